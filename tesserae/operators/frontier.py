"""The discovery frontier: routes to check, leads they give, dispositions and a budget of requests.

A lead has one identity however many routes lead to it; each route and piece of evidence is one edge. The frontier is three
tables (routes, leads, edges) that are only added to; operators return the rows to add, so that a rerun adds nothing.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISPOSITIONS = ("acquired", "gap", "unsupported", "out_of_scope")
OUTSIDE = "year or source family outside declared scope"


def lead_key(url: Column, year: Column, family: Column, context: Column) -> Column:
    """Identity of a lead: its url, year, family and context (a day or session that shares a url); the route is no part of it."""
    return F.sha2(F.to_json(F.struct(url.alias("url"), year.alias("year"), family.alias("family"), context.alias("context")), {"ignoreNullFields": "false"}), 256)


def added(leads: DataFrame, edges: DataFrame, found: DataFrame, routes: DataFrame, years: list[int], families: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads to add, edges to add, rejected) of a batch ``found`` (n, url, route, year, source_family, context, evidence).

    ``leads`` is (key, url, year, source_family, outside), ``edges`` (key, route, evidence). Rejected rows (n, reason) have a
    route that is not declared or no evidence. The same edge twice is one; a lead outside of the declared years and families is
    known, and out of scope from the start. Of equal leads the first of the batch (by n) names the url.
    """
    known = found.join(routes.select("route", F.lit(True).alias("__declared")), "route", "left")
    reason = F.when(F.col("__declared").isNull(), "route").when(F.coalesce(F.trim("evidence"), F.lit("")) == "", "evidence")
    judged = known.withColumn("reason", reason).withColumn("key", lead_key(F.col("url"), F.col("year"), F.col("source_family"), F.col("context")))
    good = judged.where("reason is null")
    outside = ~(F.coalesce(F.col("year").isin(*years), F.lit(False)) & F.coalesce(F.col("source_family").isin(*families), F.lit(False)))
    first = good.groupBy("key").agg(F.min_by(F.struct("url", "year", "source_family"), "n").alias("lead")).select("key", "lead.*").withColumn("outside", outside)
    return (
        first.join(leads.select("key"), "key", "left_anti"),
        good.select("key", "route", "evidence").distinct().join(edges, ["key", "route", "evidence"], "left_anti"),
        judged.where("reason is not null").select("n", "reason"),
    )


def dispositions(leads: DataFrame, told: DataFrame) -> DataFrame:
    """(key, status, evidence) of every lead: what was told last (key, revision, status, evidence), out_of_scope for leads outside
    that nothing is told of, null for unchecked ones. Statuses that do not exist and leads that are not known count for nothing."""
    last = told.where(F.col("status").isin(*DISPOSITIONS)).groupBy("key").agg(F.max(F.struct("revision", "status", "evidence")).alias("last"))
    joined = leads.join(last, "key", "left")
    status = F.coalesce("last.status", F.when(F.col("outside"), "out_of_scope"))
    return joined.select("key", status.alias("status"), F.coalesce("last.evidence", F.when(F.col("outside"), OUTSIDE)).alias("evidence"))


def spent(requests: DataFrame, budget: int) -> DataFrame:
    """``requests`` (session, n, count) with ``granted``: in order of n, a request is granted if it and all granted before
    it in its session fit the budget; a smaller one may still fit after a refusal. Counts below 1 are refused.

    A session's requests are one order and so one task's work.
    """
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select("session", "n", "count").schema)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows, used, granted = rows.sort_values("n"), 0, []
        for count in rows["count"]:
            fits = count >= 1 and used + count <= budget
            used += count if fits else 0
            granted.append(fits)
        return rows.assign(granted=granted)

    return requests.select("session", "n", "count").groupBy("session").applyInPandas(each, f"{kind}, granted boolean")


def summary(routes: DataFrame, leads: DataFrame, told: DataFrame, granted: DataFrame) -> DataFrame:
    """One row: state (complete, or checkpoint while something is unchecked), unchecked routes and leads, gaps, leads, requests.

    ``routes`` is (route, status: unchecked, checked or gap); a lead that is unsupported is a gap as well.
    """
    own = dispositions(leads, told)
    by_route = routes.agg(F.count_if(F.col("status") == "unchecked").alias("unchecked_routes"), F.count_if(F.col("status") == "gap").alias("route_gaps"))
    by_lead = own.agg(F.count_if(F.col("status").isNull()).alias("unchecked_leads"), F.count_if(F.col("status").isin("gap", "unsupported")).alias("lead_gaps"), F.count("*").alias("leads"))
    requests = granted.agg(F.coalesce(F.sum(F.when(F.col("granted"), F.col("count"))), F.lit(0)).cast("long").alias("requests"))
    whole = functools.reduce(lambda a, b: a.join(F.broadcast(b)), (by_route, by_lead, requests))  # a row each
    done = (F.col("unchecked_routes") == 0) & (F.col("unchecked_leads") == 0)
    return whole.select(F.when(done, "complete").otherwise("checkpoint").alias("state"), "unchecked_routes", "unchecked_leads", (F.col("route_gaps") + F.col("lead_gaps")).alias("gaps"), "leads", "requests")


def frontier_pages(leads: DataFrame, told: DataFrame, budget: int, batch: Column) -> DataFrame:
    """(key, url, page) of the leads that come next: the unchecked ones by ``batch`` and key, ``budget`` of them."""
    waiting = leads.join(dispositions(leads, told).where("status is null").select("key"), "key", "left_semi")
    return waiting.select("key", "url", batch.alias("page")).orderBy("page", "key").limit(budget)
