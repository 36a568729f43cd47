"""Rosters of discovery routes and their leads: the newest roster, its checks, filters and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason
from tesserae.operators.snapshot import browse


def newest_roster(records: DataFrame, name: str, prefix: str) -> DataFrame:
    """Records of the source named ``prefix`` and the highest number; names of any other form are left out."""
    number = F.regexp_extract(name, rf"^{prefix}([0-9]+)$", 1)
    numbered = records.withColumn("__n", F.nullif(number, F.lit("")).try_cast("long"))
    newest = numbered.agg(F.max("__n").alias("__n"))
    return numbered.join(F.broadcast(newest), "__n", "left_semi").drop("__n")  # one row


def year_label(year: Column) -> Column:
    """The year as text, or ``unknown``."""
    return F.coalesce(year.cast("string"), F.lit("unknown"))


def roster_problems(routes: DataFrame, leads: DataFrame) -> DataFrame:
    """(problem, id): repeated route ids, repeated lead ids, and leads of a route that is not there. No rows: the roster holds."""
    repeated = lambda rows, what: rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(what).alias("problem"), "id")
    lost = leads.join(routes.select(F.col("id").alias("route_id")), "route_id", "left_anti").select(F.lit("unknown-route").alias("problem"), "id")
    return repeated(routes, "repeated-route").unionByName(repeated(leads, "repeated-lead")).unionByName(lost)


def filtered_leads(leads: DataFrame, year: str | None = None, **equal: object) -> DataFrame:
    """Leads that equal every given value; ``year`` is a year's text or ``unknown``."""
    rows = browse(leads, **equal)
    return rows if year is None else rows.where(year_label(F.col("competition_year")) == year)


def lead_order() -> list[Column]:
    """By route, then year (unknown last), date and event (unknown first), then id."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("route_id"), F.coalesce(F.col("competition_year"), F.lit(9999)), text("competition_date"), text("event_key"), F.col("id")]


def roster_summary(routes: DataFrame, leads: DataFrame, statuses: list[str], years: list[str]) -> DataFrame:
    """One row a route (leads or none): lead_count, and zero-filled counts by status and by year as maps."""
    label = year_label(F.col("competition_year"))
    counts = lambda column, names: [F.count_if(column == n).alias(f"__{n}") for n in names]
    per_route = leads.groupBy("route_id").agg(F.count("*").alias("lead_count"), *counts(F.col("status"), statuses), *counts(label, years))
    filled = lambda names: F.create_map(*(x for n in names for x in (F.lit(n), F.coalesce(F.col(f"`__{n}`"), F.lit(0).cast("long")))))
    joined = routes.select(F.col("id").alias("route_id")).join(per_route, "route_id", "left")
    return joined.select("route_id", F.coalesce("lead_count", F.lit(0).cast("long")).alias("lead_count"), filled(statuses).alias("by_status"), filled(years).alias("by_year"))


#: What a route or lead may say of itself.
STATUSES = ("unchecked", "checked", "gap", "unavailable")
RELATIONSHIPS = ("unknown", "same-event", "distinct-event", "overlap")
YEARS = (2025, 2026)
_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _history_problem(history: Column, status: Column, cutoff: Column) -> Column:
    """Whether a history (at, status) is out of order, beyond the cutoff, unknown in a status, or ends in another one."""
    at = F.transform(history, lambda h: F.try_to_timestamp(h["at"]))
    rising = F.forall(F.zip_with(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.coalesce(a < b, F.lit(False))), lambda x: x)
    sound = F.forall(history, lambda h: F.coalesce(h["status"].isin(*STATUSES) & h["at"].rlike(_INSTANT), F.lit(False))) & F.forall(at, lambda t: F.coalesce(t <= cutoff, F.lit(False)))
    return F.coalesce((F.size(history) > 0) & ~(rising & sound & (F.element_at(history, -1)["status"] == status)), F.lit(False))


def route_problems(routes: DataFrame, cutoff: str, roles: tuple[str, ...]) -> DataFrame:
    """(id, problem): the first rule that a route (id, status, role, authority, checked_at, receipt, history: array of (at, status)) breaks.

    An unchecked route has neither check nor receipt, any other one has both, checked by the cutoff; a history rises and ends in the route's
    status, at the time of its check.
    """
    end = F.to_timestamp(F.lit(cutoff))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    at = F.try_to_timestamp("checked_at")
    waiting = F.col("status") == "unchecked"
    last = F.try_element_at("history", F.lit(-1))["at"]
    problem = first_reason(
        ("missing-id", blank("id")),
        ("invalid-status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("invalid-role", ~F.coalesce(F.col("role").isin(*roles), F.lit(False))),
        ("missing-authority", blank("authority")),
        ("unchecked-with-receipt", waiting & (F.col("checked_at").isNotNull() | F.col("receipt").isNotNull())),
        ("invalid-check", ~waiting & ~F.coalesce(F.col("checked_at").rlike(_INSTANT) & at.isNotNull(), F.lit(False))),
        ("checked-after-cutoff", ~waiting & (at > end)),
        ("missing-receipt", ~waiting & blank("receipt")),
        ("invalid-history", _history_problem(F.col("history"), F.col("status"), end)),
        ("history-check-mismatch", last.isNotNull() & F.col("checked_at").isNotNull() & (F.try_to_timestamp(last) != at)),
    )
    return routes.select("id", problem.alias("problem"))


def lead_problems(leads: DataFrame, routes: DataFrame, cutoff: str) -> DataFrame:
    """(id, problem): the first rule that a lead (id, route_id, status, title, competition_date, competition_date_to, competition_year,
    date_evidence, citation_sha256, relationship, snapshot_ids, candidate_snapshot_ids, history) breaks, its route (id, receipt) included.

    A known date needs evidence and its own year, a range does not run backwards or into another year, the citation is that of the route's receipt,
    and a snapshot is proven or a candidate, not both.
    """
    date = lambda c: F.try_to_date(F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c)))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    first, last = date("competition_date"), date("competition_date_to")
    known = routes.groupBy(F.col("id").alias("route_id")).agg(F.max("receipt").alias("__receipt"), F.lit(True).alias("__known"))
    wrong_date = lambda c, d: F.col(c).isNotNull() & ~F.coalesce(F.year(d).isin(*YEARS), F.lit(False))
    year = F.col("competition_year")
    problem = first_reason(
        ("missing-id", blank("id")),
        ("unknown-route", F.col("__known").isNull()),
        ("invalid-status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("invalid-date", wrong_date("competition_date", first) | wrong_date("competition_date_to", last)),
        ("invalid-date-range", last.isNotNull() & (first.isNull() | (last < first))),
        ("invalid-year", year.isNotNull() & ~year.isin(*YEARS)),
        ("year-mismatch", first.isNotNull() & (~year.eqNullSafe(F.year(first)) | F.coalesce(F.year(last) != year, F.lit(False)))),
        ("date-without-evidence", first.isNotNull() & F.col("date_evidence").isNull()),
        ("citation-not-of-receipt", F.col("__receipt").isNotNull() & ~F.col("citation_sha256").eqNullSafe(F.col("__receipt"))),
        ("missing-title", blank("title")),
        ("invalid-relationship", ~F.coalesce("relationship", F.lit("unknown")).isin(*RELATIONSHIPS)),
        ("proven-and-candidate", F.coalesce(F.arrays_overlap("snapshot_ids", "candidate_snapshot_ids"), F.lit(False))),
        ("invalid-history", _history_problem(F.col("history"), F.col("status"), F.to_timestamp(F.lit(cutoff)))),
    )
    return leads.join(known, "route_id", "left").select("id", problem.alias("problem"))
