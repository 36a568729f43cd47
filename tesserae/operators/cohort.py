"""Historical cohorts: what a selection of routes and leads cites, and the gate that known gaps keep closed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("checked", "unchecked", "gap", "unavailable")


def selected(tables: dict[str, DataFrame], route: str | None = None, lead: str | None = None, status: str | None = None) -> dict[str, DataFrame]:
    """The tables (routes, leads, sources, events, positions, gaps, relationships) as far as a selection cites them.

    Leads are chosen by route (route_ids), id and state (source_state), routes by id and status or because a chosen lead names
    them; then sources of the leads (source_ids), their events (event_ids) and positions (source_id), gaps of these and of the search,
    and relationships (left, right) between two chosen positions. Without any filter everything stays. A route or lead
    that is not there, or another state, is an error.
    """
    for name, value, rows in (("route", route, tables["routes"]), ("lead", lead, tables["leads"])):
        if value is not None and rows.where(F.col("id") == value).isEmpty():
            raise ValueError(f"unknown {name} filter")
    if status is not None and status not in STATES:
        raise ValueError("unknown status filter")
    keep = lambda value, rule: F.lit(True) if value is None else rule
    leads = tables["leads"].where(keep(route, F.array_contains("route_ids", F.lit(route))) & keep(lead, F.col("id") == lead) & keep(status, F.col("source_state") == status))
    named = leads.select(F.explode("route_ids").alias("id")).distinct().withColumn("__named", F.lit(True))
    marked = tables["routes"].join(named, "id", "left").withColumn("__named", F.coalesce("__named", F.lit(False)))
    routes = marked.where(keep(route, F.col("id") == route) & keep(lead, F.col("__named")) & keep(status, (F.col("status") == status) | F.col("__named"))).drop("__named")
    out = tables | {"routes": routes, "leads": leads}
    if route is None and lead is None and status is None:
        return out
    semi = lambda rows, by, keys: rows.join(keys.select(F.col("id").alias(by)), by, "left_semi")
    out["sources"] = semi(tables["sources"], "id", leads.select(F.explode("source_ids").alias("id")))
    out["events"] = semi(tables["events"], "id", out["sources"].select(F.explode("event_ids").alias("id")))
    out["positions"] = semi(tables["positions"], "source_id", out["sources"])
    gaps = tables["gaps"]
    out["gaps"] = functools.reduce(
        DataFrame.unionByName, (gaps.where("scope = 'search'"), *(semi(gaps.where(F.col("scope") == scope), "ref", out[f"{scope}s"]).select(*gaps.columns) for scope in ("source", "event")))
    )
    out["relationships"] = semi(semi(tables["relationships"], "left", out["positions"]), "right", out["positions"]).select(*tables["relationships"].columns)
    return out


def gate(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, ref, reason) of everything that keeps ordinary ingestion closed; it is open if there is no row.

    Routes and leads that are not resolved, resolved leads with attempts whose fields are not all known, gaps of the census, sources with
    gaps in their provenance, and positions that are not parsed or not resolved.
    """
    text = lambda c: F.array_join(c, "; ")
    row = lambda rows, kind, when, reason: rows.where(when).select(F.lit(kind).alias("kind"), F.col("id").alias("ref"), reason.alias("reason"))
    open_: Column = ~F.coalesce(F.col("disposition") == "resolved", F.lit(False))
    unknown = (F.size("unknown_fields") > 0) & (F.col("disposition") == "resolved") & (F.col("resolution") == "attempt-results")
    unparsed = ~F.coalesce(F.col("status") == "parsed", F.lit(False)) | (F.coalesce("unresolved_reason", F.lit("")) != "")
    return functools.reduce(
        DataFrame.unionByName,
        (
            row(tables["routes"], "route", open_, F.col("evidence")),
            row(tables["leads"], "lead", open_, F.col("evidence")),
            row(tables["leads"], "lead", unknown, F.concat(F.lit("Unknown event fields: "), F.array_join("unknown_fields", ", "))),
            row(tables["gaps"], "census-gap", F.lit(True), F.col("reason")),
            row(tables["sources"], "source", F.size("provenance_gaps") > 0, text("provenance_gaps")),
            row(tables["positions"], "position", unparsed, F.coalesce(F.nullif("unresolved_reason", F.lit("")), "status")),
        ),
    )


def ingested(tables: dict[str, DataFrame], candidate: DataFrame, year: int) -> DataFrame:
    """``candidate`` events (held_from, held_to), once the gate is open and all are held in ``year``; else an error, before any
    row is used."""
    if not gate(tables).isEmpty():
        raise ValueError(f"ordinary {year} ingestion is closed by known gaps")
    inside = F.coalesce(F.col("held_from").startswith(f"{year}-") & F.col("held_to").startswith(f"{year}-"), F.lit(False))
    if candidate.isEmpty() or not candidate.where(~inside).isEmpty():
        raise ValueError("ordinary ingestion needs events, all of them in its year")
    return candidate
