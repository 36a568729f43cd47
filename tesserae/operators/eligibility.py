"""Eligibility of attempts for a comparison: every rule that fails is named, in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.facts import in_year
from tesserae.functions.reasons import reasons, status
from tesserae.functions.scalars import has_places
from tesserae.operators.ordering import repeated

#: Reasons that leave a row outside the comparison; any other reason withholds it.
FILTERS = [
    "unselected-source-view", "federation-filter", "environment-filter", "discipline-filter", "year-filter", "category-filter",
    "representation-filter",
]


@dataclass(frozen=True)
class Scope:
    """What is compared. ``categories`` gives each federation a (column, pattern) that its rows must match whole, and
    ``event_dates`` the one date of a federation's event; ``by_view`` names the federations whose view id is their date."""

    year: int
    discipline: str
    environment: str
    federations: tuple[str, ...]
    representations: tuple[str, ...]
    categories: dict[str, tuple[str, str]]
    event_dates: dict[str, str] = field(default_factory=dict)
    by_view: tuple[str, ...] = ()
    families: dict[str, str] = field(default_factory=dict)


def _holds(condition: Column) -> Column:
    """Unknown does not hold."""
    return F.coalesce(condition, F.lit(False))


def _is(value: str, wanted: str) -> Column:
    return F.col(value).eqNullSafe(F.lit(wanted))


def _reference_complete() -> Column:
    sha = "^[0-9a-f]{64}$"
    named = (F.trim("job_id") != "") & (F.trim("candidate_id") != "") & (F.col("ordinal") >= 0)
    return _holds(named & F.col("source_sha256").rlike(sha) & F.col("artifact_sha256").rlike(sha))


def eligibility(scope: Scope) -> Column:
    """The failed rules of a row, of 22. Columns: job_id, ordinal, candidate_id, source_sha256, artifact_sha256, federation,
    view_id, view_selected, environment, authority, finality, sanction (of the source); parsed_federation, event_date,
    discipline, category, gender, representation, parse_status, source_family, source_status (of the candidate); review,
    outcome, relationship, conflict_resolved, final_value (decimal), final_unit, final_basis, final_places, conversion (of
    the evidence). A rule whose columns are unknown fails, but for source_status, which must be unknown."""
    federation = F.col("federation")
    context = ~federation.eqNullSafe(F.col("parsed_federation")) | (federation.isin(*scope.by_view) & ~F.col("view_id").eqNullSafe(F.col("event_date")))
    for name, date in scope.event_dates.items():
        context |= (federation == name) & ~_is("event_date", date)
    in_category = F.lit(False)
    for name, (column, pattern) in scope.categories.items():
        in_category |= _holds((federation == name) & F.col(column).rlike(f"^(?:{pattern})$"))
    family = F.lit(True)
    for name, wanted in scope.families.items():
        family &= ~_holds(federation == name) | _is("source_family", wanted)
    distance = (F.col("final_value") > 0) & (F.col("final_unit") == "m") & (F.col("final_basis") == "verified-post-penalty")
    precision = (F.col("final_places") >= 0) & has_places(F.col("final_value"), F.col("final_places"))
    return reasons(
        ("missing-exact-reference", ~_reference_complete()),
        ("unselected-source-view", ~_holds(F.col("view_selected"))),
        ("source-context-conflict", F.coalesce(context, F.lit(True))),
        ("federation-filter", ~_holds(federation.isin(*scope.federations))),
        ("environment-filter", ~_is("environment", scope.environment)),
        ("discipline-filter", ~_is("discipline", scope.discipline)),
        ("year-filter", ~in_year(F.col("event_date"), scope.year)),
        ("category-filter", ~in_category),
        ("representation-filter", ~_holds(F.col("representation").isin(*scope.representations))),
        ("unparsed", ~_is("parse_status", "parsed")),
        ("not-attempt-view", ~family),
        ("unverified-source-authority", ~_is("authority", "official-results")),
        ("unverified-source-finality", ~_is("finality", "verified-final")),
        ("unverified-sanction", ~_is("sanction", "eligible")),
        ("unverified-review", ~_is("review", "verified")),
        ("unverified-outcome", ~_holds(F.col("outcome").isin("finally-valid", "finally-valid-penalized"))),
        ("unresolved-attempt-relationship", ~_is("relationship", "distinct")),
        ("unverified-final-distance", ~_holds(distance)),
        ("unverified-final-precision", ~_holds(precision)),
        ("unverified-final-conversion", ~_is("conversion", "verified")),
        ("source-status-conflict", F.col("source_status").isNotNull()),
        ("source-conflict", ~_holds(F.col("conflict_resolved"))),
    )


def attempt_accounts(rows: DataFrame, scope: Scope, key: list[str], unselected: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Each row with reasons and status (excluded, withheld, ranked).

    ``key`` is a row's exact reference: rows that share one are all withheld as duplicate-reference. ``unselected`` (the same
    key columns) lists references that a selection was made against: non-selected-source-claim. Repeated references are found from
    ``references`` (a table with one row for each of ``rows``, else ``rows`` itself) by their hashes and joined back, so copies of one
    reference do not meet in one task's window.
    """
    copies = repeated((rows if references is None else references).select(*key), key)
    copies = copies.select(*(F.col(k).alias(f"__r_{k}") for k in key), F.lit(True).alias("__repeated"))
    same = lambda side: [F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in key]
    out = rows.withColumn("reasons", eligibility(scope)).join(copies, same("__r_"), "left")
    if unselected is None:
        out = out.withColumn("__other", F.lit(False))
    else:
        claims = unselected.select(*(F.col(k).alias(f"__u_{k}") for k in key)).distinct().withColumn("__other", F.lit(True))
        out = out.join(claims, same("__u_"), "left")
    late = reasons(("duplicate-reference", F.col("__repeated")), ("non-selected-source-claim", F.col("__other")))
    out = out.withColumn("reasons", F.concat("reasons", late))
    return out.withColumn("status", status(F.col("reasons"), FILTERS)).select(*rows.columns, "reasons", "status")
