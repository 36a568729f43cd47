"""The attempt inspector: bind, compare, score, rank, filter and page in one plan; and the public facade over projected results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import eligibility, paging, ranking, sporting
from tesserae.operators.ordering import repeated
from tesserae.sources.stored import stored

REFERENCE = ["job_id", "ordinal", "candidate_id", "source_sha256", "artifact_sha256"]
#: What a claim about an attempt says; an observation without exactly one claim says nothing of it.
CLAIM = ("authority", "finality", "sanction", "review", "outcome", "relationship", "conflict_resolved", "final_value", "final_unit", "final_basis", "final_places", "conversion", "country", "continent")
FILTERS = ("federation", "environment", "discipline", "gender", "category", "representation", "review")
WILD = (None, "", "all")


@dataclass
class Inspection:
    """``rows`` is one page, ``all`` every row that the filters leave, ``facets`` the choices of each filter over all rows whatever is
    filtered, ``coverage`` one row (provided, ranked, withheld, excluded)."""

    rows: DataFrame
    all: DataFrame
    facets: DataFrame
    coverage: DataFrame


def bound(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """``observations`` with the columns of CLAIM of their one claim by full reference, and ``claims``, how many there are."""
    copies = repeated(claims, REFERENCE)
    several = stored(claims.join(copies, REFERENCE, "left_semi").groupBy(*REFERENCE).agg(F.count("*").alias("__n")), "several")
    one = claims.join(copies, REFERENCE, "left_anti").select(*REFERENCE, F.struct(*CLAIM).alias("claim"))
    joined = observations.join(one, REFERENCE, "left").join(several, REFERENCE, "left")
    number = F.when(F.col("claim").isNotNull(), 1).otherwise(F.coalesce("__n", F.lit(0))).cast("long")
    return joined.withColumns({c: F.col(f"claim.{c}") for c in CLAIM} | {"claims": number}).drop("claim", "__n")


def inspect(observations: DataFrame, claims: DataFrame, scope: eligibility.Scope, family: str, filters: dict[str, str | None] | None = None, limit: int = 50, offset: int = 0) -> Inspection:
    """Every contract is computed anew from the observations (columns of ``eligibility.eligibility`` but for CLAIM) and the claims, then
    filtered.

    A filter on a column of FILTERS keeps equal values ('all', '' and None keep everything); another one is an error. Ranks and
    denominators (national, continental, international) count the rows that the filters leave. ``family`` is the scoring family of the scope's
    discipline.
    """
    filters = filters or {}
    if set(filters) - set(FILTERS):
        raise ValueError(f"unsupported filters: {sorted(set(filters) - set(FILTERS))}")
    accounts = eligibility.attempt_accounts(bound(observations, claims), scope, REFERENCE, references=observations)
    # what is asked of an attempt from here on, and no other column of the observations
    judged = stored(accounts.select(*REFERENCE, *FILTERS, "reasons", "status", "final_unit", "final_value", "country", "continent"), "judged")
    facets = judged.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in FILTERS))
    kept = judged
    for column, value in filters.items():
        if value not in WILD:
            kept = kept.where(F.col(column) == value)
    ranked = F.col("status") == "ranked"
    shown = F.struct(*REFERENCE, *FILTERS, "reasons", F.col("status").alias("comparison")).alias("row")
    attempts = kept.select(F.col("candidate_id").alias("id"), F.lit(family).alias("discipline"), F.col("final_unit").alias("unit"), F.col("final_value").alias("value"), ranked.alias("reviewed"), "country", "continent", shown)
    scored = ranking.scores(attempts).withColumn("score", F.when(F.col("id").isNotNull(), F.col("score")))
    placed = sporting.sporting_ranks(scored.select(F.lit("scope").alias("cohort_id"), F.col("id").alias("result_id"), "score", "country", "continent", "row")).drop("status")
    out = placed.select("row.*", "score", "country", "continent", *(f"{s}_{c}" for s in sporting.SCOPES for c in ("rank", "peers")))
    count = lambda status: F.count_if(F.col("comparison") == status).alias(status)
    coverage = out.agg(F.count("*").alias("provided"), *(count(s) for s in ("ranked", "withheld", "excluded")))
    return Inspection(paging.page(out, [F.asc_nulls_last("international_rank"), "candidate_id", "job_id", "ordinal"], limit, offset), out, facets, coverage)


class PublicResults:
    """Read-only answers over public results (result_id, source_name, identity_id, body, ...)."""

    def __init__(self, results: DataFrame):
        self.shown = results

    def results(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return paging.page(self.shown, ["result_id"], limit, offset)

    def search(self, source_name: str) -> DataFrame:
        """Results of exactly this name, as written."""
        return self.shown.where(F.col("source_name") == source_name)

    def result(self, result_id: str) -> DataFrame:
        return self.shown.where(F.col("result_id") == result_id)

    def history(self, identity_id: str) -> DataFrame:
        return self.shown.where(F.col("identity_id") == identity_id)

    def coverage(self) -> DataFrame:
        """One row: results, identities, scope and completeness."""
        return self.shown.agg(F.count("*").alias("results"), F.count_distinct("identity_id").alias("identities")).withColumns({"scope": F.lit("pilot"), "completeness": F.lit("partial")})
