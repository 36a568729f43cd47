"""Comparisons for reviewers: blind transcriptions, versions side by side, denominators, replay metrics and the order of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ordering import beside, numbered

BUCKETS = ("2025", "2026", "unknown", "outside_scope")


def blind_comparison(first: DataFrame, later: DataFrame, keys: list[str], fields: dict[str, str], seed: str) -> DataFrame:
    """(keys, position, different, missing, sampled) of every position that either reading has.

    ``first`` and ``later`` are (keys, position, fields: map); ``fields`` maps names of the later reading to those of the first. A field that the later
    reading lacks is not compared, one that the first lacks is missing; null and '' are equal. Positions of one side only have the
    pseudo-field ``only-first`` or ``only-later``. Of the positions that agree a tenth, rounded up, is sampled by digest.
    """
    a = first.select(*keys, F.col("fields").alias("a"))
    b = later.select(*keys, "position", F.col("fields").alias("b"))
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), keys, "full_outer")
    pairs = F.array(*(F.struct(F.lit(new).alias("new"), F.lit(old).alias("old")) for new, old in sorted(fields.items())))
    plain = lambda m, k: F.nullif(F.try_element_at(m, k), F.lit(""))
    asked = F.filter(pairs, lambda p: F.map_contains_key(F.col("b"), p["new"]))
    different = F.transform(F.filter(asked, lambda p: F.map_contains_key(F.col("a"), p["old"]) & ~plain(F.col("a"), p["old"]).eqNullSafe(plain(F.col("b"), p["new"]))), lambda p: p["new"])
    missing = F.transform(F.filter(asked, lambda p: ~F.map_contains_key(F.col("a"), p["old"])), lambda p: p["new"])
    none = F.array().cast("array<string>")
    lone = F.when(F.col("__b").isNull(), F.array(F.lit("only-first"))).when(F.col("__a").isNull(), F.array(F.lit("only-later")))
    told = both.select(*keys, "position", F.coalesce(lone, different, none).alias("different"), F.when(lone.isNull(), missing).otherwise(none).alias("missing"))
    agreed = (F.size("different") == 0) & (F.size("missing") == 0)
    order = F.when(agreed, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("position").cast("string")), 256))
    placed = numbered(told.withColumn("__order", order), [], [F.asc_nulls_last("__order"), *keys], "__place")
    size = told.agg(F.ceil(F.count_if(agreed) / 10).alias("__tenth"))
    return placed.join(F.broadcast(size)).select(*keys, "position", "different", "missing", (F.col("__order").isNotNull() & (F.col("__place") <= F.col("__tenth"))).alias("sampled"))  # one row


def versions_side_by_side(positions: DataFrame, versions: DataFrame, diffs: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``positions`` that stand once by ``keys``, with the versions 1 and 2 that parsed them (``parser_version`` ends in /1 or /2; the
    first by record_id), and the one diff and the one decision of them, null where there are none or several."""
    one = lambda rows, name: rows.groupBy(*keys).agg(F.when(F.count("*") == 1, F.first(F.struct(*(c for c in rows.columns if c not in keys)))).alias(name))
    lone = positions.join(positions.groupBy(*keys).count().where("count = 1").select(*keys), keys, "left_semi")
    rest = [c for c in versions.columns if c not in keys]
    tagged = versions.withColumn("__v", F.substring_index("parser_version", "/", -1)).where("__v in ('1', '2')")
    by = tagged.groupBy(*keys).agg(*(F.min_by(F.struct(*rest), F.when(F.col("__v") == v, F.col("record_id"))).alias(f"v{v}") for v in ("1", "2")), *(F.count_if(F.col("__v") == v).alias(f"__n{v}") for v in ("1", "2")))
    by = by.select(*keys, *(F.when(F.col(f"__n{v}") > 0, F.col(f"v{v}")).alias(f"v{v}") for v in ("1", "2")))
    return lone.join(by, keys, "left").join(one(diffs, "diff"), keys, "left").join(one(decisions, "decision"), keys, "left")


def denominators(records: DataFrame, year: Column) -> DataFrame:
    """(source_name, bucket, candidate_positions, source_objects, observation_versions) for every source and bucket, zeros included; and
    with a null source_name over all. ``year`` gives a bucket of BUCKETS; only candidate positions count."""
    kept = records.where("kind = 'candidate_position'").withColumn("bucket", year)
    counted = (F.count("*").alias("candidate_positions"), F.count_distinct("source_object_id").alias("source_objects"), F.count_distinct("observation_version").alias("observation_versions"))
    measured = kept.groupBy("source_name", "bucket").agg(*counted).unionByName(kept.groupBy("bucket").agg(*counted).withColumn("source_name", F.lit(None).cast("string")), allowMissingColumns=True)
    names = records.select("source_name").distinct()
    names = names.unionByName(names.limit(1).select(F.lit(None).cast("string").alias("source_name")))
    whole = names.withColumn("bucket", F.explode(F.array(*map(F.lit, BUCKETS))))
    return beside(whole, measured, ["source_name", "bucket"]).fillna(0, ["candidate_positions", "source_objects", "observation_versions"])


def replay_metrics(entries: DataFrame, positions: DataFrame, sections: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: documents, duplicate_inputs, known_positions, routed, gaps, unexamined_sections, exceptions, rejected_claims of a batch that was
    routed again without any request.

    ``entries`` (source_sha256, source_version) are the inputs, ``positions`` (source_sha256, position_id, status) the routed positions and
    gaps, ``sections`` (source_sha256, section_id) those that nobody examined, ``rejected`` (source_sha256, claim) claims.
    """
    parts = (
        entries.agg(F.count_distinct("source_sha256", "source_version").alias("documents"), F.count("*").alias("__entries")),
        positions.agg(F.count("*").alias("known_positions"), F.count_if(F.col("status") == "routed").alias("routed")),
        sections.agg(F.count("*").alias("unexamined_sections")),
        rejected.agg(F.count("*").alias("rejected_claims")),
    )
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(F.broadcast(p))  # a row each
    gaps = F.col("known_positions") - F.col("routed")
    return whole.select(
        "documents", (F.col("__entries") - F.col("documents")).alias("duplicate_inputs"), "known_positions", "routed", gaps.alias("gaps"), "unexamined_sections", (gaps + F.col("unexamined_sections")).alias("exceptions"), "rejected_claims"
    )


def queued_cases(cases: DataFrame, scores: DataFrame, sort: str = "match-desc") -> DataFrame:
    """``cases`` (case_id, job_id, ordinal, outcome) with score and place in the order that a reviewer asks for.

    ``sort`` is match or no-match, then asc or desc. Of a case's scores (case_id, run_id, status, match, no_match, abstain) only complete ones whose
    three chances lie between 0 and 1 count, the best in that order; cases without one come last. Ties go by job, ordinal and case.
    """
    name, _, way = sort.rpartition("-")
    if name not in ("match", "no-match") or way not in ("asc", "desc"):
        raise ValueError("sort is match or no-match, then asc or desc")
    column = name.replace("-", "_")
    sound = F.lit(True)
    for c in ("match", "no_match", "abstain"):
        sound = sound & F.coalesce(F.col(c).between(0, 1), F.lit(False))
    pick = F.max if way == "desc" else F.min
    best = scores.where((F.col("status") == "complete") & sound).groupBy("case_id").agg(pick(column).alias("score"))
    turn = F.desc_nulls_last if way == "desc" else F.asc_nulls_last
    return numbered(cases.join(best, "case_id", "left"), [], [turn("score"), F.col("job_id"), F.col("ordinal"), F.col("case_id")], "place")
