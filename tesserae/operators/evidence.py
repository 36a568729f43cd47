"""Binding of decisions to exact evidence: cited records, current events, replaced evidence, agreement of two views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason


def bound_evidence(citations: DataFrame, records: DataFrame, key: list[str], citation: str, record: str) -> DataFrame:
    """Each citation with the one record of its full key, and why it is bound to none.

    missing: no record has the key; ambiguous: several have; reused: the record is cited more than once. A null in the key
    matches a null. Only a citation without a problem carries a record. Records are counted per key before the join, so a key
    with many records sends one row.
    """
    known = records.groupBy(*key).agg(F.count("*").alias("__n"), F.min(record).alias("__record"))
    cited = citations.groupBy(*key).agg(F.count("*").alias("__uses"))
    right = known.select(*(F.col(k).alias(f"__k_{k}") for k in key), "__n", "__record")
    uses = cited.select(*(F.col(k).alias(f"__c_{k}") for k in key), "__uses")
    same = lambda side: [F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in key]
    both = citations.join(uses, same("__c_"), "left").join(right, same("__k_"), "left")
    problem = first_reason(("missing", F.col("__n").isNull()), ("ambiguous", F.col("__n") > 1), ("reused", F.col("__uses") > 1))
    return both.select(citation, problem.alias("problem"), F.when(problem.isNull(), F.col("__record")).alias(record))


def current_events(events: DataFrame, questions: DataFrame, key: list[str], revision: str, carried: list[str]) -> DataFrame:
    """Each question (key columns) with the newest event of its key; no event leaves null. Ties of a revision go to the
    greatest values of ``carried``."""
    newest = events.groupBy(*key).agg(F.max(F.struct(revision, *carried)).alias("__e"))
    return questions.join(newest, key, "left").select(*questions.columns, *(F.col(f"__e.{c}").alias(c) for c in (revision, *carried)))


def rebased(history: DataFrame, fresh: DataFrame, subject: str, digest: str, state: str) -> DataFrame:
    """History with ``state`` set to invalidated where the evidence of the subject was replaced or is gone; other rows keep
    their state. ``fresh`` holds one digest a subject."""
    now = fresh.select(F.col(subject).alias("__s"), F.col(digest).alias("__d"))
    both = history.join(now, F.col(subject) == F.col("__s"), "left")
    stands = F.coalesce(F.col(digest) == F.col("__d"), F.lit(False))
    return both.withColumn(state, F.when(stands, F.col(state)).otherwise("invalidated")).select(*history.columns)


def view_census(view: DataFrame, expected: int, first: DataFrame, second: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(problem, rows) of a view that must hold ``expected`` rows, all parsed, and that two parser versions must read alike
    row by row. No rows: the census holds. Repeated rows count as often as they stand."""
    count = view.agg(F.count("*").alias("rows")).where(F.col("rows") != expected).select(F.lit("unexpected-count").alias("problem"), "rows")
    unparsed = view.where("parse_status is distinct from 'parsed'").agg(F.count("*").alias("rows")).select(F.lit("unparsed").alias("problem"), "rows")
    columns = [*key, *compared]
    signed = lambda rows, by: rows.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("n", F.col("n") * by)
    apart = signed(first, 1).unionByName(signed(second, -1)).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
    apart = apart.select(*key).distinct().agg(F.count("*").alias("rows")).select(F.lit("versions-differ").alias("problem"), "rows")
    return count.unionByName(unparsed.where("rows > 0")).unionByName(apart.where("rows > 0"))


def audit_counts(edges: DataFrame, jobs: list[str], hashes: list[str]) -> DataFrame:
    """(counter, n): distinct jobs and hashes over both ends of all edges, and edges by kind."""
    ends = lambda columns: F.explode(F.array(*columns))
    distinct = lambda columns, name: edges.select(ends(columns).alias("v")).agg(F.count_distinct("v").alias("n")).select(F.lit(name).alias("counter"), "n")
    kinds = edges.groupBy(F.concat(F.lit("edges:"), F.col("kind")).alias("counter")).agg(F.count("*").alias("n"))
    return distinct(jobs, "jobs").unionByName(distinct(hashes, "hashes")).unionByName(kinds)


def multi_grain_counts(rows: DataFrame, source: str, version: str, position: str, attempt: str) -> DataFrame:
    """One row: how many sources, versions (of a source), positions (of a version) and attempts the rows hold. Each grain is
    counted on its own distinct keys; unknown attempts do not count."""
    grain = lambda *keys: rows.select(*keys).distinct().agg(F.count("*").alias("n"))
    known = rows.where(F.col(attempt).isNotNull())
    parts = [
        grain(source).withColumnRenamed("n", "sources"), grain(source, version).withColumnRenamed("n", "versions"),
        grain(source, version, position).withColumnRenamed("n", "positions"), known.select(attempt).distinct().agg(F.count("*").alias("attempts")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def within_bound(*parts: DataFrame, text: str, most_bytes: int, most_rows: int) -> DataFrame:
    """One row: rows, bytes and whether both stay within their bounds, over all given histories together."""
    sums = [p.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes")) for p in parts]
    joined = sums[0]
    for more in sums[1:]:
        joined = joined.unionByName(more)
    total = joined.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return total.withColumn("within", (F.col("rows") <= most_rows) & (F.col("bytes") <= most_bytes))
