"""Aggregations: grouped counts, zero-filled domains, rates with explicit denominators, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(counts: DataFrame, domain: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row for each key of ``domain``, 0 where ``counts`` has none."""
    return domain.join(counts, keys, "left").select(*keys, F.coalesce(value, F.lit(0)).cast("long").alias(value))


def pivoted(rows: DataFrame, keys: list[str], column: str, domain: list[str]) -> DataFrame:
    """Counts of a fixed domain as columns, zero-filled, in one aggregation."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(v) for v in domain))


def merged_counts(*tables: DataFrame, key: str, value: str) -> DataFrame:
    """Count maps added up by key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.sum(value).alias(value))


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; null (unknown) where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole)


def confusion(cases: DataFrame, truth: str, outcome: str, *keys: str) -> DataFrame:
    """Counts and rates of match / no-match outcomes; abstentions and errors stay in the denominators."""
    yes, no = F.col(truth) == "match", F.col(truth) == "no-match"
    said, denied = F.col(outcome) == "match", F.col(outcome) == "no-match"
    counted = cases.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.count_if(yes & said).alias("true_match"),
        F.count_if(no & said).alias("false_match"),
        F.count_if(no & denied).alias("true_no_match"),
        F.count_if(yes & denied).alias("false_no_match"),
        F.count_if(F.col(outcome) == "abstain").alias("abstained"),
        F.count_if(F.col(outcome) == "error").alias("errors"),
        F.count_if(yes).alias("positives"),
    )
    return counted.withColumn("recall", rate(F.col("true_match"), F.col("positives"))).withColumn("precision", rate(F.col("true_match"), F.col("true_match") + F.col("false_match"))).withColumn("coverage", rate(F.col("cases") - F.col("abstained") - F.col("errors"), F.col("cases")))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Measured and unknown counts, total, mean and nearest-rank median and 95th percentile."""
    kind = rows.schema[value].dataType
    return rows.groupBy(*keys).agg(
        F.count(value).alias("measured"),
        F.count_if(F.col(value).isNull()).alias("unknown"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").cast(kind).alias("median"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").cast(kind).alias("p95"),
    )


def cost(rows: DataFrame, amount: str, currency: str, *keys: str) -> DataFrame:
    """total and currency, both null where any row is not metered or currencies mix."""
    known = (F.count_if(F.col(amount).isNull() | F.col(currency).isNull()) == 0) & (F.count_distinct(currency) == 1)
    return rows.groupBy(*keys).agg(F.when(known, F.sum(amount)).alias("total"), F.when(known, F.min(currency)).alias("currency"))


def once_per_basis(rows: DataFrame, keys: list[str], basis: str, count: str) -> DataFrame:
    """Totals that count each basis once; conflict where one basis states two counts."""
    lone = rows.groupBy(*keys, basis).agg(F.max(count).alias("__n"), (F.count_distinct(count) > 1).alias("__bad"))
    return lone.groupBy(*keys).agg(F.sum("__n").alias("total"), F.bool_or("__bad").alias("conflict"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that does not depend on the order of rows."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.expr("bit_xor(xxhash64(*))"), F.lit(0).cast("long")).alias("digest"))


def ordered_digest(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """SHA-256 over the sorted values of each key, joined by commas."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), ","), 256).alias("digest"))


def pairs_within(rows: DataFrame, key: str) -> DataFrame:
    """(groups, members, pairs): the n(n-1)/2 denominators of groups, without making a pair."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))
