"""Places, running sums and carried values inside hot groups: no group passes through one task.

Rows are dealt to ranges of (group, order) whose bounds Spark draws from the rows themselves, and written once, since bounds are
drawn anew each time that they are asked for. Windows run inside a range only; what the ranges before hold of a group comes from a table
with one row for each range and group. A group of a third of all rows is many ranges, outliers and repeated values change
nothing while the order has few ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.stored import removed, stored

#: So many rows (of counts, not of data) may pass through one task.
SMALL = 200_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly to four tasks a core, for work whose time is not told by the bytes that it reads: a small file is one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def parted(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` dealt to ranges and written, with the number of the range in ``__part``."""
    return stored(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def beside(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``other`` on equal ``keys``, null with null; the columns of ``other`` that are no keys are added."""
    renamed = other.withColumnsRenamed({k: f"__on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__on_{k}"))
    return rows.join(renamed, same, how).drop(*(f"__on_{k}" for k in keys))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` (null equal to null) that stand in more than one row, written.

    Hashes are counted first, so that all but the rows of repeated hashes are a number each in the shuffle; these rows are then
    counted by the keys themselves, so hashes that meet by chance change nothing.
    """
    number = F.xxhash64(*keys)
    twice = stored(rows.groupBy(number.alias("__hash")).agg(F.count("*").alias("__n")).where("__n > 1").select("__hash"), "hashes")
    found = rows.select(*keys).join(twice, number == F.col("__hash"), "left_semi")
    out = stored(found.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys), "repeated")
    removed(twice)
    return out


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place from 1 within ``keys`` (the whole table if there are none) in a total order."""
    ranged = parted(rows, keys, order)
    counts = ranged.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy(*keys).orderBy("__part")) - F.col("__n")).drop("__n")
    inner = F.row_number().over(W.partitionBy("__part", *keys).orderBy(*order))
    return beside(ranged.withColumn("__inner", inner), before, ["__part", *keys]).withColumn(name, (F.col("__inner") + F.col("__before")).cast("long")).drop("__part", "__inner", "__before")


def sums_before(counts: DataFrame, keys: list[str], order: Column, n: str, name: str) -> DataFrame:
    """``counts`` with the sum of ``n`` over the rows of the same ``keys`` that come before in ``order`` (in which no two are equal).
    Few rows go through a plain window, more through ranges."""
    counts = stored(counts, "counts")
    if counts.count() <= SMALL:
        return counts.withColumn(name, F.sum(n).over(W.partitionBy(*keys).orderBy(order)) - F.col(n))
    ranged = parted(counts, keys, [order])
    sums = ranged.groupBy("__part", *keys).agg(F.sum(n).alias("__n"))
    before = sums.withColumn("__before", F.sum("__n").over(W.partitionBy(*keys).orderBy("__part")) - F.col("__n")).drop("__n")
    inner = F.sum(n).over(W.partitionBy("__part", *keys).orderBy(order)) - F.col(n)
    return beside(ranged.withColumn("__inner", inner), before, ["__part", *keys]).withColumn(name, F.col("__inner") + F.col("__before")).drop("__part", "__inner", "__before")


def known_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the last ``value`` that is not null of the rows of the same ``keys`` before each, in a total order."""
    ranged = parted(rows, keys, order)
    last = ranged.groupBy("__part", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__last"))
    carried = last.withColumn("__carried", F.last("__last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).drop("__last")
    inner = F.last(value, ignorenulls=True).over(W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return beside(ranged.withColumn("__inner", inner), carried, ["__part", *keys]).withColumn(name, F.coalesce("__inner", "__carried")).drop("__part", "__inner", "__carried")
