"""Row context by windows: neighbours, continuation lines, carried headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearby(rows: DataFrame, keys: list[str], order: list[str], value: Column, back: int, ahead: int) -> DataFrame:
    """before: the last non-null ``value`` in the ``back`` rows before; after: the first one in the ``ahead`` rows after."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("before", F.last(value, ignorenulls=True).over(window.rowsBetween(-back, -1))).withColumn("after", F.first(value, ignorenulls=True).over(window.rowsBetween(1, ahead)))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last non-null ``value`` up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def continued(rows: DataFrame, keys: list[str], order: str, text: str, starts: Column) -> DataFrame:
    """Lines that do not start a row are joined to the row before them; lines before the first start are dropped."""
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("__row", F.sum(F.when(starts, 1).otherwise(0)).over(window)).where("__row > 0")
    lines = F.array_sort(F.collect_list(F.struct(order, text)))
    return marked.groupBy(*keys, "__row").agg(F.min(order).alias(order), F.array_join(F.transform(lines, lambda x: x[text]), " ").alias(text)).drop("__row")


def representative(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """anchor: the smallest id of each group, on every row."""
    return rows.withColumn("anchor", F.min(id_col).over(W.partitionBy(*keys)))
