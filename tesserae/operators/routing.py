"""Claim routing, referential checks and ordered decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason


def routed(positions: DataFrame, claims: DataFrame, keys: list[str], examined: str = "examined", supported: str = "supported") -> DataFrame:
    """status of each position: unexamined, unsupported (no claim supports it), unclaimed, routed (one claim) or ambiguous.

    ``claims`` has (keys, parser, claimed); exact duplicates collapse.
    """
    counted = claims.distinct().groupBy(*keys).agg(F.count_if(F.col("claimed")).alias("claims"), F.count("*").alias(supported))
    status = first_reason(
        ("unexamined", ~F.col(examined)),
        ("unsupported", F.coalesce(supported, F.lit(0)) == 0),
        ("unclaimed", F.col("claims") == 0),
        ("routed", F.col("claims") == 1),
        otherwise="ambiguous",
    )
    return positions.join(counted, keys, "left").select(*positions.columns, status.alias("status"))


def violations(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(rule, id) of all rows that break a rule; each check is a table whose first column is the id."""
    out = None
    for rule, rows in checks:
        part = rows.select(F.lit(rule).alias("rule"), F.col(rows.columns[0]).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, id_col: str) -> DataFrame:
    """Ids of child rows whose key no parent has; a null key is no reference."""
    known = parent.select(F.col(parent_key).alias("__key")).distinct()
    return child.where(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("__key"), "left_anti").select(id_col)


def clear_choice(chances: Column, selected: Column, least: float, margin: float) -> Column:
    """Whether the selected chance is high enough and far enough ahead of every other."""
    chosen = chances[selected]
    others = F.array_max(F.map_values(F.map_filter(chances, lambda k, _: k != selected)))
    return F.coalesce((chosen >= least) & (chosen - F.coalesce(others, F.lit(0.0)) >= margin), F.lit(False))


def merged_batches(rows: DataFrame, key: str, inventory: str) -> DataFrame:
    """(key, batches, status): merged where all batches state one inventory, else conflict."""
    return rows.groupBy(key).agg(F.count("*").alias("batches"), F.when(F.count_distinct(inventory) == 1, "merged").otherwise("conflict").alias("status"))


def cascade(events: DataFrame, sources: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sources and positions, those that events reach: sources name events in an array, positions name a source."""
    reached = sources.withColumn("__event", F.explode("event_ids")).join(events.select(F.col("id").alias("__event")), "__event", "left_semi").drop("__event").dropDuplicates(["id"])
    return reached, positions.join(reached.select(F.col("id").alias("source_id")), "source_id", "left_semi")
