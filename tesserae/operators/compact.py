"""Compact projection: rows factored into shared families and excerpts, and its inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import components
from tesserae.operators.ordering import numbered


def compacted(sources: DataFrame, order: str, tokens: list[str], excerpt: str) -> tuple[DataFrame, DataFrame]:
    """(references, excerpts) of ``sources``.

    Sources that share any of ``tokens`` (a family, a document's or an artifact's digest), directly or over others, depend on one another: a
    dependence, named after its smallest ``order``. Within a dependence equal excerpts are one, labelled s1, s2, ... in the order
    in which they are first seen. References are ``sources`` without the excerpt, with the label; excerpts are (label,
    dependence, excerpt). ``expanded`` gives the sources back. ``order`` must be unique; null tokens link nothing.
    """
    keyed = sources.select(F.col(order).alias("id"), F.explode(F.array(*(F.when(F.col(t).isNotNull(), F.concat_ws("\x1f", F.lit(t), F.col(t).cast("string"))) for t in tokens))).alias("token")).where("token is not null")
    anchor = keyed.groupBy("token").agg(F.min("id").alias("anchor"))
    linked = components(keyed.join(anchor, "token").select("anchor", "id"), "anchor", "id")
    rows = sources.join(linked.withColumnsRenamed({"node": order, "component": "__linked"}), order, "left").withColumn("dependence", F.coalesce("__linked", order)).drop("__linked")
    first = rows.groupBy("dependence", excerpt).agg(F.min(order).alias("__first"))
    labelled = numbered(first, [], ["__first"], "__place").withColumn("label", F.concat(F.lit("s"), F.col("__place").cast("string"))).select("label", "dependence", excerpt)
    same = rows.alias("r").join(labelled.alias("e"), (F.col("r.dependence") == F.col("e.dependence")) & F.col(f"r.{excerpt}").eqNullSafe(F.col(f"e.{excerpt}")))
    return same.select(*(F.col(f"r.{c}").alias(c) for c in sources.columns if c != excerpt), F.col("e.label").alias("label")), labelled


def expanded(references: DataFrame, excerpts: DataFrame, excerpt: str) -> DataFrame:
    """The sources that ``compacted`` was given."""
    return references.join(excerpts.select("label", excerpt), "label").drop("label")
