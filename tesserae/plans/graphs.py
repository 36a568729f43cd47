"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import graph, matching
from tesserae.plans.registry import query
from tesserae.sources.tables import table


def _links(spark, sf):
    """Documents that share their text, and neighbouring ids of one source that share their language."""
    docs = table(spark, sf, "documents")
    same = matching.pair_edges(docs, F.sha2("text", 256), "doc_id", "text").select(F.col("left").alias("a"), F.col("right").alias("b"))
    near = docs.alias("x").join(docs.alias("y"), (F.col("x.doc_id") + 1 == F.col("y.doc_id")) & (F.col("x.source") == F.col("y.source")))
    return same.unionByName(near.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")))


@query("""WITH RECURSIVE h AS (SELECT sha256(text) AS k, doc_id FROM documents),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.k = y.k AND x.doc_id <> y.doc_id
  UNION ALL SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.doc_id + 1 = y.doc_id AND x.source = y.source UNION ALL SELECT y.doc_id, x.doc_id FROM documents x JOIN documents y ON x.doc_id + 1 = y.doc_id AND x.source = y.source),
r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def connected_components(spark, sf):
    return graph.components(_links(spark, sf))


@query("""WITH RECURSIVE k AS (SELECT doc_id, 't' || md5(text) AS key FROM documents UNION ALL SELECT doc_id, 's' || source || n_chars::VARCHAR FROM documents),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (key) WHERE x.doc_id <> y.doc_id),
r AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def key_groups(spark, sf):
    docs = table(spark, sf, "documents").withColumn("keys", F.array(F.concat(F.lit("t"), F.md5("text")), F.concat(F.lit("s"), "source", F.col("n_chars").cast("string"))))
    return graph.key_groups(docs, "doc_id", "keys")


@query("""WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS a, conv_id * 1000 + turn - 1 AS b FROM conversations WHERE turn > 0),
r AS (SELECT a AS ancestor, b AS node, 1 AS depth FROM e UNION ALL SELECT r.ancestor, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node) SELECT ancestor, node, min(depth)::BIGINT AS depth FROM r GROUP BY 1, 2""")
def dependency_closure(spark, sf):
    turns = table(spark, sf, "conversations").where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("a"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("b"))
    return graph.closure(turns, "a", "b")


@query("SELECT conv_id * 1000 + turn AS node, turn AS wave FROM conversations")
def dependency_waves(spark, sf):
    key = F.col("conv_id") * 1000 + F.col("turn")
    turns = table(spark, sf, "conversations")
    return graph.waves(turns.select(key.alias("n")), turns.where("turn > 0").select(key.alias("a"), (key - 1).alias("b")), "n", "a", "b")


@query("""WITH x AS (SELECT sha256(text) AS text_hash, CASE WHEN doc_id % 3 = 0 THEN 'held-out' ELSE 'train' END AS split FROM documents)
SELECT text_hash, count(DISTINCT split) AS splits, count(*) AS rows FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def leakage_check(spark, sf):
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_hash"), F.when(F.col("doc_id") % 3 == 0, "held-out").otherwise("train").alias("split"))
    return graph.leaks(rows, "text_hash", "split")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS name, l_partkey AS alias FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT DISTINCT x.name AS "left", y.name AS "right" FROM a x JOIN a y ON x.alias = y.alias AND x.name < y.name""")
def alias_bridge(spark, sf):
    a = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("name"), F.col("l_partkey").alias("alias")).distinct()
    return graph.bridged(a, "name", "alias")
