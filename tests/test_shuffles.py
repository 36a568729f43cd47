"""What queries shuffle: rows go to other tasks with what is asked of them there, and by no key of few values."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import graph, grid, inspector, ordering, ranking, relationships
from tesserae.plans import registry
from tesserae.sources import archive
from tesserae.streaming import machines


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def attempts(spark, tmp_path, n=3000):
    """Attempts from a table, as small rows of a script are never shuffled; every seventh id stands twice."""
    path = str(tmp_path / "attempts")
    key = F.col("id")
    rows = spark.range(n).select(
        F.when(key % 7 == 0, key - key % 14).otherwise(key).cast("string").alias("id"), F.lit("sta").alias("discipline"), F.lit("s").alias("unit"),
        (key % 50).cast("decimal(18,6)").alias("value"), F.lit(True).alias("reviewed"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_repeated_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), (None, 1), (None, None), ("b", None), ("b", None), ("c", 3)], "k string, n int")
    assert {tuple(r) for r in ordering.repeated(rows, ["k", "n"]).collect()} == {("a", 1), (None, 1), ("b", None)}


def test_scores_shuffle_no_attempts(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = ranking.comparison_score(attempts(spark, tmp_path))
        assert "SortMergeJoin" not in planned(out) and "hashpartitioning(id" not in planned(out)
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    doubled = [r for r in rows if "duplicate-id" in r["reasons"]]
    assert len(rows) == 3000 and len(doubled) == 2 * (3000 // 14) and all(r["score"] is None and r["common_rank"] is None for r in doubled)
    assert all(r["discipline_rank"] is not None for r in rows if not r["reasons"])


def test_claims_are_bound_by_one_shuffle_a_side(spark, tmp_path):
    rows = spark.range(2000).select(F.lit("j").alias("job_id"), F.col("id").cast("int").alias("ordinal"), F.col("id").cast("string").alias("candidate_id"), F.lit("s").alias("source_sha256"), F.lit("a").alias("artifact_sha256"))
    claims = rows.where("ordinal % 10 <> 0").select("*", *(F.lit("x").alias(c) for c in inspector.CLAIM)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("ordinal") % 10 == 1, 2).otherwise(0)))).drop("copy")
    for name, df in (("rows", rows), ("claims", claims)):
        df.write.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        out = inspector.bound(*(spark.read.parquet(str(tmp_path / name)) for name in ("rows", "claims")))
        assert planned(out).count("Exchange hashpartitioning") <= 2
        found = {r["ordinal"]: (r["claims"], r["authority"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: {0: (0, None), 1: (3, None)}.get(i % 10, (1, "x")) for i in range(2000)}


def test_imports_are_not_gathered_by_key(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "doc_id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        fresh = archive.imported(docs.where("lang = 'en'"), docs, "lang")
        assert "hashpartitioning(lang" not in planned(fresh) and fresh.count() == docs.where("lang <> 'en'").count()
        for other in (docs.where("doc_id <> 1 or lang <> 'en'"), docs.unionByName(docs.where("lang = 'en'").limit(1)), docs.withColumn("text", F.when(F.col("doc_id") % 50 != 0, F.col("text")))):
            if other.where("lang = 'en'").exceptAll(docs).isEmpty() and docs.where("lang = 'en'").exceptAll(other).isEmpty():
                continue
            with pytest.raises(ValueError):
                archive.imported(docs.where("lang = 'en'"), other, "lang")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_classes_of_rows_are_joined_only_where_they_are_many(spark, tmp_path):
    """Classes of one, two and five members at places of one or two classes, some without a context."""
    k = F.col("id")
    rows = spark.range(6000).withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(k % 100 == 0, 5).when(k % 100 < 4, 2).otherwise(1)))).select(
        F.concat_ws("/", k.cast("string"), "copy").alias("ref"), F.sha2(F.floor(k / 2).cast("string"), 256).alias("source_sha256"), F.lit(1).alias("page"), F.lit(1).alias("line"), (k % 2).cast("string").alias("source_text"),
        F.when(k % 200 < 100, "e").alias("event_key"), F.lit("d").alias("discipline"), F.lit(None).cast("string").alias("day"), F.lit("v").alias("parser_version"), F.create_map(F.lit("x"), F.lit("1")).alias("parsed"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = relationships.automatic_edges(spark.read.parquet(str(tmp_path / "rows")))
        assert planned(out).count("SortMergeJoin") == 1  # pairs of a place
        found = sorted(tuple(r)[:3] for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stars = [(f"{i}/1", f"{i}/{c}", "source-duplicate" if i % 200 < 100 else "unknown") for i in range(6000) for c in range(2, 6 if i % 100 == 0 else 3 if i % 100 < 4 else 2)]
    pairs = [(*sorted((f"{i}/1", f"{i + 1}/1")), "unknown") for i in range(0, 6000, 2)]
    assert found == sorted(stars + pairs)


def test_records_of_a_small_file_are_read_by_all_cores(spark):
    for name in ("record_normalised", "record_kinds"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_bridged_names_come_in_lists_of_bounded_length(spark, monkeypatch):
    """One alias and one name of very many, null names and aliases, repeated rows; pairs are not grouped by themselves."""
    rows = [(i, 0) for i in range(60)] + [(7, i) for i in range(1, 40)] + [(100 + i % 9, i % 40) for i in range(200)] + [(None, 0), (3, None), (4, None), (5, 0), (5, 0)]
    table = spark.createDataFrame(rows, "name long, alias long")
    held = {a: {n for n, b in rows if b == a and n is not None} for _, a in rows if a is not None}
    wanted = sorted({(x, y) for names in held.values() for x in names for y in names if x < y})
    for most in (100_000, 10):
        monkeypatch.setattr(graph, "LIST", most)
        out = graph.bridged(table, "name", "alias")
        assert "keys=[left#" in planned(out) and "right#" not in "".join(x for x in planned(out).split("\n") if "Aggregate(keys" in x)
        assert sorted(map(tuple, out.collect())) == wanted


class _Held:
    """A value or map state of one key that counts what it is asked."""

    def __init__(self):
        self.map, self.value, self.asked = {}, None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.map

    def getValue(self, key):  # noqa: N802
        return self.map[key]

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value


def test_a_new_key_asks_its_store_for_no_request():
    machine = machines._Machine("k", "none", {("none", "a"): "a", ("a", "a"): "a"})
    machine.now, machine.seen = _Held(), _Held()
    rows = [(0, "r", 0, "a", "d"), (1, "r", 0, "a", "d"), (2, "r", 0, "a", "e"), (3, "s", 1, "a", "d"), (4, "t", 1, "a", "d"), (5, "u", 2, "b", "d")]
    run = lambda part: [tuple(r) for f in machine.handleInputRows(("k",), iter([pd.DataFrame(part, columns=["n", "id", "base", "action", "digest"])]), None) for r in f[["n", "verdict", "revision"]].itertuples(index=False)]
    assert run(rows) == [(0, "accepted", 1), (1, "repeated-accepted", 1), (2, "conflicting-id", 1), (3, "accepted", 2), (4, "stale", 2), (5, "invalid", 2)]
    assert machine.seen.asked == 0 and len(machine.seen.map) == 4
    assert run([(6, "t", 1, "a", "d"), (7, "v", 2, "a", "d"), (8, "v", 2, "a", "d")]) == [(6, "repeated-stale", 2), (7, "accepted", 3), (8, "repeated-accepted", 3)]
    assert machine.seen.asked == 2


def test_boxes_of_a_page_meet_once(spark):
    """Lines and cells are cut in the row of a page, as windows over its boxes would; the query shuffles orders, not boxes."""
    rng = random.Random(20)
    side = lambda: rng.choice([None, *(float(rng.randint(0, 40)) for _ in range(30))])
    boxes = [(rng.choice([None, 1, 2, 3]), side(), side(), side(), side(), rng.choice([None, "a", "b", "c"])) for _ in range(900)]
    boxes += [(p, x, y, x + rng.randint(1, 9), y + rng.randint(1, 9), "w") for p, x, y, *_ in boxes if x is not None and y is not None]
    frame = spark.createDataFrame([*boxes, *boxes[:30]], "page int, x0 double, y0 double, x1 double, y1 double, text string").repartition(4)
    unit = F.min(F.col("y1") - F.col("y0")).over(W.partitionBy("page", "line"))
    lined = grid.box_lines(frame, ["page"]).where("line is not null").withColumn("unit", unit)
    word = F.sort_array(F.collect_list(F.struct("x0", "y0", "x1", "text")))
    wanted = grid.islands(lined, ["page", "line"], F.col("x0") / F.col("unit"), F.col("x1") / F.col("unit"), "cell", 1.0)
    wanted = wanted.groupBy("page", "line", "cell").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.array_join(F.transform(word, lambda w: w["text"]), " "))
    found = grid.box_cells(frame, ["page"])
    told = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert told(found) == told(wanted) and len({r["line"] for r in found.collect()}) > 1
    assert found.schema["line"].dataType == found.schema["cell"].dataType == T.LongType()
    for df in (found, registry.queries()["boxes_to_cells"](spark, "/root/testdata/sf0.001")):
        plan = planned(df).split("== Initial Plan ==")[-1]
        assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "x0" not in plan.split("Exchange hashpartitioning")[1]
