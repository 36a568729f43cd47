"""Places, ranks and carried values in hot groups, with ties, nulls, outliers and repeated values."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import ledger, ordering, paging, ranking


def hot(seed):
    """A group of half of all rows, a value of a third, one far outlier, null groups and values."""
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), 7.0 if rng.random() < 0.33 else rng.choice([None, round(rng.random(), 2)])) for i in range(3000)]
    return rows + [(9999, "hot", 1e12), (10000, "hot", -1e12)]


@pytest.mark.parametrize("small", [200_000, 1])
def test_ranks_and_positions_of_hot_groups(spark, monkeypatch, small):
    monkeypatch.setattr(ordering, "SMALL", small)
    rows = hot(1)
    frame = spark.createDataFrame(rows, "id long, k string, v double").repartition(7)
    for down in (True, False):
        out = {r["id"]: (r["rank"], r["place"]) for r in ranking.ranked(frame, "v", "rank", ("k",), down, ("id",), "place").collect()}
        for k in ("hot", "a", "b", None):
            own = [(v, i) for i, g, v in rows if g == k]
            better = sorted((v for v, _ in own if v is not None), reverse=down)
            ordered = sorted(own, key=lambda x: (x[0] is None, (-x[0] if down else x[0]) if x[0] is not None else 0, x[1]))
            first = {v: n for n, v in reversed(list(enumerate(better, 1)))}
            for place, (v, i) in enumerate(ordered, 1):
                assert out[i] == (first.get(v), place)
    whole = {r["id"]: r["rank"] for r in ranking.global_rank(frame, "v", "rank").collect()}
    assert all(whole[i] == (None if v is None else 1 + sum(w is not None and w > v for _, _, w in rows)) for i, _, v in random.Random(2).sample(rows, 40))


def test_no_range_holds_a_hot_group(spark):
    """The largest range is a few times the mean, although one group is half of all rows and one value a third."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordering.parted(spark.createDataFrame(hot(3), "id long, k string, v double"), ["k"], ["v", "id"]).groupBy("__part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in parts]
    assert len(sizes) >= 3 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_values_are_carried_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), rng.choice([None, None, "x", "y"])) for i in range(500)] + [(i, "c", None) for i in range(500, 520)]
    frame = spark.createDataFrame(rows, "n long, k string, d string").repartition(5)
    out = {r["n"]: r["version_status"] for r in ledger.version_history(frame, ["k"], ["n"], "d").collect()}
    known = {}
    for n, k, d in rows:
        before = known.get(k)
        assert out[n] == ("gap" if d is None else "first_version" if before is None else "unchanged_bytes" if d == before else "changed_bytes")
        known[k] = d or before


def test_queue_and_empty_tables(spark):
    rows = [(1, "t", 2.0), (2, "t", None), (3, "t", 1.0), (4, None, 5.0), (5, "t", 1.0)]
    frame = spark.createDataFrame(rows, "id long, t string, s double")
    assert {r["id"]: r["queue_position"] for r in paging.queue(frame, "s", "t", "id").collect()} == {3: 1, 5: 2, 1: 3, 2: 4, 4: 1}
    none = frame.limit(0)
    assert paging.queue(none, "s", "t", "id").count() == 0 and ranking.ranked(none, "s", "r", ("t",), order=("id",), position="p").count() == 0
    assert ordering.numbered(frame, [], ["id"], "n").orderBy("id").select("n").collect()[-1]["n"] == 5
