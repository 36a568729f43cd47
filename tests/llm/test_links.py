"""Operators 2, 5, 8, 10: work across documents."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, jaccard_join, sharding, suffix_dedup
from tests.llm import brute


def unique(rows):
    return list({i: t for i, t in rows if i is not None}.items())


def test_jaccard_join_of_odd_rows(odd, odd_rows, none):
    out = jaccard_join.jaccard_join(odd).collect()
    assert len(out) == len(odd_rows)
    want = brute.linked(unique(odd_rows))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == {(i, *w) for i, w in want.items()}
    assert jaccard_join.jaccard_join(none).count() == 0


def test_jaccard_join_of_repeated_ids(spark, prose):
    """Every row is a document of its own; rows without an id reach the ids of their copies."""
    one, two, three, four = (prose(i, 30) for i in range(300, 304))
    rows = [(20, one), (20, two), (19, two), (21, two + " more"), (None, one), (None, three), (None, three), (22, four)]
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(20, 26, 20), (20, 26, 19), (19, 26, 19), (21, 27, 19), (None, 26, 20), (None, 26, None), (None, 26, None), (22, 26, 22)]
    assert sorted(map(str, out)) == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)


@pytest.mark.parametrize("often", [2, 16, 10**6])
def test_jaccard_join_in_many_blocks(spark, prose, monkeypatch, often):
    """Small blocks of pairs and lists, small chunks, n-grams counted in chunks or not, and broadcast tables of hot keys give
    the same."""
    for name, value in {"OFTEN": often, "FLUSH": 400, "PAIRS": 7, "LIST": 3, "HOT": 1, "CHUNK": 5}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng, rows = random.Random(12), []
    passage = prose(888, 12)
    for i in range(60):
        words = prose(400 + i // 12, 25).split()
        words[rng.randrange(25)] = f"e{i}"
        rows.append((i, " ".join(words) + " " + passage))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute.linked(rows)


def test_a_frequent_gram_is_a_row_a_chunk(prose):
    """What a fragment gets of an n-gram that all documents share does not grow with the documents of a chunk."""
    from unittest import mock

    passage = prose(5, 5)
    deal = jaccard_join._deal(5, 8, 10**6, 65_000, 16)
    texts = [f"{passage} {prose(100 + i, 6)}" for i in range(400)]
    with mock.patch.object(jaccard_join, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 0
        rows = [r for batch in deal(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for r in batch.to_pylist()]
    counted = [np.frombuffer(r["times"], np.uint32) for r in rows if r["times"] and r["fragment"] >= 0]
    assert [x.tolist() for x in counted if len(x)] == [[400]]
    packed = sum(len(r["docs"]) // 2 for r in rows if r["fragment"] >= 0)
    assert packed == sum(len(brute.shingles(t)) for t in texts) - 400


def test_jaccard_join_of_edited_families(spark, prose):
    """Families of copies with more and more edits, chains of edits, and a passage that all documents share."""
    rng, rows = random.Random(2), []
    passage = prose(999, 30)
    for family in range(6):
        words = prose(family, 120).split()
        chain = list(words)
        for n in range(25):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["edit"], [copy[at], copy[at]]])
            rows.append((len(rows), " ".join(copy) + (" " + passage if n % 2 else "")))
            chain[rng.randrange(len(chain))] = f"w{n}"
            rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, prose(50 + i, 40) + " " + passage) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df).collect()}
    assert out == brute.linked(rows)


def places(out, n_rows, n_shards=8):
    sizes = np.bincount([r["shard"] for r in out], minlength=n_shards)
    assert len(out) == n_rows and sizes.max() - sizes.min() <= 1
    for s in range(n_shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))


def test_sharding(spark, odd, odd_rows, none, prose):
    out = sharding.shard(odd).collect()
    places(out, len(odd_rows))
    want = sorted((str(i), len((t or "").encode()) + 1, brute.crc((t or "").encode())) for i, t in odd_rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    assert sharding.shard(none).count() == 0
    # a third of all rows are one text; small groups stay whole
    rows = [(i, "hot" if i % 3 == 0 else prose(i // 4 if i % 5 == 0 else 10_000 + i, 5)) for i in range(600)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    places(out, 600)
    held = {}
    for r in out:
        held.setdefault(rows[r["doc_id"]][1], set()).add(r["shard"])
    assert len(held["hot"]) <= 5 and np.mean([len(s) == 1 for t, s in held.items() if t != "hot"]) > 0.95
    # every text stands twice or oftener: shards are full from the start, and groups still come together
    rows = [(i, prose(i // (2 if i < 3000 else 3), 5)) for i in range(4200)]
    made = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    places(made.collect(), 4200)
    assert sharding.cut_share(made) < 0.15  # seven eighths at the start; rounding moves about sqrt(n) documents a shard
    every = sharding.shard(spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")).collect()
    places(every, 50)


def test_flow_is_admitted_up_to_room_and_outflow():
    demand = np.zeros((3, 3, 2))
    demand[0, 1], demand[1, 0], demand[2, 1] = (10, 0), (0, 10), (5, 5)
    flow = sharding.admitted_flow(demand, np.array([0, 3, 0]))
    assert (flow <= demand).all() and (flow.sum((0, 2)) - flow.sum((1, 2)) <= np.array([0, 3, 0]) + 1e-5).all()
    # an exchange needs no room; greater gains go first, into the room of 3 (5 would break the bound above: shard 0 takes 10, so it sends 10)
    assert flow[1, 0].sum() == 10 and (flow[2, 1] == (0, 3)).all()
    rng = np.random.default_rng(5)
    for _ in range(50):
        demand = rng.integers(0, 20, (4, 4, 3)) * (rng.random((4, 4, 3)) < 0.5)
        demand[range(4), range(4)] = 0
        room = rng.integers(0, 15, 4)
        flow = sharding.admitted_flow(demand, room)
        assert (flow >= 0).all() and (flow <= demand).all() and (flow.sum((0, 2)) - flow.sum((1, 2)) <= room).all()
        assert not sharding.admitted_flow(demand - flow, room - flow.sum((0, 2)) + flow.sum((1, 2))).any()  # nothing can be added


def test_decontamination(spark, odd, odd_rows, none, prose):
    items = [(1, prose(1, 80)), (2, prose(70, 25)), (3, "too short"), (4, None), (5, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words = items[1][1].split()
    rows = [(100, prose(71, 90) + " " + items[1][1].upper() + "\n" + prose(72, 30)), (101, prose(73, 50) + " " + " ".join([*words[:12], "other", *words[13:]]) + " " + prose(74, 9)), (102, " ".join(words[:12]) + " " + prose(75, 40))]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == similar(unique(odd_rows) + rows, items)
    assert {(1, 1), (2, 1), (7, 1), (8, 1), (100, 2)} <= found and (102, 2) not in found
    assert decontaminate.leaks(none, benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    kept = decontaminate.decontaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len([i for i, _ in odd_rows if i is None or (i, 1) not in found])


def test_unrelated_fingerprints_seldom_meet(spark):
    """Rows of the index join on random fingerprints are below a tenth of all pairs, and none passes the radius."""
    n = 600
    drawn = lambda seed: F.array(*(F.xxhash64("id", F.lit(seed + i)) for i in range(decontaminate.BITS // 64)))
    prints = spark.range(n).select("id", F.lit(40).alias("n_words"), drawn(0).alias("fingerprint"))
    items = spark.range(n).select(F.col("id").alias("item_id"), F.lit(40).alias("n_words"), drawn(100).alias("item_print"))
    rows = decontaminate.met(prints, items)
    assert rows.count() < n * n / 10
    assert rows.where(decontaminate._distance(F.col("fingerprint"), F.col("item_print")) <= decontaminate.RADIUS).count() == 0


def test_index_finds_all_within_the_radius(spark):
    import random

    rng = random.Random(4)
    whole = lambda x: [int(v) for v in np.array([x & (1 << 64) - 1, x >> 64], np.uint64).view(np.int64)]
    pairs = []
    for i in range(400):
        x, d = rng.getrandbits(128), rng.randint(0, decontaminate.RADIUS)
        pairs.append((i, 40, whole(x), whole(x ^ sum(1 << b for b in rng.sample(range(128), d)))))
    frame = spark.createDataFrame(pairs, "id long, n_words int, fingerprint array<long>, item_print array<long>")
    found = decontaminate.met(frame.drop("item_print"), frame.select(F.col("id").alias("item_id"), "n_words", "item_print")).where("id = item_id").select("id").distinct()
    assert found.count() == 400


def test_recall_of_edited_passages(spark, prose):
    """Passages of invented edits, also with very long words: what is similar by brute force, and what is found of it."""
    import random

    rng = random.Random(12)
    items, rows = [], []
    for i in range(120):
        words = prose(5000 + i, rng.choice([20, 35, 60])).split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "y" * rng.randint(20, 90)
        items.append((i, " ".join(words)))
        edited = list(words)
        for _ in range(rng.randint(0, 2)):
            edited[rng.randrange(len(words))] = "z" * rng.choice([3, 8, 40])
        rows.append((i, prose(6000 + i, 15) + " " + " ".join(edited) + " " + prose(7000 + i, 15)))
    wanted = similar(rows, items)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= wanted and len(wanted) > 60 and len(found) >= 0.98 * len(wanted)


def test_decontamination_of_edited_beginnings(spark, prose):
    item = prose(170, 40).split()
    long = "https://host.example/" + "x" * 480
    ends = [prose(180, 30), prose(181, 30)]
    edits = [["new", "first", "words", *item[3:]], ["new", *item[1:]], [*item[:37], "new", "last", "words"]]
    rows = [(i, f"{ends[0]} {long} {' '.join(e)} {long} {ends[1]}") for i, e in enumerate(edits)] + [(9, f"{ends[0]} {' '.join(item[:12])} {long}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == similar(rows, [(1, " ".join(item))]) == {(0, 1), (1, 1), (2, 1)}
    assert {r["start_word"] for r in out} == {31}


def test_decontamination_behind_long_words(spark, prose):
    """A passage whose first words differ, before very long words; and rows that repeat an id with other texts."""
    item = prose(190, 25).split()
    long = "x" * 1000
    rows = [(1, f"a b {' '.join(item[2:])} {long} {long}"), (2, prose(191, 40)), (2, " ".join(item)), (2, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], round(r["similarity"], 3)) for r in out)[1] == (2, 0, 1.0) and {r["doc_id"] for r in out} == {1, 2} and len(out) == 2


def similar(rows, items):
    """All windows of all documents against all items."""
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    weight = lambda s: sum(len(x) for g in s for x in g)
    out = set()
    for item, text in items:
        asked = brute.WORD.findall((text or "").lower())
        want = grams(asked)
        for doc, body in rows:
            words = brute.WORD.findall((body or "").lower())
            if not want or len(grams(words) & want) * 2 < len(want):
                continue
            for at in range(max(1, len(words) - len(asked) + 1)):
                own = grams(words[at : at + len(asked)])
                common = weight(own & want)
                if common / (weight(own) + weight(want) - common) >= 0.75:
                    out.add((doc, item))
                    break
    return out


def removed(df, **options):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(df, with_bytes=True, **options).collect() if r["doc_id"] is not None}


def test_suffix_dedup_of_odd_rows(odd, odd_rows, none):
    want = brute.repeats_removed([r for r in unique(odd_rows) if r[0] != 9], 100)
    out = removed(odd)
    assert {i: out[i] for i in want} == want and out[9][:3] == (len(odd_rows[9][1]), 0, 0)
    rows = suffix_dedup.dedup(odd).collect()
    assert len(rows) == len(odd_rows) and suffix_dedup.dedup(none).count() == 0
    assert all(r["kept_sha256"] == hashlib.sha256(out[r["doc_id"]][3]).hexdigest() for r in rows if r["doc_id"] is not None)


def test_suffix_dedup_of_overlaps(spark, prose):
    """Shared parts cut at any place, periodic texts, and repeats inside a document."""
    rng = random.Random(4)
    pool = [prose(i, 60) for i in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            source = rng.choice(pool)
            a = rng.randrange(len(source) - 90)
            parts.append(source[a : a + rng.randint(50, 300)])
            parts.append(prose(1000 + rng.randrange(10**6), rng.randint(0, 12)))
        rows.append((i, " ".join(parts)))
    rows += [(60, "ab" * 300), (61, "ba" * 200), (62, "\0" * 400), (63, pool[0] + pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df) == brute.repeats_removed(rows, 100)


def test_suffix_dedup_of_hot_anchors(spark, prose):
    """A passage with other text around it in every document, with single strings in place of pieces."""
    rng, passage = random.Random(8), prose(700, 25)
    contexts = [prose(710 + i, 12) for i in range(3)]
    rows = [(i, f"{rng.choice(contexts)} {prose(800 + i, 2)} {passage[: rng.randint(90, len(passage))]} {prose(900 + i % 4, 6)}") for i in range(50)]
    rows += [(60, "<" + passage + ">"), (61, "[" + passage + ">"), (62, "<" + passage + "]")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df, hot_bytes=300) == removed(df) == brute.repeats_removed(rows, 100)


def test_suffix_dedup_of_repeated_ids(spark, prose):
    """Different texts of one id are documents in the order of their hashes, rows without an id come last; equal rows are one."""
    a, b, c = prose(720, 40), prose(721, 40), prose(723, 40)
    rows = [(1, a), (1, b), (1, f"{b} {c}"), (2, a), (3, b), (None, a), (None, c + " x"), (None, c + " x"), (4, prose(722, 3)), (4, prose(722, 3)), (5, None)]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = brute.repeats_removed([(n, t) for n, (_, t) in enumerate(order)], 100)
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=True).collect()]
    assert sorted(out, key=str) == sorted(((i, *want[order.index((i, t))]) for i, t in rows), key=str)


def test_merged_transforms_hold_the_intervals():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint8) for _ in range(20)]
    shards = []
    for part in (texts[:7], texts[7:8], texts[8:]):
        out, ends = suffix_dedup.transform(part)
        shards.append((out, ends, len(part)))
    for length in (5, 6):
        text, start, interval = suffix_dedup.merged_intervals(shards, length)
        found = {}
        for t, s, i in zip(text.tolist(), start.tolist(), interval.tolist()):
            found.setdefault(i, set()).add((t, s))
        want = {}
        for t, x in enumerate(texts):
            for s in range(len(x) - length + 1):
                want.setdefault(x[s : s + length].tobytes(), set()).add((t, s))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
