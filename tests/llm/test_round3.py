"""Operators 11 to 13 against plain Python, odd tables and the registered SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import queries
from tesserae.llm.centroids import clustered, distances, reassigned
from tesserae.llm.chat_format import digests, escaped, formatted, read_turns, unescaped
from tesserae.llm.divergence import audit, chances, tile
from tests.compare import DATA, bag, connection

NEW = ["op11_divergence", "op12_chat_format", "op13_centroids"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    found, wanted = queries.queries()[name](spark, DATA).toPandas(), connection().sql(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert bag(found) == bag(wanted)


# operator 11


def audited(rows, min_docs=3, top=200):
    """Plain statement of the audit; rows are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, term(t)) for x, s, t in rows if x == lang]
        docs = Counter(w for _, ws in own for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for s, ws in own:
            counts[s].update(w for w in ws if docs[w] >= min_docs)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        chance, base = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum((chance[s][w] - q) ** 2 // q for w, q in chance[o].items())) for o in counts if o != s]
            terms = [(w, (chance[s][w] - base[w]) ** 2 // base[w]) for w in kept if counts[s][w] and chance[s][w] > base[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def wordings():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéßя") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), " ".join(rng.choices(words, range(60, 0, -1), k=rng.randint(0, 40)))) for _ in range(120)]
    return rows + [("fr", "x", "one two"), ("fr", "y", None), ("sv", "alone", "A a-A a_9a"), ("en", "a", None), ("en", "silent", "123 !"), ("en", "a", rows[0][2]), ("en", "a", "ABC abc " * 5000)]


@pytest.mark.parametrize("block,width", [(4096, 256), (7, 2)])
def test_audit_equals_brute_force(spark, wordings, block, width):
    """Also in small tiles, so that heaps and pair matrices of many tiles are merged."""
    docs = spark.createDataFrame(wordings, "lang string, source string, text string").withColumns({c: F.lit(1) for c in ("term", "n", "rank", "block", "left", "item", "own")}).repartition(5)
    assert sorted(map(tuple, audit(docs, top=5, block=block, width=width).collect())) == audited(wordings, top=5)


def test_audit_of_odd_tables(spark, odd, none):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, audit(odd).collect())) == audited(rows)
    assert audit(none).count() == 0


def test_chances_are_exact_for_great_counts():
    for count, total, vocabulary in ((0, 0, 1), (9 * 10**15 - 7, 9 * 10**15, 10**6), (10**12, 3 * 10**12 + 1, 7), (5, 5, 1)):
        assert chances(np.array([count]), total, vocabulary)[0] == 1 + 10**9 * (count + 1) // (total + vocabulary)


def test_strips_do_not_change_a_tile():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, t = 6, 11
    counts = rng.integers(0, 4, (n, t))
    rows = [(0, f"s{i}", i % 2, None, int(counts[i].sum())) for i in range(n)] + [(1, None, None, f"t{j}", int(counts[:, j].sum())) for j in range(t)]
    rows += [(2, f"s{i}", i % 2, f"t{j}", int(counts[i, j])) for i in range(n) for j in range(t) if counts[i, j]]
    columns = dict(zip(("kind", "source", "own", "term", "n"), (list(c) for c in zip(*rows, strict=True)), strict=True))
    table = pa.table(columns | {"vocabulary": [t] * len(rows), "in_lang": [int(counts.sum())] * len(rows)})
    key = tuple(map(pa.scalar, ("en", 0, 0, 1)))
    whole = sorted(map(str, tile(key, table).to_pylist()))
    assert whole == sorted(map(str, tile(key, table, strip=1).to_pylist())) and len(whole) == 2 * 3 * 3


# operator 12

TURNS = [
    (1, 2, "assistant", "later <|im_end|>\n"), (1, 1, "user", "first"), (2, 1, "user", None), (2, 2, "user", "again <|im_part|>"), (2, 3, "assistant", ""), (2, 4, "assistant", "b\\n <\\|im_start|>"), (2, 5, "assistant", "c 😀"),
    (3, None, "assistant", "no number"), (3, 1, None, "x"), (3, 1, "us\ner\\n<|im_start|>", "role"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 1, "assistant", "lone"), (None, 1, "assistant", "lone"), (4, 1, "assistant", "y" * 200_000),
]


def chat_digests(rows):
    out, talks = [], defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):
        talks[conv, k if conv is None else None].append((turn is not None, turn or 0, role or "", text or ""))
    for (conv, _), turns in talks.items():
        turns = [x[2:] for x in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chats_read_back_as_they_were(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("extra") for c in ("turns", "loss", "formatted", "entry", "lone", "runs")})
    found = sorted((tuple(r)[:5] for r in digests(formatted(frame.repartition(4))).collect()), key=str)
    assert found == chat_digests(TURNS)
    assert formatted(frame.limit(0)).count() == 0


def test_adjacent_turns_of_a_role_are_merged(spark):
    frame = spark.createDataFrame(TURNS[2:7], "conv_id long, turn long, role string, text string")
    row = formatted(frame).first()
    text = row["formatted"]
    assert text == "<|im_start|>user\n<|im_part|>again <\\|im_part|><|im_end|>\n<|im_start|>assistant\n<|im_part|>b\\n <\\\\|im_start|><|im_part|>c 😀<|im_end|>\n"
    assert [text[s["start"] : s["stop"]] for s in row["loss"]] == ["", "b\\n <\\\\|im_start|>", "c 😀"]


def test_long_conversation(spark):
    """Running sums go over many blocks."""
    rows = [(7, i, ["user", "assistant", "assistant"][i % 3], f"<|{i}") for i in range(20_001)]
    assert [tuple(r)[:5] for r in digests(formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()] == chat_digests(rows)


def test_escapes_are_reversible(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("<|\\\\ax>im_") for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).select("t", "e", unescaped(F.col("e")).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)
    chats = [(k, 0, t, t) for k, t in enumerate(texts[:300])]
    back = formatted(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")).select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [tuple(x) for x in r["t"]] for r in back} == {k: [(r, t)] for k, _, r, t in chats}


def test_chat_plan_has_no_python(spark):
    plan = queries.op12_chat_format(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# operator 13


def lloyd(rows, k, rounds, dimensions):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and abs(x) < 131072 for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in seeds[:k]]
    gap = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        centres = [[sum(x) // len(x) for x in zip(*members, strict=True)] if (members := [v for (_, v), o in zip(kept, own, strict=True) if o == c]) else centre for c, centre in enumerate(centres)]
    own = [nearest(v) for _, v in kept]
    far = [gap(v, centres[o]) for (_, v), o in zip(kept, own, strict=True)]
    within = Counter()
    for o, d in zip(own, far, strict=True):
        within[o] += d
    return sorted(((i, o, d, within[o], sum(far), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, far, strict=True)), key=str)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_clusters_equal_plain_rounds(spark, k):
    """Ties, copies, equal first centroids, null ids and odd vectors; also a lattice on which many distances are equal."""
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(150)] + [(5, [0.0, 0.0, 0.0])] * 3 + [(None, [9.0, -9.0, 100.0]), (None, None), (200, [0.1, None, 0.2]), (201, [0.1, 0.2]), (202, [])]
    rows += [(203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0]), (205, [131071.0, -131071.0, 131071.0]), (206, [131072.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("extra") for c in ("cluster", "vector", "upper", "n", "total", "distance")}).repartition(4)
    sane = [(i, v if v is None or not any(x is not None and x != x for x in v) else None) for i, v in rows]
    found = clustered(frame, k=k, rounds=4, dimensions=3)
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == lloyd(sane, k, 4, 3)
    assert clustered(frame.limit(0), k=k, rounds=2, dimensions=3).count() == 0


def test_bounds_hold_and_spare_scans(spark):
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (4, 16))
    vectors = np.concatenate([m + rng.integers(-300, 300, (200, 16)) for m in middles])
    now = vectors[[3, 250, 500, 700]].copy()
    before, cluster, upper, lower, scans = now, np.full(800, -1), np.zeros(800), np.zeros(800), 0
    for _ in range(6):
        cluster, upper, lower, scanned = reassigned(vectors, cluster, upper, lower, before, now)
        exact = distances(vectors, now)
        assert (cluster == exact.argmin(1)).all()
        rest = exact.copy()
        rest[np.arange(800), cluster] = np.iinfo(np.int64).max
        assert (upper >= np.sqrt(exact.min(1))).all() and (lower <= np.sqrt(rest.min(1).astype(float))).all()
        scans += scanned.sum()
        before, now = now, np.array([vectors[cluster == c].sum(0) // max(1, (cluster == c).sum()) for c in range(4)])
    assert scans < 2 * 800
