"""Pairs of rows that share keys, against brute force, and how their plans deal them out."""

import random
import re

from tesserae.operators import graph, matching
from tesserae.plans import registry
from tests.compare import DATA

plan = lambda df: df._jdf.queryExecution().toString()


def test_routes_of_shared_keys(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 20)
    draw = random.Random(2)
    sides = [[(draw.choice(["x", "y", "z", None]), draw.choice(["1", "2", "3", None]), draw.choice([*map(str, range(25)), None])) for _ in range(150)] for _ in range(2)]
    index, asked = (spark.createDataFrame(s, "route string, key string, id string") for s in sides)
    want = {}
    for r, k, a in sides[1]:
        for q, m, f in sides[0]:
            if r and k and (r, k) == (q, m) and a and f and a != f:
                want.setdefault((a, f), set()).add(r)
    out = matching.routes(index, asked)
    assert sorted(map(tuple, out.collect())) == sorted((a, f, ",".join(sorted(r))) for (a, f), r in want.items())
    assert "hashpartitioning(asked" not in plan(out)  # pairs are not shuffled


def test_leads_of_shared_names(spark, monkeypatch):
    monkeypatch.setattr(matching, "PAIRS", 20)
    draw = random.Random(8)
    rows = [(i, draw.choice(["s", "t", None]), draw.choice([1, 2, None]), [draw.choice(["a", "b", "c", None]) for _ in range(draw.randrange(4))]) for i in range(60)]
    for given in (rows, [*rows, *((i, "u", 1, ["b", "a"]) for i in range(0, 60, 7)), (None, "s", 1, ["a"])]):
        want = {}
        for i, s, d, names in given:
            for j, t, e, others in given:
                if i is not None and j is not None and i < j and s and t and s != t and (d is None or e is None or d == e):
                    for n in set(names) & set(others) - {None}:
                        want[i, j] = min(want.get((i, j), n), n)
        out = matching.overlapping_leads(spark.createDataFrame(given, "id long, source string, d int, names array<string>"), "id", "source", "names", "d")
        assert sorted(map(tuple, out.collect())) == sorted((*k, n) for k, n in want.items())
        if given is rows:
            assert "hashpartitioning(l_id" not in plan(out) and "hashpartitioning(left" not in plan(out)


def test_labels_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["c"])], "id long, keys array<string>")
    out = graph.key_groups(rows, "id", "keys")
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert "BroadcastHashJoin" not in plan(out)


def test_facts_are_not_shuffled(spark):
    query = registry.queries()["publication_bindings"](spark, DATA)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", query._jdf.queryExecution().explainString(formatted))
    assert inputs and not any(re.search(r"\bfacts#", columns) for columns in inputs)


def test_bindings_shuffle_digests_once(spark):
    query = registry.queries()["publication_bindings"](spark, DATA)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", query._jdf.queryExecution().explainString(formatted))
    assert 1 <= len(inputs) <= 5
    assert not any(re.search(r"(result_id|observation_id|_sha256|job_id|candidate_id)#", columns) for columns in inputs)
