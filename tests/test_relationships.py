"""Relationships of printed rows and routes, and the rules of a census."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import relationships
from tesserae.plans import registry
from tests.compare import bag, connection

OBS = "ref string, source_sha256 string, page int, line int, source_text string, event_key string, discipline string, day string, parser_version string, parsed map<string,string>"
EVID = "left string, right string, kind string, left_page int, left_line int, right_page int, right_line int, left_text string, right_text string, fields array<string>"


def cited(o):
    return bool((o[1] or "").strip()) and (o[2] or 0) > 0 and (o[3] or 0) > 0 and bool((o[4] or "").strip())


def context(a, b):
    return bool((a[5] or "").strip()) and a[5] == b[5] and bool((a[6] or "").strip()) and a[6] == b[6] and a[7] == b[7]


def automatic(a, b):
    if not (cited(a) and cited(b) and context(a, b) and a[4] == b[4]):
        return "unknown"
    return "parser-revision" if a[8] != b[8] else "source-duplicate" if a[9] == b[9] else "unknown"


def components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {frozenset(y for y in parent if root(y) == root(x)) for x in parent}


def test_automatic_edges_hold_for_all_pairs(spark):
    rng = random.Random(1)
    rows = [(f"r{i:03}", rng.choice(["s1", "s2", ""]), rng.choice([1, 2, 0]), rng.choice([1, 2]), rng.choice(["t", "t", "u", " "]), rng.choice(["e", "e", None]), rng.choice(["d", "d", ""]), rng.choice([None, "1"]), rng.choice(["v1", "v2"]), rng.choice([{"a": "1"}, {"a": "2"}])) for i in range(120)]
    found = {(r["left"], r["right"]): r["kind"] for r in relationships.automatic_edges(spark.createDataFrame(rows, OBS)).collect()}
    by = {r[0]: r for r in rows}
    wanted = {(a[0], b[0]): automatic(a, b) for a, b in itertools.combinations(rows, 2) if cited(a) and cited(b) and a[1:4] == b[1:4]}
    assert found and all(wanted[p] == k for p, k in found.items())  # every edge is one of all pairs, with its kind
    for kind in ("source-duplicate",):  # and links by copies are the same components
        assert components(p for p, k in found.items() if k == kind) == components(p for p, k in wanted.items() if k == kind)
    # pairs of classes: every kind between two classes is found between their first members
    same = lambda o: (*o[1:9], tuple(sorted(o[9].items())))
    first = {}
    for r in sorted(rows):
        first.setdefault(same(r), r[0])
    for (a, b), kind in wanted.items():
        x, y = sorted((first[same(by[a])], first[same(by[b])]))
        assert x == y or found[x, y] == kind


def test_explicit_evidence(spark):
    obs = [("a", "s", 1, 1, "ta", "e", "d", None, "v", {"x": "1", "y": "2", "z": "3", "w": "4"}), ("b", "t", 2, 3, "tb", "e", "d", None, "v", {"x": "1", "y": "2", "z": "3", "w": "5"}), ("c", "t", 2, 4, "tc", "other", "d", None, "v", {"x": "1", "y": "2", "z": "3"}), ("a2", "s", 1, 1, "ta", "e", "d", None, "v", {"x": "1", "y": "2", "z": "3", "w": "4"})]
    good = ("b", "a", "same-attempt", 2, 3, 1, 1, "tb", "ta", ["x", "y", "z"])
    put = lambda **change: tuple((dict(zip((c.split()[0] for c in EVID.split(", ")), good, strict=True)) | change).values())
    frame = spark.createDataFrame(obs, OBS)
    run = lambda rows: [(r["left"], r["right"], r["kind"], r["reason"]) for r in relationships.explicit_edges(frame, spark.createDataFrame(rows, EVID)).collect()]
    assert run([good]) == [("a", "b", "same-attempt", None)]
    wrong = [put(fields=["x", "y"]), put(fields=["x", "y", "y"]), put(fields=["x", "y", "w"]), put(fields=["x", "y", "none"]), put(left_line=9), put(right_text="?"), put(kind="supporting-result"), put(right="zz"), put(left="c", left_line=4, left_text="tc"), put(left="a2", left_page=1, left_line=1, left_text="ta"), put(fields=None)]
    assert all(k == "unknown" and why == "insufficient-evidence" for *_, k, why in run(wrong))
    whole = {(r["left"], r["right"]): (r["kind"], r["reason"]) for r in relationships.classified(frame, spark.createDataFrame([good, put(fields=["x"]), ("a2", "a", "same-attempt", 1, 1, 1, 1, "ta", "ta", ["x", "y", "z"])], EVID)).collect()}
    assert whole == {("a", "b"): ("unknown", "conflicting-evidence"), ("a", "a2"): ("unknown", "conflicting-evidence")}


def test_routes_and_counts(spark):
    routes = spark.createDataFrame([("r1", "h"), ("r2", "h"), ("r3", "h"), ("r4", "g"), ("r5", " "), ("r6", None)], "route_id string, source_sha256 string")
    ask = lambda rows: spark.createDataFrame(rows, "left string, right string, reason string")
    edges = relationships.route_edges(routes, ask([("r4", "r1", "x"), ("r1", "r4", "x")]))
    assert {tuple(r) for r in edges.collect()} == {("r1", "r2", "source-duplicate", None), ("r1", "r3", "source-duplicate", None), ("r1", "r4", "unknown", "x")}
    for bad in ([("r1", "zz", "x")], [("r1", "r1", "x")], [("r1", "r2", None)]):
        with pytest.raises(ValueError):
            relationships.route_edges(routes, ask(bad))
    counts = {(r["scope"], r["kind"]): r["edges"] for r in relationships.kind_counts({"route": edges, "observation": edges.limit(0)}).collect()}
    assert len(counts) == 10 and counts["route", "source-duplicate"] == 2 and counts["observation", "unknown"] == 0


def census(spark, **more):
    sha = "a" * 64
    ref = "array<struct<job_id:string,ordinal:int,artifact_sha256:string,parser_version:string,citation:string>>"
    schemas = {
        "events": "id string, federation string, name string, held_from string, held_to string",
        "sources": "id string, event_ids array<string>, authority string, media string, original_sha256 string, acquisition_id string, retrieved_at string, discovery_url string, final_url string, view_state string, view_ref string, provenance_gaps array<string>",
        "positions": f"id string, source_id string, locator string, status string, raw_fields string, unresolved_reason string, observation_refs {ref}",
        "gaps": "id string, scope string, ref string, status string, reason string",
        "relationships": "id string, left string, right string, kind string, status string, basis string",
    }
    rows = {
        "events": [("e1", "A", "n", "2025-01-01", "2025-01-02")], "sources": [("s1", ["e1"], "official", "pdf", sha, "q", "2025-01-01T00:00:00Z", "u", "u", "st", "rf", [])],
        "positions": [("p1", "s1", "l", "parsed", "{}", None, [("j", 0, sha, "v", "c")]), ("p2", "s1", "l", "unparsed", None, "why", [("j", 0, sha, "v", "c")])], "gaps": [("g1", "event", "e1", "checked", "r"), ("g2", "search", "any", "missing", "r")], "relationships": [("x1", "p1", "p2", "same-attempt", "exact", "b")],
    }
    return {n: spark.createDataFrame(rows[n] + more.get(n, []), schemas[n]) for n in rows}


def test_census_rules(spark):
    sha = "a" * 64
    run = lambda **more: {tuple(r) for r in relationships.census_violations(census(spark, **more)).collect()}
    assert run() == set()
    broken = run(
        events=[("e1", "A", "n", "2025-01-01", "2025-01-02"), ("e2", " ", "n", "2025-02-30", "2025-03-01"), ("e3", "A", "n", "2025-03-02", "2025-03-01")],
        sources=[("s2", ["e1", "e1"], "me", "tape", "x", "q", "2025-01-01T00:00:00", "u", "u", "st", None, []), ("s3", ["zz"], "official", "pdf", sha, None, None, "u", "u", "st", "rf", []), ("s4", [], "official", "pdf", sha, None, None, None, None, None, None, ["lost"])],
        positions=[("p3", "zz", "l", "parsed", "{}", None, []), ("p4", "s1", "", "done", None, " ", [("j", 0, sha, "v2", "c"), ("", -1, "x", None, None)])],
        gaps=[("g3", "event", "zz", "checked", "r"), ("g4", "source", "e1", "checked", "r"), ("g5", "other", "", "none", "")],
        relationships=[("x2", "p1", "zz", "unknown", "exact", "b"), ("x3", "p1", "p2", "odd", "exact", None)],
    )
    assert broken == {
        ("duplicate-events", "e1"), ("incomplete-event", "e2"), ("event-dates", "e2"), ("event-dates", "e3"), ("repeated-source-event", "s2"), ("source-authority", "s2"), ("source-media", "s2"), ("source-digest", "s2"), ("retrieved-without-zone", "s2"), ("incomplete-view", "s2"),
        ("unknown-event", "s3"), ("provenance-without-gap", "s3"), ("unknown-source", "p3"), ("incomplete-position", "p4"), ("position-status", "p4"), ("unresolved-without-reason", "p4"), ("malformed-observation", "p4"), ("conflicting-observation", "p1"), ("conflicting-observation", "p2"), ("conflicting-observation", "p4"),
        ("gap-unknown-event", "g3"), ("gap-unknown-source", "g4"), ("gap-scope", "g5"), ("incomplete-gap", "g5"), ("relationship-kind", "x2"), ("unknown-position", "x2"), ("relationship-kind", "x3"), ("incomplete-relationship", "x3"),
    }


def test_audit_of_a_ledger(spark):
    obs = [("a", "s", 1, 1, "t", "e", "d", None, "v1", {"x": "1", "y": "2", "z": "3"}), ("b", "s", 1, 1, "t", "e", "d", None, "v2", {"x": "1", "y": "2", "z": "3"}), ("c", "u", 1, 1, "t", "e", "d", None, "v1", {"x": "1", "y": "2", "z": "3"}), ("d", "u", 1, 2, "q", "e", "d", "1", "v1", {"x": "1", "y": "2", "z": "9"}), ("f", "w", 1, 2, "q", "e", "d", "1", "v1", {"x": "1", "y": "2", "z": "9"})]
    three = ["x", "y", "z"]
    edges = [("a", "b", "source-duplicate", None), ("b", "a", "unknown", None), ("a", "c", "source-duplicate", None), ("c", "d", "parser-revision", None), ("a", "zz", "unknown", None), ("c", "c", "unknown", None), ("b", "d", "odd", None), ("b", "c", "same-attempt", three), ("d", "f", "same-attempt", three), ("c", "f", "unknown", None), ("a", "d", "same-attempt", three)]
    routes = [("r1", "h"), ("r2", "h"), ("r3", "g")]
    links = [("r1", "r2", "source-duplicate", "h"), ("r1", "r3", "source-duplicate", "h"), ("r2", "r9", "unknown", None), ("r2", "r3", "same-attempt", None), ("r2", "r1", "unknown", None)]
    recorded = [("observation", "same-attempt", 3), ("observation", "unknown", 9), ("source-route", "unknown", 2), ("source-route", "parser-revision", 1)]
    make = spark.createDataFrame
    out = relationships.audit_problems(make(obs, OBS), make(edges, "left string, right string, kind string, fields array<string>"), make(routes, "route_id string, source_sha256 string"), make(links, "left string, right string, kind string, basis_sha256 string"), make(recorded, "scope string, kind string, edges long"))
    assert {tuple(r) for r in out.collect()} == {
        ("repeated-pair", "a", "b"), ("no-duplicate", "a", "c"), ("no-revision", "c", "d"), ("unknown-end", "a", "zz"), ("unknown-end", "c", "c"), ("unknown-kind", "b", "d"), ("no-same-attempt", "b", "c"), ("no-same-attempt", "a", "d"), ("no-duplicate", "r1", "r3"), ("unknown-end", "r2", "r9"), ("unknown-kind", "r2", "r3"),
        ("repeated-pair", "r1", "r2"), ("count-mismatch", "observation", "unknown"), ("count-mismatch", "source-route", "parser-revision"),
    }


def test_compact_sources_of_joined_sizes(spark, tmp_path):
    """src1 with 12 and src11 with 2 characters are one token in the query's SQL, as are no null sources."""
    rows = [(0, "a", "en", "src1", 12), (1, "b", "en", "src11", 2), (2, "c", "de", "src11", 2), (3, "d", "en", None, 5), (4, "e", "en", None, 5), (5, "f", None, "src2", 3), (6, "g", "en", "src2", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found, wanted = registry.queries()["compact_sources"](spark, str(tmp_path)).toPandas(), connection(tmp_path).sql(registry.oracle_sql()["compact_sources"]).df()
    assert bag(found) == bag(wanted)
