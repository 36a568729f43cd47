"""Queue items, version relationships, roster rules, peer lists and attempt groups."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators import matching, queue, ranking, roster
from tesserae.plans import registry


def test_queue_items(spark):
    rows = [
        ("relationship", "x", "c", {"relationship_type": "publisher_revision", "basis": "b"}, "source_revision_same_result"), ("relationship", "x", "c", {"relationship_type": "same_attempt"}, "same_attempt_relationship"), ("relationship", "x", "c", {"relationship_type": "other"}, None),
        ("gap", "x", "unparsed_rows", {"reason": "r", "value": "v"}, "extraction_source_semantics"), ("gap", *queue.UNMATCHED, {"value": 5}, "same_attempt_relationship"), ("gap", "x", "unmatched_daily", {"assessment": {"disposition": "supporting_overlap", "evidence": ["e"], "contrary_evidence": "c"}}, "source_revision_same_result"),
        ("gap", "x", "source_relationship_gaps", {"assessment": {"failure_reason": "f"}}, "event_publication"), ("gap", "x", "retained_only_artifacts", {}, "extraction_source_semantics"), ("gap", "x", "z", {"assessment": {"disposition": "supplemental_aggregate"}}, "extraction_source_semantics"), ("gap", "x", "z", {"reason": "", "contrary_evidence": []}, "coverage_finality"),
    ]
    frame = spark.createDataFrame([(f"r{i}", k, s, c, json.dumps(raw)) for i, (k, s, c, raw, _) in enumerate(rows)], "record_id string, kind string, source_name string, collection string, raw string").withColumn("raw", F.parse_json("raw"))
    out = {r["id"]: r for r in queue.queue_items(frame).collect()}
    assert {i: r["group"] for i, r in out.items()} == {f"queue:r{i}": g for i, (*_, g) in enumerate(rows) if g}
    assert [out[f"queue:r{i}"]["trigger"] for i in (0, 3, 4, 5, 6, 7)] == ["publisher_revision", "r", "5", "supporting_overlap", "f", "Explicit evidence record"]
    assert out["queue:r5"]["supporting"] == ['["e"]'] and out["queue:r5"]["contrary"] == ["c"] and out["queue:r5"]["unknown"] == ["Relationship or publication approval not recorded"]
    assert out["queue:r9"]["unknown"] == ["Supporting evidence not recorded in this item", "Contrary evidence not recorded in this item"]


def test_version_relationships(spark):
    rows = [("a", "h1", "p", "http://x/a/../b"), ("b", "h1", "p", "http://x/b"), ("c", "h2", "p", "http://x/./b"), ("d", "h3", "p", "http://x/b"), ("e", "h4", "q", "http://x/b"), ("f", "h5", None, "http://x/b"), ("g", "h4", "q", "http://y")]
    out = {tuple(r) for r in matching.version_relationships(spark.createDataFrame(rows, "acquisition_id string, sha256 string, publisher string, final_url string")).collect()}
    assert out == {("a", "b", "source-duplicate", None), ("e", "g", "source-duplicate", None), ("a", "c", "unknown", "possible-source-revision"), ("a", "d", "unknown", "possible-source-revision")}
    urls = ["http://x/a/../b?q=..#z", "http://x/../b", "http://x/a/b/..", "http://x/a/./b/", "http://x", "/a/../..", None]
    got = [r["n"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", matching.normal_url(F.col("u")).alias("n")).orderBy("i").collect()]
    assert got[:5] == ["http://x/b?q=..#z", "http://x/../b", "http://x/a/", "http://x/a/b/", "http://x"] and got[6] is None


def test_roster_rules(spark):
    at, cutoff = "2026-01-01T00:00:00Z", "2026-06-01T00:00:00Z"
    history = [(at, "gap"), ("2026-02-01T00:00:00Z", "checked")]
    names = "id status role authority checked_at receipt history".split()
    good = dict(zip(names, ["r", "checked", "archive", "A", "2026-02-01T00:00:00Z", "h", history], strict=True))
    cases = [
        ({}, None), ({"id": " "}, "missing-id"), ({"status": "done"}, "invalid-status"), ({"role": None}, "invalid-role"), ({"authority": ""}, "missing-authority"), ({"status": "unchecked"}, "unchecked-with-receipt"), ({"status": "unchecked", "checked_at": None, "receipt": None, "history": None}, None), ({"checked_at": "2026-02-01"}, "invalid-check"),
        ({"checked_at": "2027-02-01T00:00:00Z"}, "checked-after-cutoff"), ({"receipt": None}, "missing-receipt"), ({"history": history[::-1]}, "invalid-history"), ({"history": history[:1]}, "invalid-history"), ({"checked_at": at}, "history-check-mismatch"), ({"history": []}, None),
    ]
    frame = spark.createDataFrame([(i, *(good | {"id": f"r{i}"} | c).values()) for i, (c, _) in enumerate(cases)], "i int, id string, status string, role string, authority string, checked_at string, receipt string, history array<struct<at:string,status:string>>")
    out = {r["id"]: r["problem"] for r in roster.route_problems(frame, cutoff, ("archive",)).collect()}
    assert [out[c.get("id", f"r{i}")] for i, (c, _) in enumerate(cases)] == [p for _, p in cases]
    names = "id route_id status title competition_date competition_date_to competition_year date_evidence citation_sha256 relationship snapshot_ids candidate_snapshot_ids history".split()
    good = dict(zip(names, ["l", "r0", "checked", "T", "2026-05-01", "2026-05-02", 2026, "e", "h", None, ["s"], ["t"], None], strict=True))
    cases = [
        ({}, None), ({"id": None}, "missing-id"), ({"route_id": "x"}, "unknown-route"), ({"status": ""}, "invalid-status"), ({"competition_date": "2026-02-30"}, "invalid-date"), ({"competition_date": "2024-05-01"}, "invalid-date"), ({"competition_date_to": "2026-04-01"}, "invalid-date-range"), ({"competition_date": None}, "invalid-date-range"),
        ({"competition_year": 2024, "competition_date": None, "competition_date_to": None}, "invalid-year"), ({"competition_year": 2025}, "year-mismatch"), ({"competition_year": None}, "year-mismatch"), ({"date_evidence": None}, "date-without-evidence"), ({"citation_sha256": "g"}, "citation-not-of-receipt"), ({"title": " "}, "missing-title"),
        ({"relationship": "maybe"}, "invalid-relationship"), ({"candidate_snapshot_ids": ["s"]}, "proven-and-candidate"), ({"history": history[:1]}, "invalid-history"), ({"history": history}, None),
    ]
    leads = spark.createDataFrame([tuple((good | {"id": f"l{i}"} | c).values()) for i, (c, _) in enumerate(cases)], "id string, route_id string, status string, title string, competition_date string, competition_date_to string, competition_year int, date_evidence string, citation_sha256 string, relationship string, snapshot_ids array<string>, candidate_snapshot_ids array<string>, history array<struct<at:string,status:string>>")
    out = {r["id"]: r["problem"] for r in roster.lead_problems(leads, frame, cutoff).collect()}
    assert [out[c.get("id", f"l{i}")] for i, (c, _) in enumerate(cases)] == [p for _, p in cases]


def test_peer_lists(spark):
    rows = [("a", "x", 3.0), ("b", "x", 5.0), ("c", "x", 3.0), ("d", "x", None), ("e", None, 1.0)]
    out = [tuple(r) for r in ranking.peer_lists(spark.createDataFrame(rows, "id string, k string, v double"), "v", "id", "k").orderBy("k", "place").collect()]
    assert out == [(None, 1, "e", 1, 1), ("x", 1, "b", 1, 3), ("x", 2, "a", 2, 3), ("x", 3, "c", 2, 3)]


def test_attempt_groups_query_by_brute_force(spark):
    """The registered query over the whole table: parts are one group that share a position or a scope, directly or over others."""
    folder = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{folder}/part.parquet").collect()
    parent = {r["p_partkey"]: r["p_partkey"] for r in parts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for r in parts:
        for key in (("position", r["p_brand"], r["p_size"]), ("scope", r["p_name"], r["p_type"])):
            a, b = root(first.setdefault(key, r["p_partkey"])), root(r["p_partkey"])
            parent[max(a, b)] = min(a, b)
    out = registry.queries()["attempt_groups"](spark, folder)
    ident, group = out.columns[0], next(c for c in out.columns if c in ("group", "component", "attempt_group"))
    assert {r[ident]: r[group] for r in out.collect()} == {p: root(p) for p in parent}
