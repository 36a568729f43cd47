"""Exact bindings, comparisons for reviewers, labels, the inspector, page contexts and workbook rows."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.operators import comparing, exact, inspector
from tesserae.sources import contexts
from tests.test_facts import GOOD, SCOPE

A, B, C = (c * 64 for c in "abc")
SCOPED = {"year": "2026", "discipline": "dnf"}
PUB = f"result_id string, observation_id string, ordinal int, source_sha256 string, artifact_sha256 string, federation string, event_id string, view_id string, facts array<struct<name:string,result_id:string,policy:string,source_sha256:string,artifact_sha256:string,page:int,line:int>>"
EVI = "result_id string, observation_id string, ordinal int, source_sha256 string, artifact_sha256 string, job_id string, candidate_id string, parser_version string, page int, line int, table int, row int"
CON = "job_id string, candidate_id string, ordinal int, source_sha256 string, artifact_sha256 string, page int, line int, table int, row int, year string, discipline string, public_id string"


def published(i, **change):
    own = hashlib.sha256(str(i).encode()).hexdigest()
    fact = {"result_id": own, "policy": "p", "source_sha256": B, "artifact_sha256": C, "page": 1, "line": i} | change.get("fact", {})
    facts = [tuple({"name": n} | fact for _ in [0])[0] for n in change.get("names", exact.FACTS)]
    row = (own, A, 0, B, C, "AIDA", "event-1", "view-1", [(f["name"], f["result_id"], f["policy"], f["source_sha256"], f["artifact_sha256"], f["page"], f["line"]) for f in facts])
    proof = (own, A, 0, B, C, f"j{i}", f"c{i}", "v1", 1, i, None, None)
    kept = (f"j{i}", f"c{i}", 0, B, C, 1, i, None, None, "2026", "dnf", None)
    put = lambda row, names, change: tuple(change.get(n, v) for n, v in zip(names, row, strict=True))
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    return put(row, names(PUB), change.get("row", {})), put(proof, names(EVI), change.get("proof", {})), put(kept, names(CON), change.get("kept", {}))


def test_publication_problems_name_what_differs(spark):
    cases = [
        ({}, []), ({"row": {"observation_id": "x"}}, ["invalid-reference", "reference-changed"]), ({"proof": {"ordinal": 5}}, ["reference-changed"]), ({"kept": {"line": 99}}, ["unmatched-context"]), ({"proof": {"parser_version": None}}, ["missing-parser-version"]),
        ({"kept": {"artifact_sha256": A}}, ["retained-reference-differs"]), ({"kept": {"discipline": "sta"}}, ["unsupported-scope"]), ({"kept": {"public_id": "other"}}, ["mapping-changed"]), ({"row": {"event_id": "Event 1"}}, ["invalid-source"]),
        ({"names": exact.FACTS[1:]}, ["missing-facts"]), ({"names": (*exact.FACTS, "extra")}, ["unsupported-facts"]), ({"names": (*exact.FACTS, *exact.OPTIONAL)}, []), ({"names": (*exact.FACTS, "review")}, ["repeated-facts"]),
        ({"fact": {"result_id": "z"}}, ["fact-binding-changed"]), ({"fact": {"policy": None}}, ["fact-policy-changed"]), ({"fact": {"line": 0}}, ["fact-citation-changed"]), ({"fact": {"source_sha256": A}}, ["fact-citation-changed"]),
    ]
    made = [published(i, **change) for i, (change, _) in enumerate(cases, 1)]
    wanted = {r[0][0]: w for r, (_, w) in zip(made, cases, strict=True)}
    rows, proofs, kept = (list(x) for x in zip(*made, strict=True))
    crowd, twice, bare, many = published(101), published(102), published(103), published(104)
    second = published(105, proof={"line": 101, "job_id": "j105"}, kept={"line": 101, "job_id": "j105"}, fact={"line": 101})
    rows += [crowd[0], second[0], twice[0], twice[0], bare[0], many[0]]
    proofs += [crowd[1], second[1], twice[1], many[1], many[1]]
    kept += [crowd[2], second[2], twice[2], many[2], published(2)[2]]
    wanted |= {crowd[0][0]: ["duplicate-position"], second[0][0]: ["duplicate-position"], twice[0][0]: ["duplicate-result", "duplicate-position"], bare[0][0]: ["missing-evidence", "fact-citation-changed"], many[0][0]: ["several-evidence"]}
    wanted[rows[1][0]] += []
    out = exact.publication_problems(spark.createDataFrame(rows, PUB), spark.createDataFrame(proofs, EVI), spark.createDataFrame(kept, CON), SCOPED, "p")
    found = {r["result_id"]: r["problems"] for r in out.collect()}
    wanted[rows[1][0]] = ["invalid-reference", "reference-changed", "several-context-rows"]
    assert found == wanted


def test_publication_facts_one_by_one(spark):
    good = published(1)
    facts = good[0][-1]
    other = lambda **change: [*facts[:-1], tuple(change.get(n, v) for n, v in zip(("name", "result_id", "policy", "source_sha256", "artifact_sha256", "page", "line"), facts[-1], strict=True))]
    cases = [
        (facts[::-1], []), (other(name=None), ["missing-facts", "unsupported-facts"]), (other(result_id=None), ["fact-binding-changed"]), (other(policy="q"), ["fact-policy-changed"]), (other(artifact_sha256=None), ["fact-citation-changed"]),
        (other(page=None), ["fact-citation-changed"]), (other(line=2), ["fact-citation-changed"]), (facts[1:] + facts[-1:], ["missing-facts", "repeated-facts"]), ([], ["missing-facts"]), (None, ["missing-facts"]),
    ]
    rows = [(n, *good[0][:-1], f) for n, (f, _) in enumerate(cases)]
    for row in rows:  # each a publication of its own, so that none repeats another
        out = exact.publication_problems(spark.createDataFrame([row], f"n int, {PUB}"), spark.createDataFrame([good[1]], EVI), spark.createDataFrame([good[2]], CON), SCOPED, "p", named=("n",))
        assert [tuple(r) for r in out.collect()] == [(row[0], cases[row[0]][1])]


def test_publication_rows_keep_their_names_and_do_not_depend_on_order(spark):
    one, two, bare, void = published(1), published(2), published(3), published(4, row={"source_sha256": None}, proof={"source_sha256": None}, kept={"source_sha256": None})
    other = published(2, proof={"line": 9, "job_id": "j9", "ordinal": 7})[1]  # a second evidence, without a context row
    nowhere = (None, None, 0, B, C, None, None, None, None, "2026", "dnf", None)  # no evidence leads to it
    rows = [(1, *one[0]), (2, *one[0]), (3, *two[0]), (4, *bare[0]), (5, *void[0])]
    found = []
    for turn in (1, -1):
        frames = [spark.createDataFrame(x[::turn], schema).coalesce(1) for x, schema in ((rows, f"n int, {PUB}"), ([one[1], two[1], other, void[1]], EVI), ([one[2], two[2], void[2], nowhere], CON))]
        found.append(sorted(map(tuple, exact.publication_problems(*frames, SCOPED, "p", named=("n",)).collect())))
    assert found[0] == found[1]
    told = dict(found[0])
    assert len(found[0]) == 5 and told[1] == told[2] == ["duplicate-result", "duplicate-position"] and told[3][0] == "several-evidence" and told[4] == ["missing-evidence", "fact-citation-changed"]
    assert told[5] == ["invalid-reference", "retained-reference-differs", "fact-citation-changed"]


def test_revision_problems(spark):
    ref = "array<struct<job_id:string,ordinal:int,source_sha256:string,candidate_id:string>>"
    records = [("a", "s1", "p1", "c", [("j", 0, "s1", "x")]), ("b", "s1", "p9", "c", [("j", 0, None, "x"), ("j", 1, None, "y")]), ("d", "s2", "p1", "c", [("j", 2, None, "z")]), ("e", "s1", "p1", "c1", [("k", 0, None, "q")]), ("f", "s1", "p1", "c2", [("k", 0, None, "q")]), ("g", "s1", "p1", None, [("j", None, None, "x"), ("n", 0, None, "x"), ("j", 3, "s9", "w")]), ("h", "s1", "p1", "c", [])]
    revisions = [("j", 0, "s1", "p1", "x"), ("j", 1, "s1", "p1", "other"), ("j", 2, "s1", "p1", "z"), ("j", 3, "s1", "p1", "w"), ("k", 0, "s1", "p1", "q")]
    out = exact.revision_problems(spark.createDataFrame(records, f"record_id string, source_sha256 string, parser_version string, citation string, refs {ref}"), spark.createDataFrame(revisions, "job_id string, ordinal int, source_sha256 string, parser_version string, candidate_id string"), ["candidate_id"])
    found = {(r["record_id"], r["job_id"], r["ordinal"]): (r["problem"], r["parser_differs"], r["repeated"]) for r in out.collect()}
    assert found == {
        ("a", "j", 0): (None, False, True), ("b", "j", 0): (None, True, True), ("b", "j", 1): ("mismatched-observation", True, False), ("d", "j", 2): ("source-differs", False, False), ("e", "k", 0): ("ambiguous-reference", False, True), ("f", "k", 0): ("ambiguous-reference", False, True),
        ("g", "j", None): ("malformed-reference", False, False), ("g", "n", 0): ("missing-observation", False, False), ("g", "j", 3): ("source-differs", False, False),
    }


def test_decision_problems(spark):
    names = "position_id job_id ordinal source_sha256 artifact_sha256 parser_version raw_category raw_representation category_status representation_status accepted_categories category_citation representation_citation revision".split()
    good = dict(zip(names, ["p", "j", 0, "s", "a", "v", "cat", "rep", "human", "unresolved", ["x"], "c", None, 3], strict=True))
    cases = [
        ({}, None), ({"position_id": None}, "missing-position"), ({"position_id": "gone"}, "no-single-row"), ({"position_id": "two"}, "no-single-row"), ({"job_id": "k"}, "job-differs"), ({"artifact_sha256": "b"}, "version-differs"), ({"raw_category": None}, "raw-category-differs"), ({"raw_representation": "x"}, "raw-representation-differs"),
        ({"category_status": "maybe"}, "invalid-status"), ({"accepted_categories": None}, "categories-missing"), ({"category_citation": ""}, "citation-missing"), ({"representation_status": "automatic"}, "citation-missing"), ({"revision": None}, "revision-missing"),
    ]
    rows, kept, wanted = [], [("two", "candidate_position", "j", 0, "s", "a", "v", "cat", "rep")] * 2 + [("other", "source", "j", 0, "s", "a", "v", "cat", "rep")], {}
    for n, (change, problem) in enumerate(cases):
        ident = change.get("position_id", f"p{n}")
        rows.append(tuple((good | {"position_id": ident} | change).values()))
        wanted[ident] = problem
        if ident == f"p{n}":
            kept.append((ident, "candidate_position", "j", 0, "s", "a", "v", "cat", "rep"))
    rows += [tuple((good | {"position_id": "again"}).values())] * 2
    kept += [("again", "candidate_position", None, None, "s", None, "v", None, None), ("free", "candidate_position", None, None, "s", None, "v", None, None)]
    rows += [tuple((good | {"position_id": "free", "job_id": "q", "artifact_sha256": "q"}).values())]
    schema = "position_id string, job_id string, ordinal int, source_sha256 string, artifact_sha256 string, parser_version string, raw_category string, raw_representation string, category_status string, representation_status string, accepted_categories array<string>, category_citation string, representation_citation string, revision int"
    out = exact.decision_problems(spark.createDataFrame(rows, schema), spark.createDataFrame(kept, "source_id string, kind string, job_id string, ordinal int, source_sha256 string, artifact_sha256 string, parser_version string, category_raw string, representation_raw string"))
    assert {r["position_id"]: r["problem"] for r in out.collect()} == wanted | {"again": "duplicate-position", "free": None}


def test_artifact_problems(spark):
    lines = spark.createDataFrame([("d", 1, n, f"line {n}") for n in range(1, 6)], "doc string, page int, line int, text string")
    cases = [
        (1, 1, 1, "line 1", "parsed", "{}", "unreviewed", None, None), (2, 1, 2, "line 2\nline 3", "unparsed", None, "unreviewed", [(1, 2, "line 2"), (1, 3, "line 3")], None), (3, 1, 2, "line 2", "parsed", None, "unreviewed", None, "malformed-status"), (4, 1, 2, "line 2", "parsed", "{}", "done", [], "malformed-status"),
        (5, 1, 2, "line 3\nline 2", "parsed", "{}", "unreviewed", [(1, 3, "line 3"), (1, 2, "line 2")], "own-place-not-first"), (6, 1, 2, "line x", "parsed", "{}", "unreviewed", [(1, 2, "line x")], "line-differs"), (7, 1, 9, "", "parsed", "{}", "unreviewed", None, "line-differs"), (8, 1, 4, "line", "parsed", "{}", "unreviewed", [], "raw-text-differs"),
    ]
    frame = spark.createDataFrame([("d", *c[:8]) for c in cases], "doc string, candidate int, page int, line int, raw string, parse_status string, parsed string, review_status string, source_lines array<struct<page:int,line:int,text:string>>")
    assert {r["candidate"]: r["problem"] for r in exact.artifact_problems(frame, lines).collect()} == {c[0]: c[8] for c in cases}


def test_selection_problems(spark):
    make = spark.createDataFrame
    members = make([("a1", "A", "7"), ("a2", "A", "7"), ("b1", "B", "1"), ("b2", "B", "2"), ("c1", "C", None), ("d1", "D", "4"), ("d2", "D", "4"), ("e1", "E", "5"), ("e2", "E", "5"), ("e1", "E", "5")], "ref string, attempt string, bib string")
    refs = lambda *x: make([(r,) for r in x], "ref string")
    run = lambda complete: {tuple(r) for r in exact.selection_problems(members, refs("a1", "b1", "b2", "d1", "x", "a1"), refs("a1", "z"), refs("c1"), make([("a2", "a1")], "excluded string, chosen string"), complete).collect()}
    partial = {("e1", "repeated-member"), ("a1", "repeated-selection"), ("x", "selected-outside-inventory"), ("z", "previous-member-omitted"), ("c1", "member-of-another-event"), ("b1", "conflicting-identifiers"), ("b2", "conflicting-identifiers"), ("b1", "several-versions-selected"), ("b2", "several-versions-selected"), ("d2", "excluded-without-relationship")}
    assert run(False) == partial and run(True) == partial | {("c1", "attempt-without-version"), ("e1", "attempt-without-version"), ("e2", "attempt-without-version")}


def test_blind_comparison(spark):
    rng = random.Random(5)
    first = [(1, i, {"name": "n", "depth": rng.choice(["1", "2", "", None]), **({"time": "t"} if rng.random() < 0.8 else {})}) for i in range(60)]
    later = [(1, i, f"pos {i}", {"name": "n", **({"d": rng.choice(["1", "2", ""])} if rng.random() < 0.9 else {}), "t": "t"}) for i in range(2, 62)]
    out = comparing.blind_comparison(spark.createDataFrame(first, "page int, row int, fields map<string,string>"), spark.createDataFrame(later, "page int, row int, position string, fields map<string,string>"), ["page", "row"], {"name": "name", "d": "depth", "t": "time"}, "seed")
    a, b = {x[:2]: x[2] for x in first}, {x[:2]: x[3] for x in later}
    agreed = []
    got = {(r["page"], r["row"]): r for r in out.collect()}
    assert set(got) == set(a) | set(b)
    for key, r in got.items():
        if key not in b or key not in a:
            assert r["different"] == ["only-first" if key not in b else "only-later"]
            continue
        asked = {n: o for n, o in {"name": "name", "d": "depth", "t": "time"}.items() if n in b[key]}
        assert r["missing"] == sorted(n for n, o in asked.items() if o not in a[key])
        assert r["different"] == sorted(n for n, o in asked.items() if o in a[key] and (a[key][o] or "") != (b[key][n] or ""))
        if not r["missing"] and not r["different"]:
            agreed.append(key)
    chosen = sorted(agreed, key=lambda k: hashlib.sha256(f"seed:pos {k[1]}".encode()).hexdigest())[: math.ceil(len(agreed) / 10)]
    assert {k for k, r in got.items() if r["sampled"]} == set(chosen) and chosen


def test_versions_side_by_side(spark):
    make = spark.createDataFrame
    positions = make([(1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (2, 0, "d")], "unit int, i int, record_id string")
    versions = make([(1, 0, "v2b", "p/1"), (1, 0, "v1b", "p/1"), (1, 0, "w", "p/2"), (1, 0, "x", "p/3"), (2, 0, "y", "p/3")], "unit int, i int, record_id string, parser_version string")
    diffs = make([(1, 0, "one"), (2, 0, "x"), (2, 0, "y")], "unit int, i int, changes string")
    decided = make([(2, 0, "kept")], "unit int, i int, decision string")
    out = {r["record_id"]: r for r in comparing.versions_side_by_side(positions, versions, diffs, decided, ["unit", "i"]).collect()}
    assert set(out) == {"a", "d"}
    assert (out["a"]["v1"]["record_id"], out["a"]["v2"]["record_id"], out["a"]["diff"]["changes"], out["a"]["decision"]) == ("v1b", "w", "one", None)
    assert (out["d"]["v1"], out["d"]["v2"], out["d"]["diff"], out["d"]["decision"]["decision"]) == (None, None, None, "kept")


def test_denominators_and_replay(spark):
    rows = [("s1", "candidate_position", "o1", "v1", "2025-01-01"), ("s1", "candidate_position", "o1", None, "2025-02-01"), ("s1", "source", "o9", "v9", "2025-02-01"), ("s2", "candidate_position", "o1", "v2", None), ("s3", "gap", None, None, None)]
    frame = spark.createDataFrame(rows, "source_name string, kind string, source_object_id string, observation_version string, date string")
    bucket = F.when(F.col("date").isNull(), "unknown").when(F.substring("date", 1, 4).isin("2025", "2026"), F.substring("date", 1, 4)).otherwise("outside_scope")
    out = {(r["source_name"], r["bucket"]): tuple(r)[2:] for r in comparing.denominators(frame, bucket).collect()}
    assert len(out) == 4 * 4 and out["s1", "2025"] == (2, 1, 1) and out["s2", "unknown"] == (1, 1, 1) and out["s3", "2026"] == (0, 0, 0) and out[None, "2025"] == (2, 1, 1) and out[None, "unknown"] == (1, 1, 1)
    assert comparing.denominators(frame.limit(0), bucket).count() == 0
    entries = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "source_sha256 string, source_version string")
    positions = spark.createDataFrame([("a", "p", "routed"), ("a", "q", "gap")], "source_sha256 string, position_id string, status string")
    one = spark.createDataFrame([("a", "s")], "source_sha256 string, section_id string")
    assert tuple(comparing.replay_metrics(entries, positions, one, one.limit(0)).first()) == (2, 1, 2, 1, 1, 1, 2, 0)


def test_cases_in_the_order_asked_for(spark):
    cases = spark.createDataFrame([("a", "j", 1, "x"), ("b", "j", 0, "x"), ("c", "i", 5, "x"), ("d", "h", 0, "x")], "case_id string, job_id string, ordinal int, outcome string")
    scores = spark.createDataFrame([("a", "r1", "complete", 0.5, 0.4, 0.1), ("a", "r2", "complete", 0.9, 0.05, 0.05), ("b", "r1", "complete", 0.9, 0.1, 0.0), ("c", "r1", "failed", 1.0, 0.0, 0.0), ("d", "r1", "complete", 1.2, 0.0, 0.0)], "case_id string, run_id string, status string, match double, no_match double, abstain double")
    order = lambda sort: [r["case_id"] for r in comparing.queued_cases(cases, scores, sort).orderBy("place").collect()]
    assert order("match-desc") == ["b", "a", "d", "c"] and order("match-asc") == ["a", "b", "d", "c"] and order("no-match-desc") == ["a", "b", "d", "c"]
    with pytest.raises(ValueError):
        comparing.queued_cases(cases, scores, "best")


def test_labels_and_contexts(spark):
    rows = [("A", "A", "1"), ("A", "B", "1"), (None, "B", None), (None, None, None), ("Z", None, None), ("C", None, "")]
    frame = spark.createDataFrame(rows, "r string, h string, x string").withColumn("d", F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two"), F.lit("C"), F.lit(" ")))
    value = F.try_element_at("d", F.coalesce("r", "h"))
    out = [tuple(r["m"]) for r in frame.select(labels.mapped_label(F.col("r"), F.col("h"), F.col("d"), F.trim(value) != "").alias("m")).collect()]
    assert out == [("accepted", "one", "explicit-dictionary-map"), ("unresolved", None, "row-heading-conflict"), ("accepted", "two", "explicit-dictionary-map"), ("unresolved", None, "missing-label"), ("unresolved", None, "unmapped-label"), ("unresolved", None, "unmapped-label")]
    (bare,) = frame.limit(1).select(labels.mapped_label(F.col("r"), F.col("h"), F.col("d"), semantic=F.lit(False)).alias("m")).collect()
    assert bare["m"]["rule"] == "unsupported-column-semantics"
    got = spark.createDataFrame([("2026-01-01", " STA ", "Female", [("2026-01-02", "sta", "men"), (None, "dyn", None)]), (None, "?", None, [("x", "dyn", "men")]), ("d", "all", "all", None)], "e string, d string, g string, a array<struct<selected_date:string,discipline:string,gender:string>>")
    errors = got.select(labels.context_errors({"event_date": F.col("e"), "discipline": F.col("d"), "gender": F.col("g")}, F.col("a")).alias("x")).collect()
    assert [r["x"] for r in errors] == [["acquisition-date-conflict", "acquisition-discipline-conflict", "acquisition-gender-conflict"], [], []]


def test_inspector(spark):
    claim = [c for c in inspector.CLAIM if c not in ("country", "continent")]
    rows, claims = [], []
    for i, change in enumerate([{}, {"final_value": "80.5"}, {"final_value": "71.2"}, {"review": "unknown"}, {"discipline": "STA"}, {"gender": "Men"}, {"final_value": "71.5"}]):
        r = GOOD | {"candidate_id": f"c{i}", "ordinal": i} | change
        rows.append(tuple(v for k, v in r.items() if k not in claim))
        if i != 6:
            claims.append((r["job_id"], i, f"c{i}", r["source_sha256"], r["artifact_sha256"], *(r[c] for c in claim), "FRA" if i else "ITA", "Europe"))
    claims += [claims[0][:1] + (6, "c6") + claims[0][3:]] * 2  # two claims are none
    kinds = {"ordinal": "int", "final_places": "int", "view_selected": "boolean", "conflict_resolved": "boolean"}
    typed = lambda names: ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    obs = spark.createDataFrame(rows, typed([k for k in GOOD if k not in claim]))
    made = spark.createDataFrame(claims, typed([*inspector.REFERENCE, *claim, "country", "continent"])).withColumn("final_value", F.col("final_value").cast("decimal(18,6)"))
    out = inspector.inspect(obs, made, SCOPE, "dynamic", limit=10)
    got = {r["candidate_id"]: r for r in out.rows.collect()}
    assert [r["candidate_id"] for r in out.rows.collect()][:3] == ["c1", "c0", "c2"]
    assert {i: (got[i]["international_rank"], got[i]["international_peers"], got[i]["national_rank"]) for i in ("c0", "c1", "c2")} == {"c0": (2, 3, 1), "c1": (1, 3, 1), "c2": (2, 3, 2)}
    assert got["c3"]["comparison"] == "withheld" and got["c4"]["comparison"] == "excluded" and got["c6"]["comparison"] == "withheld" and got["c6"]["international_rank"] is None
    assert tuple(out.coverage.first()) == (7, 3, 2, 2) and out.facets.first()["gender"] == ["Men", "Women"]
    men = inspector.inspect(obs, made, SCOPE, "dynamic", {"gender": "Men", "review": "all", "category": None}, limit=10)
    assert [r["candidate_id"] for r in men.rows.collect()] == ["c5"] and men.facets.first()["gender"] == ["Men", "Women"]
    with pytest.raises(ValueError):
        inspector.inspect(obs, made, SCOPE, "dynamic", {"name": "x"})
    shown = inspector.PublicResults(spark.createDataFrame([("r1", "Ann", "i1", "b"), ("r2", "Ann", "i2", "b"), ("r3", "Bo", "i1", "b")], "result_id string, source_name string, identity_id string, body string"))
    ids = lambda df: [r["result_id"] for r in df.orderBy("result_id").collect()]
    assert (ids(shown.results(2, 1)), ids(shown.search("Ann")), ids(shown.result("r3")), ids(shown.history("i1")), tuple(shown.coverage().first())) == (["r2", "r3"], ["r1", "r2"], ["r3"], ["r1", "r3"], (3, 2, "pilot", "partial"))


def test_visible_names(spark):
    pages = [
        (1, "<title>T</title><h1> A &amp; <b>B</b> </h1>"), (2, "<h1>A</h1><h1>B</h1>"), (3, "<div hidden><h1>A</h1></div><h1 style='color:red; display : none'>x</h1><h1>B</h1>"), (4, "<div class='x site-header__branding'><a><img alt=' Cup '></a></div>"),
        (5, "<div class=site-header__branding2><img alt=Cup></div><h1>Cup</h1>"), (6, "<div aria-hidden=' TRUE '><img alt=z></div><img alt=y><template><h1>t</h1></template><h1> </h1>"), (7, None), (8, "<p>open<h1>A</p></h1><noscript><h1>n</h1></noscript>"), (9, "<h1>A<span hidden>no</span></h1>"),
    ]
    out = {r["id"]: (r["event_name"], len(r["names"])) for r in contexts.visible_names(spark.createDataFrame(pages, "page int, html string"), "page", "html").collect()}
    assert out == {1: ("A & B", 1), 2: (None, 2), 3: ("B", 1), 4: ("Cup", 1), 5: (None, 2), 6: (None, 0), 7: (None, 0), 8: ("A", 1), 9: ("A", 1)}


def test_cut_references_stay(spark):
    pages = spark.createDataFrame([(1, "<h1>A &amp;&amp</h1>"), (2, "<h1>&am B&lt;</h1>"), (3, "<h1>&#65;&#66 &quo</h1>"), (4, "<h1>&ampx; &nope;</h1>"), (5, "<div class=site-header__branding><img alt='a&b&lt;'></div>")], "page int, html string")
    assert [r["event_name"] for r in contexts.visible_names(pages, "page", "html").orderBy("id").collect()] == ["A &&amp", "&am B<", "A&#66 &quo", "&ampx; &nope;", "a&b<"]


def test_workbook_rows_and_packets(spark, tmp_path):
    rules = [contexts.RowRule("S", "result", 2, "B", (("name", "B"), ("points", "C")), "ABC"), contexts.RowRule("S", "static", 2, "D", (("name", "B"), ("time", "D")), "BD"), contexts.RowRule("S", "placeholder", 2, "A", (("rank", "A"),), "AB", lacks="B")]
    cells = [("S", 1, "B", "Name", None, None), ("S", 2, "A", "1", None, None), ("S", 2, "B", "Ann", None, None), ("S", 2, "D", "4.10", "=D1", "4.10"), ("S", 3, "A", "2", None, None), ("T", 2, "B", "x", None, None), ("S", 4, "B", None, None, None), ("S", 4, "A", None, None, None)]
    out = {(r["row"], r["kind"]): r for r in contexts.workbook_rows(spark.createDataFrame(cells, "sheet string, row int, column string, value string, formula string, cached string"), rules).collect()}
    assert set(out) == {(2, "result"), (2, "static"), (3, "placeholder")}
    assert out[2, "result"]["fields"] == {"name": "Ann", "points": None} and out[2, "result"]["citation"] == "S!A2:B2" and out[2, "static"]["cells"][-1]["formula"] == "=D1"
    (tmp_path / "a.json").write_text(json.dumps({"rows": [1]}))
    sha = hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    assert contexts.packets(spark, str(tmp_path), {"a.json": sha}).select(F.try_variant_get("packet", "$.rows[0]", "int").alias("x")).first()["x"] == 1
    for wrong in ({"a.json": "0" * 64}, {"b.json": sha}):
        with pytest.raises(ValueError):
            contexts.packets(spark, str(tmp_path), wrong)
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        contexts.packets(spark, str(tmp_path), {})
    objects = spark.createDataFrame([("h", "p", 1), ("g", "q", 2)], "sha256 string, path string, bytes int")
    got = contexts.inspected(objects, spark.createDataFrame([("h", "a2"), ("h", "a1"), ("g", "a3")], "sha256 string, acquisition_id string"), "h").collect()
    assert [r["acquisition_id"] for r in got] == ["a1", "a2"]


def test_retained_matches(spark):
    rows = [("k1", "s", '{"page": 1, "line": 2}', "a", '{"x": 1, "y": 2}'), ("k2", "s", '{"page": 1, "line": 3}', "a", '{"x": 1}'), ("k3", "s", None, "a", '{"x": 1}'), ("k4", "s", '{"page": 9}', None, '{"x": 1}'), ("k5", "t", '{"page": 1}', "b", "{}"), ("k6", "t", '{"page": 1}', "b", "{}"), ("k7", "u", '{"page": 1}', "b", "{}")]
    kept = [("p1", "s", '{"line": 2, "page": 1}', "a", '{"y": 2, "x": 1}'), ("p2", "s", '{"page": 1, "line": 3}', "A", '{"x": 1}'), ("p3", "s", None, "a", '{"x": 1}'), ("p5", "t", '{"page": 1}', "b", "{}"), ("p7", "u", '{"page": 1}', "b", "{}"), ("p8", "u", '{"page": 1}', "b", "{}")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} string, source_sha256 string, coordinates string, line string, fields string").withColumns({c: F.parse_json(c) for c in ("coordinates", "fields")})
    out = {r["candidate_id"]: (r["position_id"], r["status"]) for r in exact.retained_matches(frame(rows, "candidate_id"), frame(kept, "position_id")).collect()}
    assert out == {"k1": ("p1", "matched"), "k2": (None, "unmatched"), "k3": ("p3", "matched"), "k4": (None, "incomplete"), "k5": (None, "position-reused"), "k6": (None, "position-reused"), "k7": (None, "ambiguous-position")}


def test_refresh_plans(spark):
    from tesserae.operators import refresh

    cases = [
        (("index", None, None, None), (True, "index_each_run", 0)), (("result", None, None, None), (True, "never_checked", 7)), (("result", "2026-05-20", False, "2026-05-30"), (False, "recent_or_undated_not_due", 7)), (("result", "2026-05-20", False, "2026-05-25T10:00:00+02:00"), (True, "recent_or_undated_due", 7)),
        (("result", "2025-05-20", False, "2026-05-01"), (False, "stable_not_due", 90)), (("result", "2025-05-20", True, "2026-05-31"), (True, "provisional_due", 1)), (("result", "2026-02-30", False, None), (None, "invalid-publication-date", None)), (("result", "2027-01-01", False, None), (None, "publication-in-the-future", None)),
        (("result", None, False, "2026-05-01T10:00:00"), (None, "invalid-check", None)), (("result", None, False, "2026-06-02"), (None, "check-in-the-future", None)), (("page", None, False, None), (None, "unknown-kind", None)),
    ]
    frame = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, kind string, publication_date string, provisional boolean, last_check string")
    out = {r["i"]: (r["due"], r["reason"], r["interval_days"]) for r in refresh.planned(frame, "2026-06-01").collect()}
    assert [out[i] for i in range(len(cases))] == [w for _, w in cases]
    with pytest.raises(ValueError):
        refresh.Policy(recent=200)
