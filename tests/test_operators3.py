"""Delta propagation, the discovery frontier, publication rules, cohorts, compact projections and keyed state machines."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cohort, compact, decisions, frontier, graph, publication
from tesserae.streaming import flows, machines

EDGE = "id long, needs long"


def behind(edges, starts):
    seen, queue = {s: 0 for s in starts}, list(starts)
    for x in queue:
        for a, b in edges:
            if b == x and a not in seen:
                seen[a] = seen[x] + 1
                queue.append(a)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_what_is_reached_equals_brute_force(spark, seed):
    """Also along ways longer than the tables that are kept apart, through cycles and over repeated edges."""
    rng = random.Random(seed)
    edges = [(i + 1, i) for i in range(25)] + [(rng.randrange(30, 90), rng.randrange(30, 90)) for _ in range(70)] + [(3, 40), (3, 40), (None, 1), (1, None)]
    starts = [0, 35, 200]
    found = graph.reached(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(s,) for s in [*starts, 0, None]], "node long"), "needs", "id")
    assert {r["node"]: r["steps"] for r in found.collect()} == behind([e for e in edges if None not in e], starts)


def test_waves_equal_longest_ways(spark):
    rng = random.Random(3)
    edges = [(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a > b] + [(50, 51), (51, 50), (52, 50), (53, 99)]
    nodes = [*range(40), 50, 51, 52, 53]
    wave = {}
    for n in range(40):
        wave[n] = max((wave[b] + 1 for a, b in edges if a == n), default=0)
    found = graph.waves(spark.createDataFrame([(n,) for n in nodes], "n long"), spark.createDataFrame(edges, EDGE), "n", "id", "needs")
    assert {r["node"]: r["wave"] for r in found.collect()} == {n: wave.get(n) for n in nodes}


def plainly_applied(rows, edges):
    known = {i for i, _, _ in rows}
    broken = set(behind(edges, [i for i, f, _ in rows if f])) - {i for i, f, _ in rows if f}
    lacking = {a for a, b in edges if b not in known}
    broken |= set(behind(edges, lacking))
    # one that fails and needs one that fails is its own reason first
    out = {}
    for i, f, active in rows:
        bad = i in broken or any(b in behind(edges, [x for x, g, _ in rows if g]) for a, b in edges if a == i)
        outcome = "reversed" if active and (f or bad) else "unresolved" if f else "blocked" if bad else "materialized"
        out[i] = (outcome, f or ("dependency-unapproved" if bad else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_deltas_equal_a_full_reconciliation(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a > b} | {(59, 999)})
    rows = [(i, rng.choice([None] * 7 + ["stale", "unsupported-family"]), rng.random() < 0.5) for i in range(60)]
    schema = "id long, failing string, active boolean"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    needs = spark.createDataFrame(edges, EDGE)
    result = decisions.applied(frame(rows), needs)
    read = lambda df: {r["id"]: (r["outcome"], r["reason"]) for r in df.collect()}
    assert read(result) == plainly_applied(rows, edges)
    for _ in range(2):
        changed = rng.sample(range(60), 3)
        rows = [(i, rng.choice([None, None, "stale"]) if i in changed else f, a) for i, f, a in rows]
        new = [(60, None, False)] if len(rows) == 60 else []
        if new:
            rows, edges = rows + new, [*edges, (60, changed[0])]
            needs = spark.createDataFrame(edges, EDGE)
        result = decisions.reapplied(result, frame(rows), needs, spark.createDataFrame([(i,) for i in [*changed, *(r[0] for r in new)]], "id long"))
        assert read(result) == read(decisions.applied(frame(rows), needs)) == plainly_applied(rows, edges)


def test_frontier_batches_equal_a_replay(spark):
    rng = random.Random(7)
    routes = spark.createDataFrame([("r1", "checked"), ("r2", "unchecked"), ("r3", "gap")], "route string, status string")
    found = [(n, f"u{rng.randrange(6)}", rng.choice(["r1", "r2", "r9", None]), rng.choice([2024, 2025, 1990, None]), rng.choice(["a", "b"]), rng.choice([None, "day 1"]), rng.choice(["e1", "e2", " ", None])) for n in range(80)]
    schema = "n int, url string, route string, year int, source_family string, context string, evidence string"
    leads, edges = spark.createDataFrame([], "key string, url string, year int, source_family string, outside boolean"), spark.createDataFrame([], "key string, route string, evidence string")
    rejected = []
    for cut in ((0, 10), (10, 11), (11, 60), (40, 80)):  # the last batch repeats rows
        a, b, c = frontier.added(leads, edges, spark.createDataFrame(found[slice(*cut)], schema), routes, [2024, 2025], ["a"])
        leads, edges = leads.unionByName(a), edges.unionByName(b)
        leads, edges = (spark.createDataFrame(x.collect(), x.schema) for x in (leads, edges))
        rejected += [r["n"] for r in c.collect()]
    good = [x for x in found if x[2] in ("r1", "r2") and (x[6] or "").strip()]
    lead = {}
    for _, url, _, year, family, context, _ in good:
        lead.setdefault((url, year, family, context), year in (2024, 2025) and family == "a")
    assert sorted((r["url"], str(r["year"]), r["source_family"], not r["outside"]) for r in leads.collect()) == sorted((u, str(y), f, inside) for (u, y, f, _), inside in lead.items())
    assert edges.count() == len({(x[1], x[3], x[4], x[5], x[2], x[6]) for x in good}) and set(rejected) == {x[0] for x in found if x not in good}
    keys = sorted(r["key"] for r in leads.collect())
    told = spark.createDataFrame([(keys[0], 1, "gap", "x"), (keys[0], 2, "acquired", "y"), (keys[1], 3, "unsupported", "z"), (keys[2], 4, "nonsense", "z"), ("none", 5, "gap", "q")], "key string, revision long, status string, evidence string")
    status = {r["key"]: r["status"] for r in frontier.dispositions(leads, told).collect()}
    assert (status[keys[0]], status[keys[1]]) == ("acquired", "unsupported") and sum(s is None or s == "out_of_scope" for s in status.values()) == len(keys) - 2
    asks = [("s", n, rng.choice([1, 2, 5, 0])) for n in range(12)] + [("t", 0, 7)]
    granted = {(r["session"], r["n"]): r["granted"] for r in frontier.spent(spark.createDataFrame(asks, "session string, n int, count int"), 9).collect()}
    used = 0
    for s, n, count in asks[:12]:
        fits = count >= 1 and used + count <= 9
        used += count if fits else 0
        assert granted[s, n] == fits
    line = frontier.summary(routes, leads, told, frontier.spent(spark.createDataFrame(asks, "session string, n int, count int"), 9)).first()
    waiting = sum(s is None for s in status.values())
    assert tuple(line) == ("checkpoint", 1, waiting, 2, len(keys), used + 7)
    assert frontier.frontier_pages(leads, told, 2, F.lit(0)).count() == min(2, waiting)


def test_blockers_name_every_reason(spark):
    good = {
        "kind": "result-row", "parse_status": "parsed", "discipline": "STA", "source_name": "Ann", "performance": 5.0, "final_depth": None, "final_distance": None, "realized_distance": None, "final_time": None, "realized_time": None,
        "status": None, "coordinate": "p1", "known_coordinates": ["p1"], "acquisitions": [("https://x.org/a", "x", "s")], "source_sha256": "s", "html": False, "context": None, "unsupported_tables": 0, "flags": ["f"],
        "uncertainties": ["owner-review-required"], "fields": [("unit", "ambiguous", "time-unit-not-explicit")],
    }
    time = "struct<components:array<int>,fraction:string,fraction_digits:int,notation:string>"
    schema = (
        "kind string, parse_status string, discipline string, source_name string, performance double, final_depth double, final_distance double, realized_distance double, final_time T, realized_time T, status string, coordinate string, "
        "known_coordinates array<string>, acquisitions array<struct<final_url:string,publisher:string,sha256:string>>, source_sha256 string, html boolean, context struct<event_name:string,event_date:string,errors:array<string>>, unsupported_tables int, "
        "flags array<string>, uncertainties array<string>, fields array<struct<name:string,status:string,reason:string>>"
    ).replace(" T", " " + time)
    html = {"html": True, "context": ("e", "d", [])}
    cases = [
        ({}, []), ({"kind": "x"}, ["not-result-row"]), ({"parse_status": None}, ["unparsed"]), ({"discipline": " "}, ["missing-discipline-context"]), ({"source_name": None}, ["missing-source-name"]),
        ({"performance": float("nan")}, ["missing-performance-or-status"]), ({"performance": None, "status": "DNS"}, []), ({"performance": None, "final_time": ([4, 10], "5", 1, "colon-separated")}, []),
        ({"performance": None, "final_time": ([4], "5", 1, "colon-separated")}, ["missing-performance-or-status"]), ({"performance": None, "realized_time": ([4], None, 0, "decimal")}, []), ({"performance": None, "realized_time": ([4], "x", 1, "decimal")}, ["missing-performance-or-status"]),
        ({"coordinate": "p2"}, ["missing-source-context"]), ({"known_coordinates": None}, ["missing-source-context"]), ({"acquisitions": [("ftp://x.org", "x", "s")]}, ["missing-source-citation"]), ({"acquisitions": [("https://x.org", "x", "t")]}, ["missing-source-citation"]),
        ({"acquisitions": None}, ["missing-source-citation"]), ({"uncertainties": ["odd", "odd", "units-not-explicit"]}, ["unresolved-extraction-error: odd"]), ({"fields": [("depth", "invalid", None), ("time", "parsed", None)]}, ["invalid-field: depth"]), ({"fields": None, "flags": None, "uncertainties": None}, []),
        (html | {"flags": []}, []), (html, ["substantive-source-flag: f"]), (html | {"context": None, "flags": None}, ["missing-source-context", "missing-event-heading", "missing-event-date"]), (html | {"context": ("", None, ["bad"]), "flags": []}, ["missing-event-heading", "missing-event-date", "bad"]),
        (html | {"unsupported_tables": 2, "flags": [], "uncertainties": ["coverage-not-established"]}, ["unsupported-html-layout"]),
    ]
    rows = [tuple((good | change).values()) for change, _ in cases]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    found = {r["i"]: r["blockers"] for r in publication.blockers(frame, F.lit(publication.HTML_POLICY)).collect()}
    assert [found[i] for i in range(len(cases))] == [wanted for _, wanted in cases]
    (old,) = publication.blockers(frame.where("i = 19"), F.lit(publication.PLAIN_POLICY)).collect()
    assert old["blockers"] == ["html-policy-required"]
    placed = frame.withColumns({"job_id": F.lit("j"), "ordinal": F.col("i")})
    last = [(0, 1, "validate", publication.HTML_POLICY, 4), (2, 2, "revoke", publication.HTML_POLICY, 0), (6, 3, "validate", publication.PLAIN_POLICY, 0), (7, 4, "validate", publication.HTML_POLICY, 3)]
    d = spark.createDataFrame([("j", *x) for x in last], "job_id string, ordinal int, revision long, action string, policy_version string, review_revision long")
    r = spark.createDataFrame([("j", 0, 4), ("j", 7, 5)], "job_id string, ordinal int, revision long")
    p = spark.createDataFrame([(1, publication.PLAIN_POLICY), (2, publication.HTML_POLICY)], "revision long, policy_version string")
    out = {x["ordinal"]: tuple(x)[2:] for x in publication.diagnosis(placed, d, r, p).collect()}
    assert out[0] == (True, True, []) and out[1][2] == ["not-result-row", "validation-required"] and out[2] == (False, False, ["unparsed", "validation-revoked"])
    assert out[6] == (True, False, ["policy-version-changed"]) and out[7] == (True, False, ["review-revision-changed"]) and out[9] == (True, False, ["validation-required"])
    gone = {x["ordinal"]: tuple(x)[2:] for x in publication.diagnosis(placed, d, r, p.limit(0)).collect()}
    assert gone[0] == (False, False, ["policy-inactive", "policy-version-changed"])


def test_answers_fail_the_first_check(spark):
    good = {"type": "choice", "choice": "yes", "confidence": 0.5, "probabilities": {"yes": 0.5, "no": 0.3, "unknown": 0.2}}
    change = lambda **x: {"q": {k: v for k, v in (good | x).items() if v != "gone"}}
    p = lambda yes, no, unknown: change(probabilities={"yes": yes, "no": no, "unknown": unknown})
    cases = [
        (change(), None), ({}, "missing-answer"), ([], "missing-answer"), ({"q": None}, "invalid-answer-type"), ({"q": [1]}, "invalid-answer-type"), (change(type=1), "invalid-choice-type"), (change(type="gone"), "invalid-choice-type"),
        (change(choice="maybe"), "unsupported-choice"), (change(choice=None), "unsupported-choice"), (change(confidence="gone"), "missing-confidence"), (change(confidence="0.5"), "invalid-confidence"), (change(confidence=1.5), "invalid-confidence"), (change(confidence=None), "invalid-confidence"),
        (change(probabilities="gone"), "missing-probabilities"), (change(probabilities=[1]), "invalid-probabilities-type"), (change(probabilities={"yes": 1}), "invalid-probability-keys"), (p(0.5, "x", 0.2), "invalid-probability-type"), (p(1.2, -0.1, -0.1), "invalid-probability-range"),
        (p(0.5, 0.3, 0.21), "invalid-probability-sum"), (p(0.5, 0.3, 0.200001), None), (p(0.2, 0.5, 0.3), "choice-probability-inconsistency"), (p(0.4, 0.4, 0.2), None), (p(1, 0, 0), None),
    ]
    frame = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(cases)], "i int, a string").withColumn("v", F.parse_json("a"))
    allowed = ("yes", "no", "unknown")
    found = {r["i"]: r["e"] for r in frame.select("i", publication.choice_reason(F.col("v"), "q", allowed).alias("e")).collect()}
    assert [found[i] for i in range(len(cases))] == [e for _, e in cases]
    loose = [(0.5, 0.3, 0.22, None), (0.5, 0.3, 0.18, None), (0.5, 0.3, 0.221, "invalid-probability-sum"), (0.5, 0.3, 0.179, "invalid-probability-sum")]
    frame = spark.createDataFrame([(i, json.dumps(p(*x[:3]))) for i, x in enumerate(loose)], "i int, a string").select("i", publication.choice_reason(F.parse_json("a"), "q", allowed, True).alias("e"))
    assert [r["e"] for r in frame.orderBy("i").collect()] == [x[3] for x in loose]


def historical(spark):
    make = spark.createDataFrame
    return {
        "routes": make([("r1", "checked", "resolved", "e"), ("r2", "gap", "open", "no page"), ("r3", "checked", "resolved", "e")], "id string, status string, disposition string, evidence string"),
        "leads": make([("l1", ["r1"], "checked", ["s1"], [], "resolved", "attempt-results", "e"), ("l2", ["r1", "r2"], "gap", ["s2"], ["url", "event_date"], "resolved", "attempt-results", "e"), ("l3", ["r3"], "checked", [], ["url"], "open", None, "later")], "id string, route_ids array<string>, source_state string, source_ids array<string>, unknown_fields array<string>, disposition string, resolution string, evidence string"),
        "sources": make([("s1", ["e1"], []), ("s2", ["e1", "e2"], ["lost", "old"])], "id string, event_ids array<string>, provenance_gaps array<string>"),
        "events": make([("e1",), ("e2",), ("e3",)], "id string"),
        "positions": make([("p1", "s1", "parsed", None), ("p2", "s2", "parsed", ""), ("p3", "s2", "damaged", None), ("p4", "s2", "parsed", "two names")], "id string, source_id string, status string, unresolved_reason string"),
        "gaps": make([("g1", "search", None, "x"), ("g2", "source", "s2", "y"), ("g3", "event", "e1", "z"), ("g4", "event", "e3", "z")], "id string, scope string, ref string, reason string"),
        "relationships": make([("p1", "p2"), ("p2", "p3")], "left string, right string"),
    }


def test_cohort_selection_cascades(spark):
    tables = historical(spark)
    names = lambda out: {n: sorted(r["id"] if "id" in r else r["left"] for r in df.select(*(c for c in ("id", "left") if c in df.columns)).collect()) for n, df in out.items()}
    assert names(cohort.selected(tables))["positions"] == ["p1", "p2", "p3", "p4"]
    by_lead = names(cohort.selected(tables, lead="l1"))
    assert by_lead == {"routes": ["r1"], "leads": ["l1"], "sources": ["s1"], "events": ["e1"], "positions": ["p1"], "gaps": ["g1", "g3"], "relationships": []}
    by_route = names(cohort.selected(tables, route="r2"))
    assert by_route == {"routes": ["r2"], "leads": ["l2"], "sources": ["s2"], "events": ["e1", "e2"], "positions": ["p2", "p3", "p4"], "gaps": ["g1", "g2", "g3"], "relationships": ["p2"]}
    assert names(cohort.selected(tables, status="gap"))["routes"] == ["r1", "r2"]
    for wrong in ({"route": "x"}, {"lead": "x"}, {"status": "x"}):
        with pytest.raises(ValueError):
            cohort.selected(tables, **wrong)


def test_gate_opens_without_known_gaps(spark):
    tables = historical(spark)
    found = sorted(map(tuple, cohort.gate(tables).collect()))
    assert found == sorted([
        ("route", "r2", "no page"), ("lead", "l3", "later"), ("lead", "l2", "Unknown event fields: url, event_date"), ("census-gap", "g1", "x"), ("census-gap", "g2", "y"), ("census-gap", "g3", "z"), ("census-gap", "g4", "z"),
        ("source", "s2", "lost; old"), ("position", "p3", "damaged"), ("position", "p4", "two names"),
    ])
    events = spark.createDataFrame([("2023-01-01", "2023-02-01")], "held_from string, held_to string")
    with pytest.raises(ValueError):
        cohort.ingested(tables, events, 2023)
    clean = {n: df.limit(0) for n, df in tables.items()}
    assert cohort.ingested(clean, events, 2023).count() == 1
    for wrong in (events.limit(0), spark.createDataFrame([("2023-01-01", None)], events.schema)):
        with pytest.raises(ValueError):
            cohort.ingested(clean, wrong, 2023)


def test_compact_projection_expands_to_what_it_was(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, "f1", "f2", "f3", f"f{i}"]), rng.choice([None, f"s{rng.randrange(12)}"]), rng.choice(["ex a", "ex b", None])) for i in range(60)]
    frame = spark.createDataFrame(rows, "n long, family string, sha string, excerpt string").repartition(3)
    refs, parts = compact.compacted(frame, "n", ["family", "sha"], "excerpt")
    assert sorted(map(tuple, compact.expanded(refs, parts, "excerpt").select("n", "family", "sha", "excerpt").collect()), key=str) == sorted(rows, key=str)
    # dependence by joining everything that shares a token
    group = {i: i for i, *_ in rows}
    for _ in rows:
        for i, f, s, _ in rows:
            for j, g, t, _ in rows:
                if (f and f == g) or (s and s == t):
                    group[i] = group[j] = min(group[i], group[j])
    first, labels = {}, {}
    for i, _, _, e in rows:
        first.setdefault((group[i], e), i)
    for place, (key, _) in enumerate(sorted(first.items(), key=lambda x: x[1]), 1):
        labels[key] = f"s{place}"
    assert {(r["dependence"], r["excerpt"]): r["label"] for r in parts.collect()} == labels
    assert {r["n"]: r["label"] for r in refs.collect()} == {i: labels[group[i], e] for i, _, _, e in rows}
    none, empty = compact.compacted(frame.limit(0), "n", ["family", "sha"], "excerpt")
    assert none.count() == empty.count() == 0


MOVES = {("none", "open"): "open", ("open", "close"): "closed", ("closed", "open"): "open"}


def machine(rows):
    """(n) -> (verdict, revision, state) by one plain pass."""
    now, seen, out = {}, {}, {}
    for key, n, ident, base, action, digest in sorted(rows, key=lambda r: r[1]):
        revision, state = now.get(key, (0, "none"))
        if (key, ident) in seen:
            d, at, verdict = seen[key, ident]
            out[n] = (f"repeated-{verdict}", at, state) if d == digest else ("conflicting-id", revision, state)
            continue
        verdict = "stale" if base != revision else "accepted" if (state, action) in MOVES else "invalid"
        if verdict == "accepted":
            revision, state = revision + 1, MOVES[state, action]
        now[key] = (revision, state)
        seen[key, ident] = (digest, revision, verdict)
        out[n] = (verdict, revision, state)
    return out


@pytest.mark.parametrize("cuts", [[0, 200], [0, 1, 50, 51, 120, 200]])
def test_state_machine_does_not_depend_on_batches(spark, tmp_path, cuts):
    """Each cut is a file, a run of its own and a restart from the checkpoint."""
    rng = random.Random(13)
    rows, revision = [], {}
    for n in range(200):
        key = rng.randrange(4)
        base = revision.get(key, 0) if rng.random() < 0.8 else rng.randrange(5)
        rows.append((key, n, f"i{rng.randrange(90)}", base, rng.choice(["open", "close", "jump"]), rng.choice(["d", "d", "e"])))
        revision[key] = sum(v[0] == "accepted" for m, v in machine(rows).items() if rows[m][0] == key)
    schema = "key int, n int, id string, base int, action string, digest string"
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        flow = machines.compare_and_set(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", "none", MOVES)
        out = flows.drained(flow, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {r["n"]: (r["verdict"], r["revision"], r["state"]) for r in out.collect()} == machine(rows)
