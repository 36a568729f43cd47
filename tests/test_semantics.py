"""Hand-written rows that pin the rules (FIXTURES A1 to A9)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tesserae.functions import names, scalars
from tesserae.plans import registry
from tesserae.operators import graph, ledger, lines, matching, paging, ranking, routing, snapshot, summaries

ATTEMPT = "id string, discipline string, unit string, value decimal(18,6), reviewed boolean"


def scored(spark, *rows):
    out = ranking.comparison_score(spark.createDataFrame([(i, d, u, None if v is None else Decimal(v), r) for i, d, u, v, r in rows], ATTEMPT))
    return {r["id"]: r for r in out.collect()}


def test_scores_floor_to_whole_units(spark):
    out = scored(spark, ("a", "sta", "s", "61.99", True), ("b", "dynamic", "m", "101.99", True), ("c", "depth", "m", "50.99", True))
    assert [(float(out[i]["score"]), out[i]["common_rank"]) for i in "abc"] == [(12.2, 3), (50.5, 1), (50.0, 2)]


def test_common_rank_ties_on_scores_and_discipline_rank_on_finals(spark):
    out = scored(spark, ("a", "dynamic", "m", "100.1", True), ("b", "dynamic", "m", "100.9", True), ("c", "dynamic", "m", "90", True))
    assert [(out[i]["common_rank"], out[i]["discipline_rank"]) for i in "abc"] == [(1, 2), (1, 1), (3, 3)]


def test_withheld_rows_name_their_reasons(spark):
    out = scored(spark, ("a", "sta", "s", None, True), ("b", "sta", "s", "5", None), ("c", "speed", "s", "5", True), ("d", "sta", "s", "5", True), ("d", "sta", "s", "6", True))
    assert out["a"]["reasons"] == ["missing-final"] and out["b"]["reasons"] == ["not-reviewed"] and out["c"]["reasons"] == ["unknown-discipline"]
    assert out["d"]["reasons"] == ["duplicate-id"] and out["d"]["score"] is None


def test_mixed_units_lose_the_discipline_rank_only(spark):
    out = scored(spark, ("a", "depth", "m", "50", True), ("b", "depth", "pts", "49", True))
    assert out["a"]["common_rank"] == 1 and out["a"]["discipline_rank"] is None and out["a"]["reasons"] == ["mixed-final-units"]


def test_filter_reasons_dominate(spark):
    rows = spark.createDataFrame([(1, 5.0, True, True), (2, 5.0, False, True), (3, 5.0, False, False), (4, 5.0, False, False)], "id long, v double, other boolean, bad boolean")
    out = {r["id"]: r for r in ranking.attempt_comparison(rows, [("bad", F.col("bad"))], [("other", F.col("other"))], "v", ["id"]).collect()}
    assert [out[i]["status"] for i in (1, 2, 3, 4)] == ["excluded", "withheld", "ranked", "ranked"]
    assert [out[i]["rank"] for i in (3, 4)] == [1, 1] and [out[i]["position"] for i in (3, 4)] == [1, 2]


def test_listing_does_not_imply_sanction(spark):
    df = spark.createDataFrame([(["x"], [])], "listing array<string>, sanction array<struct<status:string>>")
    assert df.select(ranking.sanction_level(F.col("listing"), F.col("sanction"))).first()[0] == "listed"


def test_hypothetical_rank_counts_strictly_better(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 5.0), ("a", 5.0), ("b", 9.0), ("a", None)], "k string, v double")
    asks = spark.createDataFrame([("a", 5.0), ("a", 4.0), ("b", 1.0), ("c", 1.0)], "k string, ask double")
    out = {(r["k"], r["ask"]): r["hypothetical_rank"] for r in ranking.hypothetical_rank(rows, asks, "v", "ask", "k").collect()}
    assert out == {("a", 5.0): 1, ("a", 4.0): 3, ("b", 1.0): 2, ("c", 1.0): 1}


def test_name_candidates(spark):
    people = spark.createDataFrame([("1", "s", "José Pérez"), ("2", "t", "PEREZ jose"), ("3", "t", "Jose Pérez Luna"), ("4", "t", "Bo Li"), ("5", "u", None), ("6", "s", "Perez José")], "id string, source string, name string")
    pairs = {(r["left"], r["right"]): r["signal"] for r in matching.name_candidates(people, "id", "name", "source").collect()}
    assert pairs == {("1", "2"): 2, ("1", "3"): 3, ("2", "3"): 3}
    found = {r["id"]: tuple(r)[1:] for r in matching.candidate_outcome(people, "id", "name", "source").collect()}
    assert found["4"] == ("4", 0, "no-candidate") and found["3"] == ("3", 2, "ambiguous") and found["5"] == ("5", 0, "unknown")
    assert found["1"] == found["6"] == ("1", 2, "ambiguous")  # members share their group's outcome


def test_names_fold_as_written(spark):
    df = spark.createDataFrame([("Straße  Ñandú",), (None,)], "n string")
    out = df.select(names.folded("n").alias("f"), names.composed("n").alias("c"), names.squashed("n").alias("s")).collect()
    assert tuple(out[0]) == ("straße nandu", "straße ñandú", "straenandu") and tuple(out[1]) == (None, None, None)


def test_unique_matches_need_one_row_on_each_side(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "k string, l long")
    right = spark.createDataFrame([("a", 7), ("b", 8), (None, 9)], "k string, r long")
    assert [tuple(r) for r in matching.unique_matches(left, right, ["k"], "l", "r").collect()] == [(1, 7)]


def test_field_state_is_a_stack(spark):
    rows = [("f", 1, "approve", 1, None, "a", "b"), ("f", 2, "approve", 2, None, "b", "c"), ("f", 3, "reject", 3, None, None, None), ("f", 4, "reverse", 4, 2, None, None), ("g", 1, "approve", 1, None, "a", "b"), ("g", 2, "approve", 2, None, "b", "c"), ("g", 3, "reverse", 3, 1, None, None)]
    df = spark.createDataFrame(rows, "k string, revision long, action string, event_id long, target long, before string, after string")
    out = {r["k"]: (r["value"], r["depth"], r["violations"]) for r in ledger.field_states(df, ["k"]).collect()}
    assert out == {"f": ("b", 1, 0), "g": ("c", 2, 1)}


def test_ledger_guards(spark):
    revisions = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2)], "k string, revision long")
    assert sorted(tuple(r) for r in ledger.gaps(revisions, ["k"], "revision").collect()) == [("a", 4, 3), ("b", 2, 1)]
    chain = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "x", "y"), ("a", 3, "x", "z")], "k string, n long, previous string, head string")
    assert [r["n"] for r in ledger.broken_links(chain, ["k"], ["n"], "previous", "head").collect()] == [3]
    view = spark.createDataFrame([(1,)], "v long")
    counts = spark.createDataFrame([(1, 2)], "a long, b long")
    assert ledger.fence(view, counts, counts).count() == 1 and ledger.fence(view, counts, counts.withColumn("a", F.lit(9))).count() == 0


def test_graphs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    out = {r["node"]: r["component"] for r in graph.components(chain).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(chain.limit(0)).count() == 0
    nodes = spark.createDataFrame([(i,) for i in range(5)], "n long")
    needs = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 3)], "a long, b long")
    assert {r["node"]: r["wave"] for r in graph.waves(nodes, needs, "n", "a", "b").collect()} == {0: 0, 1: 1, 2: 2, 3: None, 4: None}
    assert {(r["ancestor"], r["node"]): r["depth"] for r in graph.closure(needs.where("a < 3"), "a", "b").collect()} == {(1, 0): 1, (2, 1): 1, (2, 0): 2}


def test_packets_are_flattened(spark):
    body = '{"pages": [{"id": 1, "rows": [{"n": 1}, {"n": 2}]}, {"id": 2}], "note": "x", "gaps": [3]}'
    df = spark.createDataFrame([("s", body), ("bad", "no json"), ("none", None)], "source_name string, body string")
    out = sorted((r["record_path"], r["parent_path"]) for r in snapshot.flattened(df).collect())
    assert out == [("pages/0", None), ("pages/0/rows/0", "pages/0"), ("pages/0/rows/1", "pages/0"), ("pages/1", None)]


def test_bounds_are_errors(spark):
    df = spark.range(20)
    with pytest.raises(ValueError):
        paging.page(df, ["id"], 101)
    with pytest.raises(ValueError):
        paging.bounded(df, 19)
    assert paging.bounded(df, 20).count() == 20
    rows, total, pages = paging.numbered_page(df, ["id"], 3, 9)
    assert [r["id"] for r in rows.collect()] == [18, 19] and (total, pages) == (20, 3)


def test_routing_states(spark):
    positions = spark.createDataFrame([(i, i != 5) for i in range(1, 6)], "id long, examined boolean")
    claims = spark.createDataFrame([(1, "p", True), (1, "p", True), (2, "p", True), (2, "q", True), (3, "p", False)], "id long, parser string, claimed boolean")
    out = {r["id"]: r["status"] for r in routing.routed(positions, claims, ["id"]).collect()}
    assert out == {1: "routed", 2: "ambiguous", 3: "unclaimed", 4: "unsupported", 5: "unexamined"}


def test_rates_are_unknown_without_cases(spark):
    cases = spark.createDataFrame([("no-match", "abstain"), ("no-match", "error")], "t string, o string")
    out = summaries.confusion(cases, "t", "o").first()
    assert out["recall"] is None and out["precision"] is None and out["coverage"] == 0.0 and out["cases"] == 2


def test_scalars(spark):
    row = spark.createDataFrame([("31/02/2024", "29/02/2024", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "1,5", '{"a": 0.5, "b": 0.5}', '{"a": 2}')], "a string, b string, c string, d string, e string, f string, g string")
    out = row.select(
        scalars.iso_date(F.col("a"), "dd/MM/yyyy"), scalars.iso_date(F.col("b"), "dd/MM/yyyy"), scalars.is_instant(F.col("c")), scalars.is_instant(F.col("d")), scalars.decimal_comma(F.col("e")),
        scalars.probabilities(F.col("f"), 0.01), scalars.probabilities(F.col("g"), 0.01), scalars.fixed_columns(F.lit("ab  cd e"), [0, 4, 7]), scalars.has_places(F.lit(Decimal("1.25")), 1),
        scalars.one_scope(F.array(F.lit("a"), F.lit(None), F.lit("a"))), scalars.map_diff(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("x"), F.lit("1"), F.lit("z"), F.lit("3"))),
    ).first()
    assert list(out)[:5] == [None, "2024-02-29", True, False, Decimal("1.500000")]
    assert out[5] == {"a": 0.5, "b": 0.5} and out[6] is None and out[7] == ["ab", "cd", "e"] and out[8] is False and out[9] is True
    assert {k: tuple(v) for k, v in out[10].items()} == {"y": ("2", None), "z": (None, "3")}


def test_continuation_lines(spark):
    df = spark.createDataFrame([("p", 1, "head"), ("p", 2, "1 Ann"), ("p", 3, "more"), ("p", 4, "2 Bo")], "page string, line long, text string")
    out = [r["text"] for r in lines.continued(df, ["page"], "line", "text", F.col("text").rlike("^[0-9]")).orderBy("line").collect()]
    assert out == ["1 Ann more", "2 Bo"]


def test_registry_parses_each_document_once(spark):
    from tesserae.operators.census import Registry

    docs = spark.createDataFrame([(1, "a:x"), (2, "b:y"), (3, "c"), (4, None), (5, "a:b:z")], "id long, text string")
    registry = Registry()
    registry.add("a", F.col("text").startswith("a:"), lambda d: d.select("id", F.substring("text", 3, 9).alias("value")))
    registry.add("b", F.col("text").contains("b:"), lambda d: d.select("id", F.upper("text").alias("value")))
    assert sorted(tuple(r) for r in registry.parsed(docs).collect()) == [(1, "x", "a"), (2, "B:Y", "b"), (5, "b:z", "a")]
    assert registry.claims(docs, "id").where("claimed").count() == 4


def test_snapshot_facade(spark, tmp_path, capsys):
    from tesserae.operators import facade
    from tesserae.sources.archive import write_snapshot

    rows = [("r1", "s", "pages", "gap", "e", None, None, "2024-01-02", None, "pages/0"), ("r2", "s", "rows", "result", "e", "2024-01-01", "2024-01-05", None, "pages/0", "pages/0/rows/0"), ("r3", "t", "pages", "result", None, None, None, None, None, "pages/0")]
    names = "record_id source_name collection kind event_name date_from date_to event_date parent_path record_path".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    view = facade.SnapshotQuery(df, spark.createDataFrame([("s", "CMX")], "source_name string, label string"))
    assert [r["record_id"] for r in view.browse(low="2024-01-03").collect()] == ["r2"]
    assert {r["record_id"] for r in view.browse(label="unknown").collect()} == {"r3"} and view.browse(label="CMX", kind="gap").count() == 1
    assert {r["record_id"] for r in view.detail("r1").collect()} == {"r1", "r2"} and view.gaps().count() == 1
    assert view.facets("kind").first()["kind"] == ["gap", "result"] and view.sources().count() == 2
    write_snapshot(df, str(tmp_path / "snap"))
    facade.main([str(tmp_path / "snap"), "browse", "source_name=t"])
    assert '"record_id":"r3"' in capsys.readouterr().out


def test_decisions_fail_closed(spark):
    from tesserae.operators import decisions

    good = {"version": "v", "family": "identity", "action": "same-person", "outcome": "same-person", "probabilities": {"same-person": 0.98, "different-person": 0.02, "unknown": 0.0}, "confidence": 0.99, "evidence_adequate": True, "stale": False, "error": False, "conflicts": []}
    cases = [
        ("thresholds-met", {}), ("invalid-policy", {"version": None}), ("unsupported-action", {"action": "maybe"}), ("stale-evidence", {"stale": True}), ("provider-error", {"outcome": "error"}),
        ("unknown-answer", {"outcome": "unknown"}), ("inadequate-evidence", {"evidence_adequate": None}), ("conflicting-evidence", {"conflicts": ["x"]}), ("unexpected-answer", {"outcome": "different-person"}),
        ("invalid-answer", {"probabilities": {"same-person": 0.98, "different-person": 0.02}}), ("invalid-answer", {"probabilities": None}), ("invalid-answer", {"probabilities": {"same-person": 0.98, "different-person": 0.0201, "unknown": 0.0}}),
        ("no-canonical-role-ledger", {"family": "row-semantics", "action": "attempt", "outcome": "attempt", "probabilities": {"attempt": 1.0, "aggregate": 0.0, "summary": 0.0, "not-result": 0.0, "unknown": 0.0}}),
        ("low-confidence", {"confidence": 0.97}), ("low-probability", {"probabilities": {"same-person": 0.9, "different-person": 0.1, "unknown": 0.0}}),
    ]
    kinds = "version string, family string, action string, outcome string, probabilities map<string,double>, confidence double, evidence_adequate boolean, stale boolean, error boolean, conflicts array<string>"
    df = spark.createDataFrame([tuple((good | change).values()) for _, change in cases], kinds).coalesce(1)
    assert [r[0] for r in df.select(decisions.approval({c: F.col(c) for c in df.columns})).collect()] == [reason for reason, _ in cases]
    one = [(i, i // 3, None if i % 7 == 0 else float(i % 5), "a" if i % 2 else None) for i in range(60)]
    placed = ranking.ranked(spark.createDataFrame(one, "id long, tie long, v double, k string"), "v", "rank", ("k",), order=("tie", "id"), position="place").collect()
    for r in placed:
        group = [x for x in one if x[3] == r["k"]]
        assert r["rank"] == (None if r["v"] is None else 1 + sum(x[2] is not None and x[2] > r["v"] for x in group))
        assert r["place"] == 1 + sorted(group, key=lambda x: (x[2] is None, -(x[2] or 0), x[1], x[0])).index(next(x for x in group if x[0] == r["id"]))
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    groups = {p["p_partkey"]: p["p_partkey"] for p in parts}
    for _ in range(len(parts)):
        least = {}
        for p in parts:
            for key in (p["p_brand"] + str(p["p_size"]), "/" + p["p_name"] + p["p_type"]):
                least[key] = min(least.get(key, p["p_partkey"]), groups[p["p_partkey"]])
        after = {p["p_partkey"]: min(least[p["p_brand"] + str(p["p_size"])], least["/" + p["p_name"] + p["p_type"]]) for p in parts}
        if after == groups:
            break
        groups = after
    assert {r["node"]: r["component"] for r in registry.queries()["attempt_groups"](spark, "/root/testdata/sf0.001").collect()} == groups
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = spark.createDataFrame([(1, 7, "publisher-id", False, True), (2, 7, "name", False, True)], "id long, candidate long, route string, contradicts boolean, supported boolean")
    assert {r["id"]: r["decision"] for r in decisions.identity_decision(found, people, "id").collect()} == {1: "link", 2: "weak-route", 3: "no-candidate"}
    fresh, bad = decisions.upserted(spark.createDataFrame([("a", "1")], "k string, p string"), spark.createDataFrame([("a", "2"), ("b", "1"), ("b", "1"), ("c", "1"), ("c", "2")], "k string, p string"), ["k"], "p")
    assert [r["k"] for r in fresh.collect()] == ["b"] and {r["k"] for r in bad.collect()} == {"a", "c"}
