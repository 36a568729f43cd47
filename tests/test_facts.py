"""Fixtures of fact rules, record kinds, eligibility reasons, rosters and bound evidence."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import facts, scalars
from tesserae.operators import eligibility, evidence, records, roster

SHA = "a" * 64
GOOD = {
    "job_id": "j", "ordinal": 0, "candidate_id": "c", "source_sha256": SHA, "artifact_sha256": SHA, "federation": "AIDA", "view_id": "2026-06-03", "view_selected": True, "environment": "pool",
    "authority": "official-results", "finality": "verified-final", "sanction": "eligible", "parsed_federation": "AIDA", "event_date": "2026-06-03", "discipline": "DNF", "category": None, "gender": "Women",
    "representation": "FRA", "parse_status": "parsed", "source_family": "attempts", "source_status": None, "review": "verified", "outcome": "finally-valid", "relationship": "distinct",
    "conflict_resolved": True, "final_value": "71.5", "final_unit": "m", "final_basis": "verified-post-penalty", "final_places": 1, "conversion": "verified",
}
SCHEMA = ", ".join(f"{k} {'int' if k in ('ordinal', 'final_places') else 'boolean' if k in ('view_selected', 'conflict_resolved') else 'string'}" for k in GOOD)
SCOPE = eligibility.Scope(
    2026, "DNF", "pool", ("CMAS", "AIDA"), ("FRA",), {"CMAS": ("category", "SENIORS [–—-] WOMEN"), "AIDA": ("gender", "Women")}, {"CMAS": "2026-06-11"}, ("AIDA",), {"AIDA": "attempts"}
)
BROKEN = {
    "missing-exact-reference": {"job_id": "  "}, "unselected-source-view": {"view_selected": None}, "source-context-conflict": {"view_id": "other"}, "federation-filter": {"federation": "X", "parsed_federation": "X"},
    "environment-filter": {"environment": "sea"}, "discipline-filter": {"discipline": None}, "year-filter": {"event_date": "2026-02-30", "view_id": "2026-02-30"}, "category-filter": {"gender": "Men"},
    "representation-filter": {"representation": None}, "unparsed": {"parse_status": "unparsed"}, "not-attempt-view": {"source_family": None}, "unverified-source-authority": {"authority": None},
    "unverified-source-finality": {"finality": "provisional"}, "unverified-sanction": {"sanction": None}, "unverified-review": {"review": None}, "unverified-outcome": {"outcome": "disqualified"},
    "unresolved-attempt-relationship": {"relationship": None}, "unverified-final-distance": {"final_unit": "ft"}, "unverified-final-precision": {"final_value": "71.55"},
    "unverified-final-conversion": {"conversion": None}, "source-status-conflict": {"source_status": "DQ"}, "source-conflict": {"conflict_resolved": None},
}


def _attempts(spark, rows):
    return spark.createDataFrame([tuple((GOOD | r).values()) for r in rows], SCHEMA).withColumn("final_value", F.col("final_value").cast("decimal(12,2)"))


def test_each_reason_of_eligibility_stands_alone(spark):
    rows = [{"candidate_id": "good"}, *({"candidate_id": name} | change for name, change in BROKEN.items())]
    found = {r.candidate_id: r for r in eligibility.attempt_accounts(_attempts(spark, rows), SCOPE, ["candidate_id"]).collect()}
    assert (found["good"].status, found["good"].reasons) == ("ranked", [])
    for name in BROKEN:
        also = ["category-filter"] if name == "federation-filter" else []
        assert found[name].reasons == [name, *also], name
        assert found[name].status == ("excluded" if name in eligibility.FILTERS else "withheld")


def test_repeated_and_unselected_references_are_withheld(spark):
    rows = _attempts(spark, [{"candidate_id": c} for c in "aabc"])
    claims = spark.createDataFrame([("b",), ("b",)], "candidate_id string")
    found = sorted((r.candidate_id, *r.reasons) for r in eligibility.attempt_accounts(rows, SCOPE, ["candidate_id"], claims).collect())
    assert found == [("a", "duplicate-reference"), ("a", "duplicate-reference"), ("b", "non-selected-source-claim"), ("c",)]
    assert eligibility.attempt_accounts(rows.limit(0), SCOPE, ["candidate_id"]).count() == 0


@pytest.mark.parametrize(
    ("collection", "obj", "parent", "schema", "kind"),
    [
        ("RESULT_ROWS", {"kind": "aggregate"}, None, None, "candidate_position"),
        ("positions", {"kind": "aggregate"}, None, None, "aggregate"),
        ("positions", {}, {"role": "aggregate_standings"}, None, "aggregate"),
        ("pages.rows", {"disposition": "duplicate_render"}, {"page_kind": "aggregate"}, None, "repeated_position"),
        ("pages.rows", {}, {"page_kind": "aggregate"}, None, "aggregate"),
        ("observation_versions", {}, None, records.SUPPLEMENT, "observation_version"),
        ("observation_versions", {}, None, None, "candidate_position"),
        ("events", {"kind": "formula_placeholder"}, None, None, "other"),
        ("candidate_gaps", {}, None, None, "gap"),
        ("events", {}, None, None, "event"),
        ("anything", None, None, None, "other"),
    ],
)
def test_kinds_of_records(spark, collection, obj, parent, schema, kind):
    text = [None if x is None else json.dumps(x) for x in (obj, parent)]
    row = spark.createDataFrame([(collection, *text, schema)], "c string, o string, p string, s string")
    assert row.select(records.kind(F.col("c"), F.parse_json("o"), F.parse_json("p"), F.col("s"))).first()[0] == kind


def test_normalised_columns_take_the_first_place_with_a_value(spark):
    rows = [
        ({"id": "1", "date_from": "2026-01-01", "date_scope": ["a", "b"], "session": {"b": 1, "a": 2}, "raw_fields": {}, "cells": {"Discipline": {"value": "DNF"}}}, {"source": {"sha256": SHA}}, {}, "other"),
        ({"sha256": SHA, "citation": {"page": 4}}, {}, {"source": {"acquisition_id": "q"}, "owner_review_status": "done"}, "source"),
        ({"daily": {"x": 1}, "ranking": {"y": 2}, "name": "n"}, {}, {"source_sha256": SHA, "event_title_calendar": "t"}, "relationship"),
        ({}, {}, {}, "candidate_position"),
        ({"parsed_fields": {"b": {"value": [1, {"z": 1, "a": 2}]}, "a": {"raw": "x"}, "c\"": 3, "d": {"value": None}}}, {}, {}, "other"),
        ({"parsed_fields": {"b": {"raw": 1}, "a": 2.5}}, {}, {}, "other"),
        ({"parsed_fields": [1]}, {}, {}, "other"),
    ]
    df = spark.createDataFrame([(*map(json.dumps, r[:3]), r[3]) for r in rows], "obj string, parent string, root string, kind string")
    df = df.select(*(F.parse_json(c).alias(c) for c in ("obj", "parent", "root")), "kind")
    a, b, c, d, *parsed = records.normalized(df).collect()
    assert [p.parsed_fields_json for p in parsed] == ['{"a":null,"b":[1,{"a":2,"z":1}],"c\\"":3,"d":null}', '{"a":2.5,"b":{"raw":1}}', "{}"]
    assert (a.date_from, a.date_to, a.event_date, a.date_scope_json) == ("2026-01-01", "b", None, '["a","b"]')
    assert (a.source_object_id, a.discipline, json.loads(a.session), a.raw_fields_json) == ("sha256:" + SHA, "DNF", {"a": 2, "b": 1}, '{"Discipline":{"value":"DNF"}}')
    assert (b.source_object_id, b.acquisition_id, b.page, b.citation_json, b.review_status) == ("sha256:" + SHA, "q", 4, '{"page":4}', "done")
    assert (c.citation_json, c.event_name, c.source_object_id) == ('{"daily":{"x":1},"field_correspondences":null,"ranking":{"y":2}}', "t", "sha256:" + SHA)
    assert (d.review_status, d.source_object_id, d.raw_fields_json, d.parsed_fields_json) == ("unreviewed", None, "{}", "{}")


def test_json_differences(spark):
    pairs = [({"a": {"x": 1, "y": 2}, "c": [1]}, {"a": {"x": 1.0}, "b": None, "c": [1]}), (1, True), ({"a": {}}, {"a": []}), ({}, {})]
    df = spark.createDataFrame([(i, json.dumps(x), json.dumps(y)) for i, (x, y) in enumerate(pairs)] + [(4, None, "{}")], "i int, a string, b string")
    found = {r.i: r.d and [tuple(x) for x in r.d] for r in df.select("i", facts.json_differences("a", "b").alias("d")).collect()}
    assert found[0] == [("a.x", True, True, "1", "1.0"), ("a.y", True, False, "2", None), ("b", False, True, None, "null")]
    assert found[1] == [("", True, True, "1", "true")] and found[2] == [("a", True, True, "{}", "[]")]
    assert found[3] == [] and found[4] is None


def test_small_facts(spark):
    df = spark.createDataFrame([("José  Núñez-2", "<b>a &amp;lt;</b> ", "-7 m", "1e2"), ("", "", "7.0", "x"), (None, None, None, None)], "n string, h string, m string, w string")
    got = df.select(facts.label_words("n"), facts.cell_text(F.col("h")), facts.integer_with_unit(F.col("m"), "m"), facts.cell_number(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(["2", "jose", "nunez"], "a &lt;", -7, (None, 100.0)), ([], "", None, (None, None)), (None, None, None, (None, None))]
    places = spark.sql("select cast(v as decimal(10,3)) as v, p from values ('1.500', 1), ('1.501', 2), ('2', 0), ('0.01', 2) t(v, p)")
    assert [r[0] for r in places.select(scalars.has_places(F.col("v"), F.col("p"))).collect()] == [True, False, True, True]


def test_roster_checks_and_filters(spark):
    routes = spark.createDataFrame([("r1", "open"), ("r1", "done"), ("r2", "open")], "id string, status string")
    leads = spark.createDataFrame([("l1", "r1", "open", 2026, None, None), ("l2", "r9", "open", None, "2026-01-01", "e"), ("l2", "r2", "done", None, None, "e")], "id string, route_id string, status string, competition_year int, competition_date string, event_key string")
    assert sorted(map(tuple, roster.roster_problems(routes, leads).collect())) == [("repeated-lead", "l2"), ("repeated-route", "r1"), ("unknown-route", "l2")]
    assert [r.id for r in roster.filtered_leads(leads, year="unknown", status="open").collect()] == ["l2"]
    assert [r.route_id for r in leads.orderBy(*roster.lead_order()).collect()] == ["r1", "r2", "r9"]
    names = spark.createDataFrame([("roster-v2",), ("roster-v10",), ("roster-vx",), (None,)], "source string")
    assert [r.source for r in roster.newest_roster(names, "source", "roster-v").collect()] == ["roster-v10"]
    assert roster.newest_roster(names.limit(0), "source", "roster-v").count() == 0


def test_bound_evidence_fails_closed(spark):
    cited = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None), (6, "z")], "citation int, k string")
    known = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21), ("c", 30), (None, 50)], "k string, record int")
    found = {r.citation: (r.problem, r.record) for r in evidence.bound_evidence(cited, known, ["k"], "citation", "record").collect()}
    assert found == {1: (None, 10), 2: ("ambiguous", None), 3: ("reused", None), 4: ("reused", None), 5: (None, 50), 6: ("missing", None)}


def test_view_census_of_equal_versions_is_empty(spark):
    rows = spark.createDataFrame([("a", 1, "parsed"), ("a", 1, "parsed"), ("b", 2, "parsed")], "k string, v int, parse_status string")
    assert evidence.view_census(rows, 3, rows, rows, ["k"], ["v"]).count() == 0
    problems = evidence.view_census(rows, 4, rows, rows.distinct(), ["k"], ["v"]).collect()
    assert sorted((r.problem, r.rows) for r in problems) == [("unexpected-count", 3), ("versions-differ", 1)]
