"""Versioned tables, memoised derivations and projections that are kept up to date."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import sporting
from tesserae.sources import derived, versions


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, f"file://{tmp_path}/store")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_a_reader_keeps_its_version_while_writers_go_on(spark, store):
    empty = store.pin()
    assert empty.number == 0 and empty.rows("a") == 0
    one = store.commit(empty, append={"a": spark.range(3), "b": spark.range(1)})
    two = store.commit(one, append={"a": spark.range(3, 5)}, properties={"k": 1})
    three = store.commit(two, replace={"a": spark.range(9, 10)})
    assert [ids(p.table("a")) for p in (one, two, three)] == [[0, 1, 2], [0, 1, 2, 3, 4], [9]]
    assert (store.pin().number, store.pin().properties, store.pin(1).rows("a"), two.rows("a")) == (3, {"k": 1}, 3, 5)
    assert ids(three.table("b")) == [0]
    with pytest.raises(versions.Conflict):
        store.commit(two, append={"a": spark.range(1)})
    with pytest.raises(versions.Conflict):  # also where both saw the same newest commit
        store._publish(3, "{}")
    with pytest.raises(ValueError):
        store.commit(three, append={"a": spark.range(1).withColumn("x", F.lit(1))})
    assert store.pin().number == 3
    assert store.clean() > 0 and ids(store.pin().table("a")) == [9] and ids(store.pin().table("b")) == [0]


def test_corpus_loads_whole_or_not_at_all(spark, store):
    extractions = spark.createDataFrame([("j1", "s1"), ("j2", "s2")], "job_id string, source string")
    observations = spark.createDataFrame([("j1", 0), ("j1", 1), ("j2", 0)], "job_id string, ordinal int")
    pinned = store.commit(store.pin(), append={"extractions": extractions, "observations": observations})
    store.commit(pinned, append={"observations": observations.limit(1)})
    assert sorted(map(tuple, versions.corpus(pinned, 3).collect())) == [("j1", "s1", 0), ("j1", "s1", 1), ("j2", "s2", 0)]
    with pytest.raises(versions.TooMany):
        versions.corpus(pinned, 2)
    with pytest.raises(ValueError):
        versions.corpus(store.pin(), 10)


def test_derivations_are_computed_once(spark, store):
    asked = spark.sparkContext.accumulator(0)

    def produce(jobs):
        def each(batches):
            for b in batches:
                asked.add(len(b))
                b["value"] = b["text"].map(lambda t: None if t is None else t.upper())
                b["error"] = b["text"].map(lambda t: "too short" if t is not None and len(t) < 2 else None)
                yield b[["job", "value", "error"]]

        return jobs.mapInPandas(each, "job string, value string, error string")

    rows = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "x"), (4, None), (5, "")], "id int, text string")
    here, out = derived.derive(store, rows, ["text"], "p/1", "s/1", produce)
    got = {r["id"]: (r["status"], r["value"], r["error"]) for r in out.collect()}
    assert got == {1: ("committed", "AB", None), 2: ("committed", "AB", None), 3: ("failed", None, "too short"), 4: ("failed", None, "no-value"), 5: ("failed", None, "too short")}
    assert asked.value == 4 and here.rows("receipts") == 4
    again, out = derived.derive(store, rows.unionByName(spark.createDataFrame([(6, "new")], rows.schema)), ["text"], "p/1", "s/1", produce)
    assert asked.value == 5 and {r["id"]: r["value"] for r in out.collect()}[6] == "NEW"  # failures are not tried again
    same, _ = derived.derive(store, rows, ["text"], "p/1", "s/1", produce)
    assert asked.value == 5 and same.number == again.number
    derived.derive(store, rows, ["text"], "p/2", "s/1", produce)
    assert asked.value == 9 and derived.verified(store.pin()).count() == 0
    kept = derived.forgotten(store, ["p/2"])
    assert kept.rows("receipts") == 4 and store.clean() == 3
    twice = lambda jobs: jobs.select("job", F.lit("v").alias("value"), F.lit(None).cast("string").alias("error")).unionAll(jobs.select("job", F.lit("w"), F.lit(None).cast("string")))
    assert {r["error"] for r in derived.derive(store, rows, ["id"], "p/3", "s", twice)[1].collect()} == {"several-results"}
    assert {r["error"] for r in derived.derive(store, rows, ["id"], "p/4", "s", lambda jobs: twice(jobs).limit(0))[1].collect()} == {"no-result"}


def test_flow_takes_in_what_is_new(spark, store):
    from tesserae.sources import flow
    from tesserae.sources.layouts import EXAMPLES
    from tests.test_grid import PAGES

    heard = []
    texts = lambda pages: spark.createDataFrame([(t,) for _, t in pages], "text string")
    run = lambda pages, parser="v1": flow.flow(store, texts(pages), EXAMPLES, parser, lambda stage, n: heard.append((stage, n)))
    first = run(PAGES[:3] * 2)
    assert heard == [("archive", 3), ("extraction", 3), ("ingestion", 3), ("readiness", 3)]
    again = run(PAGES[:3])
    assert again.number == first.number and heard[4:] == [(s, 0) for s in flow.STAGES]
    last = run(PAGES)
    assert [n for _, n in heard[8:]] == [3, 3, 0, 3]  # documents that no layout reads have no observations
    ready = last.table("readiness")
    assert ready.count() == 6 and {r["coverage"] for r in ready.collect()} == {"complete", "partial", "unsupported", "ambiguous", "needs-ocr"} - ({"complete"} if not ready.where("coverage = 'complete'").count() else set())
    seen = last.table("observations")
    assert seen.groupBy("job_id").agg(F.max("ordinal").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").isEmpty()
    assert seen.count() == ready.agg(F.sum(F.col("rows") + F.col("unparsed"))).first()[0]
    # a run that is lost after extraction goes on from there; another parser reads all objects again
    other = run(PAGES, "v2")
    assert other.table("readiness").count() == 12 and other.rows("objects") == 6


DECISIONS = "result_id string, revision long, action string, score int"


def projected(ledgers):
    newest = ledgers["decisions"].groupBy("result_id").agg(F.max_by(F.struct("action", "score"), "revision").alias("d"))
    notes = ledgers["reviews"].groupBy("result_id").agg(F.count("*").alias("reviews"))
    floor = ledgers["policies"].agg(F.max_by("least", "revision").alias("least"))
    return newest.join(notes, "result_id", "left").crossJoin(floor).where("d.action = 'publish' and d.score >= least").select("result_id", "d.score", F.coalesce("reviews", F.lit(0)).alias("reviews"))


def test_incremental_projection_equals_a_full_one(spark, store):
    rng = random.Random(2)
    ledgers = {"decisions": [], "reviews": [], "policies": [(1, 10)]}
    schemas = {"decisions": DECISIONS, "reviews": "result_id string, revision long", "policies": "revision long, least int"}
    frames = lambda: {n: spark.createDataFrame(rows, schemas[n]) for n, rows in ledgers.items()}
    view = sporting.Projection(store, "view", "result_id", ("decisions", "reviews"), projected, buckets=16)
    revision = 1
    for batch in range(6):
        for _ in range([40, 0, 2, 1, 5, 3][batch]):
            revision += 1
            kind = rng.random()
            key = f"r{rng.randrange(60)}" if rng.random() < 0.95 else None
            ledgers["decisions" if kind < 0.7 else "reviews"].append((key, revision, rng.choice(["publish", "publish", "withdraw"]), rng.randrange(30)) if kind < 0.7 else (key, revision))
        if batch == 4:
            revision += 1
            ledgers["policies"].append((revision, 20))
        now = frames()
        assert view.fresh(now) == (batch == 1)
        done = view.refresh(now)
        assert sorted(map(tuple, view.rows().collect())) == sorted(map(tuple, projected(now).where("result_id is not null").collect()))
        written = done.properties["view.written"]
        assert written == (16 if batch in (0, 4) else 0 if batch == 1 else written) and (batch not in (2, 3) or written <= 2)
        assert view.fresh(now)


def test_public_results_need_everything_current(spark):
    place = ("j", 0)
    decisions = [("d1", *place, 1, "validate", "extraction-publication/1", 0), ("d2", *place, 2, "validate", "extraction-publication/2", 3), ("d3", "k", 0, 3, "revoke", "extraction-publication/2", 0), ("d4", "m", 0, 4, "validate", "extraction-publication/2", 0), ("d5", "n", 0, 5, "validate", "own", 0)]
    d = spark.createDataFrame(decisions, "id string, job_id string, ordinal int, revision long, action string, policy_version string, review_revision long")
    reviews = spark.createDataFrame([(*place, 3), ("m", 0, 9)], "job_id string, ordinal int, revision long")
    policies = spark.createDataFrame([(1, "extraction-publication/1"), (2, "extraction-publication/2")], "revision long, policy_version string")
    token = sporting.freshness({"decisions": d, "reviews": reviews})
    now = token.first()["token"]
    cache = [(f"r{i}", "n", "p", "b", v, pol, t) for i, (v, pol, t) in enumerate([("d1", "extraction-publication/1", now), ("d2", "extraction-publication/2", now), ("d2", "extraction-publication/2", "old"), ("d3", "extraction-publication/2", now), ("d4", "extraction-publication/2", now), ("d5", "own", now), ("d2", "extraction-publication/1", now)])]
    c = spark.createDataFrame(cache, "result_id string, source_name string, identity_id string, body string, validation_id string, policy_version string, token string")
    assert ids(sporting.public_results(c, d, reviews, policies, token), "result_id") == ["r1"]
    more = sporting.freshness({"decisions": d, "reviews": reviews.unionByName(reviews.limit(1))})
    assert more.first()["token"] != now
    assert sporting.public_results(c, d, reviews, policies.where("revision = 1"), token).count() == 0


def test_cohorts_are_shown_whole_and_current_only(spark):
    token = spark.createDataFrame([("t",)], "token string")
    events = [("c1", 1, "publish", "v1", 2, 5, "t", 2), ("c2", 2, "publish", "v1", 2, 5, "t", 2), ("c3", 3, "publish", "v1", 2, 5, "old", 0), ("c4", 4, "publish", "v1", 2, 5, "t", 1), ("c4", 5, "withdraw", "v1", 2, 5, "t", 1), ("c5", 6, "publish", "v1", 1, 5, "t", 1)]
    e = spark.createDataFrame(events, "cohort_id string, revision long, action string, policy_version string, policy_revision long, publication_revision long, token string, expected_members int")
    members = spark.createDataFrame([(1, "r1", "b1"), (1, "r2", "b2"), (2, "r1", "b1"), (2, "r2", "changed"), (4, "r1", "b1"), (6, "r1", "b1")], "revision long, result_id string, source_body string")
    results = spark.createDataFrame([("r1", "b1"), ("r2", "b2")], "result_id string, body string")
    ledger = lambda n: spark.createDataFrame([(n,)], "revision long")
    out = sporting.sporting_view(e, members, results, ledger(2), ledger(5), token, "v1")
    assert sorted(map(tuple, out.collect())) == [("c1", 1, "r1", "b1"), ("c1", 1, "r2", "b2")]


def test_ranks_in_three_scopes(spark):
    rng = random.Random(6)
    rows = [(f"c{rng.randrange(2)}", f"r{i}", rng.choice([None, 1.0, 2.0, 3.0, 4.5]), rng.choice(["IT", "FR", "JP", None]), None) for i in range(60)]
    rows = [(c, r, s, k, {"IT": "EU", "FR": "EU", "JP": "AS"}.get(k)) for c, r, s, k, _ in rows] + [("c9", "alone", None, "IT", "EU")]
    frame = spark.createDataFrame(rows, "cohort_id string, result_id string, score double, country string, continent string")
    for r in sporting.sporting_ranks(frame).collect():
        for scope, place in (("national", r["country"]), ("continental", r["continent"]), ("international", "*")):
            peers = [x for x in rows if x[0] == r["cohort_id"] and x[2] is not None and (scope == "international" or x[3 if scope == "national" else 4] == place)]
            assert r[f"{scope}_peers"] == (None if place is None else len(peers))
            assert r[f"{scope}_rank"] == (None if place is None or r["score"] is None else 1 + sum(x[2] > r["score"] for x in peers))
        assert r["status"] == ("withheld" if r["score"] is None else "ranked")
