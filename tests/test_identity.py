"""Six routes, exclusions and the decision, against a plain statement that compares every row with every other."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import names
from tesserae.functions.names import _folded
from tesserae.operators import identity

SCHEMA = "observation_id string, source_name string, parse_status string, publisher_scope string, publisher_athlete_id string, publisher_id_kind string, aliases array<struct<name:string,origin:string>>, sex string"


def key(name):
    words = (_folded(name) or "").split() if name is not None else []
    return " ".join(sorted(words)) or None


def person(r):
    return (r[3], r[4]) if r[5] == "person" and (r[3] or "").strip() and (r[4] or "").strip() else None


def listed(r, *origins):
    known = [("native", r[1])] + [(o, n) for n, o in r[6] or [] if o in identity.ROUTES and o != "native"]
    return {(o, k) for o, n in known if (k := key(n)) and (not origins or o in origins)}


def keys(r, *origins):
    return {k for _, k in listed(r, *origins)}


def retrieve(rows, target):
    usable = [r for r in rows if r[2] == "parsed"]
    bridge = {}
    for r in usable:
        for alias in keys(r, "publisher", "accepted"):
            for own in keys(r, "native"):
                bridge.setdefault(alias, set()).add(own)
                bridge.setdefault(own, set()).add(alias)
    asked = keys(target)
    bridged = set().union(*(bridge.get(k, set()) for k in asked)) - asked
    found = {}
    for r in usable:
        routes = {identity.ROUTES[o] for o, k in listed(r) if k in asked}
        if person(target) and person(target) == person(r):
            routes.add("publisher-id")
        if keys(r, "native") & bridged:
            routes.add("romanization")
        if routes and r[0] != target[0]:
            found[r[0]] = routes
    bad = [r for r in rows if r[2] != "parsed" and r[0] != target[0]]
    omitted = [r for r in bad if not keys(r) or keys(r) & asked or person(target) and person(target) == person(r)]
    return found, len(omitted), len(bad) - len(omitted)


def decide(rows, target, ambiguous):
    by_id = {r[0]: r for r in rows}
    found, omitted, excluded = retrieve(rows, target)

    def agrees(r):
        a, b = person(target), person(r)
        return not (a and b and a[0] == b[0] and a != b) and not (target[7] and r[7] and target[7] != r[7])

    plausible = [i for i in found if agrees(by_id[i])]
    exact = [i for i in plausible if keys(target, "native", "publisher", "accepted") & keys(by_id[i], "native", "publisher", "accepted")]
    ids = [i for i in plausible if "publisher-id" in found[i]]
    winner = ids[0] if len(ids) == 1 else exact[0] if len(exact) == 1 else None
    own = _folded(target[1]) if target[1] else ""
    reason = (
        "damaged-reading" if target[2] != "parsed" else "missing-name" if not own else "unsupported-possible-candidate" if omitted else "verified-publisher-id" if len(ids) == 1
        else "configured-ambiguous-name" if own in ambiguous else "insufficient-name" if len(own.split()) < 2 else "competing-candidates" if len(plausible) > 1
        else "no-distinctive-exact-match" if winner is None else "distinctive-exact-name"
    )
    linked = reason in identity.LINKS
    return (target[0], "approve" if linked else "unresolved", reason, winner if linked else None, len(found), omitted, excluded)


def invented(seed, nameless):
    rng = random.Random(seed)
    words = ["Ana", "Bo", "Čeh", "Dörr", "Eš", "Fox", "Gil", "Häß"]
    name = lambda: " ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3])))
    rows = []
    for i in range(70):
        aliases = [(name(), rng.choice(["publisher", "accepted", "generated", "other"])) for _ in range(rng.choice([0, 0, 0, 1, 2]))] + ([(None, "publisher")] if rng.random() < 0.1 else [])
        rows.append((
            f"r{i:02}", rng.choice([name(), name(), name(), name(), None, "12"]), rng.choices(["parsed", "damaged", None], [20, 1, 1])[0], rng.choice(["A", "B", " ", None]),
            rng.choice([None, None, "1", "2", "3", "4", "5"]), rng.choice(["person", "listing", None]), rng.choice([aliases, aliases, None]), rng.choice([None, None, "w", "m"]),
        ))
    if not nameless:
        rows = [r if r[2] == "parsed" or keys(r) else (*r[:1], "Lone Damage", *r[2:]) for r in rows]
    return rows + [("s1", "Ana Bo", "parsed", None, None, None, None, None), ("s2", "bo ÁNA", "parsed", None, None, None, None, None), ("s3", "Ana Bo", "parsed", None, None, None, [], None)]


@pytest.mark.parametrize("seed,nameless", [(1, True), (2, False), (3, False)])
def test_decisions_equal_brute_force(spark, seed, nameless):
    rows = invented(seed, nameless)
    people = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, identity.decided(people, ("ana fox",)).collect())) == sorted(decide(rows, r, ("ana fox",)) for r in rows)


def test_routes_equal_brute_force_and_name_all_six(spark):
    rows = invented(5, False)
    members, kinds = identity.classes(spark.createDataFrame(rows, SCHEMA))
    of = {r["id"]: r["class"] for r in members.collect()}
    found = {(r["asked"], r["found"]): set(r["routes"]) for r in identity.retrieved(kinds).collect()}
    wanted = {}
    for r in rows:
        for i, routes in retrieve(rows, r)[0].items():
            assert wanted.setdefault((of[r[0]], of[i]), routes) == routes  # members of a class are alike
    assert found == wanted
    assert set().union(*found.values()) == {"publisher-id", "native-name", "publisher-alias", "accepted-alias", "generated-transliteration", "romanization"}


def test_copies_of_a_name_are_one_class(spark):
    """2,000 rows of one name give one pair of classes, not four million pairs of rows."""
    rows = spark.range(2000).select(
        F.concat(F.lit("r"), "id").alias("observation_id"), F.lit("Ana Fox").alias("source_name"), F.lit("parsed").alias("parse_status"), *(F.lit(None).cast("string").alias(c) for c in ("publisher_scope", "publisher_athlete_id", "publisher_id_kind", "sex")),
        F.lit(None).cast("array<struct<name:string,origin:string>>").alias("aliases"),
    )
    assert identity.retrieved(identity.classes(rows)[1]).count() == 1
    assert [tuple(r) for r in identity.decided(rows).select("reason", "candidates").distinct().collect()] == [("competing-candidates", 1999)]


def test_spellings(spark):
    df = spark.createDataFrame([("Jörg", "Weiß"), ("Ann", ""), (None, "Łuk")], "a string, b string")
    out = df.select(names.transliterations(F.col("a")).alias("t"), names.combinations(F.col("a"), F.col("b"), F.concat_ws(" ", "a", "b")).alias("c")).collect()
    assert [(sorted(r["t"]), r["c"]) for r in out] == [(["joerg"], ["jorgwei", "weijorg"]), ([], []), ([], [])]
    empty = spark.createDataFrame([], SCHEMA)
    assert identity.decided(empty).count() == 0
