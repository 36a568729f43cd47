"""Retrieval of people over six routes of an inverted index, and the decision whether a row links to one of them.

Rows that nothing tells apart (same names, aliases, person id, sex and status) form a class. The index, retrieval and decision work on
classes; members are numbers beside them, so copies of a name are one posting and are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.names import folded_each, token_order, transliterations
from tesserae.functions.reasons import first_reason
from tesserae.sources.stored import stored

#: Origin of a name to the route of its postings.
ROUTES = {"native": "native-name", "publisher": "publisher-alias", "accepted": "accepted-alias", "generated": "generated-transliteration"}
#: Names that are too common to link by, folded.
AMBIGUOUS = ("amy smith", "john smith", "maria silva")
LINKS = ("verified-publisher-id", "distinctive-exact-name")


def with_generated(rows: DataFrame) -> DataFrame:
    """``rows`` with the transliterations of source_name among their aliases, origin ``generated``."""
    made = F.transform(transliterations(F.col("source_name")), lambda n: F.struct(n.alias("name"), F.lit("generated").alias("origin")))
    return rows.withColumn("aliases", F.concat(F.coalesce("aliases", F.array().cast("array<struct<name:string,origin:string>>")), made))


def described(rows: DataFrame) -> DataFrame:
    """(id, usable, folded, names, person, sex) of rows (observation_id, source_name, parse_status, publisher_scope,
    publisher_athlete_id, publisher_id_kind, aliases (name, origin), sex).

    ``names`` has (origin, key) of the source name and of aliases with a known origin, keys being words in order; names
    without letters have none. ``person`` is (scope, id) of verified person ids.
    """
    known = F.filter(F.coalesce("aliases", F.array().cast("array<struct<name:string,origin:string>>")), lambda a: a["origin"].isin("publisher", "accepted", "generated"))
    listed = F.concat(F.array(F.struct(F.col("source_name").alias("name"), F.lit("native").alias("origin"))), known)
    out = rows.select("*", listed.alias("__listed")).withColumn("__folded", folded_each(F.transform("__listed", lambda a: a["name"])))
    pair = F.zip_with("__listed", "__folded", lambda a, f: F.struct(a["origin"].alias("origin"), token_order(f).alias("key")))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    person = F.when((F.col("publisher_id_kind") == "person") & filled("publisher_scope") & filled("publisher_athlete_id"), F.struct(F.col("publisher_scope").alias("scope"), F.col("publisher_athlete_id").alias("id")))
    return out.select(
        F.col("observation_id").alias("id"), F.coalesce(F.col("parse_status") == "parsed", F.lit(False)).alias("usable"), F.nullif(F.col("__folded")[0], F.lit("")).alias("folded"),
        F.array_sort(F.array_distinct(F.filter(pair, lambda n: n["key"] != ""))).alias("names"), person.alias("person"), "sex",
    )


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (id, class) of each row, and each class once with its smallest and greatest id and its size."""
    signed = stored(described(rows).withColumn("signature", F.sha2(F.to_json(F.struct("usable", "folded", "names", "person", "sex")), 256)), "people")
    once = signed.groupBy("signature").agg(
        F.min("id").alias("class"), F.max("id").alias("last"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("usable", "folded", "names", "person", "sex"))
    )
    once = stored(once, "classes")
    return signed.select("id", "signature").join(once.select("signature", "class"), "signature").select("id", "class"), once.drop("signature")


def _keys(names: Column, *origins: str) -> Column:
    chosen = F.filter(names, lambda n: n["origin"].isin(*origins)) if origins else names
    return F.array_distinct(F.transform(chosen, lambda n: n["key"]))


def _person_key(person: Column) -> Column:
    return F.concat_ws("\x1f", person["scope"], person["id"])


def postings(kinds: DataFrame) -> DataFrame:
    """(route, key, class) of all usable classes."""
    usable = kinds.where("usable")
    by_name = usable.select(F.explode("names").alias("name"), "class")
    route = F.element_at(F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair)), F.col("name.origin"))
    by_id = usable.where("person is not null").select(F.lit("publisher-id").alias("route"), _person_key(F.col("person")).alias("key"), "class")
    return by_name.select(route.alias("route"), F.col("name.key").alias("key"), "class").unionByName(by_id)


def bridge(kinds: DataFrame) -> DataFrame:
    """(key, other): names that published or accepted aliases of usable classes equate, both ways."""
    said = kinds.where("usable").select(F.explode(_keys(F.col("names"), "publisher", "accepted")).alias("key"), F.explode(_keys(F.col("names"), "native")).alias("other"))
    return said.unionByName(said.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct()


def retrieved(kinds: DataFrame) -> DataFrame:
    """(asked, found, routes): classes that the index holds for the names and person id of each class, with the sorted
    routes. Romanization leads over one name that aliases equate with an own one, and is not an own one itself.

    A class finds itself where it has two members or more.
    """
    index = postings(kinds)
    own = kinds.select(F.col("class").alias("asked"), F.explode(_keys(F.col("names"))).alias("key")).distinct()
    direct = own.select("asked", F.explode(F.array(*map(F.lit, ROUTES.values()))).alias("route"), "key").withColumn("through", F.col("route"))
    person = kinds.where("person is not null").select(F.col("class").alias("asked"), F.lit("publisher-id").alias("route"), _person_key(F.col("person")).alias("key"), F.lit("publisher-id").alias("through"))
    hops = own.join(bridge(kinds), "key").select("asked", F.col("other").alias("key")).distinct().join(own, ["asked", "key"], "left_anti")
    over = hops.select("asked", F.lit("native-name").alias("route"), "key", F.lit("romanization").alias("through"))
    hits = direct.unionByName(person).unionByName(over).join(index.withColumnRenamed("class", "found"), ["route", "key"])
    lone = kinds.where("n = 1").select(F.col("class").alias("asked"), F.col("class").alias("found"))
    return hits.groupBy("asked", "found").agg(F.array_sort(F.collect_set("through")).alias("routes")).join(lone, ["asked", "found"], "left_anti")


def unsupported(kinds: DataFrame) -> DataFrame:
    """(class, omitted, excluded) as numbers of rows: unusable rows that may be one's person (they share a name or person id, or
    have no name), and the other unusable rows. A row itself counts in neither."""
    bad = kinds.where("not usable")
    total = bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.size("names") == 0, F.col("n"))), F.lit(0)).alias("nameless"))
    marks = lambda df: df.select("class", F.explode(F.concat(F.transform(_keys(F.col("names")), lambda k: F.concat(F.lit("name "), k)), F.when(F.col("person").isNotNull(), F.array(F.concat(F.lit("id "), _person_key(F.col("person"))))).otherwise(F.array().cast("array<string>")))).alias("mark"))
    named = bad.where(F.size("names") > 0)
    met = marks(kinds).join(marks(named).withColumnRenamed("class", "bad"), "mark").select("class", "bad").distinct()
    near = met.join(named.select(F.col("class").alias("bad"), "n"), "bad").groupBy("class").agg(F.sum("n").alias("near"))
    itself = F.when(F.col("usable"), 0).otherwise(1)
    out = kinds.select("class", "usable").join(near, "class", "left").join(F.broadcast(total))  # one row
    omitted = F.coalesce("near", F.lit(0)) + F.col("nameless") - itself
    return out.select("class", omitted.alias("omitted"), (F.col("total") - itself - omitted).alias("excluded"))


def decided(rows: DataFrame, ambiguous: tuple[str, ...] = AMBIGUOUS) -> DataFrame:
    """(id, status, reason, candidate_id, candidates, omitted, excluded) for each row: the first reason that holds of ten.

    ``approve`` needs one candidate of the same verified person id, or one candidate in all, under an exact name of
    two words or more that is not in ``ambiguous``; everything else stays ``unresolved``, however likely. Candidates that
    contradict (another person id of the same publisher, another sex) do not compete.
    """
    members, kinds = classes(rows)
    exact = lambda c: _keys(F.col(c), "native", "publisher", "accepted")
    facts = lambda side: kinds.select(F.col("class").alias(side), F.col("n").alias(f"{side}_n"), F.col("names").alias(f"{side}_names"), F.col("person").alias(f"{side}_person"), F.col("sex").alias(f"{side}_sex"))
    pairs = retrieved(kinds).join(facts("asked"), "asked").join(facts("found"), "found")
    clash = F.coalesce((F.col("asked_person.scope") == F.col("found_person.scope")) & (F.col("asked_person.id") != F.col("found_person.id")), F.lit(False)) | F.coalesce(F.col("asked_sex") != F.col("found_sex"), F.lit(False))
    same = F.col("asked") == F.col("found")
    n = F.col("found_n") - F.when(same, 1).otherwise(0)
    by_id, by_name = ~clash & F.array_contains("routes", "publisher-id"), ~clash & F.arrays_overlap(exact("asked_names"), exact("found_names"))
    count = lambda which: F.sum(F.when(which, F.col("others")).otherwise(0))
    seen = pairs.withColumn("others", n).groupBy("asked").agg(
        F.sum("others").alias("candidates"), count(~clash).alias("plausible"), count(by_id).alias("ids"), count(by_name).alias("exact"),
        F.max(F.when(by_id, F.col("found"))).alias("id_found"), F.max(F.when(by_name, F.col("found"))).alias("name_found"),
    )
    none = lambda c: F.coalesce(c, F.lit(0))
    whole = kinds.join(seen.withColumnRenamed("asked", "class"), "class", "left").join(unsupported(kinds), "class")
    winner = F.when(F.col("ids") == 1, F.col("id_found")).when(F.col("exact") == 1, F.col("name_found"))
    reason = first_reason(
        ("damaged-reading", ~F.col("usable")),
        ("missing-name", F.col("folded").isNull()),
        ("unsupported-possible-candidate", F.col("omitted") > 0),
        ("verified-publisher-id", none("ids") == 1),
        ("configured-ambiguous-name", F.col("folded").isin(*ambiguous)),
        ("insufficient-name", F.size(F.split("folded", " ")) < 2),
        ("competing-candidates", none("plausible") > 1),
        ("no-distinctive-exact-match", winner.isNull()),
        otherwise="distinctive-exact-name",
    )
    whole = whole.select("class", "last", none("candidates").alias("candidates"), "omitted", "excluded", reason.alias("reason"), winner.alias("winner"))
    linked = F.col("reason").isin(*LINKS)
    # one's only candidate in a class of two is the other member
    other = F.when(F.col("winner") != F.col("class"), F.col("winner")).when(F.col("id") == F.col("class"), F.col("last")).otherwise(F.col("class"))
    return members.join(whole, "class").select("id", F.when(linked, "approve").otherwise("unresolved").alias("status"), "reason", F.when(linked, other).alias("candidate_id"), "candidates", "omitted", "excluded")
