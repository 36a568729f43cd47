"""Candidate pairs, one-to-one matches, relationship edges and comparisons of two sides, all as equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.names import folded, token_order, tokens
from tesserae.sources.stored import stored

#: So many pairs, about, are one task's work.
PAIRS = 2_000_000


def name_groups(people: DataFrame, id_col: str, name_col: str, source_col: str) -> DataFrame:
    """(id, group, name) of every person: listings of one source with one name (in any order of words) are one group, named after
    its smallest id, ``name`` being that member's folded name. A name without letters is null, and its row a group of its own."""
    named = people.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.nullif(folded(F.col(name_col)), F.lit("")).alias("name"))
    ordered = named.withColumn("ordered", token_order(F.col("name")))
    heads = ordered.where("name is not null").groupBy("source", "ordered").agg(F.min("id").alias("group"), F.min_by("name", "id").alias("head"))
    joined = ordered.alias("o").join(heads.alias("h"), F.col("o.source").eqNullSafe(F.col("h.source")) & (F.col("o.ordered") == F.col("h.ordered")), "left")
    return joined.select("id", F.coalesce("group", "id").alias("group"), F.col("head").alias("name"))


def name_candidates(people: DataFrame, id_col: str, name_col: str, source_col: str, least_letters: int = 4) -> DataFrame:
    """(left, right, signal) of people that may be one: 1 folded names equal, 2 equal in another word order, 3 a shared
    word of ``least_letters`` or more where both names have two words or more.

    Pairs are between groups (``name_groups`` has the members), named after their smallest ids; they are ordered (left < right) and
    carry their strongest signal. Names without letters match nobody.
    """
    return _group_pairs(name_groups(people, id_col, name_col, source_col), least_letters)


def _group_pairs(groups: DataFrame, least_letters: int) -> DataFrame:
    one = groups.where("id = group and name is not null").select("id", "name", token_order(F.col("name")).alias("ordered"))
    parts = one.select("id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("key"), F.size(tokens(F.col("name"))).alias("n"))
    keys = one.select("id", F.lit(1).alias("signal"), F.col("name").alias("key")).unionByName(one.select("id", F.lit(2).alias("signal"), F.col("ordered").alias("key")))
    keys = keys.unionByName(parts.where((F.col("n") >= 2) & (F.char_length("key") >= least_letters)).select("id", F.lit(3).alias("signal"), "key"))
    left, right = keys.alias("l"), keys.alias("r")
    pairs = left.join(right, (F.col("l.signal") == F.col("r.signal")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")))
    return pairs.groupBy(F.col("l.id").alias("left"), F.col("r.id").alias("right")).agg(F.min("l.signal").alias("signal"))


def candidate_outcome(people: DataFrame, id_col: str, name_col: str, source_col: str, least_letters: int = 4) -> DataFrame:
    """(id, group, candidates, outcome) of every person, by group: unknown without a name, no-candidate, candidate, or
    ambiguous (several groups, or a shared word alone). ``candidates`` counts groups."""
    groups = name_groups(people, id_col, name_col, source_col)
    pairs = _group_pairs(groups, least_letters)
    both = pairs.select(F.col("left").alias("group"), "signal").unionByName(pairs.select(F.col("right").alias("group"), "signal"))
    found = both.groupBy("group").agg(F.count("*").alias("candidates"), F.min("signal").alias("best"))
    outcome = (
        F.when(F.col("name").isNull(), "unknown").when(F.col("candidates").isNull(), "no-candidate").when((F.col("candidates") > 1) | (F.col("best") == 3), "ambiguous").otherwise("candidate")
    )
    return groups.join(found, "group", "left").select(F.col("id").alias(id_col), "group", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), outcome.alias("outcome"))


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) where a key joins exactly one row of each side; null keys match nothing."""
    lone = lambda df, ident: df.groupBy(*keys).agg(F.count("*").alias("n"), F.first(ident).alias(ident)).where("n = 1").drop("n")
    return lone(left, left_id).join(lone(right, right_id), keys).select(left_id, right_id)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``."""
    return left.join(right.select(*keys), keys, "left_anti")


def pair_edges(rows: DataFrame, key: str | Column, id_col: str, kind: str) -> DataFrame:
    """(left, right, kind): star edges from the smallest id of each key to every other id of it.

    A star keeps the same components as all pairs, with one edge a member.
    """
    keyed = rows.select(F.col(id_col).alias("id"), (F.col(key) if isinstance(key, str) else key).alias("key")).where("key is not null")
    anchor = keyed.groupBy("key").agg(F.min("id").alias("left"))
    return keyed.join(anchor, "key").where("id <> left").select("left", F.col("id").alias("right"), F.lit(kind).alias("kind"))


def normal_url(url: Column) -> Column:
    """A URL with its path's ``.`` and ``..`` steps taken, as far as they stand behind a step."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & F.coalesce(last != "..", F.lit(False)) & (F.size(done) > 1)
        return F.when(part == ".", done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    head, path, tail = (F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$", i) for i in (1, 2, 3))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    end = F.when(path.rlike(r"(^|/)\.{1,2}$"), "/").otherwise("")
    return F.when(url.isNotNull(), F.concat(head, F.regexp_replace(F.concat(F.array_join(parts, "/"), end), "//$", "/"), tail))


def version_relationships(acquisitions: DataFrame) -> DataFrame:
    """(left, right, kind, reason) of acquisitions (acquisition_id, sha256, publisher, final_url): ``source-duplicate`` for equal bytes, ``unknown``
    with reason possible-source-revision for other bytes at one publisher's URL.

    Edges are stars: copies lead to their first acquisition, and the first acquisitions of the several versions at a URL to the
    smallest of them; a group of n versions has n - 1 edges and the components of all its pairs.
    """
    copies = pair_edges(acquisitions, "sha256", "acquisition_id", "source-duplicate").withColumn("reason", F.lit(None).cast("string"))
    place = F.when(F.col("publisher").isNotNull() & F.col("final_url").isNotNull(), F.concat_ws("\x1f", "publisher", normal_url(F.col("final_url"))))
    versions = acquisitions.withColumn("__place", place).where("__place is not null and sha256 is not null").groupBy("__place", "sha256").agg(F.min("acquisition_id").alias("acquisition_id"))
    revised = pair_edges(versions, "__place", "acquisition_id", "unknown").withColumn("reason", F.lit("possible-source-revision"))
    return copies.unionByName(revised)


def agreed_edges(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair; kinds that disagree become ``unknown``."""
    ordered = edges.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "kind")
    return ordered.groupBy("left", "right").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("unknown").alias("kind"))


def near_misses(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, match, near): the one exact match of each left row, or else the sorted ids that share the loose key."""
    found = unique_matches(left, right, exact, left_id, right_id).withColumnRenamed(right_id, "match")
    near = right.groupBy(*loose).agg(F.array_sort(F.collect_list(right_id)).alias("near"))
    rest = left.join(found, left_id, "left_anti").join(near, loose, "left").select(left_id, F.lit(None).cast(right.schema[right_id].dataType).alias("match"), "near")
    return found.select(left_id, "match", F.lit(None).cast(rest.schema["near"].dataType).alias("near")).unionByName(rest)


def crossed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` and ``right`` with equal ``keys``, as an inner join; no other column is in both.

    For keys that many rows of both sides share. Pairs are counted by key first: tasks are as many as the pairs need, and a key of
    more than ``PAIRS`` pairs is cut into cells, each with a part of its left rows.
    """
    sizes = left.groupBy(*keys).agg(F.count("*").alias("__l")).join(right.groupBy(*keys).agg(F.count("*").alias("__r")), keys)
    work = stored(sizes.select(*keys, F.ceil(F.col("__l") * F.col("__r") / PAIRS).alias("__cells"), (F.col("__l") * F.col("__r")).alias("__pairs")), "work")
    tasks = 1 + (work.agg(F.sum("__pairs")).first()[0] or 0) // PAIRS
    hot = work.where("__cells > 1").select(*keys, "__cells")
    cells = F.coalesce("__cells", F.lit(1).cast("long"))
    l = left.join(hot, keys, "left").withColumn("__cell", F.pmod(F.xxhash64(*left.columns), cells)).drop("__cells")
    r = right.join(hot, keys, "left").withColumn("__cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).drop("__cells")
    on = [*keys, "__cell"]
    return l.repartition(tasks, *on).join(r.repartition(tasks, *on).hint("merge"), on).drop("__cell")


def routes(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, found, routes): what an inverted index (route, key, id) holds for the keys (route, key, id) of each asked id, with
    the routes that led there, sorted."""
    # keys of both sides are numbered; both sides know all numbers of their id, so a pair is given once, by its least shared number,
    # and pairs are not shuffled
    known = lambda rows: rows.where("route is not null and key is not null and id is not null").select("route", "key", "id").distinct()
    shared_keys = known(asked).select("route", "key").distinct().join(known(index).select("route", "key").distinct(), ["route", "key"])
    numbers = stored(shared_keys.withColumn("__key", F.monotonically_increasing_id()), "keys")

    def entries(rows: DataFrame, name: str) -> DataFrame:
        numbered = known(rows).join(numbers, ["route", "key"])
        return numbered.groupBy(F.col("id").alias(name)).agg(F.collect_list(F.struct("__key", "route")).alias(f"__{name}"))

    left = entries(asked, "asked").select("asked", "__asked", F.col("__asked")["__key"].alias("__mine"), F.inline("__asked"))
    right = entries(index, "found").select("found", F.col("__found")["__key"].alias("__theirs"), F.explode(F.col("__found")["__key"]).alias("__key"))
    hits = crossed(left, right, ["__key"]).where("asked <> found").withColumn("__both", F.array_intersect("__mine", "__theirs"))
    least = hits.where((F.size("__both") == 1) | (F.array_min("__both") == F.col("__key")))
    several = F.transform(F.filter("__asked", lambda x: F.array_contains("__both", x["__key"])), lambda x: x["route"])
    names = F.when(F.size("__both") == 1, F.col("route")).otherwise(F.array_join(F.array_sort(F.array_distinct(several)), ","))
    return least.select("asked", "found", names.alias("routes"))


def compared(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, side, field, before, after): rows on one side only, and fields that differ (null and '' are equal)."""
    a = left.select(*keys, F.struct(*fields).alias("a"))
    b = right.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full_outer")
    text = lambda s, f: F.nullif(F.col(f"{s}.{f}").cast("string"), F.lit(""))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text("a", f).alias("before"), text("b", f).alias("after")) for f in fields))).alias("x")
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both")
    rows = both.select(*keys, side.alias("side"), each).select(*keys, "side", "x.*")
    return rows.where("side <> 'both' or not (before <=> after)")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables are equal as bags."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def overlapping_leads(rows: DataFrame, id_col: str, source_col: str, names_col: str, date_col: str) -> DataFrame:
    """(left, right, name): ids of different sources that share a name and whose dates do not contradict."""
    listed = rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(date_col).alias("date"), F.array_distinct(names_col).alias("names")).where("id is not null")
    repeated = stored(listed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        sides = [df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns), F.explode("names").alias("name")) for side, df in (("l", left), ("r", right))]
        agree = F.col("l_date").isNull() | F.col("r_date").isNull() | (F.col("l_date") == F.col("r_date"))
        return crossed(*sides, ["name"]).where((F.col("l_source") != F.col("r_source")) & (F.col("l_id") < F.col("r_id")) & agree)

    # ids of one row know all their names, so a pair of them is given once, by its least shared name, and is not shuffled
    single = listed.join(repeated, "id", "left_anti")
    least = (F.size("l_names") == 1) | (F.size("r_names") == 1) | (F.col("name") == F.array_min(F.array_intersect("l_names", "r_names")))
    out = pairs(single, single).where(least).select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), "name")
    if repeated.isEmpty():
        return out
    several = listed.join(repeated, "id", "left_semi")
    rest = pairs(several, listed).unionByName(pairs(single, several))
    return out.unionByName(rest.groupBy(F.col("l_id").alias("left"), F.col("r_id").alias("right")).agg(F.min("name").alias("name")))


def disjoint(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether two namespaces share no key."""
    return left.select(key).join(right.select(key), key, "left_semi").isEmpty()


def verified_readings(first: DataFrame, second: DataFrame, keys: list[str], value: str, box: str, least_overlap: float = 0.5) -> DataFrame:
    """(keys, outcome): two readings of one position are agreed, or inspected where the boxes overlap enough but the values
    differ, else unresolved."""
    from tesserae.functions.scalars import box_iou

    a = first.select(*keys, F.col(value).alias("a"), F.col(box).alias("box_a"))
    b = second.select(*keys, F.col(value).alias("b"), F.col(box).alias("box_b"))
    overlap = box_iou(F.col("box_a"), F.col("box_b")) >= least_overlap
    outcome = F.when(overlap & F.col("a").eqNullSafe(F.col("b")), "agreed").when(overlap, "inspected").otherwise("unresolved")
    return a.join(b, keys, "full_outer").select(*keys, outcome.alias("outcome"))


def exactly_one(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key stands once."""
    return rows.withColumn("__n", F.count("*").over(W.partitionBy(*keys))).where("__n = 1").drop("__n")
