"""Proven relationships of printed rows and of source routes, and the rules of a census.

Nothing about people is inferred: what evidence does not prove is ``unknown`` and a candidate for review.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ordering import beside
from tesserae.sources.stored import stored

KINDS = ("same-attempt", "source-duplicate", "parser-revision", "supporting-result", "unknown")
#: What a census may say.
AUTHORITIES, MEDIA = ("official", "organizer", "third-party", "unknown"), ("html", "pdf", "json", "image", "workbook")
STATUSES, GAP_STATUSES, SHA = ("parsed", "quarantined", "unparsed"), ("checked", "missing", "inaccessible", "unchecked"), "^[0-9a-f]{64}$"


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def _cited(o: Column) -> Column:
    """Whether an observation says where it is printed and what is printed there."""
    return F.coalesce(_text(o["source_sha256"]) & (o["page"] > 0) & (o["line"] > 0) & _text(o["source_text"]), F.lit(False))


def _context(a: Column, b: Column) -> Column:
    return _text(a["event_key"]) & (a["event_key"] == b["event_key"]) & _text(a["discipline"]) & (a["discipline"] == b["discipline"]) & a["day"].eqNullSafe(b["day"])


def _ordered(parsed: Column) -> Column:
    return F.array_sort(F.map_entries(parsed))


def automatic_edges(observations: DataFrame) -> DataFrame:
    """(left, right, kind, reason): observations (ref, source_sha256, page, line, source_text, event_key, discipline, day, parser_version, parsed: map) that
    cite one place of one source: parser-revision where the parsers differ, source-duplicate where what they read is equal, else unknown,
    as where text or context differ.

    Observations that agree in everything are a class: its members lead to their first by a star of source-duplicates; pairs are made between
    the first ones of the classes of a place only.
    """
    own = F.struct(*observations.columns)
    place = ["source_sha256", "page", "line"]
    same = [*place, "source_text", "event_key", "discipline", "day", "parser_version", "parsed"]
    cited = observations.withColumn("o", own).where(_cited(F.col("o"))).withColumn("parsed", _ordered(F.col("parsed"))).select("ref", *same)
    heads = stored(cited.groupBy(*same).agg(F.min("ref").alias("head"), F.max("ref").alias("last"), F.count("*").alias("n")), "heads")
    # two members are known from the class alone; more are found by the hash of what they agree in, then by itself
    number = F.xxhash64(*same)
    many = stored(heads.where("n > 2").select(*same, "head"), "many")
    hashes = stored(many.select(number.alias("__hash")).distinct(), "hashes")
    rest = beside(cited.join(hashes, number == F.col("__hash"), "left_semi"), many, same, "inner").select("head", F.col("ref").alias("last"), *same)
    members = heads.where("n = 2").select("head", "last", *same).unionByName(rest).where("head <> last")
    # members of a class without a context of their own prove nothing
    sure = _context(*[F.struct("event_key", "discipline", "day")] * 2)
    stars = members.select(F.col("head").alias("left"), F.col("last").alias("right"), F.when(F.coalesce(sure, F.lit(False)), "source-duplicate").otherwise("unknown").alias("kind"))
    first = F.struct("head", *same[len(place) :])
    both = heads.select(*place, first.alias("a")).join(heads.select(*place, first.alias("b")), place).where("a.head < b.head")
    x, y = F.col("a"), F.col("b")
    agree = F.coalesce(_context(x, y), F.lit(False)) & (x["source_text"] == y["source_text"])
    kind = F.when(~agree, "unknown").when(~x["parser_version"].eqNullSafe(y["parser_version"]), "parser-revision").when(x["parsed"] == y["parsed"], "source-duplicate").otherwise("unknown")
    pairs = both.select(F.col("a.head").alias("left"), F.col("b.head").alias("right"), kind.alias("kind"))
    return stars.unionByName(pairs).withColumn("reason", F.lit(None).cast("string"))


def explicit_edges(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(left, right, kind, reason) of evidence (left, right, kind, left_page, left_line, right_page, right_line, left_text, right_text, fields: array) that
    two rows are one attempt: accepted where both are cited as it says, their context agrees, they stand at different places, and
    three fields or more, each once, are known and equal in both; else unknown for insufficient-evidence."""
    known = observations.select("ref", F.struct(*(c for c in observations.columns if c != "ref")).alias("o"))
    joined = beside(beside(evidence, known.withColumnsRenamed({"ref": "left", "o": "a"}), ["left"]), known.withColumnsRenamed({"ref": "right", "o": "b"}), ["right"])
    a, b = F.col("a"), F.col("b")
    places = (a["page"] == F.col("left_page")) & (a["line"] == F.col("left_line")) & (b["page"] == F.col("right_page")) & (b["line"] == F.col("right_line"))
    texts = (a["source_text"] == F.col("left_text")) & (b["source_text"] == F.col("right_text"))
    apart = ~(a["source_sha256"].eqNullSafe(b["source_sha256"]) & a["page"].eqNullSafe(b["page"]) & a["line"].eqNullSafe(b["line"]))
    fields = (F.size("fields") >= 3) & (F.size(F.array_distinct("fields")) == F.size("fields")) & F.forall("fields", lambda f: F.coalesce(F.try_element_at(a["parsed"], f) == F.try_element_at(b["parsed"], f), F.lit(False)))
    sound = (F.col("left") != F.col("right")) & (F.col("kind") == "same-attempt") & _cited(a) & _cited(b) & _context(a, b) & apart & places & texts & fields
    accepted = F.coalesce(sound, F.lit(False))
    return joined.select(
        F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.when(accepted, "same-attempt").otherwise("unknown").alias("kind"), F.when(~accepted, "insufficient-evidence").alias("reason")
    )


def classified(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(left, right, kind, reason) once for each pair: claims of one kind stand, claims that differ are unknown (conflicting-evidence)."""
    edges = automatic_edges(observations).unionByName(explicit_edges(observations, evidence))
    one = F.min("kind") == F.max("kind")
    return edges.groupBy("left", "right").agg(F.when(one, F.min("kind")).otherwise("unknown").alias("kind"), F.when(one, F.min("reason")).otherwise("conflicting-evidence").alias("reason"))


def route_edges(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(left, right, kind, reason) of source routes (route_id, source_sha256): a star of source-duplicates for equal bytes, and the
    candidates (left, right, reason) as unknown. A candidate of unknown or equal routes, or without a reason, is an error."""
    ends = candidates.select(F.explode(F.array("left", "right")).alias("route_id"))
    if not ends.join(routes, "route_id", "left_anti").isEmpty() or not candidates.where("left <=> right or reason is null").isEmpty():
        raise ValueError("a candidate needs two known routes and a reason")
    held = routes.where(_text(F.col("source_sha256")))
    first = held.groupBy("source_sha256").agg(F.min("route_id").alias("left"))
    stars = held.join(first, "source_sha256").where("route_id <> left").select("left", F.col("route_id").alias("right"), F.lit("source-duplicate").alias("kind"), F.lit(None).cast("string").alias("reason"))
    asked = candidates.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.lit("unknown").alias("kind"), "reason").distinct()
    return stars.unionByName(asked)


def kind_counts(scopes: dict[str, DataFrame]) -> DataFrame:
    """(scope, kind, edges) with every kind, zeros included."""
    parts = [df.select(F.lit(name).alias("scope"), "kind") for name, df in scopes.items()]
    spark = parts[0].sparkSession
    frame = spark.createDataFrame([(s, k) for s in scopes for k in KINDS], "scope string, kind string")
    return beside(frame, functools.reduce(DataFrame.unionByName, parts).groupBy("scope", "kind").agg(F.count("*").alias("edges")), ["scope", "kind"]).fillna(0, ["edges"])


def census_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, id) of everything that a census breaks; no row: it holds.

    ``events`` (id, federation, name, held_from, held_to), ``sources`` (id, event_ids, authority, media, original_sha256, acquisition_id,
    retrieved_at, discovery_url, final_url, view_state, view_ref, provenance_gaps), ``positions`` (id, source_id, locator, status, raw_fields,
    unresolved_reason, observation_refs: array of (job_id, ordinal, artifact_sha256, parser_version, citation)), ``gaps`` (id, scope, ref,
    status, reason), ``relationships`` (id, left, right, kind, status, basis).
    """
    events, sources, positions, gaps, relations = (tables[n] for n in ("events", "sources", "positions", "gaps", "relationships"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    bad = lambda rows, rule, when: rows.where(when).select(F.lit(rule).alias("rule"), "id")
    lost = lambda rows, rule, key, parent: rows.join(parent.select(F.col("id").alias("__id")).distinct(), F.col(key) == F.col("__id"), "left_anti").select(F.lit(rule).alias("rule"), "id")
    date = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c).isNotNull()
    unproven = functools.reduce(lambda a, b: a | b, (F.col(c).isNull() for c in ("acquisition_id", "retrieved_at", "discovery_url", "final_url", "view_state")))
    refs = positions.select("id", F.explode("observation_refs").alias("r")).select("id", "r.*", F.struct("r.*").alias("ref"))
    versions = refs.groupBy("job_id", "ordinal").agg(F.count_distinct(F.to_json("ref")).alias("__ways")).where("__ways > 1")
    conflicting = refs.join(versions, ["job_id", "ordinal"], "left_semi").select(F.lit("conflicting-observation").alias("rule"), "id")
    ref_ok = _text(F.col("job_id")) & (F.col("ordinal") >= 0) & F.col("artifact_sha256").rlike(SHA) & _text(F.col("parser_version")) & _text(F.col("citation"))
    exploded = sources.select("id", F.explode("event_ids").alias("event_id"))
    repeated = [rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate-{name}").alias("rule"), "id") for name, rows in tables.items()]
    parts = [
        *repeated,
        bad(events, "incomplete-event", no(_text(F.col("federation")) & _text(F.col("name")))),
        bad(events, "event-dates", no(date("held_from") & date("held_to") & (F.col("held_from") <= F.col("held_to")))),
        bad(sources, "repeated-source-event", F.size(F.array_distinct("event_ids")) < F.size("event_ids")),
        lost(exploded, "unknown-event", "event_id", events),
        bad(sources, "source-authority", no(F.col("authority").isin(*AUTHORITIES))),
        bad(sources, "source-media", no(F.col("media").isin(*MEDIA))),
        bad(sources, "source-digest", no(F.col("original_sha256").rlike(SHA))),
        bad(sources, "retrieved-without-zone", F.col("retrieved_at").isNotNull() & no(F.col("retrieved_at").rlike(r"^\d{4}-\d{2}-\d{2}T[0-9:.]+(Z|[+-]\d{2}:\d{2})$"))),
        bad(sources, "incomplete-view", F.col("view_state").isNotNull() & no(_text(F.col("view_state")) & _text(F.col("view_ref")))),
        bad(sources, "provenance-without-gap", unproven & no(F.size("provenance_gaps") > 0)),
        lost(positions.where("source_id is not null"), "unknown-source", "source_id", sources),
        bad(positions, "incomplete-position", no(F.col("source_id").isNotNull() & _text(F.col("locator")))),
        bad(positions, "position-status", no(F.col("status").isin(*STATUSES))),
        bad(positions, "unresolved-without-reason", F.col("raw_fields").isNull() & no(_text(F.col("unresolved_reason")))),
        bad(refs, "malformed-observation", no(ref_ok)),
        conflicting,
        bad(gaps, "gap-scope", no(F.col("scope").isin("event", "source", "search"))),
        lost(gaps.where("scope = 'event'"), "gap-unknown-event", "ref", events),
        lost(gaps.where("scope = 'source'"), "gap-unknown-source", "ref", sources),
        bad(gaps, "incomplete-gap", no(_text(F.col("ref")) & _text(F.col("reason")) & F.col("status").isin(*GAP_STATUSES))),
        bad(relations, "relationship-kind", no(F.col("kind").isin(*KINDS) & F.col("status").isin("exact", "unknown") & ~((F.col("kind") == "unknown") & (F.col("status") != "unknown")))),
        bad(relations, "incomplete-relationship", no(_text(F.col("basis")) & F.col("left").isNotNull() & F.col("right").isNotNull())),
        lost(relations.where("left is not null"), "unknown-position", "left", positions),
        lost(relations.where("right is not null"), "unknown-position", "right", positions),
    ]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def audit_problems(observations: DataFrame, edges: DataFrame, routes: DataFrame, route_edges_: DataFrame, recorded: DataFrame) -> DataFrame:
    """(problem, left, right) of a ledger of relationships that was handed in.

    ``edges`` is (left, right, kind, fields: array of names that are claimed to be equal) between observations, ``route_edges_`` (left, right, kind, basis_sha256) between
    routes (route_id, source_sha256), ``recorded`` (scope, kind, edges) the counts that it states. Ends must be known and two, a pair stands once,
    duplicates and revisions are of one place, text and scope (read alike, or by other parsers), attempts agree in event, discipline, day and three
    fields or more, route duplicates have the bytes that they name, and the counts are right. Unknown edges need known ends only.
    """
    kind = F.col("kind")
    known = observations.select("ref", F.struct(*(c for c in observations.columns if c != "ref")).alias("o"))
    joined = beside(beside(edges, known.withColumnsRenamed({"ref": "left", "o": "a"}), ["left"]), known.withColumnsRenamed({"ref": "right", "o": "b"}), ["right"])
    a, b = F.col("a"), F.col("b")
    one_source, one_text = a["source_sha256"] == b["source_sha256"], a["source_text"] == b["source_text"]
    scope = a["event_key"].eqNullSafe(b["event_key"]) & a["discipline"].eqNullSafe(b["discipline"]) & a["day"].eqNullSafe(b["day"])
    both = _cited(a) & _cited(b)
    same = F.coalesce(both & one_source & (a["page"] == b["page"]) & (a["line"] == b["line"]) & one_text & scope, F.lit(False))
    parsers, parsed = a["parser_version"].eqNullSafe(b["parser_version"]), _ordered(a["parsed"]).eqNullSafe(_ordered(b["parsed"]))
    fields = (F.size("fields") >= 3) & (F.size(F.array_distinct("fields")) == F.size("fields")) & F.forall("fields", lambda f: F.coalesce(F.try_element_at(a["parsed"], f) == F.try_element_at(b["parsed"], f), F.lit(False)))
    # an unknown day proves nothing across sources
    dated = F.coalesce(a["day"] == b["day"], F.lit(False)) | one_source
    attempt = both & _text(a["event_key"]) & (a["event_key"] == b["event_key"]) & _text(a["discipline"]) & (a["discipline"] == b["discipline"]) & dated & fields
    unknown_end = a.isNull() | b.isNull() | F.col("left").eqNullSafe(F.col("right"))
    wrong = (
        F.when(unknown_end, "unknown-end")
        .when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown-kind")
        .when((kind == "source-duplicate") & ~(same & parsed), "no-duplicate")
        .when((kind == "parser-revision") & ~(same & ~parsers), "no-revision")
        .when((kind == "same-attempt") & ~F.coalesce(attempt, F.lit(False)), "no-same-attempt")
    )
    pair = (F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
    repeated = lambda rows: rows.select(*pair).groupBy("left", "right").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated-pair").alias("problem"), "left", "right")
    by_route = routes.select("route_id", "source_sha256", F.lit(True).alias("__in"))
    r = beside(beside(route_edges_, by_route.toDF("left", "sha_a", "in_a"), ["left"]), by_route.toDF("right", "sha_b", "in_b"), ["right"])
    bytes_ok = F.coalesce((F.col("sha_a") == F.col("sha_b")) & (F.col("sha_a") == F.col("basis_sha256")), F.lit(False))
    wrong_route = (
        F.when(F.col("in_a").isNull() | F.col("in_b").isNull() | F.col("left").eqNullSafe(F.col("right")), "unknown-end")
        .when(~F.coalesce(kind.isin("source-duplicate", "unknown"), F.lit(False)), "unknown-kind")
        .when((kind == "source-duplicate") & ~bytes_ok, "no-duplicate")
    )
    counted = edges.select(F.lit("observation").alias("scope"), "kind").unionByName(route_edges_.select(F.lit("source-route").alias("scope"), "kind")).groupBy("scope", "kind").agg(F.count("*").alias("__n"))
    counts = recorded.join(counted, ["scope", "kind"], "left").where(F.col("edges") != F.coalesce("__n", F.lit(0)))
    parts = (
        joined.select(wrong.alias("problem"), "left", "right").where("problem is not null"), repeated(edges), r.select(wrong_route.alias("problem"), "left", "right").where("problem is not null"), repeated(route_edges_),
        counts.select(F.lit("count-mismatch").alias("problem"), F.col("scope").alias("left"), F.col("kind").alias("right")),
    )
    return functools.reduce(DataFrame.unionByName, parts).distinct()
