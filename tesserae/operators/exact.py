"""Exact bindings: publications to retained rows, snapshots to revisions, decisions to positions, candidates to page lines.

Each check names what is wrong beside the row; nothing is repaired. All of them are equi joins on full references, or on
their SHA-256, and counts by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason, reasons
from tesserae.operators.ordering import beside

SHA = "^[0-9a-f]{64}$"
#: Facts that every published row must state, and one that it may.
FACTS = (
    "source-view", "source-authority", "finality", "sanction", "review", "outcome", "same-attempt", "source-conflict", "final", "scoring-policy",
    "source-gender", "comparable-category", "represented-country", "listing", "international-sanction", "official-event-placing",
)
OPTIONAL = ("source-selection",)
REFERENCE = ("observation_id", "ordinal", "source_sha256", "artifact_sha256")
PLACE = ("page", "line", "table", "row")


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with whether another row has the same keys, by counts; null keys are equal."""
    counts = rows.groupBy(*keys).agg((F.count("*") > 1).alias(name))
    return beside(rows, counts, keys)


#: What can be wrong with a published row, in the order in which it is told; a row carries what is true of it as bits.
PROBLEMS = (
    "invalid-reference", "duplicate-result", "missing-evidence", "several-evidence", "reference-changed", "unmatched-context", "several-context-rows", "missing-parser-version",
    "retained-reference-differs", "unsupported-scope", "mapping-changed", "duplicate-position", "invalid-source", "missing-facts", "unsupported-facts", "repeated-facts",
    "fact-binding-changed", "fact-policy-changed", "fact-citation-changed",
)


def _digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the texts of ``values``, each behind its length; null has a mark of its own, so null equals null."""
    texts = [v.cast("string") for v in values]
    found = F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))
    return F.coalesce(found, F.lit(b""))  # never null, which Spark does not see and would test before each join by computing it again


def _bits(rules: dict[str, Column]) -> Column:
    """The problems whose predicate is true, as bits of a number; an unknown predicate sets none."""
    return reduce(Column.__add__, (F.when(rule, 1 << PROBLEMS.index(name)).otherwise(0) for name, rule in rules.items()))


def _has(bits: Column, *names: str) -> Column:
    return bits.bitwiseAND(sum(1 << PROBLEMS.index(n) for n in names)) != 0


def publication_problems(rows: DataFrame, evidence: DataFrame, context: DataFrame, scope: dict[str, str], policy: str, named: tuple[str, ...] = ("result_id",)) -> DataFrame:
    """(``named``, problems) of rows of a publication; ``named`` are the columns of ``rows`` that tell them apart for the caller.

    ``rows`` is (result_id, REFERENCE, federation, event_id, view_id, facts: array of (name, result_id, policy, source_sha256, artifact_sha256,
    page, line)); ``evidence`` names the retained row of each (result_id, REFERENCE, job_id, candidate_id, parser_version, PLACE);
    ``context`` has the retained rows that count now (job_id, candidate_id, ordinal, source_sha256, artifact_sha256, PLACE, the columns of
    ``scope``, public_id). A row needs one evidence, that one context row, a physical position of its own, and facts that are complete,
    closed and bound to it. Of several evidences of a result or context rows of an evidence, the least counts for the other problems.

    Facts and references are judged where they stand. Five shuffles follow, each of digests, bits and places: evidence and context by the
    retained row, evidence and rows by the result, rows by their position. Everything that is grouped is grouped where it is joined.
    """
    retained = [F.col(c) for c in ("job_id", "candidate_id", *PLACE)]
    version = [F.col(c) for c in ("ordinal", "source_sha256", "artifact_sha256")]
    reference = _digest(*(F.col(c) for c in REFERENCE))
    whole = reduce(Column.__and__, (c.isNotNull() for c in version))
    in_scope = reduce(Column.__and__, (F.col(c) == value for c, value in scope.items()), F.lit(True))
    public = F.when(F.col("public_id").isNotNull(), _digest(F.col("public_id")))

    held = context.select(_digest(*retained).alias("__at"), F.struct(F.when(whole, _digest(*version)).alias("version"), F.coalesce(in_scope, F.lit(False)).alias("in_scope"), public.alias("public")).alias("c"))
    held = held.repartition("__at").groupBy("__at").agg(F.count("*").alias("__found"), F.min("c").alias("c"))
    proofs = evidence.select(_digest(F.col("result_id")).alias("__result"), reference.alias("__reference"), _digest(*retained).alias("__at"), *PLACE, (F.coalesce("parser_version", F.lit("")) == "").alias("__unversioned"))
    found = proofs.join(held, "__at", "left")
    told = _bits({
        "unmatched-context": F.col("__found").isNull(),
        "several-context-rows": F.col("__found") > 1,
        "missing-parser-version": F.col("__unversioned"),
        "unsupported-scope": (F.col("__found") == 1) & ~F.col("c.in_scope"),
        "mapping-changed": F.col("c.public") != F.col("__result"),
    })
    found = found.select("__result", F.struct(F.col("__reference").alias("reference"), *PLACE, told.alias("bits"), F.col("c.version").alias("version")).alias("e"))
    found = found.repartition("__result").groupBy("__result").agg(F.count("*").alias("__proofs"), F.min("e").alias("e"))

    reference_ok = F.col("result_id").rlike(SHA) & F.col("observation_id").rlike(SHA) & F.col("source_sha256").rlike(SHA) & F.col("artifact_sha256").rlike(SHA) & (F.col("ordinal") >= 0)
    own = lambda f: (f["source_sha256"] == F.col("source_sha256")) & (f["artifact_sha256"] == F.col("artifact_sha256"))
    names, size = F.col("facts.name"), F.size("facts")
    others = lambda c, value: F.col(f"facts.{c}") != F.array_repeat(value, size)
    first = lambda c: F.get(F.col(f"facts.{c}"), F.lit(0))
    # names are sets only where they are not all there in the usual order
    named_facts = _bits({
        "missing-facts": F.coalesce(F.size(F.array_except(F.array(*map(F.lit, FACTS)), names)), F.lit(1)) > 0,
        "unsupported-facts": F.size(F.array_except(names, F.array(*map(F.lit, FACTS + OPTIONAL)))) > 0,
        "repeated-facts": F.size(F.array_distinct(names)) < F.size(names),
    })
    judged = F.when(names == F.array(*map(F.lit, FACTS)), 0).otherwise(named_facts) + _bits({
        "invalid-reference": _no(reference_ok),
        "invalid-source": _no(F.col("federation").isin("CMAS", "AIDA") & F.col("event_id").rlike("^[a-z0-9-]{1,100}$") & F.col("view_id").rlike("^[a-z0-9-]{1,100}$")),
        "fact-binding-changed": others("result_id", F.col("result_id")),
        "fact-policy-changed": others("policy", F.lit(policy)),
        # facts that cite several places cannot all cite that of the evidence, so that one place at most goes on with a row
        "fact-citation-changed": others("page", first("page")) | others("line", first("line")) | F.exists("facts", lambda f: _no(own(f))),
    })
    published = rows.select(
        *(F.col(c).alias(f"__named_{c}") for c in named), _digest(F.col("result_id")).alias("__result"), reference.alias("__reference"), F.when(whole, _digest(*version)).alias("__version"), _digest(F.col("source_sha256")).alias("__source"),
        judged.alias("__judged"), F.when(size > 0, F.struct(first("page").alias("page"), first("line").alias("line"))).alias("__cited"),
    )
    published = published.withColumn("__twice", F.count("*").over(W.partitionBy("__result")) > 1)
    joined = published.join(found, "__result", "left")
    one = F.col("__proofs") == 1
    seen = F.col("e.bits")
    found_one = ~_has(seen, "unmatched-context", "several-context-rows")
    cited = F.col("__cited.page").eqNullSafe(F.col("e.page")) & F.col("__cited.line").eqNullSafe(F.col("e.line"))
    bound = _bits({
        "duplicate-result": F.col("__twice"),
        "missing-evidence": F.col("__proofs").isNull(),
        "several-evidence": F.col("__proofs") > 1,
        "reference-changed": one & (F.col("__reference") != F.col("e.reference")),
        **{n: one & _has(seen, n) for n in ("unmatched-context", "several-context-rows", "missing-parser-version")},
        "retained-reference-differs": found_one & _no(F.col("__version") == F.col("e.version")),
        **{n: _has(seen, n) for n in ("unsupported-scope", "mapping-changed")},
        "fact-citation-changed": F.col("__cited").isNotNull() & ~cited & ~_has(F.col("__judged"), "fact-citation-changed"),
    })
    # where it stands on paper, whatever it is called; a row that stands nowhere goes by its result, so that these do not meet in one task
    position = F.when(found_one, _digest(F.hex("__source"), *(F.col(f"e.{p}") for p in PLACE))).otherwise(F.col("__result"))
    placed = joined.select(*(f"__named_{c}" for c in named), (F.col("__judged") + bound).alias("__bits"), position.alias("__position"), F.coalesce(found_one, F.lit(False)).alias("__placed"))
    crowded = F.col("__placed") & (F.count("*").over(W.partitionBy("__position", "__placed")) > 1)
    bits = F.col("__bits") + _bits({"duplicate-position": crowded})
    return placed.withColumn("__bits", bits).select(*(F.col(f"__named_{c}").alias(c) for c in named), reasons(*((n, _has(F.col("__bits"), n)) for n in PROBLEMS)).alias("problems"))


def revision_problems(records: DataFrame, revisions: DataFrame, fields: list[str]) -> DataFrame:
    """(record_id, job_id, ordinal, problem, parser_differs, repeated) for each observation reference of snapshot records.

    ``records`` is (record_id, source_sha256, parser_version, citation, refs: array of (job_id, ordinal, source_sha256, ``fields``)),
    ``revisions`` the export (job_id, ordinal, source_sha256, parser_version, ``fields``). A reference must be whole, have its revision, agree in
    every field and in the source; one that several records make must be cited the same by all.
    """
    refs = records.select("record_id", "citation", F.col("source_sha256").alias("__source"), F.col("parser_version").alias("__parser"), F.explode("refs").alias("r")).select("*", "r.job_id", "r.ordinal")
    known = revisions.select("job_id", "ordinal", F.struct("source_sha256", "parser_version", *fields).alias("v"))
    joined = beside(refs, known, ["job_id", "ordinal"])
    cites = refs.groupBy("job_id", "ordinal").agg(F.count("*").alias("__n"), F.count_distinct(F.coalesce("citation", F.lit(""))).alias("__ways"), F.count_if(F.col("citation").isNull()).alias("__bare"))
    joined = beside(joined, cites, ["job_id", "ordinal"])
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"r.{f}").eqNullSafe(F.col(f"v.{f}"))
    other = ~F.col("__source").eqNullSafe(F.col("v.source_sha256")) | (F.col("r.source_sha256").isNotNull() & (F.col("r.source_sha256") != F.col("__source")))
    problem = first_reason(
        ("malformed-reference", F.col("job_id").isNull() | _no(F.col("ordinal") >= 0)),
        ("missing-observation", F.col("v").isNull()),
        ("mismatched-observation", differs),
        ("source-differs", other),
        ("ambiguous-reference", (F.col("__n") > 1) & ((F.col("__ways") > 1) | (F.col("__bare") > 0))),
    )
    parser = F.col("v").isNotNull() & ~F.col("__parser").eqNullSafe(F.col("v.parser_version"))
    return joined.select("record_id", "job_id", "ordinal", problem.alias("problem"), parser.alias("parser_differs"), (F.col("__n") > 1).alias("repeated"))


def decision_problems(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(position_id, problem): what keeps an exported decision from its retained position; null if nothing does.

    ``decisions`` is (position_id, job_id, ordinal, source_sha256, artifact_sha256, parser_version, raw_category, raw_representation,
    category_status, representation_status, accepted_categories, category_citation, representation_citation, revision), ``records``
    (source_id, kind, job_id, ordinal, source_sha256, artifact_sha256, parser_version, category_raw, representation_raw).
    """
    decisions = _repeated(decisions, ["position_id"], "__twice")
    rows = records.where("kind = 'candidate_position'").groupBy(F.col("source_id").alias("position_id")).agg(
        F.count("*").alias("__rows"), F.first(F.struct(*(c for c in records.columns if c not in ("source_id", "kind")))).alias("r")
    )
    joined = beside(decisions, rows, ["position_id"])
    said = lambda own, kept: F.col(f"r.{kept}").isNotNull() & ~F.col(own).eqNullSafe(F.col(f"r.{kept}"))
    known = ("automatic", "human", "unresolved")
    decided = lambda f: F.coalesce(F.col(f"{f}_status") != "unresolved", F.lit(False))
    problem = first_reason(
        ("missing-position", F.coalesce("position_id", F.lit("")) == ""),
        ("duplicate-position", F.col("__twice")),
        ("no-single-row", ~F.col("__rows").eqNullSafe(F.lit(1).cast("long"))),
        ("job-differs", said("job_id", "job_id") | said("ordinal", "ordinal")),
        ("version-differs", F.col("r.source_sha256").isNull() | F.col("r.parser_version").isNull() | said("source_sha256", "source_sha256") | said("parser_version", "parser_version") | said("artifact_sha256", "artifact_sha256")),
        ("raw-category-differs", said("raw_category", "category_raw")),
        ("raw-representation-differs", said("raw_representation", "representation_raw")),
        ("invalid-status", _no(F.col("category_status").isin(*known)) | _no(F.col("representation_status").isin(*known))),
        ("categories-missing", decided("category") & F.col("accepted_categories").isNull()),
        ("citation-missing", (decided("category") & (F.coalesce("category_citation", F.lit("")) == "")) | (decided("representation") & (F.coalesce("representation_citation", F.lit("")) == ""))),
        ("revision-missing", F.col("revision").isNull()),
    )
    return joined.select("position_id", problem.alias("problem"))


def artifact_problems(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, candidate, problem) of candidates (doc, candidate, page, line, raw, parse_status, parsed, review_status, source_lines: array of
    (page, line, text)) against the lines (doc, page, line, text) of their artifact.

    A candidate's first source line is its own place, each source line stands on the page as it says, and its raw text is that of
    its source lines joined. Without source lines, its own line counts.
    """
    own = candidates.withColumn("__lines", F.when(F.size("source_lines") > 0, F.transform("source_lines", lambda x: F.struct(x["page"].alias("page"), x["line"].alias("line"), x["text"].alias("text")))))
    single = F.array(F.struct(F.col("page"), F.col("line"), F.lit(None).cast("string").alias("text")))
    cited = own.withColumn("__lines", F.coalesce("__lines", single)).withColumn("__bare", F.coalesce(F.size("source_lines") <= 0, F.lit(True)))
    each = cited.select("doc", "candidate", "__bare", F.posexplode("__lines").alias("__at", "x")).select("doc", "candidate", "__bare", "__at", F.col("x.page").alias("page"), F.col("x.line").alias("line"), F.col("x.text").alias("told"))
    met = beside(each, lines.select("doc", "page", "line", F.col("text").alias("there")), ["doc", "page", "line"])
    wrong = F.col("there").isNull() | (~F.col("__bare") & ~F.col("told").eqNullSafe(F.col("there")))
    whole = met.groupBy("doc", "candidate").agg(F.bool_or(wrong).alias("__wrong"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "there"))), lambda x: x["there"]), "\n").alias("__text"))
    joined = beside(cited, whole, ["doc", "candidate"])
    first = F.col("__lines")[0]
    problem = first_reason(
        ("malformed-status", _no(F.col("parse_status").isin("parsed", "unparsed")) | _no(F.col("review_status") == "unreviewed") | ((F.col("parse_status") == "parsed") != F.col("parsed").isNotNull())),
        ("own-place-not-first", ~(first["page"].eqNullSafe(F.col("page")) & first["line"].eqNullSafe(F.col("line")))),
        ("line-differs", F.col("__wrong")),
        ("raw-text-differs", ~F.col("raw").eqNullSafe(F.col("__text"))),
    )
    return joined.select("doc", "candidate", problem.alias("problem"))


def selection_problems(members: DataFrame, selected: DataFrame, previous: DataFrame, others: DataFrame, supported: DataFrame, complete: bool) -> DataFrame:
    """(ref, problem) of a selection of versions of one event.

    ``members`` (ref, attempt, bib) is the event's inventory, ``selected`` (ref) what is to be shown, ``previous`` (ref) the inventory before,
    ``others`` (ref) what belongs to other events, ``supported`` (excluded, chosen) pairs that a replacement or equivalence covers. One
    version of an attempt at most is selected (with ``complete`` coverage exactly one); every other version of it needs support; nothing
    that was known may be left out.
    """
    tag = lambda rows, problem: rows.select("ref", F.lit(problem).alias("problem"))
    chosen = selected.select("ref").distinct()
    picks = members.join(chosen, "ref", "left_semi").groupBy("attempt").agg(F.count("*").alias("__n"), F.min("ref").alias("__chosen"))
    attempts = members.join(picks, "attempt", "left")
    bibs = members.groupBy("attempt").agg(F.count_distinct("bib").alias("__bibs")).where("__bibs > 1")
    unsupported = attempts.where("__n = 1 and ref <> __chosen").join(supported.select(F.col("excluded").alias("ref"), F.col("chosen").alias("__chosen")), ["ref", "__chosen"], "left_anti")
    parts = [
        tag(members.groupBy("ref").count().where("count > 1"), "repeated-member"),
        tag(selected.groupBy("ref").count().where("count > 1"), "repeated-selection"),
        tag(chosen.join(members, "ref", "left_anti"), "selected-outside-inventory"),
        tag(previous.join(members, "ref", "left_anti"), "previous-member-omitted"),
        tag(members.join(others, "ref", "left_semi"), "member-of-another-event"),
        tag(members.join(bibs, "attempt", "left_semi"), "conflicting-identifiers"),
        tag(attempts.where("__n > 1").join(chosen, "ref", "left_semi"), "several-versions-selected"),
        tag(unsupported, "excluded-without-relationship"),
    ]
    if complete:
        parts.append(tag(attempts.where("__n is null"), "attempt-without-version"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _printed(source: Column, coordinates: Column, line: Column, fields: Column) -> Column:
    """The exact key of a printed row; null where its line or fields are unknown. Variants are written with sorted keys."""
    whole = source.isNotNull() & line.isNotNull() & fields.isNotNull()
    return F.when(whole, F.sha2(F.concat_ws("\x1f", source, F.coalesce(F.to_json(coordinates), F.lit("null")), line, F.to_json(fields)), 256))


def retained_matches(candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """(candidate_id, position_id, status) of retained candidates (candidate_id, source_sha256, coordinates, line, fields) against imported positions
    (position_id, the same): exact by source, coordinates, printed line and fields.

    ``matched`` needs one position of that key which no other candidate has; else ``unmatched``, ``incomplete`` (no printed line or fields),
    ``ambiguous-position`` (several positions) or ``position-reused`` (several candidates).
    """
    key = _printed(F.col("source_sha256"), F.col("coordinates"), F.col("line"), F.col("fields"))
    held = positions.withColumn("__key", key).where("__key is not null").groupBy("__key").agg(F.count("*").alias("__n"), F.min("position_id").alias("position_id"))
    own = candidates.select("candidate_id", key.alias("__key"))
    uses = own.groupBy("__key").agg(F.count("*").alias("__uses"))
    joined = own.join(held, "__key", "left").join(uses, "__key", "left")
    status = F.when(F.col("__key").isNull(), "incomplete").when(F.col("__n").isNull(), "unmatched").when(F.col("__n") > 1, "ambiguous-position").when(F.col("__uses") > 1, "position-reused").otherwise("matched")
    return joined.select("candidate_id", F.when(status == "matched", F.col("position_id")).alias("position_id"), status.alias("status"))
