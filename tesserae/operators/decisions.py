"""Decisions over ledgers: gates, precedence, effective status, identity and label rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.reasons import first_reason
from tesserae.operators.graph import components, key_groups, reached
from tesserae.operators.ledger import latest
from tesserae.sources.stored import stored

#: The approval policy. What may be answered in each family (and unknown), the least confidence, probability
#: and margin of an approval, and the family that is never approved with its reason.
ANSWERS = {
    "identity": ("same-person", "different-person"),
    "same-attempt": ("same-attempt", "distinct-attempts"),
    "source-revision": ("left-revises-right", "right-revises-left", "same-source", "unrelated"),
    "category-representation": ("category", "representation", "both", "neither"),
    "row-semantics": ("attempt", "aggregate", "summary", "not-result"),
}
CONFIDENCE, PROBABILITY, MARGIN, SUM_TOLERANCE = 0.98, 0.97, 0.30, 0.00001
BLOCKED = {"row-semantics": "no-canonical-role-ledger"}


def _unit(x: Column) -> Column:
    return F.coalesce((x >= 0) & (x <= 1) & ~F.isnan(x), F.lit(False))


def approval(row: dict[str, Column]) -> Column:
    """The first of 13 ordered reasons against an automatic approval; ``thresholds-met`` if there is none.

    ``row`` names the columns: version, family, action, outcome, probabilities (map of answers to doubles), confidence,
    evidence_adequate and stale and error (booleans), conflicts (array). Whatever is unknown fails closed.
    """
    family, action, chances = row["family"], row["action"], row["probabilities"]
    answers = F.coalesce(*(F.when(family == f, F.array(*map(F.lit, (*names, "unknown")))) for f, names in ANSWERS.items()))
    selected = F.try_element_at(chances, action)
    others = F.array_max(F.map_values(F.map_filter(chances, lambda k, _: k != action)))
    total = F.aggregate(F.map_values(chances), F.lit(0.0), lambda a, x: a + x)
    closed = F.array_sort(F.map_keys(chances)) == F.array_sort(answers)
    valid = _unit(row["confidence"]) & closed & selected.isNotNull() & F.forall(F.map_values(chances), _unit) & (F.abs(total - 1) < SUM_TOLERANCE)
    holds = lambda x: F.coalesce(x, F.lit(False))
    return first_reason(
        ("invalid-policy", ~holds(row["version"] != "")),
        ("unsupported-action", ~holds(F.array_contains(answers, action) & (action != "unknown"))),
        ("stale-evidence", holds(row["stale"])),
        ("provider-error", holds(row["error"]) | holds(row["outcome"] == "error")),
        ("unknown-answer", holds(action == "unknown") | holds(row["outcome"] == "unknown")),
        ("inadequate-evidence", ~holds(row["evidence_adequate"])),
        ("conflicting-evidence", holds(F.size(row["conflicts"]) > 0)),
        ("unexpected-answer", ~holds(action == row["outcome"])),
        ("invalid-answer", ~holds(valid)),
        *((reason, holds(family == f)) for f, reason in BLOCKED.items()),
        ("low-confidence", row["confidence"] < CONFIDENCE),
        ("low-probability", selected < PROBABILITY),
        ("close-alternative", selected - others < MARGIN),
        otherwise="thresholds-met",
    )


def appended(state: DataFrame, events: DataFrame, key: str, revision: str) -> DataFrame:
    """``events`` with a verdict: accepted where they continue their key's revision (the state's, or 0) without a gap,
    rejected from the first gap or repetition on. One writer a batch."""
    base = state.groupBy(key).agg(F.max(revision).alias("__base"))
    place = F.row_number().over(W.partitionBy(key).orderBy(revision))
    bad = F.max(F.when(F.col(revision) != F.coalesce("__base", F.lit(0)) + F.col("__place"), 1).otherwise(0))
    rows = events.join(base, key, "left").withColumn("__place", place)
    return rows.withColumn("verdict", F.when(bad.over(W.partitionBy(key).orderBy(revision)) == 1, "rejected").otherwise("accepted")).drop("__base", "__place")


def by_precedence(found: DataFrame, key: str, route: str, order: list[str]) -> DataFrame:
    """One row of each key: that of the first route in ``order`` that has one (human before rules before cached ...)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(route))
    rest = [c for c in found.columns if c != key]
    return found.where(place > 0).groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("__x")).select(key, "__x.*")


def effective(decisions: DataFrame, needs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, status): accepted decisions stay accepted only while their evidence is there and all they depend on, however
    far, is accepted; else they are invalidated. Other statuses stay.

    What fails is sent on along dependencies, so the work grows with what is lost, not with all pairs that depend on each other."""
    bare = decisions.join(evidence.select("id"), "id", "left_anti").select("id")
    lost = bare.unionByName(decisions.where("status <> 'accepted'").select("id")).select(F.col("id").alias("node"))
    bad = reached(needs, lost, "needs", "id").select(F.col("node").alias("id"), F.lit(True).alias("__bad"))
    status = F.when((F.col("status") == "accepted") & F.col("__bad"), "invalidated").otherwise(F.col("status"))
    return decisions.join(bad, "id", "left").select("id", status.alias("status"))


def impact(decisions: DataFrame, needs: DataFrame, reversed_id) -> DataFrame:
    """Accepted decisions that a reversal of ``reversed_id`` would invalidate."""
    start = decisions.sparkSession.range(1).select(F.lit(reversed_id).cast(decisions.schema["id"].dataType).alias("node"))
    behind = reached(needs, start, "needs", "id").where("steps > 0").select(F.col("node").alias("id"))
    return decisions.where("status = 'accepted'").join(behind, "id", "left_semi").select("id")


def _outcome(broken: Column) -> Column:
    """materialized, or what keeps a decision from it."""
    return first_reason(
        ("reversed", F.col("active") & (F.col("failing").isNotNull() | broken)),
        ("unresolved", F.col("failing").isNotNull()),
        ("blocked", broken),
        otherwise="materialized",
    )


def applied(decisions: DataFrame, needs: DataFrame) -> DataFrame:
    """(id, outcome, reason) of decisions (id, failing: a reason of its own or null, active: applied before).

    A decision is materialized if neither it nor anything it needs, however far, fails. Else it is reversed if it was
    applied before; if not, unresolved for a reason of its own, or blocked by what it needs (``dependency-unapproved``). A
    need that is not listed fails.
    """
    missing = needs.join(decisions.select(F.col("id").alias("needs")), "needs", "left_anti").select(F.col("id").alias("node"))
    own = decisions.where("failing is not null").select(F.col("id").alias("node"))
    # steps 0 are the failing ones themselves; what lacks a need is as good as one step away
    behind = reached(needs, own.unionByName(missing), "needs", "id")
    broken = behind.where("steps > 0").select(F.col("node").alias("id")).unionByName(missing.select(F.col("node").alias("id"))).distinct().withColumn("__broken", F.lit(True))
    rows = decisions.join(broken, "id", "left").withColumn("__broken", F.coalesce("__broken", F.lit(False)))
    return rows.select("id", _outcome(F.col("__broken")).alias("outcome"), F.coalesce("failing", F.when(F.col("__broken"), "dependency-unapproved")).alias("reason"))


def reapplied(before: DataFrame, decisions: DataFrame, needs: DataFrame, changed: DataFrame) -> DataFrame:
    """What ``applied`` returns, from its last result ``before`` and the ids (id) of decisions that are new or have changed since,
    or whose needs have: only these and what needs them, however far, is judged again.

    ``active`` of a decision that has not changed must be as it was.
    """
    touched = stored(reached(needs, changed.select(F.col("id").alias("node")), "needs", "id").select(F.col("node").alias("id")), "touched")
    inner = needs.join(touched, "id", "left_semi")
    # a need outside of what is touched keeps its outcome: if it is not materialized, it counts as failing
    standing = before.join(touched, "id", "left_anti")
    firm = standing.where("outcome = 'materialized'").select(F.col("id").alias("needs")).unionByName(touched.select(F.col("id").alias("needs")))
    blocked = inner.join(firm, "needs", "left_anti").select("id").distinct()
    within = inner.join(touched.select(F.col("id").alias("needs")), "needs", "left_semi")
    own = decisions.join(touched, "id", "left_semi")
    starts = own.where("failing is not null").select(F.col("id").alias("node")).unionByName(blocked.select(F.col("id").alias("node")))
    behind = reached(within, starts, "needs", "id").where("steps > 0").select(F.col("node").alias("id"))
    broken = behind.unionByName(blocked).distinct().withColumn("__broken", F.lit(True))
    rows = own.join(broken, "id", "left").withColumn("__broken", F.coalesce("__broken", F.lit(False)))
    again = rows.select("id", _outcome(F.col("__broken")).alias("outcome"), F.coalesce("failing", F.when(F.col("__broken"), "dependency-unapproved")).alias("reason"))
    return standing.unionByName(again)


def stable(rows: DataFrame, links: DataFrame, rule: Column, key: str) -> DataFrame:
    """The largest set of rows that satisfy ``rule`` and whose links (key, needs) all lead to rows of the set: rows that
    need a missing one drop out until nothing changes."""
    kept = stored(rows.where(rule).select(key), "eligible")
    count = kept.count()
    while True:
        lost = links.join(kept.select(F.col(key).alias("needs")), "needs", "left_anti").select(key).distinct()
        kept = stored(kept.join(lost, key, "left_anti"), "eligible", kept)
        if (now := kept.count()) == count:
            return rows.join(kept, key, "left_semi")
        count = now


def identity_decision(retrieved: DataFrame, people: DataFrame, id_col: str) -> DataFrame:
    """(id, decision) from retrieval rows (id, candidate, route, contradicts, supported): no-candidate, unsupported,
    contradiction, ambiguous, weak-route, or link."""
    seen = retrieved.groupBy(id_col).agg(
        F.count_distinct("candidate").alias("n"), F.bool_or("contradicts").alias("bad"), F.bool_and("supported").alias("known"), F.bool_or(F.col("route") == "publisher-id").alias("strong")
    )
    decision = first_reason(
        ("no-candidate", F.col("n").isNull()), ("unsupported", ~F.col("known")), ("contradiction", F.col("bad")), ("ambiguous", F.col("n") > 1), ("weak-route", ~F.col("strong")), otherwise="link"
    )
    return people.select(id_col).join(seen, id_col, "left").select(id_col, decision.alias("decision"))


def recheck(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Automatic links (id, candidates_hash) whose candidate set is another one now: (id, action reverse)."""
    now = candidates.groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("candidate").cast("string"))), ","), 256).alias("now"))
    return links.where("actor = 'automatic'").join(now, "id", "left").where(~F.col("candidates_hash").eqNullSafe(F.col("now"))).select("id", F.lit("reverse").alias("action"))


def exported_labels(labels: DataFrame, names: DataFrame) -> DataFrame:
    """The last label of each pair, with a status: excluded (unknown or revoked), conflict (a group of pairs that share a
    name disagrees), duplicate (not the first of its group), or exported."""
    last = latest(labels, ["pair"], ["revision"])
    grouped = last.join(key_groups(names, "pair", "names").withColumnRenamed("node", "pair").withColumnRenamed("component", "group"), "pair", "left").withColumn("group", F.coalesce("group", "pair"))
    usable = F.col("label").isin("match", "no-match")
    window = W.partitionBy("group", usable)
    status = first_reason(("excluded", ~usable), ("conflict", F.min("label").over(window) != F.max("label").over(window)), ("duplicate", F.col("pair") != F.min("pair").over(window)), otherwise="exported")
    return grouped.withColumn("status", status).select("pair", "label", "group", "status")


def packed(rows: DataFrame, key: str, order: str, size: str, most_rows: int, most_size: int) -> DataFrame:
    """batch: number of the request a row goes into, filled in order until a count or size bound; a row beyond the size
    bound goes alone. Order matters, so each key is one pandas group: keys must be bounded units such as a run."""
    out = rows.withColumn("batch", F.lit(0).cast("long"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        batch, n, total, numbers = 0, 0, 0, []
        for s in frame[size]:
            if n and (n == most_rows or total + s > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            numbers.append(batch)
        return frame.assign(batch=numbers)

    return out.groupBy(key).applyInPandas(run, out.schema)


def attempt_groups(rows: DataFrame, id_col: str, same_position: DataFrame, same_scope: DataFrame, accepted: DataFrame) -> DataFrame:
    """(node, component): attempts united by position, by scope or by an accepted link; others alone."""
    edges = same_position.select("left", "right").unionByName(same_scope.select("left", "right")).unionByName(accepted.select("left", "right"))
    linked = components(edges, "left", "right")
    return rows.select(F.col(id_col).alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def relationship(edges: DataFrame) -> DataFrame:
    """(left, right, kind): one kind a pair by the ladder same-bytes, same-position, cited; contradictions are unknown."""
    kinds = edges.groupBy("left", "right").agg(F.collect_set("kind").alias("kinds"))
    has = lambda k: F.array_contains("kinds", k)
    kind = F.when(has("refuted") & (F.size("kinds") > 1), "unknown").when(has("same-bytes"), "equivalent").when(has("same-position"), "same-attempt").when(has("cited"), "dependent").otherwise("unknown")
    return kinds.select("left", "right", kind.alias("kind"))


def revision_match(before: DataFrame, after: DataFrame, scope: list[str], name: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, match, class): possible-revision by scope and name, else name-only, else unmatched; a class with several
    partners is ambiguous."""
    exact = before.join(after.select(*scope, name, F.col(right_id).alias("e")), [*scope, name]).groupBy(left_id).agg(F.count("*").alias("n1"), F.min("e").alias("m1"))
    loose = before.select(left_id, name).join(after.groupBy(name).agg(F.count("*").alias("n2"), F.min(right_id).alias("m2")), name).select(left_id, "n2", "m2")
    both = before.select(left_id).join(exact, left_id, "left").join(loose, left_id, "left")
    kind = F.when(F.col("n1") > 1, "ambiguous").when(F.col("n1") == 1, "possible-revision").when(F.col("n2") > 1, "ambiguous").when(F.col("n2") == 1, "name-only").otherwise("unmatched")
    match = F.when(F.col("n1") == 1, F.col("m1")).when(F.col("n1").isNull() & (F.col("n2") == 1), F.col("m2"))
    return both.select(left_id, match.alias("match"), kind.alias("class"))


def frontier(leads: DataFrame, done: DataFrame) -> DataFrame:
    """(digest, sources, state): leads merged by digest, unchecked where no disposition names them."""
    merged = leads.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return merged.join(done.groupBy("digest").agg(F.max_by("state", "revision").alias("state")), "digest", "left").select("digest", "sources", F.coalesce("state", F.lit("unchecked")).alias("state"))


def checked_answers(answers: DataFrame, json_col: str, known: list[str]) -> DataFrame:
    """error: the first check that an answer fails, null if none. An answer is a JSON object with ``choice`` (one of
    ``known``), ``confidence`` (0 to 1) and ``evidence`` (a non-empty list of texts)."""
    kind = "struct<choice:string,confidence:decimal(9,6),evidence:array<string>>"
    a = F.from_json(json_col, kind)
    error = first_reason(
        ("missing", F.col(json_col).isNull()),
        ("not-json", F.try_parse_json(json_col).isNull()),
        ("no-choice", F.col("__a.choice").isNull()),
        ("unknown-choice", ~F.col("__a.choice").isin(*known)),
        ("no-confidence", F.col("__a.confidence").isNull()),
        ("confidence-out-of-range", ~F.col("__a.confidence").between(0, 1)),
        ("no-evidence", F.coalesce(F.size("__a.evidence"), F.lit(0)) < 1),
        ("repeated-evidence", F.size(F.array_distinct("__a.evidence")) < F.size("__a.evidence")),
    )
    return answers.withColumn("__a", a).withColumn("error", error).drop("__a")


def provider_rules(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """outcome of the rules provider: match for a shared authority id, no-match for two different ones, else abstain."""
    a, b = F.col(left), F.col(right)
    return pairs.withColumn("outcome", F.when(a == b, "match").when(a != b, "no-match").otherwise("abstain"))


def upserted(existing: DataFrame, batch: DataFrame, keys: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): new keys once each; keys whose payload differs from the stored or from each other."""
    every = existing.select(*keys, payload).unionByName(batch.select(*keys, payload))
    bad = every.groupBy(*keys).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")
    fresh = batch.join(existing.select(*keys), keys, "left_anti").join(bad, keys, "left_anti").dropDuplicates(keys)
    return fresh, bad

