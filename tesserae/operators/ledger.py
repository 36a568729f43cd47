"""Append-only ledgers: current state, validity of appends, and version histories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.operators.ordering import known_before


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key by ``order``; no sort of whole keys, a maximum with map-side combine."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


def active(events: DataFrame, id_col: str, action_col: str, target_col: str, accept: str = "accept", reverse: str = "reverse") -> DataFrame:
    """Accepts that no reversal names."""
    gone = events.where(F.col(action_col) == reverse).select(F.col(target_col).alias("__gone"))
    return events.where(F.col(action_col) == accept).join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def field_states(decisions: DataFrame, keys: list[str], revision: str = "revision") -> DataFrame:
    """Current value of each field from decisions (action, event_id, target, before, after).

    An approval pushes its ``after``; a reversal takes back the approval it targets, which must be the active one, and so
    restores what was active before it, at the bottom that proposal's ``before``; a rejection changes nothing. Decisions
    that break this are counted as violations.
    """
    kind = decisions.schema[revision].dataType
    parts = [F.col(revision)[f.name] for f in kind.fields] if isinstance(kind, StructType) else [F.col(revision)]
    texts = ["action", "event_id", "target", "before", "after"]
    order = [*(f"__rev{i}" for i in range(len(parts))), *texts]
    rows = decisions.select(*keys, *(c.alias(f"__rev{i}") for i, c in enumerate(parts)), *(F.col(c).cast("string").alias(c) for c in texts))
    kinds = ", ".join(f"`{k}` {decisions.schema[k].dataType.simpleString()}" for k in keys)

    def fold(group: tuple, events: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values(order, kind="stable", na_position="first")
        plain = lambda x: None if pd.isna(x) else x
        stack, value, violations = [], None, 0
        for action, ident, target, before, after in zip(*(events[c] for c in ("action", "event_id", "target", "before", "after")), strict=True):
            if action == "approve":
                stack.append((plain(ident), plain(before)))
                value = plain(after)
            elif action == "reverse":
                if stack and stack[-1][0] == plain(target):
                    value = stack.pop()[1]
                else:
                    violations += 1
        return pd.DataFrame([(*group, value, len(stack), violations)], columns=[*keys, "value", "depth", "violations"])

    # a key's decisions are one order and so one task's work, linear in their number
    return rows.groupBy(*keys).applyInPandas(fold, f"{kinds}, value string, depth long, violations long")


def preferred(events: DataFrame, keys: list[str], actor_col: str, order: list[str], human: str = "human") -> DataFrame:
    """The last event of each key, any human one before any automatic one."""
    return latest(events.withColumn("__human", (F.col(actor_col) == human).cast("int")), keys, ["__human", *order]).drop("__human")


def gaps(rows: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """(keys, revision, expected) where a revision does not follow its predecessor by one (the first must be 1)."""
    before = F.lag(revision).over(W.partitionBy(*keys).orderBy(revision))
    expected = F.coalesce(before, F.lit(0)) + 1
    return rows.withColumn("expected", expected.cast("long")).where(F.col(revision) != F.col("expected")).select(*keys, revision, "expected")


def broken_links(rows: DataFrame, keys: list[str], order: list[str], previous: str, head: str) -> DataFrame:
    """Receipts whose ``previous`` is not the ``head`` before them (the first must have none)."""
    before = F.lag(head).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("expected", before).where(~F.col(previous).eqNullSafe(F.col("expected")))


def running_budget(rows: DataFrame, keys: list[str], order: list[str], amount: str, limit: float) -> DataFrame:
    """spent (running sum, never refunded) and allowed (strictly below the limit before the reservation is made)."""
    spent = F.sum(amount).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("spent", spent).withColumn("allowed", F.col("spent") < limit)


def version_history(checks: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """status of each check: gap without a digest, first_version, unchanged_bytes, or changed_bytes against the last known
    digest."""
    before = F.col("__known")
    status = F.when(F.col(digest).isNull(), "gap").when(before.isNull(), "first_version").when(F.col(digest) == before, "unchanged_bytes").otherwise("changed_bytes")
    return known_before(checks, keys, order, digest, "__known").withColumn("version_status", status).drop("__known")


def forbidden_transitions(rows: DataFrame, keys: list[str], order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Rows whose step from the state before is not in ``allowed`` (before, after); a first row has no step."""
    stepped = rows.withColumn("before", F.lag(state).over(W.partitionBy(*keys).orderBy(*order))).where("before is not null")
    return stepped.join(F.broadcast(allowed.withColumnRenamed("after", state)), ["before", state], "left_anti")  # a fixed table of states


def fixed_windows(events: DataFrame, key: str, at: str, ident: str, seconds: int, most: int) -> DataFrame:
    """(key, ident, window_start, allowed): a key's window opens with its first event and the next one with the first event after
    it has closed; the first ``most`` events of a window are allowed. Events of one instant go by ``ident``.

    Where a window ends depends on where it began, so a key's events are one task's work; it steps from window to window,
    not from event to event.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, ident)}
    rows = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("__at"), ident)

    def windows(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__at", ident], kind="stable")
        times = rows["__at"].to_numpy()
        start, place, i = np.empty_like(times), np.empty_like(times), 0
        while i < len(times):
            end = int(np.searchsorted(times, times[i] + seconds * 1_000_000))
            start[i:end], place[i:end] = times[i], np.arange(end - i)
            i = end
        return pd.DataFrame({key: group[0], ident: rows[ident].to_numpy(), "start": start, "allowed": place < most})

    out = rows.where("__at is not null").groupBy(key).applyInPandas(windows, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, start long, allowed boolean")
    return out.select(key, ident, F.timestamp_micros("start").alias("window_start"), "allowed")


def fence(view: DataFrame, counts: DataFrame, recorded: DataFrame) -> DataFrame:
    """``view`` while the recorded counts equal the current ones, else no rows; both are one row of equal columns."""
    equal = F.lit(True)
    for c in recorded.columns:
        equal &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    valid = counts.alias("a").crossJoin(recorded.alias("b")).select(equal.alias("valid")).where("valid")  # one row each
    return view.join(F.broadcast(valid.select(F.lit(1).alias("__ok"))), F.lit(1) == F.col("__ok"), "left_semi")


def conflicts(requests: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, requests, fingerprints, conflict): a repeated key is a retry if the fingerprints agree, else a conflict."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.count_distinct(fingerprint).alias("fingerprints")).withColumn("conflict", F.col("fingerprints") > 1)
