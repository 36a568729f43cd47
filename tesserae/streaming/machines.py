"""Keyed state machines on streams: versioned compare-and-set with idempotent requests.

The state of a key is its revision and state, and the requests it has seen; it lives in the state store and is restored from
the checkpoint after a restart. Verdicts depend on the order of a key's events only, not on how batches cut the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps values and maps a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Machine(StatefulProcessor):
    def __init__(self, key: str, start: str, moves: dict[tuple[str, str], str]):
        self.key, self.begin, self.moves = key, start, moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "revision long, state string")
        self.seen = handle.getMapState("seen", "id string", "digest string, revision long, verdict string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # a key without state has seen no request, and what this batch has seen is at hand: the store is asked for the rest only
        first, answered = not self.now.exists(), {}
        revision, state = (0, self.begin) if first else self.now.get()
        events = pd.concat(list(rows)).sort_values("n", kind="stable")
        out = []
        for n, ident, base, action, digest in zip(events["n"], events["id"], events["base"], events["action"], events["digest"], strict=True):
            known = answered.get(ident)
            if known is None and not first and self.seen.containsKey((ident,)):
                known = self.seen.getValue((ident,))
            if known is not None:
                old_digest, old_revision, old_verdict = known
                # a retry gets the first answer again; another request under its id gets none
                verdict, at = (f"repeated-{old_verdict}", old_revision) if old_digest == digest else ("conflicting-id", revision)
            else:
                move = self.moves.get((state, action))
                verdict = "stale" if base != revision else "invalid" if move is None else "accepted"
                if verdict == "accepted":
                    revision, state = revision + 1, move
                at = revision
                answered[ident] = (digest, int(revision), verdict)
                self.seen.updateValue((ident,), answered[ident])
            out.append((key[0], int(n), ident, verdict, int(at), state))
        self.now.update((int(revision), state))
        yield pd.DataFrame(out, columns=[self.key, "n", "id", "verdict", "revision", "state"])

    def close(self) -> None:
        pass


def compare_and_set(events: DataFrame, key: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """(key, n, id, verdict, revision, state) of a stream of requests (key, n, id, base, action, digest).

    A request moves its key from one state to the next if ``base`` is the key's revision (else ``stale``) and ``moves`` has
    (state, action) (else ``invalid``); then the revision grows by one. A request whose id was seen before with the same digest is ``repeated-``
    with the first verdict and revision; with another digest it is ``conflicting-id``. A key's requests are taken by n within
    a batch, and a later batch is later. Requests without a key, n or id are left out, as nothing could repeat or order them.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    ready = events.where(f"`{key}` is not null and n is not null and id is not null").selectExpr(
        f"`{key}`", "cast(n as long) n", "cast(id as string) id", "coalesce(cast(base as long), -1) base", "coalesce(cast(action as string), '') action", "coalesce(cast(digest as string), '') digest"
    )
    schema = f"`{key}` {kind}, n long, id string, verdict string, revision long, state string"
    return ready.groupBy(key).transformWithStateInPandas(_Machine(key, start, moves), schema, "append", "None")
