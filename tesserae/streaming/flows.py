"""The ledgers as Structured Streaming: deduplication, delivery, rate limits and version histories.

Every flow takes a streaming DataFrame and returns one, or starts a query with its own checkpoint folder; ``drained`` runs
what is there and stops, for jobs that are called at intervals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def requests(events: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """One event a key within ``delay``: a retry inside it is dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def imports(events: DataFrame, key: str) -> DataFrame:
    """One event a key for ever; the keys seen are state."""
    return events.dropDuplicates([key])


def sessions(events: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    """(key, begin, end, events) of sessions that a pause of ``gap`` closes."""
    counted = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count("*").alias("events"))
    return counted.select(key, F.col("session.start").alias("begin"), F.col("session.end").alias("end"), "events")


def rate_limited(events: DataFrame, key: str, at: str, ident: str, seconds: int, most: int) -> DataFrame:
    """(key, ident, allowed): a key's window opens with its first event; ``most`` events of a window are allowed.

    State is two numbers a key. Events of one micro-batch are taken in order of time; a later batch is later.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["second", ident])
        allowed = []
        for second in rows["second"]:
            if opened is None or second >= opened + seconds:
                opened, n = int(second), 0
            n += 1
            allowed.append(n <= most)
        state.update((opened, n))
        yield pd.DataFrame({key: group[0], ident: rows[ident].to_numpy(), "allowed": allowed})

    ready = events.select(key, ident, F.unix_timestamp(F.col(at).cast("timestamp")).alias("second"))
    return ready.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ident} {events.schema[ident].dataType.simpleString()}, allowed boolean", "opened long, n long", "append", GroupStateTimeout.NoTimeout)


def versions(checks: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """(key, at, status): first_version, unchanged_bytes, changed_bytes or gap against the last known digest of the key."""
    kind = checks.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("at")
        found = []
        for value in rows["digest"]:
            if value is None or pd.isna(value):
                found.append("gap")
            else:
                found.append("first_version" if known is None else "unchanged_bytes" if value == known else "changed_bytes")
                known = value
        if known is not None:
            state.update((known,))
        yield pd.DataFrame({key: group[0], "at": rows["at"].to_numpy(), "status": found})

    ready = checks.select(key, F.col(at).cast("long").alias("at"), F.col(digest).cast("string").alias("digest"))
    return ready.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long, status string", "digest string", "append", GroupStateTimeout.NoTimeout)


def delivered(events: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """At-least-once delivery in order: ``deliver`` gets each batch with its number and must accept a repeated one; the
    checkpoint folder holds how far the target is."""
    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(flow: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a flow over what is there, append its rows to the table at ``path``, and read that table."""
    flow.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return flow.sparkSession.read.schema(flow.schema).parquet(path)


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder`` as a stream of its files (one file, or a folder of them)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")
