"""Streaming queries over the tables as they are (availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.plans.registry import query
from tesserae.sources.stored import shared_folder
from tesserae.streaming import flows


def _run(spark, flow, name):
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return flows.drained(flow, f"{at}/rows", f"{at}/checkpoint")


def _events(spark, sf):
    return flows.stream(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT DISTINCT user_id FROM events")
def import_dedupe_stream(spark, sf):
    return _run(spark, flows.imports(_events(spark, sf).select("user_id"), "user_id"), "imports")


@query("SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def request_dedupe_stream(spark, sf):
    """One request of a user and day: what repeats it within two days is dropped, and state is held no longer."""
    asked = _events(spark, sf).select("user_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "at").withColumn("request", F.concat_ws("/", F.col("user_id").cast("string"), "day"))
    return _run(spark, flows.requests(asked, "request", "at", "2 days"), "requests").select("user_id", "day")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
s AS (SELECT user_id, event_id, i, floor(epoch(ts))::BIGINT AS t FROM e JOIN events USING (user_id, event_id)),
w AS (SELECT user_id, event_id, i, t, t AS opened, 1 AS place FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.event_id, s.i, s.t, CASE WHEN s.t >= w.opened + 86400 THEN s.t ELSE w.opened END, CASE WHEN s.t >= w.opened + 86400 THEN 1 ELSE w.place + 1 END FROM s JOIN w ON s.user_id = w.user_id AND s.i = w.i + 1)
SELECT user_id, event_id, place <= 2 AS allowed FROM w""")
def rate_limit_stream(spark, sf):
    return _run(spark, flows.rate_limited(_events(spark, sf), "user_id", "at", "event_id", 86400, 2), "rates")


@query("""WITH c AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS digest FROM documents),
x AS (SELECT *, last_value(digest IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT source, doc_id AS at, CASE WHEN digest IS NULL THEN 'gap' WHEN before IS NULL THEN 'first_version' WHEN digest = before THEN 'unchanged_bytes' ELSE 'changed_bytes' END AS status FROM x""")
def version_history_stream(spark, sf):
    docs = flows.stream(spark, sf, "documents").withColumn("digest", F.when(F.col("doc_id") % 6 != 0, F.col("lang")))
    return _run(spark, flows.versions(docs, "source", "doc_id", "digest"), "versions")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
g AS (SELECT user_id, min(ts) AS "begin", max(ts) + INTERVAL 12 HOURS AS "end", count(*) AS events FROM s GROUP BY user_id, n)
SELECT user_id, "begin", "end", events FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def session_stream(spark, sf):
    """Sessions that are closed when the stream is drained: the watermark is a day behind its last event."""
    return _run(spark, flows.sessions(_events(spark, sf).select("user_id", "at"), "user_id", "at", "12 hours", "1 day"), "sessions")
