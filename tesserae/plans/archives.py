"""Queries of readers, snapshots, registries and review queues over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.operators import matching, queue, ranking, relationships, roster
from tesserae.operators.census import Registry
from tesserae.operators.facade import SnapshotQuery
from tesserae.plans.registry import query
from tesserae.sources import archive, documents
from tesserae.sources.stored import shared_folder
from tesserae.sources.tables import table


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def snapshot_round_trip(spark, sf):
    """A snapshot of the documents, replaced by one of all after one of a language, read back and verified."""
    path = _folder(spark, "snapshot")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))
    archive.write_snapshot(docs.where("lang = 'en'"), path)
    archive.write_snapshot(docs, path)
    return archive.read_snapshot(spark, path)


@query("SELECT c_custkey, c_name FROM customer")
def portable_copy(spark, sf):
    path = _folder(spark, "copy")
    archive.exported(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    return archive.restored(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def checked_csv(spark, sf):
    """Nations written as CSV and read with their header checked."""
    path = _folder(spark, "csv")
    table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    return documents.checked_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text, doc_id % 7 = 0 AS quarantined FROM documents")
def strict_texts(spark, sf):
    """Texts as bytes; every seventh is cut inside a character and set apart."""
    data = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(data, F.unhex(F.lit("C3")))).otherwise(data)
    return documents.strict_utf8(table(spark, sf, "documents").select("doc_id", broken.alias("content")), "content").select("doc_id", "text", "quarantined")


@query("""SELECT doc_id, text FROM documents WHERE lang <> 'en'""")
def imported_batches(spark, sf):
    """A batch repeats what is there already (by language) and adds the rest."""
    docs = table(spark, sf, "documents").select("lang", "doc_id", "text")
    return archive.imported(docs.where("lang = 'en'"), docs, "lang").select("doc_id", "text")


@query("""SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'unexpected' ELSE 'changed' END AS problem FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0)""")
def file_listing(spark, sf):
    """Orders as files: an index without some, files without others, some with another digest."""
    key = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(key.cast("string").alias("path"), F.sha2("o_orderpriority", 256).alias("sha256"), "o_orderkey")
    found = files.where("o_orderkey % 5 <> 0").withColumn("sha256", F.when(key % 3 == 0, "other").otherwise(F.col("sha256")))
    return archive.listing_mismatches(files.where("o_orderkey % 7 <> 0"), found)


@query("""SELECT o_orderkey, o_custkey % 40 AS object, CASE WHEN o_custkey % 40 < 30 THEN 'verified' ELSE 'missing' END AS state FROM orders""")
def acquisition_inventory(spark, sf):
    held = spark.range(30).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    own = F.col("o_custkey") % 40
    acquisitions = table(spark, sf, "orders").select("o_orderkey", own.alias("object"), F.sha2(own.cast("string"), 256).alias("sha256"))
    return archive.inventory(held, acquisitions).select("o_orderkey", "object", "state")


@query("""SELECT doc_id, parser, CASE parser WHEN 'english' THEN lang = 'en' WHEN 'long' THEN n_chars > 2000 ELSE source = 'src1' END AS claimed FROM documents, (VALUES ('english'), ('long'), ('first')) v(parser)""")
def parser_claims(spark, sf):
    return _registry().claims(table(spark, sf, "documents"), "doc_id")


def _registry():
    registry = Registry()
    registry.add("english", F.col("lang") == "en", lambda docs: docs.select("doc_id", F.lit("e").alias("mark")))
    registry.add("long", F.col("n_chars") > 2000, lambda docs: docs.select("doc_id", F.lit("l").alias("mark")))
    registry.add("first", F.col("source") == "src1", lambda docs: docs.select("doc_id", F.lit("f").alias("mark")))
    return registry


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'e' WHEN n_chars > 2000 THEN 'l' ELSE 'f' END AS mark, CASE WHEN lang = 'en' THEN 'english' WHEN n_chars > 2000 THEN 'long' ELSE 'first' END AS parser FROM documents WHERE lang = 'en' OR n_chars > 2000 OR source = 'src1'""")
def parser_registry(spark, sf):
    return _registry().parsed(table(spark, sf, "documents"))


@query("SELECT source AS source_name, count(*) AS records, count(DISTINCT lang) AS collections, max(strftime(DATE '2025-01-01' + (doc_id % 300)::INTEGER, '%Y-%m-%d')) AS newest FROM documents GROUP BY 1")
def facade_sources(spark, sf):
    date = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    records = table(spark, sf, "documents").select(F.col("source").alias("source_name"), F.col("lang").alias("collection"), date.alias("event_date"))
    return SnapshotQuery(records).sources()


_GROUPS = ("relationship", "unparsed_rows", "unmatched_daily", "source_relationship_gaps", "retained_only_artifacts", "assessed", "other")


@query("""WITH p AS (SELECT *, p_partkey % 7 AS c, p_size % 5 AS d FROM part)
SELECT 'queue:' || p_partkey AS id, CASE c WHEN 0 THEN CASE d WHEN 0 THEN 'source_revision_same_result' WHEN 1 THEN 'same_attempt_relationship' END WHEN 1 THEN 'extraction_source_semantics' WHEN 2 THEN 'same_attempt_relationship' WHEN 3 THEN 'event_publication' WHEN 4 THEN 'extraction_source_semantics'
  WHEN 5 THEN CASE WHEN d = 0 THEN 'source_revision_same_result' WHEN d = 1 THEN 'extraction_source_semantics' ELSE 'coverage_finality' END ELSE 'coverage_finality' END AS "group",
  CASE WHEN p_size % 3 = 0 THEN p_name WHEN c = 5 THEN CASE d WHEN 0 THEN 'duplicate_rendering' WHEN 1 THEN 'supplemental_aggregate' ELSE 'none' END WHEN c = 0 THEN CASE d WHEN 0 THEN 'same_result' ELSE 'same_attempt' END ELSE 'Explicit evidence record' END AS "trigger", CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS supporting,
  (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END + CASE WHEN (c = 0 AND d = 0) OR c = 3 OR (c = 5 AND d = 0) THEN 1 ELSE 0 END)::INTEGER AS unknown
FROM p WHERE c <> 0 OR d < 2""")
def review_queue(spark, sf):
    """Parts as records of every kind that falls into a group, with reasons and evidence of some."""
    c, d, size = F.col("p_partkey") % 7, F.col("p_size") % 5, F.col("p_size")
    field = lambda when, name, value: F.when(when, F.concat(F.lit(f'"{name}": "'), value, F.lit('"')))
    disposition = F.when(d == 0, "duplicate_rendering").when(d == 1, "supplemental_aggregate").otherwise("none")
    assessment = F.when(c == 5, F.concat(F.lit('"assessment": {"disposition": "'), disposition, F.lit('"}')))
    relation = F.when(d == 0, "same_result").when(d == 1, "same_attempt").otherwise("other")
    raw = F.concat(F.lit("{"), F.concat_ws(", ", field(size % 3 == 0, "reason", F.col("p_name")), field(size % 2 == 0, "basis", F.col("p_brand")), field(c == 0, "relationship_type", relation), assessment), F.lit("}"))
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.when(c == 0, "relationship").otherwise("gap").alias("kind"), F.lit(queue.UNMATCHED[0]).alias("source_name"), F.element_at(F.array(*map(F.lit, _GROUPS)), (c + 1).cast("int")).alias("collection"), F.parse_json(raw).alias("raw")
    )
    return queue.queue_items(rows).select("id", "group", "trigger", F.array_join("supporting", ",").alias("supporting"), F.size("unknown").alias("unknown"))


@query("""WITH a AS (SELECT o_orderkey AS id, sha256(o_custkey || '-' || (o_orderkey % 4)) AS sha, CASE WHEN o_orderkey % 9 <> 0 THEN 'p' END AS publisher, o_custkey AS url FROM orders),
c AS (SELECT id, min(id) OVER (PARTITION BY sha) AS anchor FROM a), v AS (SELECT publisher, url, sha, min(id) AS id FROM a WHERE publisher IS NOT NULL GROUP BY ALL), w AS (SELECT id, min(id) OVER (PARTITION BY publisher, url) AS anchor FROM v)
SELECT anchor AS "left", id AS "right", 'source-duplicate' AS kind, NULL AS reason FROM c WHERE id <> anchor UNION ALL SELECT anchor, id, 'unknown', 'possible-source-revision' FROM w WHERE id <> anchor""")
def version_relationships(spark, sf):
    """Orders as acquisitions of their customer's page: equal bytes, and other bytes at one URL that is written in two ways."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    url = F.when(key % 2 == 0, F.concat(F.lit("http://host/a/../"), owner)).otherwise(F.concat(F.lit("http://host/"), owner))
    rows = table(spark, sf, "orders").select(key.alias("acquisition_id"), F.sha2(F.concat_ws("-", owner, (key % 4).cast("string")), 256).alias("sha256"), F.when(key % 9 != 0, "p").alias("publisher"), url.alias("final_url"))
    return matching.version_relationships(rows)


@query("""SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place, c_custkey AS peer, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS peer_rank, count(*) OVER (PARTITION BY c_mktsegment) AS peers FROM customer WHERE c_acctbal > 0""")
def peer_lists(spark, sf):
    rows = table(spark, sf, "customer").withColumn("score", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return ranking.peer_lists(rows, "score", "c_custkey", "c_mktsegment")


@query("""WITH o AS (SELECT *, o_orderkey % 11 AS k, year(o_orderdate) AS y, '2025' || strftime(o_orderdate, '-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%m-%d') <> '02-29')
SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN 'unknown-route' WHEN o_orderstatus = 'P' THEN 'invalid-status' WHEN k = 1 THEN 'invalid-date' WHEN k = 2 AND day > '2025-01-01' THEN 'invalid-date-range' WHEN k = 3 THEN 'year-mismatch' WHEN k = 4 THEN 'date-without-evidence' WHEN k = 5 AND o_custkey % 2 = 0 THEN 'citation-not-of-receipt' WHEN k = 6 THEN 'missing-title' WHEN k = 7 THEN 'proven-and-candidate' END AS problem FROM o""")
def roster_rules(spark, sf):
    """Orders as leads of their customers' routes; each rule is broken by some."""
    k, key, owner = F.col("o_orderkey") % 11, F.col("o_orderkey"), F.col("o_custkey")
    day = F.concat(F.lit("2025"), F.date_format("o_orderdate", "-MM-dd"))
    orders = table(spark, sf, "orders").where("date_format(o_orderdate, 'MM-dd') <> '02-29'")
    one = lambda c: F.array(c)
    leads = orders.select(
        key.cast("string").alias("id"), owner.cast("string").alias("route_id"), F.when(F.col("o_orderstatus") == "P", "P").otherwise("checked").alias("status"), F.when(k != 6, F.col("o_orderpriority")).otherwise(" ").alias("title"), F.when(k == 1, "2025-02-30").otherwise(day).alias("competition_date"),
        F.when(k == 2, "2025-01-01").otherwise(F.lit(None).cast("string")).alias("competition_date_to"), F.when(k == 3, 2026).otherwise(2025).alias("competition_year"), F.when(k != 4, "page").alias("date_evidence"), F.when(k == 5, "other").otherwise("sha").alias("citation_sha256"), F.lit(None).cast("string").alias("relationship"),
        one(F.lit("s")).alias("snapshot_ids"), F.when(k == 7, one(F.lit("s"))).otherwise(one(F.lit("t"))).alias("candidate_snapshot_ids"), F.lit(None).cast("array<struct<at:string,status:string>>").alias("history"),
    )
    routes = table(spark, sf, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "sha").alias("receipt"))
    return roster.lead_problems(leads, routes, "2026-06-01T00:00:00Z").select(F.col("id").cast("long").alias("o_orderkey"), "problem")


@query("""WITH o AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS ref, l_orderkey AS source, l_linenumber AS line, l_returnflag AS text, l_linestatus AS parser, l_partkey % 2 AS parsed FROM lineitem WHERE l_linenumber > 1),
h AS (SELECT source, line, text, parser, parsed, min(ref) AS ref FROM o GROUP BY ALL)
SELECT h.ref AS "left", o.ref AS "right", 'source-duplicate' AS kind FROM o JOIN h USING (source, line, text, parser, parsed) WHERE o.ref <> h.ref
UNION SELECT a.ref, b.ref, CASE WHEN a.text <> b.text THEN 'unknown' WHEN a.parser <> b.parser THEN 'parser-revision' ELSE 'unknown' END FROM h a JOIN h b ON a.source = b.source AND a.line = b.line AND a.ref < b.ref""")
def classified_rows(spark, sf):
    """Order lines as observations of one place (order and line number): return flags as texts, statuses as parsers, parts as what was read."""
    text = lambda c: F.col(c).cast("string")
    ref = F.concat_ws("/", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.col("l_quantity").cast("long").cast("string"))
    observations = table(spark, sf, "lineitem").select(
        ref.alias("ref"), text("l_orderkey").alias("source_sha256"), F.lit(1).alias("page"), (F.col("l_linenumber") - 1).cast("int").alias("line"), F.col("l_returnflag").alias("source_text"), F.lit("e").alias("event_key"), F.lit("d").alias("discipline"), F.lit(None).cast("string").alias("day"),
        F.col("l_linestatus").alias("parser_version"), F.create_map(F.lit("part"), (F.col("l_partkey") % 2).cast("string")).alias("parsed"),
    )
    return relationships.automatic_edges(observations).select("left", "right", "kind").distinct()


@query("""SELECT 'incomplete-event' AS rule, 'e' || n_nationkey AS id FROM nation WHERE n_nationkey % 7 = 3 UNION ALL SELECT 'event-dates', 'e' || n_nationkey FROM nation WHERE n_nationkey % 5 = 4
UNION ALL SELECT 'unknown-event', 's' || s_suppkey FROM supplier WHERE s_suppkey % 6 = 5 UNION ALL SELECT 'source-media', 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 3 UNION ALL SELECT 'provenance-without-gap', 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 2
UNION ALL SELECT 'unknown-source', 'p' || l_orderkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) WHERE l_suppkey % 10 = 9 UNION SELECT 'duplicate-positions', 'p' || l_orderkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'gap-unknown-source', 'g' || c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 = 8 UNION ALL SELECT 'incomplete-gap', 'g' || c_custkey FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'relationship-kind', 'x' || o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT 'unknown-position', 'x' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""")
def census_rules(spark, sf):
    """Nations as events, suppliers as sources, first order lines as positions, customers as gaps, orders as relationships."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, s, c = F.col("n_nationkey"), F.col("s_suppkey"), F.col("c_custkey")
    lit = F.lit
    refs = F.array().cast("array<struct<job_id:string,ordinal:int,artifact_sha256:string,parser_version:string,citation:string>>")
    tables = {
        "events": table(spark, sf, "nation").select(text("e", "n_nationkey").alias("id"), lit("F").alias("federation"), F.when(n % 7 != 3, F.col("n_name")).alias("name"), F.when(n % 5 == 4, "2025-06-31").otherwise("2025-06-01").alias("held_from"), lit("2025-06-02").alias("held_to")),
        "sources": table(spark, sf, "supplier").select(
            text("s", "s_suppkey").alias("id"), F.array(F.when(s % 6 == 5, "gone").otherwise(text("e", "s_nationkey"))).alias("event_ids"), lit("official").alias("authority"), F.when(s % 4 == 3, "tape").otherwise("pdf").alias("media"), F.sha2("s_name", 256).alias("original_sha256"),
            F.when(s % 3 == 0, lit("q")).otherwise(F.lit(None).cast("string")).alias("acquisition_id"), lit("2025-01-01T00:00:00Z").alias("retrieved_at"), lit("u").alias("discovery_url"), lit("u").alias("final_url"), lit("v").alias("view_state"), lit("r").alias("view_ref"),
            F.when(s % 3 == 1, F.array(lit("lost"))).otherwise(F.array().cast("array<string>")).alias("provenance_gaps"),
        ),
        "positions": table(spark, sf, "lineitem").where("l_linenumber = 1").select(text("p", "l_orderkey").alias("id"), F.when(F.col("l_suppkey") % 10 == 9, "gone").otherwise(text("s", "l_suppkey")).alias("source_id"), lit("line").alias("locator"), lit("parsed").alias("status"), lit("{}").alias("raw_fields"), F.lit(None).cast("string").alias("unresolved_reason"), refs.alias("observation_refs")),
        "gaps": table(spark, sf, "customer").select(text("g", "c_custkey").alias("id"), F.when(c % 2 == 0, "source").otherwise("search").alias("scope"), F.when(c % 10 == 8, "gone").otherwise("s0").alias("ref"), F.when(F.col("c_acctbal") < 0, "?").otherwise("checked").alias("status"), lit("r").alias("reason")),
        "relationships": table(spark, sf, "orders").select(text("x", "o_orderkey").alias("id"), text("p", "o_orderkey").alias("left"), text("p", "o_orderkey").alias("right"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("same-attempt").alias("kind"), lit("exact").alias("status"), lit("b").alias("basis")),
    }
    return relationships.census_violations(tables)
