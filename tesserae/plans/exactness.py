"""Queries of exact bindings, reviewers' comparisons, labels, the inspector and page contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import labels
from tesserae.operators import comparing, exact, inspector, refresh
from tesserae.plans.registry import query
from tesserae.plans.stores import public_results_current
from tesserae.sources import contexts
from tesserae.sources.tables import table

_text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))


@query("""WITH o AS (SELECT *, o_orderkey % 7 = 0 AS other, o_orderkey % 11 = 0 AS away, o_orderkey % 13 = 0 AS line FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 17 = 0 THEN 'missing-evidence' END, CASE WHEN other AND o_orderkey % 17 <> 0 THEN 'reference-changed' END, CASE WHEN away AND o_orderkey % 17 <> 0 THEN 'unmatched-context' END,
  CASE WHEN o_orderstatus = 'P' AND NOT away AND o_orderkey % 17 <> 0 THEN 'unsupported-scope' END, CASE WHEN o_orderkey % 19 = 0 THEN 'missing-facts' END, CASE WHEN line OR o_orderkey % 17 = 0 THEN 'fact-citation-changed' END) AS problems FROM o""")
def publication_bindings(spark, sf):
    """Orders as published rows: evidence that is missing or names another version, rows that are gone, facts that cite another line."""
    key = F.col("o_orderkey")
    sha = lambda *c: F.sha2(F.concat_ws("/", *c), 256)
    reference = ["result_id", "observation_id", "ordinal", "source_sha256", "artifact_sha256"]
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", sha(F.lit("result"), key.cast("string")).alias("result_id"), sha(F.lit("observation"), key.cast("string")).alias("observation_id"), F.lit(0).alias("ordinal"),
        sha(F.lit("source"), F.col("o_custkey").cast("string")).alias("source_sha256"), sha(F.lit("artifact"), F.col("o_custkey").cast("string")).alias("artifact_sha256"),
    )
    line = key.cast("int")
    fact = lambda name: F.struct(F.lit(name).alias("name"), "result_id", F.lit("p").alias("policy"), "source_sha256", "artifact_sha256", F.lit(1).alias("page"), F.when(key % 13 == 0, -1).otherwise(line).alias("line"))
    stated = F.array(*map(fact, exact.FACTS))
    facts = F.when(key % 19 == 0, F.slice(stated, 2, len(exact.FACTS))).otherwise(stated)
    place = [F.lit(1).alias("page"), line.alias("line"), F.lit(None).cast("int").alias("table"), F.lit(None).cast("int").alias("row")]
    retained = [_text("j", "o_orderkey").alias("job_id"), _text("c", "o_orderkey").alias("candidate_id")]
    rows = orders.select("o_orderkey", *reference, F.lit("AIDA").alias("federation"), F.lit("event").alias("event_id"), F.lit("view").alias("view_id"), facts.alias("facts"))
    evidence = orders.where(key % 17 != 0).select("result_id", F.when(key % 7 == 0, "other").otherwise(F.col("observation_id")).alias("observation_id"), *reference[2:], *retained, F.lit("v1").alias("parser_version"), *place)
    context = orders.where(key % 11 != 0).select(*retained, *reference[2:], *place, F.when(F.col("o_orderstatus") == "P", "2025").otherwise("2026").alias("year"), F.lit(None).cast("string").alias("public_id"))
    found = exact.publication_problems(rows, evidence, context, {"year": "2026"}, "p", named=("o_orderkey",))
    return found.select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query("""SELECT problem, count(*) AS refs, count_if(parser)::BIGINT AS parser_differs FROM (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'missing-observation' WHEN l_partkey % 7 = 0 THEN 'mismatched-observation' WHEN l_partkey % 11 = 0 THEN 'source-differs' END AS problem, l_partkey % 10 <> 0 AND l_returnflag = 'N' AS parser
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem)) GROUP BY problem""")
def revision_references(spark, sf):
    """Order lines as references of snapshot records to revisions by part."""
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").distinct()
    part = F.col("l_partkey")
    one = F.struct(F.col("l_partkey").cast("string").alias("job_id"), F.col("l_orderkey").alias("ordinal"), F.lit(None).cast("string").alias("source_sha256"), F.when(part % 7 == 0, "old").otherwise("now").alias("candidate_id"))
    records = refs.groupBy("l_orderkey", "l_returnflag", (part % 11 == 0).alias("far")).agg(F.collect_list(one).alias("refs"))
    records = records.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), "l_returnflag", F.col("far").cast("string")).alias("record_id"), F.when(F.col("far"), "other").otherwise("source").alias("source_sha256"), F.when(F.col("l_returnflag") == "N", "p/1").otherwise("p/2").alias("parser_version"), F.col("l_orderkey").cast("string").alias("citation"), "refs")
    revisions = refs.where(part % 10 != 0).select(F.col("l_partkey").cast("string").alias("job_id"), F.col("l_orderkey").alias("ordinal"), F.lit("source").alias("source_sha256"), F.lit("p/2").alias("parser_version"), F.lit("now").alias("candidate_id")).distinct()
    found = exact.revision_problems(records, revisions, ["candidate_id"])
    return found.groupBy("problem").agg(F.count("*").alias("refs"), F.count_if("parser_differs").alias("parser_differs"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), c AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line FROM d)
SELECT doc_id, line, CASE WHEN line % 5 = 0 THEN 'malformed-status' WHEN line % 7 = 0 THEN 'line-differs' WHEN line % 3 = 0 THEN 'raw-text-differs' END AS problem FROM c""")
def artifact_evidence(spark, sf):
    """The lines of all documents as candidates that cite themselves, some wrongly."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc", F.lit(1).alias("page"), (F.col("line") + 1).alias("line"), "text")
    line = F.col("line")
    told = F.when(line % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    cited = F.when(line % 2 == 0, F.array(F.struct("page", "line", told.alias("text")))).when(line % 7 == 0, F.array(F.struct("page", "line", told.alias("text"))))
    candidates = pages.select(
        "doc", F.col("line").alias("candidate"), "page", "line", F.when(line % 3 == 0, F.lit("?")).otherwise(F.col("text")).alias("raw"), F.when(line % 5 == 0, "other").otherwise("parsed").alias("parse_status"), F.lit("{}").alias("parsed"), F.lit("unreviewed").alias("review_status"), cited.alias("source_lines")
    )
    return exact.artifact_problems(candidates, pages).select(F.col("doc").alias("doc_id"), F.col("candidate").alias("line"), "problem")


@query("""WITH m AS (SELECT p_partkey AS ref, p_name || p_brand AS attempt, p_size % 40 = 0 AS odd FROM part), g AS (SELECT attempt, min(ref) FILTER (NOT odd) AS best, count(DISTINCT odd) AS bibs FROM m GROUP BY attempt)
SELECT ref, 'excluded-without-relationship' AS problem FROM m JOIN g USING (attempt) WHERE best IS NOT NULL AND ref <> best AND ref % 3 <> 0
UNION ALL SELECT ref, 'conflicting-identifiers' FROM m JOIN g USING (attempt) WHERE bibs > 1 UNION ALL SELECT ref, 'attempt-without-version' FROM m JOIN g USING (attempt) WHERE best IS NULL""")
def selection_checks(spark, sf):
    """Parts as versions of attempts (name and brand): the first sound one of each is selected, some of the others are covered by a relationship."""
    members = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.concat("p_name", "p_brand").alias("attempt"), F.when(F.col("p_size") % 40 == 0, "b").otherwise("a").alias("bib"))
    best = members.where("bib = 'a'").groupBy("attempt").agg(F.min("ref").alias("chosen"))
    selected = best.select(F.col("chosen").alias("ref"))
    supported = members.where("ref % 3 = 0").join(best, "attempt").select(F.col("ref").alias("excluded"), "chosen")
    return exact.selection_problems(members, selected, members.select("ref"), members.select((-F.col("ref") - 1).alias("ref")), supported, True)


@query("""WITH b AS (SELECT o_orderkey, o_custkey, o_orderkey % 9 = 0 AS gone, o_orderkey % 4 = 0 AS other, o_orderkey % 6 = 0 AS less FROM orders),
t AS (SELECT *, CASE WHEN gone THEN 'only-first' WHEN other THEN 'status' ELSE '' END AS different, CASE WHEN NOT gone AND less THEN 'priority' ELSE '' END AS missing FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN different = '' AND missing = '' THEN sha256('seed:' || o_orderkey) END NULLS LAST) AS k, count_if(different = '' AND missing = '') OVER () AS n FROM t)
SELECT o_orderkey, different, missing, different = '' AND missing = '' AND k <= ceil(n / 10) AS sampled FROM r""")
def blind_positions(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    pair = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    first = orders.select("o_orderkey", F.map_from_entries(F.array_compact(F.array(pair("status", F.col("o_orderstatus")), F.when(key % 6 != 0, pair("priority", F.col("o_orderpriority")))))).alias("fields"))
    later = orders.where(key % 9 != 0).select("o_orderkey", key.cast("string").alias("position"), F.create_map(F.lit("status"), F.when(key % 4 == 0, "x").otherwise(F.col("o_orderstatus")), F.lit("priority"), F.col("o_orderpriority")).alias("fields"))
    out = comparing.blind_comparison(first, later, ["o_orderkey"], {"status": "status", "priority": "priority"}, "seed")
    return out.select("o_orderkey", F.array_join("different", ",").alias("different"), F.array_join("missing", ",").alias("missing"), "sampled")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, part, CASE WHEN part % 2 = 0 THEN part || '/1' END AS v1, CASE WHEN part % 3 = 0 THEN part || '/2' END AS v2, CASE WHEN part % 5 = 0 THEN part END AS diff, CASE WHEN part % 7 = 0 THEN 'kept' END AS decision FROM p WHERE n = 1""")
def version_table(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = ["l_orderkey", "l_linenumber"]
    version = lambda d, v: lines.where(F.col("l_partkey") % d == 0).select(*keys, F.concat(F.col("l_partkey").cast("string"), F.lit(f"/{v}")).alias("record_id"), F.lit(f"parser/{v}").alias("parser_version"))
    versions = version(2, 1).unionByName(version(3, 2)).unionByName(version(5, 3))
    out = comparing.versions_side_by_side(lines, versions, lines.where("l_partkey % 5 = 0").withColumnRenamed("l_partkey", "part"), lines.where("l_partkey % 7 = 0").select(*keys, F.lit("kept").alias("decision")), keys)
    return out.select(*keys, F.col("l_partkey").alias("part"), F.col("v1.record_id").alias("v1"), F.col("v2.record_id").alias("v2"), F.col("diff.part").alias("diff"), F.col("decision.decision").alias("decision"))


@query("""WITH r AS (SELECT l_returnflag AS source_name, l_linenumber <= 5 AS candidate, l_suppkey AS object, l_partkey AS version, CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN year(l_shipdate) IN (1999) THEN '2025' WHEN year(l_shipdate) = 2000 THEN '2026' ELSE 'outside_scope' END AS bucket FROM lineitem),
n AS (SELECT DISTINCT source_name FROM r UNION ALL SELECT NULL), b AS (SELECT unnest(['2025', '2026', 'unknown', 'outside_scope']) AS bucket)
SELECT n.source_name, b.bucket, count(r.bucket) AS candidate_positions, count(DISTINCT object) AS source_objects, count(DISTINCT version) AS observation_versions
FROM n CROSS JOIN b LEFT JOIN r ON candidate AND r.bucket = b.bucket AND (n.source_name IS NULL OR r.source_name = n.source_name) GROUP BY 1, 2""")
def year_denominators(spark, sf):
    year = F.year("l_shipdate")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source_name"), F.when(F.col("l_linenumber") <= 5, "candidate_position").otherwise("source").alias("kind"), F.col("l_suppkey").cast("string").alias("source_object_id"), F.col("l_partkey").cast("string").alias("observation_version"),
        F.when(F.col("l_linenumber") == 1, "unknown").when(year == 1999, "2025").when(year == 2000, "2026").otherwise("outside_scope").alias("year"),
    )
    return comparing.denominators(rows, F.col("year"))


@query("""SELECT count(DISTINCT (text, lang)) AS documents, count(*) - count(DISTINCT (text, lang)) AS duplicate_inputs, (SELECT count(*) FROM lineitem) AS known_positions, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS routed,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS gaps, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS unexamined_sections, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') + (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS exceptions,
  (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS rejected_claims FROM documents""")
def replay_totals(spark, sf):
    entries = table(spark, sf, "documents").select(F.sha2("text", 256).alias("source_sha256"), F.col("lang").alias("source_version"))
    positions = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") != "R", "routed").otherwise("gap").alias("status"))
    return comparing.replay_metrics(entries, positions, table(spark, sf, "orders").where("o_orderstatus = 'P'"), table(spark, sf, "customer").where("c_acctbal < 0"))


@query("""WITH s AS (SELECT user_id AS case_id, max(value / 100) AS score FROM events WHERE event_type <> 'error' AND value BETWEEN 0 AND 100 GROUP BY 1)
SELECT c_custkey AS case_id, score, row_number() OVER (ORDER BY score DESC NULLS LAST, c_nationkey, c_custkey) AS place FROM customer LEFT JOIN s ON case_id = c_custkey""")
def case_queue(spark, sf):
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("job_id"), F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("outcome"))
    share = F.col("value") / 100
    scores = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") != "error", "complete").otherwise("failed").alias("status"), share.alias("match"), (1 - share).alias("no_match"), F.lit(0.0).alias("abstain"))
    return comparing.queued_cases(cases, scores).select("case_id", "score", "place")


@query("""WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS r, CASE WHEN o_orderkey % 4 = 0 THEN '2-HIGH' WHEN o_orderkey % 4 = 1 THEN o_orderpriority END AS h FROM orders)
SELECT o_orderkey, CASE WHEN r <> h THEN 'row-heading-conflict' WHEN coalesce(r, h) IS NULL THEN 'missing-label' WHEN coalesce(r, h) NOT IN ('1-URGENT', '2-HIGH') THEN 'unmapped-label' ELSE 'explicit-dictionary-map' END AS rule,
  CASE WHEN NOT coalesce(r <> h, false) THEN CASE coalesce(r, h) WHEN '1-URGENT' THEN 'first' WHEN '2-HIGH' THEN 'second' END END AS value FROM l""")
def label_mapping(spark, sf):
    key = F.col("o_orderkey")
    dictionary = F.create_map(*map(F.lit, ("1-URGENT", "first", "2-HIGH", "second")))
    row, heading = F.when(key % 3 != 0, F.col("o_orderpriority")), F.when(key % 4 == 0, "2-HIGH").when(key % 4 == 1, F.col("o_orderpriority"))
    mapped = labels.mapped_label(row, heading, dictionary)
    return table(spark, sf, "orders").select("o_orderkey", mapped.alias("m")).select("o_orderkey", "m.rule", "m.value")


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1) AS names FROM pages)
SELECT page_id, len(names) AS names, CASE WHEN len(names) = 1 THEN trim(replace(replace(replace(replace(names[1], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) END AS event_name FROM h""")
def page_contexts(spark, sf):
    found = contexts.visible_names(table(spark, sf, "pages"), "page_id", "html")
    return found.select(F.col("id").alias("page_id"), F.size("names").cast("long").alias("names"), "event_name")


@query("""SELECT o_orderpriority AS sheet, (o_orderkey + 1)::INTEGER AS row, kind, o_orderpriority || '!' || 'A' || (o_orderkey + 1) || ':' || CASE kind WHEN 'placeholder' THEN 'A' WHEN 'result' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'C' END ELSE 'D' END || (o_orderkey + 1) AS citation, CASE kind WHEN 'result' THEN CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::VARCHAR END WHEN 'static' THEN o_orderstatus END AS measure
FROM orders, (VALUES ('result'), ('static'), ('placeholder')) v(kind) WHERE o_orderkey >= 1 AND CASE kind WHEN 'placeholder' THEN o_orderkey % 5 = 0 WHEN 'result' THEN o_orderkey % 5 <> 0 ELSE o_orderkey % 2 = 0 END""")
def workbook_kinds(spark, sf):
    """Orders as rows of a sheet for each priority: a rank in A, a name in B of most, a score in C of some, a time in D of some."""
    key = F.col("o_orderkey")
    cell = lambda column, when, value: F.when(when, F.struct(F.lit(column).alias("column"), value.cast("string").alias("value"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("string").alias("cached")))
    all_ = F.array_compact(F.array(cell("A", F.lit(True), key), cell("B", key % 5 != 0, F.col("o_custkey")), cell("C", key % 3 != 0, F.col("o_custkey")), cell("D", key % 2 == 0, F.col("o_orderstatus"))))
    cells = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sheet"), (key + 1).cast("int").alias("row"), F.inline(all_))
    rules = []
    for sheet in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        rules += [contexts.RowRule(sheet, "result", 2, "B", (("measure", "C"),), "ABC"), contexts.RowRule(sheet, "static", 2, "D", (("measure", "D"),), "AD"), contexts.RowRule(sheet, "placeholder", 2, "A", (("measure", "B"),), "AB", lacks="B")]
    return contexts.workbook_rows(cells, rules).select("sheet", "row", "kind", "citation", F.try_element_at("fields", F.lit("measure")).alias("measure"))


@query("""WITH d AS (SELECT 'd' || o_orderkey AS id, o_custkey AS job_id, o_orderkey % 2 AS ordinal, o_orderkey AS revision, CASE WHEN o_orderstatus = 'P' THEN 'revoke' ELSE 'validate' END AS action,
  o_orderpriority LIKE '5%' AS old, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS seen FROM orders),
r AS (SELECT c_custkey AS job_id, 0 AS ordinal, 1 AS revision FROM customer WHERE c_acctbal < 0), last AS (SELECT *, max(revision) OVER (PARTITION BY job_id, ordinal) = revision AS newest FROM d)
SELECT count(*) AS results, count(DISTINCT o_orderkey % 10) AS identities, 'pilot' AS scope, 'partial' AS completeness FROM orders JOIN last ON id = 'd' || o_orderkey
LEFT JOIN r ON r.job_id = last.job_id AND r.ordinal = last.ordinal WHERE newest AND action = 'validate' AND NOT old AND seen = coalesce(r.revision, 0) AND o_orderkey % 7 <> 0""")
def public_coverage(spark, sf):
    """The facade over the results that may be shown now."""
    shown = public_results_current(spark, sf).withColumn("identity_id", F.substring("result_id", -1, 1))
    return inspector.PublicResults(shown.withColumn("source_name", F.lit("n"))).coverage()


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, count(*) OVER (PARTITION BY l_partkey, l_linenumber, l_returnflag, l_quantity) AS uses FROM lineitem WHERE l_linenumber <= 2),
p AS (SELECT l_partkey, l_linenumber, l_returnflag, l_quantity, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 4 <> 0 GROUP BY ALL)
SELECT status, count(*) AS candidates FROM (SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'incomplete' WHEN p.n IS NULL THEN 'unmatched' WHEN p.n > 1 THEN 'ambiguous-position' WHEN uses_kept > 1 THEN 'position-reused' ELSE 'matched' END AS status
  FROM (SELECT *, count(*) FILTER (l_suppkey % 5 <> 0) OVER (PARTITION BY l_partkey, l_linenumber, l_returnflag, l_quantity) AS uses_kept FROM k) k LEFT JOIN p USING (l_partkey, l_linenumber, l_returnflag, l_quantity)) GROUP BY status""")
def retained_positions(spark, sf):
    """Order lines as retained candidates, keyed by part (source), line number (coordinates), return flag (printed line) and quantity (fields)."""
    lines = table(spark, sf, "lineitem").where("l_linenumber <= 2")
    number = F.col("l_quantity").cast("long").cast("string")
    kept = [F.col("l_partkey").cast("string").alias("source_sha256"), F.parse_json(F.concat(F.lit('{"row": '), F.col("l_linenumber").cast("string"), F.lit("}"))).alias("coordinates"), F.col("l_returnflag").alias("line"), F.parse_json(F.concat(F.lit('{"b": '), number, F.lit(', "a": 1}'))).alias("fields")]
    ident = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    candidates = lines.select(ident.alias("candidate_id"), *kept).withColumn("line", F.when(F.split("candidate_id", "/")[3].cast("long") % 5 != 0, F.col("line")))
    positions = lines.where("l_partkey % 4 <> 0").select(ident.alias("position_id"), *kept)
    return exact.retained_matches(candidates, positions).groupBy("status").agg(F.count("*").alias("candidates"))


@query("""WITH o AS (SELECT *, o_orderdate::DATE AS day, o_orderkey % 4 AS k FROM orders), x AS (SELECT *, DATE '2001-06-01' - day AS age, k = 0 AS provisional, CASE WHEN k = 0 THEN 1 WHEN k = 3 OR DATE '2001-06-01' - day <= 30 THEN 7 ELSE 90 END AS interval FROM o)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN k <> 3 AND day > DATE '2001-06-01' THEN NULL ELSE interval END AS interval_days,
  CASE WHEN o_orderstatus = 'P' THEN 'index_each_run' WHEN k <> 3 AND day > DATE '2001-06-01' THEN 'publication-in-the-future' WHEN o_custkey % 6 = 0 THEN 'never_checked'
    ELSE CASE WHEN k = 0 THEN 'provisional' WHEN k = 3 OR age <= 30 THEN 'recent_or_undated' ELSE 'stable' END || CASE WHEN o_custkey % 100 >= interval THEN '_due' ELSE '_not_due' END END AS reason FROM x""")
def refresh_plans(spark, sf):
    """Orders as results of publishers, pending ones as indexes; their last check lies up to 99 days back."""
    k, owner = F.col("o_orderkey") % 4, F.col("o_custkey")
    checked = F.date_format(F.date_sub(F.lit("2001-06-01").cast("date"), (owner % 100).cast("int")), "yyyy-MM-dd")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "index").otherwise("result").alias("kind"), F.when(k != 3, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("publication_date"), (k == 0).alias("provisional"),
        F.when(owner % 6 != 0, F.when(owner % 2 == 0, checked).otherwise(F.concat(checked, F.lit("T08:00:00Z")))).alias("last_check"),
    )
    return refresh.planned(rows, "2001-06-01").select("o_orderkey", "interval_days", "reason")
