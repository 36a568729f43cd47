"""Queries of single facts: codes, cohorts, canonical forms, differences, record kinds, cells of source formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import facts, names, scalars
from tesserae.operators import records, snapshot
from tesserae.operators.ordering import spread
from tesserae.plans.registry import query
from tesserae.sources import documents
from tesserae.sources.tables import table


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'europe' WHEN 1 THEN 'asia' WHEN 2 THEN 'americas' WHEN 3 THEN 'oceania' WHEN 4 THEN 'africa' WHEN 5 THEN 'asia' END AS continent FROM customer""")
def sports_continents(spark, sf):
    codes = F.array(*map(F.lit, ("FRA", "PHL", "BRA", "AUS", "RSA", "JPN", "fra", "AIN")))
    return table(spark, sf, "customer").select("c_custkey", facts.sports_continent(F.get(codes, F.col("c_custkey") % 8)).alias("continent"))


@query("""SELECT upper(event_type) AS discipline, CASE user_id % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'MALE' ELSE 'MIXED' END AS gender, 'a' || user_id AS athlete, count(*) AS n FROM events GROUP BY ALL""")
def collision_keys(spark, sf):
    gender = F.get(F.array(*map(F.lit, (" m", "Women", "men ", "mixed"))), F.col("user_id") % 4)
    nothing = F.lit(None).cast("string")
    key = facts.collision_key(nothing, nothing, nothing, F.concat(F.lit(" "), F.col("event_type")), gender, F.concat(F.lit("A"), F.col("user_id").cast("string")))
    return table(spark, sf, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n")).select("key.discipline", "key.gender", "key.athlete", "n")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'card,source-name' ELSE 'source-name' END AS fields, CASE WHEN doc_id % 5 = 0 THEN lang ELSE source END AS name FROM documents""")
def public_projection(spark, sf):
    i = F.col("doc_id")
    cells = F.create_map(
        F.lit("Name"), F.col("source"), F.lit("Diver"), F.when(i % 5 == 0, F.col("lang")), F.lit("Card"), F.when(i % 3 == 0, F.lit("WHITE")), F.lit("Remarks"), F.lit("private"), F.lit("Other"), F.lit("x")
    )
    headers = {"Name": "source-name", "Diver": "source-name", "Card": "card", "Remarks": "remarks"}
    shown = facts.public_fields(facts.renamed_headers(cells, headers), ["source-name", "card"])
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(shown)), ",").alias("fields"), shown["source-name"].alias("name"))


@query("""SELECT o_orderkey, o_orderkey % 4 <> 3 AND o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AND year(o_orderdate) = 1996 AS target FROM orders""")
def target_cohort(spark, sf):
    i = F.col("o_orderkey")
    category = F.get(F.array(*map(F.lit, ("SENIORS - WOMEN", "SENIORS – WOMEN", "SENIORS — WOMEN", "SENIORS WOMEN"))), i % 4)
    date = F.when(i % 7 == 0, "1996-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", facts.target_cohort(F.col("o_orderstatus"), F.lit("DNF"), date, category, ("O", "DNF", 1996)).alias("target"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'result-row' WHEN event_id % 2 = 0 THEN 'fragment' ELSE 'unclassified' END AS class FROM events""")
def observation_classes(spark, sf):
    i = F.col("event_id")
    fields = F.when(i % 5 == 0, F.create_map(F.lit("line"), F.lit("x")))
    line = F.when(i % 2 == 0, " fi ").otherwise("fin")
    return table(spark, sf, "events").select("event_id", facts.observation_class(F.when(i % 3 == 0, "parsed").otherwise("unparsed"), fields, line, ["fi"]).alias("class"))


@query("""SELECT l_orderkey, l_linenumber, NOT (l_returnflag = l_linestatus AND l_partkey <> l_suppkey) AND (l_orderkey % 3 = 0 OR l_orderkey % 2 = l_linenumber % 2) AS compatible FROM (SELECT * REPLACE (CASE WHEN l_returnflag = 'N' THEN 'O' ELSE l_returnflag END AS l_returnflag) FROM lineitem)""")
def identity_compatibility(spark, sf):
    scheme = F.when(F.col("l_returnflag") == "N", "O").otherwise(F.col("l_returnflag"))
    sex = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 2)
    fits = facts.identity_compatible(scheme, F.col("l_partkey"), F.col("l_linestatus"), F.col("l_suppkey"), sex, F.col("l_linenumber") % 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fits.alias("compatible"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 AND p_brand <> 'Brand#13' THEN 'snapshot-binding-mismatch' END, CASE WHEN p_partkey % 3 = 0 THEN 'missing-observation-store-revision' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'missing-decision-store-revision' END, CASE WHEN p_partkey % 7 = 0 THEN 'missing-decision-api-mapping' END) AS blockers FROM part""")
def replay_blockers(spark, sf):
    i = F.col("p_partkey")
    found = facts.replay_blockers(
        F.lit("Brand#13"), F.when(i % 2 == 0, F.col("p_brand")), F.when(i % 3 != 0, "r1").otherwise(""), F.when(i % 5 != 0, "r2"), F.when(i % 7 != 0, F.create_map(F.lit("a"), F.lit("b")))
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(found, ",").alias("blockers"))


@query("""SELECT event_id FROM events WHERE event_type = 'purchase' OR (event_type = 'error' AND user_id % 2 = 0)""")
def owner_queue(spark, sf):
    effective = F.when(F.col("event_type") == "purchase", "rejected").when(F.col("event_type") == "error", "projection_pending").otherwise("pending")
    status = F.when(F.col("user_id") % 2 == 0, "rejected").otherwise("reversed")
    return table(spark, sf, "events").where(facts.owner_queue_filter("rejected", effective, status)).select("event_id")


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN '{"a":{"m":1,"z":' || user_id || '},"k":"' || event_type || '"}' END AS canonical FROM events""")
def canonical_objects(spark, sf):
    text = F.concat(F.lit('{ "k": "'), F.col("event_type"), F.lit('", "a": {"z": '), F.col("user_id").cast("string"), F.lit(', "m" : 1}}'))
    return table(spark, sf, "events").select("event_id", facts.canonical_json(F.when(F.col("event_id") % 9 != 0, text).otherwise("{broken")).alias("canonical"))


@query("""SELECT event_id, 'a.x' AS field, true AS before_present, true AS after_present, user_id::VARCHAR AS before, (user_id + 1)::VARCHAR AS after FROM events WHERE event_id % 2 = 1
UNION ALL SELECT event_id, 'b', true, false, '"' || event_type || '"', NULL FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'c', true, true, '1', '1.0' FROM events WHERE event_id % 5 = 0""")
def object_differences(spark, sf):
    i, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    text = lambda x, b, c: F.concat(F.lit('{"a": {"x": '), x.cast("string"), F.lit("}"), b, F.lit(', "c": '), c, F.lit("}"))
    named = F.concat(F.lit(', "b": "'), kind, F.lit('"'))
    before = text(user, named, F.lit("1"))
    after = text(user + i % 2, F.when(i % 3 == 0, "").otherwise(named), F.when(i % 5 == 0, "1.0").otherwise("1"))
    return table(spark, sf, "events").select("event_id", F.explode(facts.json_differences(before, after)).alias("d")).select("event_id", "d.*")


@query("""SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS words FROM part""")
def label_words(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(facts.label_words(F.concat(F.lit(" "), F.regexp_replace("p_name", "o", "ó"), F.lit("!"))), " ").alias("words"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS metres, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS whole, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey + 0.5 END::DOUBLE AS real FROM orders""")
def cell_numbers(spark, sf):
    i, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    number = facts.cell_number(F.concat(n, F.when(i % 2 == 1, ".5").otherwise("")))
    metres = facts.integer_with_unit(F.concat(F.lit(" "), n, F.when(i % 3 == 0, " km").when(i % 3 == 1, " m ").otherwise("")), "m")
    return table(spark, sf, "orders").select("o_orderkey", metres.alias("metres"), number.alias("n")).select("o_orderkey", "metres", "n.whole", "n.real")


@query("""SELECT page_id, 'A & B ' || page_id AS cell FROM pages""")
def cell_texts(spark, sf):
    source = F.concat(F.lit("<td class='x'> A &amp;\n <b>B</b>&nbsp;"), F.col("page_id").cast("string"), F.lit("</td>"))
    return table(spark, sf, "pages").select("page_id", facts.cell_text(source).alias("cell"))


_KINDS = ["result_rows", "Overall_rows", "endpoint_records", "routes", "leads", "x_relationship", "sources", "unmatched_daily", "observation_versions", "pages.rows", "positions", "events", "limits", "candidate_versions", "retained_only"]


@query("""SELECT p_partkey, CASE p_partkey % 15 WHEN 0 THEN 'candidate_position' WHEN 1 THEN 'aggregate' WHEN 2 THEN 'endpoint_source_record' WHEN 3 THEN 'discovery_route' WHEN 4 THEN 'discovery_lead'
  WHEN 6 THEN 'source' WHEN 7 THEN 'gap' WHEN 8 THEN CASE WHEN p_size % 2 = 0 THEN 'observation_version' WHEN p_size % 3 = 0 THEN 'aggregate' ELSE 'candidate_position' END
  WHEN 9 THEN CASE WHEN p_brand = 'Brand#11' THEN 'summary' WHEN p_brand = 'Brand#12' THEN 'repeated_position' WHEN p_size % 3 = 0 THEN 'aggregate' ELSE 'candidate_position' END
  ELSE CASE WHEN p_size % 3 = 0 THEN 'aggregate' ELSE CASE p_partkey % 15 WHEN 5 THEN 'relationship' WHEN 10 THEN 'candidate_position' WHEN 11 THEN 'event' WHEN 12 THEN 'other' WHEN 13 THEN 'candidate_position' WHEN 14 THEN 'gap' END END END AS kind FROM part""")
def record_kinds(spark, sf):
    collection = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 15).cast("int"))
    disposition = F.when(F.col("p_brand") == "Brand#11", "summary").when(F.col("p_brand") == "Brand#12", "duplicate_render").otherwise("row")
    obj = F.parse_json(F.concat(F.lit('{"disposition":"'), disposition, F.lit('","kind":"'), F.when(F.col("p_size") % 3 == 0, "standings").otherwise("row"), F.lit('"}')))
    schema = F.when(F.col("p_size") % 2 == 0, records.SUPPLEMENT)
    return spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")).select("p_partkey", records.kind(collection, obj, F.lit(None).cast("variant"), schema).alias("kind"))


@query("""SELECT p_partkey, 'p' || p_partkey AS source_id, 'sha256:' || sha256(p_brand) AS source_object_id, CASE WHEN p_size % 2 = 0 THEN '2026-06-01' ELSE '2026-05-30' END AS event_date, '2026-06-01' AS date_from,
  CASE WHEN p_size % 2 = 0 THEN '2026-06-01' ELSE '2026-06-02' END AS date_to, CASE WHEN p_size % 3 = 0 THEN 'evening' ELSE 'noon' END AS session, p_type AS category, p_size AS page,
  '{"line":1,"page":' || p_size || '}' AS citation_json, 'unreviewed' AS review_status, '{"a":"x","b":"' || p_type || '"}' AS raw_fields_json,
  '{"category":"' || p_type || '","depth":' || p_size || ',"note":null}' AS parsed_fields_json FROM part""")
def record_normalised(spark, sf):
    size, even = F.col("p_size").cast("string"), F.col("p_size") % 2 == 0
    obj = F.concat(
        F.lit('{"id": null, "position_id": "p'), F.col("p_partkey").cast("string"), F.lit('", "source_id": "'), F.sha2("p_brand", 256), F.lit('", "date_scope": ["2026-06-01", "'), F.when(even, "2026-06-01").otherwise("2026-06-02"),
        F.lit('"]'), F.when(F.col("p_size") % 3 == 0, ', "session": "evening"').otherwise(""), F.lit(', "parsed_fields": {"category": {"value": "'), F.col("p_type"),
        F.lit('"}, "note": {"raw": 1}, "depth": '), size, F.lit('}, "raw_fields": {"b": "'), F.col("p_type"), F.lit('", "a": "x"}, "fields": {"c": 1}, "locator": {"page": '), size, F.lit(', "line": 1}, "coordinates": {"page": '), size, F.lit("}}"),
    )
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")).select(
        "p_partkey", F.parse_json(obj).alias("obj"), F.parse_json(F.lit('{"session": "noon", "event_date": "2026-05-30", "page": 9999}')).alias("parent"), F.parse_json(F.lit("{}")).alias("root"), F.lit("candidate_position").alias("kind")
    )
    kept = ["source_id", "source_object_id", "event_date", "date_from", "date_to", "session", "category", "page", "citation_json", "review_status", "raw_fields_json", "parsed_fields_json"]
    return records.normalized(rows).select("p_partkey", *kept)


@query("""SELECT o_orderkey, place, CASE WHEN place = 0 THEN o_custkey ELSE o_custkey + 1 END AS id FROM orders, (VALUES (0), (1)) v(place)""")
def json_result_rows(spark, sf):
    text = F.concat(F.lit('{"data": {"rows": [{"id": '), F.col("o_custkey").cast("string"), F.lit('}, {"id": '), (F.col("o_custkey") + 1).cast("string"), F.lit(', "private": 1}]}}'))
    rows = documents.json_results(table(spark, sf, "orders").select("o_orderkey", text.alias("body")), "o_orderkey", "body", "$.data.rows", "struct<id:bigint>")
    return rows.select(F.col("doc").alias("o_orderkey"), F.col("index").alias("place"), "row.id")


@query("""SELECT p_partkey, 'public.parts' AS "table", p_name AS name, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size::VARCHAR END AS size FROM part""")
def dump_cells(spark, sf):
    text = F.concat(F.lit("-- dump\nCOPY public.parts (name, size) FROM stdin;\n"), F.col("p_name"), F.lit("\t"), F.when(F.col("p_size") % 2 == 0, "\\N").otherwise(F.col("p_size").cast("string")), F.lit("\n\\.\nSELECT 1;\n"))
    rows = documents.dump_rows(table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return rows.select(F.col("doc").alias("p_partkey"), "table", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("size"))


@query("""SELECT 'q' || user_id AS source_name, 'events' AS collection, count(*) AS records, 0 AS nested FROM events GROUP BY 1 UNION ALL SELECT 'q' || user_id, 'rows', 2 * count(*), 2 * count(*) FROM events GROUP BY 1""")
def flattened_packets(spark, sf):
    one = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "rows": [{"n": 1}, {"n": 2}]}'))
    packets = table(spark, sf, "events").select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("source_name"), F.concat(F.lit('{"limits": 3, "events": ['), one, F.lit("]}")).alias("body"))
    flat = snapshot.flattened(packets)
    return flat.groupBy("source_name", "collection").agg(F.count("*").alias("records"), F.count("parent_path").cast("int").alias("nested"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18, 2) = round(l_extendedprice::DECIMAL(18, 2), 1) AS exact FROM lineitem""")
def exact_precision(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.has_places(F.col("l_extendedprice").cast("decimal(18,2)"), 1).alias("exact"))


@query("""SELECT event_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AS instant FROM events""")
def instants(spark, sf):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "2026-02-30T10:00:00Z").otherwise(F.concat(F.lit("2026-06-01T10:00:00"), F.get(F.array(F.lit(""), F.lit("Z"), F.lit("+02:00")), i % 3)))
    return table(spark, sf, "events").select("event_id", scalars.is_instant(text).alias("instant"))


@query("""SELECT p_partkey, p_brand AS brand, p_type AS type FROM part""")
def fixed_cells(spark, sf):
    line = F.concat(F.rpad("p_brand", 12, " "), F.lit(" "), F.col("p_type"), F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", scalars.fixed_columns(line, [0, 12]).alias("cells")).select("p_partkey", F.col("cells")[0].alias("brand"), F.col("cells")[1].alias("type"))


@query("""SELECT p_partkey, lower(p_name) AS composed, replace(lower(p_name), ' ', '') AS squashed FROM part""")
def name_forms(spark, sf):
    printed = F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "  "))
    return table(spark, sf, "part").select("p_partkey", names.composed(printed).alias("composed"), names.squashed(printed).alias("squashed"))


@query("""SELECT o_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') <= 1 AS one_scope FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def compatible_scopes(spark, sf):
    known = F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))  # three flags at most
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(scalars.one_scope(known).alias("one_scope"))
