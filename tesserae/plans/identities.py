"""People queries: parts stand for listed people, with names in several spellings, aliases, person ids and damaged rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.names import combinations
from tesserae.operators import identity
from tesserae.plans.registry import query
from tesserae.sources.tables import table

_FOLD = "trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}]+', ' ', 'g'))"
_ORDER = "array_to_string(list_sort(string_split({}, ' ')), ' ')"

_PEOPLE = f"""WITH base AS (
  SELECT *, p_name || CASE WHEN p_size >= 18 THEN ' ' || chr(97 + split_part(p_brand, '#', 2)::INTEGER % 26) || chr(97 + p_size % 26) ELSE '' END AS whole FROM part
), people AS (
  SELECT 'p' || p_partkey AS id, p_size <> 13 AS usable, p_partkey,
    CASE WHEN p_size = 13 THEN 'damaged ' || whole WHEN p_size = 17 THEN NULL WHEN p_size % 4 = 0 THEN replace(whole, 'o', 'ö') WHEN p_size % 4 = 1 THEN replace(whole, 'o', 'oe')
      WHEN p_size % 4 = 2 THEN array_to_string(list_reverse(string_split(whole, ' ')), ' ') ELSE whole END AS name,
    CASE WHEN p_size % 7 = 0 THEN p_type || ' ' || whole END AS published, CASE WHEN p_size % 11 = 0 THEN 'Trade ' || whole END AS accepted,
    CASE WHEN p_size % 5 = 0 THEN p_brand || chr(31) || p_type END AS person, CASE WHEN p_size % 5 = 0 THEN p_brand END AS scope, CASE p_size % 3 WHEN 1 THEN 'women' WHEN 2 THEN 'men' END AS sex
  FROM base
), listed AS (
  SELECT id, 'native' AS origin, name FROM people UNION ALL SELECT id, 'publisher', published FROM people UNION ALL SELECT id, 'accepted', accepted FROM people
  UNION ALL SELECT id, 'generated', replace(lower(name), 'ö', 'oe') FROM people WHERE name LIKE '%ö%'
), folded AS (
  SELECT id, origin, {_FOLD.format("name")} AS folded FROM listed WHERE name IS NOT NULL
), names AS (SELECT DISTINCT id, origin, {_ORDER.format("folded")} AS key FROM folded WHERE folded <> ''),
native AS (SELECT people.*, folded FROM people LEFT JOIN folded ON folded.id = people.id AND origin = 'native'),
kinds AS (
  SELECT id, min(id) OVER (PARTITION BY usable, folded, person, sex, (SELECT string_agg(origin || ':' || key, ';' ORDER BY origin, key) FROM names WHERE names.id = native.id)) AS class FROM native
), index AS (
  SELECT names.*, CASE origin WHEN 'native' THEN 'native-name' WHEN 'publisher' THEN 'publisher-alias' WHEN 'accepted' THEN 'accepted-alias' ELSE 'generated-transliteration' END AS route FROM names JOIN people USING (id) WHERE usable
), said AS (
  SELECT DISTINCT a.key, n.key AS other FROM index a JOIN index n ON a.id = n.id AND a.origin IN ('publisher', 'accepted') AND n.origin = 'native'
), bridge AS (SELECT key, other FROM said UNION SELECT other, key FROM said),
hops AS (SELECT DISTINCT names.id, other AS key FROM names JOIN bridge USING (key) EXCEPT SELECT id, key FROM names),
hits AS (
  SELECT n.id AS asked, i.id AS found, i.route FROM names n JOIN index i ON n.key = i.key
  UNION SELECT a.id, f.id, 'publisher-id' FROM people a JOIN people f ON a.person = f.person AND f.usable
  UNION SELECT h.id, i.id, 'romanization' FROM hops h JOIN index i ON h.key = i.key AND i.origin = 'native'
), pairs AS (SELECT asked, found, string_agg(route, ',' ORDER BY route) AS routes FROM hits WHERE asked <> found GROUP BY ALL)"""


def _people(spark, sf):
    number, size = F.split("p_brand", "#")[1].cast("int"), F.col("p_size")
    whole = F.concat("p_name", F.when(size >= 18, F.concat(F.lit(" "), F.char(97 + number % 26), F.char(97 + size % 26))).otherwise(""))
    spelt = (
        F.when(size == 13, F.concat(F.lit("damaged "), whole)).when(size == 17, None).when(size % 4 == 0, F.replace(whole, F.lit("o"), F.lit("ö"))).when(size % 4 == 1, F.replace(whole, F.lit("o"), F.lit("oe")))
        .when(size % 4 == 2, F.array_join(F.reverse(F.split(whole, " ")), " ")).otherwise(whole)
    )
    alias = lambda when, name, origin: F.when(when, F.struct(name.alias("name"), F.lit(origin).alias("origin")))
    numbered = size % 5 == 0
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("observation_id"), spelt.alias("source_name"), F.when(size == 13, "damaged").otherwise("parsed").alias("parse_status"),
        F.when(numbered, F.col("p_brand")).alias("publisher_scope"), F.when(numbered, F.col("p_type")).alias("publisher_athlete_id"), F.when(numbered, "person").otherwise("listing").alias("publisher_id_kind"),
        F.array_compact(F.array(alias(size % 7 == 0, F.concat("p_type", F.lit(" "), whole), "publisher"), alias(size % 11 == 0, F.concat(F.lit("Trade "), whole), "accepted"))).alias("aliases"),
        F.when(size % 3 == 1, "women").when(size % 3 == 2, "men").alias("sex"),
    )
    return identity.with_generated(rows)


@query(_PEOPLE + " SELECT id, class FROM kinds")
def identity_classes(spark, sf):
    return identity.classes(_people(spark, sf))[0]


@query(_PEOPLE + """ SELECT a.class AS asked, f.class AS found, min(routes) AS routes FROM pairs JOIN kinds a ON a.id = asked JOIN kinds f ON f.id = found GROUP BY ALL""")
def identity_routes(spark, sf):
    found = identity.retrieved(identity.classes(_people(spark, sf))[1])
    return found.select("asked", "found", F.array_join("routes", ",").alias("routes"))


@query(_PEOPLE + """, exact AS (
  SELECT DISTINCT a.id AS asked, f.id AS found FROM names a JOIN names f ON a.key = f.key AND a.origin <> 'generated' AND f.origin <> 'generated'
), judged AS (
  SELECT asked, found, routes, coalesce(a.scope = f.scope AND a.person <> f.person, false) OR coalesce(a.sex <> f.sex, false) AS clash, e.asked IS NOT NULL AS exact
  FROM pairs JOIN people a ON a.id = asked JOIN people f ON f.id = found LEFT JOIN exact e USING (asked, found)
), seen AS (
  SELECT asked AS id, count(*) AS candidates, count_if(NOT clash) AS plausible, count_if(NOT clash AND routes LIKE '%publisher-id%') AS ids, count_if(NOT clash AND exact) AS same,
    max(found) FILTER (NOT clash AND routes LIKE '%publisher-id%') AS id_found, max(found) FILTER (NOT clash AND exact) AS same_found FROM judged GROUP BY asked
), bad AS (
  SELECT DISTINCT n.id, b.id AS bad FROM names n JOIN names b ON n.key = b.key JOIN people p ON p.id = b.id AND NOT p.usable WHERE n.id <> b.id
  UNION SELECT a.id, b.id FROM people a JOIN people b ON a.person = b.person AND NOT b.usable AND a.id <> b.id
), omitted AS (SELECT id, count(*) AS omitted FROM bad GROUP BY id),
reasoned AS (
  SELECT n.id, coalesce(candidates, 0) AS candidates, coalesce(omitted, 0) AS omitted, CASE WHEN ids = 1 THEN id_found WHEN same = 1 THEN same_found END AS winner,
    CASE WHEN NOT usable THEN 'damaged-reading' WHEN folded IS NULL THEN 'missing-name' WHEN omitted > 0 THEN 'unsupported-possible-candidate' WHEN ids = 1 THEN 'verified-publisher-id'
      WHEN folded IN ('red widget', 'hot gear') THEN 'configured-ambiguous-name' WHEN len(string_split(folded, ' ')) < 2 THEN 'insufficient-name' WHEN plausible > 1 THEN 'competing-candidates'
      WHEN coalesce(same, 0) <> 1 THEN 'no-distinctive-exact-match' ELSE 'distinctive-exact-name' END AS reason,
    (SELECT count(*) FROM people WHERE NOT usable) - CASE WHEN usable THEN 0 ELSE 1 END AS others
  FROM native n LEFT JOIN seen USING (id) LEFT JOIN omitted USING (id)
), linked AS (SELECT *, reason IN ('verified-publisher-id', 'distinctive-exact-name') AS linked FROM reasoned)
SELECT id, CASE WHEN linked THEN 'approve' ELSE 'unresolved' END AS status, reason, CASE WHEN linked THEN winner END AS candidate_id, candidates::BIGINT AS candidates, omitted::BIGINT AS omitted, (others - omitted)::BIGINT AS excluded FROM linked""")
def identity_decided(spark, sf):
    return identity.decided(_people(spark, sf), ("red widget", "hot gear"))


@query("""WITH n AS (SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS nation FROM nation),
f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') ELSE '' END AS given, CASE WHEN s_suppkey % 5 <> 0 THEN nation ELSE '' END AS family, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g')[:s_suppkey % 12] AS whole
  FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN given <> '' AND family <> '' THEN given || family END, CASE WHEN given <> '' AND family <> '' THEN family || given END, whole], lambda x: length(x) >= 5))), ',') AS forms FROM f""")
def name_forms_listed(spark, sf):
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    squashed = F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "")
    forms = combinations(F.when(key % 3 != 0, F.col("s_name")), F.when(key % 5 != 0, F.col("n_name")), F.substring(squashed, F.lit(1), (key % 12).cast("int")))
    return rows.select("s_suppkey", F.array_join(forms, ",").alias("forms"))
