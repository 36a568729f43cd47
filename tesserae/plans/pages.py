"""Queries over printed pages: customers' orders are printed as documents, fixed-width pages and word boxes, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.operators import grid
from tesserae.plans.registry import query
from tesserae.sources import flow, layouts
from tesserae.sources.stored import shared_folder
from tesserae.sources.tables import table
from tesserae.sources.versions import Store


def _lines_of(orders, line):
    """The printed lines of each customer's orders, in order of their numbers, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n")


def _documents(spark, sf):
    """A document a customer: a ranking, a list of entries or a report, some of no known layout, some of two."""
    orders = table(spark, sf, "orders").withColumn("kind", F.col("o_custkey") % 3)
    key = F.col("o_orderkey").cast("string")
    time = F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 61).cast("string"), 2, "0"))
    ranking = F.concat_ws("  ", F.lit(" "), key, F.lit("Family"), F.lit("Given"), "o_orderpriority", F.lit("1990"), F.when(F.col("o_orderstatus") == "P", "none").otherwise(time))
    ranking = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("  BO\n"), ranking)).otherwise(ranking)
    entry = F.concat(key, F.lit(". Name of "), "o_orderpriority", F.lit(" (ITA)"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(" "), time)), F.when(F.col("o_orderkey") % 5 == 0, "\n      continued").otherwise(""))
    report = F.concat(F.lit("Place "), key, F.lit("| F |"), F.when(F.col("o_orderstatus") == "P", "none").otherwise((F.col("o_orderkey") % 100).cast("string")))
    line = F.when(F.col("kind") == 0, ranking).when(F.col("kind") == 1, entry).otherwise(report)
    bodies = orders.groupBy("o_custkey", "kind").agg(_lines_of(orders, line).alias("body"))
    head = F.when(F.col("o_custkey") % 17 == 0, "Some title\n").when(F.col("kind") == 0, "Ranking of results\nCategory Senior - STA\n").when(F.col("kind") == 1, "Start list\nUnit A\n").otherwise("Report of the jury\n-----\n")
    tail = F.when(F.col("kind") == 2, "\n-----\nsigned").otherwise("\n\nsigned")
    both = F.when(F.col("o_custkey") % 19 == 0, "Start list and Report of the jury\n").otherwise("")
    return bodies.select(F.col("o_custkey").cast("string").alias("doc"), F.concat(both, head, "body", tail).alias("body"))


_DOCS = """WITH o AS (SELECT *, o_custkey % 3 AS kind FROM orders), d AS (
  SELECT o_custkey::VARCHAR AS doc, kind, count(*) AS n, count_if(o_orderstatus = 'P') AS bad, count_if(o_orderkey % 5 = 0) AS fifth, o_custkey % 17 = 0 AS plain, o_custkey % 19 = 0 AS doubled FROM o GROUP BY ALL
)"""


@query(_DOCS + """ SELECT doc, CASE WHEN verdict IS NULL THEN name END AS layout, (CASE WHEN plain THEN 1 ELSE 2 END + doubled::INT + n + CASE WHEN kind <> 2 THEN fifth ELSE 1 END + 1)::BIGINT AS lines,
  CASE WHEN verdict IS NULL THEN n - bad ELSE 0 END::BIGINT AS rows, CASE WHEN verdict IS NULL THEN bad ELSE 0 END::BIGINT AS unparsed, CASE WHEN verdict IS NULL THEN 1 ELSE 0 END::BIGINT AS sections,
  coalesce(verdict, CASE WHEN bad = 0 THEN 'complete' ELSE 'partial' END) AS coverage
FROM (SELECT *, ['ranking', 'entries', 'report'][kind + 1] AS name, CASE WHEN doubled THEN 'ambiguous' WHEN plain THEN 'unsupported' END AS verdict FROM d)""")
def layout_accounts(spark, sf):
    docs = _documents(spark, sf)
    lines = layouts.laid_out(docs, layouts.EXAMPLES, "doc", "body")
    return layouts.reconciled(lines, docs, "doc", "body").select("doc", "layout", "lines", "rows", "unparsed", "sections", "coverage")


@query(_DOCS + """ SELECT doc, CASE WHEN NOT doubled AND NOT plain THEN ['ranking', 'entries', 'report'][kind + 1] END AS layout, CASE WHEN NOT doubled AND NOT plain THEN n - bad ELSE 0 END::BIGINT AS rows, CASE WHEN NOT doubled AND NOT plain THEN n ELSE 0 END::BIGINT AS observations,
  CASE WHEN doubled THEN 'ambiguous' WHEN plain THEN 'unsupported' WHEN bad = 0 THEN 'complete' ELSE 'partial' END AS coverage FROM d""")
def evidence_flow(spark, sf):
    """The printed documents arrive in two batches that overlap, and go through archive, extraction, ingestion and readiness."""
    docs = _documents(spark, sf)
    store = Store(spark, f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}")
    flow.flow(store, docs.where("doc % 2 = 0").withColumnRenamed("body", "text"), layouts.EXAMPLES, "v1")
    last = flow.flow(store, docs.withColumnRenamed("body", "text"), layouts.EXAMPLES, "v1")
    seen = last.table("observations").groupBy("job_id").agg(F.count("*").alias("observations"))
    job = F.sha2(F.concat_ws("\x1f", F.sha2("body", 256), F.lit("v1")), 256).alias("job_id")
    ready = docs.select("doc", job).join(last.table("readiness"), "job_id").join(seen, "job_id", "left")
    return ready.select("doc", "layout", "rows", F.coalesce("observations", F.lit(0).cast("long")).alias("observations"), "coverage")


@query("""SELECT o_custkey::VARCHAR AS doc, ['ranking', 'entries', 'report'][o_custkey % 3 + 1] AS layout, o_orderkey AS number, CASE WHEN o_orderstatus = 'P' THEN 'unparsed' ELSE 'row' END AS role,
  CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'BO' END AS status, CASE WHEN o_custkey % 3 = 1 THEN 'Name of ' || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ' continued' ELSE '' END END AS name,
  CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 <> 1 THEN 'none' WHEN o_orderstatus <> 'P' THEN CASE WHEN o_custkey % 3 = 2 THEN (o_orderkey % 100)::VARCHAR ELSE o_orderkey % 60 || ':' || lpad((o_orderkey % 61)::VARCHAR, 2, '0') END END AS result
FROM orders WHERE o_custkey % 17 <> 0 AND o_custkey % 19 <> 0""")
def layout_rows(spark, sf):
    rows = layouts.laid_out(_documents(spark, sf), layouts.EXAMPLES, "doc", "body").where("role in ('row', 'unparsed')")
    field = lambda *names: F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in names))
    number = F.regexp_extract(field("rank", "number", "place"), r"(\d+)", 1).cast("long")
    return rows.select("doc", "layout", number.alias("number"), "role", field("status").alias("status"), field("name").alias("name"), field("time", "result").alias("result"))


@query("""SELECT o_custkey AS page, o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'unsupported-table' WHEN o_custkey % 11 = 0 THEN 'unsupported-row-layout' ELSE 'aligned-row' END AS status,
  CASE WHEN o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 THEN o_orderpriority || '/' || o_orderstatus || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_custkey::VARCHAR END END AS cells FROM orders""")
def aligned_rows(spark, sf):
    """Pages of six columns whose places differ from page to page; some have no header, in some a line reaches over two columns."""
    key = F.col("o_orderkey").cast("string")
    wide = lambda c, n: F.rpad(c, n, " ")
    indent = F.repeat(F.lit(" "), (F.col("o_custkey") % 7).cast("int"))
    number = F.when(F.col("o_custkey") % 2 == 0, F.lpad(key, 12, " ")).otherwise(wide(key, 12))  # to the right or left
    owner = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).otherwise("")
    row = F.concat(indent, number, F.lit("   "), wide(F.col("o_orderpriority"), 18), wide(F.col("o_orderstatus"), 9), wide(F.date_format("o_orderdate", "yyyy-MM-dd"), 13), wide(owner, 11), F.lit("end"))
    crowded = F.when((F.col("o_custkey") % 11 == 0), F.regexp_replace(row, r"-(\S+(?: \S+)*) +(\S) +", "-$1 ------------------$2 ")).otherwise(row)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line"), crowded.alias("text"))
    pages = table(spark, sf, "orders").select("o_custkey").distinct().where("o_custkey % 7 <> 0")
    heading = F.concat(indent, F.when(F.col("o_custkey") % 2 == 0, F.lpad(F.lit("Order"), 12, " ")).otherwise(F.rpad(F.lit("Order"), 12, " ")), F.lit("   "), wide(F.lit("Priority"), 18), wide(F.lit("State"), 9), wide(F.lit("Day"), 13), wide(F.lit("Customer"), 11), F.lit("End"))
    heads = pages.select(F.col("o_custkey").alias("page"), F.lit(-1).cast("long").alias("line"), heading.alias("text"))
    read = grid.aligned_tables(rows.unionByName(heads), ["page"], F.col("line") == -1)
    cell = lambda name: F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))
    cells = F.when(F.col("fields").isNotNull(), F.concat_ws("/", cell("Priority"), cell("State"), cell("Day"), cell("Customer")))
    return read.select("page", F.col("line").alias("o_orderkey"), "status", cells.alias("cells"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS line FROM orders)
SELECT o_custkey AS page, line, cell, CASE cell WHEN 0 THEN 'order ' || o_orderkey WHEN 1 THEN o_orderstatus ELSE o_orderpriority || ' of ' || o_custkey END AS text FROM o, (VALUES (0), (1), (2)) v(cell)""")
def boxes_to_cells(spark, sf):
    """Every order is a line of a customer's page, printed as word boxes that jitter up and down. The page is printed where its orders meet."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("order"))
    pages = orders.repartition("page").groupBy("page").agg(F.collect_list("order").alias("orders"))
    words = [("order", 0, 0), (None, 0, 1), ("status", 1, 0), ("priority", 2, 0), ("of", 2, 1), ("customer", 2, 2)]

    def printed(order):
        key, page = order["o_orderkey"], F.col("page")
        base = key.cast("double") * 12
        text = {"order": F.lit("order"), None: key.cast("string"), "status": order["o_orderstatus"], "priority": order["o_orderpriority"], "of": F.lit("of"), "customer": page.cast("string")}
        return F.array(*(
            F.struct((F.lit(100.0 * cell + 30 * n) + page % 7).alias("x0"), (base + (key + n) % 3).alias("y0"), (F.lit(100.0 * cell + 30 * n + 25) + page % 7).alias("x1"), (base + 10 + (key + n) % 3).alias("y1"), text[name].alias("text"))
            for name, cell, n in words
        ))

    boxes = pages.select("page", F.flatten(F.transform("orders", printed)).alias("boxes"))
    return grid.page_cells(boxes, ["page"], "boxes").select("page", "line", "cell", "text")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 <> 3 THEN o_orderkey % 9 || ':10.00/' || CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 80 || '.5' ELSE '' END || '/' || CASE WHEN o_orderkey % 5 = 0 THEN 'PG' ELSE '' END
  WHEN o_orderstatus = 'O' AND o_orderkey % 4 <> 3 THEN o_orderkey % 90 || ',00/' || CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 80 || '.5' ELSE '' END || '/' || CASE WHEN o_orderkey % 5 = 0 THEN 'PG' ELSE '' END END AS decoded FROM orders""")
def token_layouts(spark, sf):
    """Results as tokens of several layouts: static by time, dynamic by distance; pending orders have no layout, some have a token too much."""
    key = F.col("o_orderkey")
    text = lambda n, end: F.concat((key % n).cast("string"), F.lit(end))
    static, far = F.col("o_orderstatus") == "F", text(90, ",00")
    tokens = F.when(static, F.array(F.lit("1:00.00"), text(9, ":10.00"), text(9, ":10.00"))).otherwise(F.array(F.lit("9,00"), F.lit("1:00.00"), far, F.lit("1:00.00"), far))
    tokens = F.concat(tokens, F.when(key % 4 == 0, F.array(text(80, ".5"))).otherwise(F.array().cast("array<string>")), F.when(key % 4 == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    tokens = F.when(key % 5 == 0, F.array_insert(tokens, 2, F.lit("PG"))).otherwise(tokens)
    s, d = ["declared", "realized", "approved"], ["declared", "time", "realized", "approved-time", "approved"]
    templates = [("F", "TTT", s), ("F", "TTTP", [*s, "points"]), ("O", "DTDTD", d), ("O", "DTDTDP", [*d, "points"])]
    rows = table(spark, sf, "orders").select("o_orderkey", grid.decoded_tokens(tokens, F.col("o_orderstatus"), templates).alias("m"))
    get = lambda name: F.coalesce(F.try_element_at("m", F.lit(name)), F.lit(""))
    return rows.select("o_orderkey", F.when(F.col("m").isNotNull(), F.concat_ws("/", get("approved"), get("points"), get("penalty"))).alias("decoded"))
