"""Layouts as data, aligned tables, boxes and token templates."""

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import grid
from tesserae.plans import registry
from tesserae.sources import layouts
from tests.compare import bag, connection


def test_islands_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(p, i, float(s), float(s + rng.randint(1, 6))) for p in range(5) for i, s in enumerate(rng.sample(range(60), 12))] + [(0, 99, None, None)]
    found = {(r["p"], r["i"]): r["n"] for r in grid.islands(spark.createDataFrame(rows, "p int, i int, s double, e double"), ["p"], F.col("s"), F.col("e"), "n", 1).collect()}
    for p in range(5):
        own = sorted((s, e, i) for q, i, s, e in rows if q == p and s is not None)
        n, reach = -1, None
        for s, e, i in own:
            if reach is None or s - reach > 1:
                n += 1
            reach = e if reach is None else max(reach, e)
            assert found[p, i] == n
    assert found[0, 99] is None


def test_boxes_become_lines_and_cells(spark):
    rng = random.Random(3)
    boxes, wanted = [], {}
    for page in range(4):
        y = 10.0
        for line in range(6):
            height, x = rng.choice([8.0, 12.0]), rng.uniform(0, 20)
            for cell in range(rng.randint(1, 4)):
                words = [f"w{page}{line}{cell}{k}" for k in range(rng.randint(1, 3))]
                for w in words:
                    jitter = rng.uniform(-0.2, 0.2) * height
                    boxes.append((page, x, y + jitter, x + 20, y + jitter + height, w))
                    x += 20 + rng.uniform(0.1, 0.9) * height
                wanted[page, line, cell] = " ".join(words)
                x += height * 2
            y += height * 1.15
    boxes += [(0, 5.0, 5.0, 5.0, 9.0, "flat"), (0, None, 1.0, 2.0, 3.0, "none")]
    rng.shuffle(boxes)
    frame = spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double, text string").repartition(3)
    assert {(r["page"], r["line"], r["cell"]): r["text"] for r in grid.box_cells(frame, ["page"]).collect()} == wanted


HEADS = ["Position", "Family name", "Given", "Club", "Year", "Time"]


def page_of(rng, indent, rows):
    widths = [max(len(str(r[c])) for r in [HEADS, *rows]) + 2 + rng.randint(0, 6) for c in range(6)]
    right = [rng.random() < 0.5 for _ in HEADS]
    line = lambda r: " " * indent + "".join((str(v).rjust(w - 2) + "  ") if right[c] else str(v).ljust(w) for c, (v, w) in enumerate(zip(r, widths, strict=True)))
    return [line(HEADS), *(line(r) for r in rows)]


def test_aligned_tables_of_shifted_pages(spark):
    rng = random.Random(8)
    lines, wanted = [], {}
    for page in range(30):
        rows = [[n, rng.choice(["Li", "De la Cruz", "Ångström"]), rng.choice(["Ana", "Jo Ann", ""]), rng.choice(["Club of the sea", "X", ""]), rng.randint(1950, 2009), f"{n}:0{n}.1"] for n in range(1, 8)]
        kind = ["good", "good", "none", "twice", "narrow", "crowded"][page % 6]
        text = page_of(rng, rng.randint(0, 9), rows)
        status = {"good": "aligned-row", "none": "unsupported-table"}.get(kind, "unsupported-row-layout")
        if kind == "none":
            text = text[1:]
        if kind == "twice":
            text.insert(4, text[0])
        if kind == "narrow":
            text = [t[: t.index("Year")] if "Year" in t else t[:30] for t in text]
        if kind == "crowded":  # one row reaches over two columns
            text[3] = "x" * len(text[0])
        above = ["Some title of the page", ""] if kind != "none" else []
        for n, t in enumerate(above + text):
            lines.append((page, n, t))
        for n, r in enumerate(rows):
            if kind == "good":
                wanted[page, len(above) + 1 + n] = {h: str(v) for h, v in zip(HEADS, r, strict=True) if str(v)}
        if kind != "good":
            wanted[page] = status
    frame = spark.createDataFrame(lines, "page int, line int, text string").repartition(4)
    out = grid.aligned_tables(frame, ["page"], F.col("text").rlike("Position +Family name")).collect()
    got = {(r["page"], r["line"]): r["fields"] for r in out if r["status"] == "aligned-row"}
    assert got == {k: v for k, v in wanted.items() if isinstance(k, tuple)}
    assert {r["page"]: r["status"] for r in out if r["status"] != "aligned-row"} == {k: v for k, v in wanted.items() if not isinstance(k, tuple)}


def test_runs_keep_their_places(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("a  é  b ") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for r in grid.runs(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect():
        assert r["text"][r["start"] : r["stop"]] == r["value"] and "  " not in r["value"] and r["value"].strip() == r["value"] != ""


TEMPLATES = [("STA", "TTT", ["declared", "realized", "approved"]), ("STA", "TTTP", ["declared", "realized", "approved", "points"]), ("DYN", "DTDTDP", ["declared", "time", "distance", "approved-time", "approved", "points"]), ("DYN", "DTDTD", ["a", "b", "c", "d", "e"]), ("DYN", "DTDTD", ["e", "d", "c", "b", "a"])]


def test_token_templates(spark):
    rows = [("STA", "4:00.00 4:10.00 4:10.00"), ("STA", "4:00.00 PG 4:10.00 4:10.00 50.5"), ("STA", "4:00.00 PG 4:10.00 PG 4:10.00"), ("STA", "x 4:10.00 4:10.00"), ("DYN", "50,00 1:00.00 51,00 1:00.00 51,00 25.5"), ("DYN", "50,00 1:00.00 51,00 1:00.00 51,00"), (None, "4:00.00 4:10.00 4:10.00")]
    out = spark.createDataFrame(rows, "d string, t string").select(grid.decoded_tokens(F.split("t", " "), F.col("d"), TEMPLATES).alias("m")).collect()
    assert [r["m"] for r in out] == [
        {"declared": "4:00.00", "realized": "4:10.00", "approved": "4:10.00"}, {"declared": "4:00.00", "realized": "4:10.00", "approved": "4:10.00", "points": "50.5", "penalty": "PG"}, None, None,
        {"declared": "50,00", "time": "1:00.00", "distance": "51,00", "approved-time": "1:00.00", "approved": "51,00", "points": "25.5"}, None, None,
    ]


PAGES = [
    ("rank", "Ranking of results 2026\n\nCategory Senior - STA\n  1   Doe  Ann  Club one  1990  4:10.50\n  BO\n  2   Roe  Bo  Club  1991  3:00\n 3   Poe  Cy  Club  1892  2:00\f  4   Loe  Di  1990  2:00\nCategory Junior - DNF\n  1   Moe  Ed  Club  2005  1:00\nnot a row\nPage 1 of 2"),
    ("entries", "Start list of day 1\nUnit A\n1. Ann Doe (ITA) 3:30\n2. A name that is very\n      long (FRA) 2:00\n3. Bo Roe (JPN) 2:15\n    Santos\n-> DNS\n4. Cy Poe (ITA)"),
    ("report", "Report of the jury\nSome prose | here\n-----\nPool |  F | 55,5\nSea | M | x\nSea | M | 40\n-----\nmore prose"),
    ("none", "Something else"), ("both", "Ranking of results\nStart list"), ("blank", " \n\f "), ("null", None),
]


def test_layouts_account_for_every_line(spark):
    docs = spark.createDataFrame(PAGES, "id string, body string").withColumn("line", F.lit("extra")).repartition(3)
    lines = layouts.laid_out(docs, layouts.EXAMPLES, "id", "body").cache()
    rows = {(r["doc"], r["page"], r["line"]): (r["role"], r["fields"], r["reasons"]) for r in lines.where("role in ('row', 'unparsed')").collect()}
    assert rows["rank", 1, 4][1] == {"category": "Senior", "discipline": "STA", "rank": "1", "surname": "Doe", "given": "Ann", "club": "Club one", "year": "1990", "time": "4:10.50"}
    assert rows["rank", 1, 6][1]["status"] == "BO" and "status" not in rows["rank", 2, 1][1]
    assert rows["rank", 2, 1][0::2] == ("unparsed", ["cells", "birth-year", "time"]) and rows["rank", 2, 3][1]["discipline"] == "DNF"
    assert rows["entries", 1, 6][1] == {"unit": "A", "number": "3", "name": "Bo Roe Santos", "country": "JPN", "time": "2:15", "status": "DNS"}
    assert rows["entries", 1, 9][0::2] == ("unparsed", ["announced-time"]) and rows["report", 1, 5][0] == "unparsed"
    count = {r["doc"]: tuple(r)[1:] for r in layouts.reconciled(lines, docs, "id", "body", spark.createDataFrame([("report", 2), ("entries", 3)], "doc string, expected long")).collect()}
    assert count["rank"] == ("ranking", 10, 3, 2, 2, 2, 1, None, "partial")
    for layout, n, *parts in count.values():
        assert layout is None or n == sum(parts[:5])
    assert {k: v[-1] for k, v in count.items()} == {"rank": "partial", "entries": "partial", "report": "partial", "none": "unsupported", "both": "ambiguous", "blank": "needs-ocr", "null": "needs-ocr"}
    whole = spark.createDataFrame([("w", "Report of the jury\n-----\nSea | M | 40\n-----")], "id string, body string")
    assert layouts.reconciled(layouts.laid_out(whole, layouts.EXAMPLES, "id", "body"), whole, "id", "body").first()["coverage"] == "complete"


def test_layouts_come_from_tables(spark, tmp_path):
    rules = [("pairs", ["Pairs"], "start", "Pairs", "skip", "start", None, None), ("pairs", ["Pairs"], "start", r"(?P<a>\w)=(?P<b>\w)", "row", "start", None, [["b", r"\d", "digit"]])]
    rows = [dict(zip(("n", "layout", "marks", "state", "pattern", "action", "goes_to", "columns", "checks"), (i, *r), strict=True)) for i, r in enumerate(rules)]
    import json

    (tmp_path / "rules.json").write_text("\n".join(map(json.dumps, reversed(rows))))
    found = layouts.read_layouts(spark, str(tmp_path / "rules.json"))
    docs = spark.createDataFrame([("d", "Pairs\nx=1\ny=z")], "id string, body string")
    assert [(r["role"], r["fields"]) for r in layouts.laid_out(docs, found, "id", "body").orderBy("line").collect()] == [("skip", None), ("row", {"a": "x", "b": "1"}), ("unparsed", {"a": "y", "b": "z"})]
    with pytest.raises(ValueError):
        layouts.Layout("bad", (), (layouts.Rule("start", "x", "row", "nowhere"),))


def test_bound_layouts_need_their_source(spark):
    bound = layouts.Layout("bound", ("Pairs",), (layouts.Rule("start", ".*", "skip", "start"),), ("ab",))
    docs = spark.createDataFrame([("d", "Pairs", "ab"), ("e", "Pairs", "cd")], "id string, body string, sha string")
    assert {r["doc"]: r["role"] for r in layouts.laid_out(docs, [bound], "id", "body", "sha").collect()} == {"d": "skip", "e": "unsupported"}


def test_crowded_pages_of_one_priority(spark, tmp_path):
    """A page that is to be crowded holds only priorities of two words."""
    orders = [(1, 22, "O", "4-NOT SPECIFIED"), (2, 22, "F", "4-NOT SPECIFIED"), (3, 23, "F", "4-NOT SPECIFIED"), (4, 33, "P", "1-URGENT"), (5, 33, "P", "4-NOT SPECIFIED")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.lit("1995-01-02").cast("timestamp")).write.parquet(str(tmp_path / "orders.parquet"))
    found, wanted = registry.queries()["aligned_rows"](spark, str(tmp_path)).toPandas(), connection(tmp_path).sql(registry.oracle_sql()["aligned_rows"]).df()
    assert bag(found) == bag(wanted)


def test_patterns_are_made_once_and_lines_handed_on_together(spark):
    assert layouts._by_state(layouts.RANKING) is layouts._by_state(layouts.RANKING)
    docs = spark.createDataFrame([(str(i), f"Report of the jury\n-----\nSea {i} | M | {i}\n-----") for i in range(6000)], "id string, body string").coalesce(1)
    lines = layouts.laid_out(docs, layouts.EXAMPLES, "id", "body")
    assert lines.count() == 4 * 6000 and lines.where("role = 'row' and fields['result'] = ' ' || doc").count() == 6000
