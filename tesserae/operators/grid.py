"""Tables found by geometry: islands of intervals, boxes to lines and cells, fixed-width pages to columns.

Everything is a sweep inside a page: intervals in order of their start, a running greatest end, and a new island where one
begins beyond it. A page is a bounded group; pages are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], start: Column, end: Column, name: str, gap: float = 0) -> DataFrame:
    """``rows`` with the number (from 0) of the island that each interval [start, end) belongs to: intervals that overlap,
    or that lie ``gap`` or less apart, directly or over others. Rows without an interval have none."""
    named = rows.withColumns({"__start": start, "__end": end})
    order = W.partitionBy(*keys, F.col("__start").isNull()).orderBy("__start", "__end")
    reach = F.max("__end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = named.withColumn("__new", F.when(reach.isNull() | (F.col("__start") - reach > gap), 1).otherwise(0))
    number = F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1
    return opened.withColumn(name, F.when(F.col("__start").isNotNull(), number).cast("long")).drop("__start", "__end", "__new")


def box_lines(boxes: DataFrame, keys: list[str], core: float = 0.5) -> DataFrame:
    """``boxes`` (keys, x0, y0, x1, y1, text) with their line on the page, from the top, numbered from 0.

    Boxes stand on one line if the middle ``core`` parts of their heights overlap, directly or over others, so that
    descenders that touch the next line do not join the two. A box without width or height, or with a null side, is on no line.
    """
    sound = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    margin = (F.col("y1") - F.col("y0")) * (1 - core) / 2
    return islands(boxes, keys, F.when(sound, F.col("y0") + margin), F.when(sound, F.col("y1") - margin), "line")


def _cut(ordered: Column, start: str, end: str, gap: float) -> Column:
    """Places (from 1) in an array in order of ``start``, where an element begins beyond all ends before it by more than ``gap``."""
    none = F.struct(F.lit(None).cast("double").alias("reach"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, x: Column) -> Column:
        opens = s["reach"].isNull() | (x[start] - s["reach"] > gap)
        at = F.when(opens, F.concat(s["at"], F.array(s["n"] + 1))).otherwise(s["at"])
        return F.struct(F.greatest(s["reach"], x[end]).alias("reach"), (s["n"] + 1).alias("n"), at.alias("at"))

    return F.aggregate(ordered, none, step, lambda s: s["at"])


def _pieces(ordered: str, at: str) -> Column:
    """The array ``ordered`` cut before each place of ``at``."""
    after = lambda i: F.coalesce(F.get(at, i + 1), F.size(ordered) + 1)
    return F.transform(at, lambda a, i: F.slice(ordered, a, after(i) - a))


def page_cells(pages: DataFrame, keys: list[str], boxes: str, space: float = 1.0, core: float = 0.5) -> DataFrame:
    """What ``box_cells`` returns, of pages that are one row each (keys, an array of structs x0, y0, x1, y1, text).

    Lines and cells are cut inside the row, as ``box_lines`` and ``islands`` would: no row is shuffled or sorted.
    """
    sound = lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    margin = lambda b: (b["y1"] - b["y0"]) * (1 - core) / 2
    upright = F.transform(F.filter(boxes, sound), lambda b: F.struct((b["y0"] + margin(b)).alias("top"), (b["y1"] - margin(b)).alias("foot"), b.alias("box")))
    down = pages.select(*keys, F.sort_array(upright).alias("__down"))
    lines = down.select(*keys, "__down", _cut(F.col("__down"), "top", "foot", 0).alias("__at")).select(*keys, F.posexplode(_pieces("__down", "__at")).alias("line", "__words"))
    # in units of the line's height, so that one gap fits all lines
    unit = F.array_min(F.transform("__words", lambda w: w["box"]["y1"] - w["box"]["y0"])) * space
    scaled = lambda w: F.struct((w["box"]["x0"] / F.col("__unit")).alias("left"), (w["box"]["x1"] / F.col("__unit")).alias("right"), w["box"].alias("box"))
    across = lines.withColumn("__unit", unit).select(*keys, "line", F.sort_array(F.transform("__words", scaled)).alias("__across"))
    cut = across.select(*keys, "line", "__across", _cut(F.col("__across"), "left", "right", 1.0).alias("__at"))
    cells = cut.select(*keys, "line", F.posexplode(_pieces("__across", "__at")).alias("cell", "__words"))
    side = lambda name: F.transform("__words", lambda w: w["box"][name])
    word = F.sort_array(F.transform("__words", lambda w: F.struct(*(w["box"][n].alias(n) for n in ("x0", "y0", "x1", "text")))))
    text = F.array_join(F.transform(word, lambda w: w["text"]), " ")
    ends = [F.array_min(side("x0")).alias("x0"), F.array_min(side("y0")).alias("y0"), F.array_max(side("x1")).alias("x1"), F.array_max(side("y1")).alias("y1")]
    return cells.select(*keys, F.col("line").cast("long").alias("line"), F.col("cell").cast("long").alias("cell"), *ends, text.alias("text"))


def box_cells(boxes: DataFrame, keys: list[str], space: float = 1.0) -> DataFrame:
    """(keys, line, cell, x0, y0, x1, y1, text): words of a line that lie at most ``space`` of the line's lowest box height apart are a
    cell, read from left to right.

    The boxes of a page are brought together by one shuffle and cut into lines and cells in one row (``page_cells``), so a task
    sorts them by page once, not by window after window. They are dealt before they are grouped, as a task that reads them cannot
    know how many it holds, while partitions of a shuffle are sized by their bytes.
    """
    box = F.struct("x0", "y0", "x1", "y1", "text")
    return page_cells(boxes.repartition(*keys).groupBy(*keys).agg(F.collect_list(box).alias("__boxes")), keys, "__boxes", space)


def runs(lines: DataFrame, text: str, blanks: int = 2) -> DataFrame:
    """``lines`` with one row for each cell of their text: words parted by fewer than ``blanks`` spaces, with the places
    [start, stop) where they stand."""
    # the split keeps the blanks before each cell, so places are running sums of lengths
    piece = F.regexp_extract_all(F.rtrim(text), F.lit(rf"( *)([^ ]+(?: {{1,{blanks - 1}}}[^ ]+)*)"), F.lit(0))
    placed = lines.select("*", F.posexplode(piece).alias("cell", "__piece"), piece.alias("__all"))
    before = F.aggregate(F.slice("__all", F.lit(1), F.col("cell")), F.lit(0), lambda s, p: s + F.char_length(p))
    body = F.ltrim("__piece")
    start = before + F.char_length("__piece") - F.char_length(body)
    return placed.withColumns({"start": start, "stop": start + F.char_length(body), "value": body}).drop("__piece", "__all")


def aligned_tables(lines: DataFrame, keys: list[str], is_header: Column, least_columns: int = 6) -> DataFrame:
    """(keys, line, status, fields) of the lines below the header of each page (keys, line, text); fields is a map by header.

    Columns are not cut at fixed places: the cells of all lines of a page, header included, are projected on one
    axis, and each stretch that some cell covers is a column. The page is read only if that is unambiguous: one
    header line of ``least_columns`` cells or more, one header cell over each column, no line with two cells in a column. Lines of a
    page without a header are ``unsupported-table``; of a page with several, or that is ambiguous, ``unsupported-row-layout``;
    the others ``aligned-row``. Blank lines are left out.
    """
    filled = lines.where(F.trim("text") != "").withColumn("__head", F.coalesce(is_header, F.lit(False)))
    page = W.partitionBy(*keys)
    heads = filled.withColumns({"__heads": F.count_if("__head").over(page), "__at": F.min(F.when(F.col("__head"), F.col("line"))).over(page)})
    below = heads.where((F.col("__heads") == 0) | (F.col("line") >= F.col("__at")))
    cells = runs(below.where("__heads = 1").select(*keys, "line", "text", "__head"), "text")
    placed = islands(cells, keys, F.col("start"), F.col("stop"), "column")
    names = placed.where("__head").groupBy(*keys, "column").agg(F.count("*").alias("__n"), F.first("value").alias("name"))
    twice = placed.groupBy(*keys, "line", "column").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.max("__n").alias("__most"))
    columns = placed.groupBy(*keys).agg(F.count_distinct("column").alias("__columns"))
    headed = names.groupBy(*keys).agg(F.count("*").alias("__named"), F.count_distinct("name").alias("__names"))
    sound = twice.join(columns, keys).join(headed, keys).select(*keys, ((F.col("__most") == 1) & (F.col("__columns") == F.col("__named")) & (F.col("__names") == F.col("__named")) & (F.col("__columns") >= least_columns)).alias("__sound"))
    read = placed.where("not __head").join(names.select(*keys, "column", "name"), [*keys, "column"]).join(sound.where("__sound").select(*keys), keys, "left_semi")
    fields = read.groupBy(*keys, "line").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    status = F.when(F.col("__heads") == 0, "unsupported-table").when(F.col("fields").isNull(), "unsupported-row-layout").otherwise("aligned-row")
    return below.where("not __head").join(fields, [*keys, "line"], "left").select(*keys, "line", status.alias("status"), "fields")


#: Token classes: a letter for each, tried in order.
CLASSES = (("T", r"^\d+:\d{2}(\.\d{1,3})?$"), ("D", r"^\d+,\d{2}$"), ("P", r"^\d+\.\d+$"), ("N", r"^\d+$"))


def token_signature(tokens: Column, classes: tuple[tuple[str, str], ...] = CLASSES) -> Column:
    """One letter for each token, X where no class fits."""

    def letter(token: Column) -> Column:
        out = F.lit("X")
        for name, pattern in reversed(classes):
            out = F.when(token.rlike(pattern), name).otherwise(out)
        return out

    return F.array_join(F.transform(tokens, letter), "")


def decoded_tokens(tokens: Column, kind: Column, templates: list[tuple[str, str, list[str]]], penalty: str = "PG") -> Column:
    """A map from names to tokens by the one template (kind, signature, names) that fits, null where none does or two do.

    ``kind`` (a discipline, say) chooses among templates, their signature is matched whole against the tokens' classes. One
    token ``penalty`` is taken out first and kept under the name ``penalty``; two of them fit nothing.
    """
    marked = F.filter(tokens, lambda t: t == penalty)
    rest = F.filter(tokens, lambda t: t != penalty)
    signature = token_signature(rest)
    fits = [(F.coalesce(kind == k, F.lit(False)) & signature.eqNullSafe(F.lit(s)), names) for k, s, names in templates]
    number = sum((fit.cast("int") for fit, _ in fits), F.lit(0))
    names = F.lit(None).cast("array<string>")
    for fit, own in fits:
        names = F.when(fit, F.array(*map(F.lit, own))).otherwise(names)
    named = F.when(F.size(marked) == 1, F.concat(names, F.array(F.lit("penalty")))).otherwise(names)
    return F.when((number == 1) & (F.size(marked) <= 1), F.map_from_arrays(named, F.concat(rest, marked)))
