"""Operator 8: benchmark decontamination by SimHash windows. DataFrame functions only.

A window is as many words as a benchmark item has. Documents are searched for windows whose weighted five-word shingles
reach the similarity ``AT_LEAST`` with the item's:

1. A window can only be similar if its shingles of items of its length weigh ``AT_LEAST`` of the lightest such item or
   more. Shingles of items are found by one hash join; of windows that hold one, those go on whose first one begins a
   stretch of so much weight. Windows begin at any word, since a shift brings other words into the weighted union.
2. Each window and each item gets a SimHash of ``BITS`` bits. A shingle weighs its number of characters and votes with the root
   of it, so that the cosine that SimHash estimates is 2 s / (1 + s) or more at similarity s, however weights are spread.
3. Multi-index Hamming search: the fingerprint is cut into blocks of ``BLOCK`` bits. Of two fingerprints that differ in at
   most ``RADIUS`` bits one block at least differs in ``NEAR`` bits or fewer, so every block of an item is listed with all
   values that near, and an equality join on (window size, block, value) finds all of them. Unrelated fingerprints meet with
   a chance of 0.085 a pair, and pass the radius with one of 1e-8.
4. Candidates within the radius are verified by the exact weighted Jaccard similarity of their shingle sets.

Windows of similarity ``AT_LEAST`` differ in 22 of 128 bits on average with a deviation of 4.3, so the radius finds
98.7 of 100 at that very similarity, and all but one in a thousand from 0.8 on.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.stored import stored

WORDS = 5
AT_LEAST = 0.75
BITS = 128
BLOCK = 16
NEAR = 3
RADIUS = (BITS // BLOCK) * (NEAR + 1) - 1
#: Tables of so many rows (or array elements) at most are sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Places are ordered in parts of a window's length, so that one range holds windows of all lengths.
PARTS = 1 << 20
_WHITE = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; one empty word for a blank or null text."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WHITE)), r"[\x20\x09-\x0D]+")


def _shingles(words: Column, weigh: bool) -> Column:
    """Hashes of the five-word shingles in order, with their characters as weights if asked; none for fewer words."""

    def one(i: Column) -> Column:
        parts = [F.element_at(words, i + k) for k in range(WORDS)]
        h = F.xxhash64(*parts)
        return F.struct(h.alias("h"), sum((F.char_length(p) for p in parts[1:]), F.char_length(parts[0])).alias("w")) if weigh else h

    kind = "array<struct<h:bigint,w:int>>" if weigh else "array<bigint>"
    return F.when(F.size(words) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), one)).otherwise(F.array().cast(kind))


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with its SimHash as ``BITS`` / 64 numbers, from one row for each distinct shingle (h, w): a bit is set if
    more than half of the votes set it."""
    vote = F.round(1000 * F.sqrt("w")).cast("long").alias("w")  # whole numbers: sums do not depend on their order
    halves = F.posexplode(F.array(F.col("h"), *(F.xxhash64("h", F.lit(i)) for i in range(1, BITS // 64)))).alias("half", "bits")
    votes = [F.sum(F.when(F.getbit("bits", F.lit(i)) == 1, F.col("w")).otherwise(0)).alias(f"v{i}") for i in range(64)]
    counted = rows.select(*keys, vote, halves).groupBy(*keys, "half").agg(F.sum("w").alias("total"), *votes)
    words = [sum((F.when(2 * F.col(f"v{i}") > F.col("total"), F.lit(1 << (i - lo)).cast("long")).otherwise(0) for i in range(lo, lo + 32)), F.lit(0).cast("long")) for lo in (0, 32)]
    whole = counted.select(*keys, "half", words[0].bitwiseOR(F.shiftleft(words[1], 32)).alias("bits"))
    return whole.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("half", "bits"))), lambda x: x["bits"]).alias("fingerprint"))


#: All differences of ``NEAR`` bits or fewer inside a block.
_FLIPS = [sum(1 << i for i in places) for n in range(NEAR + 1) for places in combinations(range(BLOCK), n)]


def _blocks(fingerprint: Column) -> Column:
    """(block, value) of the blocks."""
    part = lambda b: F.shiftrightunsigned(fingerprint[b * BLOCK // 64], b * BLOCK % 64).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")
    return F.array(*(F.struct(F.lit(b).alias("block"), part(b).alias("value")) for b in range(BITS // BLOCK)))


def _near_blocks(fingerprint: Column) -> Column:
    """(block, value) of all values that differ from a block in ``NEAR`` bits or fewer."""
    flips = F.array(*map(F.lit, _FLIPS))
    return F.flatten(F.transform(_blocks(fingerprint), lambda x: F.transform(flips, lambda f: F.struct(x["block"].alias("block"), x["value"].bitwiseXOR(f).alias("value")))))


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def met(prints: DataFrame, items: DataFrame, join: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows of ``prints`` (n_words, fingerprint, ...) beside those of ``items`` (item_id, n_words, item_print) that have a near block in
    common; once for each such block."""
    index = items.select("item_id", "n_words", "item_print", F.inline(_near_blocks(F.col("item_print"))))
    return prints.select("*", F.inline(_blocks(F.col("fingerprint")))).join(join(index), ["n_words", "block", "value"])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance): for each document and item that it holds, the most
    similar window (the first of equals).

    Null, blank and shorter texts have no shingles: such documents hold nothing, such items are held by none. Rows that
    repeat an id are searched each, and the best window of any counts; rows with a null id are not searched. Very long texts
    are searched whole. Other columns are ignored; an empty table on either side gives no rows.
    """
    items = stored(
        benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(item_text)).alias("words"))
        .select("item_id", F.size("words").alias("n_words"), F.array_distinct(_shingles(F.col("words"), True)).alias("shingles"))
        .where(f"n_words >= {WORDS} and item_id is not null"),
        "items",
    )
    weight = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["w"])
    lightest = items.groupBy("n_words").agg(F.min(weight(F.col("shingles"))).alias("least"))
    wanted = items.select("n_words", F.inline("shingles")).distinct().join(lightest, "n_words")
    # copies of items count too: the bounds hold for the rows that would be sent
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    # beyond the bound a shuffle is asked for: Spark's own estimate does not see what explode makes of a small table
    near = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")

    # a text is told from others of its id by its hash
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).where("doc_id is not null")
    key = ["doc_id", "body"]
    hits = texts.select(*key, _words(F.col("text")).alias("words")).select(*key, F.posexplode(_shingles(F.col("words"), False)).alias("at", "h")).join(near(wanted, n_shingles), "h")
    places = F.col("n_words") - (WORDS - 1)
    each = W.partitionBy(*key, "n_words")
    ahead = each.orderBy(F.floor(F.col("at") * F.lit(PARTS).cast("long") / places)).rangeBetween(0, PARTS)
    hits = hits.withColumns({"held": F.sum("w").over(ahead), "last": F.lag("at").over(each.orderBy("at"))}).where((F.col("held") >= AT_LEAST * F.col("least")) & (F.col("last").isNull() | (F.col("last") < F.col("at"))))
    # a window's first hit gives all its possible begins
    hits = hits.select(*key, "n_words", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - places + 1, F.col("last") + 1), F.col("at"))).alias("at"))
    begins = stored(hits.groupBy(*key).agg(F.collect_set(F.struct("at", "n_words")).alias("begins")), "begins")
    # as many rows as documents with hits: never broadcast, whatever the size
    held = begins.hint("merge").join(texts, key).select(*key, "begins", _words(F.col("text")).alias("words")).select(*key, "begins", _shingles(F.col("words"), True).alias("shingles"))
    window = [*key, "at", "n_words"]
    windows = stored(
        held.select(*key, "shingles", F.explode("begins").alias("begin"))
        .select(*key, F.col("begin.at").alias("at"), F.col("begin.n_words").alias("n_words"), F.array_distinct(F.slice("shingles", F.col("begin.at") + 1, F.col("begin.n_words") - (WORDS - 1))).alias("shingles"))
        .dropDuplicates(window),
        "windows",
        begins,
    )

    prints = _fingerprints(windows.select(*window, F.inline("shingles")), window)
    item_prints = _fingerprints(items.select("item_id", "n_words", F.inline("shingles")), ["item_id", "n_words"])
    listed = n_items * (BITS // BLOCK) * len(_FLIPS)
    index = item_prints.withColumnRenamed("fingerprint", "item_print")
    found = met(prints, index, lambda df: near(df, listed)).select(*window, "item_id", _distance(F.col("fingerprint"), F.col("item_print")).alias("distance")).where(f"distance <= {radius}").distinct()

    both = (
        found.join(windows.withColumnRenamed("shingles", "own"), window)
        .join(near(items.select("item_id", F.col("shingles").alias("asked")), n_shingles), "item_id")
        .withColumn("common", weight(F.array_intersect("own", "asked")))
        .withColumn("similarity", F.col("common") / (weight(F.col("own")) + weight(F.col("asked")) - F.col("common")))
        .where(F.col("similarity") >= AT_LEAST)
    )
    best = both.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("similarity", F.negative("at").alias("order"), "distance")).alias("best"))
    return best.select("doc_id", "item_id", F.negative("best.order").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "best.similarity", F.col("best.distance").cast("int").alias("distance"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns and other rows as they are (also null ids)."""
    gone = leaks(docs, benchmark, id_col, **columns).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(gone.hint("merge"), docs[id_col] == gone["__leaked"], "left_anti")
