"""Operator 11: source divergence audit by dense matrices of term blocks.

How far does the wording of each source stand from that of the others of its language, and which terms set it apart?

1. Terms are counted per (language, source) inside tasks, in parts of bounded size; counts meet by a shuffle on
   (language, source, term). A language keeps the terms that stand in ``MIN_DOCS`` of its documents.
2. Kept terms of a language are dealt by hash into blocks of some ``TERMS`` terms, its sources into parts of some
   ``SOURCES`` sources. A tile is one block and one pair of parts: an int64 matrix of groups by terms, zeros included,
   since smoothing gives absent terms a chance as well.
3. In each tile numpy broadcasts all pairs of its groups over all its terms, in strips of bounded size, which gives a
   partial pair matrix; and each group keeps a heap of its ``TOP`` terms.
4. Partial matrices are summed per pair of sources, heaps are merged per group (Spark cuts each task's rows to the
   ``TOP`` of a group before they are shuffled).

A hot language has more blocks, a hot source more parts of counts that are summed before the shuffle; neither makes a task
larger. Chances are integers to the billion. All arithmetic is exact while a language has at most 9e15 occurrences and 4e9 kept terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.sources.stored import removed, stored

MIN_DOCS = 3
TOP = 200
TERMS = 4096
SOURCES = 256
#: Cells that one strip of a tile may compare at once.
STRIP = 1 << 21
#: Distinct terms that a task holds before it hands them on.
HELD = 300_000
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 22
#: Languages whose sizes are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_TILE = "lang string, source string, part string, item string, value long"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some ``SLICE`` bytes of it at a time."""
    text = text.translate(_TERM)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def handed_on() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (total, docs) in seen.items() for term, n in total.items()]
        seen.clear()
        lang, source, term, n, docs = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=names)

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            total, docs = seen[lang, source]
            before, own = len(total), set()
            for terms in slices(text.as_py()):
                total.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(total) - before
            if held >= HELD:
                yield handed_on()
                held = 0
    yield handed_on()


def chances(counts: np.ndarray, total: np.ndarray | int, vocabulary: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (total + vocabulary)), by long division in three steps of a thousand."""
    below = np.asarray(total, np.int64) + vocabulary
    whole, rest = np.divmod(counts + 1, below)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + step
    return 1 + whole


def _leading(values: np.ndarray, terms: list[str], top: int) -> list[tuple[int, str]]:
    """The ``top`` pairs of greatest value, of equals the first term."""
    if len(values) > top:
        least = np.partition(values, len(values) - top)[len(values) - top]
        chosen = np.flatnonzero(values >= least)
    else:
        chosen = np.arange(len(values))
    return sorted(((int(values[i]), terms[i]) for i in chosen), key=lambda x: (-x[0], x[1]))[:top]


def tile(key: tuple[pa.Scalar, ...], table: pa.Table, top: int = TOP, strip: int = STRIP) -> pa.Table:
    """Partial pair values and heaps of one tile.

    ``table`` has the tile's groups (kind 0: source, its part, n occurrences, and the language's own total and
    vocabulary), its kept terms (kind 1: n in the language) and counts (kind 2).
    """
    lang, _, left, right = (x.as_py() for x in key)
    kind = table["kind"]
    groups, kept, counts = (table.filter(pc.equal(kind, k)) for k in range(3))
    parts = groups["own"].to_numpy()
    order = np.lexsort((np.array(groups["source"].to_pylist(), object), parts)) if len(parts) else np.zeros(0, np.int64)
    groups = groups.take(pa.array(order))
    names, parts = groups["source"].combine_chunks(), parts[order]
    vocabulary, in_lang = (groups[c][0].as_py() for c in ("vocabulary", "in_lang"))
    terms = kept["term"].combine_chunks()
    matrix = np.zeros((len(names), len(terms)), np.int64)
    if len(counts):
        matrix[pc.index_in(counts["source"], names).to_numpy(), pc.index_in(counts["term"], terms).to_numpy()] = counts["n"].to_numpy()
    p = chances(matrix, groups["n"].to_numpy()[:, None], vocabulary) if len(terms) else matrix
    named, found = names.to_pylist(), []

    rows, columns = np.flatnonzero(parts == left), np.flatnonzero(parts == right)
    high = p[columns][None]
    step = max(1, strip // max(1, len(columns) * len(terms)))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        low = p[some][:, None]
        squares = (low - high) ** 2
        for i, values in zip(some, (squares // high).sum(2), strict=True):
            found += [(named[i], "pair", named[j], int(v)) for j, v in zip(columns, values, strict=True) if i != j]
        if left != right:
            for i, values in zip(some, (squares // low).sum(2), strict=True):
                found += [(named[j], "pair", named[i], int(v)) for j, v in zip(columns, values, strict=True)]
    if left == right and len(terms):
        q, words = chances(kept["n"].to_numpy(), in_lang, vocabulary), terms.to_pylist()
        for i in rows:
            over = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
            values = (p[i, over] - q[over]) ** 2 // q[over]
            found += [(named[i], "term", word, v) for v, word in _leading(values, [words[t] for t in over], top)]
    source, part, item, value = zip(*found, strict=True) if found else [()] * 4
    text = pa.string()
    return pa.table({"lang": pa.array([lang] * len(found), text), "source": pa.array(source, text), "part": pa.array(part, text), "item": pa.array(item, text), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = TERMS, width: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: each other source of the language with the summed divergence from it, all ranks. Part ``term``: the
    ``top`` terms that the source uses more than its language does. Ranks begin at 1, by value descending, then item.

    Null text, lang and source count as empty strings. Every row is a document, also where ids repeat. A source without
    kept terms takes part (all its chances are equal); a language without kept terms gives pairs of value 0; a source that
    is alone in its language has no pairs. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    by_term = W.partitionBy("lang", "term")
    counts = stored(
        own.mapInArrow(_counted, _COUNTS)
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumns({"docs": F.sum("docs").over(by_term), "total": F.sum("n").over(by_term), "first": F.min("source").over(by_term) == F.col("source")})
        .where(F.col("docs") >= min_docs).drop("docs"),
        "counts",
    )
    groups = stored(own.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    langs = (
        groups.groupBy("lang").agg(F.count("*").alias("sources"))
        .join(counts.groupBy("lang").agg(F.count_if("first").alias("vocabulary"), F.sum("n").alias("in_lang")), "lang", "left").fillna(0)
        .select("lang", "vocabulary", "in_lang", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / block)).alias("blocks"), F.ceil(F.col("sources") / width).alias("parts"))
    )
    langs = stored(langs, "langs")
    if langs.count() <= BROADCAST_ROWS:
        langs = F.broadcast(langs)

    parts, part = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.pmod(F.xxhash64("source"), F.col("parts"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("left"), F.greatest(a, b).alias("right"))
    with_others = F.explode(F.transform(parts, lambda b: pair(part, b)))
    all_pairs = F.explode(F.flatten(F.transform(parts, lambda a: F.transform(F.sequence(a, F.col("parts") - 1), lambda b: pair(a, b)))))
    where = F.pmod(F.xxhash64("term"), F.col("blocks"))
    none = lambda kind: F.lit(None).cast(kind)
    columns = ("source", "own", "term", "n", "vocabulary", "in_lang")

    def tiled(rows: DataFrame, kind: int, block, pairs) -> DataFrame:
        rows = rows.join(langs, "lang").withColumns({"own": part if kind != 1 else none("long"), "block": block})
        return rows.select("lang", "block", pairs.alias("pair"), F.lit(kind).alias("kind"), *columns)

    members = (
        tiled(groups.withColumn("term", none("string")), 0, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), with_others)
        .union(tiled(counts.where("first").select("lang", none("string").alias("source"), "term", F.col("total").alias("n")), 1, where, all_pairs))
        .union(tiled(counts.select("lang", "source", "term", "n"), 2, where, with_others))
        .select("lang", "block", "pair.left", "pair.right", "kind", *columns)
    )

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return tile(key, table, top)

    tiles = stored(members.groupBy("lang", "block", "left", "right").applyInArrow(each, _TILE), "tiles")
    removed(counts)
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    heaps = tiles.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.union(heaps)
