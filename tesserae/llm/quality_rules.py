"""Operator 1: quality rules as gradient-boosted trees over document statistics.

The statistics of a text are counted in one vectorised pass. Trees are boosted on a bounded sample of rated documents with
histogram splits; on the features of ``MONOTONE`` a higher value can only lower the score. The trees are flattened into
numpy node arrays, so that a batch of documents is scored level by level without a loop over documents. Scoring takes one
pass over the table and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textkernel as tk

#: Rated documents that the fit takes at most.
SAMPLE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "capital_share", "digit_share",
    "mark_share", "distinct_share", "adjacent_share", "mean_line", "beyond_ascii_share",
)
#: Features of which more is never better.
MONOTONE = ("symbol_share", "dup_line_share", "repeat_share", "capital_share", "adjacent_share")
#: The fixed rules: fewer words, or a greater per cent of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50

_U = np.uint64


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_SYMBOL, _CAPITAL, _DIGIT = _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58)))
_MARK = _mask(b"!\"'(),-./:;?@[\\]^_`{}~+=")
_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])  # the first byte of a code point


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place in the run of equals, length of that run) of (owner, key), sorted so that equals are in order."""
    joint = tk.mixed(keys ^ tk.mixed(owner.astype(np.uint64)))
    order = np.argsort(joint, kind="stable")
    joint = joint[order]
    new = np.flatnonzero(np.concatenate(([True], joint[1:] != joint[:-1]))) if len(joint) else np.zeros(0, np.int64)
    runs = np.diff(np.append(new, len(joint)))
    return order, np.arange(len(joint)) - np.repeat(new, runs), np.repeat(runs, runs)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features): int64 rows of COUNTS and float64 rows of FEATURES, one for each text; null is empty."""
    counts, shown = [np.zeros((0, len(COUNTS)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for lo, hi, data, offsets in tk.chunks(column):
        n = hi - lo

        def total(mask, data=data, offsets=offsets):
            running = np.concatenate(([0], np.cumsum(mask[data] if mask.shape == (256,) else mask)))
            return running[offsets[1:]] - running[offsets[:-1]]

        starts, ends, first = tk.word_bounds(data, offsets)
        prefix = tk.prefix_hash(data)
        words = tk.spans(prefix, starts, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        n_words = np.diff(first)
        word_chars = total(_FIRST & ~tk._WHITE)
        symbols = total(_SYMBOL)

        cuts = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate((offsets[:-1][offsets[:-1] < offsets[1:]], cuts + 1)))
        begin = begin[begin < len(data)]
        line_doc = np.searchsorted(offsets, begin, "right") - 1
        stop = np.minimum(offsets[line_doc + 1], np.append(cuts, len(data))[np.searchsorted(cuts, begin)])
        full = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
        begin, stop, line_doc = begin[full], stop[full], line_doc[full]
        n_lines = np.bincount(line_doc, minlength=n)
        order, place, _ = _repeats(tk.spans(prefix, begin, stop), line_doc)
        dup_lines = np.bincount(line_doc[order][place > 0], minlength=n)

        grams = tk.windows(words, 3)
        whole = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
        order, _, runs = _repeats(grams[whole], doc[whole])
        cover = np.zeros(len(words) + 1, np.int64)
        twice = whole[order][runs > 1]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
        repeated = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)

        order, place, _ = _repeats(words, doc)
        distinct = np.bincount(doc[order][place == 0], minlength=n)
        same = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
        adjacent = np.bincount(doc[same], minlength=n)

        size, of = np.maximum(np.diff(offsets), 1), np.maximum(n_words, 1)
        chars = np.maximum(word_chars, 1)
        counts.append(np.stack((n_words, word_chars, symbols, dup_lines, repeated), 1))
        shown.append(
            np.stack(
                (np.log1p(n_words), word_chars / of, symbols / chars, dup_lines / np.maximum(n_lines, 1), repeated / of, total(_CAPITAL) / chars, total(_DIGIT) / chars,
                 total(_MARK) / chars, distinct / of, adjacent / of, np.log1p(n_words / np.maximum(n_lines, 1)), (size - total(_FIRST)) / size), 1)
        )
    return np.concatenate(counts).astype(np.int64), np.concatenate(shown)


@dataclass(frozen=True)
class Trees:
    """Flattened trees: node arrays, the root of each tree, and the score that all start from."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of ``x``: every row descends every tree at once; a leaf is its own child."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def boost(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Logistic boosting with histogram splits. ``monotone``: -1, 0 or 1 for each feature.

    A split on a constrained feature must order its children's values, and the middle of the two then bounds what either
    side can become further down.
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    coded = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], 1) if len(x) else None
    score = np.full(len(y), base)

    def leaf(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(at), right.append(at), value.append(v)
        return at

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                n = len(edges[f]) + 1
                code = coded[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(code, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = -gl / (hl + ridge), -(total_g - gl) / (total_h - hl + ridge)
                gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                fine = (nl >= least) & (len(rows) - nl >= least)
                if monotone[f]:
                    fine &= monotone[f] * (vr - vl) >= 0
                gain = np.where(fine, gain, 0)
                at = int(np.argmax(gain))
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], f, at, float(np.clip(vl[at], low, high)), float(np.clip(vr[at], low, high)))
        if best is None:
            v = float(np.clip(-total_g / (total_h + ridge), low, high))
            score[rows] += rate * v
            return leaf(rate * v)
        _, f, at, vl, vr = best
        node = leaf(0.0)
        middle = (vl + vr) / 2
        goes = coded[rows, f] <= at
        bounds = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}[int(monotone[f])]
        feature[node], threshold[node] = f, float(edges[f][at])
        left[node] = grow(rows[goes], g, h, level + 1, *bounds[0])
        right[node] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return node

    for _ in range(n_trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), 0, -np.inf, np.inf))
    whole = lambda a: np.array(a, np.int64)
    return Trees(whole(feature), np.array(threshold), whole(left), whole(right), np.array(value), whole(roots), base, depth)


def _sampled(batches):
    for batch in batches:
        _, x = statistics(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "good", "x"])


def fitted(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees:
    """Trees for ``ratings`` (``doc_id``, ``good`` 0 or 1), from ``sample`` rated documents at most (those of smallest id
    hash); ratings with a null are left out. Without any rated document every score is even."""
    chosen = ratings.where("doc_id is not null and good is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(sample)
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .select("doc_id", F.col("good").cast("int").alias("good"), "text")
        .mapInArrow(_sampled, "doc_id long, good int, x array<double>")
        .toArrow()
        .to_pylist()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["good"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return boost(x, np.array([r["good"] for r in rows], np.float64), np.array([-1 if f in MONOTONE else 0 for f in FEATURES]))


def judged(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """(doc_id, the COUNTS, base_failed, score, kept) for each row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half the words repeated in 3-word windows. ``score`` is the trees'
    probability of good quality; ``kept`` is false where base_failed, else whether the score reaches ``at_least``. Null and
    blank texts have zero counts and fail; repeated rows are judged each; a null id stays; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            counts, x = statistics(batch.column(1))
            score = 1 / (1 + np.exp(-np.clip(shared.value.score(x), -50, 50)))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(len(COUNTS))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= at_least))],
                ["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
