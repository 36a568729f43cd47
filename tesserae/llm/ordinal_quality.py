"""Operator 4: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score:
``P(grade > j) = sigmoid(w.x - threshold_j)`` with ``threshold_0 < threshold_1 < ...``. The features are presence of
words and of word beginnings, and of bands that the shares of marks, capitals, digits and repeated words reach; the whole
text is read.
The model is fitted on a bounded sample of rated documents (``sample`` rows, those of smallest id hash) that travels to
one executor as packed feature numbers (about 1 kB a row), the driver receives the weights; every document is scored in
place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import textkernel as tk

#: Hashed features; the model is so many 4-byte weights.
BITS = 18
#: Rated documents that the fit takes at most.
SAMPLE = 12_000

_U = np.uint64
_MARK, _CAPITAL, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_MARK[np.frombuffer(b"#*$%&|<>!", np.uint8)] = True
_CAPITAL[65:91] = True
_DIGIT[48:58] = True


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Ascending distinct feature numbers of each text."""
    for lo, hi, data, offsets in tk.chunks(column):
        starts, ends, first = tk.word_bounds(data, offsets)
        prefix = tk.prefix_hash(tk.LOWER[data])
        words = tk.spans(prefix, starts, ends)
        short = tk.spans(prefix, starts, np.minimum(starts + 4, ends)) ^ _U(0x1111)
        longer = tk.spans(prefix, starts, np.minimum(starts + 6, ends)) ^ _U(0x2222)
        shares = []
        for kind in (_MARK, _CAPITAL, _DIGIT):
            total = np.concatenate(([0], np.cumsum(kind[data])))
            shares.append(total[offsets[1:]] - total[offsets[:-1]])
        numbers = (np.stack((words, short, longer), 1).reshape(-1) * _U(0x9E3779B97F4A7C15) >> _U(64 - BITS)).astype(np.int64)
        for row in range(hi - lo):
            a, b = first[row], first[row + 1]
            extra = []
            if b > a:
                size = offsets[row + 1] - offsets[row]
                again = np.count_nonzero(words[a + 1 : b] == words[a : b - 1])
                extra = [1000 + int(np.log2(b - a))]
                for at, share in enumerate((shares[0][row] / size, shares[1][row] / size, shares[2][row] / size, again / (b - a), 1 - len(np.unique(words[a:b])) / (b - a))):
                    extra += [100 * at + band for band in range(int(4 * np.log2(1 + 200 * share)) + 1)]
            own = (tk.mixed(np.array(extra, np.int64).view(np.uint64)) >> _U(64 - BITS)).astype(np.int64)
            yield np.unique(np.concatenate((numbers[3 * a : 3 * b], own)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: Iterable[np.ndarray]) -> np.ndarray:
        """P(grade > j) for each text and threshold; one text's features are held at a time."""
        score = np.fromiter((float(self.weights[x].sum(dtype=np.float64)) for x in found), np.float64)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def fit(found: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = 940, rate: float = 0.02, sparsity: float = 0.022, batch: int = 256) -> Model:
    """Adam on the cumulative-link likelihood with soft thresholding, so that words that say nothing weigh nothing (the
    fewer rated texts, the stronger); weights only for features of five rated texts or more."""
    sizes = np.array([len(x) for x in found])
    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
    common = np.bincount(flat, minlength=1 << BITS) >= 5
    begin = np.concatenate(([0], np.cumsum(sizes)))
    weights = np.zeros(1 << BITS)
    base = np.array([np.mean(grades <= j) for j in range(n_grades - 1)]) if len(grades) else np.full(n_grades - 1, 0.5)
    base = np.clip(base, 0.01, 0.99)
    logits = np.maximum.accumulate(np.log(base / (1 - base)) + 1e-3 * np.arange(n_grades - 1))
    params = np.concatenate((logits[:1], np.log(np.maximum(np.diff(logits), 1e-3))))
    m, v, pm, pv = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(params), np.zeros_like(params)
    order, step = np.random.default_rng(7), 0
    penalty = sparsity / np.sqrt(max(1, len(found)))
    epochs = -(-steps // max(1, -(-len(found) // batch)))
    for epoch in range(epochs if len(found) else 0):
        turn = order.permutation(len(found))
        for at in range(0, len(turn), batch):
            rows = turn[at : at + batch]
            index = np.concatenate([flat[begin[r] : begin[r + 1]] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            score = np.bincount(owner, weights=weights[index], minlength=len(rows))
            cuts = params[0] + np.concatenate(([0.0], np.cumsum(np.exp(params[1:]))))
            above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -50, 50)))
            tail = np.concatenate((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))), 1)
            y = grades[rows]
            r = np.arange(len(rows))
            p = np.maximum(tail[r, y] - tail[r, y + 1], 1e-9)
            slope = tail * (1 - tail)
            d_score = (slope[r, y + 1] - slope[r, y]) / p
            d_cut = np.zeros_like(above)
            inner = y > 0
            d_cut[r[inner], y[inner] - 1] += slope[r, y][inner] / p[inner]
            inner = y < n_grades - 1
            d_cut[r[inner], y[inner]] -= slope[r, y + 1][inner] / p[inner]
            d_cut = d_cut.sum(0) / len(rows)
            grad_w = np.bincount(index, weights=d_score[owner], minlength=1 << BITS) / len(rows) * common
            grad_p = np.concatenate(([d_cut.sum()], [d_cut[j:].sum() * np.exp(params[j]) for j in range(1, len(params))]))
            step += 1
            pace = rate * (1 - epoch / epochs)
            m += 0.1 * (grad_w - m)
            v += 0.001 * (grad_w**2 - v)
            scale = np.sqrt(v / (1 - 0.999**step)) + 1e-6
            weights -= pace * m / (1 - 0.9**step) / scale
            weights = np.sign(weights) * np.maximum(np.abs(weights) - pace * penalty / scale, 0)
            pm += 0.1 * (grad_p - pm)
            pv += 0.001 * (grad_p**2 - pv)
            params -= pace * pm / (1 - 0.9**step) / (np.sqrt(pv / (1 - 0.999**step)) + 1e-8)
    return Model((weights * common).astype(np.float32), params[0] + np.concatenate(([0.0], np.cumsum(np.exp(params[1:])))))


def _numbers(batches):
    for batch in batches:
        found = [zstandard.compress(np.diff(x, prepend=0).astype(np.uint32).tobytes()) for x in features(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "grade", "found"])
    tk.release()


def _fit_in_task(n_grades: int):
    """The sample, all of it in one task, -> the model as one row; none for an empty sample."""

    def run(batches):
        if parts := [b for b in batches if b.num_rows]:
            rows = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("found", "ascending")])
            found = [np.cumsum(np.frombuffer(zstandard.decompress(x.as_py()), np.uint32), dtype=np.int32) for x in rows["found"]]
            model = fit(found, rows["grade"].to_numpy().astype(np.int64), n_grades)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], ["weights", "thresholds"])
        tk.release()

    return run


def fitted(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model of ``ratings`` (``doc_id``, ``grade`` from 0 to n_grades - 1), from ``sample`` rated documents at most.

    Ratings with a null in either column, or outside of these grades, are left out. Without any rated document all weights are 0.
    """
    chosen = ratings.where(f"doc_id is not null and grade between 0 and {n_grades - 1}").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    models = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .select("doc_id", F.col("grade").cast("int").alias("grade"), "text")
        .mapInArrow(_numbers, "doc_id long, grade int, found binary")
        .repartition(1)  # the bounded sample: an executor fits it, so that the driver holds the weights and nothing else
        .mapInArrow(_fit_in_task(n_grades), "weights binary, thresholds binary")
        .collect()
    )
    for weights, thresholds in models:
        return Model(np.frombuffer(bytes(weights), np.float32), np.frombuffer(bytes(thresholds), np.float64))
    return fit([], np.zeros(0, np.int64), n_grades)


def graded(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail_1 .. tail_k (P(grade >= j)) and kept: the last tail reaches ``at_least``.

    Null and empty texts have no features and get the prior of the thresholds. Other columns pass through; columns of
    these names are replaced. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"tail_{j + 1}" for j in range(len(model.thresholds))]
    clash = {"expected_grade", "kept", *names}
    kept = [c for c in docs.columns if c not in clash]
    at = kept.index(text_col)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "expected_grade double", *(f"{n} double" for n in names), "kept boolean"])

    def run(batches):
        for batch in batches:
            tails = shared.value.tails(features(batch.column(at))).reshape(batch.num_rows, len(names))
            new = [pa.array(tails.sum(1)), *(pa.array(np.ascontiguousarray(tails[:, j])) for j in range(len(names))), pa.array(tails[:, -1] >= at_least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*kept, "expected_grade", *names, "kept"])
        tk.release()

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def toxicity_grade() -> Column:
    """The rating of a row of ``labels``: 0 toxic, 1 of low quality, 2 good; null where quality is."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
