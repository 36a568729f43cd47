"""Operator 13: centroid clustering with Hamerly's bounds, on integers.

Each vector keeps its cluster, one upper bound of the distance to that centroid and one lower bound of the distance to the
second nearest. When centroids move, the upper bound grows by the own centroid's drift and the lower one shrinks by
the greatest drift of the others. A vector whose upper bound stays below its lower bound (or below half the distance from
its centroid to the nearest other) keeps its cluster unread; otherwise the upper bound is made exact, and if
that does not settle it, the vector is ambiguous: all centroids are scanned with exact integers. Bounds are floats, rounded outwards by
a part in 10**12, and decide only when strict, so ties always come to the exact scan.

A round is one pass: it reads vectors and bounds, writes both, and each task adds one row for each cluster with
its sum of vectors and their number. Only those rows are read to move the centroids. The tables are written in the shared folder; a round's table goes when
the next one stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.stored import stored

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Scaled components stay within it, so that squared distances fit 64 bits.
LIMIT = 1 << 27
_STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, distance long, scans int, n long, total array<long>"
_OUT = 1 + 1e-12
_IN = 1 - 1e-12


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors from all centroids, exact."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = vectors - centroid
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other, never too large."""
    apart = np.sqrt(distances(centroids, centroids).astype(np.float64)) * _IN / 2
    np.fill_diagonal(apart, np.inf)
    return apart.min(1)


def reassigned(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, scanned) after the centroids moved from ``before`` to ``now``; cluster -1 has no bounds yet."""
    drift = np.sqrt(((now - before) ** 2).sum(1).astype(np.float64)) * _OUT
    others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(len(now))])
    known = cluster >= 0
    own = np.where(known, cluster, 0)
    cluster = cluster.copy()
    upper, lower = (upper + drift[own]) * _OUT, np.maximum(lower - others[own], 0) * _IN
    bound = np.maximum(lower, between(now)[own])
    doubt = np.flatnonzero(known & (upper >= bound))
    apart = vectors[doubt] - now[own[doubt]]
    upper[doubt] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64)) * _OUT
    scanned = ~known
    scanned[doubt] = upper[doubt] >= bound[doubt]
    rows = np.flatnonzero(scanned)
    exact = distances(vectors[rows], now)
    cluster[rows] = exact.argmin(1)  # of equals the smaller number
    at = np.arange(len(rows))
    upper[rows] = np.sqrt(exact[at, cluster[rows]].astype(np.float64)) * _OUT
    if len(now) > 1:
        lower[rows] = np.sqrt(np.partition(exact, 1, 1)[:, 1].astype(np.float64)) * _IN
    else:
        lower[rows] = np.inf
    return cluster, upper, lower, scanned


def _round(before: np.ndarray, now: np.ndarray, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, inertia = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(np.int64)
            cluster, upper, lower, scanned = reassigned(vectors, *(batch[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")), before, now)
            for c in range(len(now)):
                total[c] += vectors[cluster == c].sum(0)
            n += np.bincount(cluster, minlength=len(now))
            distance = None
            if last:
                apart = vectors - now[cluster]
                distance = np.einsum("ij,ij->i", apart, apart)
                np.add.at(inertia, cluster, distance)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch["vec_id"], "vector": pa.nulls(len(batch), pa.list_(pa.int32())) if last else batch["vector"], "cluster": pa.array(cluster.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower),
                    "distance": pa.array(distance, pa.int64()) if last else pa.nulls(len(batch), pa.int64()), "scans": pa.array(batch["scans"].to_numpy() + scanned.astype(np.int32), pa.int32()),
                    "n": pa.nulls(len(batch), pa.int64()), "total": pa.nulls(len(batch), pa.list_(pa.int64())),
                }
            )
        some = np.flatnonzero(n)
        blank = {c: pa.nulls(len(some), t) for c, t in (("vec_id", pa.int64()), ("vector", pa.list_(pa.int32())), ("upper", pa.float64()), ("lower", pa.float64()))}
        yield pa.RecordBatch.from_pydict(
            {
                "vec_id": blank["vec_id"], "vector": blank["vector"], "cluster": pa.array(some.astype(np.int32)), "upper": blank["upper"], "lower": blank["lower"], "distance": pa.array(inertia[some]),
                "scans": pa.nulls(len(some), pa.int32()), "n": pa.array(n[some]), "total": pa.array(total[some].tolist(), pa.list_(pa.int64())),
            }
        )

    return assigned


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has ``dimensions`` finite components, each as floor(1024 * x)."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE))
    sound = (F.size(vector_col) == dimensions) & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LIMIT / SCALE))
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(scaled, lambda x: x.cast("int")).alias("vector"))


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans) for each kept vector; ``scans`` is how often
    it was compared with all centroids.

    Left out are null vectors, vectors of another length and such with a null, infinite or NaN component, or with one of
    131,072 or more (its squared distances would not fit 64 bits). Rows that repeat an id are vectors of their own. First
    centroids are those of smallest sha256 of ``3:<vec_id>``, null ids last, of equals the smaller vector; with fewer than
    ``k`` vectors there are as many centroids. Other columns are ignored; an empty table gives no rows. ``k`` centroids
    are what reaches the driver and what is sent to tasks.
    """
    kept = integers(vectors, id_col, vector_col, dimensions)
    seed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(seed.asc_nulls_last(), "vector").limit(k).collect()
    now = before = np.array([r["vector"] for r in first], np.int64).reshape(len(first), dimensions)
    state = kept.select("*", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans"))
    standing = None
    for turn in range(rounds + 1):
        last = turn == rounds
        done = stored(state.mapInArrow(_round(before, now, last), _STATE), "clusters", standing)
        standing = done
        state = done.where("n is null").select("vec_id", "vector", "cluster", "upper", "lower", "scans")
        sums = done.where("n is not null")
        if last:
            break
        before, now = now, now.copy()
        for r in sums.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect():
            now[r["cluster"], r["pos"]] = r["total"] // r["n"]
    names = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in now.tolist())) if len(now) else F.array().cast("array<string>")
    held = {r["cluster"]: r["n"] for r in sums.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    each = F.array(*(F.lit(held.get(c, 0)).cast("long") for c in range(len(now)))) if len(now) else F.array().cast("array<bigint>")
    own = F.col("cluster") + 1
    return done.where("n is null").select(
        "vec_id", "cluster", "distance", F.element_at(each, own).alias("cluster_inertia"), F.lit(sum(held.values())).cast("long").alias("inertia"), F.element_at(names, own).alias("centroid_sha256"), "scans"
    )
