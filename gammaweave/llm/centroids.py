"""Lloyd's rounds over vectors of whole numbers, each vector's nearest centroid found by annulus search. All arithmetic is exact.

Centroids are sorted by norm. A vector's distance to the centroids whose norms lie beside its own bounds that to its nearest one from above, so by the triangle
inequality the nearest has a norm within that bound of the vector's: a binary search gives these candidates, and they alone are compared, in whole numbers. The ring is
widened by more than a rounding, so ties at its border are compared too.

Vectors stay in their tasks: a round sends the k centroids out with the task, and each task returns k sums at most, which are summed by a shuffle of k rows a task and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import column
from .shared import scratch

#: Components' bound, so that squared distances of 64 components fit a long; centroids' numbers that the driver holds at once.
MOST_COMPONENT, MOST_CENTROIDS = 1 << 27, 1 << 22
#: Numbers of candidates' components that are compared at once.
BLOCK = 1 << 21


def whole(vectors: DataFrame, *, vec: str = "vec_id", values: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the vectors with exactly `size` components, none of them null or not finite; the others have no row."""
    got = vectors.select(column(vec).alias("vec_id"), column(values).cast("array<double>").alias("x"))
    good = got.where(f"size(x) = {size} AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    fits = f"forall(x, c -> abs({scale} * c) < {MOST_COMPONENT - 1})"
    v = f"CASE WHEN {fits} THEN transform(x, c -> CAST(floor({scale} * c) AS INT)) ELSE raise_error('a component is too large for exact distances') END"
    return good.selectExpr("vec_id", f"{v} AS v")


def seed_hash(vec_id: Column, seed: int = 1) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit("null"))).cast("binary"), 256)


def seeds(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k vectors (or all, if fewer) whose ids have the smallest hashes; ids that are equal go by their components."""
    rows = vectors.select(seed_hash(F.col("vec_id"), seed).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of c, of equally near ones the first, and the squared distance; both hold whole numbers."""
    norms = np.sqrt(np.einsum("ij,ij->i", c, c))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    own = np.sqrt(np.einsum("ij,ij->i", x, x))
    beside = np.searchsorted(norms, own)
    bound = np.minimum(*(squared(x, c[order[np.clip(beside - side, 0, len(c) - 1)]]) for side in (0, 1)))
    reach = np.sqrt(bound)
    reach += 1e-9 * (reach + own + 1)
    first, last = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    upto, a = np.concatenate([[0], np.cumsum(last - first)]), 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK // x.shape[1], "right")) - 1)
        n = (last - first)[a:b]
        begins = upto[a:b] - upto[a]
        rows = np.repeat(np.arange(a, b), n)
        tried = order[np.arange(len(rows)) - np.repeat(begins - first[a:b], n)]
        d = squared(x[rows], c[tried])
        distance[a:b] = np.minimum.reduceat(d, begins)
        cluster[a:b] = np.minimum.reduceat(np.where(d == distance[rows], tried, len(c)), begins)
        a = b
    return cluster, distance


def _rows(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, size)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of each vector; no shuffle."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_rows(batch, centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by its vectors' floor(sum / count), component by component; one without vectors stays."""
    k, size = centroids.shape

    def run(batches):
        total = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, size)
                cluster = nearest(x, centroids)[0]
                order = np.argsort(cluster, kind="stable")
                found, begins = np.unique(cluster[order], return_index=True)
                total[found, :size] += np.add.reduceat(x[order], begins)
                total[found, size] += np.diff(np.append(begins, len(x)))
        some = np.repeat(np.flatnonzero(total[:, size]), size + 1)
        at = np.tile(np.arange(size + 1), len(some) // (size + 1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[some, at])], ["cluster", "at", "total"])

    sums = vectors.select("v").mapInArrow(run, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    got = {(r["cluster"], r["at"]): int(r["total"]) for r in sums.collect()}
    out = centroids.copy()
    for c in range(k):
        if n := got.get((c, size)):
            out[c] = [got[c, i] // n for i in range(size)]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, *, vec: str = "vec_id", values: str = "embedding", size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (array of int) for each kept vector, after `rounds` rounds and one more assignment.

    Kept are vectors with exactly `size` components, none null or not finite, floor(scale * x) each; whole numbers of 2^27 or more fail the job, as their distances
    wouldn't fit. Fewer than k vectors give as many centroids as there are; repeated rows count as often as they stand; a null id is seeded as `null`; no vectors,
    no rows; other columns are not read. k times size is bounded by 2^22, which is what the driver and each task hold.
    """
    if k * size > MOST_CENTROIDS:
        raise ValueError("too many centroids for one driver")
    store = scratch(vectors.sparkSession)
    kept = store(whole(vectors, vec=vec, values=values, size=size, scale=scale))
    c = seeds(kept, k, seed)
    if not len(c):
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "v AS centroid")
    for _ in range(rounds):
        c = moved(kept, c)
    done = store(assign(kept, c))
    sums = {r["cluster"]: r["n"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows at most
    of = [(i, n, sum(sums.values()), c[i].tolist()) for i, n in sums.items()]
    # the k centroids, whose number is bounded above
    return done.join(F.broadcast(vectors.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid array<int>")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
