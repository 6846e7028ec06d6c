"""Centroid clustering of integer vectors: rounds of nearest assignment by a threshold algorithm, and exact means.

The nearest centroid of a vector is found from sorted lists: in each dimension the centroids stand in the order of their
component, and the lists are walked outward from the vector's own value, all dimensions in step. A centroid met for the
first time gets its exact squared distance. A centroid not yet met lies, in every dimension, at least as far away as
the last one met there, so the sum of the frontier's squared gaps bounds its distance from below: a vector is done as
soon as that sum strictly exceeds its best exact distance (strictly, since an equal distance may have a smaller number).

A round is one job over the vectors: tasks assign, and hand on one sum a cluster and dimension; k * (dimensions + 1)
numbers reach the driver, whatever the input, and the next round's centroids go out with its tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.hard_negatives import scaled, usable
from corpusmem.llm.util import Work, extended, lean

#: Components are held within this range: 64 squared differences stay below 2 ** 63.
MOST = 1 << 27
#: Vectors that are walked at once.
STEP = 4096


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of x; ties go to the smaller number."""
    n, dims = x.shape
    k = len(centroids)
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)  # ascending components of each dimension
    right = np.stack([np.searchsorted(lists[:, d], x[:, d]) for d in range(dims)], axis=1) if dims else np.zeros((n, 0), np.int64)
    left = right - 1
    best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    met = np.zeros((n, k), bool)
    live, across = np.arange(n), np.arange(dims)[None, :]
    far = np.iinfo(np.int64).max
    for _ in range(k):
        # the nearer of both neighbours in every dimension
        xs, lo, hi = x[live], left[live], right[live]
        below = np.where(lo >= 0, xs - lists[np.maximum(lo, 0), across], far)
        above = np.where(hi < k, lists[np.minimum(hi, k - 1), across] - xs, far)
        down = below <= above
        gap = np.where(down, below, above)
        at = order[np.where(down, lo, np.minimum(hi, k - 1)), across]
        left[live], right[live] = lo - down, hi + ~down
        new = np.zeros((len(live), k), bool)
        new[np.arange(len(live))[:, None], at] = True
        new &= ~met[live]
        met[live] |= new
        for c in range(k):  # exact distances of centroids met just now
            some = live[new[:, c]]
            apart = x[some] - centroids[c]
            apart = np.einsum("ij,ij->i", apart, apart)
            better = (apart < best[some]) | ((apart == best[some]) & (c < number[some]))
            best[some[better]], number[some[better]] = apart[better], c
        frontier = np.einsum("ij,ij->i", gap, gap)
        live = live[(frontier <= best[live]) & ~met[live].all(axis=1)]
        if not len(live):
            break
    return number, best


def vectors(rows: DataFrame, dims: int, scale: int, vector_col: str) -> Column:
    """The condition that a vector is kept: `dims` components, none null or not finite."""
    return usable(F.col(vector_col)) & (F.size(vector_col) == dims)


def _blocks(column, dims: int):
    """Integer rows of an Arrow list column, STEP at a time."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    for i in range(0, len(flat), STEP):
        yield flat[i : i + STEP]


def sums(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, sum of distances, sums of components) of each centroid's cluster; table: (q)."""
    k, dims = centroids.shape

    @lean
    def run(batches):
        total = np.zeros((k, dims + 2), np.int64)
        for batch in batches:
            for x in _blocks(batch.column(0), dims):
                number, apart = nearest(x, centroids)
                for c in range(k):
                    own = number == c
                    total[c, 0] += own.sum()
                    total[c, 1] += apart[own].sum()
                    total[c, 2:] += x[own].sum(axis=0)
        place = np.flatnonzero(np.repeat(total[:, 0] > 0, dims + 2))
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], ["place", "v"])

    found = table.select("q").mapInArrow(run, "place int, v long").groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # k * (dims + 2) rows at most
    out = np.zeros(k * (dims + 2), np.int64)
    out[found.column("place").to_numpy()] = found.column("v").to_numpy()
    out = out.reshape(k, dims + 2)
    return out[:, 0], out[:, 1], out[:, 2:]


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly dims components, none null or not finite; components become floor(scale * x), held
    within +-2 ** 27. Centroids start as the k kept vectors with the least sha256 of `seed:id`, in that order; null ids
    start none, and of vectors with one id the least does. Fewer than k such ids make fewer centroids; without any the
    result is empty. Each round assigns every vector to the nearest centroid, ties to the smaller number, and moves
    every non-empty centroid to the exact floor of its vectors' mean; then vectors are assigned once more. Repeated rows
    are vectors of their own, also those with a null id. Other columns are not read, whatever their names.
    """
    spark = rows.sparkSession
    kept = rows.where(vectors(rows, dims, scale, vector_col)).select(F.col(id_col), scaled(F.col(vector_col), scale, MOST).alias("q"))
    work = Work(spark)
    table = work.store(kept)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    first = table.where(F.col(id_col).isNotNull()).groupBy(key.alias("h")).agg(F.min("q").alias("q")).orderBy("h").limit(k).collect()  # k rows
    if not first:
        work.clear()
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], extended(rows.select(id_col).schema, **dict(c.split() for c in none.split(", "))))
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        n, _, total = sums(table, centroids)
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
    _, inertia, _ = sums(table, centroids)
    work.clear()
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = int(inertia.sum())

    @lean
    def assign(batches):
        for batch in batches:
            done = 0
            for x in _blocks(batch.column(1), dims):
                number, apart = nearest(x, centroids)
                cols = [batch.column(0).slice(done, len(x)), pa.array(number.astype(np.int32)), pa.array(apart), pa.array(inertia[number]), pa.array(np.full(len(x), whole)), pa.array([digests[c] for c in number])]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
                done += len(x)

    return kept.mapInArrow(assign, extended(kept.select(id_col).schema, cluster="int", distance="long", cluster_inertia="long", inertia="long", centroid_sha256="string"))
