"""Hard-negative mining: for an anchor and each of its positives, the best rows of other labels within a window of scores.

A score is the integer inner product of two vectors. The anchors of a block stand in a minimum spanning tree. A row x
scores at an anchor what it scores at the anchor's parent, give or take the length of the tree's edge times the length
of x; so bounds run down the tree from the root, where all rows are scored. A row is scored again at an anchor only
where its bounds overlap what is asked there: the best scores of the anchor's label first, then the windows of its
positives. Where it was scored, its bounds are exact for the anchor's children.

Anchors are a fixed share of the rows, so blocks of anchors meet slices of rows in tiles: a tile holds at most about
BLOCK anchors and SLICE rows, whatever the input, and returns a bounded number of rows an anchor. An anchor's block
is told by signs of its components, so that near anchors are in one tree; a hot sign pattern is split by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.llm.util import Work, lean, stored

#: Anchors of a block and rows of a slice: what a tile holds.
BLOCK, SLICE = 512, 8192
#: Components are held within this range, so that sums of products stay exact.
MOST = 1 << 24


def usable(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(vector: Column, by: int, most: int = MOST) -> Column:
    """Integer components floor(by * x), x as double, held within most."""
    held = lambda x: F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), F.lit(float(by)) * x.cast("double")))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, length of the edge) of a minimum spanning tree, parents first; the root's parent is -1."""
    n = len(vectors)
    near, parent, inside = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    square = np.einsum("ij,ij->i", vectors, vectors)
    at, out = 0, []
    for _ in range(n):
        out.append((at, int(parent[at]), float(np.sqrt(near[at])) if parent[at] >= 0 else 0.0))
        inside[at] = True
        apart = np.maximum(square + square[at] - 2 * (vectors @ vectors[at]), 0)
        closer = ~inside & (apart < near)
        near[closer], parent[closer] = apart[closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
    return out


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _width(*columns) -> int:
    sizes = [np.diff(c.combine_chunks().offsets.to_numpy()) for c in columns]
    return max([1, *(int(s.max()) for s in sizes if len(s))])


class Tile:
    """The anchors of a block and the rows of a slice, with bounds of all scores."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        width = _width(anchors.column("q"), rows.column("q"))
        self.a, self.x = _matrix(anchors.column("q"), width), _matrix(rows.column("q"), width)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        longest = float(np.sqrt(np.einsum("ij,ij->i", self.a, self.a)).max(initial=0))
        self.exact = np.float64 if longest * float(self.norm.max(initial=0)) < 2**52 else np.int64  # sums of products are exact in either
        if self.exact is np.int64:
            self.a, self.x = self.a.astype(np.int64), self.x.astype(np.int64)
        self.tree = spanning_tree(self.a.astype(np.float64))

    def walk(self, wanted):
        """For each anchor, parents first: its number, the rows that were scored and their scores.

        wanted(anchor, lo, hi) says which rows' bounds overlap what is asked at the anchor.
        """
        left = np.bincount([p for _, p, _ in self.tree if p >= 0], minlength=len(self.tree))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for node, parent, edge in self.tree:
            if parent < 0:
                mask, lo, hi = np.ones(len(self.x), bool), np.empty(len(self.x)), np.empty(len(self.x))
            else:
                slack = edge * self.norm * (1 + 1e-9) + 1e-3  # rounding, too
                lo, hi = bounds[parent][0] - slack, bounds[parent][1] + slack
                mask = wanted(node, lo, hi)
                left[parent] -= 1
                if not left[parent]:
                    del bounds[parent]
            some = np.flatnonzero(mask)
            scores = (self.x if len(some) == len(self.x) else self.x[some]) @ self.a[node]
            lo[some] = hi[some] = scores
            if left[node]:
                bounds[node] = lo, hi
            yield node, some, scores.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first, by score down and id up."""
    if len(ids) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _tiles(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, f, schema: str) -> DataFrame:
    """f(anchors, rows) for each tile of a block and a slice."""
    n_slices = max(1, -(-n_rows // SLICE))
    bits = max(0, (max(1, n_anchors // BLOCK)).bit_length() - 1)
    code = F.concat(F.lit("b"), *[F.when(F.coalesce(F.try_element_at("q", F.lit(i + 1)), F.lit(0)) >= 0, "1").otherwise("0") for i in range(bits)])
    coded = anchors.withColumn("code", code)
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))  # one row a sign pattern
    blocks = coded.join(sizes, "code").withColumn("block", F.concat("code", F.lit("/"), F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("string"))).drop("code", "k")
    names = sizes.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat("code", F.lit("/"), i.cast("string")))).alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice")
    # each slice is dealt to every block: the anchors are a stated set of queries against all rows
    dealt = names.select("block", every).join(rows.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_slices)).cast("int")), "slice")
    return blocks.select("*", every).groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInArrow(f, schema)


def positives(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, count: int = 5) -> DataFrame:
    """(anchor_id, positive_id, positive_score): the first `count` other rows of each anchor's label."""

    @lean
    def tile(a: pa.Table, x: pa.Table) -> pa.Table:
        anchor, label, ids, labels = (t.column(c).to_numpy() for t in (a, x) for c in ("id", "label"))
        out = ([], [], [])
        if len(anchor) and len(ids):
            t = Tile(a, x)

            def wanted(node, lo, hi):
                same = (labels == label[node]) & (ids != anchor[node])
                low = lo[same]
                least = np.partition(low, len(low) - count)[len(low) - count] if len(low) > count else -np.inf
                return same & (hi >= least)

            for node, some, scores in t.walk(wanted):
                own = (labels[some] == label[node]) & (ids[some] != anchor[node])
                some, scores = some[own], scores[own]
                first = _best(ids[some], scores, count)
                for o, v in zip(out, (np.full(len(first), anchor[node]), ids[some[first]], scores[first]), strict=True):
                    o.append(v)
        cols = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out]
        return pa.Table.from_arrays(cols, ["anchor_id", "positive_id", "positive_score"])

    found = _tiles(rows, anchors, n_rows, n_anchors, tile, "anchor_id long, positive_id long, positive_score long")
    best = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= count).drop("r")


def negatives(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, count: int, window: tuple[int, int, int]) -> DataFrame:
    """The first `count` rows of another label in the window of each positive. anchors have `p`, an array of
    (positive_id, positive_score). window: low and high bound in parts of the third number."""
    low, high, of = window

    @lean
    def tile(a: pa.Table, x: pa.Table) -> pa.Table:
        anchor, label, ids, labels = (t.column(c).to_numpy() for t in (a, x) for c in ("id", "label"))
        out = ([], [], [], [], [])
        if len(anchor) and len(ids):
            t = Tile(a, x)
            asked = a.column("p").to_pylist()
            windows = [[(-(-low * p["positive_score"] // of), high * p["positive_score"] // of) for p in own] for own in asked]

            def wanted(node, lo, hi):
                other, mask = labels != label[node], np.zeros(len(ids), bool)
                for least, most in windows[node]:
                    some = other & (hi >= least) & (lo <= most)
                    sure = lo[some & (lo >= least) & (hi <= most)]
                    if len(sure) > count:  # so many rows of the window are at least as good
                        some &= hi >= np.partition(sure, len(sure) - count)[len(sure) - count]
                    mask |= some
                return mask

            for node, some, scores in t.walk(wanted):
                own = labels[some] != label[node]
                some, scores = some[own], scores[own]
                for p, (least, most) in zip(asked[node], windows[node], strict=True):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    first = inside[_best(ids[some[inside]], scores[inside], count)]
                    for o, v in zip(out, (np.full(len(first), anchor[node]), np.full(len(first), p["positive_id"]), ids[some[first]], np.full(len(first), p["positive_score"]), scores[first]), strict=True):
                        o.append(v)
        cols = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out]
        return pa.Table.from_arrays(cols, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = _tiles(rows, anchors, n_rows, n_anchors, tile, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    rows: DataFrame, anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 10, window: tuple[int, int, int] = (30, 90, 100),
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    anchor: a condition on the rows. Components become floor(scale * x), held within +-2 ** 24. An anchor's positives are
    its first rows of the same label, itself aside; negatives are the first rows of another label whose score lies between
    window[0] and window[1] of window[2] parts of the positive's. Higher scores come first, ties by smaller id. Rows with
    a null id, a null label, a null vector or a component that is null or not finite take no part. Repeated rows count
    once; of different rows with one id, the least by label and vector counts. Shorter vectors end in zeros, empty ones
    score 0. Other columns are not read, whatever their names; an empty table gives an empty result, and so does one
    without anchors; anchors without a positive or without a row in the window give no row.
    """
    label, vector, i = F.col(label_col), F.col(vector_col), F.col(id_col)
    kept = rows.where(i.isNotNull() & label.isNotNull() & usable(vector))
    kept = kept.select(i.cast("long").alias("id"), F.struct(label.cast("long").alias("label"), scaled(vector, scale).alias("q"), anchor.alias("anchor")).alias("r"))
    work = Work(rows.sparkSession)
    table = work.store(kept.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*"))
    anchors = table.where("anchor").drop("anchor")
    table = table.drop("anchor")
    n_rows, n_anchors = table.count(), anchors.count()
    own = work.store(positives(table, anchors, n_rows, n_anchors, n_positives))
    asked = anchors.join(own.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p")), "id")
    out = stored(negatives(table, asked, n_rows, n_anchors, n_negatives, window))
    work.clear()
    return out
