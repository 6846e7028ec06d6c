"""Packing into token windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.util import extended, lean, stored
from corpusmem.llm.vocab import Encoder, whole_tokens

CAPACITY = 2048
#: Remainders of documents are cut into pieces of at most so many tokens, so that windows can be made near-equal.
MAX_PIECE = 512
#: Windows that one shard of pieces fills, about.
SHARD_WINDOWS = 256


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each size: partial partitions with the largest spread are merged, large sums upon small ones.

    Each partial partition is a vector of k sums in falling order. Two are merged by adding one to the other reversed,
    so their imbalances oppose; the common minimum stays in the vector. Ties are broken by order of creation.
    """
    n = len(sizes)
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    left, right = [], []  # a node n + i joins left[i] and right[i]; -1 is empty
    order = np.argsort(-sizes, kind="stable")
    parts: list = []
    heap = []
    # at first, k sizes at a time would never meet: they form one vector, as their merging one by one does
    for c, i in enumerate(range(0, n, k)):
        at = order[i : i + k]
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[: len(at)], nodes[: len(at)] = sizes[at], at
        parts.append((sums, nodes))
        heap.append((-(int(sums[0]) - int(sums[-1])), c))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = parts[a], parts[b]
        parts[a] = parts[b] = None
        sb, nb = sb[::-1], nb[::-1]
        sums, both = sa + sb, (na >= 0) & (nb >= 0)
        nodes = np.where(na >= 0, na, nb)
        nodes[both] = n + len(left) + np.arange(both.sum())
        left += na[both].tolist()
        right += nb[both].tolist()
        at = np.argsort(-sums, kind="stable")
        sums, nodes = sums[at], nodes[at]
        parts.append((sums, nodes))
        heapq.heappush(heap, (-(int(sums[0]) - int(sums[-1])), len(parts) - 1))
    window = np.full(n + len(left), -1, np.int64)
    _, nodes = parts[heap[0][1]]
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for i in range(len(left) - 1, -1, -1):
        window[left[i]] = window[right[i]] = window[n + i]
    return window[:n]


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Windows of near-equal sums, none over capacity: the count starts at the least possible and rises while one is over."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        over = np.bincount(window, sizes, k) - capacity
        if not (over > 0).any():
            return window
        k += max(1, int(over[over > 0].sum()) // capacity)


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cuts every document's ids (with end_id appended) into full windows and pieces of the remainder, where it is read.

    (id, start, length, ids_crc32, doc_tokens[, ids]); a null or empty text is the one id end_id. The remainder below a
    full window is cut evenly into pieces of at most max_piece.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def cut(total: int) -> list[tuple[int, int]]:
        full, rest = divmod(total, capacity)
        out = [(i * capacity, capacity) for i in range(full)]
        if rest:
            parts = -(-rest // max_piece)
            at = [full * capacity + rest * i // parts for i in range(parts + 1)]
            out += [(a, b - a) for a, b in zip(at, at[1:], strict=False)]
        return out

    @lean
    def run(batches):
        encoder = Encoder(path, whole.value, words=True)
        for b in batches:
            for (lo, hi), counts, ids in encoder.batches(b.column(1), want_ids=True):
                row, start, length, crc, total, kept = [], [], [], [], [], []
                at = np.concatenate([[0], np.cumsum(counts)])
                for i in range(hi - lo):
                    own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                    for s, n in cut(len(own)):
                        row.append(lo + i), start.append(s), length.append(n), total.append(len(own))
                        crc.append(zlib.crc32(own[s : s + n].tobytes()))
                        if keep_ids:
                            kept.append(own[s : s + n])
                cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.list_(pa.int64()))] if keep_ids else []), names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (id, start, length, ...).

    Pieces are dealt by a hash of id, start and row to shards of about SHARD_WINDOWS windows, whose number follows the total; in a shard, full
    pieces stand alone and the others are packed by differencing. A shard's size is bounded however skewed documents or
    sources are, since a piece has at most `capacity` tokens. Repeated rows are pieces of their own. An empty table
    gives an empty one.
    """
    parts = stored(parts)
    total = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, -(-total // (capacity * SHARD_WINDOWS)))
    names = parts.columns
    schema = extended(parts.schema, sequence_id="long", offset="long")

    @lean
    def run(key, table):
        table = table.select(names)
        order = [(c, "ascending") for c in (id_col, "start", "length", "ids_crc32") if c in names]
        table = table.sort_by(order)
        sizes = table.column("length").to_numpy().astype(np.int64)
        full = sizes >= capacity
        window = np.empty(len(sizes), np.int64)
        window[~full] = pack_sizes(sizes[~full], capacity)
        window[full] = (window[~full].max() + 1 if (~full).any() else 0) + np.arange(full.sum())
        _, window = np.unique(window, return_inverse=True)  # windows without a piece don't count
        at = np.argsort(window, kind="stable")
        sums = np.cumsum(sizes[at]) - sizes[at]
        first = np.concatenate([[True], window[at][1:] != window[at][:-1]])
        offset = np.empty(len(sizes), np.int64)
        offset[at] = sums - np.maximum.accumulate(np.where(first, sums, 0))
        shard = key[0].as_py()
        return table.append_column("sequence_id", pa.array(shard * (1 << 24) + window, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # the row's place in the stored table spreads repeated rows too
    shard = F.pmod(F.xxhash64(F.col(id_col).cast("string"), "start", F.monotonically_increasing_id()), F.lit(shards)).alias("__shard")
    return parts.groupBy(shard).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, max_piece: int = MAX_PIECE, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all documents: (id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset), one row a piece."""
    return pack(pieces(docs, path, end_id, capacity, max_piece, id_col, text_col, keep_ids), capacity, id_col)
