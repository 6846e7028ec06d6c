"""Long repeats across documents, by run-length BWT indexes of the passages that may repeat.

A document loses each byte covered by a 50-byte string that also starts in a document with a smaller id. Windows of 50
bytes are sampled by minimizers: of the 20-byte strings within a window those with the least hash are its anchors, so
equal windows have equal anchors. That gives the job its partitions:

1. Anchors are counted by hash: only those of two documents or more can stand in a repeat.
2. Around each such anchor lies a passage of at most 80 bytes that holds every window over it. Documents are dealt in
   bounded chunks; a chunk sends each distinct passage once, with its smallest document, to the anchor's bucket.
3. A bucket builds the run-length BWT of its distinct passages (but for those alone at their anchor). Match lengths with the lexicographic neighbour are
   computed at the ends of runs only and streamed to all other places (inside a run they fall by one per byte). Where a
   length is 50 or more, neighbours share a window, whose smallest document is thus known.
4. Chunks mark the windows of their documents, and cut the union of the marked windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.util import Work, extended, gram_hashes, lean, mix, power_sums, range_hashes, slices, stored, text_bytes, utf8

LENGTH = 50
GRAM = 20
#: Bytes of text that a chunk of documents, and a bucket of anchors, stand for.
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 1_000_000
#: Buckets that lie together in one row of what is dealt: rows grow as groups times chunks, and so must be few.
GROUP = 8
#: Bytes of text whose anchors are dealt at once.
DEAL_BYTES = 16_000_000
#: Bytes of documents whose grams are hashed at once: their arrays stay in a core's cache.
SLICE = 64_000
_REACH = LENGTH - GRAM
_SPAN = LENGTH + _REACH
_TOP = np.uint32(0xFFFFFFFF)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every run of `width` values, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a run of documents: grams that are least within one of their windows.
    sums: of power_sums(data), if known."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = gram_hashes(data, GRAM, sums)
    h = (full >> np.uint64(33)).astype(np.uint32)  # 31 bits rank the grams
    for e in offsets[1:-1]:  # grams that cross into the next document
        h[max(0, e - GRAM + 1) : e] = _TOP
    width = _REACH + 1
    least = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((h == most) & (h != _TOP))
    return at, full[at]


def passages(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For anchors at `at`: their document, and the passage [begin, end) around each, with a hash of it."""
    doc = np.searchsorted(offsets, at, "right") - 1
    begin, end = np.maximum(at - _REACH, offsets[doc]), np.minimum(at + LENGTH, offsets[doc + 1])
    return doc, begin, end, passage_hashes(data, begin, end, at, sums)


def passage_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Of each passage's bytes and of where its anchor stands in it; at most 80 bytes, so patterns don't break the hash."""
    return mix(range_hashes(data, begin, end, sums) ^ mix((at - begin).astype(np.uint64)))


def repeated_windows(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For distinct passages with a smallest document each: the windows that a smaller document has too, bit s for start s.

    The run-length BWT of the passages (each closed by an end mark) is built from their sorted suffixes. r run ends are
    sampled; only there are neighbours compared byte by byte.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(start[-1])
    text = np.zeros(n + 8, np.int16)
    body = np.ones(n, bool)
    body[start[1:] - 1] = False
    text[:n][body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    stop = np.repeat(start[1:].astype(np.int32), sizes + 1)  # one past the end mark of each place's passage
    place = np.arange(n, dtype=np.int32)
    # ranks of suffixes by their first 7, 14, 28, ... symbols; an end mark counts as 0 and ends the suffix
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key * 257 + np.where(place + k < stop, text[k : n + k], 0)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)  # the first place in order of those that are equal so far
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    width, shared = 7, np.zeros(n, np.int32)  # symbols that a row is known to share with the row above
    while width <= _SPAN:  # suffixes that differ from all others keep their rank
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        at = order[tied]
        key = rank[at] * (n + 1) + np.where(at + width < stop[at], rank[np.minimum(at + width, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        shared[tied[first & ~new[tied]]] = width
        order[tied], new[tied], width = at, first, width * 2
        rank[at] = np.maximum.accumulate(np.where(first, tied, 0))
    shared[~new] = width
    # equal suffixes stand in order of their passages, which keeps runs consistent
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))
    suffix, at = order, order[tied]
    suffix[tied] = at[np.argsort(rank[at] * n + at)]
    previous = np.concatenate([[0], text[: n - 1]]).astype(np.int64)
    previous[start[:-1]] = -1 - np.arange(len(sizes))
    before = previous[suffix]
    head = np.concatenate([[True], before[1:] != before[:-1]])  # first rows of BWT runs
    # lengths in common with the row above: compared at run heads, streamed elsewhere
    common = np.full(n, -1, np.int64)
    rows = np.flatnonzero(head)
    a, b = suffix[np.maximum(rows - 1, 0)], suffix[rows]
    most = np.minimum(stop[a] - a, stop[b] - b) - 1
    same = np.where(rows > 0, np.minimum(shared[rows], most), 0)
    alive = np.flatnonzero((rows > 0) & (same < most))
    while len(alive):
        alive = alive[text[a[alive] + same[alive]] == text[b[alive] + same[alive]]]
        same[alive] += 1
        alive = alive[same[alive] < most[alive]]
    common[b] = same
    sampled = np.flatnonzero(common >= 0)
    last = sampled[np.cumsum(common >= 0) - 1] if n else place
    common = np.maximum(0, common[last] - (place - last))
    # rows that share a window with the row above stand in one class; its smallest document has the window first
    new = common[suffix] < LENGTH
    new[0] = True
    group = np.cumsum(new) - 1
    owner = np.repeat(np.asarray(docs), sizes + 1)
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner[suffix])
    hit = np.zeros(n, bool)
    hit[suffix] = least[group] < owner[suffix]
    hit &= place + LENGTH < stop
    at = np.flatnonzero(hit)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)[at]
    return np.bincount(owner, 2.0 ** (at - start[owner]), len(sizes)).astype(np.uint64)


def _firsts(doc: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Of equal passages, the place with the smallest document (then the first place)."""
    order = np.lexsort((np.arange(len(doc)), ids[doc], prints))
    return np.sort(order[np.concatenate([[True], prints[order][1:] != prints[order][:-1]])]) if len(order) else order


def _cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:]


def _packed(a: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The bytes of a's runs from each of `begin` to the next, as binary values."""
    offsets = (np.append(begin, len(a)) * a.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a))])


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), cut_texts: bool = False) -> DataFrame:
    """(id, text, spans[, the columns of `keep`]): text as read, spans an array of (start, end) byte ranges to remove, ascending and apart.
    cut_texts: instead, (id, text[, ...]) with the spans cut out, see without_repeats().

    Null texts are empty; texts below 50 bytes have no window and keep everything; a window that repeats only inside its
    own document stays. Rows with one id count as one document: neither repeats the other. Rows with a null id come
    before all ids, as one document. Chunks and buckets follow the total of bytes, and documents are dealt by hash, so
    neither a hot source nor a group of copies lands in one task; a passage of thousands of copies is sent once a chunk.
    What is dealt has a row for each chunk and group of buckets, and each is cut by one sort, not by a search a bucket.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("id"), F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)])
    kept = [f"keep_{k}" for k in range(len(keep))]
    total = text_bytes(rows)
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    bucket_of = lambda h: (h % np.uint64(buckets)).astype(np.int32)
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")

    def deal(h, c, i):
        """One entry for each anchor and chunk here, 0 for its document if the anchor stands in two; a row for each group."""
        order = np.lexsort((i, c, h))
        h, c, i = h[order], c[order], i[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = new | np.concatenate([[True], c[1:] != c[:-1]])
        group = np.cumsum(new) - 1
        many = np.zeros(group[-1] + 1, bool)
        many[group[np.concatenate([[False], ~new[1:] & (i[1:] != i[:-1])])]] = True
        h, c, i = h[first], c[first].astype(np.int32), np.where(many[group[first]], 0, mix(i[first].astype(np.uint64)) | np.uint64(1)).astype(np.uint64)
        group = bucket_of(h) // GROUP
        order = np.argsort(group, kind="stable")
        begin, _ = _cuts(group[order])
        return pa.RecordBatch.from_arrays([pa.array(group[order][begin], pa.int32()), *(_packed(x[order], begin) for x in (h, c, i))], ["bucket", "h", "c", "i"])

    @lean
    def find(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(offsets, SLICE):
                off = offsets[a : b + 1] - offsets[a]
                at, h = anchors(data[offsets[a] : offsets[b]], off)
                doc = a + np.searchsorted(off, at, "right") - 1
                held.append((h, own[doc], ids[doc]))
                size += off[-1]
                if size >= DEAL_BYTES:
                    if sum(len(x) for x, *_ in held):
                        yield deal(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if sum(len(x) for x, *_ in held):
            yield deal(*(np.concatenate(x) for x in zip(*held, strict=True)))

    found = rows.withColumn("chunk", chunk).select("id", "chunk", "text").mapInArrow(find, "bucket int, h binary, c binary, i binary")

    @lean
    def several(key, table):
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(table.column("c").to_pylist()), np.int32)
        i = np.frombuffer(b"".join(table.column("i").to_pylist()), np.uint64)
        order = np.argsort(h, kind="stable")
        h, c, i = h[order], c[order], i[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        # 0 marks an anchor of several documents; else entries of different documents differ
        dup = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(dup, group, (i == 0) | (i != i[np.flatnonzero(new)][group]))
        keep = dup[group]
        h, c = h[keep], c[keep]
        order = np.argsort(c, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(c[order]) != 0])) if len(order) else []
        out = [(int(c[order[lo]]), np.unique(h[order[lo:hi]]).tobytes()) for lo, hi in zip(cut, [*cut[1:], len(order)], strict=False)]
        return pa.table({"chunk": pa.array([x for x, _ in out], pa.int32()), "h": pa.array([x for _, x in out], pa.binary())})

    repeated = stored(found.groupBy("bucket").applyInArrow(several, "chunk int, h binary"))

    def local(table, hashes):
        """Anchored passages of a chunk's documents, in slices: (rows, data, offsets, doc, begin, at, passage hash, anchor)."""
        table = table.combine_chunks()
        data, offsets = utf8(table.column("text"))
        for a, b in slices(offsets, 1_000_000):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found = []
            for x, y in slices(off, SLICE):
                some, at_zero = part[off[x] : off[y]], off[x : y + 1] - off[x]
                sums = power_sums(some)
                at, h = anchors(some, at_zero, sums)
                keep = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h if len(hashes) else slice(0)
                at, h = at[keep], h[keep]
                doc, begin, end, prints = passages(some, at_zero, at, sums)
                found.append((doc + x, begin + off[x], end + off[x], at + off[x], prints, h))
            yield a, part, *(np.concatenate(c) for c in zip(*found, strict=True))

    def gather(table, hashes):
        """All slices of a chunk together: documents in order of id."""
        table = table.sort_by([("id", "ascending")])
        parts = list(local(table, hashes))
        ids = table.column("id").to_numpy()
        if not parts:
            return table, ids, [], *[np.zeros(0, np.int64)] * 4
        doc = np.concatenate([p[0] + p[2] for p in parts])
        prints = np.concatenate([p[6] for p in parts])
        first = _firsts(doc, ids, prints)
        return table, ids, parts, doc, prints, first, np.concatenate([np.full(len(p[2]), k) for k, p in enumerate(parts)])

    def known(table):
        return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("h").to_pylist() if x] or [np.zeros(0, np.uint64)]))

    @lean
    def send(key, table, repeated):
        table, ids, parts, doc, prints, first, _ = gather(table, known(repeated))
        data, offsets = utf8(table.column("text"))
        begin, end, at, h = ([np.concatenate([p[k] + (offsets[p[0]] if k < 6 else 0) for p in parts]) for k in (3, 4, 5, 7)]) if parts else [np.zeros(0, np.int64)] * 4
        bucket = bucket_of(h[first].astype(np.uint64))
        order = np.argsort(bucket, kind="stable")
        j, bucket = first[order], bucket[order]
        cut, stop = _cuts(bucket // GROUP)
        counts = np.bincount(np.repeat(np.arange(len(cut)), stop - cut) * GROUP + bucket % GROUP, minlength=len(cut) * GROUP).astype(np.int32)
        raw, x, y = data.tobytes(), begin[j].tolist(), end[j].tolist()
        passages = [b"".join(raw[x[k] : y[k]] for k in range(lo, hi)) for lo, hi in zip(cut.tolist(), stop.tolist(), strict=True)]
        packed = [_packed(v, cut) for v in ((end[j] - begin[j]).astype(np.uint8), (at[j] - begin[j]).astype(np.uint8), ids[doc[j]].astype(np.int64))]
        chunk = pa.array(np.full(len(cut), key[0].as_py()), pa.int32())
        return pa.table([pa.array(bucket[cut] // GROUP, pa.int32()), chunk, _packed(counts, np.arange(0, len(counts), GROUP)), pa.array(passages, pa.binary()), *packed], ["bucket", "chunk", "counts", "bytes", "lengths", "places", "ids"])

    dealt = rows.withColumn("chunk", chunk)
    work = Work(docs.sparkSession)  # gone once the marks are stored
    sent = work.store(dealt.select("id", "text", "chunk").groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, counts binary, bytes binary, lengths binary, places binary, ids binary"))

    @lean
    def index(key, table):
        whole = {c: [memoryview(x.as_buffer()) for x in table.column(c)] for c in ("counts", "bytes", "lengths", "places", "ids")}
        chunk_of = table.column("chunk").to_numpy()
        counts = np.frombuffer(b"".join(whole["counts"]), np.int32).reshape(-1, GROUP)
        ends = np.cumsum(counts, axis=1)
        # the bytes of a row's buckets end where their passages do
        byte_ends = np.array([np.concatenate([[0], np.cumsum(np.frombuffer(x, np.uint8), dtype=np.int64)])[e] for x, e in zip(whole["lengths"], ends, strict=True)]).reshape(-1, GROUP)
        found = []
        for b in range(GROUP):
            some = np.flatnonzero(counts[:, b]).tolist()
            if some:
                part = lambda name, to, size: b"".join(whole[name][r][size * (to[r, b - 1] if b else 0) : size * to[r, b]] for r in some)  # noqa: B023, E731
                found.append((np.repeat(chunk_of[some], counts[some, b]), *marked(part("bytes", byte_ends, 1), np.frombuffer(part("lengths", ends, 1), np.uint8).astype(np.int64), np.frombuffer(part("places", ends, 1), np.uint8), np.frombuffer(part("ids", ends, 8), np.int64))))
        chunk, prints, mask = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.flatnonzero(mask > 0)
        order = keep[np.argsort(chunk[keep], kind="stable")]
        begin, _ = _cuts(chunk[order])
        return pa.table({"chunk": pa.array(chunk[order][begin], pa.int32()), "prints": _packed(prints[order], begin), "masks": _packed(mask[order], begin)})

    def marked(raw, lengths, places, ids):
        """A bucket's passages, as chunks sent them: hashes, and the windows that smaller documents have."""
        ends = np.cumsum(lengths)
        data, at = np.frombuffer(raw, np.uint8), ends - lengths + places
        prints = passage_hashes(data, ends - lengths, ends, at)
        order = np.lexsort((ids, prints))
        new = np.concatenate([[True], prints[order][1:] != prints[order][:-1]])
        first = order[new]
        least = ids[first]
        # an anchor of one distinct passage has nothing to compare: only its copies repeat
        anchor = range_hashes(data, at[first], at[first] + GRAM)
        _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(times[which] > 1)
        masks = np.zeros(len(first), np.uint64)
        masks[mixed] = repeated_windows([raw[ends[k] - lengths[k] : ends[k]] for k in first[mixed].tolist()], least[mixed])
        every = (np.uint64(1) << np.maximum(0, lengths[first] - LENGTH + 1).astype(np.uint64)) - np.uint64(1)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        # a copy of a passage that a smaller document has is covered whole; the smallest document's by its windows
        return prints, np.where(ids > least[group], every[group], masks[group]).astype(np.uint64)

    marks = stored(sent.groupBy("bucket").applyInArrow(index, "chunk int, prints binary, masks binary"))
    work.clear()
    # each chunk reads its anchors and its marks together
    both = repeated.select("chunk", "h", F.lit(None).cast("binary").alias("prints"), F.lit(None).cast("binary").alias("masks")).unionByName(marks.select("chunk", F.lit(None).cast("binary").alias("h"), "prints", "masks"))

    @lean
    def cut(key, table, both):
        prints_known = np.concatenate([np.frombuffer(x, np.uint64) for x in both.column("prints").to_pylist() if x] or [np.zeros(0, np.uint64)])
        masks_known = np.concatenate([np.frombuffer(x, np.uint64) for x in both.column("masks").to_pylist() if x] or [np.zeros(0, np.uint64)])
        order = np.argsort(prints_known)
        prints_known, masks_known = prints_known[order], masks_known[order]
        table, ids, parts, doc, prints, first, slice_of = gather(table, known(both))
        mask = np.zeros(len(prints), np.uint64)
        if len(prints):
            # the local first of each passage has the bucket's word; its later copies here are covered whole
            span = np.concatenate([p[4] - p[3] for p in parts])
            whole = (np.uint64(1) << np.maximum(0, span - LENGTH + 1).astype(np.uint64)) - np.uint64(1)
            if len(prints_known):
                i = np.minimum(np.searchsorted(prints_known, prints), len(prints_known) - 1)
                mask = np.where(prints_known[i] == prints, masks_known[i], mask)
            # the smallest id with this passage in the chunk
            o = np.argsort(prints[first])
            i = first[o][np.searchsorted(prints[first][o], prints)]
            mask = np.where(ids[doc] > ids[doc[i]], whole, mask)
        base, spans = 0, [[] for _ in range(len(ids))]
        text = table.column("text")
        offsets = utf8(text)[1]
        for a, part, d, begin, _, _, pr, _ in parts:
            m = mask[base : base + len(pr)]
            base += len(pr)
            window = np.zeros(len(part) + 1, bool)
            for s in range(_REACH + 1):
                window[begin[(m >> np.uint64(s)) & np.uint64(1) == 1] + s] = True
            on = np.flatnonzero(window)
            edge = np.zeros(len(part) + 1, np.int64)
            edge[on] = 1
            edge[on + LENGTH] -= 1
            covered = np.cumsum(edge[:-1]) > 0
            lo, hi = a, a + int(np.searchsorted(offsets - offsets[a], len(part), "left"))
            step = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            if not len(d):
                continue
            begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            off = offsets[lo : hi + 1] - offsets[lo]
            for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                # a run may go on over the border of two documents
                k = int(np.searchsorted(off, x, "right")) - 1
                while x < y:
                    z = min(y, int(off[k + 1]))
                    if z > x:
                        spans[lo + k].append((x - int(off[k]), z - int(off[k])))
                    x, k = z, k + 1
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if cut_texts:
            text = pa.array([remaining(t, s) for t, s in zip(text.to_pylist(), spans, strict=True)], pa.string())
            spans = [[] for _ in spans]
        got = pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], kind)
        return pa.table([table.column("id"), table.column("no_id"), text, got, *[table.column(c) for c in kept]], ["id", "no_id", "text", "spans", *kept])

    out = dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, extended(rows.select("id", "no_id", "text").schema, spans="array<struct<start:long,end:long>>", **{c: rows.schema[c].dataType for c in kept}))
    kind = docs.schema[id_col].dataType.simpleString()
    return out.select(F.when(~F.col("no_id"), F.col("id")).cast(kind).alias(id_col), F.col("text").alias(text_col), *([] if cut_texts else ["spans"]), *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])


def digest(marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of a table of marked documents."""

    def run(batches):
        for b in batches:
            rows = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode()
                kept, at, gone = hashlib.sha256(), 0, 0
                for s in spans:
                    kept.update(raw[at : s["start"]])
                    at = s["end"]
                    gone += s["end"] - s["start"]
                kept.update(raw[at:])
                rows.append((len(raw), gone, len(spans), kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], kinds[k]) for k in range(4)]], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = marked.schema[id_col].dataType.simpleString()
    return marked.select(id_col, text_col, "spans").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remaining(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without byte ranges; of a character cut in part nothing stays."""
    raw, last, kept = text.encode(), 0, []
    for start, end in spans:
        kept.append(raw[last:start].decode("utf-8", "ignore"))
        last = end
    return "".join([*kept, raw[last:].decode("utf-8", "ignore")])


def without_repeats(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Marked documents with their spans cut out of the text; a character cut in part goes whole. Drops spans."""
    names = [c for c in marked.columns if c != "spans"]
    at, spans_at = names.index(text_col), len(names)

    def run(batches):
        for b in batches:
            texts = []
            for t, spans in zip(b.column(at).to_pylist(), b.column(spans_at).to_pylist(), strict=True):
                texts.append(remaining(t, [(s["start"], s["end"]) for s in spans]))
            cols = list(b.columns[:spans_at])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = extended(marked.select(names).schema)
    return marked.select(*names, "spans").mapInArrow(run, schema)
