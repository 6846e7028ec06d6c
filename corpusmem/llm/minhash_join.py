"""Near-duplicates by an inverted join of MinHash signatures: documents are posted under each coordinate and its value.

A signature has COORDS coordinates, each the least of a hash function over the document's shingles; two sets of
similarity s agree in a coordinate with probability s. Pairs with MATCHES equal coordinates or more are retained and
confirmed on their full sets; at the linking threshold of 0.85 fewer agree with probability 7e-8 (a binomial tail).

* Prefix. The (coordinate, value) pairs of a signature stand in a global order, rarest first (counted in a hashed table
  of fixed size over all documents). Two signatures with MATCHES pairs in common have at least MORE in common within
  their first COORDS - MATCHES + MORE, so only these are posted.
* Counting. Short posting lists are merged: each pair of their documents is a collision, and collisions are counted by
  pair. A document with f long lists in its prefix must still collide MORE - f times in short ones.
* Skipping. Long lists aren't merged into pairs, whatever their length. They only matter between documents that both
  have MORE long lists or more. Such documents are posted again, under two coordinates and their values at once:
  coordinates lie in MATCHES - 1 parts, so of MATCHES equal ones two share a part. Unlike documents seldom meet there.
* Checking. All that meet are compared by a print of their signatures, in tiles of two bounded slices of a list. Only
  pairs that reach MATCHES count, of these as many as hold a list's documents together: a list of n makes n at most. What
  a few coordinates bring together by chance, the more the larger the input, so ties no groups and sends no texts.

Documents that these pairs hold together form groups. Within a group, in tiles of two bounded slices, equal
coordinates are counted; a pair that reaches MATCHES is confirmed on full sets unless confirmed links already join it.
So a group of copies of one original costs about one comparison a copy in each tile.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.components import components
from corpusmem.llm.util import Work, lean, mix, shingles, slices, stored, utf8, words

#: Documents link at this Jaccard similarity, as a fraction.
THRESHOLD = (85, 100)
#: Coordinates of a signature, equal ones of a retained pair, and collisions asked of prefixes.
COORDS, MATCHES, MORE = 32, 15, 3
#: A posting list of at most so many documents is short.
SHORT = 6
#: Bits of the hashed table of posting lengths: 2 ** 18 counts, whatever the input.
TABLE = 18
#: Documents in one slice of a list of two coordinates, and rows of lists that a task gets at once.
LIST, ROWS = 4_000, 20_000
#: Sets, and shingles of all of them, in one slice of a group; a tile is two slices.
SLICE, SLICE_SHINGLES = 1_000, 750_000

_U = np.uint64
_DRAW = np.random.default_rng(20240713).integers(1, 1 << 63, (2, COORDS), dtype=np.uint64)
_FACTOR, _SHIFT = _DRAW[0] | _U(1), _DRAW[1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS tokens for each non-empty set of shingle hashes; a token is a hash of coordinate and value."""
    if not sets:
        return np.zeros((0, COORDS), np.int64)
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDS), np.uint64)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(mix(flat * _FACTOR[k] + _SHIFT[k]), at)
    return mix(out + np.arange(COORDS, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    hashes, lo, hi = words(data, offsets)
    return [np.unique(shingles(hashes[x:y], size)) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]


def _digest(own: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)


def signed_sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, sig): number of shingles, a 128-bit digest of the set, and the signature (empty for an empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                sets = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.array([len(s) for s in sets], np.int64)
                digests = np.array([_digest(s) for s in sets])
                sigs = signatures([s for s in sets if len(s)])
                starts = np.concatenate([[0], np.cumsum(np.where(n > 0, COORDS, 0))]).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(starts), pa.array(sigs.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), sig], ["id", "n", "d1", "d2", "sig"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, sig array<long>")


def posting_lengths(classes: DataFrame) -> np.ndarray:
    """Lengths of all posting lists by the first TABLE bits of their hash: always 2 ** TABLE numbers."""

    @lean
    def run(batches):
        counts = np.zeros(1 << TABLE, np.int64)
        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy().view(np.uint64)
            counts += np.bincount((tokens >> _U(64 - TABLE)).view(np.int64), minlength=1 << TABLE)
        slot = np.flatnonzero(counts)
        for i in range(0, len(slot), 10_000):
            part = slot[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["slot", "n"])

    found = classes.select("sig").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << TABLE, np.int64)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return table


def prefixes(classes: DataFrame, lengths) -> DataFrame:
    """(id, n, tok): the first COORDS - MATCHES + MORE tokens of each signature, rarest first, then by hash."""
    width = min(COORDS, COORDS - MATCHES + MORE)

    @lean
    def run(batches):
        for batch in batches:
            tokens = batch.column(2).flatten().to_numpy().reshape(-1, COORDS)
            tokens = np.sort(tokens, axis=1)
            often = lengths.value[(tokens.view(np.uint64) >> _U(64 - TABLE)).view(np.int64)]
            first = np.take_along_axis(tokens, np.argsort(often, axis=1, kind="stable")[:, :width], axis=1)
            row = pa.array(np.repeat(np.arange(len(tokens)), width))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(first.ravel())], ["id", "n", "tok"])

    return classes.select("id", "n", "sig").mapInArrow(run, "id long, n long, tok long")


def twos(classes: DataFrame) -> DataFrame:
    """(id, tok): a token for each two coordinates of one part. Of any MATCHES coordinates, two lie in one of the parts."""
    parts = MATCHES - 1
    both = np.array([c for p in range(parts) for c in combinations(range(p, COORDS, parts), 2)])

    @lean
    def run(batches):
        for batch in batches:
            tokens = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, COORDS)
            tok = mix(mix(tokens[:, both[:, 0]]) + tokens[:, both[:, 1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(tok)), len(both)))), pa.array(tok.ravel())], ["id", "tok"])

    return classes.select("id", "sig").mapInArrow(run, "id long, tok long")


def prints(classes: DataFrame) -> DataFrame:
    """(id, print): two bytes of each coordinate. Equal coordinates have equal ones, others with probability 2 ** -16."""

    @lean
    def run(batches):
        for batch in batches:
            short = (batch.column(1).flatten().to_numpy().view(np.uint64) >> _U(48)).astype(np.uint16).reshape(-1, COORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in short], pa.binary())], ["id", "print"])

    return classes.select("id", "sig").mapInArrow(run, "id long, print binary")


def alike(prints: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places that hold together what is equal in MATCHES coordinates; own ones meet all others."""
    label, pairs = np.arange(len(prints)), []
    for i in np.flatnonzero(own).tolist():
        other = np.flatnonzero(label != label[i])
        if not len(other):
            break
        near = other[(prints[other] == prints[i]).sum(1) >= MATCHES]
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            pairs += [(i, j) for j in near[first].tolist()]
            label[np.isin(label, joined)] = label[i]
    return pairs


def checked(lists: DataFrame, printed: DataFrame, work: Work) -> DataFrame:
    """(a, b): pairs that hold together the documents of each list that agree in MATCHES coordinates. lists: (tok, id, k),
    k the list's length; printed: (id, print). Of a list longer than LIST, slices meet."""
    cut = lists.withColumn("k", F.ceil(F.col("k") / LIST).cast("int")).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int"))
    cut = work.store(cut)
    total = cut.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    slot, t = F.col("slot"), F.col("t")
    spread = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("t")).select("tok", "id", F.least(slot, t).alias("p"), F.greatest(slot, t).alias("q"), (slot <= t).alias("own"))
    spread = spread.join(printed, "id").withColumn("task", F.pmod(F.xxhash64("tok", "p", "q"), F.lit(total // ROWS + 1)))

    @lean
    def run(key, table: pa.Table) -> pa.Table:
        of = [table.column(c).to_numpy() for c in ("tok", "p", "q")]
        order = np.lexsort(of)
        ids, own = table.column("id").to_numpy()[order], table.column("own").to_numpy(zero_copy_only=False)[order]
        flat = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint16).reshape(-1, COORDS)[order]
        new = np.logical_or.reduce([np.concatenate([[True], x[order][1:] != x[order][:-1]]) for x in of])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(ids)))
        two = begin[size == 2]  # most lists
        two = two[((flat[two] == flat[two + 1]).sum(1) >= MATCHES) & (own[two] | own[two + 1])]
        pairs = [np.stack([two, two + 1], 1)]
        for x, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := alike(flat[x : x + n], own[x : x + n]):
                pairs.append(x + np.array(found))
        a, b = ids[np.concatenate(pairs)].T
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return spread.groupBy("task").applyInArrow(run, "a long, b long").where("a < b").distinct()


def candidates(classes: DataFrame, work: Work, threshold: tuple[int, int]) -> DataFrame:
    """(a, b) pairs, which agree in MATCHES coordinates, that hold all such sets together. classes: (id, n, sig)."""
    num, den = threshold
    posted = prefixes(classes, classes.sparkSession.sparkContext.broadcast(posting_lengths(classes)))
    shared = posted.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1")
    posted = work.store(posted.join(shared.hint("shuffle_hash"), "tok"))
    long = posted.where(F.col("k") > SHORT)
    need = work.store(long.groupBy("id").agg((MORE - F.count("*")).alias("need")))  # collisions still asked in short lists
    short = posted.where(F.col("k") <= SHORT).select("tok", "id", "n")
    left, right = short.toDF("tok", "a", "na"), short.toDF("tok", "b", "nb")
    # at most SHORT documents a list
    pairs = left.join(right, "tok").where((F.col("a") < F.col("b")) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb"))).groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = pairs.join(need.toDF("a", "wa"), "a", "left").join(need.toDF("b", "wb"), "b", "left")
    asked = F.greatest(F.coalesce("wa", F.lit(MORE)), F.coalesce("wb", F.lit(MORE)))
    pairs = pairs.where((asked > 0) & (F.col("k") >= asked)).select(F.xxhash64("a", "b").alias("tok"), F.explode(F.array("a", "b")).alias("id"), F.lit(2).cast("long").alias("k"))
    heavy = work.store(twos(classes.join(need.where("need <= 0"), "id", "left_semi")))
    lists = heavy.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1")
    return checked(heavy.join(lists, "tok").select("tok", "id", "k").union(pairs), prints(classes), work)


def confirm(tile: pa.Table, threshold: tuple[int, int], size: int) -> list[tuple[int, int]]:
    """Links that span the components of a tile: (id, own, sig, text) of distinct sets; own sets meet all others.

    Equal coordinates are counted for each own set; those that reach MATCHES are confirmed on full sets, all at once,
    unless links already join them.
    """
    num, den = threshold
    ids, own = tile.column("id").to_numpy(), tile.column("own").to_numpy(zero_copy_only=False)
    sig = np.ascontiguousarray(tile.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDS).T)
    matches = [None] * len(ids)
    for i in np.flatnonzero(own):
        equal = np.zeros(len(ids), np.uint8)
        for k in range(COORDS):
            equal += sig[k] == sig[k, i]
        equal[i] = 0
        matches[i] = np.flatnonzero(equal >= MATCHES)
    wanted = np.zeros(len(ids), bool)
    for i, m in enumerate(matches):
        if m is not None and len(m):
            wanted[i] = wanted[m] = True
    some = np.flatnonzero(wanted)
    if not len(some):
        return []
    data, offsets = utf8(tile.column("text").take(pa.array(some)))
    sets: list = [None] * len(ids)
    for a, b in slices(offsets):
        for i, s in zip(some[a:b].tolist(), _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size), strict=True):
            sets[i] = s
    distinct, flat = np.unique(np.concatenate([sets[i] for i in some]), return_inverse=True)
    at = np.cumsum([0, *(len(sets[i]) for i in some)])
    for j, i in enumerate(some.tolist()):
        sets[i] = flat[at[j] : at[j + 1]]
    size_of = np.array([len(s) if s is not None else 0 for s in sets])
    label, mark, links = np.arange(len(ids)), np.zeros(len(distinct), bool), []
    for i in some[own[some]].tolist():
        other = matches[i][label[matches[i]] != label[i]]
        other = other[den * np.minimum(size_of[other], size_of[i]) >= num * np.maximum(size_of[other], size_of[i])]
        if not len(other):
            continue
        mark[sets[i]] = True
        both = np.add.reduceat(mark[np.concatenate([sets[j] for j in other])].astype(np.int64), np.concatenate([[0], np.cumsum(size_of[other])[:-1]]))
        mark[sets[i]] = False
        linked = other[den * both >= num * (size_of[i] + size_of[other] - both)]
        if len(linked):
            joined, first = np.unique(label[linked], return_index=True)
            links += [(int(ids[i]), int(ids[j])) for j in linked[first]]
            label[np.isin(label, joined)] = label[i]
    return links


def confirmed(groups: DataFrame, texts: DataFrame, threshold: tuple[int, int], size: int) -> DataFrame:
    """(a, b): links that span the components within groups. groups: (component, id, d1, n, sig); texts: (id, text).

    A small group is one tile. Others are cut into bands of sizes that double, and bands into slices by hash; a slice
    meets all of its own band and of the next, since sets of bands further apart can't link at 0.5 or more.
    """
    whole = groups.groupBy("component").agg(((F.count("*") <= SLICE) & (F.sum("n") <= SLICE_SHINGLES)).alias("small"))
    groups = groups.join(whole, "component").withColumn("band", F.when(F.col("small"), -1).otherwise(F.floor(F.log2(F.col("n").cast("double")))).cast("int"))
    hold = F.when(F.first("small"), F.lit(SLICE)).otherwise(F.greatest(F.lit(1), F.least(F.lit(SLICE), F.floor(SLICE_SHINGLES / F.max("n")))))
    sizes = groups.groupBy("component", "band").agg(F.ceil(F.count("*") / hold).cast("int").alias("k"))
    above = sizes.select("component", (F.col("band") - 1).alias("band"), F.col("k").alias("k_above"))
    below = sizes.select("component", (F.col("band") + 1).alias("band"), F.col("k").alias("k_below"))
    spread = groups.join(sizes, ["component", "band"]).join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
    spread = spread.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int"))
    cut = lambda kind, of, p, q, own: (F.struct("component", F.lit(kind).alias("kind"), of.alias("of"), p.alias("p"), q.alias("q")).alias("tile"), own.alias("own"))
    slot, t, here = F.col("slot"), F.col("t"), F.col("band")
    route = lambda rows, of, tile, own: rows.select("*", F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias("t")).select("id", "d1", "sig", tile, own)
    inside = route(spread, "k", *cut(0, here, F.least(slot, t), F.greatest(slot, t), slot <= t))
    host = route(spread.where("k_above is not null"), "k_above", *cut(1, here, slot, t, F.lit(True)))
    guest = route(spread.where("k_below is not null"), "k_below", *cut(1, here - 1, t, slot, F.lit(False)))
    routes = inside.union(host).union(guest)

    @lean
    def run(key, table: pa.Table) -> pa.Table:
        if pc.count_distinct(table.column("id")).as_py() < table.num_rows:  # repeated rows, or several texts of one id
            data, offsets = utf8(table.column("text"))
            digest = np.concatenate([[_digest(s)[0] for s in _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)] for a, b in slices(offsets)])
            own = {(i, d): row for row, (i, d, seen) in enumerate(zip(table.column("id").to_pylist(), table.column("d1").to_pylist(), digest.tolist(), strict=True)) if d == seen}
            table = table.take(pa.array(sorted(own.values()), pa.int64()))
        found = confirm(table, threshold, size)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return routes.join(texts, "id").select("tile", "id", "d1", "own", "sig", "text").groupBy("tile").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the size of its shingle set, the least id that its links reach,
    and whether it is the row's own.

    A document's set: distinct runs of `size` words, A-Z as a-z; with fewer words the whole sequence; null texts and texts
    without a word have an empty set and no link. Documents link when 100 * intersection >= 85 * union (the threshold);
    equal sets are one class from the start, whatever their number. Repeated rows are one document
    of the graph and come back as often as they are given; of different texts under one id, each row follows its own. A
    row with a null id has its own set size, a null component, and is kept. Very long texts are hashed whole, in bounded slices. An empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    work = Work(docs.sparkSession)
    table = work.store(signed_sets(docs, size, id_col, text_col))
    real = table.where("n > 0 and id is not null")
    classes = work.store(real.groupBy("d1", "d2", "n").agg(F.min(F.col("id").cast("long")).alias("id"), F.first("sig").alias("sig")))
    met = work.store(candidates(classes.select("id", "n", "sig"), work, threshold))
    groups = components(met, keep=work).join(classes.select("id", "d1", "n", "sig"), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    linked = components(confirmed(groups, texts, threshold, size), keep=work)
    whole = classes.join(linked, "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("c"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = table.drop("sig").join(whole, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("c").cast(kind), F.col("id")))
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
    work.clear()
    return out
