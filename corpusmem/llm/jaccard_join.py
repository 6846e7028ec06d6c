"""Near-duplicate join of documents by Jaccard similarity of word shingles.

Candidates come from token-combination prefixes. The shingles of a document ("tokens") stand in a global order: rarest
first, by counts over all documents in a hashed table of fixed size, then by hash. So a prefix leaves out the passages
that many documents share; tokens that meet in the table only cost speed. A set of n tokens that reaches the threshold with another misses at most floor(n / 10) = m of its tokens there,
so it may be judged by a prefix: m + 1 tokens would do, and the prefix is extended beyond. Counted over all prefixes, a
token is rare (in few sets) or frequent:

* rare tokens are indexed singly. Of its c rare (or unshared) prefix tokens a set misses at most m in any partner whose
  prefix reaches as far, so a pair must share c - m of them; where c > m that is decisive ("light" sets).
* "heavy" sets have c <= m. Their frequent tokens are dealt into classes by hash, and all 2-token combinations within a
  class are indexed: a class with f frequent tokens withstands f - 1 misses, and there are so few classes that the
  extension makes the sum of c and all f - 1 exceed m. Light sets index their combinations too, but a combination without a heavy set is dropped.

Sets tied by a candidate form groups; within a group and a band of similar sizes all pairs are verified exactly, in
tiles of bounded size, as products of membership matrices, and each block returns links that span its components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.llm.components import components
from corpusmem.llm.util import Work, lean, mix, shingles, slices, stored, utf8, words

#: Jaccard threshold as a fraction, 90 / 100; smaller sets than LEAST can only link with equal sets.
THRESHOLD = (90, 100)
#: A token in at most so many prefixes is rare.
RARE = 4
#: Bits of the hashed table of token counts: 2 ** 18 counts, whatever the input.
TABLE = 18
#: Sets, and shingles of all of them, in one slice of the verification; a tile is two slices.
BLOCK, BLOCK_SHINGLES = 1_000, 750_000
#: So many ids (8 bytes each, some 64 MB as a hashed table) may be broadcast.
BROADCAST_IDS = 2_000_000


def misses(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """How many tokens of a set of n a partner at the threshold may miss: n - ceil(n * threshold)."""
    num, den = threshold
    return n - -(-n * num // den)


def _band(n: int) -> int:
    return int(math.log(n) / math.log(1.25) + 1e-9)


def _classes(band: int, threshold: tuple[int, int]) -> int:
    """As many classes as the extension of the smallest set that signs in this band: one less than the tokens beyond m."""
    num, den = threshold
    least = max(1, int(1.25**band * num / den))
    return max(1, prefix_length(least, threshold) - misses(least, threshold) - 1)


def prefix_length(n: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """m + 1 tokens, extended by half as many, by 8, and by the classes that a set of this size may meet."""
    m = misses(n, threshold)
    return min(n, m + 1 + m // 2 + 8)


def _bands(n: int, threshold: tuple[int, int]) -> list[int]:
    """The bands in which a set signs: its own and those of larger partners, so any pair meets in that of its larger set."""
    num, den = threshold
    return list(range(_band(n), _band(n * den // num) + 1))


def token_counts(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """How often tokens stand in all documents, by the first TABLE bits of their hash: always 2 ** TABLE numbers."""

    @lean
    def run(batches):
        counts = np.zeros(1 << TABLE, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in slices(offsets):
                hashes, lo, hi = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = [shingles(hashes[x:y], size) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                counts += np.bincount((np.concatenate(some) >> np.uint64(64 - TABLE)).view(np.int64), minlength=1 << TABLE)
        slot = np.flatnonzero(counts)
        for i in range(0, len(slot), 10_000):
            part = slot[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], ["slot", "n"])

    found = docs.select(text_col).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << TABLE, np.int64)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return table


def shingle_sets(docs: DataFrame, threshold: tuple[int, int], size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d1, d2, prefix): number of shingles, a 128-bit digest of the set, and the first tokens of its order."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(token_counts(docs, size, text_col))

    @lean
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                hashes, lo, hi = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, d1, d2, prefix = [], [], [], []
                for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                    own = np.unique(shingles(hashes[x:y], size).view(np.int64))
                    digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                    n.append(len(own)), d1.append(digest[0]), d2.append(digest[1])
                    if misses_any(len(own), threshold):
                        often = shared.value[(own.view(np.uint64) >> np.uint64(64 - TABLE)).view(np.int64)]
                        prefix.append(own[np.argsort(often, kind="stable")[: prefix_length(len(own), threshold)]])
                    else:
                        prefix.append(own[:0])
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "d1", "d2", "prefix"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n long, d1 long, d2 long, prefix array<long>")


def misses_any(n: int, threshold: tuple[int, int]) -> bool:
    """Whether a set of n can reach the threshold with a different one: n / (n + 1) does, or (n - 1) / n."""
    num, den = threshold
    return den * n >= num * (n + 1) or den * (n - 1) >= num * n > 0


def candidates(sets: DataFrame, work: Work, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b) pairs that tie all sets which may link (and others): sets has one row (id, n, prefix) for each distinct set."""
    num, den = threshold
    tokens = sets.select("id", "n", F.explode("prefix").alias("tok"))
    shared = tokens.groupBy("tok").count().where("count > 1")
    rows = tokens.join(shared.hint("shuffle_hash"), "tok").groupBy("id", "n").agg(F.collect_list(F.struct("tok", (F.col("count") <= RARE).alias("rare"))).alias("t"))

    @lean
    def sign(batches):
        for batch in batches:
            sigs, single, need = [], [], []
            for n, t in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                tok, rare = (t.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                common = np.sort(tok[~rare]).view(np.uint64)
                own = [tok[rare]]
                for band in _bands(n, threshold):
                    classes = common % np.uint64(_classes(band, threshold))
                    for c in np.unique(classes):
                        some = common[classes == c]
                        i1, i2 = np.triu_indices(len(some), 1)
                        own.append(mix(mix(some[i1] + np.uint64(band)) * np.uint64(3) + some[i2]).view(np.int64))
                sigs.append(np.concatenate(own))
                single.append(np.arange(len(sigs[-1])) < len(own[0]))
                need.append(prefix_length(n, threshold) - len(common) - misses(n, threshold))
            if not sigs:
                continue
            row = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            need = np.array(need, np.int64)[row]
            cols = [pa.array(np.concatenate(sigs)), pa.array(np.concatenate(single)), *[batch.column(k).take(pa.array(row)) for k in range(2)], pa.array(need), pa.array(need <= 0)]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "single", "id", "n", "need", "heavy"])

    signed = work.store(rows.select("id", "n", "t").mapInArrow(sign, "sig long, single boolean, id long, n long, need long, heavy boolean"))
    one = signed.where("single")
    # at most RARE sets have the token
    left, right = one.select("sig", F.col("id").alias("a"), F.col("n").alias("na"), F.col("need").alias("needa")), one.select("sig", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("need").alias("needb"))
    pairs = left.join(right, "sig").where((F.col("a") < F.col("b")) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb")))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.first(F.least("needa", "needb")).alias("need")).where(F.col("k") >= F.col("need")).select("a", "b")
    # combinations: every set is tied to the bucket's least heavy set
    many = signed.where("not single").groupBy("sig").agg(F.min(F.when(F.col("heavy"), F.col("id"))).alias("b"), F.count("*").alias("k")).where("b is not null and k > 1")
    ties = signed.where("not single").join(many, "sig").where("id <> b").select(F.col("id").alias("a"), "b")
    return pairs.union(ties).distinct()


def link_blocks(texts: DataFrame, threshold: tuple[int, int], size: int) -> DataFrame:
    """Of each tile, links (a, b) that span its components, and (a, null, n): n documents that link with a's set here.

    texts: (block, part, own, id, copies, text), see similar(). A tile of two slices compares its own sets with all; each
    pair of different sets is counted in one tile only, where it stands across the slices or the slice is alone.
    """
    num, den = threshold

    @lean
    def verify(key, table):
        alone = key[1].as_py()
        alone = alone["kind"] == 0 and alone["p"] == alone["q"]
        if pc.count_distinct(table.column("id")).as_py() < table.num_rows:  # repeated rows
            seen = {x: i for i, x in reversed(list(enumerate(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True))))}
            table = table.take(pa.array(sorted(seen.values()), pa.int64()))
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        partners = np.zeros(len(ids), np.int64)
        own = table.column("own").to_numpy(zero_copy_only=False)
        data, offsets = utf8(table.column("text"))
        sets = []
        for a, b in slices(offsets):
            hashes, lo, hi = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sets += [np.unique(shingles(hashes[x:y], size)) for x, y in zip(lo, hi, strict=True)]
        n = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), n)
        tokens = np.concatenate(sets)
        # only tokens of several sets count for an overlap
        order = np.argsort(tokens, kind="stable")
        new = np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]])
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1
        col = np.unique(group[keep], return_inverse=True)[1]
        at = row[order][keep]
        label = np.arange(len(ids))
        links, step = [], 256
        left = np.flatnonzero(own)
        width = int(col.max()) + 1 if len(col) else 0
        for i in range(0, len(left), step):
            some = left[i : i + step]
            overlap = np.zeros((len(some), len(ids)), np.float32)
            pos = np.full(len(ids), -1)
            pos[some] = np.arange(len(some))
            for c in range(0, width, 4096):
                inside = (col >= c) & (col < c + 4096)
                m = np.zeros((len(ids), min(4096, width - c)), np.float32)
                m[at[inside], col[inside] - c] = 1
                overlap += m[some] @ m.T
            both = overlap.astype(np.int64)
            ok = den * both >= num * (n[some][:, None] + n[None, :] - both)
            ok[np.arange(len(some)), some] = False
            counted = ok if alone else ok & ~own[None, :]
            partners[some] += counted @ copies
            partners += np.where(own, 0, copies[some] @ counted)
            for x, hits in zip(some, ok, strict=True):
                y = np.flatnonzero(hits & (label != label[x]))
                if len(y):
                    joined, first = np.unique(label[y], return_index=True)
                    links += [(int(ids[x]), int(ids[z])) for z in y[first]]
                    label[np.isin(label, joined)] = label[x]
        some = np.flatnonzero(partners)
        a = [x for x, _ in links] + ids[some].tolist()
        b = [y for _, y in links] + [None] * len(some)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([0] * len(links) + partners[some].tolist(), pa.int64())})

    return texts.groupBy("block", "part").applyInArrow(verify, "a long, b long, n long")


def similar(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) for every row: the size of its shingle set, the least id its links reach,
    and with how many other documents it links.

    Two documents link when their sets' intersection is at least threshold times their union; empty sets (null texts,
    texts without a word) link with nothing. Equal sets are one class from the start, whatever their number, so copies
    are never paired, only counted. Links span components; no pair of different sets at the threshold is lost. Repeated
    rows with one id are one document of the graph (but count as many partners) and come back as often as they are given;
    a row with a null id has its own set size, a null component and no links. Texts must be unique by id for the result
    to be one set a document: of several texts under one id, all links count. Other columns are not read.
    """
    num, den = threshold
    work = Work(docs.sparkSession)
    table = work.store(shingle_sets(docs, threshold, size, id_col, text_col))
    real = table.where("n > 0 and id is not null")
    classes = work.store(real.groupBy("d1", "d2", "n").agg(F.min(F.col("id").cast("long")).alias("rep"), F.first("prefix").alias("prefix"), F.count("*").alias("copies")))
    ties = work.store(candidates(classes.where(F.size("prefix") > 0).select(F.col("rep").alias("id"), "n", "prefix"), work, threshold))
    groups = components(ties, keep=work).join(classes.select(F.col("rep").alias("id"), "n", "copies"), "id")
    # bands by size: partners are in the same band or the next; each band is checked against itself and the next
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("long")
    groups = groups.withColumn("band", band)
    # sets of a band are about equally large: a slice has at most BLOCK of them and about BLOCK_SHINGLES shingles
    slice_of = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.max("n"))))
    sizes = groups.groupBy("component", "band").agg(F.ceil(F.count("*") / slice_of).cast("int").alias("k"))
    groups = groups.join(sizes, ["component", "band"])
    below = sizes.select("component", (F.col("band") + 1).alias("band"), F.col("k").alias("k_below"))
    above = sizes.select("component", (F.col("band") - 1).alias("band"), F.col("k").alias("k_above"))
    spread = groups.join(below, ["component", "band"], "left").join(above, ["component", "band"], "left")
    spread = spread.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int"))
    # a tile holds two slices of a band, or a slice each of a band and of the next; neighbours of one slice share a tile
    tile = lambda band, kind, p, q, own: (F.struct("component", band.alias("band")).alias("block"), F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q")).alias("part"), own.alias("own"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias("t")
    own, t, slot, here = F.lit(True), F.col("t"), F.col("slot"), F.col("band")
    inside = spread.select("*", every("k")).select("id", "copies", *tile(here, 0, F.least(slot, t), F.greatest(slot, t), slot <= t))
    small = lambda other: (F.col("k") == 1) & (F.col(other) == 1)
    host = spread.where(F.col("k_above").isNotNull() & ~small("k_above")).select("*", every("k_above")).select("id", "copies", *tile(here, 1, slot, t, own))
    guest = spread.where(F.col("k_below").isNotNull() & ~small("k_below")).select("*", every("k_below")).select("id", "copies", *tile(here - 1, 1, t, slot, ~own))
    near = spread.where(small("k_below")).select("id", "copies", *tile(here - 1, 0, F.lit(0), F.lit(0), ~own))
    routes = inside.union(host).union(guest).union(near)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found = work.store(link_blocks(routes.join(texts, "id").select("block", "part", "own", "id", "copies", "text"), threshold, size))
    linked = components(found.where("b is not null"), keep=work).withColumnRenamed("id", "rep")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    # classes that share an id (repeated ids with different texts) and equal sets meet through the least id of the class
    whole = classes.join(linked, "rep", "left").join(counts, "rep", "left")
    whole = whole.select("d1", "d2", "n", F.coalesce("component", "rep").alias("c"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = table.drop("prefix").join(whole, ["d1", "d2", "n"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.col("c").cast(kind), F.col("id")))
    links = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = stored(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), links.alias("n_links")))
    work.clear()
    return out


def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the document with the least id stays; rows with a null id stay.

    Up to BROADCAST_IDS ids that go are broadcast, so that texts stay where they are; beyond, both sides meet by a shuffle.
    """
    gone = similar(docs, threshold, size, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
