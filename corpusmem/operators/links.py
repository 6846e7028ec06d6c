"""Documents linked to the symbols they mention: a substring join, blocked by each name's rarest trigram. Token sets that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.plans.scratch import stored

MIN_NAME = 3
#: Sets and tokens of a slice of a project, and left sets of a block: a tile holds two slices and the counts of one block.
SETS, TOKENS, BLOCK = 16_384, 2_000_000, 1024
#: Tokens that a larger share of a tile's pairs has are counted by products of matrices, so many columns at a time.
DENSE, WIDTH = 0.01, 512
#: Trigrams of names (of each project) up to which they are broadcast: some tens of bytes each.
BROADCAST_GRAMS = 500_000
#: Tiles up to which each has a task of its own.
MOST_TASKS = 4000
#: Projects up to which their numbers of slices are broadcast.
BROADCAST_PROJECTS = 500_000


def _trigrams(text):
    """Distinct runs of three characters, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def links(docs: DataFrame, symbols: DataFrame | None = None, keys: tuple[str, ...] = (), ident: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, doc_id, symbol_id): the symbol's name, case aside, is a substring of the document's title, summary and keywords.

    docs and symbols: entries; without symbols, docs hold both. Names of three characters or more are looked up by one
    trigram, of theirs the one in fewest documents; only trigrams of names are taken from the documents, and candidates
    are verified by `contains`. Names with up to BROADCAST_GRAMS trigrams are sent to the documents, so that no text is
    shuffled; beyond, both sides meet by trigram. Distinct names are matched first and symbols joined to them afterwards. With keys, such
    as the project, only rows that agree in them are linked. ident: further columns that name an entry, which come out
    with doc_ and symbol_ before their names.
    """
    docs, symbols = docs.where("type = 'doc'"), (docs if symbols is None else symbols).where("type = 'symbol'")
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")))
    docs = docs.select(*keys, F.struct(*ident).alias("doc"), hay.alias("hay")).where(F.length("hay") >= MIN_NAME)
    symbols = symbols.select(*keys, F.struct(*ident).alias("symbol"), F.lower(F.col("keywords")[0]).alias("name")).where(F.length("name") >= MIN_NAME)
    names = symbols.select(*keys, "name").distinct()
    named = stored(names.select(*keys, "name", F.explode_outer(_trigrams(F.col("name"))).alias("gram")))
    sent = F.broadcast if named.count() <= BROADCAST_GRAMS else (lambda df: df)
    # outer generators: for an inner one Spark infers a filter, and makes the trigrams twice
    grams = docs.select(*keys, "doc", "hay", F.explode_outer(_trigrams(F.col("hay"))).alias("gram"))
    grams = grams.join(sent(named.select(*keys, "gram").distinct()), [*keys, "gram"], "left_semi")
    counts = grams.groupBy(*keys, "gram").agg(F.count("*").alias("k"))
    rarest = named.join(counts, [*keys, "gram"], "left").groupBy(*keys, "name").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "gram")).alias("g"))
    rarest = rarest.where("g.k > 0").select(*keys, "name", F.col("g.gram").alias("gram"))
    pairs = grams.join(sent(rarest), [*keys, "gram"]).where(F.col("hay").contains(F.col("name"))).select(*keys, "doc", "name")
    out = pairs.join(symbols, [*keys, "name"]).select(*keys, *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("doc", "symbol") for c in ident])
    return out.distinct()


def linked_symbols(found: DataFrame) -> DataFrame:
    """(doc_id, n_links, symbols): links rendered as a sorted list."""
    return found.groupBy("doc_id").agg(F.count("*").alias("n_links"), F.array_sort(F.collect_set("symbol_id")).alias("symbols"))


def nested_loop_links(entries: DataFrame) -> DataFrame:
    """The same by comparing all pairs; for tests only."""
    hay = F.lower(F.concat_ws(" ", "title", "summary", F.array_join("keywords", " ")))
    docs = entries.where("type = 'doc'").select(F.col("id").alias("doc_id"), hay.alias("hay"))
    symbols = entries.where("type = 'symbol'").select(F.col("id").alias("symbol_id"), F.lower(F.col("keywords")[0]).alias("name")).where(F.length("name") >= MIN_NAME)
    return docs.join(symbols, F.col("hay").contains(F.col("name"))).select("doc_id", "symbol_id").distinct()


def keyed_sets(rows: DataFrame) -> DataFrame:
    """rows (project, id, seq, tokens) with `set`, a name of the token set that equal sets share (128 bits of its hash),
    stored; empty sets go. Tokens are distinct within a row."""
    name = F.left(F.sha2(F.to_json(F.array_sort("tokens")).cast("binary"), 256), F.lit(32))
    return stored(rows.where(F.size("tokens") > 0).select("project", "id", "seq", name.alias("set"), "tokens"))


def distinct_sets(keyed: DataFrame) -> DataFrame:
    """(project, set, n, tokens, first): each set of a project once, with the first (seq, id) that has it, stored."""
    found = keyed.groupBy("project", "set").agg(F.first("tokens").alias("tokens"), F.min(F.struct("seq", "id")).alias("first"))
    return stored(found.select("project", "set", F.size("tokens").alias("n"), "tokens", "first"))


def _pack(table: pa.Table) -> bytes:
    """A slice in few bytes: each token once, sets as numbers of tokens, compressed."""
    lists = table.column("tokens").combine_chunks()
    numbered = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]), pa.int32()), lists.flatten().dictionary_encode())
    table, out = table.set_column(table.column_names.index("tokens"), "tokens", numbered), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(table: pa.Table) -> pa.Table | None:
    """The slice of a tile's side; None if the tile has none there."""
    return pa.ipc.open_stream(table.column("packed")[0].as_py()).read_all() if len(table) else None


def _dealt(a: DataFrame, b: DataFrame, left: tuple[str, ...] = ("set", "n", "tokens"), right: tuple[str, ...] = ("set", "n", "tokens", "first.seq", "first.id")) -> tuple[DataFrame, DataFrame]:
    """Both sides of distinct_sets dealt to tiles (project, i, j): each slice of a project's left sets meets each of its right ones.

    A slice has about SETS sets or TOKENS tokens at most, so a large project is spread over its tiles. A slice is packed
    once, with the columns named, and sent as one row for each slice of the other side: so what is sent again is a
    fraction of what the sets themselves take.
    """
    parts = lambda df, name: df.groupBy("project").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / TOKENS)).cast("int").alias(name))
    tiles = stored(parts(a, "ni").join(parts(b, "nj"), "project"))
    projects, count = tiles.agg(F.count("*"), F.sum(F.col("ni").cast("long") * F.col("nj"))).first()
    tiles = F.broadcast(tiles) if projects <= BROADCAST_PROJECTS else tiles

    def packed(df: DataFrame, columns: tuple[str, ...], own: str, mine: str, other: str, others: str) -> DataFrame:
        rows = df.join(tiles, "project").select("project", F.pmod(F.xxhash64("set"), F.col(mine)).cast("int").alias(own), F.col(others).alias("times"), *columns)

        def pack(table: pa.Table) -> pa.Table:
            head = table.select(["project", own, "times"]).slice(0, 1)
            return head.append_column("packed", pa.array([_pack(table.drop_columns(["project", own, "times"]))], pa.binary()))

        whole = rows.groupBy("project", own).applyInArrow(pack, f"project {dict(rows.dtypes)['project']}, {own} int, times int, packed binary")
        sent = whole.select("project", own, F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias(other), "packed")
        # packed slices are small, and a tile's work isn't: by size alone Spark would put many tiles into one task
        return sent.repartition(max(1, min(count or 1, MOST_TASKS)), "project", "i", "j")

    return packed(a, left, "i", "ni", "j", "nj"), packed(b, right, "j", "nj", "i", "ni")


def _numbered(*tables: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each table the (row, token) of all its sets, by row; equal tokens have one number in all tables."""
    lists = [t.column("tokens").combine_chunks() for t in tables]
    names = pa.chunked_array([x.flatten() for x in lists]).unify_dictionaries()
    sizes = [pc.list_value_length(x).to_numpy() for x in lists]
    return [(np.repeat(np.arange(len(n)), n), x.indices.to_numpy()) for n, x in zip(sizes, names.chunks, strict=True)]


def _shared(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts): how many tokens the left sets of a block share with each right one.

    Tokens of many pairs are counted by a product of matrices, the others by their postings.
    """
    (rows, tokens), (others, theirs) = _numbered(left, right)
    n = int(max(tokens.max(initial=0), theirs.max(initial=0))) + 1
    mine, found = np.bincount(tokens, minlength=n), np.bincount(theirs, minlength=n)
    dense = mine * found > DENSE * len(left) * len(right)
    column, width = np.cumsum(dense) - 1, int(dense.sum())

    def matrix(rows: np.ndarray, tokens: np.ndarray, height: int) -> np.ndarray:
        out, own = np.zeros((height, width), "uint8"), dense[tokens]
        out[rows[own], column[tokens[own]]] = 1
        return out

    every, rare = matrix(others, theirs, len(right)), ~dense[theirs]
    posted = others[rare][np.argsort(theirs[rare], kind="stable")]
    until, met = np.cumsum(np.where(dense, 0, found)), ~dense & (found > 0)
    for begin in range(0, len(left), BLOCK):
        height = min(BLOCK, len(left) - begin)
        own = slice(*np.searchsorted(rows, [begin, begin + height]))
        at, asked = rows[own] - begin, tokens[own]
        block, counts = matrix(at, asked, height), np.zeros((height, len(right)), "float32")
        for c in range(0, width, WIDTH):
            counts += block[:, c : c + WIDTH].astype("float32") @ every[:, c : c + WIDTH].astype("float32").T
        at, asked = at[met[asked]], asked[met[asked]]
        ends = np.searchsorted(at, np.arange(height + 1))
        for k in np.unique(at):
            counts[k] += np.bincount(np.concatenate([posted[until[t] - found[t] : until[t]] for t in asked[ends[k] : ends[k + 1]]]), minlength=len(right))
        yield begin, counts


def _least(table: pa.Table, threshold: float) -> np.ndarray:
    """The smallest number of shared tokens that is threshold of each set or more; of two sets the smaller number counts."""
    n = table.column("n").to_numpy().astype("float64")
    least = np.ceil(n * threshold)
    least -= (least - 1) / n >= threshold
    least += least / n < threshold
    return np.maximum(least, 1).astype("float32")


def best_partners(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(project, set, overlap, first): of distinct_sets, each left set's best partner that shares threshold of the smaller set
    or more; first is the partner's. The largest overlap wins, ties go to the smaller (seq, id).

    All sets of a project are compared in tiles, each of which returns one row a left set at most.
    """

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _unpack(left), _unpack(right)
        if left is None or right is None:
            return none
        right = right.take(pc.sort_indices(right, [("seq", "ascending"), ("id", "ascending")], null_placement="at_start"))
        mine, theirs = _least(left, threshold), _least(right, threshold)
        best, most = np.zeros(len(left), "int64"), np.zeros(len(left), "int32")
        for at, counts in _shared(left, right):
            counts *= counts >= np.minimum(mine[at : at + len(counts), None], theirs)
            best[at : at + len(counts)] = own = counts.argmax(1)  # the first of the largest
            most[at : at + len(counts)] = np.take_along_axis(counts, own[:, None], 1)[:, 0]
        own = np.flatnonzero(most)
        left, right = left.column("set").take(own), right.select(["seq", "id"]).take(best[own])
        return pa.table([pa.array([key[0].as_py()] * len(own), key[0].type), left, pa.array(most[own]), *right.columns], names=names)

    left, right = _dealt(a, b, right=("n", "tokens", "first.seq", "first.id"))
    kinds, names = dict(right.dtypes) | {x.name: x.dataType.simpleString() for x in b.schema["first"].dataType}, ["project", "set", "overlap", "seq", "id"]
    schema = f"project {kinds['project']}, set string, overlap int, seq {kinds['seq']}, id {kinds['id']}"
    none = a.sparkSession.createDataFrame([], schema).toArrow()
    found = left.groupBy("project", "i", "j").cogroup(right.groupBy("project", "i", "j")).applyInArrow(tile, schema)
    best = found.groupBy("project", "set").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.struct("seq", "id").alias("first"))).alias("b"))
    return best.select("project", "set", (-F.col("b.o")).alias("overlap"), "b.first")


def met(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(project, set): of distinct_sets, the right sets that share threshold of the smaller set or more with a left one.

    Tiles as for best_partners. The smallest left sets come first, since they are met most, and right sets that were met
    aren't compared again in their tile.
    """

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _unpack(left), _unpack(right)
        if left is None or right is None:
            return none
        left, out = left.sort_by("n"), []
        for begin in range(0, len(left), BLOCK):
            block = left.slice(begin, BLOCK)
            for _, counts in _shared(block, right) if len(right) else ():
                hit = (counts >= np.minimum(_least(block, threshold)[:, None], _least(right, threshold))).any(0)
                out.append(right.column("set").filter(hit))
                right = right.filter(~hit)
        found = pa.chunked_array([c for x in out for c in x.chunks], pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(found), key[0].type), found], names=["project", "set"])

    left, right = _dealt(a, b, ("n", "tokens"), ("set", "n", "tokens"))
    schema = f"project {dict(right.dtypes)['project']}, set string"
    none = a.sparkSession.createDataFrame([], schema).toArrow()
    found = left.groupBy("project", "i", "j").cogroup(right.groupBy("project", "i", "j")).applyInArrow(tile, schema)
    return found.distinct()


def partnered(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(project, id, seq, partner, overlap): the rows of best_overlap with the left row's seq."""
    rows = keyed_sets(left)
    best = best_partners(distinct_sets(rows), distinct_sets(keyed_sets(right)), threshold)
    return rows.select("project", "set", "id", "seq").join(best, ["project", "set"]).select("project", "id", "seq", F.col("first.id").alias("partner"), F.col("overlap").cast("long").alias("overlap"))


def best_overlap(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(project, left_id, right_id, overlap): of token sets (id, project, seq, tokens), each left row's best partner of its project.

    Partners share threshold of the smaller set or more; the largest overlap wins, ties go to the smaller seq, then id.
    Equal sets are compared once; rows without tokens, or without a project, have no partner.
    """
    return partnered(left, right, threshold).select("project", F.col("id").alias("left_id"), F.col("partner").alias("right_id"), "overlap")


def compared_overlap(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The same by comparing all pairs of a project; for tests only."""
    pairs = left.alias("l").join(right.alias("r"), "project").where("size(l.tokens) > 0 and size(r.tokens) > 0")
    pairs = pairs.select("project", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "r.seq", F.size(F.array_intersect("l.tokens", "r.tokens")).cast("long").alias("overlap"), F.least(F.size("l.tokens"), F.size("r.tokens")).alias("n"))
    best = W.partitionBy("project", "left_id").orderBy(F.col("overlap").desc(), "seq", "right_id")
    return pairs.where(F.col("overlap") / F.col("n") >= threshold).withColumn("k", F.row_number().over(best)).where("k = 1").select("project", "left_id", "right_id", "overlap")
