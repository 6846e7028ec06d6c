"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.llm.util import stored

WEIGHTS = (5, 2, 1)
#: Virtual time between 0 and 1 is cut into so many ranges; the last range holds all later times.
RANGES = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(col: str = "text"):
    """Words `[^\\x20\\x09-\\x0D]+` of a text, null 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with target: sources by code point, null last, weigh `weights`, repeating.

    They share 150 % of all sizes by weight; a target stops at twice its source's size and the excess is shared again by
    weight. With sources in order of 2 * size / weight, those before the first that stays below its cap are capped, and
    one level holds for the rest; the arithmetic up to the last division is in integers, so reruns agree to the bit.
    The table has one row for each source and is handled in one partition.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    fill = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    t = sources.select("source", "source_size", rank.alias("rank"), weight.alias("weight"))
    # twice the words left for this and later sources, and their weight
    t = t.withColumn("left2", 3 * F.sum("source_size").over(everything) - 4 * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    t = t.withColumn("w_left", F.sum("weight").over(after))
    t = t.withColumn("open", F.when(4 * F.col("source_size") * F.col("w_left") > F.col("weight") * F.col("left2"), F.struct("left2", "w_left")))
    level = F.first("open", ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("level", level)
    shared = F.col("weight") * F.col("level.left2") / (2.0 * F.col("level.w_left"))
    return t.select("source", "source_size", "rank", F.coalesce(shared, F.col("source_size") * 2.0).alias("target"))


def reachable(copies: DataFrame, total: int) -> DataFrame:
    """copies with the words before their slot, of slots that start before 150 % of all words; no later one can be taken.

    Slots are 2 * RANGES + 1 rows at most, whatever the input. They are broadcast, so that the late copies, which share
    the last slot, are dropped where they are and not gathered in one task.
    """
    slots = copies.groupBy("slot").agg(F.sum("size").alias("own"))
    slots = slots.select("slot", (F.sum("own").over(W.orderBy("slot")) - F.col("own")).alias("before"))
    return copies.join(F.broadcast(slots.where(2 * F.col("before") < 3 * total)), "slot")


def _taken(docs: DataFrame, weights: tuple[int, ...], seed: str, id_col: str, source_col: str, text_col: str, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (row, id, source, size, hash, uid), sources with targets, and what the mix takes: (uid, taken, copies).

    row holds all columns of docs if `whole`; whatever their names, they meet none of ours. All three are stored tables.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.lit(None)
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    rows = rows.withColumn("hash", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed)).cast("binary")))
    rows = stored((rows if whole else rows.drop("row")).withColumn("uid", F.monotonically_increasing_id()))
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    known = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("id", "uid", "size", "hash", "rank", "source_size", "target").withColumn("range", F.substring("hash", 1, 4))
    ranges = known.groupBy("rank", "range").agg(F.sum("size").alias("own"))
    ranges = ranges.select("rank", "range", (F.sum("own").over(W.partitionBy("rank").orderBy("range")) - F.col("own")).alias("before"))
    order = W.partitionBy("rank", "range").orderBy("hash", "id", "uid").rowsBetween(W.unboundedPreceding, 0)
    up_to = known.withColumn("up_to", F.sum("size").over(order)).join(ranges, ["rank", "range"])
    copy = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    copies = up_to.where("size > 0").select("id", "uid", "size", "hash", "rank", "source_size", "target", (F.col("before") + F.col("up_to")).alias("up_to"), copy)
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("up_to")) / F.col("target"))
    copies = stored(copies.select("id", "uid", "size", "hash", "rank", "copy", "finish", F.least(F.floor(F.col("finish") * RANGES), F.lit(2 * RANGES)).alias("slot")))
    order = W.partitionBy("slot").orderBy("finish", "rank", "hash", "id", "uid", "copy").rowsBetween(W.unboundedPreceding, 0)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    mixed = reachable(copies, total).withColumn("in_slot", F.sum("size").over(order)).where(2 * (F.col("before") + F.col("in_slot")) <= 3 * total)
    taken = stored(mixed.groupBy("uid").agg(F.sum("size").alias("taken"), F.count("*").alias("copies")))
    return rows, sources, taken


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken) for every row of docs.

    Documents of a source stand in order of md5(id, seed), twice over (a document may be taken twice at most). A copy's
    virtual finish time is its source's words up to its end divided by the source's target. Copies are put in ranges of
    that time, and the mix takes them in global order of (time, source, hash, id, copy) up to 150 % of all words: words
    before a range come from the ranges' sums, words within it from a window, so neither a hot source nor the global
    order is ever one task. Words before a document in its source come the same way, by ranges of the hash.

    Null texts have size 0 and are taken 0 words; a null source is a source of its own, the last; null ids are hashed as
    the empty text; repeated rows are documents of their own. An empty table gives an empty one. Other columns are not
    read, so clashing names do no harm.
    """
    rows, sources, taken = _taken(docs, weights, seed, id_col, source_col, text_col, False)
    out = rows.join(taken, "uid", "left").join(sources.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows that the mix takes, with all columns of docs and no other; a document taken twice is two rows.

    Columns may have any names, `size` or `taken` among them: they travel in a struct. See mix() for the other cases.
    """
    rows, _, taken = _taken(docs, weights, seed, id_col, source_col, text_col, True)
    out = rows.select("uid", "row").join(taken.select("uid", "copies"), "uid")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
