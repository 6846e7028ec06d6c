"""BM25 ranking of a table of queries over pools of entries or notes, and the cited answers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.functions.text import tokens, truncate
from corpusmem.operators import links
from corpusmem.plans.scratch import stored

K1, B = 1.5, 0.75


ONE = ("query_id", "variant", "pool")
#: Query terms (times pools) up to which they are broadcast: some tens of bytes each. Beyond, Spark joins by a shuffle.
BROADCAST_TERMS = 500_000
#: Bounds are compared with scores less this much: ranks go by six decimals, and sums may round.
SLACK = 2e-6
#: Rows scored whole for the threshold, times the limit; and the share of the threshold that inessential terms may reach.
LEADERS, SHARE = 8, 0.6
#: Scores (a row for a query variant and a row) that a task sums: some 100 bytes each, in two hash tables and a sort.
PAIRS = 1_000_000


def postings(rows: DataFrame, text, keys: tuple[str, ...] = ("pool", "id")) -> DataFrame:
    """(keys, term, tf)."""
    # outer generators: for an inner one Spark infers a filter, and tokenises twice
    terms = rows.select(*keys, F.explode_outer(tokens(text)).alias("term")).where("term is not null")
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, text, keys: tuple[str, ...] = ("pool", "id")) -> DataFrame:
    """(keys, len): tokens of each row."""
    return rows.select(*keys, F.size(tokens(text)).cast("long").alias("len"))


def pool_stats(sizes: DataFrame) -> DataFrame:
    """(pool, n, avgdl): one row a pool."""
    return sizes.groupBy("pool").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(pool, term, df)."""
    return posted.groupBy("pool", "term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, keys: tuple[str, ...] = ("query_id", "variant")) -> DataFrame:
    """(keys, term): distinct terms of every query variant."""
    return queries.select(*keys, F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).where("term is not null")


def small(terms: DataFrame, rows: DataFrame) -> bool:
    """Whether the terms of all queries, in each pool, are few enough to be broadcast."""
    return terms.count() * max(1, rows.select("pool").distinct().count()) <= BROADCAST_TERMS


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _parts(spark: SparkSession, pairs: int) -> int:
    """Partitions in which a task sums PAIRS scores at most. The number is given, so that Spark, which sees only the few bytes
    of the postings, doesn't join them."""
    return max(spark.sparkContext.defaultParallelism, ceil(pairs / PAIRS))


def scored_parts(terms: DataFrame, rows: DataFrame) -> int:
    """Partitions by id in which all rows are scored for all query variants: every pair may have a score."""
    return _parts(rows.sparkSession, terms.select("query_id", "variant").distinct().count() * rows.count())


def asked_postings(rows: DataFrame, text, terms: DataFrame, few: bool = False, parts: int | None = None) -> DataFrame:
    """(pool, id, len, term, tf): postings of asked terms, and of the empty term once for every row, for the statistics.

    Each text is tokenised once; only tokens that are asked are shuffled, by id, so that neither the counts nor the sums
    of scores by row need another shuffle. parts: partitions, see scored_parts; left to Spark where no scores are summed in them.
    """
    bag = rows.select("pool", "id", tokens(text).alias("t"))
    # the length first: what is computed beside an explode would carry the whole array along with each of its tokens
    bag = bag.select("pool", "id", F.size("t").cast("long").alias("len"), F.concat(F.array(F.lit("")), "t").alias("t"))
    every = bag.select("pool", "id", "len", F.explode_outer("t").alias("term"))
    asked = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    found = every.join(_sent(asked, few), "term", "left_semi").repartition(*([parts] if parts else []), "id")
    return found.groupBy("pool", "id", "len", "term").agg(F.count("*").alias("tf"))


def term_stats(posted: DataFrame) -> DataFrame:
    """(pool, term, df, total, max_tf, min_len) of asked postings; those of the empty term are the pool's own."""
    return posted.groupBy("pool", "term").agg(F.count("*").alias("df"), F.sum("len").alias("total"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def _part(tf, length, avgdl):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(length, F.lit(1)) / avgdl))


def weighed(terms: DataFrame, stats: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, variant, pool, term, df, n, idf, avgdl, most): the terms of each query in each pool; most bounds a term's score."""
    pools = stats.where("term = ''").select("pool", F.col("df").alias("n"), F.when(F.col("total") > 0, F.col("total") / F.col("df")).otherwise(1.0).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = stats.where("term <> ''").join(pools, "pool").select("pool", "term", "df", "n", "avgdl", idf.alias("idf"), (idf * _part(F.col("max_tf"), F.col("min_len"), F.col("avgdl"))).alias("most"))
    shared = ["term"] + (["pool"] if "pool" in terms.columns else [])
    return known.join(_sent(terms, few), shared)


def _sums(posted: DataFrame, wanted: DataFrame, few: bool, parts: int | None = None) -> DataFrame:
    """(query_id, variant, pool, id, score): sums of term scores over equal terms.

    parts: partitions by id to which the wanted postings, which are fewer than the scores, are dealt first.
    """
    if parts:
        posted = posted.join(_sent(wanted.select("pool", "term").distinct(), few), ["pool", "term"], "left_semi").repartition(parts, "id")
    part = F.col("idf") * _part(F.col("tf"), F.col("len"), F.col("avgdl"))
    hits = posted.join(_sent(wanted.select(*ONE, "term", "idf", "avgdl"), few), ["pool", "term"])
    return hits.groupBy(*ONE, "id").agg(F.sum(part).alias("score"))


def scores(terms: DataFrame, posted: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, variant, pool, id, score) of every row with an asked term; statistics are those of the pool.

    posted: see asked_postings. Terms with a pool are asked in that pool only.
    """
    return _sums(posted, weighed(terms, term_stats(posted), few), few).where("score > 0")


def _looked_up(hits: DataFrame, wanted: DataFrame, posted: DataFrame, few: bool) -> DataFrame:
    """(query_id, variant, pool, id, more): sums over the wanted terms for given rows only."""
    part = F.col("idf") * _part(F.col("tf"), F.col("len"), F.col("avgdl"))
    asked = hits.select(*ONE, "id").join(_sent(wanted.select(*ONE, "term", "idf", "avgdl"), few), list(ONE))
    return asked.join(posted, ["pool", "id", "term"]).groupBy(*ONE, "id").agg(F.sum(part).alias("more"))


def _extent(asked: DataFrame) -> tuple[bool, int]:
    """Whether weighed terms are few enough to be broadcast, and the partitions for all scores that they may make."""
    each = asked.groupBy(*ONE).agg(F.count("*").alias("terms"), F.least(F.sum("df"), F.max("n")).alias("pairs"))
    found = each.agg(F.sum("terms"), F.sum("pairs")).first()
    return (found[0] or 0) <= BROADCAST_TERMS, _parts(asked.sparkSession, found[1] or 0)


def best_scores(terms: DataFrame, posted: DataFrame, limit: int, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, variant, pool, id, score): the rows that can be among a query's best `limit`, with whole scores.

    Terms are bounded by their greatest score in the pool (MaxScore). First come the terms with the upper half of the
    bounds: the leaders of that sum are scored whole, and the limit-th of them gives a threshold that the best rows
    reach. Terms whose bounds add up to less than a share of the threshold, the least first, can't lift a row there
    alone: only rows with another, essential, term are summed. Those that their sum and the other terms' bounds lift to
    the threshold are looked up in the postings of the other terms. What is read more than once (query terms with their
    bounds, rows that may enter) is stored; posted is read five times and should be stored, too. stats: those of
    term_stats, where they are kept.
    """
    up = W.partitionBy(*ONE).orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    asked = weighed(terms, term_stats(posted) if stats is None else stats).withColumn("below", F.sum("most").over(up) * (1 + 1e-9)).withColumn("all", F.max("below").over(W.partitionBy(*ONE)))
    asked = stored(asked)  # a row a query term and pool
    few, parts = _extent(asked)
    order = W.partitionBy(*ONE).orderBy(F.col("score").desc())
    first = _sums(posted, asked.where(F.col("below") > F.col("all") / 2), few, parts)
    leaders = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LEADERS * limit)
    whole = _looked_up(leaders, asked, posted, few).withColumnRenamed("more", "score")
    reached = whole.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == limit).select(*ONE, (F.col("score") * (1 - 1e-9) - SLACK).alias("reach"))
    asked = asked.join(_sent(reached, few), list(ONE), "left").withColumn("rest", F.col("below") < SHARE * F.coalesce("reach", F.lit(0.0)))
    asked = stored(asked)
    bound = asked.groupBy(*ONE).agg(F.coalesce(F.max("reach"), F.lit(0.0)).alias("reach"), F.coalesce(F.max(F.when(F.col("rest"), F.col("below"))), F.lit(0.0)).alias("lift"))
    hits = _sums(posted, asked.where(~F.col("rest")), few, parts).join(_sent(bound, few), list(ONE)).where((F.col("score") > 0) & (F.col("score") + F.col("lift") >= F.col("reach")))
    hits = stored(hits.select(*ONE, "id", "score"))  # some multiples of the limit a query
    more = _looked_up(hits, asked.where("rest"), posted, few)
    return hits.select(*ONE, "id", "score").join(more, [*ONE, "id"], "left").select(*ONE, "id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def merge_variants(scored: DataFrame) -> DataFrame:
    """Each document's best score over the variants of a query."""
    return scored.groupBy("query_id", "pool", "id").agg(F.max("score").alias("score"))


def clamp_limit(limit: int | None) -> int:
    return max(1, min(int(limit or 8), 20))


def top_k(scored: DataFrame, limit: int | None = 8) -> DataFrame:
    """The best rows of each query and pool, ties by id; scores at 6 decimals; rel_score in percent of the best."""
    best = W.partitionBy("query_id", "pool").orderBy(F.round("score", 6).desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= clamp_limit(limit))
    top = F.max("score").over(W.partitionBy("query_id", "pool"))
    rel = F.round(100 * F.col("score") / F.when(top == 0, 1.0).otherwise(top)).cast("int")
    return ranked.select("query_id", "pool", "rank", "id", F.round("score", 6).alias("score"), rel.alias("rel_score"))


def without_variants(queries: DataFrame, variants: DataFrame, rows: DataFrame, limit: int = 8) -> DataFrame:
    """Queries without any variant get the first rows by id of the pools they ask, with score 0. queries: (query_id, pool)."""
    bare = queries.select("query_id", "pool").distinct().join(variants, "query_id", "left_anti")
    first = rows.select("pool", "id").withColumn("rank", F.row_number().over(W.partitionBy("pool").orderBy("id"))).where(F.col("rank") <= limit)
    return bare.join(first, "pool").select("query_id", "pool", "rank", "id", F.lit(0.0).alias("score"))


def search(queries: DataFrame, rows: DataFrame, text, limit: int = 8) -> DataFrame:
    """queries (query_id, variant, text[, pool]) against rows (pool, id, ...) in one job; see best_scores.

    Queries with a pool are asked in that pool only, others in all. The asked postings are stored, sorted by
    term, as they are read several times.
    """
    keys = ("query_id", "variant") + (("pool",) if "pool" in queries.columns else ())
    terms = query_terms(queries, keys)
    posted = asked_postings(rows, text, terms, terms.count() <= BROADCAST_TERMS)
    posted = stored(posted.sortWithinPartitions("term"))
    return top_k(merge_variants(best_scores(terms, posted, clamp_limit(limit))), limit)


def layered(entries: DataFrame, layer: str = "all") -> DataFrame:
    """Entries with the pool a layer is searched as: all documents and symbols together, or one type alone."""
    if layer == "all":
        return entries.where(F.col("type").isin("doc", "symbol")).withColumn("pool", F.lit("all"))
    return entries.where(F.col("type") == layer).withColumn("pool", F.lit(layer))


def linked(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """The links of documents that were hit, made for them alone. entries: (id, type, ...)."""
    docs = entries.where("type = 'doc'").join(hits.select("id").distinct(), "id", "left_semi")
    return links.links(docs.unionByName(entries.where("type = 'symbol'")))


def cite(hits: DataFrame, entries: DataFrame, links: DataFrame) -> DataFrame:
    """Hits with title, source `path:line`, summary and, for documents, up to five linked symbols."""
    symbols = entries.where("type = 'symbol'").select(F.col("id").alias("symbol_id"), F.concat("title", F.lit(" @ "), "source_path", F.lit(":"), F.col("source_line").cast("string")).alias("label"))
    wanted = links.join(hits.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    named = wanted.join(symbols, "symbol_id", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("symbol_id", F.coalesce("label", "symbol_id").alias("label")))).alias("l"))
    refs = named.select(F.col("doc_id").alias("id"), F.transform(F.slice("l", 1, 5), lambda x: x["label"]).alias("refs"))
    shown = entries.select("id", "type", "title", "summary", F.when(F.col("source_line").isNotNull(), F.concat("source_path", F.lit(":"), F.col("source_line").cast("string"))).otherwise(F.col("source_path")).alias("source"))
    return hits.join(shown, "id").join(refs, "id", "left").withColumn("refs", F.when(F.col("type") == "doc", F.col("refs")))


def block(hits: DataFrame):
    """The text of a cited hit: its title and score, source, summary and, after a blank line, its references."""
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("\n\n- references: "), F.array_join("refs", "; "))).otherwise("")
    return F.concat(F.lit("### "), "title", F.lit(" (score: "), F.col("rel_score").cast("string"), F.lit(")\n- source: "), "source", F.lit("\n- "), F.coalesce("summary", F.lit("")), refs)


def section(hits: DataFrame, text, heading: str, name: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, name): a heading and the texts of a query's hits by rank, at most twenty."""
    rows = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("b")))).alias("b"))
    return rows.select(*keys, F.concat(F.lit(heading + "\n\n"), F.array_join(F.transform("b", lambda x: x["b"]), "\n\n")).alias(name))


def miss(text) -> Column:
    """What is said to a query that nothing matches."""
    return F.concat(F.lit('No memory matches for "'), F.coalesce(text, F.lit("")), F.lit('".'))


def render(queries: DataFrame, cited: DataFrame, limit: int = 8000) -> DataFrame:
    """(query_id, answer): a heading and one block a hit, or a note that nothing matches; cut at `limit` characters."""
    answers = section(cited, block(cited), "## Memory (docs + symbols)", "a")
    return queries.join(answers, "query_id", "left").select("query_id", truncate(F.coalesce("a", miss(F.col("text"))), limit).alias("answer"))
