"""The inverted index of a memory's entries, kept on disk and brought up to date by what a run touches.

Each commit that changes entries adds one segment: postings of new entries sorted by term, tombstones of files whose
earlier postings count no more, and signed changes of the counts of each term. Small segments are merged on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.functions.text import entry_text, tokens
from corpusmem.operators import rank
from corpusmem.plans.scratch import stored

SCHEMAS = {
    "postings": "term string, project string, type string, path string, id string, len long, tf long, version long",
    "tombstones": "project string, path string, version long",
    "frequencies": "term string, project string, type string, df long, total long",
}
FILE = ["project", "path"]
ENTRY = ["project", "type", "path", "id"]
COUNTED = ["term", "project", "type"]
#: A segment is merged with the newer ones once it isn't larger than so many times all of them together.
GROWTH = 2
#: Asked terms up to which they are written into the scan's filter, which skips row groups of other terms.
PUSHED = 256


def posted(entries: DataFrame) -> DataFrame:
    """(term, project, type, path, id, len, tf) of entries; the empty term, with tf 0, stands once for every entry.

    Tokens are counted within their entry, as runs of the sorted ones, so nothing is shuffled. Sorted tokens and the
    places where a run starts are columns of their own, so that nothing is made twice.
    """
    bag = entries.select(*ENTRY, F.sort_array(F.concat(F.array(F.lit("")), tokens(entry_text()))).alias("__t"))
    starts = F.array_compact(F.transform("__t", lambda t, i: F.when((i == 0) | (t != F.get("__t", i - 1)), i)))
    bag = bag.select(*ENTRY, "__t", starts.alias("__at"))
    tf = lambda at, k: F.when(at > 0, F.coalesce(F.get("__at", k + 1), F.size("__t")) - at).otherwise(0).cast("long")
    runs = F.transform("__at", lambda at, k: F.struct(F.get("__t", at).alias("term"), tf(at, k).alias("tf")))
    # an outer generator: for an inner one Spark infers a filter, and tokenises twice
    every = bag.select(*ENTRY, (F.size("__t") - 1).cast("long").alias("len"), F.explode_outer(runs).alias("p"))
    return every.select("p.term", *ENTRY, "len", "p.tf")


def counted(rows: DataFrame, sign: int = 1) -> DataFrame:
    """(term, project, type, df, total): entries with a term and their tokens, with a sign; of the empty term, all entries."""
    return rows.groupBy(*COUNTED).agg((sign * F.count("*")).alias("df"), (sign * F.sum("len")).alias("total"))


def summed(counts: DataFrame) -> DataFrame:
    """Signed counts added up; those that change nothing go. An entry that changes keeps df and may change the total."""
    return counts.groupBy(*COUNTED).agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df <> 0 or total <> 0")


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Postings that count: those whose file has no tombstone of a later version."""
    dead = tombstones.groupBy(*FILE).agg(F.max("version").alias("dead"))
    return rows.join(dead, FILE, "left").where("dead is null or version >= dead").drop("dead")


def to_merge(sizes: dict[int, int]) -> list[int]:
    """The newest segments that should become one: each next older one isn't larger than GROWTH times those together.

    What is left grows by that factor from segment to segment, so there are about log(size) of them and a posting is
    rewritten as often. sizes: bytes by segment number.
    """
    out, together = [], 0
    for n in sorted(sizes, reverse=True):
        if out and sizes[n] > GROWTH * together:
            break
        out.append(n)
        together += sizes[n]
    return out if len(out) > 1 else []


def update(store, fresh: DataFrame, removed: DataFrame, touched: DataFrame) -> None:
    """Puts the segment of a run: fresh and removed entries, and the touched files (project, path) the memory had before.

    Only these entries are tokenised. A segment's number is its version; merged segments go with the same commit.
    """
    number, sizes = store.version() + 1, store.segments()
    merged = to_merge(sizes)
    older = lambda name: store.table(name, merged)
    new, gone = stored(posted(fresh)), touched.select(FILE).distinct().withColumn("version", F.lit(number).cast("long"))
    rows, counts = new.withColumn("version", F.lit(number).cast("long")), counted(new).unionByName(counted(posted(removed), -1))
    if merged:
        every = store.table("tombstones").unionByName(gone)
        rows, counts = rows.unionByName(live(older("postings"), every)), counts.unionByName(older("frequencies"))
        gone = older("tombstones").unionByName(gone).groupBy(*FILE).agg(F.max("version").alias("version"))
        if len(merged) == len(sizes):
            gone = gone.limit(0)  # no older segment is left that they could hide
    for name, table in (("postings", rows), ("tombstones", gone), ("frequencies", summed(counts))):
        store.put(name, table, [number, *merged])


def rebuild(store) -> None:
    """Puts the index anew from all entries, as one segment; commit() makes it visible."""
    number, before = store.version() + 1, list(store.segments())
    new = stored(posted(store.table("entries")))
    for name, table in (("postings", new.withColumn("version", F.lit(number).cast("long"))), ("tombstones", None), ("frequencies", counted(new))):
        store.put(name, store.table(name).limit(0) if table is None else table, [number, *before])


def asked(store, terms: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Stored postings (pool, id, len, term, tf) of asked terms (pool, term, ...), and their statistics as of term_stats.

    pool is the project; id names an entry in all projects, see ident. Nothing is tokenised: postings of these terms are
    read, counts are sums of signed ones, and the bounds are those of the postings read.
    """
    wanted = terms.select(F.col("pool").alias("project"), "term").distinct()
    few, words = wanted.count() <= rank.BROADCAST_TERMS, [r[0] for r in terms.select("term").distinct().limit(PUSHED + 1).collect()]
    of = lambda name: store.table(name).where(F.col("type").isin(*kinds))
    near = lambda df, more: df.where(F.col("term").isin(*words, *more)) if len(words) <= PUSHED else df
    hint = F.broadcast if few else (lambda df: df)
    found = live(near(of("postings"), []).where("term <> ''").join(hint(wanted), ["project", "term"], "left_semi"), store.table("tombstones"))
    found = stored(found.select(F.col("project").alias("pool"), ident("id", "path").alias("id"), "len", "term", "tf").sortWithinPartitions("term"))
    every = wanted.select("project").distinct().withColumn("term", F.lit(""))
    counts = near(of("frequencies"), [""]).join(hint(wanted.unionByName(every)), ["project", "term"], "left_semi")
    counts = counts.groupBy(F.col("project").alias("pool"), "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df > 0")
    bounds = found.groupBy("pool", "term").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
    return found, counts.join(bounds, ["pool", "term"], "left")


def ident(own, path):
    """The name of an entry among those of all projects; it sorts as the entry's id does within a project."""
    return F.concat("project", F.lit("\n"), own, F.lit("\n"), path)


def search(store, queries: DataFrame, kinds: tuple[str, ...], limit: int = 8) -> DataFrame:
    """rank.search for queries (query_id, variant, text, pool) over the stored index instead of texts."""
    terms = stored(rank.query_terms(queries, ("query_id", "variant", "pool")))
    found, stats = asked(store, terms, kinds)
    return rank.top_k(rank.merge_variants(rank.best_scores(terms, found, rank.clamp_limit(limit), stats)), limit)
