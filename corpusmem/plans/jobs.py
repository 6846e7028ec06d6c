"""Whole jobs over a stored memory: index a listing, index single documents, refresh by poll or by path, answer queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmem.config import Config
from corpusmem.functions.text import note_text, truncate
from corpusmem.operators import links, models, notes, rank
from corpusmem.plans import index, postings
from corpusmem.plans.scratch import remove, stored
from corpusmem.streaming import observe

SCHEMAS = {
    "manifest": "project string, path string, sha256 string, size long, kind string, indexed_at timestamp",
    "entries": "project string, path string, seq long, id string, type string, title string, summary string, keywords array<string>, source_path string, source_line int, text string",
    "links": "project string, path string, doc_id string, symbol_path string, symbol_id string",
    "notes": notes.SCHEMA,
    "snapshot": "project string, path string, mtime double, size long",
    "roots": "project string, root string",
    "answers": "key string, answer string",
    "waiting": "project string, path string",
    "plan": "project string, path string, kind string, status string, sha256 string, size long",
} | postings.SCHEMAS
COMMITS = "name string, bucket int, dir string"
FILE = ["project", "path"]
#: Tables that are kept in buckets by project and path; of the others, each version is whole, but for segments.
BY_PATH = ("manifest", "entries", "links", "snapshot", "waiting")
#: Tables in segments: what a version puts is one more bucket, numbered by the version and sorted by the first column.
SEGMENTED = (*postings.SCHEMAS, "answers")


class MemoryStore:
    """Versioned Parquet tables below one shared path, with one writer at a time.

    Tables of files are kept in buckets by project and path. A version writes only the buckets it touches, below a folder
    of its own; the commit names, for each table and bucket, the folder that counts. A commit shows once its file is
    whole, so a job that is lost before that changes nothing and may simply run again, and readers of older versions are
    not disturbed until vacuum() removes what they read. buckets: fixed for a store; so many that one is quickly
    written. Commits have tables x buckets rows, whatever the tables hold.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.made: dict[str, tuple[str, dict[int, bool]]] = {}

    def _list(self, below: str) -> list[str]:
        """Names in a folder of the store; none if it isn't there."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self) -> list[int]:
        """Committed versions, oldest first; a commit that was lost while it was written has no _SUCCESS."""
        return sorted(int(v[2:]) for v in self._list("commits") if v.startswith("v=") and "_SUCCESS" in self._list(f"commits/{v}"))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _dirs(self, version: int) -> dict[tuple[str, int], str]:
        if not version:
            return {}
        return {(r["name"], r["bucket"]): r["dir"] for r in self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits/v={version}").collect()}

    def bucket(self) -> Column:
        """The bucket of a row with a project and a path."""
        return F.pmod(F.xxhash64(*FILE), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # `buckets` numbers at most

    def _read(self, name: str, dirs: dict[int, str], buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.path}/{d}" for b, d in sorted(dirs.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The last committed version of a table, or some of its buckets; empty before the first."""
        return self._read(name, {b: d for (n, b), d in self._dirs(self.version()).items() if n == name}, buckets)

    def coming(self, name: str) -> DataFrame:
        """The table as it will be once what has been put is committed."""
        return self._read(name, {b: d for (n, b), d in self._next().items() if n == name}, None)

    def _next(self) -> dict[tuple[str, int], str]:
        dirs = self._dirs(self.version())
        for name, (to, written) in self.made.items():
            for b, there in written.items():
                dirs.pop((name, b), None)
                if there:
                    dirs[name, b] = f"{to}/bucket={b}"
        return dirs

    def put(self, name: str, rows: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Writes the next version of a table's buckets (all: None) and returns it as stored; commit() makes it visible.

        rows are all that these buckets hold from then on; a bucket without rows goes. Of a table in segments, rows are the
        new segment, and buckets are its number with those of the segments it replaces.
        """
        kinds = StructType.fromDDL(SCHEMAS[name])
        to = f"{name}/v={self.version() + 1}"
        own = self.bucket() if name in BY_PATH else F.lit(self.version() + 1 if name in SEGMENTED else 0)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds], own.alias("bucket"))
        if name in SEGMENTED:
            # ranges of whole rows: a common term is spread over files, and each file holds a range of terms
            rows = rows.repartitionByRange(*kinds.names).sortWithinPartitions(*kinds.names)
        else:
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *([*FILE] if name in BY_PATH else ["project"]))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{to}")
        there = {int(d[7:]) for d in self._list(to) if d.startswith("bucket=")}
        every = (range(self.buckets) if name in BY_PATH else [0]) if buckets is None else buckets
        self.made[name] = to, {b: b in there for b in every}
        return self._read(name, {b: f"{to}/bucket={b}" for b in there}, None)

    def segments(self, names: tuple[str, ...] = tuple(postings.SCHEMAS)) -> dict[int, int]:
        """Bytes of committed segments by their number, those of the index if no others are named."""
        out: dict[int, int] = {}
        for (name, number), d in self._dirs(self.version()).items():
            if name in names:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{d}")
                out[number] = out.get(number, 0) + at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
        return out

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that was committed, -1 before the first."""
        return int(self._dirs(self.version()).get((f"stream {stream}", 0), -1))

    def commit(self, batch: tuple[str, int] | None = None) -> int:
        """Makes all that was put since the last commit visible at once; batch: the stream and batch that it came from."""
        version = self.version() + 1
        rows = self._next() | ({(f"stream {batch[0]}", 0): str(batch[1])} if batch else {})
        rows = [(name, b, d) for (name, b), d in rows.items()]
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/v={version}")
        self.made = {}
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Removes folders that none of the last `keep` versions reads, and older commits; returns how many folders."""
        versions = self._versions()
        used = {d for v in versions[-keep:] for d in self._dirs(v).values()}
        gone = [f"commits/v={v}" for v in versions[:-keep]]
        for name in SCHEMAS:
            for v in (x for x in self._list(name) if x.startswith("v=") and int(x[2:]) <= self.version()):  # later ones are being written
                gone += [d for b in self._list(f"{name}/{v}") if b.startswith("bucket=") and (d := f"{name}/{v}/{b}") not in used]
        for d in gone:
            remove(self.spark, f"{self.path}/{d}")
        return len(gone)


def totals(store: MemoryStore) -> DataFrame:
    """(project, files, entries, notes, indexed_at, links) of the stored memory."""
    linked = store.table("links").groupBy("project").agg(F.count("*").alias("links"))
    rows = index.inventory(store.table("manifest"), store.table("entries"), store.table("notes"))
    return rows.join(linked, "project", "left").withColumn("links", F.coalesce("links", F.lit(0)))


Model = Callable[[list[str]], list[str | None]]


def _answered(store: MemoryStore, fresh: DataFrame, touched: DataFrame, buckets: list[int], model: Model | None, version: str) -> DataFrame:
    """fresh entries with a model's titles, summaries and keywords, without a model as they are.

    Answers are kept by the content of the chunk and the prompt's version: a chunk that any file ever had is not asked
    about again, equal chunks are asked about once. A failed answer isn't kept: the entry stays extractive, and its file
    waits, to be taken up by the next run over its project.
    """
    late = touched.select(FILE).limit(0)
    if model is not None:
        keyed = stored(fresh.withColumn("key", F.when(F.col("type") == "doc", models.answer_key(version, F.col("text")))))
        wanted = keyed.where("key is not null").groupBy("key").agg(F.first("text").alias("text"))
        known = store.table("answers").join(wanted.select("key"), "key", "left_semi")
        todo = wanted.join(known.select("key"), "key", "left_anti")
        got = stored(models.ask(todo.select(F.col("key").alias("id"), "text"), model).where(models.usable(F.col("answer"))).select(F.col("id").alias("key"), "answer"))
        merged = postings.to_merge(store.segments(("answers",)))
        if not got.isEmpty():
            store.put("answers", got.unionByName(store.table("answers", merged)), [store.version() + 1, *merged])
        every = stored(known.unionByName(got))
        late = keyed.where("key is not null").join(every, "key", "left_anti").select(FILE).distinct()
        own = [c for c in fresh.columns if c != "id"]
        with_key = keyed.withColumn("own", F.col("id")).withColumn("id", F.col("key")).drop("key")
        fresh = models.entries_with_answers(with_key, every.withColumnRenamed("key", "id")).select(*own, F.col("own").alias("id"))
    waiting = store.table("waiting", buckets)
    if model is not None or not waiting.isEmpty():
        store.put("waiting", waiting.join(touched.select(FILE).distinct(), FILE, "left_anti").unionByName(late), buckets)
    return fresh


def _apply(store: MemoryStore, plan: DataFrame, texts: DataFrame, now, config: Config, model: Model | None = None) -> None:
    """Carries out a stored plan: entries of touched files are replaced, files outside the plan stay, links and the index
    are brought up to date. Only buckets of touched files are read and written, and those in which a link changes."""
    touched = plan.where(~F.col("status").isin(*index.KEEP))
    buckets = store.buckets_of(touched)
    if not buckets:
        return
    todo = plan.where(F.col("status").isin("new", "changed")).select(*FILE, "kind")
    fresh = _answered(store, index.extract(texts.select(*FILE, "text").join(todo, FILE), config), touched, buckets, model, config.prompt_version)
    stored_ = store.put("entries", index.upsert(store.table("entries", buckets), fresh, touched), buckets)
    _relink(store, touched, stored_.join(todo.select(FILE), FILE, "left_semi"), buckets)
    own, manifest = plan.where(store.bucket().isin(buckets)), store.table("manifest", buckets)
    had = touched.join(manifest.select(FILE), FILE, "left_semi")
    removed = store.table("entries", buckets).join(had.select(FILE), FILE, "left_semi")
    postings.update(store, stored_.join(todo.select(FILE), FILE, "left_semi"), removed, had)
    outside = manifest.join(own.select(FILE), FILE, "left_anti")
    store.put("manifest", outside.unionByName(index.next_manifest(own, manifest, now)), buckets)


def _relink(store: MemoryStore, touched: DataFrame, fresh: DataFrame, buckets: list[int]) -> None:
    """Links of touched files go, new documents meet all names of their projects, and old documents new names."""
    projects = touched.select("project").distinct()
    entries = store.coming("entries").join(projects, "project", "left_semi")
    symbols = fresh.where("type = 'symbol'")
    older = entries.where("type = 'doc'").join(touched.select(FILE).distinct(), FILE, "left_anti")
    found = lambda docs, names: links.links(docs, names, keys=("project",), ident=("path", "id")).withColumnRenamed("doc_path", "path")
    added = found(fresh.where("type = 'doc'"), entries)
    before = store.table("links")
    code = touched.where("kind = 'code'").select("project", F.col("path").alias("symbol_path")).distinct()
    if not code.isEmpty():
        added = added.unionByName(found(older, symbols))
        buckets = sorted({*buckets, *store.buckets_of(before.join(code, ["project", "symbol_path"], "left_semi"))})
    added = stored(added)
    buckets = sorted({*buckets, *store.buckets_of(added)})
    stay = store.table("links", buckets).join(touched.select(FILE).distinct(), FILE, "left_anti").join(code, ["project", "symbol_path"], "left_anti")
    store.put("links", stay.unionByName(added), buckets)


def index_listing(store: MemoryStore, listing: DataFrame, now, config: Config = Config(), reindex: bool = False, pages: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """Indexes whole projects and returns the report of each: counts of the run and totals of the memory.

    listing: (project, path, sha256, size, text[, failed]), all files of its projects; what else those projects have in
    the memory is removed, other projects stay. Running it twice changes nothing the second time. pages: (project, path,
    page, text) of files that come as pages, such as .pdf; without pages such a file fails and is tried again.
    model: gives answers to batches of chunk texts, which take the place of extractive titles and summaries; see
    _answered. With a model, files some answer of which failed count as changed, and only what is missing is asked again.
    """
    listing = index.with_pages(listing, pages, config.max_pages)
    mine = store.table("manifest").join(listing.select("project").distinct(), "project", "left_semi")
    if model is not None:
        late = store.table("waiting").withColumn("late", F.lit(True))
        mine = mine.join(late, FILE, "left").withColumn("sha256", F.when(F.col("late"), "").otherwise(F.col("sha256"))).drop("late")
    plan = store.put("plan", index.change_plan(listing, mine, config.max_file_mb, reindex))
    _apply(store, plan, listing, now, config, model)
    store.commit()
    return index.report(plan).join(totals(store), "project", "left")


def index_documents(store: MemoryStore, listing: DataFrame, paths: DataFrame, now, config: Config = Config()) -> DataFrame:
    """Indexes requested files only, and returns (project, path, status, n_entries, preview): a line for each entry.

    paths: (project, path). Files that aren't in the listing are left as they are.
    """
    asked = listing.join(paths.select(FILE).distinct(), FILE, "left_semi")
    plan = store.put("plan", index.change_plan(asked, store.table("manifest").join(asked.select(FILE), FILE, "left_semi"), config.max_file_mb))
    _apply(store, plan, asked, now, config)
    store.commit()
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" @ "), "path", F.lit(":"), F.col("source_line").cast("string"))
    found = store.table("entries").join(plan.select(FILE), FILE, "left_semi").groupBy(FILE).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    shown = F.when(F.col("status").isin("new", "changed"), F.transform("l", lambda x: x["line"]))
    return plan.join(found, FILE, "left").select(*FILE, "status", F.greatest(F.size("l"), F.lit(0)).alias("n_entries"), shown.alias("preview"))


def _refresh(store: MemoryStore, look: DataFrame, gone: DataFrame, read: Callable[[DataFrame], DataFrame], now, config: Config) -> DataFrame:
    """Reads the files to look at, plans them and those that are gone, and carries the plan out; not committed yet."""
    known = index.with_pages(read(look), None, config.max_pages)
    failed = F.coalesce("failed", F.lit(False)) if "failed" in known.columns else F.lit(False)
    found = look.select(FILE).join(known.select(*FILE, "sha256", F.col("size"), "text", failed.alias("failed")), FILE, "left")
    found = found.withColumn("failed", F.coalesce("failed", F.lit(True)))  # listed, but not readable
    affected = look.select(FILE).union(gone.select(FILE)).distinct()
    plan = store.put("plan", index.change_plan(found, store.table("manifest").join(affected, FILE, "left_semi"), config.max_file_mb))
    _apply(store, plan, found, now, config)
    return plan


def poll(store: MemoryStore, listing: DataFrame, read: Callable[[DataFrame], DataFrame], now, config: Config = Config()) -> DataFrame:
    """One polled refresh; returns its plan: only files whose time or size differs from the snapshot are read.

    listing: (project, path, mtime, size), all files of the watched projects; read gives (project, path, sha256, size,
    text[, failed]) of some of them. What is gone is removed; failed files keep their entries and are tried again.
    """
    listing = listing.withColumn("mtime", F.col("mtime").cast("double")).withColumn("size", F.col("size").cast("long"))
    mine = store.table("snapshot").join(listing.select("project").distinct(), "project", "left_semi")
    look, gone = observe.to_hash(listing, mine), observe.vanished(listing, mine)
    plan = _refresh(store, look, gone, read, now, config)
    buckets = store.buckets_of(look.select(FILE).union(gone.select(FILE)))
    if buckets:
        others = store.table("snapshot", buckets).join(listing.select("project").distinct(), "project", "left_anti")
        fresh = observe.next_snapshot(listing.where(store.bucket().isin(buckets)), plan)
        store.put("snapshot", others.unionByName(fresh), buckets)
    store.commit()
    return plan


def refresh_paths(store: MemoryStore, paths: DataFrame, read: Callable[[DataFrame], DataFrame], now, config: Config = Config()) -> DataFrame:
    """Refreshes observed paths (project, path) and returns the plan: the step that observe.index_on_read calls.

    Unchanged files cost a read and a hash; a batch that is seen again changes nothing.
    """
    look = paths.select(FILE).distinct()
    plan = _refresh(store, look, look.limit(0), read, now, config)
    store.commit()
    return plan


def watch(store: MemoryStore, roots: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Adds watched roots (project, root) to the memory and removes those of gone (root); returns the roots kept.

    They are a table of the memory, so a stream or a poll that starts anew finds them. A root has one project, the new one.
    """
    stay = store.table("roots").join(roots.select("root"), "root", "left_anti")
    every = stay.select("project", "root").unionByName(roots.groupBy("root").agg(F.min("project").alias("project")))
    kept = store.put("roots", every if gone is None else every.join(gone.select("root").distinct(), "root", "left_anti"))
    store.commit()
    return kept


def observed_batch(store: MemoryStore, batch: DataFrame, batch_id: int, read: Callable[[DataFrame], DataFrame], now, name: str = "reads", config: Config = Config()) -> bool:
    """One batch of observations (path, observed_at, ...): watched files are planned, extracted, replaced and relinked.

    The commit carries the batch's number, so a batch that is seen again writes nothing (False). What a batch wrote
    before it was lost is written again below the same version and never read. Paths outside all roots are left out.
    """
    store = MemoryStore(batch.sparkSession, store.path, store.buckets)  # without what a lost batch has put
    if store.last_batch(name) >= batch_id:
        return False
    paths = observe.in_roots(observe.coalesce_burst(batch), store.table("roots"))
    look = stored(paths.select(*FILE).distinct())
    _refresh(store, look, look.limit(0), read, now, config)
    store.commit((name, batch_id))
    return True


def read_time_index(
    store: MemoryStore, events: DataFrame, read: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "reads", config: Config = Config(), interval: str = "300 milliseconds", once: bool = False,
):
    """Starts the read-time index over a stream of events (path, kind, sha, observed_at, seq) below the watched roots.

    Observed contents that equal the last one of their path stop at the gate; the others become batches of observed_batch.
    read gives (project, path, sha256, size, text[, failed]) of files (project, path), paths relative to their root. A
    stream started again with its checkpoint and name goes on where it was.
    """
    fresh = observe.gate(observe.observed(events).select("path", "sha", "observed_at", "seq"))
    each = lambda batch, number: observed_batch(store, batch, number, read, datetime.now(timezone.utc).replace(tzinfo=None), name, config) and None
    writer = fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def answers(
    store: MemoryStore, queries: DataFrame, project: str | None = None, layer: str = "all", limit: int = 8, config: Config = Config(), expansions: DataFrame | None = None,
) -> DataFrame:
    """(query_id, answer) over the entries and notes of each query's project, all in one job.

    Entries are found by the stored index, so none is tokenised; notes, which are few, are searched as texts.

    queries: (query_id, variant, text[, project]); project is asked by all, if they name none. layer: all, doc, symbol, or
    experience for notes alone. Entries come first, then past problems with their solutions. A query that nothing
    matches is told what its project holds. expansions: a model's answers (query_id, answer) with variants of the
    queries, used if config.expand_queries.
    """
    if "project" not in queries.columns:
        queries = queries.withColumn("project", F.lit(project))
    if config.expand_queries and expansions is not None:
        first = queries.where("variant = 0")
        queries = models.expand(first.select("query_id", "text"), expansions, config.expansion_count).join(first.select("query_id", "project"), "query_id")
    asked = queries.groupBy("query_id", "project").agg(F.min_by("text", "variant").alias("text"))
    parts, projects = asked.select("query_id"), asked.select("project").distinct()
    own = lambda name: store.table(name).join(projects, "project", "left_semi")
    # ids are told apart by project and file while all projects are searched at once
    pooled = queries.withColumnRenamed("project", "pool")
    if layer != "experience":
        kinds = ("doc", "symbol") if layer == "all" else (layer,)
        entries = own("entries").withColumn("id", postings.ident("id", "path"))
        hits = stored(postings.search(store, pooled.select("query_id", "variant", "text", "pool"), kinds, limit))
        cited = rank.cite(hits, entries, own("links").select(postings.ident("doc_id", "path").alias("doc_id"), postings.ident("symbol_id", "symbol_path").alias("symbol_id")))
        parts = parts.join(rank.section(cited, rank.block(cited), f"## Memory ({'docs + symbols' if layer == 'all' else layer})", "entries"), "query_id", "left")
    if layer in ("all", "experience"):
        pool = own("notes").withColumn("pool", F.col("project")).withColumn("own_id", F.col("id")).withColumn("id", F.concat("project", F.lit("\n"), "id"))
        told = rank.search(pooled, pool, note_text(), limit).join(pool.drop("pool"), "id")
        source = F.when(F.coalesce("source_file", F.lit("")) != "", F.concat(F.lit(" (source: "), "source_file", F.lit(")"))).otherwise("")
        block = F.concat(F.lit("### Problem: "), F.coalesce("problem", F.lit("")), F.lit(" (score: "), F.col("rel_score").cast("string"), F.lit(", id: "), "own_id", F.lit(")\n- solution: "), F.coalesce("solution", F.lit("")), source, F.lit("\n- updated: "), F.coalesce(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")))
        parts = parts.join(rank.section(told, block, "## Experience (past problems -> solutions)", "notes"), "query_id", "left")
    sections = F.concat_ws("\n\n", *[c for c in ("entries", "notes") if c in parts.columns])
    stock = totals(store).select("project", F.concat(F.lit("\nThe memory of "), "project", F.lit(" holds "), *[x for c in ("files", "entries", "notes") for x in (F.col(c).cast("string"), F.lit(f" {c}" + ("." if c == "notes" else ", ")))]).alias("stock"))
    none = F.concat(F.lit('No memory matches for "'), F.coalesce("text", F.lit("")), F.lit('" in '), "project", F.lit("."), F.coalesce("stock", F.lit("")))
    out = asked.join(parts, "query_id").join(stock, "project", "left")
    return out.select("query_id", truncate(F.when(sections != "", sections).otherwise(none), config.max_output_chars).alias("answer"))


def remember(store: MemoryStore, new: DataFrame, now) -> DataFrame:
    """Adds notes (project, seq, problem, solution, source_file) in order, each seeing those before it, and returns the
    totals. A note that overlaps a stored one takes its place; projects keep twice as many notes as files, within bounds."""
    at = F.lit(now).cast("timestamp")
    kept, projects = store.table("notes"), new.select("project").distinct()
    last = kept.join(projects, "project", "left_semi").groupBy("project").agg(F.max("seq").alias("last"))
    rows = new.join(last, "project", "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(0)))
    rows = rows.select("project", notes.note_id().alias("id"), "seq", "problem", "solution", "source_file", at.alias("created_at"), at.alias("updated_at"))
    files_ = store.table("manifest").groupBy("project").agg(F.count("*").cast("int").alias("n_files"))
    mine = notes.remember_in_order(kept.join(projects, "project", "left_semi"), rows, files_)
    store.put("notes", kept.join(projects, "project", "left_anti").unionByName(mine))
    store.commit()
    return totals(store)


def forget(store: MemoryStore, requests: DataFrame) -> DataFrame:
    """Removes the notes that requests (project, query) name, by id or by words, and returns (project, forgotten)."""
    kept = store.table("notes")
    left = store.put("notes", notes.forget(kept, requests))
    gone = kept.select("project", "id").join(left.select("project", "id"), ["project", "id"], "left_anti").groupBy("project").agg(F.count("*").alias("forgotten"))
    store.commit()
    return requests.select("project").distinct().join(gone, "project", "left").withColumn("forgotten", F.coalesce("forgotten", F.lit(0)))
