"""Incremental indexing: change plan, report, upserts, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.config import Config
from corpusmem.functions.text import mangled
from corpusmem.operators import chunk, links, symbols
from corpusmem.sources import files

KEEP = ("unchanged", "failed")


def change_plan(listing: DataFrame, manifest: DataFrame, max_mb: float = 50, reindex: bool = False) -> DataFrame:
    """(project, path, kind, status) of every listed file of a known kind and every manifest path not listed.

    listing: (project, path, sha256, size[, text, failed]); status is oversize, dump, failed, unchanged, changed, new or
    removed, in that precedence. One full outer join on (project, path).
    """
    optional = {"text": "string", "failed": "boolean"}
    seen = listing.withColumn("kind", files.kind(F.col("path"))).where("kind is not null")
    for c, t in optional.items():
        if c not in listing.columns:
            seen = seen.withColumn(c, F.lit(None).cast(t))
    # the text is looked at before the join, which would carry it
    dump = (F.col("kind") == "doc") & files.is_dump(F.coalesce("text", F.lit("")))
    seen = seen.select("project", "path", "kind", "sha256", "size", "failed", dump.alias("dump"))
    old = manifest.select("project", "path", F.col("sha256").alias("old_sha"), F.col("kind").alias("old_kind"))
    rows = seen.join(old, ["project", "path"], "full_outer")
    status = (
        F.when(F.col("kind").isNull(), "removed")
        .when(F.coalesce(files.oversize(F.col("size"), max_mb), F.lit(False)), "oversize")
        .when((F.col("sha256") == F.col("old_sha")) & F.lit(not reindex), "unchanged")
        .when(F.coalesce("failed", F.lit(False)), "failed")
        .when(F.col("dump"), "dump")
        .when(F.col("old_sha").isNull(), "new")
        .otherwise("changed")
    )
    return rows.select("project", "path", F.coalesce("kind", "old_kind").alias("kind"), status.alias("status"), "sha256", "size")


def with_pages(listing: DataFrame, pages: DataFrame | None, max_pages: int = 1000) -> DataFrame:
    """The listing with the texts of files that come as pages (.pdf): pages (project, path, page, text) assembled.

    Bytes of such a file are never taken for text. Without pages, or with more than max_pages, it has failed.
    """
    paged = files.is_paged(F.col("path"))
    if "failed" not in listing.columns:
        listing = listing.withColumn("failed", F.lit(False))
    if pages is None:
        text, out = F.lit(None).cast("string"), listing
    else:
        made = chunk.assemble_pages(pages, ("project", "path"), max_pages=max_pages)
        text, out = F.col("page_text"), listing.join(made.select("project", "path", F.col("text").alias("page_text")), ["project", "path"], "left")
    text = F.when(paged, text).otherwise(F.col("text"))
    failed = F.coalesce("failed", F.lit(False)) | (paged & text.isNull())
    return out.select(*[c for c in listing.columns if c not in ("text", "failed")], text.alias("text"), failed.alias("failed"))


def report(plan: DataFrame) -> DataFrame:
    """Counts of a run by project: documents and code indexed, skipped (unchanged, oversize, dumps), removed, failures."""
    done = F.col("status").isin("new", "changed")
    return plan.groupBy("project").agg(
        F.count_if(done & (F.col("kind") == "doc")).alias("docs"), F.count_if(done & (F.col("kind") == "code")).alias("code"),
        F.count_if(F.col("status").isin("unchanged", "oversize", "dump")).alias("skipped"), F.count_if(F.col("status") == "removed").alias("removed"),
        F.count_if(F.col("status") == "failed").alias("n_failed"), F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("path")))).alias("failed"),
    )


def upsert(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Entries with all those of touched (project, path) replaced by new ones; a path without new entries goes."""
    return old.join(touched.select("project", "path").distinct(), ["project", "path"], "left_anti").unionByName(new)


def next_manifest(plan: DataFrame, manifest: DataFrame, now) -> DataFrame:
    """The manifest after a run: new and changed files with their hash, unchanged and failed ones as they were."""
    done = plan.where(F.col("status").isin("new", "changed")).select("project", "path", "sha256", "size", "kind", F.lit(now).cast("timestamp").alias("indexed_at"))
    keep = plan.where(F.col("status").isin(*KEEP)).select("project", "path")
    return manifest.join(keep, ["project", "path"], "left_semi").select(done.columns).unionByName(done)


def extract(changed: DataFrame, config: Config = Config()) -> DataFrame:
    """Entries (project, path, seq, ...) of changed files (project, path, kind, text): chunks of documents, declarations
    of code. Files are told apart by project and path: both travel as one key, which is taken apart at the end."""
    keyed = changed.select(F.concat_ws("\n", "project", "path").alias("path"), "kind", "text")
    docs = chunk.doc_entries(chunk.chunks(keyed.where("kind = 'doc'"), config.chunk_chars, config.max_chunks))
    code = symbols.symbol_entries(keyed.where("kind = 'code'"))
    rows = docs.unionByName(code)
    own = F.split(F.col("path"), "\n")
    bare = lambda c: F.replace(F.col(c), F.concat(own[0], F.lit("\n")), F.lit(""))
    ident = F.concat(mangled(own[1]), F.lit("#"), F.col("seq").cast("string"))
    return rows.select(own[0].alias("project"), own[1].alias("path"), "seq", ident.alias("id"), "type", bare("title").alias("title"), bare("summary").alias("summary"), "keywords", own[1].alias("source_path"), "source_line", "text")


def inventory(manifest: DataFrame, entries: DataFrame, notes: DataFrame) -> DataFrame:
    """Files, entries, notes and the last indexing time of each project."""
    f = manifest.groupBy("project").agg(F.count("*").alias("files"), F.max("indexed_at").alias("indexed_at"))
    e = entries.groupBy("project").agg(F.count("*").alias("entries"))
    n = notes.groupBy("project").agg(F.count("*").alias("notes"))
    out = f.join(e, "project", "full_outer").join(n, "project", "full_outer")
    return out.select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "entries", "notes")], "indexed_at")


def flatten(entries: DataFrame, project: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All entries, of one project or some types if asked (pruned where the table is partitioned by them)."""
    rows = entries if project is None else entries.where(F.col("project") == project)
    return rows if kinds is None else rows.where(F.col("type").isin(*kinds))


def index_single(listing: DataFrame, manifest: DataFrame, paths: DataFrame, max_mb: float = 50) -> DataFrame:
    """The change plan of requested paths only; extensions that aren't known count as documents."""
    rows = listing.join(paths, "path", "left_semi")
    return change_plan(rows, manifest.join(paths, "path", "left_semi"), max_mb)


def relink(entries: DataFrame) -> DataFrame:
    """The links of all entries, as a table."""
    return links.links(entries)
