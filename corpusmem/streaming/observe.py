"""Keeping an index fresh: observation events, changed-content gates, polled refreshes, watched roots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def observed(events: DataFrame) -> DataFrame:
    """Events that a file is present, with a path."""
    return events.where((F.col("kind") == "present") & (F.coalesce("path", F.lit("")) != ""))


def coalesce_burst(batch: DataFrame) -> DataFrame:
    """One row for each path of a batch, the latest."""
    return batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "observed_at").alias("r")).select("path", "r.*")


def changed_content(events: DataFrame) -> DataFrame:
    """The gate over a finished table: an event passes if its hash differs from the one before it of the same path."""
    before = F.lag("sha").over(W.partitionBy("path").orderBy("observed_at", "seq"))
    return events.withColumn("before", before).where(~F.col("sha").eqNullSafe(F.col("before"))).drop("before")


class _Gate(StatefulProcessor):
    """Keeps the last hash of a path; state grows as the manifest does, one short value a path."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sha string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        table = pd.concat(list(rows)).sort_values(["observed_at", "seq"])
        kept = []
        for i, sha in enumerate(table["sha"]):
            if sha != last:
                kept.append(i)
                last = sha
        if last is not None:
            self.last.update((last,))
        yield table.iloc[kept]

    def close(self) -> None:
        pass


def gate(stream: DataFrame) -> DataFrame:
    """The same gate on a stream of (path, sha, observed_at, seq), with the last hash of each path as keyed state."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy("path").transformWithStateInPandas(_Gate(), outputStructType=schema, outputMode="append", timeMode="None")


def index_on_read(stream: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str, interval: str = "300 milliseconds", once: bool = False):
    """Starts the read-time index: each burst of observations becomes one batch, handed to `refresh` once a path.

    refresh runs the change plan, extraction, upsert and relink for the touched paths; being keyed by path and hash it
    may safely see a batch again after a failure.
    """
    writer = observed(stream).writeStream.foreachBatch(lambda batch, _: refresh(coalesce_burst(batch))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def in_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, root, path): observed paths below roots (project, root), relative to the nearest root above each.

    A path meets roots through its directories, in an equi-join.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = paths.select("path").distinct().where(F.instr("path", "/") > 0).select("path", F.explode(above).alias("root"))
    near = rows.join(roots, "root").groupBy("path").agg(F.max_by(F.struct("project", "root"), F.length("root")).alias("r"))
    return near.select("r.project", "r.root", F.expr("substring(path, length(r.root) + 2)").alias("path"))


def to_hash(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Listed files whose time or size differs from the snapshot; only these are read."""
    return listing.join(snapshot.select("project", "path", "mtime", "size"), ["project", "path", "mtime", "size"], "left_anti")


def vanished(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    return snapshot.select("project", "path").join(listing, ["project", "path"], "left_anti")


def next_snapshot(listing: DataFrame, statuses: DataFrame) -> DataFrame:
    """The snapshot after a refresh: failed paths lose their row, so that the next refresh tries them again."""
    failed = statuses.where("status = 'failed'").select("project", "path")
    return listing.join(failed, ["project", "path"], "left_anti").select("project", "path", "mtime", "size")


def add_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    return roots.select("root").union(more.select("root")).distinct()


def remove_roots(roots: DataFrame, gone: DataFrame) -> DataFrame:
    return roots.join(gone, "root", "left_anti")


def watched(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """The listing of watched roots."""
    return listing.join(roots.withColumnRenamed("root", "project"), "project", "left_semi")
