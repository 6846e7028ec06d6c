"""Upkeep of problem/solution notes: supersede, insert, prune, forget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmem.functions.text import token_set
from corpusmem.operators.links import distinct_sets, keyed_sets, met, partnered

SCHEMA = "project string, id string, seq long, problem string, solution string, source_file string, created_at timestamp, updated_at timestamp"
SUPERSEDE, FORGET = 0.6, 0.5
LEAST, MOST = 100, 2000


def _sets(rows: DataFrame, text) -> DataFrame:
    return rows.select("project", "id", "seq", token_set(text).alias("tokens"))


def note_id():
    """The id of a new note, of its project, number and problem."""
    return F.sha2(F.concat_ws("|", "project", F.col("seq").cast("string"), "problem").cast("binary"), 256)


def remember(notes: DataFrame, new: DataFrame) -> DataFrame:
    """One batch against the stored notes: a new note supersedes its best overlapping note, else is inserted.

    A superseded note keeps its id and creation time; its source only changes to a given one. When several new notes hit
    one stored note the last by seq stays. New notes do not see each other (see remember_in_order).
    """
    new = new.withColumn("id", note_id())
    hit = partnered(_sets(new, F.col("problem")), _sets(notes, F.col("problem")), SUPERSEDE).withColumnRenamed("partner", "old")
    # which new note stays is decided without texts; these are then sent once to their hit and once to the stored note's place
    last = W.partitionBy("project", "old").orderBy(F.col("seq").desc(), "id")
    hit = hit.select("project", "id", "old", F.row_number().over(last).alias("r"))
    given = new.join(hit, ["project", "id"], "left").where("old is null or r = 1").drop("r")
    placed = lambda df, place, added: df.withColumns({"place": place, "added": added})
    both = placed(notes.withColumn("old", F.lit(None).cast("string")), F.col("id"), F.lit(False)).unionByName(placed(given, F.coalesce("old", "id"), F.col("old").isNull()))
    update = F.when(F.col("old").isNotNull(), F.struct("problem", "solution", "source_file", "updated_at"))
    both = both.withColumn("u", F.max(update).over(W.partitionBy("project", "place", "added"))).where("old is null")
    after = {c: F.coalesce(F.col("u")[c], c) for c in ("problem", "source_file", "updated_at")} | {"solution": F.when(F.col("u").isNull(), F.col("solution")).otherwise(F.col("u.solution"))}
    return both.select([after.get(c, F.col(c)).alias(c) for c in ("project", "id", "seq", "problem", "solution", "source_file", "created_at", "updated_at")])


def prune(notes: DataFrame, files: DataFrame) -> DataFrame:
    """The latest notes of each project, twice its files, between 100 and 2000. files: (project, n_files)."""
    latest = W.partitionBy("project").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    cap = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), 2 * F.coalesce("n_files", F.lit(0))))
    rows = notes.join(files, "project", "left").withColumn("nth", F.row_number().over(latest))
    return rows.where(F.col("nth") <= cap).select(notes.columns)


def _set(text: str | None) -> frozenset[str]:
    low = (text or "").lower()
    out = re.findall("[a-z0-9_]+", low)
    for run in re.findall("[㐀-鿿豈-﫿぀-ヿ가-힯]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return frozenset(out)


def fold(stored: list[dict], new: list[dict], n_files: int) -> list[dict]:
    """Adds new notes in order, each seeing the effect of those before; prunes after inserts."""
    cap = max(LEAST, min(MOST, 2 * n_files))
    notes = [dict(x) | {"tokens": x.get("tokens") or _set(x["problem"])} for x in stored]
    for x in new:
        own, best, most = _set(x["problem"]), None, 0
        for old in notes if own else ():
            both, base = len(own & old["tokens"]), min(len(own), len(old["tokens"]))
            if base and both / base >= SUPERSEDE and both > most:
                best, most = old, both
        if best is not None:
            best |= {"problem": x["problem"], "solution": x["solution"], "updated_at": x["updated_at"], "tokens": own}
            if x["source_file"]:
                best["source_file"] = x["source_file"]
            continue
        notes.append(dict(x) | {"tokens": own})
        if len(notes) > cap:
            notes.sort(key=lambda n: (n["updated_at"], n["seq"]))
            notes = sorted(notes[len(notes) - cap :], key=lambda n: n["seq"])
    return notes


def remember_in_order(notes: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """New notes of each project added one after the other by seq. A project's state is at most 2000 notes.

    Notes come sorted by project, stored ones first, in Arrow batches; only the state is carried from batch to batch.
    """
    both = notes.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))).join(files, "project", "left")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = lambda state: pd.DataFrame([[n[c] for c in names] for n in state], columns=names)
        project, state = None, []
        for table in tables:
            rows = table.astype(object).where(lambda t: t.notna(), None).to_dict("records")
            for key, own in groupby(rows, lambda r: r["project"]):
                if key != project and state:
                    yield out(state)
                    state = []
                project, own = key, list(own)
                state = fold(state + [r for r in own if not r["fresh"]], [r for r in own if r["fresh"]], int(own[0]["n_files"] or 0))
        if state:
            yield out(state)

    return both.repartition("project").sortWithinPartitions("project", "fresh", "seq").mapInPandas(run, SCHEMA)


_FIELDS = ("seq", "problem", "solution", "source_file", "created_at", "updated_at")


class _Fold(StatefulProcessor):
    """Keeps a project's notes by id with their tokens, at most MOST; times are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("notes", "id string", "seq long, problem string, solution string, source_file string, created_at long, updated_at long, tokens string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows)).sort_values("seq", kind="stable").astype(object)
        new = table.where(table.notna(), None).to_dict("records")
        before = {k[0]: dict(zip((*_FIELDS, "tokens"), v, strict=True)) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        stored = [n | {"id": i, "tokens": frozenset(n["tokens"].split())} for i, n in before.items()]
        after = {n["id"]: n for n in fold(sorted(stored, key=lambda n: n["seq"]), new, int(new[-1]["n_files"] or 0))}
        changed = []
        for i, n in after.items():
            value = tuple(n[c] for c in _FIELDS)
            if i not in before or value != tuple(before[i][c] for c in _FIELDS):
                self.kept.updateValue((i,), (*value, " ".join(sorted(n["tokens"]))))
                changed.append((key[0], i, *value, "put"))
        for i in before.keys() - after.keys():
            self.kept.removeKey((i,))
            changed.append((key[0], i, *(before[i][c] for c in _FIELDS), "evict"))
        yield pd.DataFrame(changed, columns=["project", "id", *_FIELDS, "action"]).astype({"seq": "int64", "created_at": "int64", "updated_at": "int64"})

    def close(self) -> None:
        pass


def remember_stream(stream: DataFrame) -> DataFrame:
    """remember_in_order for a stream of new notes (those columns and n_files, the project's files): changes by id.

    Returns the notes' columns and `action`: `put` for a note that is new or superseded, `evict` for one beyond the
    capacity. Notes of a project are folded by seq within a batch, and batches as they arrive; an id occurs once in a
    batch of changes, so a table keyed by project and id may apply it again after a failure. Ids and times aren't null.
    A project's notes of one batch are held by one task; the source's limits a batch bound them.
    """
    at = ("created_at", "updated_at")
    rows = stream.select("project", "id", "seq", "problem", "solution", "source_file", *[F.unix_micros(c).alias(c) for c in at], "n_files")
    schema = SCHEMA.replace("timestamp", "long") + ", action string"
    changes = rows.groupBy("project").transformWithStateInPandas(_Fold(), outputStructType=schema, outputMode="update", timeMode="None")
    return changes.withColumns({c: F.timestamp_micros(c) for c in at})


def forget(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """notes without those that requests (project, query) name: by id, else those sharing half of the smaller token set.

    Equal sets are compared once, so copies of a request or a note add no comparisons."""
    by_id = notes.join(requests.select("project", F.col("query").alias("id")).distinct(), ["project", "id"], "left_semi").select("project", "id")
    others = requests.join(by_id.withColumnRenamed("id", "query"), ["project", "query"], "left_anti")
    words = keyed_sets(others.select("project", F.col("query").alias("id"), F.lit(0).alias("seq"), token_set(F.col("query")).alias("tokens")))
    text = F.concat_ws(" ", F.coalesce("problem", F.lit("")), F.coalesce("solution", F.lit("")))
    sets = keyed_sets(_sets(notes, text))
    hit = met(distinct_sets(words), distinct_sets(sets), FORGET)
    named = sets.join(hit, ["project", "set"], "left_semi").select("project", "id")
    return notes.join(by_id.union(named).distinct(), ["project", "id"], "left_anti")
