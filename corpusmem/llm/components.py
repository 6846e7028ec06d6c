"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.util import Work, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", keep: Work | None = None) -> DataFrame:
    """(id, component): component is the smallest id that the edges reach; ids without an edge are absent.

    Every round takes the smallest label of the neighbours, then follows the label's own label, so long chains
    shorten by half. Rounds end when nothing changes. Labels are stored each round and those of the round
    before removed; nothing is collected but a count. keep: the caller's Work, which then owns the result's table.
    Self-loops and repeated edges are harmless; an empty table gives an empty one.
    """
    work = Work(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    # both directions of one evaluation: links that merely span a component may come out otherwise in the next
    both = work.store(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    rounds = [Work(edges.sparkSession)]
    labels = rounds[-1].store(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        root = labels.select(F.col("id").alias("r"), F.col("component").alias("c"))
        jumped = step.join(root, step["component"] == root["r"], "left").select("id", "old", F.least("component", "c").alias("component"))
        # the smallest label is also handed to the old label's own node, so whole trees move at once
        hooks = jumped.where("component < old").groupBy(F.col("old").alias("id")).agg(F.min("component").alias("h"))
        rounds.append(Work(edges.sparkSession))
        new = rounds[-1].store(jumped.join(hooks, "id", "left").select("id", "old", F.least("component", F.coalesce("h", "component")).alias("component")))
        rounds[-2].clear()
        if not new.where("component <> old").limit(1).count():
            out = stored(new.select("id", "component")) if keep is None else keep.store(new.select("id", "component"))
            rounds[-1].clear(), work.clear()
            return out
        labels = new.select("id", "component")
