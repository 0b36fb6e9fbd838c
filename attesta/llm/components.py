"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, gathered, if_few, materialise


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Return node, label for each node of ``edges`` (columns a, b): the smallest node that it reaches.

    Each round takes the least label among neighbours and then the label of that label, so the reach doubles; it is
    written out, and the rounds end when no label changes. Few labels are broadcast, more are shuffled. Loops, repeated
    edges and an empty table are fine; edges with a null end are left out. The result is a written table, which the caller
    may ``drop``.
    """
    good = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = materialise(good.select("a", "b").union(good.select(F.col("b"), F.col("a"))).distinct())
    close = gathered(both)
    table = materialise(close(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))))
    some = if_few(table)
    for _ in range(most_rounds):
        labels = table.select("node", "label")
        near = both.join(some(labels), both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("near"))
        lower = near.join(some(labels), labels["node"] == near["b"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = some(labels.select(F.col("node").alias("at"), F.col("label").alias("beyond")))
        step = materialise(close(lower.join(jump, lower["label"] == jump["at"]).select("node", "was", F.least("label", "beyond").alias("label"))))
        drop(table)
        table = step
        if step.where("label <> was").isEmpty():
            drop(both)
            out = step.select("node", "label")
            out._written_to = step._written_to
            return out
    raise RuntimeError("labels still change")


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """The components (a written table) of what ``found`` has, a result of ``components``, and of further edges.

    The ends of these stand for their components, so what is propagated are the new edges alone, however many old ones there were.
    """
    some = if_few(found)
    ends = more
    for side in "ab":
        known = found.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        ends = ends.join(some(known), F.col(side) == F.col("__node"), "left").withColumn(side, F.coalesce("__label", side)).drop("__node", "__label")
    contracted = materialise(gathered(more)(ends.where("a <> b").distinct()))
    new = components(contracted)
    few = if_few(new)
    beyond = few(new.select(F.col("node").alias("__node"), F.col("label").alias("__label")))
    old = found.join(beyond, F.col("label") == F.col("__node"), "left").select("node", F.coalesce("__label", "label").alias("label"))
    out = materialise(gathered(found)(old.union(new.join(some(found.select("node")), "node", "left_anti"))))
    drop(contracted, new)
    return out
