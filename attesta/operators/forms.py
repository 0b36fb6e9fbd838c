"""Forms that draw forms: whether one shows text, and the tree of what a page draws.

A form without resources of its own reads names in those of whoever draws it, so a node is a form with the stream whose resources it
reads (``ctx``). Names are looked up as joins, and nesting is followed in rounds, one per level, over all documents at once.

``streams``: source, stream, kind (page, form, image or another), own (whether it has resources), of each stream of a document.
``entries``: source, owner, kind (XObject or Font), name, target, of each resource dictionary.
``draws``: source, stream, op, name, of each Do operator; ``shows``: source, stream, of the streams with a text operator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import cut, rows

NODE = ["source", "stream", "ctx"]
#: What is told of a node: it shows text, it shows none, or the reason why that can't be told.
TEXT, NONE, CYCLE, MISSING = "text", "none", "form_xobject_cycle_unsupported", "form_xobject_resource_missing"


def targets(nodes: DataFrame, draws: DataFrame, streams: DataFrame, entries: DataFrame) -> DataFrame:
    """The nodes with each of their draws: op, name, and target, target_kind and target_ctx (null where the name is unknown)."""
    found = entries.where("kind = 'XObject'").select("source", F.col("owner").alias("ctx"), "name", "target")
    kinds = streams.select("source", F.col("stream").alias("target"), F.col("kind").alias("target_kind"), F.col("own").alias("__own"))
    out = nodes.join(draws.select("source", "stream", "op", "name"), ["source", "stream"]).join(found, ["source", "ctx", "name"], "left").join(kinds, ["source", "target"], "left")
    return out.withColumn("target_ctx", F.when(F.col("__own"), F.col("target")).otherwise(F.col("ctx"))).drop("__own")


def _child(edges: DataFrame) -> DataFrame:
    return edges.where("target_kind = 'form'").select("source", F.col("target").alias("stream"), F.col("target_ctx").alias("ctx")).distinct()


def showing_text(streams: DataFrame, entries: DataFrame, draws: DataFrame, shows: DataFrame) -> DataFrame:
    """source, stream, ctx, outcome of each form that a page draws, directly or not.

    A form with a text operator shows text. Any other one is what the first of the forms that it draws is that doesn't show none:
    draws are looked at in order, and what follows isn't. A name that isn't there counts as such a one. Forms that wait for
    each other for ever are cycles. Rounds are as many as forms are nested.
    """
    pages = streams.where("kind = 'page'").select("source", "stream", F.col("stream").alias("ctx"))
    node = ["source", "stream", "ctx"]
    frontier = cut(_child(targets(pages, draws, streams, entries)))
    nodes, edges = frontier, None
    while rows(frontier):
        step = cut(targets(frontier, draws, streams, entries).where("target_kind = 'form' OR target_kind IS NULL"))
        edges = step if edges is None else edges.unionAll(step)
        frontier = cut(_child(step).join(nodes, node, "left_anti"))
        nodes = nodes.unionAll(frontier)
    if edges is None:
        return nodes.withColumn("outcome", F.lit(None).cast("string"))
    told = cut(nodes.join(shows.select("source", "stream").distinct(), ["source", "stream"], "left_semi").select(*node, F.lit(TEXT).alias("outcome")))
    open_, edges = cut(nodes.join(told, node, "left_anti")), cut(edges)
    known = lambda t: t.select("source", F.col("stream").alias("target"), F.col("ctx").alias("target_ctx"), F.col("outcome").alias("__of"))
    while rows(open_):
        each = open_.join(edges, node, "left").join(known(told), ["source", "target", "target_ctx"], "left")
        of = F.when(F.col("op").isNotNull() & F.col("target").isNull(), MISSING).otherwise(F.col("__of"))
        # The first draw that isn't known to show none; no such draw, and the form shows none.
        waits = F.col("op").isNotNull() & (of.isNull() | (of != NONE))
        first = F.min(F.when(waits, F.struct("op", of.alias("of"))))
        found = each.groupBy(*node).agg(first.alias("first")).select(*node, F.when(F.col("first").isNull(), NONE).otherwise(F.col("first.of")).alias("outcome"))
        new = cut(found.where("outcome IS NOT NULL"))
        if not rows(new):
            return told.unionAll(open_.select(*node, F.lit(CYCLE).alias("outcome")))
        told = told.unionAll(new)
        open_ = cut(open_.join(new, node, "left_anti"))
    return told


def drawn(streams: DataFrame, entries: DataFrame, draws: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each page draws: its invocations (source, page, stream, ctx, path), itself among them, and the faults met (source, page, path, reason).

    A form that shows text is entered; ``path`` is where: the places of the draws that led there, so invocations sort as they happen.
    A form that would be entered from within itself is a fault, and so are unknown names.
    """
    told = outcomes.select("source", F.col("stream").alias("target"), F.col("ctx").alias("target_ctx"), "outcome")
    frontier = streams.where("kind = 'page'").select("source", F.col("stream").alias("page"), "stream", F.col("stream").alias("ctx"), F.array().cast("array<int>").alias("path"), F.array().cast("array<long>").alias("active"))
    entered, faults = frontier, []
    while True:
        each = targets(frontier, draws, streams, entries).join(told, ["source", "target", "target_ctx"], "left")
        at = F.concat("path", F.array(F.col("op"), F.lit(0)))
        again = (F.col("outcome") == TEXT) & F.array_contains("active", F.col("target"))
        reason = F.when(F.col("target_kind").isNull(), MISSING).when(again, CYCLE).when(F.col("outcome").isin(CYCLE, MISSING), F.col("outcome"))
        each = cut(each.select("source", "page", "target", "target_ctx", at.alias("path"), "active", "outcome", reason.alias("reason")).where(f"reason IS NOT NULL OR outcome = '{TEXT}'"))
        if not rows(each):
            break
        faults.append(each.where("reason IS NOT NULL").select("source", "page", "path", "reason"))
        frontier = each.where("reason IS NULL").select("source", "page", F.col("target").alias("stream"), F.col("target_ctx").alias("ctx"), "path", F.concat("active", F.array("target")).alias("active"))
        entered = entered.unionAll(frontier)
    none = entered.select("source", "page", "path", F.lit(None).cast("string").alias("reason")).limit(0)
    return entered.drop("active"), reduce(DataFrame.unionAll, faults, none)
