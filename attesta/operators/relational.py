"""Joins that decide by how many rows match, ranges over edits, and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_match(rows: DataFrame, key: list[str], exact: DataFrame, exact_on: list[str], positional: DataFrame, positional_on: list[str], value: str) -> DataFrame:
    """Two tiers: the one exact match, else the one positional match; several in a tier are ambiguous.

    A value chosen by several rows is reused. Columns: key, value, state (exact, positional, ambiguous, reused, missing).
    """
    one = lambda df, on, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"__n{n}"), F.min(value).alias(f"__v{n}"))
    met = rows.join(one(exact, exact_on, 1), exact_on, "left").join(one(positional, positional_on, 2), positional_on, "left")
    chosen = F.when(F.col("__n1") == 1, F.col("__v1")).when(F.col("__n1").isNull() & (F.col("__n2") == 1), F.col("__v2"))
    met = met.select(*key, chosen.alias(value), F.when(F.col("__n1") == 1, "exact").when(F.col("__n1") > 1, "ambiguous").when(F.col("__n2") == 1, "positional").when(F.col("__n2") > 1, "ambiguous").otherwise("missing").alias("state"))
    again = met.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__uses")).where("__uses > 1")
    met = met.join(again, F.col(value) == F.col("__value"), "left")
    return met.select(*key, value, F.when(F.col("__uses").isNotNull(), "reused").otherwise(F.col("state")).alias("state"))


def link_status(nodes: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """key, page, status of each item by its nodes in the document and on its page: matched, wrong_page, missing, duplicated."""
    everywhere = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("__all"))
    here = nodes.groupBy(key, "page").agg(F.count(F.lit(1)).alias("__here"))
    met = items.select(key, "page").join(everywhere, key, "left").join(here, [key, "page"], "left").fillna(0, ["__all", "__here"])
    status = F.when(F.col("__all") == 0, "missing").when(F.col("__all") > 1, "duplicated").when(F.col("__here") == 0, "wrong_page").otherwise("matched")
    return met.select(key, "page", status.alias("status"))


def kth_occurrences(left: DataFrame, right: DataFrame, text: str, left_order: str, right_order: str) -> DataFrame:
    """The i-th left row of a text meets the i-th right row of it: text, left and right order values."""
    number = lambda df, order: df.select(text, order, F.row_number().over(Window.partitionBy(text).orderBy(order)).alias("__k"))
    return number(left, left_order).join(number(right, right_order), [text, "__k"]).drop("__k")


def mapped_spans(spans: DataFrame, edits: DataFrame, ref: str) -> DataFrame:
    """Spans moved by the edits that end before them; null where an edit overlaps.

    spans: ref, id, start, end, not empty. edits: ref, e_start, e_end, delta. Result: ref, id, new_start, new_end. Spans and edits of a
    reference are swept together, once by where edits end and once by where they begin.
    """
    none = F.lit(None).cast("long")
    swept = spans.select(ref, "id", "start", "end", none.alias("__delta"), F.lit(0).alias("__edit"), F.col("start").alias("__low"), F.lit(1).alias("__after"), F.col("end").alias("__high"), F.lit(0).alias("__later")).union(
        edits.select(ref, none.alias("id"), none.alias("start"), none.alias("end"), F.col("delta").cast("long"), F.lit(1), F.col("e_end"), F.lit(0), F.col("e_start"), F.lit(1))
    )
    so_far = lambda *order: Window.partitionBy(ref).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended, begun = so_far("__low", "__after"), so_far("__high", "__later")
    swept = swept.withColumn("__by", F.coalesce(F.sum("__delta").over(ended), F.lit(0))).withColumn("__ended", F.sum("__edit").over(ended)).withColumn("__begun", F.sum("__edit").over(begun))
    moved = lambda c: F.when(F.col("__begun") == F.col("__ended"), (F.col(c) + F.col("__by")).cast("long"))
    return swept.where("__edit = 0").select(ref, "id", moved("start").alias("new_start"), moved("end").alias("new_end"))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key and side (missing or unexpected) where the two sets differ."""
    a, b = expected.select(key).distinct().withColumn("__e", F.lit(True)), actual.select(key).distinct().withColumn("__a", F.lit(True))
    both = a.join(b, key, "full_outer").where("__e IS NULL OR __a IS NULL")
    return both.select(key, F.when(F.col("__a").isNull(), "missing").otherwise("unexpected").alias("side"))


def file_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name and state (missing, added, changed, same) of two inventories with digests."""
    e, a = expected.select("name", F.col("sha").alias("__e")), actual.select("name", F.col("sha").alias("__a"))
    state = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "added").when(F.col("__a") != F.col("__e"), "changed").otherwise("same")
    return e.join(a, "name", "full_outer").select("name", state.alias("state"))


def pattern_places(values: Column, pattern: Column) -> Column:
    """The places, from 0, at which an array holds another one."""
    n = F.size(values) - F.size(pattern)
    starts = F.when((n >= 0) & (F.size(pattern) > 0), F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(values, i + 1, F.size(pattern)) == pattern)


def substring_places(text: Column, part: Column) -> Column:
    """All places, from 0, at which a text holds a part, overlapping ones included."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    # Cut in front of each place: the places are where the pieces but the first begin, and 0 if the text begins with the part.
    pieces = F.split(text, quoted)
    held = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    rest = F.aggregate(pieces, held, lambda so, piece: F.struct((so["at"] + F.length(piece)).alias("at"), F.array_append(so["places"], so["at"] + F.length(piece)).alias("places")))["places"]
    found = F.concat(F.when(F.startswith(text, part), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.slice(rest, 1, F.size(pieces) - 1))
    return F.when(F.length(part) > 0, found).otherwise(F.array().cast("array<int>"))


def is_subsequence(values: Column, of: Column) -> Column:
    """Whether all values stand in another array in their order."""
    reached = F.aggregate(of, F.lit(0), lambda at, x: F.when((at < F.size(values)) & x.eqNullSafe(F.get(values, at)), at + 1).otherwise(at))
    return reached == F.size(values)


def all_equal(a: Column, b: Column) -> Column:
    """Whether two arrays have the same length and equal members place by place."""
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
