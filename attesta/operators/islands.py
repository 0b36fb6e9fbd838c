"""Runs, islands and running state over ordered rows, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def runs(rows: DataFrame, keys: list[str], order: list[str], same: list[str], name: str = "run") -> DataFrame:
    """Append the number of the run, from 0, of consecutive rows whose ``same`` columns agree (null agrees with null)."""
    w = _ordered(keys, order)
    first = F.row_number().over(w) == 1
    changed = ~F.struct(*same).eqNullSafe(F.lag(F.struct(*same)).over(w))
    return rows.withColumn(name, (F.sum(F.when(first, 0).when(changed, 1).otherwise(0)).over(w)).cast("long"))


def seeded_runs(rows: DataFrame, keys: list[str], order: list[str], marked: Column, seed: Column) -> DataFrame:
    """Maximal runs of marked rows that hold a seed: keys, first and last row number (from 0), rows, seeds."""
    w = _ordered(keys, order)
    at = rows.withColumns({"__at": F.row_number().over(w) - 1, "__marked": marked, "__seed": seed})
    at = at.where("__marked").withColumn("__run", F.col("__at") - F.row_number().over(_ordered(keys, ["__at"])))
    out = at.groupBy(*keys, "__run").agg(F.min("__at").cast("long").alias("first"), F.max("__at").cast("long").alias("last"), F.count(F.lit(1)).alias("n"), F.count_if("__seed").alias("seeds"))
    return out.where("seeds > 0").drop("__run")


def overlap_islands(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Merge spans that overlap strictly; spans that only touch stay apart. keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0))
    numbered = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("__island")


def compact_ranges(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct integers as inclusive ranges of consecutive ones: keys, first, last."""
    distinct = rows.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    gap = distinct.withColumn("__gap", F.col(value) - F.row_number().over(_ordered(keys, [value])))
    return gap.groupBy(*keys, "__gap").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__gap")


def out_of_order(rows: DataFrame, keys: list[str], order: list[str], by: list[str]) -> DataFrame:
    """keys and whether the tuples ``by`` fail to rise strictly along ``order``."""
    w = _ordered(keys, order)
    falls = F.lag(F.struct(*by)).over(w) >= F.struct(*by)
    return rows.select(*keys, F.coalesce(falls, F.lit(False)).alias("__falls")).groupBy(*keys).agg(F.bool_or("__falls").alias("out_of_order"))


def dense(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and whether the distinct values fill a range without gaps."""
    return rows.groupBy(*keys).agg((F.max(value) - F.min(value) + 1 == F.count_distinct(value)).alias("dense"))


def disjoint_ranges(rows: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """keys and whether ranges, sorted, neither overlap nor touch."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    gap = F.coalesce(F.lag(last).over(w) + 1 < F.col(first), F.lit(True))
    return rows.select(*keys, (gap & (F.col(first) <= F.col(last))).alias("__ok")).groupBy(*keys).agg(F.bool_and("__ok").alias("disjoint"))


def is_sorted_set(column: Column) -> Column:
    """Sorted, without repeats or negative values."""
    return (column == F.array_sort(F.array_distinct(column))) & F.forall(column, lambda v: v >= 0)


def latest(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The last row for each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def progress_violations(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Append ``reason``: phase_regressed, total_changed, completed_regressed, completed_out_of_range, or null."""
    w = _ordered(keys, order)
    was = F.lag(F.struct("phase", "completed", "total")).over(w)
    same = was["phase"] == F.col("phase")
    reason = (
        F.when((F.col("completed") < 0) | (F.col("completed") > F.col("total")), "completed_out_of_range")
        .when(was["phase"] > F.col("phase"), "phase_regressed")
        .when(same & (was["total"] != F.col("total")), "total_changed")
        .when(same & (was["completed"] > F.col("completed")), "completed_regressed")
    )
    return events.withColumn("reason", reason)


def bucket_changes(events: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """The events at which the bucket differs from the one before; the first one counts."""
    w = _ordered(keys, order)
    held = events.withColumn("bucket", bucket)
    return held.withColumn("__was", F.lag("bucket").over(w)).where(F.col("__was").isNull() | (F.col("__was") != F.col("bucket"))).drop("__was")


def running_offsets(edits: DataFrame, keys: list[str], start: str, delta: str) -> DataFrame:
    """Append ``offset``: the sum of the length changes of earlier edits."""
    w = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("offset", F.coalesce(F.sum(delta).over(w), F.lit(0)).cast("long"))


def filled(pages: DataFrame, keys: list[str], number: str, last: str) -> DataFrame:
    """A row for every number from 1 to ``last`` of each key; numbers that aren't there are blank."""
    every = pages.groupBy(*keys).agg(F.max(last).alias("__last")).select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__last").cast("long"))).alias(number))
    there = pages.select(*keys, number).distinct().withColumn("__there", F.lit(True))
    return every.join(there, [*keys, number], "left").withColumn("blank", F.col("__there").isNull()).drop("__there")
