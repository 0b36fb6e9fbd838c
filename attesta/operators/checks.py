"""Checks of shape and scope. A check that fails gives a row a status and a code; nothing is raised."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def _limited(ok: Column, status: str, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(code).alias("code")))


def require_supported(ok: Column, code: str) -> Column:
    """Null where ``ok`` holds, else (unsupported, code); a null condition doesn't hold."""
    return _limited(ok, "unsupported", code)


def require_unambiguous(ok: Column, code: str) -> Column:
    """Null where ``ok`` holds, else (ambiguous, code)."""
    return _limited(ok, "ambiguous", code)


def first_limitation(*checks: Column) -> Column:
    """The first check that fails, in the order given; null if all hold."""
    return F.coalesce(*checks)


def rendering_mode(operands: Column) -> Column:
    """The mode that an array of one number (as text) states, a whole number from 0 to 7; else null."""
    value = F.when(F.size(operands) == 1, F.try_element_at(operands, F.lit(1)).try_cast("double"))
    return F.when((value >= 0) & (value <= 7) & (value == F.floor(value)), value.cast("int"))


def matrix(values: Column) -> Column:
    """``values`` if they are six numbers, none of them null, else null."""
    return F.when((F.size(values) == 6) & ~F.exists(values, lambda x: x.isNull()), values.cast("array<double>"))


def canonical_reasons(reasons: Column) -> Column:
    """Of each reason font_resource, code and message alone, sorted by these; no font comes first."""
    kept = F.transform(reasons, lambda r: F.struct(F.coalesce(r["font_resource"], F.lit("")).alias("k"), r["code"].alias("code"), r["message"].alias("message"), r["font_resource"].alias("font_resource")))
    return F.transform(F.array_sort(kept), lambda r: F.struct(r["font_resource"].alias("font_resource"), r["code"].alias("code"), r["message"].alias("message")))


def selection_valid(selected: Column, available: Column, n: Column) -> Column:
    """Whether ``selected`` are ``n`` different ids, all of them among the ``available``, which are different too; null arrays aren't valid."""
    unique = lambda ids: F.size(F.array_distinct(ids)) == F.size(ids)
    return F.coalesce(unique(selected) & (F.size(selected) == n) & unique(available) & (F.size(F.array_except(selected, available)) == 0), F.lit(False))


def anchors_in_order(anchors: Column, pages: Column, prefix: str = "page-") -> Column:
    """Whether the anchors of pages are those of the sorted ``pages``, one for each, in that order; other anchors don't count."""
    return F.filter(anchors, lambda a: F.startswith(a, F.lit(prefix))) == F.transform(F.array_sort(pages), lambda p: F.concat(F.lit(prefix), p.cast("string")))


def event_limit(n_bytes: Column, most: int) -> Column:
    """event_too_large beyond ``most`` bytes, else null."""
    return F.when(n_bytes > most, F.lit("event_too_large"))


def progress_event(phase: Column, completed: Column, total: Column) -> Column:
    return F.struct(F.lit("progress").alias("type"), phase.alias("phase"), completed.alias("completed_units"), total.alias("total_units"))


def admission(running: Column, capacity: int, seconds: Column, most_seconds: float, n_bytes: Column, most_bytes: int, valid: Column) -> Column:
    """The status of a request: 429 with no slot free, 408 for a slow upload, 413 for a large one, 422 for one that breaks the contract, else 200."""
    return F.when(running >= capacity, 429).when(seconds > most_seconds, 408).when(n_bytes > most_bytes, 413).when(~F.coalesce(valid, F.lit(False)), 422).otherwise(200)


#: Fixed value: mathematics in Markdown, between brackets, parentheses, two dollars or one.
MATH = r"(?s)\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$|(?<!\\)\$(?!\$).*?(?<!\\)\$"


def extracted_math(markdown: Column) -> Column:
    """The formulas of a text in order, without delimiters and outer blanks; blank ones are left out."""
    inner = lambda m: F.when(m.rlike(r"^(\\|\$\$)"), m.substr(F.lit(3), F.length(m) - 4)).otherwise(m.substr(F.lit(2), F.length(m) - 2))
    bare = F.transform(F.regexp_extract_all(markdown, F.lit(MATH), F.lit(0)), lambda m: F.regexp_replace(inner(m), r"^\s+|\s+$", ""))
    return F.filter(bare, lambda m: m != "")


def rule_against_glyphs(rules: DataFrame, glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, covers, fits for rules (x0, x1, width) whose group (keys) has glyphs (x0, x1).

    covers: the rule spans the glyphs, but for a fifth of their span or the rule's width. fits: the glyphs span the rule, but for
    a quarter of it or twice that width.
    """
    span = glyphs.groupBy(*keys).agg(F.min("x0").alias("__g0"), F.max("x1").alias("__g1"))
    wide = F.col("__g1") - F.col("__g0")
    slack = F.least(F.greatest(F.lit(0.1), F.col("width")), wide * 0.2)
    room = F.least(F.greatest(F.lit(1.0), F.col("width") * 2), wide * 0.25)
    covers = (F.col("x0") <= F.col("__g0") + slack) & (F.col("x1") >= F.col("__g1") - slack)
    fits = (F.col("x0") >= F.col("__g0") - room) & (F.col("x1") <= F.col("__g1") + room)
    return rules.join(span, keys).select(*keys, covers.alias("covers"), fits.alias("fits"))


def publication(accepted: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """*key, code for accepted corrections (key, page, markup) against nodes of a page (the same): null, or why it isn't published as accepted.

    correction_missing, correction_repeated, correction_page_differs or correction_markup_differs, the first that holds.
    """
    held = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min("page").alias("__page"), F.min("markup").alias("__markup"))
    code = (
        F.when(F.col("__n").isNull(), "correction_missing").when(F.col("__n") > 1, "correction_repeated").when(~F.col("page").eqNullSafe(F.col("__page")), "correction_page_differs")
        .when(~F.col("markup").eqNullSafe(F.col("__markup")), "correction_markup_differs")
    )
    return accepted.join(held, key, "left").select(*key, code.alias("code"))


def applicable(regions: DataFrame, target: str, exact: Column) -> DataFrame:
    """target, n, applicable, reason: a target is applied only if all of its regions are exact."""
    out = regions.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(exact, F.lit(False))).alias("applicable"))
    return out.withColumn("reason", F.when(~F.col("applicable"), "region_not_exact"))


def links_on_page(details: Column, page: Column | int) -> Column:
    """Of an array of maps, those of a page that have a link_status, whatever it is."""
    return F.filter(details, lambda d: (d["page"] == F.lit(page).cast("string")) & F.map_contains_key(d, "link_status"))


def concatenated(parts: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """name, text, missing: the texts of a name's parts (name, position, path) joined by line ends; null where a file (path, text) is missing.

    ``missing`` lists the paths that aren't there, in order.
    """
    rows = parts.join(files.select("path", F.col("text").alias("__text"), F.lit(True).alias("__there")), "path", "left")
    held = rows.groupBy(name).agg(
        F.array_sort(F.collect_list(F.struct("position", F.coalesce("__text", F.lit("")).alias("t")))).alias("__t"), F.array_sort(F.collect_list(F.when(F.col("__there").isNull(), F.col("path")))).alias("missing"),
    )
    return held.select(name, F.when(F.size("missing") == 0, F.array_join(F.transform("__t", lambda x: x["t"]), "\n")).alias("text"), "missing")


def active_jobs(jobs: DataFrame, *executions: DataFrame) -> DataFrame:
    """The ``jobs`` (job_id) that stand in any of the tables of executions (job_id), once each."""
    there = executions[0].select("job_id")
    for more in executions[1:]:
        there = there.union(more.select("job_id"))
    return jobs.join(there, "job_id", "left_semi")


def _same(a: object, b: object) -> bool:
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        own, other = ({"cref" if k == "$ref" else k: v for k, v in d.items()} for d in (a, b))
        return own.keys() == other.keys() and all(_same(own[k], other[k]) for k in own)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else ...
    except ValueError:
        return ...


@F.pandas_udf(BooleanType())
def same_value_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two JSON texts hold one value: keys in any order, $ref and cref alike, 1 and 1.0 apart. False for what can't be read."""
    both = ((_loaded(a), _loaded(b)) for a, b in zip(left, right, strict=True))
    return pd.Series([a is not ... and b is not ... and _same(a, b) for a, b in both], dtype=bool)
