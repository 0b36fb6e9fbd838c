"""Inventory of HTML pages with the parser of the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are content by themselves, and those that never close.
MEDIA = {"math", "img", "svg", "table", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "title"}


class _Inventory(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: dict[str, int] = {}
        self.open: list[str] = []
        self.unclosed = 0
        self.text: list[str] = []
        self.anchors: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags[tag] = self.tags.get(tag, 0) + 1
        if tag not in VOID:
            self.open.append(tag)
        anchor = dict(attrs).get("id")
        if anchor:
            self.anchors.append(anchor)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                self.unclosed += 1

    def handle_data(self, data: str) -> None:
        if not HIDDEN & set(self.open):
            self.text.append(data)


INVENTORY = T.StructType([T.StructField("links", T.LongType()), T.StructField("paragraphs", T.LongType()), T.StructField("media", T.LongType()), T.StructField("unclosed", T.LongType()), T.StructField("text_chars", T.LongType()), T.StructField("anchors", T.ArrayType(T.StringType())), T.StructField("has_content", T.BooleanType())])


@F.pandas_udf(INVENTORY)
def inventory_udf(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for html in pages:
        p = _Inventory()
        p.feed(html or "")
        p.close()
        chars, media = len("".join("".join(p.text).split())), sum(n for t, n in p.tags.items() if t in MEDIA)
        rows.append((p.tags.get("a", 0), p.tags.get("p", 0), media, p.unclosed + len(p.open), chars, p.anchors, chars > 0 or media > 0))
    return pd.DataFrame(rows, columns=[f.name for f in INVENTORY.fields])


def page_issues(expected: DataFrame, actual: DataFrame, key: str, count: str) -> DataFrame:
    """key, code where counts differ: fewer and more have codes of their own, as has a page that isn't there."""
    e, a = expected.select(key, F.col(count).alias("__e")), actual.select(key, F.col(count).alias("__a"))
    code = F.when(F.col("__a").isNull(), f"{count}_page_missing").when(F.col("__a") < F.col("__e"), f"{count}_missing").when(F.col("__a") > F.col("__e"), f"{count}_unexpected")
    return e.join(a, key, "left").select(key, code.alias("code")).where("code IS NOT NULL")


def page_status(issues: Column, blank: Column) -> Column:
    return F.when(issues > 0, "incomplete").when(blank, "blank").otherwise("complete")


def anchored_document(fragments: DataFrame, keys: list[str], number: str, fragment: str) -> DataFrame:
    """One text per document: a section for each page in order, blank pages included."""
    section = F.concat(F.lit('<section id="page-'), F.col(number).cast("string"), F.lit('">'), F.coalesce(F.col(fragment), F.lit("")), F.lit("</section>"))
    held = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), section.alias("s")))).alias("__p"))
    return held.select(*keys, F.array_join(F.transform("__p", lambda p: p["s"]), "\n").alias("html"))
