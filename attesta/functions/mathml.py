"""Rewrites of MathML trees for publication: each takes XML and gives XML, or leaves what it can't read."""

from __future__ import annotations

import re
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operators whose scripts stand below them, and bars that need no space around them.
UNDER = {"max", "min", "argmax", "argmin", "lim"}
BARS = {"|", "∣", "‖"}
SENTINEL = "\uE000"


def _parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {child: parent for parent in root.iter() for child in parent}


def without_alignment(root: ET.Element) -> None:
    """Alignment marks go; a literal ampersand, kept as a sentinel, comes back."""
    parents = _parents(root)
    for node in list(root.iter("mi")) + list(root.iter("mo")):
        if node.text == "&" and node in parents:
            parents[node].remove(node)
        elif node.text and SENTINEL in node.text:
            node.text = node.text.replace(SENTINEL, "&")


def scripts_below(root: ET.Element) -> None:
    """msub of an operator like max is munder."""
    for node in list(root.iter("msub")):
        if len(node) == 2 and "".join(node[0].itertext()).strip() in UNDER:
            node.tag = "munder"


def tight_bars(root: ET.Element) -> None:
    for row in root.iter():
        kids = list(row)
        for a, b in zip(kids, kids[1:], strict=False):
            if a.tag == b.tag == "mo" and a.text in BARS and b.text in BARS:
                a.set("rspace", "0")
                b.set("lspace", "0")


def nested_formulas(root: ET.Element) -> None:
    """Text with a formula between dollars is a row of text, identifiers and text."""
    parents = _parents(root)
    for node in list(root.iter("mtext")):
        parts = re.split(r"(?<!\\)\$", node.text or "")
        if len(parts) < 3 or len(parts) % 2 == 0 or node not in parents:
            continue
        row = ET.Element("mrow")
        for i, part in enumerate(parts):
            if part:
                ET.SubElement(row, "mi" if i % 2 else "mtext").text = part
        parent = parents[node]
        parent[list(parent).index(node)] = row


def annotated(root: ET.Element, source: str) -> None:
    """Presentation and its LaTeX source under one ``semantics`` node."""
    if root.find("semantics") is not None:
        return
    kids = list(root)
    for kid in kids:
        root.remove(kid)
    semantics = ET.SubElement(root, "semantics")
    row = ET.SubElement(semantics, "mrow")
    row.extend(kids)
    ET.SubElement(semantics, "annotation", {"encoding": "application/x-tex"}).text = source


def published(xml: str, source: str) -> str | None:
    """All rewrites in turn; null where the XML can't be read."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    for rewrite in (without_alignment, scripts_below, tight_bars, nested_formulas):
        rewrite(root)
    annotated(root, source)
    return ET.tostring(root, encoding="unicode")


def with_sentinels(latex: str) -> tuple[str, int]:
    r"""``\&`` as a sentinel, and how many there were."""
    return latex.replace(r"\&", SENTINEL), latex.count(r"\&")


def restored(text: str, count: int) -> str | None:
    """Sentinels as ampersands, if there are as many as were put in."""
    return text.replace(SENTINEL, "&amp;") if text.count(SENTINEL) == count else None


def located(xml: str, attributes: dict[str, str]) -> str | None:
    """Attributes put on the one root ``math``; null where there isn't exactly one."""
    if len(re.findall(r"<math\b", xml)) != 1:
        return None
    from xml.sax.saxutils import quoteattr

    put = "".join(f" {k}={quoteattr(v)}" for k, v in sorted(attributes.items()))
    return re.sub(r"<math\b", lambda m: m[0] + put, xml, count=1)


@F.pandas_udf(T.StringType())
def published_udf(xml: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([published(x or "", s or "") for x, s in zip(xml, source, strict=True)], dtype=object)
