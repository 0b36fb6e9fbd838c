"""Order-dependent layout per page: seeds to runs, runs to regions, regions to relation signatures.

A glyph row: page, seq, u, font, block, line, span, size, oy (baseline), x0, y0, x1, y1, name. A page is handled as a whole in one
group; pages never touch each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import isfinite
from statistics import median

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.latex import EQUIVALENT
from .geometry_frames import Frame

# Characters and glyph names that the rules name.
ATOMS = set("()[]{}_")
BOUNDARIES = set(",.;")
ANNOTATED = set("=≈≝")
STACKED = {"productdisplay", "producttext", "radicalBig", "summationdisplay", "summationtext"}
#: Glyphs of regions that a task holds at once.
GLYPHS = 100_000
PAIRS = {"(": ")", "[": "]", "{": "}"}


def kind(u: str, in_math_font: bool) -> str:
    """seed, atom, boundary or prose."""
    import unicodedata

    if in_math_font or any(unicodedata.category(c) == "Sm" for c in u):
        return "seed"
    if u and all(c.isdigit() or c in ATOMS for c in u):
        return "atom"
    return "boundary" if u in BOUNDARIES else "prose"


@dataclass
class Region:
    """Glyphs of one candidate, by seq, with what the merge looks at."""

    glyphs: dict[int, dict] = field(default_factory=dict)

    @classmethod
    def of(cls, glyphs: list[dict]) -> Region:
        return cls({g["seq"]: g for g in glyphs})

    def __post_init__(self) -> None:
        rows = list(self.glyphs.values())
        self.frame = Frame.around(rows)
        self.base = max(rows, key=lambda g: g["size"])
        self.size = self.base["size"]
        self.first, self.last = min(self.glyphs), max(self.glyphs)
        self.stacked = any(g.get("name") in STACKED for g in rows)
        self.hierarchical = any(abs(g["oy"] - self.base["oy"]) > 0.05 * self.size for g in rows)

    def joins(self, other: Region) -> bool:
        if self.glyphs.keys() & other.glyphs.keys():
            return True
        scale = max(self.size, other.size)
        across, down = self.frame.gaps(other.frame)
        follows = self.last + 1 == other.first or other.last + 1 == self.first
        stacked = self.stacked or other.stacked
        if follows and across <= scale and (abs(self.base["oy"] - other.base["oy"]) <= 0.1 * scale or (stacked and down <= 1.5 * scale)):
            return True
        if not self.frame.overlaps(other.frame):
            return False
        attached = min(self.size, other.size) < 0.8 * scale and not (self.hierarchical and other.hierarchical)
        return attached or stacked


def fold(candidates: list[Region]) -> list[Region]:
    """Candidates one by one: each takes in the groups that it joins and goes last, and is not tested again.

    Only groups that hold one of its glyphs, that stand right before or behind it, or that lie level with it can be joined.
    """
    band = max([c.frame.y1 - c.frame.y0 for c in candidates], default=0.0) or 1.0
    placed = all(isfinite(y) for c in candidates for y in (c.frame.y0, c.frame.y1))
    levels = lambda frame: range(int(frame.y0 // band), int(frame.y1 // band) + 1) if placed else (0,)
    groups: dict[int, Region] = {}
    owner: dict[int, int] = {}
    level: dict[int, set[int]] = {}
    for number, new in enumerate(candidates):
        near = {owner[s] for s in new.glyphs if s in owner} | {owner[s] for s in (new.first - 1, new.last + 1) if s in owner}
        for k in levels(new.frame):
            near |= level.get(k, set())
        met = [g for g in sorted(near) if new.joins(groups[g])]
        if met:
            new = Region({**new.glyphs, **{s: x for g in met for s, x in groups[g].glyphs.items()}})
            for g in met:
                for k in levels(groups.pop(g).frame):
                    level[k].discard(g)
        groups[number] = new
        owner.update(dict.fromkeys(new.glyphs, number))
        for k in levels(new.frame):
            level.setdefault(k, set()).add(number)
    return sorted(groups.values(), key=lambda g: g.first)


def without_open_delimiters(glyphs: list[dict]) -> list[dict]:
    """Leading openers that nothing closes go."""
    text = "".join(g["u"] for g in glyphs)
    cut = 0
    while cut < len(glyphs) and (closer := PAIRS.get(glyphs[cut]["u"])) and text.count(glyphs[cut]["u"]) > text.count(closer):
        text = text[len(glyphs[cut]["u"]) :]
        cut += 1
    return glyphs[cut:]


def line_candidates(glyphs: list[dict], math_fonts: set[str]) -> list[Region]:
    """Maximal runs of seeds and atoms on a line that hold a seed; one word between two such runs links them if it is ``if`` or a bracket follows."""
    tokens: list[tuple[str, list[dict]]] = []
    for g in sorted(glyphs, key=lambda g: g["seq"]):
        k = kind(g["u"], g["font"] in math_fonts)
        if tokens and tokens[-1][0] == k and tokens[-1][1][-1]["span"] == g["span"]:
            tokens[-1][1].append(g)
        else:
            tokens.append((k, [g]))
    text = lambda t: "".join(g["u"] for g in t[1])
    marked = [t[0] in ("seed", "atom") for t in tokens]
    linked = [
        m or (0 < i < len(tokens) - 1 and tokens[i][0] == "prose" and marked[i - 1] and marked[i + 1] and (text(tokens[i]).casefold() == "if" or text(tokens[i + 1])[:1] == "("))
        for i, m in enumerate(marked)
    ]
    out, run = [], []
    for t, ok in [*zip(tokens, linked, strict=True), (("", []), False)]:
        if ok:
            run.append(t)
        else:
            if any(k == "seed" for k, _ in run):
                out.append(Region.of([g for _, gs in run for g in gs]))
            run = []
    return out


def annotations(glyphs: list[dict]) -> list[Region]:
    """A relation sign with smaller glyphs right above it, on another line of its block."""
    blocks: dict[int, list[dict]] = {}
    for g in glyphs:
        blocks.setdefault(g["block"], []).append(g)
    out = []
    for op in glyphs:
        if op["u"] not in ANNOTATED:
            continue
        reach = 0.25 * (op["x1"] - op["x0"])
        above = [
            g for g in blocks[op["block"]]
            if g["line"] != op["line"] and g["size"] < 0.8 * op["size"] and 0.1 * op["size"] < op["oy"] - g["oy"] <= op["size"]
            and op["x0"] - reach <= (g["x0"] + g["x1"]) / 2 <= op["x1"] + reach
        ]
        if above:
            out.append(Region.of([op, *above]))
    return out


def detect_page(glyphs: list[dict], math_fonts: set[str]) -> list[list[dict]]:
    """Glyphs of each region of a page, in the order of their first one."""
    lines: dict[tuple[int, int], list[dict]] = {}
    for g in glyphs:
        lines.setdefault((g["block"], g["line"]), []).append(g)
    return _trimmed([r for key in sorted(lines) for r in line_candidates(lines[key], math_fonts)] + annotations(glyphs))


def _trimmed(candidates: list[Region]) -> list[list[dict]]:
    trimmed = [without_open_delimiters([r.glyphs[s] for s in sorted(r.glyphs)]) for r in fold(candidates)]
    return [t for t in trimmed if t]


class _Kinds(dict):
    """By code point: the kind's first letter, of a glyph in no font of mathematics."""

    def __missing__(self, code: int) -> str:
        self[code] = found = kind(chr(code), False)[0]
        return found


_kinds = _Kinds()


@dataclass
class Page:
    """A page by columns, in the order of blocks, lines and glyphs; rows are made of those glyphs only that a region takes in."""

    text: str
    math: np.ndarray
    block: np.ndarray
    line: np.ndarray
    span: np.ndarray
    size: np.ndarray
    oy: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    row: Callable[[int], dict]


def detect_columns(page: Page) -> list[list[dict]]:
    """What ``detect_page`` gives of the same glyphs."""
    n = len(page.text)
    kinds = np.where(page.math, ord("s"), np.frombuffer(page.text.translate(_kinds).encode("ascii"), np.uint8))
    breaks = np.ones(n, bool)
    breaks[1:] = (np.diff(page.block) != 0) | (np.diff(page.line) != 0)
    begins = breaks.copy()
    begins[1:] |= (np.diff(kinds) != 0) | (np.diff(page.span) != 0)
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], n)
    of, new_line = kinds[at], breaks[at]
    seed = of == ord("s")
    linked = seed | (of == ord("a"))
    # A word between two such tokens of its line: if, or in front of a bracket.
    words = np.flatnonzero((of[1:-1] == ord("p")) & linked[:-2] & linked[2:] & ~new_line[1:-1] & ~new_line[2:]) + 1
    joined = [i for i in words.tolist() if page.text[ends[i]] == "(" or (ends[i] - at[i] <= 2 and page.text[at[i] : ends[i]].casefold() == "if")]
    linked[joined] = True
    starts = np.flatnonzero(linked & (new_line | ~np.append(False, linked[:-1])))
    stops = np.flatnonzero(linked & (np.append(new_line[1:], True) | ~np.append(linked[1:], False)))
    seeds = np.append(0, np.cumsum(seed))
    held = seeds[stops + 1] > seeds[starts]
    candidates = [Region.of([*map(page.row, range(a, b))]) for a, b in zip(at[starts[held]].tolist(), ends[stops[held]].tolist(), strict=True)]
    return _trimmed(candidates + _annotations(page))


def _annotations(page: Page) -> list[Region]:
    signs = sorted(i for sign in ANNOTATED if sign in page.text for i, u in enumerate(page.text) if u == sign)
    if not signs:
        return []
    small = np.flatnonzero(page.size < 0.8 * page.size[signs].max())
    block, line, size, oy, middle = page.block[small], page.line[small], page.size[small], page.oy[small], (page.x0[small] + page.x1[small]) / 2
    out = []
    for i in signs:
        own, reach = page.size[i], 0.25 * (page.x1[i] - page.x0[i])
        up = page.oy[i] - oy
        above = (block == page.block[i]) & (line != page.line[i]) & (size < 0.8 * own) & (0.1 * own < up) & (up <= own) & (page.x0[i] - reach <= middle) & (middle <= page.x1[i] + reach)
        if above.any():
            out.append(Region.of([page.row(i), *map(page.row, small[above].tolist())]))
    return out


def detect_held(rows: DataFrame, page_of: Callable[..., Page], key: str, number: int = 1) -> DataFrame:
    """What ``detect`` gives where a row holds a whole page: ``page_of`` makes it of the row's other columns. Nothing is shuffled."""
    columns = [c for c in rows.columns if c != key]
    kinds = {"region_id": pa.string(), "seqs": pa.list_(pa.int64()), "text": pa.string(), "x0": pa.float64(), "y0": pa.float64(), "x1": pa.float64(), "y1": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, glyphs = [], [], 0
            for k in range(len(batch)):
                for region in detect_columns(page_of(*[batch[c][k].as_py() for c in columns])):
                    f = Frame.around(region)
                    at.append(k)
                    out.append((f"{number}:{region[0]['seq']}", [g["seq"] for g in region], "".join(g["u"] for g in region), f.x0, f.y0, f.x1, f.y1))
                    glyphs += len(region)
                if glyphs > GLYPHS or k == len(batch) - 1:
                    told = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(at, pa.int32())), pa.array([number] * len(at), pa.int64()), *told], [key, "page", *kinds])
                    at, out, glyphs = [], [], 0

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, page long, region_id string, seqs array<long>, text string, x0 double, y0 double, x1 double, y1 double")


def detect(glyphs: DataFrame, math_fonts: list[str], keys: str = "doc_id long, page long") -> DataFrame:
    """Regions per page: keys, region_id (page:first seq), seqs, text, x0, y0, x1, y1."""
    names = [k.split()[0] for k in keys.split(", ")]
    fonts = set(math_fonts)
    columns = [*names, "region_id", "seqs", "text", "x0", "y0", "x1", "y1"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        at = [group[n].iloc[0] for n in names]
        for region in detect_page(group.to_dict("records"), fonts):
            f = Frame.around(region)
            rows.append((*at, f"{at[-1]}:{region[0]['seq']}", [g["seq"] for g in region], "".join(g["u"] for g in region), f.x0, f.y0, f.x1, f.y1))
        return pd.DataFrame(rows, columns=columns)

    return glyphs.groupBy(*names).applyInPandas(run, f"{keys}, region_id string, seqs array<long>, text string, x0 double, y0 double, x1 double, y1 double")


def clusters(values: list[float], tolerance: float) -> list[list[int]]:
    """Places of values in rising order, in clusters: one joins the last cluster while it lies within the tolerance of its median."""
    out: list[list[int]] = []
    for i in sorted(range(len(values)), key=lambda i: (values[i], i)):
        if out and abs(values[i] - median(values[j] for j in out[-1])) <= tolerance:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def signature(glyphs: list[dict]) -> tuple[list[str] | None, str | None]:
    """The relation signature of a line with scripts, or a reason.

    The baseline is the one cluster of the largest glyphs. Smaller or shifted glyphs hang below or above the last baseline glyph that
    starts before them; what stands right above a relation sign is set over it. Scripts are read the same way.
    """
    glyphs = [g for g in glyphs if not g["u"].isspace()]
    if not glyphs:
        return [], None
    size = max(g["size"] for g in glyphs)
    large = [g for g in glyphs if g["size"] >= 0.8 * size]
    groups = clusters([g["oy"] for g in large], 0.1 * size)
    ranked = sorted(groups, key=len, reverse=True)
    if len(ranked) > 1 and len(ranked[0]) == len(ranked[1]):
        return None, "source_baseline_ambiguous"
    base = sorted((large[i] for i in ranked[0]), key=lambda g: (g["x0"], g["seq"]))
    y = median(g["oy"] for g in base)
    taken = {g["seq"] for g in base}
    hung: dict[tuple[int, str], list[dict]] = {}
    for g in glyphs:
        if g["seq"] in taken:
            continue
        over = next((b for b in base if b["u"] in ANNOTATED and 0.1 * size < y - g["oy"] <= b["size"] and b["x0"] - 0.25 * (b["x1"] - b["x0"]) <= (g["x0"] + g["x1"]) / 2 <= b["x1"] + 0.25 * (b["x1"] - b["x0"])), None)
        if over:
            hung.setdefault((over["seq"], "over"), []).append(g)
            continue
        shift = g["oy"] - y
        shifted = abs(shift) >= (0.05 if g["size"] < 0.8 * size else 0.1) * size
        if not shifted or abs(shift) > 1.5 * size:
            return None, "source_script_position_ambiguous"
        before = [b for b in base if b["x0"] <= g["x0"] and g["x0"] - b["x1"] <= 2 * size]
        if not before:
            return None, "source_script_anchor_missing"
        hung.setdefault((before[-1]["seq"], "sub" if shift > 0 else "sup"), []).append(g)
    out: list[str] = []
    for b in base:
        out += [EQUIVALENT.get(c, c) for c in b["u"]]
        for role in ("over", "sub", "sup"):
            if (b["seq"], role) in hung:
                inner, reason = signature(hung[b["seq"], role])
                if inner is None:
                    return None, reason
                out += [f"<{role}>", *inner, f"</{role}>"]
    return out, None
