"""Relation signatures of regions with rules: fractions, radicals with stacked sums, and operators with bounds."""

from __future__ import annotations

from .geometry_frames import Frame
from .layout import STACKED, signature

Result = tuple[list[str] | None, str | None]


def _middle(g: dict) -> float:
    return (g["x0"] + g["x1"]) / 2


def _wrapped(parts: list[tuple[str | None, list[str]]]) -> list[str]:
    out: list[str] = []
    for name, inner in parts:
        out += [f"<{name}>", *inner, f"</{name}>"] if name else inner
    return out


def _all(*results: Result) -> str | None:
    """The first reason among results."""
    return next((reason for inner, reason in results if inner is None), None)


def fraction(glyphs: list[dict], rule: dict) -> Result:
    """What the rule spans is split by it into numerator and denominator; the rest stands left or right of it."""
    slack = max(0.5, rule["width"])
    spanned = [g for g in glyphs if rule["x0"] - slack <= _middle(g) <= rule["x1"] + slack]
    above, below = [g for g in spanned if g["y1"] <= rule["y"] + slack], [g for g in spanned if g["y0"] >= rule["y"] - slack]
    if not above or not below or len(above) + len(below) != len(spanned):
        return None, "source_fraction_rule_ambiguous"
    frame = Frame.around(spanned)
    if rule["x0"] > frame.x0 + slack or rule["x1"] < frame.x1 - slack:
        return None, "source_fraction_rule_too_short"
    if rule["x0"] < frame.x0 - 4 * slack or rule["x1"] > frame.x1 + 4 * slack:
        return None, "source_fraction_rule_too_long"
    inside = {g["seq"] for g in spanned}
    sides = [[g for g in glyphs if g["seq"] not in inside and (_middle(g) < rule["x0"]) == left] for left in (True, False)]
    read = [signature(part) for part in (sides[0], above, below, sides[1])]
    if reason := _all(*read):
        return None, reason
    left, top, bottom, right = [r[0] for r in read]
    return left + _wrapped([("fraction", _wrapped([("numerator", top), ("denominator", bottom)]))]) + right, None


def bounded(glyphs: list[dict], operator: dict) -> Result:
    """An operator, bounds below and above it before the expression begins, and what stands left of it."""
    left = [g for g in glyphs if g["x1"] <= operator["x0"]]
    rest = [g for g in glyphs if g["seq"] != operator["seq"] and g["x1"] > operator["x0"]]
    lower, upper = [g for g in rest if g["y0"] >= operator["y1"]], [g for g in rest if g["y1"] <= operator["y0"]]
    taken = {g["seq"] for g in lower + upper}
    body = [g for g in rest if g["seq"] not in taken]
    if any(g["x0"] < operator["x1"] and g["x1"] > operator["x0"] for g in body):
        return None, "source_stacked_operator_ambiguous"
    read = [signature(part) for part in (left, lower, upper, body)]
    if reason := _all(*read):
        return None, reason
    before, low, high, after = [r[0] for r in read]
    return before + [operator["u"]] + _wrapped([(n, x) for n, x in (("sub", low), ("sup", high)) if x]) + after, None


def radical(glyphs: list[dict], sign: dict, rule: dict | None) -> Result:
    """What lies under the rule of a radical is its radicand, what follows stands behind it."""
    if rule is None:
        return None, "source_radical_rule_missing"
    content = [g for g in glyphs if g["seq"] != sign["seq"] and g["x0"] >= sign["x0"]]
    before = [g for g in glyphs if g["seq"] != sign["seq"] and g["x0"] < sign["x0"]]
    if any(g["x0"] < rule["x1"] < g["x1"] - rule["width"] - 0.5 for g in content):
        return None, "source_radical_scope_ambiguous"
    under, behind = [g for g in content if g["x0"] < rule["x1"]], [g for g in content if g["x0"] >= rule["x1"]]
    if not under:
        return None, "source_radical_scope_ambiguous"
    operators = [g for g in under if g.get("name") in STACKED]
    if len(operators) > 1:
        return None, "source_stacked_operator_ambiguous"
    read = [signature(before), bounded(under, operators[0]) if operators else signature(under), signature(behind)]
    if reason := _all(*read):
        return None, reason
    head, inner, tail = [r[0] for r in read]
    return head + ["√"] + _wrapped([("radicand", inner)]) + tail, None


def expression(glyphs: list[dict], rules: list[dict]) -> Result:
    """Dispatch: one radical sign, one fraction rule, one stacked operator, or none of them; several are ambiguous."""
    signs = [g for g in glyphs if g["u"] == "√"]
    if len(signs) > 1:
        return None, "source_stacked_operator_ambiguous"
    if signs:
        own = [r for r in rules if abs(r["x0"] - signs[0]["x1"]) <= 1.5]
        return radical(glyphs, signs[0], own[0] if len(own) == 1 else None)
    if len(rules) > 1:
        return None, "source_fraction_rule_ambiguous"
    if rules:
        return fraction(glyphs, rules[0])
    operators = [g for g in glyphs if g.get("name") in STACKED]
    if len(operators) > 1:
        return None, "source_stacked_operator_ambiguous"
    return bounded(glyphs, operators[0]) if operators else signature(glyphs)
