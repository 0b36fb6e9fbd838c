"""Predicates and rewrites of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of mathematical syntax, a bare relation, and a run of four or more lone letters.
SYNTAX = r"[+*/^_{}()\[\]\\]"
RELATION = r"^\S+\s*[<>=]\s*\S+$"
LONE_LETTERS = r"(^|\s)\p{L}(\s\p{L}){3,}(\s|$)"
# A character's equivalent in candidate texts.
EQUIVALENTS = {"-": "−", "*": "∗", "'": "′"}
# Characters that alignment skips.
IGNORED = "$_^{}"


def has_math_symbol(text: Column) -> Column:
    return text.rlike(r"\p{Sm}")


def has_control(text: Column) -> Column:
    return text.rlike(r"[\p{Cc}\p{Cs}]")


def short_variable(text: Column) -> Column:
    """One or two letters, commas aside."""
    return F.replace(text, F.lit(","), F.lit("")).rlike(r"^\p{L}{1,2}$")


def carries_inline_math(label: Column, layer: Column) -> Column:
    """Text of the body that is neither code nor a formula; a missing layer is the body."""
    return ~F.coalesce(label, F.lit("")).isin("code", "formula") & (F.coalesce(layer, F.lit("body")) == "body")


def unambiguous_math(latex: Column) -> Column:
    """Starts with a command or group, is a relation, holds a sign of syntax, or is one token that isn't a word."""
    bare = F.regexp_replace(latex, r"^(?U)\s+|(?U)\s+$", "")
    told = bare.startswith("\\") | bare.startswith("{") | bare.rlike(RELATION) | bare.rlike(SYNTAX)
    return (bare != "") & (told | (~bare.rlike(r"(?U)\s") & ~bare.rlike(r"^\p{L}{2,}$")))


def spaced_letters(latex: Column) -> Column:
    """Four or more lone letters in a row, the word ``d e f`` aside: prose that was set as mathematics."""
    return F.regexp_replace(latex, r"\bd e f\b", "").rlike(LONE_LETTERS)


def operator_names(latex: Column) -> Column:
    return F.regexp_replace(latex, r"\\arg\b", r"\\operatorname{arg}")


def delimiters_balanced(text: Column) -> Column:
    """Whether ( ) and [ ] nest."""
    signs = F.regexp_replace(text, r"[^()\[\]]", "")
    # Adjacent pairs vanish; each pass takes every innermost pair, so nesting of 32 is settled.
    for _ in range(32):
        signs = F.regexp_replace(signs, r"\(\)|\[\]", "")
    return signs == ""


def code_points(text: Column) -> Column:
    """``U+XXXX`` of each character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.concat(F.lit("U+"), F.when(F.ascii(c) < 4096, F.lpad(F.hex(F.ascii(c)), 4, "0")).otherwise(F.hex(F.ascii(c)))))


def font_family(name: Column) -> Column:
    """Without a slash in front or a subset prefix, at most 24 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"^/", ""), r"^[A-Z]{3,6}\+", ""), 1, 24)


def safe_id(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9_.-]", "_")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)


def valid_sha256(value: Column) -> Column:
    """In lower case if it has 64 hex digits, else null."""
    return F.when(value.rlike(r"^[0-9A-Fa-f]{64}$"), F.lower(value))


def literal_characters(text: Column) -> Column:
    """Characters with their places that alignment looks at, each as its equivalent."""
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("u"), i.alias("at")))
    kept = F.filter(chars, lambda g: (g["u"] != "") & ~g["u"].rlike(r"(?U)^\s$") & ~g["u"].isin(*IGNORED))
    return F.transform(kept, lambda g: F.struct(F.translate(g["u"], "".join(EQUIVALENTS), "".join(EQUIVALENTS.values())).alias("u"), g["at"].alias("at")))


def collapsed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def fact_state(text: Column, required: list[str], rejected: list[str]) -> Column:
    """REJECTED if a forbidden part is there, MATCH if all required ones are, else NOT_PROVEN."""
    has = lambda part: F.contains(text, F.lit(part))
    bad, good = F.lit(False), F.lit(True)
    for part in rejected:
        bad = bad | has(part)
    for part in required:
        good = good & has(part)
    return F.when(bad, "REJECTED").when(good, "MATCH").otherwise("NOT_PROVEN")


def assertions_covered(relations: Column, expected: Column, observed: Column) -> Column:
    """Every assertion is a ``sequence`` whose expected text is the observed one, ``,.;`` at its end aside."""
    bare = F.regexp_replace(observed, r"[,.;]+$", "")
    return F.forall(F.arrays_zip(relations.alias("r"), expected.alias("e")), lambda a: (a["r"] == "sequence") & (a["e"] == bare))


def escaped_places(text: Column, character: str) -> Column:
    """Places, from 0, of a character with an even number of backslashes before it."""
    # Cut in front of each of them: the backslashes before one end the piece before it.
    pieces = F.split(text, f"(?=\\Q{character}\\E)")
    held = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))

    def put(so: Column, piece: Column) -> Column:
        at = so["at"] + F.length(piece)
        even = F.length(F.regexp_extract(piece, r"(\\*)$", 1)) % 2 == 0
        return F.struct(at.alias("at"), F.when(even & (at < F.length(text)), F.array_append(so["places"], at)).otherwise(so["places"]).alias("places"))

    first = F.when(F.startswith(text, F.lit(character)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.concat(first, F.aggregate(pieces, held, put)["places"])
