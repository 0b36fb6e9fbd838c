"""A subset of LaTeX read into tokens and a relation signature, and written back from a signature.

A signature is the flat list of tokens with paired markers for relations. What the subset doesn't hold gives a typed reason,
never a guess.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Commands and the characters that they stand for.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ",
    "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "ϕ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "propto": "∝", "in": "∈", "notin": "∉", "subset": "⊂",
    "subseteq": "⊆", "cup": "∪", "cap": "∩", "emptyset": "∅", "forall": "∀", "exists": "∃", "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑", "prod": "∏", "int": "∫",
    "times": "×", "cdot": "⋅", "pm": "±", "mp": "∓", "div": "÷", "ast": "∗", "star": "⋆", "circ": "∘", "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒",
    "Leftrightarrow": "⇔", "mapsto": "↦", "ldots": "...", "dots": "...", "cdots": "⋯", "mid": "∣", "langle": "⟨", "rangle": "⟩", "lVert": "‖", "rVert": "‖", "prime": "′",
    "ell": "ℓ", "Re": "ℜ", "Im": "ℑ", "log": "log", "exp": "exp", "max": "max", "min": "min", "lim": "lim", "sin": "sin", "cos": "cos", "tan": "tan", "ln": "ln", "arg": "arg",
}
# Characters that count as others, and blanks of LaTeX.
EQUIVALENT = {"-": "−", "*": "∗", "…": "..."}
BLANKS = {"quad", "qquad", ",", ";", ":", "!", " "}
TEXT = {"text", "mathrm", "operatorname", "mathit", "textrm", "mathsf"}
BOLD = {"mathbf", "boldsymbol", "textbf", "bm"}
MARKERS = {"sub", "sup", "over", "bold", "radicand", "fraction", "numerator", "denominator"}
_LEX = re.compile(r"\\(?:[A-Za-z]+|.)|[{}_^$~&]|\s+|.", re.DOTALL)


class Refused(ValueError):
    """A candidate outside the subset; ``code`` is the reason."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


INVALID, RELATION, COMMAND, UNSUPPORTED, MIXED = (f"candidate_{x}" for x in ("latex_invalid", "relation_invalid", "command_unsupported", "relation_unsupported", "mixed_text_invalid"))


def is_bold(character: str) -> bool:
    return "BOLD" in unicodedata.name(character, "").split() and unicodedata.name(character).startswith("MATHEMATICAL ")


def plain(text: str) -> list[str]:
    """Characters as tokens: bold letters as plain ones, the rest composed, equivalents put in, blanks left out."""
    folded = "".join(unicodedata.normalize("NFKC", c) if is_bold(c) else c for c in text)
    return [EQUIVALENT.get(c, c) for c in unicodedata.normalize("NFC", folded) if not c.isspace()]


def _marked(name: str, inner: list[str]) -> list[str]:
    return [f"<{name}>", *inner, f"</{name}>"]


class _Reader:
    """Reads a row of atoms; each gives its signature."""

    def __init__(self, latex: str) -> None:
        self.lexemes = [x for x in _LEX.findall(latex)]
        self.at = 0

    def peek(self) -> str | None:
        while self.at < len(self.lexemes) and self.lexemes[self.at].isspace():
            self.at += 1
        return self.lexemes[self.at] if self.at < len(self.lexemes) else None

    def take(self) -> str:
        lexeme = self.peek()
        if lexeme is None:
            raise Refused(RELATION)
        self.at += 1
        return lexeme

    def row(self, closing: str | None) -> list[str]:
        out: list[str] = []
        while (lexeme := self.peek()) != closing:
            if lexeme is None or lexeme == "}":
                raise Refused(INVALID)
            out += self.scripted()
        if closing:
            self.take()
        return out

    def scripted(self) -> list[str]:
        base = [] if self.peek() in ("_", "^") else self.atom()
        scripts: dict[str, list[str]] = {}
        while (mark := self.peek()) in ("_", "^"):
            self.take()
            name = "sub" if mark == "_" else "sup"
            if name in scripts:
                raise Refused(INVALID)
            scripts[name] = self.argument()
        for name in ("sub", "sup"):
            if name in scripts:
                base = base + _marked(name, scripts[name])
        return base

    def argument(self) -> list[str]:
        if self.peek() in (None, "}"):
            raise Refused(RELATION)
        return self.atom()

    def raw(self) -> str:
        """The text of a group, as it stands."""
        if self.take() != "{":
            return self.lexemes[self.at - 1]
        depth, out = 1, []
        while True:
            if self.at >= len(self.lexemes):
                raise Refused(INVALID)
            lexeme = self.lexemes[self.at]
            self.at += 1
            depth += (lexeme == "{") - (lexeme == "}")
            if not depth:
                return "".join(out)
            out.append(lexeme[1:] if len(lexeme) == 2 and lexeme[0] == "\\" and not lexeme[1].isalpha() else lexeme)

    def atom(self) -> list[str]:
        lexeme = self.take()
        if lexeme == "{":
            return self.row("}")
        if lexeme in ("~", "&"):
            return []
        if lexeme == "$" or lexeme in ("_", "^", "}"):
            raise Refused(INVALID)
        if lexeme[0] != "\\" or len(lexeme) == 1:
            return _marked("bold", plain(lexeme)) if is_bold(lexeme) else plain(lexeme)
        name = lexeme[1:]
        if name in BLANKS or name == "\\":
            return []
        if name in SYMBOLS:
            return [SYMBOLS[name]] if SYMBOLS[name] == "..." else list(SYMBOLS[name])
        if name in ("frac", "dfrac", "tfrac"):
            top, bottom = self.argument(), self.argument()
            return _marked("fraction", _marked("numerator", top) + _marked("denominator", bottom))
        if name == "sqrt":
            if self.peek() == "[":
                raise Refused(UNSUPPORTED)
            inner = self.argument()
            if not inner:
                raise Refused(RELATION)
            return ["√", *_marked("radicand", inner)]
        if name in ("stackrel", "overset"):
            top = self.argument()
            return self.argument() + _marked("over", top)
        if name in ("hat", "bar", "tilde", "vec", "overline"):
            return self.argument() + _marked("over", {"hat": ["^"], "bar": ["¯"], "tilde": ["~"], "vec": ["→"], "overline": ["¯"]}[name])
        if name in TEXT:
            return plain(self.raw())
        if name in BOLD:
            return _marked("bold", self.argument())
        if name in ("left", "right"):
            mark = self.take()
            return [] if mark == "." else plain(mark[1:] if mark[0] == "\\" and len(mark) == 2 else mark) if mark[1:] not in SYMBOLS else list(SYMBOLS[mark[1:]])
        if not name[0].isalpha():
            return plain(name)
        raise Refused(UNSUPPORTED if name in ("begin", "underset", "underbrace", "overbrace") else COMMAND)


def _joined(signature: list[str]) -> list[str]:
    """Neighbouring bold runs as one; texts between markers composed."""
    out: list[str] = []
    for token in signature:
        if token == "<bold>" and out and out[-1] == "</bold>":
            out.pop()
        else:
            out.append(token)
    return out


_SCRIPT = re.compile(r"\s*([_^])\{(.*)\}\s*", re.DOTALL)


def escaped(text: str) -> str:
    """Braces, underscores and percent signs behind a backslash, unless they are already."""
    return re.sub(r"(\\.)|([{}_%])", lambda m: m[1] or "\\" + m[2], text, flags=re.DOTALL)


def from_mixed(text: str) -> str:
    """Text with formulas between dollars as one formula; neighbouring scripts of one kind are one script."""
    parts = text.split("$")
    if len(parts) % 2 == 0:
        raise Refused(MIXED)
    pieces: list[tuple[str, str]] = []  # (kind, text): kind _ or ^ for a script, else empty
    for i, part in enumerate(parts):
        script = _SCRIPT.fullmatch(part) if i % 2 else None
        if script:
            if not script[2].strip():
                raise Refused(MIXED)
            if pieces and pieces[-1][0] == script[1]:
                pieces[-1] = (script[1], pieces[-1][1] + script[2])
            else:
                pieces.append((script[1], script[2]))
        elif i % 2:
            pieces.append(("", part))
        elif part.strip():
            pieces.append(("", escaped(part)))
    return "".join(f"{kind}{{{text}}}" if kind else text for kind, text in pieces)


@lru_cache(maxsize=4096)
def analyse(candidate: str, kind: str = "latex") -> tuple[list[str] | None, list[str] | None, str | None]:
    """Tokens, signature, reason. A blank candidate has neither tokens nor a reason."""
    if not candidate.strip():
        return [], [], None
    try:
        signature = _joined(_Reader(from_mixed(candidate) if kind == "mixed_text" else candidate).row(None))
    except Refused as refused:
        return None, None, refused.code
    except RecursionError:
        return None, None, INVALID
    return [t for t in signature if not is_marker(t)], signature, None


def is_marker(token: str) -> bool:
    return len(token) > 2 and token[0] == "<" and token[-1] == ">" and token.strip("</>") in MARKERS


@lru_cache(maxsize=1)
def _commands() -> dict[str, str]:
    """The shortest command for each character, then the first by name."""
    best: dict[str, str] = {}
    for name, value in SYMBOLS.items():
        if len(value) == 1 and (value not in best or (len(name), name) < (len(best[value]), best[value])):
            best[value] = name
    return best


def _written(token: str) -> str:
    if token == "...":
        return r"\dots "
    back = {v: k for k, v in EQUIVALENT.items()}
    if token in back:
        return back[token]
    if len(token) == 1 and token.isascii() and not token.isspace() and token not in "^~\\":
        return "\\" + token if token in "#$%&_{}" else token
    if token in _commands():
        return "\\" + _commands()[token] + " "
    raise Refused("source_symbol_unsupported")


def serialise(signature: list[str]) -> str:
    """LaTeX of a signature."""
    at = 0

    def inside(name: str | None) -> str:
        nonlocal at
        out: list[str] = []
        while at < len(signature):
            token = signature[at]
            at += 1
            if token == f"</{name}>":
                return "".join(out)
            if not is_marker(token):
                if token == "√":
                    if at >= len(signature) or signature[at] != "<radicand>":
                        raise Refused("source_relation_unbalanced")
                    at += 1
                    out.append(rf"\sqrt{{{inside('radicand')}}}")
                else:
                    out.append(_written(token))
                continue
            kind = token[1:-1]
            if kind in ("sub", "sup"):
                out.append(("_" if kind == "sub" else "^") + f"{{{inside(kind)}}}")
            elif kind == "bold":
                out.append(rf"\mathbf{{{inside(kind)}}}")
            elif kind == "over":
                if not out:
                    raise Refused("source_relation_unbalanced")
                out.append(rf"\stackrel{{{inside(kind)}}}{{{out.pop()}}}")
            elif kind == "fraction" and signature[at : at + 1] == ["<numerator>"]:
                at += 1
                top = inside("numerator")
                if signature[at : at + 1] != ["<denominator>"]:
                    raise Refused("source_relation_unbalanced")
                at += 1
                bottom = inside("denominator")
                if signature[at : at + 1] != ["</fraction>"]:
                    raise Refused("source_relation_unbalanced")
                at += 1
                out.append(rf"\frac{{{top}}}{{{bottom}}}")
            else:
                raise Refused("source_relation_unbalanced")
        if name:
            raise Refused("source_relation_unbalanced")
        return "".join(out)

    return inside(None)


def proven(tokens: list[str], signature: list[str]) -> tuple[str | None, str | None]:
    """LaTeX whose analysis gives exactly these tokens and this signature, or a reason."""
    try:
        latex = serialise(signature)
    except Refused as refused:
        return None, refused.code
    got = analyse(latex)
    return (latex, None) if got == (list(tokens), list(signature), None) else (None, "source_round_trip_unproven")


ANALYSIS = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("signature", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())])


@F.pandas_udf(ANALYSIS)
def analyse_udf(candidates: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    rows = [analyse(c or "", k or "latex") for c, k in zip(candidates, kinds, strict=True)]
    return pd.DataFrame(rows, columns=["tokens", "signature", "reason"])


@F.pandas_udf(T.StringType())
def proven_udf(tokens: pd.Series, signatures: pd.Series) -> pd.Series:
    return pd.Series([proven(list(t), list(s))[0] if t is not None and s is not None else None for t, s in zip(tokens, signatures, strict=True)], dtype=object)
