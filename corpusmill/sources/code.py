"""Skeletons and symbols of brace languages, by a scanner that knows strings, comments, characters and lifetimes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`|'(?:[^'\\\n]|\\[^\n]{1,8})'|[{}]|;")
_FUNCTION = re.compile(r"(?:\b(?:fn|func|function)\b|\)\s*(?:const|override|noexcept|throws [\w., ]+|->\s*[^{;]+|:\s*[^{;=]+)?\s*$|=>\s*$)")
_CONTROL = re.compile(r"\b(?:if|for|while|switch|catch|match|else|do|try|loop|synchronized|select)\b[^{};]*$")
_IMPL = re.compile(r"(?:^|\n|\s)(?:unsafe\s+)?impl\b[^{};]*$")
_ITEM = re.compile(r"\b(struct|enum|trait)\s+(\w+)")
ELIDED = "{ /* body elided */ }"


def _blocks(text: str) -> list[tuple[str, int, int]]:
    """(head, open, close) of each outermost function or impl block."""
    out: list[tuple[str, int, int]] = []
    depth, start, head_at, opened = 0, -1, 0, 0
    head = ""
    for m in _SKIP.finditer(text):
        c = m[0]
        if c == "{":
            if start < 0:
                head = text[head_at : m.start()]
                plain = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", "", head)
                if _IMPL.search(plain) or (_FUNCTION.search(plain) and not _CONTROL.search(plain)):
                    start, opened = m.start(), depth
            depth += 1
            head_at = m.end()
        elif c == "}":
            depth -= 1
            if start >= 0 and depth == opened:
                out.append((head, start, m.end()))
                start = -1
            head_at = m.end()
        elif c == ";":
            head_at = m.end()
    return out


def skeleton_text(text: str) -> str:
    """Bodies of functions and impls elided; everything else as it is."""
    parts, at = [], 0
    for _, a, b in _blocks(text):
        parts += [text[at:a], ELIDED]
        at = b
    return "".join(parts) + text[at:]


def symbol_lines(text: str, order: str = "source") -> list[str]:
    """Signatures of functions and heads of types; methods of an impl are indented. `reference` order is last first."""
    found: list[tuple[int, list[str]]] = []
    taken = []
    for head, a, b in _blocks(text):
        sign = " ".join(re.sub(r"//[^\n]*|/\*[\s\S]*?\*/|#\[[^\]]*\]", "", head).split())
        if _IMPL.search(" " + sign):
            inner = [" ".join(h.split()) for h, _, _ in _blocks(text[a + 1 : b - 1])]
            found.append((a, [f"{sign} {{ ... }}", *(f"  {x}" for x in inner)]))
        else:
            found.append((a, [sign]))
        taken.append((a, b))
    for m in _ITEM.finditer(re.sub(r"//[^\n]*", lambda c: " " * len(c[0]), text)):
        if not any(a < m.start() < b for a, b in taken):
            found.append((m.start(), [f"{m[1]} {m[2]} {{ ... }}"]))
    groups = [lines for _, lines in sorted(found, key=lambda x: x[0])]
    return [x for g in (reversed(groups) if order == "reference" else groups) for x in g]


@F.pandas_udf(StringType())
def skeleton(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(skeleton_text, na_action="ignore")


@F.pandas_udf(StringType())
def symbols(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: "\n".join(symbol_lines(t)), na_action="ignore")
