"""Text compression at three levels, as column expressions where they can be, else Arrow UDFs. Null stays null."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BRACE_LANGUAGES = ("rust", "rs", "js", "ts", "c", "cpp", "java", "go")
HASH_LANGUAGES = ("python", "py", "yaml", "yml")


def fold_whitespace(text: Column) -> Column:
    """Blanks and tabs at both ends of every line go."""
    return F.regexp_replace(text, r"(?md)^[ \t]+|[ \t]+$", "")


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip_hash_comments(text: Column) -> Column:
    """Lines that begin with # become empty; blanks at the end go."""
    return F.regexp_replace(F.regexp_replace(text, r"(?md)^[^\S\n]*#.*$", ""), r"(?U)\s+$", "")


_BRACE = re.compile(r'"(?:[^"\\]|\\.)*"|r#*.*#*|///[^\n]*|//[^\n]*|/\*[\s\S]*?\*/', re.M)


def brace_comments(text: str | None) -> str | None:
    """Without // and /* */ comments; /// stays, as do strings and what follows a raw string's sign on its line."""
    if text is None:
        return None
    kept = _BRACE.sub(lambda m: "" if m[0].startswith("/*") or (m[0].startswith("//") and not m[0].startswith("///")) else m[0], text)
    return kept.replace("\n \n", "\n\n")


@F.pandas_udf(StringType())
def strip_brace_comments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(brace_comments, na_action="ignore")


def minified_json(text: str | None) -> str | None:
    """JSON without blanks; anything else as it is."""
    if text is None or text.strip()[:1] not in ("{", "["):
        return text
    try:
        return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


@F.pandas_udf(StringType())
def minify_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(minified_json, na_action="ignore")


def minify_html(text: Column) -> Column:
    """Comments and blanks between tags go, if the text is HTML."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r">\s+<", "><")
    return F.when(F.ltrim(text).startswith("<"), out).otherwise(text)


def stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def prune_stop_words(text: Column, words: list[str] | None = None) -> Column:
    """Words other than stop words, by single blanks; the text as it is if none would stay."""
    stop = F.array(*(F.lit(w) for w in (stop_words() if words is None else words)))
    clean = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    kept = F.filter(F.split(text, r"(?U)\s+"), lambda w: (w != "") & ~F.array_contains(stop, clean(w)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(text)


def compress(text: Column, level: str, language: str | None = None) -> Column:
    """`safe`, `contextual` (with comments of a known language and JSON) or `aggressive` (stop words too)."""
    text = fold_newlines(fold_whitespace(text))
    if level in ("contextual", "aggressive"):
        if language in BRACE_LANGUAGES:
            text = strip_brace_comments(text)
        elif language in HASH_LANGUAGES:
            text = strip_hash_comments(text)
        text = minify_html(minify_json(text))
    return prune_stop_words(text) if level == "aggressive" else text


_FENCE = re.compile(r"(?m)^ {0,3}(`{3,}|~{3,})([^\n`]*)\n([\s\S]*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)")


def split_fences(text: str) -> list[tuple[str | None, str]]:
    """(language, text) of each stretch of Markdown; None for prose. A fence that is not closed goes to the end."""
    out, at = [], 0
    for m in _FENCE.finditer(text):
        out += [(None, text[at : m.start(3)]), (m[2].strip(), m[3])]
        at = m.end(3)
    return [*out, (None, text[at:])]


def compressed_code(text: str, level: str, language: str, stop: frozenset[str]) -> str:
    """What `compress` makes of one text of a known language."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^[ \t]+|[ \t]+$", "", text))
    if level == "safe":
        return text
    if language in BRACE_LANGUAGES:
        text = brace_comments(text)
    elif language in HASH_LANGUAGES:
        text = re.sub(r"(?m)^[^\S\n]*#.*$", "", text).rstrip()
    text = minified_json(text)
    if text.lstrip(" ").startswith("<"):
        text = re.sub(r">\s+<", "><", re.sub(r"(?s)<!--.*?-->", "", text))
    if level == "aggressive":
        kept = [w for w in text.split() if re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) not in stop]
        text = " ".join(kept) if kept else text
    return text


def compress_markdown(text: Column, level: str) -> Column:
    """`compress` for Markdown: text in fences by the fence's language, then all of it once more as prose. Markdown is not
    written anew, so its marks stay as they were. Text without a fence takes no Python."""
    stop = frozenset(stop_words())

    @F.pandas_udf(StringType())
    def fenced(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: "".join(x if lang is None else _ended(compressed_code(x, level, lang, stop), x) for lang, x in split_fences(t)), na_action="ignore")

    if level == "safe":  # folding again changes nothing
        return compress(text, level)
    has = text.rlike(r"(?m)^ {0,3}(?:```|~~~)")
    return compress(F.when(has, fenced(F.when(has, text))).otherwise(text), level)


def _ended(code: str, before: str) -> str:
    """The fence's end stays on a line of its own."""
    return code + "\n" if before.endswith("\n") and not code.endswith("\n") else code
