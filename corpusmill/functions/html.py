"""HTML: predicates, extraction and Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that go with their content, by default and when the full page is wanted (fixed values).
STRIPPED = ("script", "style", "nav", "svg", "noscript", "iframe", "header")
STRIPPED_FULL = ("script", "style", "svg", "noscript", "iframe")


def auth_wall(html: Column) -> Column:
    low = F.lower(html)
    return low.contains("accounts.google.com") | (low.contains("sign in") & (low.contains("google") | low.contains("gemini")))


def word_count(html: Column) -> Column:
    words = F.split(F.regexp_replace(html, r"(?s)<[^>]*(>|$)", " "), r"\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def js_shell(html: Column) -> Column:
    """Hardly a word beside scripts."""
    return (word_count(html) < 10) & html.contains("<script")


def strip_tags(html: Column, full: bool = False) -> Column:
    for tag in STRIPPED_FULL if full else STRIPPED:
        html = F.regexp_replace(html, f"(?s)<{tag}.*?</{tag}>", "")
    return html


def main_content(html: Column) -> Column:
    """The inside of <main>, else of <article>, else all."""
    out = html
    for tag in ("article", "main"):
        inside = F.regexp_extract(html, f"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
        out = F.when(html.rlike(f"(?s)<{tag}[^>]*>.*?</{tag}>"), inside).otherwise(out)
    return out


def flatten_links(html: Column) -> Column:
    return F.replace(F.regexp_replace(html, "<a [^>]*>", ""), F.lit("</a>"), F.lit(""))


def repair_lists(html: Column) -> Column:
    for tag in ("ol", "ul"):
        html = F.replace(F.replace(html, F.lit(f"</li>\n<{tag}"), F.lit(f"<{tag}")), F.lit(f"</li><{tag}"), F.lit(f"<{tag}"))
    return html


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote"):
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag == "img":
            self.out.append(f"![{dict(attrs).get('alt') or ''}]({dict(attrs).get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif re.fullmatch(r"h[1-6]|p", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown_text(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=\S)(?![-\d])", "\n", text)).strip()


@F.pandas_udf(StringType())
def to_markdown(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in html:
        yield s.map(to_markdown_text, na_action="ignore")


def page_to_markdown(html: Column, full: bool = False) -> Column:
    """The main content of a page as Markdown, links flattened."""
    body = strip_tags(html, full)
    return to_markdown(flatten_links(repair_lists(body if full else main_content(body))))


def page_text(page: str, full: bool = False) -> str:
    """One page as Markdown, as `page_to_markdown`; a login page or a shell of scripts is an error."""
    low = page.lower()
    if "accounts.google.com" in low or ("sign in" in low and ("google" in low or "gemini" in low)):
        raise ValueError("the page asks for a login")
    if "<script" in page and len(re.sub(r"<[^>]*(?:>|$)", " ", page).split()) < 10:
        raise ValueError("the page is a shell of scripts")
    for tag in STRIPPED_FULL if full else STRIPPED:
        page = re.sub(f"<{tag}.*?</{tag}>", "", page, flags=re.S)
    if not full:
        inside = next((m for t in ("main", "article") if (m := re.search(f"<{t}[^>]*>(.*?)</{t}>", page, re.S))), None)
        page = inside[1] if inside else page
    for tag in ("ol", "ul"):
        page = page.replace(f"</li>\n<{tag}", f"<{tag}").replace(f"</li><{tag}", f"<{tag}")
    return to_markdown_text(re.sub("<a [^>]*>", "", page).replace("</a>", ""))
