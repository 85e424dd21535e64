"""Main content of web pages, by paths on which the pages of a host agree.

Stored pages are text, so a line's container is known from its form alone: heading, list item, code, link, menu row,
sentence paragraph or label. A line has generalised paths from the particular to the general, with the variable parts (digits
and build numbers) taken out: a paragraph those of its sentences; a label its whole text, its first two words and its form;
every other container its form, that is its kind, whether it holds details of its own, and whether it looks like a title.
Three steps, and nothing but the votes decides which paths are furniture:

1. score: a page's long paragraphs, headings, code and items span its body, as far as the page alone can tell. What lies
   within votes against, what lies outside votes for its paths being furniture; the plain title before the body votes
   against. A page without a body does not vote on forms.
2. vote: votes are summed over pages by host and over all hosts. A sentence is furniture if it comes on several pages but
   always as the same line, as articles put their sentences into different paragraphs, and not always within. A text or form of a label, link or
   menu is furniture where most votes say so; a form is judged by its host where that has FORM_PAGES votes on it, else by all.
3. re-extract: each page is taken again with its host's winning paths. A paragraph is furniture if all its sentences are; a
   label if its text, its beginning (unless it holds details) or its form is; any other line if its form is.

Votes are summed by (host, path) with partial sums before the shuffle, so a host with a third of all pages is one row a
path; few winning paths are broadcast, many are joined to the paths of each page (`_with_wins`).

Defined results: null content is no page and gives nothing; blank lines belong to neither part; CRLF line ends are taken as
one; pages of a null or lone host are judged by the votes of all hosts; repeated rows vote again (each is a page) and each
gets its own result; where no page has voted nothing is furniture. Paths that are no http(s) URL are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut

#: A path needs so many pages of a host, or so many pages on at least two hosts, before it can win; a form needs more votes
#: of a host before that host's word on it counts.
HOST_PAGES, ALL_PAGES, FORM_PAGES = 4, 6, 20
#: A sentence path wins if it comes in at most this many kinds of lines a page.
LINES_A_PAGE = 0.25
#: and if it stands outside the body in at least this share of its places: what is put between paragraphs also ends pages.
OUTSIDE = 0.1

URL = r"^(?i)https?://"
_NUMBER = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+")
_HEADING = re.compile(r"#{1,6}\s")
_NUMBERED = re.compile(r"\d+[.)]\s")
_BULLET = re.compile(r"[-*•+]\s+")
_MENU = re.compile(r"^\[[^\]]*\]\([^)]*\)(\s+\[[^\]]*\]\([^)]*\))*$|\s(?:\||·|›|»|—)\s|^\S.{0,30}\s[>/]\s.*\s[>/]\s")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_END = re.compile(r"[.!?:;,…]['\")\]]*$")


#: Characters of a paragraph from which it counts as an article's before any vote.
SURE_CHARS = 110


def normal(text: str) -> str:
    return _NUMBER.sub("0", text.strip().lower())


def containers(content: str) -> list[tuple[str, str]]:
    """(container, text) of each line: blank, code, heading, item, link (an item that looks like a title), menu,
    paragraph or label."""
    out, code = [], False
    for raw in content.split("\n"):
        line = raw.strip()
        if line.startswith("```"):
            code = not code
            kind = "code"
        elif code:
            kind = "code" if line else "blank"
        elif not line:
            kind = "blank"
        elif _HEADING.match(line):
            kind = "heading"
        elif _NUMBERED.match(line):
            kind = "item"
        elif m := _BULLET.match(line):
            line = line[m.end() :]
            kind = "item" if line[:1].islower() or line[:1] in "`\"'" or line.endswith((".", ";", "!", "?")) else "link"
        elif _MENU.search(line):
            kind = "menu"
        else:
            n = line.count(" ") + 1
            kind = "paragraph" if (n >= 4 and _END.search(line)) or n >= 12 else "label"
        out.append((kind, line))
    if code:  # a fence that is never closed marks nothing
        return [(k, t) if k != "code" else ("paragraph", t) for k, t in out]
    return out


def key(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{text}") - (1 << 63)


#: Details of a line's own: numbers with several digits, a mailbox, a house number.
_DETAIL = re.compile(r"\d[\d ()./-]{5,}\d|(?:@|&#64;)\w|(?<![.\d])\b\d{1,5}[a-z]?,? [A-Za-z]|\w \d{1,4}[a-z]?,|[A-Z]{2} ?\d{6}")
_COUNT = re.compile(r"©|\d+ \w+$|[^\w]*\d+\W*$")


def has_detail(text: str) -> bool:
    return bool(_DETAIL.search(text)) and not _COUNT.match(text)


def label_keys(text: str) -> tuple[int, int]:
    n = normal(text)
    words = n.split()
    return key("label", n), key("start", " ".join(words[:2]) if len(words) > 2 or ":" in n else n)


def sentence_keys(text: str) -> set[int]:
    return {key("sentence", normal(s)) for s in _SENTENCE.split(text)}


def form_key(kind: str, text: str, title: bool, within: bool) -> int:
    """The path of a container's form. Where it stands counts for the title, and for labels with details, which close an
    article as often as a page."""
    detail = has_detail(text)
    place = "title" if title else "within" if within and detail and kind == "label" else ""
    return key("form", f"{kind} {detail} {_title_like(text)} {place}")


def stretch(lines: list[tuple[str, str]], wins: frozenset[int] | None) -> tuple[int, int, int]:
    """(first, last, title): the first and last line of the body and the plain title before it, or -1. Before the vote
    (`wins` None) only long paragraphs count, after it those that hold a sentence that has not won."""
    strong = [
        i for i, (k, t) in enumerate(lines)
        if k in ("heading", "code", "item") or (k == "paragraph" and (len(t) >= SURE_CHARS if wins is None else not sentence_keys(t) <= wins))
    ]
    if not strong:
        return -1, -1, -1
    first, last = strong[0], strong[-1]
    # labels with details that close the last paragraph's block belong to it
    while last + 1 < len(lines) and lines[last + 1][0] in ("label", "menu") and has_detail(lines[last + 1][1]) and not (wins and label_keys(lines[last + 1][1])[0] in wins):
        last += 1
    title = -1
    if not lines[first][1].startswith("# "):
        for i in range(first - 1, -1, -1):
            kind, text = lines[i]
            if kind == "blank" or kind == "paragraph" or (kind == "label" and wins and label_keys(text)[0] in wins):
                continue
            if kind == "label":
                title = i
            break
    return first, last, title


def votes(content: str) -> Iterator[tuple[int, int, int, int]]:
    """(path, kind, vote, hash of the line); kind is 0 for texts of labels, 1 for sentences and 2 for forms."""
    lines = containers(content)
    first, last, title = stretch(lines, None)
    for i, (kind, text) in enumerate(lines):
        if kind == "blank":
            continue
        within = first <= i <= last
        if kind == "paragraph":
            line = xxhash.xxh3_64_intdigest(normal(text)) - (1 << 63)
            for k in sentence_keys(text):
                yield k, 1, -1 if within else 1, line
        elif kind == "label":
            for k in label_keys(text):
                yield k, 0, -1 if i == title else 1, 0
        # a page without a body names its forms, so that others' votes reach them, and casts none
        yield form_key(kind, text, i == title, within), 2, 0 if first < 0 else -1 if within or i == title else 1, 0


def furniture(content: str, wins: frozenset[int]) -> list[bool | None]:
    """Of each line whether it is furniture; None for blank lines."""
    lines = containers(content)
    first, last, title = stretch(lines, wins)
    out: list[bool | None] = []
    for i, (kind, text) in enumerate(lines):
        if kind == "blank":
            out.append(None)
        elif kind == "paragraph":
            out.append(sentence_keys(text) <= wins)
        else:
            lost = form_key(kind, text, i == title, first <= i <= last) in wins
            if kind == "label" and i != title and not lost:
                exact, start = label_keys(text)
                lost = exact in wins or (start in wins and not has_detail(text))
            out.append(lost)
    return out


def _title_like(text: str) -> bool:
    return text[:1].isupper() and text.count(" ") >= 2 and not any(c.isdigit() for c in text) and not text.endswith(",")


def pages(file_nodes: DataFrame) -> DataFrame:
    return file_nodes.filter(F.col("path").rlike(URL) & F.col("content").isNotNull()).select(
        F.col("ord").cast("long").alias("ord"), F.col("repo").cast("string").alias("host"), F.col("content").cast("string").alias("content")
    )


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, rows = [], []
        for h, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for v in votes(content):
                host.append(h)
                rows.append(v)
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64())))],
            names=["host", "path", "sentence", "vote", "line"],
        )


def winners(page_rows: DataFrame) -> DataFrame:
    """(host, path), distinct: the paths that are furniture on each host."""
    cast = page_rows.select("host", "content").mapInArrow(_vote, "host string, path long, sentence int, vote int, line long")
    # kinds of lines of a path are counted as rows of the finer sum, at no further shuffle of pages
    fine = cast.groupBy("host", "path", "sentence", "line").agg(F.count("*").alias("n"), F.sum("vote").alias("vote"))
    by_host = cut(fine.groupBy("host", "path", "sentence").agg(F.sum("n").alias("n"), F.sum("vote").alias("vote"), F.count("*").alias("lines")))
    overall = by_host.groupBy("path", "sentence").agg(
        F.sum("n").alias("n"), F.sum("vote").alias("vote"), F.sum("lines").alias("lines"), F.count("*").alias("hosts")
    )

    def wins(pages_needed):
        # of a path on several hosts, its one line on each is one kind
        by_lines = (F.col("sentence") == 1) & (F.col("lines") <= F.greatest(F.lit(1), F.col("n") * LINES_A_PAGE)) & (F.col("vote") + F.col("n") >= 2 * OUTSIDE * F.col("n"))
        return (F.col("n") >= pages_needed) & (by_lines | ((F.col("sentence") != 1) & (F.col("vote") > 0)))

    everywhere = overall.filter((F.col("hosts") > 1) & wins(ALL_PAGES)).select("path")
    form = F.col("sentence") == 2
    own = by_host.filter(F.when(form, wins(FORM_PAGES)).otherwise(wins(HOST_PAGES))).select("host", "path")
    # what a host's pages are too few to tell is told by all hosts'
    shared = by_host.filter(~form | (F.col("n") < FORM_PAGES)).select("host", "path").join(everywhere, "path", "left_semi")
    return own.unionByName(shared.select("host", "path")).distinct()


#: Winning paths that are broadcast, as one array a host; beyond, each page gets the winners among its own paths.
BROADCAST_PATHS = 2_000_000


def page_keys(content: str) -> set[int]:
    """All paths that `furniture` may ask for."""
    out: set[int] = set()
    for kind, text in containers(content):
        if kind == "paragraph":
            out |= sentence_keys(text)
        elif kind == "label":
            out.update(label_keys(text))
        if kind not in ("blank", "paragraph"):
            out.update(form_key(kind, text, title, within) for title in (False, True) for within in (False, True))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for o, host, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            keys = list(page_keys(content))
            yield pa.RecordBatch.from_arrays([pa.array([o] * len(keys), pa.int64()), pa.array([host] * len(keys), pa.string()), pa.array(keys, pa.int64())], names=["ord", "host", "path"])


def _with_wins(page_rows: DataFrame) -> tuple[DataFrame, bool]:
    """(ord, host, content, wins) of each page, and whether they are those of its host. Winners that are few are broadcast by host. Else the paths of each page are
    joined to them, narrow rows by (host, path), and come back as the page's own winners by `ord`: no group has more than one
    page's paths, however many pages or winning paths a host has."""
    best = cut(winners(page_rows))
    if best.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS:
        by_host = F.broadcast(best.groupBy("host").agg(F.collect_set("path").alias("wins")))
        return page_rows.join(by_host, page_rows["host"].eqNullSafe(by_host["host"]), "left").select("ord", page_rows["host"], "content", "wins"), True
    asked = page_rows.mapInArrow(_keys, "ord long, host string, path long")
    won = asked.join(best, asked["host"].eqNullSafe(best["host"]) & (asked["path"] == best["path"])).select("ord", asked["path"])
    won = won.groupBy("ord").agg(F.collect_set("path").alias("wins"))
    return page_rows.join(won, "ord", "left").select("ord", "host", "content", "wins"), False


def _judge(by_host: bool):
    """With `by_host` a host's pages have the same winners, and those of a host are made a set once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, flags = [], []
            memo: dict[str | None, frozenset] = {}
            for o, content, host, wins in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                known = memo.get(host) if by_host else None
                if known is None:
                    known = memo[host] = frozenset(wins.as_py() or ())
                ords.append(o)
                flags.append(furniture(content, known))
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int64()), pa.array(flags, pa.list_(pa.bool_()))], names=["ord", "furniture"])

    return run


def judged(file_nodes: DataFrame) -> DataFrame:
    """(ord, furniture): of each page's lines whether they are furniture; null for blank lines."""
    joined, by_host = _with_wins(pages(file_nodes))
    return joined.select("ord", "content", "host", "wins").mapInArrow(_judge(by_host), "ord long, furniture array<boolean>")


def found(file_nodes: DataFrame) -> DataFrame:
    """(ord, line_no) of each furniture line."""
    lines = judged(file_nodes).select("ord", F.posexplode("furniture").alias("at", "out"))
    return lines.filter("out").select("ord", (F.col("at") + 1).cast("int").alias("line_no"))


def main_content(file_nodes: DataFrame) -> DataFrame:
    """(ord, host, text): each page with only its article's lines; blank lines at the ends and in a row go."""
    joined, _ = _with_wins(pages(file_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content, wins in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                flags = furniture(content, frozenset(wins or ()))
                kept = "\n".join(t for t, f in zip(content.replace("\r\n", "\n").split("\n"), flags) if not f)
                texts.append(re.sub(r"\n{3,}", "\n\n", kept).strip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["ord", "host", "text"])

    return joined.mapInArrow(run, "ord long, host string, text string")
