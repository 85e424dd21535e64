"""Saved threads as text: the focal post first, then the others, with authors, counts, pictures and whom they answer.

A thread is one stored payload and is rendered as one value: in Arrow batches, one payload at a time. Three shapes are read:
timelines (`instructions[].entries[]`, wherever they stand), posts with their includes (`focal` and `thread`), and single
posts with those around them. Of a timeline the posts keep their order; of the second shape replies come newest first and
are turned round.

Defined results: payloads that are no valid JSON or hold no posts give no row; missing authors are `unknown`, missing counts
0, a missing text `...`; repeated payloads give one row; fields of another type than expected count as missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.nested import parse_strict


def at(value: Any, *keys: str | int) -> Any:
    """The value under keys, one inside the other; None where there is none."""
    for k in keys:
        if isinstance(value, dict) and isinstance(k, str):
            value = value.get(k)
        elif isinstance(value, list) and isinstance(k, int) and k < len(value):
            value = value[k]
        else:
            return None
    return value


def word(value: Any, default: str = "unknown") -> str:
    return value if isinstance(value, str) else default


def count(value: Any) -> int:
    return value if isinstance(value, int) and not isinstance(value, bool) else 0


def _posts(value: Any) -> list[dict]:
    """Objects with a `legacy` post, in the order of the text, inner ones after the one around them."""
    out, stack = [], [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if isinstance(node.get("legacy"), dict) and node["legacy"].get("full_text") is not None:
                out.append(node)
            stack.extend(reversed(node.values()))
        elif isinstance(node, list):
            stack.extend(reversed(node))
    return out


def _described(node: dict) -> dict:
    post = node["legacy"]
    author = at(node, "core", "user_results", "result", "legacy") or at(node, "user") or at(post, "user")
    media = at(post, "entities", "media")
    return {
        "id": word(post.get("id_str"), ""), "parent": word(post.get("in_reply_to_status_id_str"), ""), "parent_author": word(post.get("in_reply_to_screen_name")), "text": word(post.get("full_text"), "..."),
        "handle": word(at(author, "screen_name")), "name": word(at(author, "name")), "at": word(post.get("created_at")),
        "likes": count(post.get("favorite_count")), "shares": count(post.get("retweet_count")), "replies": count(post.get("reply_count")),
        "media": [original_text(m["media_url_https"]) for m in media if isinstance(at(m, "media_url_https"), str)] if isinstance(media, list) else [],
    }


def _described_v2(post: dict, users: Any) -> dict:
    """A post of the second shape; its author is the first user with its author_id."""
    author = next((u for u in users if at(u, "id") == post.get("author_id")), None) if isinstance(users, list) and post.get("author_id") is not None else None
    return {
        "id": word(post.get("id"), ""), "parent": "", "parent_author": "unknown", "text": word(post.get("text"), "..."), "handle": word(at(author, "username")), "name": word(at(author, "name")),
        "at": word(post.get("created_at")), "likes": count(at(post, "public_metrics", "like_count")), "shares": 0, "replies": 0, "media": [],
    }


def thread(value: Any, url: str) -> tuple[dict | None, list[dict]]:
    """(the focal post, the others in order). The focal post is the one that the URL names, else the first."""
    if isinstance(at(value, "focal", "data"), dict):
        users = at(value, "focal", "includes", "users")
        focal = _described_v2(value["focal"]["data"], users)
        rest = at(value, "thread", "data")
        others = [_described_v2(x, at(value, "thread", "includes", "users") or users) for x in reversed(rest) if isinstance(x, dict)] if isinstance(rest, list) else []
        return focal, others
    posts = [_described(n) for n in _posts(value)]
    named = re.search(r"/status/(\d+)", url or "")
    focal = next((p for p in posts if named and p["id"] == named[1]), posts[0] if posts else None)
    return focal, [p for p in posts if p is not focal]


def as_markdown(focal: dict, others: list[dict], url: str) -> str:
    out = [f"Twitter Thread by @{focal['handle']}\nThread URL: {url}\n\n"]
    for n, p in enumerate([focal, *others], 1):
        reply = f"Replying to @{p['parent_author']}\n" if p["parent"] else ""
        quoted = p["text"].replace("\n", "\n> ")
        pictures = "".join(f"\nMedia Attached:\n*({m})\n" for m in p["media"])
        out.append(f"{n}. @{p['handle']} ({p['name']})\nPosted at: {p['at']} | Likes: {p['likes']} | Retweets: {p['shares']} | Replies: {p['replies']}\n{reply}> {quoted}\n{pictures}---\n\n")
    return "".join(out)


def as_xml(focal: dict, others: list[dict], url: str) -> str:
    """Nested elements, two blanks a level; a reply is by the focal author or by others. Texts are put in as they are."""

    def post(p: dict, tag: str, pad: str) -> list[str]:
        kind = "self_reply" if p["handle"] == focal["handle"] else "external_reply"
        more = "" if p is focal else f' relationship="{kind}" parent_id="{p["parent"]}"'
        text = p["text"].replace("\n", f"\n{pad}    ")
        lines = [
            f'<{tag} id="{p["id"]}"{more}>', "  <metadata>", f'    <author username="@{p["handle"]}" display_name="{p["name"]}" />', f"    <timestamp>{p['at']}</timestamp>",
            f'    <metrics likes="{p["likes"]}" retweets="{p["shares"]}" replies="{p["replies"]}" />', "  </metadata>", "  <content>", f"    <text>{text}</text>",
        ]
        if p["media"]:
            lines += ["    <media>", *(f'      <image url="{m}"></image>' for m in p["media"]), "    </media>"]
        return [pad + x for x in [*lines, "  </content>", f"</{tag}>"]]

    body = post(focal, "focal_tweet", "  ")
    if others:
        body += ["  <thread_context>", *(x for p in others for x in post(p, "tweet", "    ")), "  </thread_context>"]
    return "\n".join([f'<twitter_thread source_url="{url}">', *body, "</twitter_thread>"]) + "\n"


def rendered(timelines: DataFrame, flavor: str = "human") -> DataFrame:
    """(payload_id, body) of each payload once: Markdown, or XML for the flavor `anthropic`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = [], []
            for key, url, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ok, value = parse_strict(text)
                focal, others = thread(value, url or "") if ok else (None, [])
                if focal:
                    ids.append(key)
                    bodies.append((as_xml if flavor == "anthropic" else as_markdown)(focal, others, url or ""))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], names=["payload_id", "body"])

    url = F.col("url") if "url" in timelines.columns else F.lit("").alias("url")
    once = timelines.select(F.col("payload_id").cast("long").alias("payload_id"), url.cast("string").alias("url"), F.col("payload").cast("string").alias("payload"))
    return once.mapInArrow(run, "payload_id long, body string").distinct()


def original_text(url: str) -> str:
    return re.sub(r"([?&]name=)\w+", r"\1orig", url)


def original(url: Column) -> Column:
    """The picture in its original size."""
    return F.regexp_replace(url, r"([?&]name=)\w+", "$1orig")


# --- shared conversations -------------------------------------------------------------------------------------------------


def conversation_chunks(raw: str) -> list[list]:
    """The arrays of a stored stream: a line with a length, then a line of JSON; anything else is passed over."""
    lines = raw.removeprefix(")]}'\n").split("\n")
    out, i = [], 0
    while i < len(lines):
        if lines[i].isdecimal() and i + 1 < len(lines):
            ok, value = parse_strict(lines[i + 1])
            if ok and isinstance(value, list):
                out.append(value)
            i += 1
        i += 1
    return out


def conversation_text(raw: str, url: str) -> str:
    """A shared conversation from its stored stream: each turn's question and answer under its speaker, a title if there is one."""
    title, parts = None, []
    for chunk in conversation_chunks(raw):
        ok, data = parse_strict(at(chunk, 0, 2) if isinstance(at(chunk, 0, 2), str) else None)
        if not ok or not isinstance(data, list):
            continue
        if not isinstance(at(data, 0), list):
            title = at(data, 2) if isinstance(at(data, 2), str) else title
            continue
        for turn in data[0]:
            if isinstance(at(turn, 0), list):
                said = [("User", at(turn, 0, 0, 0, 0)), ("Gemini", at(turn, 0, 1, 0, 0))]
            elif isinstance(at(turn, 2), str):
                said = [("User", at(turn, 2))]
            else:
                said = [("Message", at(turn, 1, 0))]
            parts += [f"**{who}:**\n{text}\n\n" for who, text in said if isinstance(text, str)]
    head = f"# Gemini Conversation Share\nSource URL: {url}\n\n"
    if not parts and title is None:
        return head + "Failed to parse conversation chunks, or empty answer."
    return (f"# Gemini Conversation: {title}\nSource URL: {url}\n\n" if title is not None else "") + head + "".join(parts)


def conversations_parsed(raw: DataFrame) -> DataFrame:
    """(ord, text) of (ord, url, body): each stored conversation; a null body gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [conversation_text(b, u or "") for u, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["ord", "text"])

    return raw.filter("body is not null").select(F.col("ord").cast("long").alias("ord"), "url", "body").mapInArrow(run, "ord long, text string")
