"""Nested records to flat tables by interval labels.

Every node of a JSON document (object, array or scalar) gets a pre-order and a post-order number in one depth-first
traversal; node `a` contains node `b` exactly when `a.pre < b.pre` and `b.post < a.post`. Only nodes of a wanted type
are emitted, each with its labels, its scalar fields and `level`, the number of emitted nodes around it. Emitted
intervals of one level of one record do not overlap, so the nearest enclosing node of a node on level n is the last
one of level n-1 that began before it: one window over (record, level), linear in the nodes, and no range join.

Nodes move once, to the task of their record; removing repeated rows, finding what encloses a node and finding which post
is answered all work on that partitioning. A task emits a repeated record once, so that a record that makes up a third of
the rows arrives once a task at most.

Defined results: null, empty, cut-off or otherwise invalid JSON (also NaN and Infinity, which JSON lacks) yields one
payload row with `valid` false and nothing else; repeated rows yield one set of nodes; fields of an unexpected type
become null where a number was wanted and text where text was wanted; an empty table yields empty tables; any depth of
nesting is read. Additional input columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id long, record_fp string, valid boolean, type string, pre int, post int, level int, fields map<string,string>"
)
_ARROW = pa.schema(
    [("record_id", pa.int64()), ("record_fp", pa.string()), ("valid", pa.bool_()), ("type", pa.string()), ("pre", pa.int32()),
     ("post", pa.int32()), ("level", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_strict(text: str | None) -> tuple[bool, Any]:
    """(is valid JSON, value)."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        pass
    except ValueError as e:
        if "digits" not in str(e):
            return False, None
    try:
        return True, _read(text)
    except ValueError:
        return False, None


_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?P<rest>(?:\.\d+)?(?:[eE][+-]?\d+)?)", re.A)
_CONSTANTS = {"true": True, "false": False, "null": None}
#: Whole numbers of more digits than this are kept as text.
MOST_DIGITS = 4_000


def _read(text: str) -> Any:
    """JSON of any depth, with a stack of its own: what the recursive reader gives, or ValueError."""
    skip = lambda i: _BLANK.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return name, skip(i + 1)

    stack: list[tuple] = []
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "{" or c == "[":
            i = skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                if c == "{":
                    name, i = key(i)
                    stack.append(({}, name))
                else:
                    stack.append(([], None))
                continue
            value, i = ({} if c == "{" else []), i + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = (float(m[0]) if m["rest"] else int(m[0]) if len(m[0]) < MOST_DIGITS else m[0]), m.end()
        else:
            word = next((w for w in _CONSTANTS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(i)
            value, i = _CONSTANTS[word], i + len(word)
        while True:  # the value is whole: it goes into what is open
            i = skip(i)
            if not stack:
                if i < len(text):
                    raise ValueError(i)
                return value
            box, name = stack[-1]
            inside = isinstance(box, dict)
            if inside:
                box[name] = value
            else:
                box.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if inside:
                    name, i = key(i)
                    stack[-1] = (box, name)
                break
            if c != ("}" if inside else "]"):
                raise ValueError(i)
            stack.pop()
            value, i = box, i + 1


def as_text(value: Any) -> str | None:
    """A scalar as text; objects and arrays as null."""
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


Classify = Callable[[tuple, Any], tuple[str, dict] | None]


def label(value: Any, classify: Classify, scalars: bool = True) -> list[tuple]:
    """(type, pre, post, level, fields) of each node for which `classify(path, node)` gives a type; `path` holds the last
    two keys above the node, array positions left out. Without `scalars` only objects and arrays are asked about, while
    scalars still count. An explicit stack takes any depth."""
    out: list[list] = []
    clock = post = 0
    stack: list[tuple] = [((), iter(((None, value),)), -1, 0)]
    while stack:
        path, children, slot, level = stack[-1]
        for k, node in children:
            inner = isinstance(node, (dict, list))
            if not inner and not scalars:
                clock += 1
                post += 1
                continue
            here = path if k is None else (path[-1:] + (k,))
            found = classify(here, node)
            own = -1
            if found:
                own = len(out)
                out.append([found[0], clock, post, level, found[1]])
            clock += 1
            if inner:
                below = iter(node.items()) if isinstance(node, dict) else zip(itertools.repeat(None), node)
                stack.append((here, below, own, level + (own >= 0)))
                break
            post += 1
        else:  # the subtree is done
            stack.pop()
            if stack or slot >= 0:
                if slot >= 0:
                    out[slot][2] = post
                post += 1
    return [tuple(x) for x in out]


def shred(df: DataFrame, key: Column, text: Column, classify: Classify) -> DataFrame:
    """The labelled nodes of each record, as NODE_SCHEMA; the root is always emitted, as type `record`. `classify` is asked
    about objects and arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fp = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                if (rid, fp) in seen:
                    continue
                seen.add((rid, fp))
                ok, value = parse_strict(text)
                nodes = label(value, lambda p, n: ("record", {}) if n is value and not p else classify(p, n), False) if ok else []
                if not nodes or nodes[0][1]:  # a scalar alone, or no JSON
                    nodes = [("record", 0, 0, 0, {})]
                rows += [(rid, fp, ok, kind, pre, post, level, list(fields.items())) for kind, pre, post, level, fields in nodes]
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return df.select(key.cast("long").alias("record_id"), text.cast("string").alias("text")).mapInArrow(run, NODE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def gathered(nodes: DataFrame) -> DataFrame:
    """`nodes` once each, all nodes of a record in one task; a record is one stored value, so this is bounded by it."""
    return nodes.repartition("record_id", "record_fp").dropDuplicates(["record_id", "record_fp", "pre"])


def link(nodes: DataFrame) -> DataFrame:
    """`nodes` once each, with `parent_pre`, `parent_type` and `parent_id` (its id_str) of the nearest enclosing node by
    interval containment."""
    nodes = gathered(nodes)
    # each node stands once as a child (on its own level) and once as a possible parent (of the next level)
    both = nodes.withColumn("as_parent", F.explode(F.array(F.lit(True), F.lit(False))))
    both = both.withColumn("at", F.when(F.col("as_parent"), F.col("level")).otherwise(F.col("level") - 1))
    w = Window.partitionBy("record_id", "record_fp", "at").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.struct("pre", "post", "type", F.col("fields").getItem("id_str").alias("id"))
    last = F.last(F.when(F.col("as_parent"), whole), ignorenulls=True).over(w)
    found = both.withColumn("last", last).filter(~F.col("as_parent"))
    inside = (F.col("last.pre") < F.col("pre")) & (F.col("last.post") > F.col("post"))
    return found.select(*nodes.columns, *(F.when(inside, F.col(f"last.{c}")).alias(f"parent_{c}") for c in ("pre", "type", "id")))


# --- thread payloads -------------------------------------------------------------------------------------------------

#: The lists under a post and the field that names an element.
ATTACHMENTS = {"hashtags": "text", "user_mentions": "screen_name", "media": "media_url_https", "urls": "expanded_url"}


POST_FIELDS = ("id_str", "full_text", "favorite_count", "in_reply_to_status_id_str", "created_at", "lang")


def classify_reply(path: tuple, node: Any) -> tuple[str, dict] | None:
    """Posts alone, with their own id and that of the post they answer."""
    if path and path[-1] == "legacy" and isinstance(node, dict) and node.get("full_text") is not None:
        return "post", {k: t for k in ("id_str", "in_reply_to_status_id_str") if (t := as_text(node.get(k))) is not None}
    return None


def classify_thread(path: tuple, node: Any) -> tuple[str, dict] | None:
    """Posts are objects under a key `legacy` that have a full_text; attachments the objects in their entity lists."""
    if not path or not isinstance(node, dict):
        return None
    if path[-1] == "legacy" and node.get("full_text") is not None:
        return "post", {k: t for k in POST_FIELDS if (t := as_text(node.get(k))) is not None}
    if len(path) > 1 and path[-1] in ATTACHMENTS and path[-2] in ("entities", "extended_entities"):
        fields = {"kind": path[-1]}
        if (t := as_text(node.get(ATTACHMENTS[path[-1]]))) is not None:
            fields["value"] = t
        return "attachment", fields
    return None


def thread_nodes(timelines: DataFrame) -> DataFrame:
    return shred(timelines, F.col("payload_id"), F.col("payload"), classify_thread)


def payload_table(timelines: DataFrame) -> DataFrame:
    """payload_id, valid, n_posts, n_attachments; one row per distinct payload."""
    nodes = gathered(thread_nodes(timelines))
    return (
        nodes.groupBy(F.col("record_id").alias("payload_id"), "record_fp")
        .agg(
            F.max("valid").alias("valid"),
            F.count_if(F.col("type") == "post").alias("n_posts"),
            F.count_if(F.col("type") == "attachment").alias("n_attachments"),
        )
        .drop("record_fp")
    )


def post_table(timelines: DataFrame) -> DataFrame:
    """Posts with the key of their payload and, for posts inside posts, of the post around them."""
    linked = link(thread_nodes(timelines)).filter(F.col("type") == "post")
    f = lambda k: F.col("fields").getItem(k)
    return linked.select(
        F.col("record_id").alias("payload_id"),
        F.col("pre").alias("post_key"),
        F.when(F.col("parent_type") == "post", F.col("parent_pre")).alias("parent_post_key"),
        F.when(F.col("parent_type") == "post", F.col("parent_id")).alias("parent_post_id"),
        f("id_str").alias("id_str"),
        f("full_text").alias("full_text"),
        F.expr("try_cast(fields['favorite_count'] AS BIGINT)").alias("favorite_count"),
        f("in_reply_to_status_id_str").alias("in_reply_to_status_id_str"),
    )


def attachment_table(timelines: DataFrame) -> DataFrame:
    """Attachments with the keys of their payload and post."""
    linked = link(thread_nodes(timelines)).filter(F.col("type") == "attachment")
    return linked.select(
        F.col("record_id").alias("payload_id"),
        F.when(F.col("parent_type") == "post", F.col("parent_pre")).alias("post_key"),
        F.when(F.col("parent_type") == "post", F.col("parent_id")).alias("post_id"),
        F.col("pre").alias("attachment_key"),
        F.col("fields").getItem("kind").alias("kind"),
        F.col("fields").getItem("value").alias("value"),
    )


def reply_links(timelines: DataFrame) -> DataFrame:
    """Distinct (payload_id, parent_id, child_id): a post that answers another post of the same payload. Posts are those
    that a payload's record encloses by their intervals, whatever stands between."""
    f = lambda k: F.col("fields").getItem(k)
    posts = (
        link(shred(timelines, F.col("payload_id"), F.col("payload"), classify_reply))
        .filter((F.col("type") == "post") & F.col("parent_pre").isNotNull())
        .select("record_id", "record_fp", f("id_str").alias("id"), f("in_reply_to_status_id_str").alias("re"))
        .filter(F.col("id").isNotNull())
    )
    # a post stands once as itself and once as an answer, under the post it names, in the task of its record
    answers = F.col("re").isNotNull() & (F.col("re") != "") & (F.col("re") != F.col("id"))
    roles = F.array(F.struct(F.col("id").alias("at"), F.lit(None).cast("string").alias("child")), F.when(answers, F.struct(F.col("re").alias("at"), F.col("id").alias("child"))))
    w = Window.partitionBy("record_id", "record_fp", "at")
    return (
        posts.select("record_id", "record_fp", F.explode(roles).alias("role"))
        .filter("role is not null")
        .select("record_id", "record_fp", "role.at", "role.child")
        .withColumn("there", F.max(F.col("child").isNull()).over(w))
        .filter(F.col("child").isNotNull() & F.col("there"))
        .select(F.col("record_id").alias("payload_id"), F.col("at").alias("parent_id"), F.col("child").alias("child_id"))
        .distinct()
    )
