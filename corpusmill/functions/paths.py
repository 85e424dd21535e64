"""Column functions on paths and URLs. Null in gives null out; lengths and matches are on the text as it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of files that are never read (fixed values).
SECRET_NAMES = (
    ".env", ".env.local", ".env.development", ".env.test", ".env.production", "id_rsa", "id_ed25519", "credentials.json",
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last component; '' if there is none or the name only begins with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)/*$", 1))


def summary_extension(path: Column) -> Column:
    """From the last dot of the whole path, the dot included; 'no-extension' without one."""
    found = F.regexp_extract(path, r"(?s)(\.[^.]*)$", 1)
    return F.when(found == "", F.lit("no-extension")).otherwise(found)


def is_secret_file(path: Column) -> Column:
    name = file_name(path)
    return name.isin(*SECRET_NAMES) | name.endswith(".pem") | path.contains(".aws/credentials") | path.contains(".ssh/")


def included(path: Column, patterns: list[str]) -> Column:
    """Any pattern fits the file name: `*.x` and `.x` its end, others any part of it, signs as they are."""
    name = file_name(path)

    def one(p: str) -> Column:
        if p.startswith("*.") or p.startswith("."):
            return name.endswith(p.removeprefix("*"))
        return name.contains(p)

    return reduce(lambda a, b: a | b, [one(p) for p in patterns], F.lit(not patterns))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Any pattern fits: ends as above; with a star elsewhere all parts between stars anywhere; else any part."""
    name = file_name(path)

    def one(p: str) -> Column:
        if p.startswith("*.") or p.startswith("."):
            return name.endswith(p.removeprefix("*"))
        if "*" in p:
            return reduce(lambda a, b: a & b, [name.contains(x) for x in p.split("*") if x], F.lit(True))
        return name.contains(p)

    return reduce(lambda a, b: a | b, [one(p) for p in patterns], F.lit(False))


def depth(path: Column) -> Column:
    """1 for an entry at the top level."""
    return F.size(F.split(path, "/"))


def url_host(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: Hosts with readers of their own, in the order they are tried (fixed values).
ROUTES = (
    ("repository", ("github.com",)),
    ("video", ("youtube.com", "youtu.be")),
    ("posts", ("twitter.com", "x.com")),
    ("drive", ("docs.google.com", "drive.google.com")),
    ("conversation", ("gemini.google.com",)),
)


def url_route(path: Column, strict: bool = False) -> Column:
    """The reader of a URL by the end of its host; `strict` asks for a whole label. Null for what is no http(s) URL."""
    host = url_host(path)
    out = F.lit("page")
    for name, hosts in reversed(ROUTES):
        fits = [(host == h) | host.endswith("." + h) if strict else host.endswith(h) for h in hosts]
        out = F.when(reduce(lambda a, b: a | b, fits), name).otherwise(out)
    return F.when(path.rlike(r"^https?://"), out)


def safe_name(path: Column) -> Column:
    """The output file's name: a URL's path (index for none), without `..`, colons as _, and .md at the end."""
    url_path = F.regexp_extract(path, r"^https?://[^/?#]*/?([^?#]*)", 1)
    name = F.when(url_path == "", "index").when(url_path.endswith("/"), F.concat(url_path, F.lit("index"))).otherwise(url_path)
    name = F.replace(F.replace(name, F.lit(".."), F.lit("")), F.lit(":"), F.lit("_"))
    out = F.when(path.rlike(r"^https?://"), name).otherwise(F.replace(path, F.lit(".."), F.lit("")))
    return F.when(out.endswith(".md"), out).otherwise(F.concat(out, F.lit(".md")))


def display_name(targets: list[str]) -> str:
    """What a run over several targets is called."""
    if not targets:
        return "clipboard"
    return targets[0] if len(targets) == 1 else " & ".join(targets) if len(targets) == 2 else f"{targets[0]} and {len(targets) - 1} others"


def output_dir(name: str) -> str:
    plain = name.removeprefix("https://").removeprefix("http://")
    return plain.replace("/", "_").replace(" ", "_").replace("&", "and") + "_gobbled"


def media_id(url: Column, kind: str) -> Column:
    """The id of a post, video, document or conversation in its URL; null if there is none."""
    pattern = {
        "post": r"/status/(\d+)",
        "video": r"(?:[?&]v=|youtu\.be/|/shorts/)([A-Za-z0-9_-]+)",
        "document": r"/d/([A-Za-z0-9_-]+)",
        "conversation": r"/share/([A-Za-z0-9_-]+)",
    }[kind]
    found = F.regexp_extract(url, pattern, 1)
    return F.when(found != "", found)
