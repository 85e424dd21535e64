"""Credentials embedded in files: corpus-wide index of literals, owner counts, confirmation, and a re-scan by automata.

1. index: every literal that stands where a credential can stand (behind a telling name, in a connection string, on a
   command line, in a sentence that hands one over) or has a credential's form is listed with its file and owner. Beside
   the fixed list, names are learnt: those to which many owners assign random literals of several alphabets.
2. suppress: a random literal in the files of SHARED_OWNERS or more owners is a placeholder or an example (a password that
   people make up of words may well be chosen by many, so for those only their form counts); so are blanks, masks,
   look-ups, checksums, revisions and plain words.
3. confirm: what is left is confirmed by its form or by its place and form together.
4. re-scan: every file is read again, whatever step 1 made of it. A filter of bits over the confirmed literals (their
   first bytes, and those with their length) tells at which bounded positions one may stand; the hashes of those pieces
   are joined to the confirmed literals, and each file that holds some is searched with an Aho-Corasick automaton over
   them. The filter passes more than there is and misses nothing, so literals are found in every place.

The list of confirmed literals grows with the corpus, so it is never broadcast or collected: what is broadcast is the
filter, of at most FILTER_MOST bits, and each file carries the literals that it holds. Texts of files that hold none are
never moved (`session.attached`).

Defined results: null content is no case; empty files have none; a private key block is reported at the line on which it
begins; repeated rows count one owner and each gets its result; a null repository is an owner of its own; CRLF lines keep
their ends. Redaction replaces each literal by a run of the same length where a fixed form is needed and else by
REDACTED, so that quotes and separators stay as they were.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import attached, cut, small

#: A literal of so many owners is a placeholder.
SHARED_OWNERS = 4
#: Bits of the re-scan's filter: so many a confirmed literal, and no more than that whatever the corpus (16 MB). A fuller
#: filter passes more pieces to the join and loses none.
FILTER_BITS, FILTER_MOST = 48, 1 << 27
#: Signs that a literal has at least behind a telling name or in a place, and elsewhere.
LEAST, LEAST_ELSEWHERE = 6, 8
#: Bytes of a literal that the filter knows (no literal is shorter), and characters of text that it takes at once.
HEAD, STRETCH = 6, 4_000_000
NOT_FILES = r"(?i)(?:^https?://|\.(?:pdf|png|jpe?g|tiff?)$)"

#: A run of signs that may be a credential. Without a digit none is random, so none is a placeholder by its owners and bare
#: ones need no place in the index; behind a name or in a place they are judged like all others.
_RUN = re.compile(r"[A-Za-z0-9+/_=.!?*%#$^&~\-]{6,}")
#: Words in one case with full stops, hyphens or underscores between and after them: no form and no password has so few kinds.
_PLAIN = re.compile(r"[a-z._]+$|[A-Z]?[a-z]+[.?!]?$|[A-Z_]+_[A-Z_]+$")
_DIGIT = re.compile(r"[0-9]")
_TWO_KINDS = re.compile(r"(?:[A-Za-z]+|[^A-Z0-9]+|[^a-z0-9]+)$")
_GROUPED = re.compile(r"(?:[A-Za-z0-9]{6,8}-){3}[A-Za-z0-9]{6,9}$")
#: Names behind which credentials stand (fixed values).
_NAME = (
    r"pass(?:word|wd|phrase|wort|code)?|pwd|pw|kennwort|secret|token|api[_.-]?key|creds?|credentials?|auth|(?:access|signing|private|encryption|licen[sc]e|secret|master|shared|service|account)[_.-]?key"
    r"|bearer|login|pin|otp|webhook"
)
#: What may stand right before a literal, at the end of the text before it. Named: a telling name and an assignment.
_NAMED = re.compile(
    r"(?i)(?P<name>[a-z0-9_.\-]*(?:" + _NAME + r"))(?:[\"'\]`]*\s*(?::\s*(?:&(?:'static\s+)?str|string|any)\s*=|[:=]>?|:=)\s*\(?\s*|[\"'\]`]*\s+(?=[\"'`]))(?:[a-z]{0,2}(?P<quote>[\"'`]))?$"
)
#: A name of any kind that a literal is assigned to.
_ASSIGNED = re.compile(
    r"(?i)(?P<name>[a-z_$][a-z0-9_$.\-]*)(?:[\"'\]`]*\s*(?::\s*(?:&(?:'static\s+)?str|string|any)\s*=|[:=]>?|:=)\s*\(?\s*|[\"'\]`]*\s+(?=[\"'`]))(?:[a-z]{0,2}[\"'`])?$"
)
_URL = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]{1,20}://[^\s:/@\"'`]*:$")
_PLACE = re.compile(
    r"(?i)(?:\b(?:bearer|basic|token)[ :]+[\"']?|\s-u\s+[\"']?[\w.\-]+:|\s-p\s*[\"']?|--(?:password|token|secret|key)[= ]+[\"']?|\bidentified by [\"']?|(?:password|token|secret|pwd|key|creds?)=[\"']?)$"
)
_HANDED = re.compile(
    r"(?i)\b(?:login|password|passwd|pass|pwd|pw|kennwort|passphrase|token|secret|creds?|credentials?|key|code|auth|bearer|new value)\b[^\n]{0,60}?(?:[`\"']|:\s*|\s/\s|\bis\s|\bvalue\s|\bkey\s|\btoken\s)[`\"']?$"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Forms that tell by themselves (published token formats, and the general forms prefix + separator + random and groups).
_FORM = re.compile(
    r"(?:AKIA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{10,}|xo[a-z]{1,2}-[A-Za-z0-9\-]{16,}"
    r"|[a-z]{2,4}[-_](?:live|prod|test)[-_][A-Za-z0-9]{16,}|(?:sk|pk|rk)[-_][a-z]+-[A-Za-z0-9]{16,}|[a-z]{3}[-_](?=[A-Za-z]*\d)[A-Za-z0-9]{18,}|(?:[A-Za-z0-9]{6,8}-){3}[A-Za-z0-9]{6,9})$"
)
#: Of these, the published token formats.
_PUBLISHED = re.compile(r"AKIA[A-Z2-7]{16}$|gh[pousr]_|eyJ[A-Za-z0-9_\-]{8,}\.eyJ|xo[a-z]{1,2}-")
#: Names and values that say that a value is no credential. A name does where it is a whole segment (of a snake, kebab or
#: camel name) and the one that names the value; `password_hash` does, `hash_password`, `shard` and `account` do not.
_SEGMENT = (
    r"hash(?:es)?|digests?|(?:check|sha\d*|md5)sums?|sha\d*|md5|integrity|revisions?|rev|commits?|run[_. -]?id|trace(?:[_. -]?id|parent)?|(?:session|request)[_. -]?id|uuid|etag|nonce|versions?"
    r"|public(?:[_. -]?key)?|fingerprint|limit|count|size|length|expir(?:es|y|ed|ation)|ttl|icon|part number|ticket|oid|build"
)
_HARMLESS_NAME = re.compile(
    rf"(?:(?<![A-Za-z0-9])(?i:{_SEGMENT})|(?<=[a-z0-9])(?=[A-Z])(?i:{_SEGMENT}))(?![A-Za-z])(?:[_. -]?(?i:id|no|number|hex|value|key))?(?:[\"'\]`)]*\s*[:=]*[>#]?\s*(?:[a-z]{{0,2}}[\"'`(\[])?|[ \t]+(?:is|was|of)[ \t]+[\"'`]?)$"
)
#: How each such name ends, before what may stand between it and the value: a cheap test.
_HARMLESS_LETTER = re.compile(r"[A-Za-z0-9][\"'\]`)]*\s*[:=]*[>#]?\s*(?:[a-z]{0,2}[\"'`(\[])?$|\b(?:is|was|of)[ \t]+[\"'`]?$")
_HARMLESS = re.compile(
    r"(?i)(?:[*x.\-_#•?…0]+|\$.*|%.*|changeme.*|change[_-].*|.*example.*|placeholder.*|dummy.*|todo.*|redacted.*|your[_-].*|my[_-].*|insert.*|replace.*|xxx+.*"
    r"|(?:pass(?:word|wd)?|test|admin|secret|abc|abcd|qwerty|letmein|welcome|foo|bar|user|demo|sample|default)[\W_]*\d{0,6}[!?]?|0?1?234567?8?9?0?|.*(.)\1{5,}.*"
    r"|(?:os|process|env|config|settings|secrets?|vault|self|this|req|args?|ctx|var|sys|app)\..*|(?:env|vault|ssm|kms|arn|file|path|data|https?|sha\d+|md5|ref|op)[:+/-].*|sha\d{1,3}-.*)$"
)
_LOOKUP = re.compile(r"(?i)environ|getenv|process\.env|\$\{|\{\{|vault|keyring|secretsmanager|from_env|\benv\(|lookup\(|ENV\[|std::env|getpass|base64,|data:image")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|[0-9a-f]{8}-[0-9a-f]{8}$")
_HEX = re.compile(r"[0-9a-f]{32,128}$")
_ORDINARY = re.compile(
    r"(?:[\w.\-]+\.(?:test|example|internal|com|org|net|local|json|ya?ml|txt|py|js|ts|go|rs|pem|key|env|sql)(?:[/:].*)?|v?\d+(?:[./:-]\d+)*[a-z]{0,3}|[a-z_]+\d{0,3}|[a-z]+[A-Za-z]*\d{0,2}|[A-Z_]+\d{0,2}|\d+/[a-z]+|/.*/.*|.*/[a-z]+/.*|#.*|0x[0-9a-f]+"
    r"|\d{4}-\d\d-\d\d.*|[A-Z]{2,4}-\d+(?:-\w+)*|[A-Z]{1,3}\d{6,9})$"
)

#: Words with hyphens or dots between them (surnames, places, headers): in a sentence, with no name assigned, no password.
_COMPOUND = re.compile(r"[A-Z]?[a-z]+(?:[._-][A-Z]?[a-z]+)+$")

#: Where a candidate stands.
#: Bare literals are indexed, so that a literal confirmed elsewhere is found here too, but confirm nothing.
NAMED, PLACED, FORMED, HANDED, BARE, BLOCK = "named", "placed", "formed", "handed", "bare", "block"
#: A name tells of credentials, though no list has it, if random literals of so many values in the files of so many owners
#: are assigned to it, and of two alphabets or more: checksums, revisions and ids have one.
LEARNED_VALUES, LEARNED_OWNERS = 3, 3


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def random_like(v: str) -> bool:
    """Long and mixed enough that nobody made it up as a word."""
    kinds = bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v))
    if _HEX.match(v):
        return entropy(v) > 3.0
    words = sum(len(w) for w in re.findall(r"[a-z]{5,}|[A-Z]{5,}", v))
    return len(v) >= 16 and kinds >= 2 and bool(re.search(r"\d", v)) and entropy(v) > 3.3 and words < 0.6 * len(v)


def password_like(v: str) -> bool:
    """What people choose: signs of at least three kinds, or letters with digits or signs."""
    if len(v) < LEAST or re.fullmatch(r"[\w.\-]+\.(?:test|example|internal|com|org|net|local|json|ya?ml|txt|py|js|pem|key|env)(?:[:/].*)?", v):
        return False
    kinds = bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^A-Za-z0-9]", v))
    return kinds >= 3 or (kinds == 2 and bool(re.search(r"\d", v)) and not re.fullmatch(r"[a-z]+[_-]?\d{1,2}|v?\d+(?:\.\d+)*|\d+[a-z]{1,3}", v)) and bool(re.search(r"[A-Za-z]", v))


def alphabet(v: str) -> str:
    return "hex" if re.fullmatch(r"[0-9a-fA-F]+", v) else "base64" if re.search(r"[+/=]", v) else "mixed"


def assigned(before: str) -> str | None:
    """The last word of the name that the literal behind `before` is assigned to."""
    m = _ASSIGNED.search(before)
    words = re.findall(r"[A-Z]+(?![a-z])\d*|[A-Z]?[a-z]+\d*|\d+", m["name"]) if m else []
    return words[-1].lower() if words else None


def candidates(content: str) -> Iterator[tuple[int, int, str, str, str, str | None]]:
    """(start, line_no, value, place, form, name) of each literal where a credential may stand; a bare one's name is the
    last word of what it is assigned to."""
    for m in _PEM.finditer(content):
        yield m.start(), content.count("\n", 0, m.start()) + 1, m[0], BLOCK, "", None
    if "'\n" in content or '"\n' in content or "+" in content:
        yield from _in_parts(content)
    for m in _RUN.finditer(content):
        run = m[0]
        if run.isalpha() and not run.startswith("AKIA") or _PLAIN.match(run):
            continue  # a word, or words with signs between them
        for start, value in _values(content, m.start(), run):
            if _TWO_KINDS.match(value) and not _FORM.match(value):
                continue  # a word, whatever its place
            found = judge(content, start, value)
            if found and (found[0] != BARE or _DIGIT.search(run) or _GROUPED.match(run)) and (len(value) >= LEAST_ELSEWHERE or found[0] in (NAMED, PLACED)):
                yield start, content.count("\n", 0, start) + 1, value, *found


#: A literal written in two parts on two lines.
_PARTS = re.compile(r"([\"'])(?P<one>[^\"'\n]{2,})\1[ \t]*\+?[ \t\r]*\n[ \t]*([\"'])(?P<two>[^\"'\n]{1,})\3")


def _in_parts(content: str) -> Iterator[tuple[int, int, str, str, str, str | None]]:
    """Candidates that go over the end of a part. The value is as the file has it, with the quotes between its parts."""
    for m in _PARTS.finditer(content):
        begin = content.rfind("\n", 0, m.start()) + 1
        head = content[begin : m.start("one")]
        joined = head + m["one"] + m["two"] + m[1]
        border = len(head) + len(m["one"])
        for r in _RUN.finditer(joined):
            if not r.start() < border < r.end():
                continue
            for start, value in _values(joined, r.start(), r[0]):
                end = start + len(value)
                if start < border < end and (found := judge(joined, start, value)) and (found[0] != BARE or found[2]):
                    a, b = begin + start, m.start("two") + end - border
                    yield a, content.count("\n", 0, a) + 1, content[a:b], *found


def _values(content: str, start: int, run: str) -> Iterator[tuple[int, str]]:
    """The literals a run of signs may hold: itself without the name and the sign of an assignment before it, without what
    belongs to the sentence, and without a flag."""
    end = content.find("\n", start)
    at = run.find("=")
    while 0 <= at < len(run) - LEAST and re.match(r"[\w.\-]+$", run[:at]) and not re.match(r"=*$", run[at:]):
        start, run = start + at + 1, run[at + 1 :]
        at = run.find("=")
    if run.startswith("-p") and content[start - 1 : start] in (" ", "\t"):
        start, run = start + 2, run[2:]
    while run and run[-1] in ".?!" and (content[start + len(run) : start + len(run) + 1] in (" ", "\n", "\r", "") and run[-1] == "."):
        run = run[:-1]
    if len(run) >= LEAST and end != start:
        yield start, run


def judge(content: str, start: int, value: str) -> tuple[str, str, str | None] | None:
    """(place, form, name), or None for a literal that is no candidate."""
    form = "random" if random_like(value) else "password" if password_like(value) else "word"
    shaped = bool(_FORM.match(value))
    if form == "word" and not shaped or _UUID.match(value) or _HARMLESS.match(value):
        return None
    begin = content.rfind("\n", max(0, start - 200), start) + 1 or max(0, start - 200)
    before, after = content[begin:start], content[start + len(value) : start + len(value) + 60].split("\n", 1)[0]
    if after[:1] in ("(", "[", "{") or after[:3] == "://":
        return None
    if _URL.search(before):
        return (PLACED, form, None) if after[:1] == "@" else None
    if after[:1] == "@" or before[-1:] == "@":
        return None
    if _LOOKUP.search(before):
        return None
    if m := _NAMED.search(before):
        quoted = m["quote"]
        if shaped or form == "random" and not _ORDINARY.match(value) or not _ORDINARY.match(value):
            if quoted and after[:1] == quoted or not quoted and (not after or after[0] in " \t\r,;\"'`" or not after.strip()):
                return NAMED, form, None
        return None
    harmless = _HARMLESS_LETTER.search(before[-60:]) and _HARMLESS_NAME.search(before[-60:])
    if _PLACE.search(before) and not harmless and not _ORDINARY.match(value):
        return PLACED, form, None
    if shaped and (not harmless or _PUBLISHED.match(value)) and (not before or not (before[-1].isalnum() or before[-1] in "/+")) and not (after[:1].isalnum() or after[:1] in ("/", "+")):
        return FORMED, form, None
    if not harmless and not _ORDINARY.match(value):
        if _HANDED.search(before) and not _COMPOUND.match(value):
            return HANDED, form, None
        return BARE, form, assigned(before) if form == "random" else None
    return None


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for o, repo, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if content:
                owner = repo or f"#{o}"
                rows += [
                    (o, owner, no, value, xxhash.xxh3_64_intdigest(value) - (1 << 63), place, form, name, alphabet(value) if name else None)
                    for _, no, value, place, form, name in candidates(content)
                ]
        cols = list(zip(*rows)) if rows else [[]] * 9
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), *[pa.string()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["ord", "owner", "line_no", "value", "hash", "place", "form", "name", "alphabet"])


def _files(file_nodes: DataFrame) -> DataFrame:
    rows = file_nodes.filter(F.col("content").isNotNull() & ~F.coalesce("path", F.lit("")).rlike(NOT_FILES))
    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("repo").cast("string").alias("repo"), F.col("content").cast("string").alias("content"))


def index(file_nodes: DataFrame) -> DataFrame:
    return _files(file_nodes).mapInArrow(_index, "ord long, owner string, line_no int, value string, hash long, place string, form string, name string, alphabet string")


def learned_names(literals: DataFrame) -> DataFrame:
    """(name): of the names of bare random literals those that tell of credentials. Sums by (name, value) and (name, owner)
    come before the counts by name, so that a name that a third of all files has is no single group."""
    named = literals.filter("name is not null").groupBy("name", "hash", "owner").agg(F.first("alphabet").alias("alphabet"))
    values = named.groupBy("name", "hash").agg(F.first("alphabet").alias("alphabet")).groupBy("name").agg(F.count("*").alias("n_values"), F.collect_set("alphabet").alias("alphabets"))
    owners = named.groupBy("name", "owner").agg(F.count("*").alias("n")).groupBy("name").agg(F.count("*").alias("n_owners"))
    told = values.join(owners, "name").filter((F.col("n_values") >= LEARNED_VALUES) & (F.size("alphabets") > 1) & (F.col("n_owners") >= LEARNED_OWNERS))
    return told.select("name", F.lit(True).alias("learned"))


def confirmed(literals: DataFrame) -> DataFrame:
    """(hash, value) of literals that are credentials; key blocks are none of them. The owners of a hot literal are
    counted from one row an owner."""
    literals = literals.filter(F.col("place") != BLOCK).join(small(cut(learned_names(literals))), "name", "left")
    told = F.col("place").isin(PLACED, NAMED, HANDED) | F.coalesce("learned", F.lit(False))
    by_owner = literals.groupBy("hash", "value", "owner").agg(F.max(F.col("form") == "random").alias("random"), F.max(told).alias("told"), F.max(F.col("place") == FORMED).alias("formed"))
    return (
        by_owner.groupBy("hash", "value").agg(F.count("*").alias("owners"), F.max("random").alias("random"), F.max("told").alias("told"), F.max("formed").alias("formed"))
        .filter(((F.col("owners") < SHARED_OWNERS) | ~F.col("random")) & (F.col("told") | F.col("formed"))).select("hash", "value", "owners")
    )


def _bits(keys: np.ndarray, log: int) -> list[np.ndarray]:
    """The bits of a filter of 2^log bits that stand for each key."""
    return [keys * m >> np.uint64(64 - log) for m in _MIX]


_MIX = [np.uint64(xxhash.xxh3_64_intdigest(f"filter {i}") | 1) for i in range(3)]
_LENGTH = np.uint64(xxhash.xxh3_64_intdigest("length") | 1)
_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


def _filter(sure: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, lengths, log): the filter over the confirmed literals as 2^log bits in 64-bit words, and their lengths in bytes."""
    log = max(16, math.ceil(math.log2(min(FILTER_MOST, FILTER_BITS * sure.count() + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v.encode() for v in batch.column(0).to_pylist()]
            heads = np.array([int.from_bytes(v[:HEAD], "little") for v in values], dtype=np.uint64)
            lengths = np.array([len(v) for v in values], dtype=np.uint64)
            at = np.unique(np.concatenate(_bits(heads, log) + _bits(heads + lengths * _LENGTH, log)))
            bits = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bits)], names=["word", "bits"])

    got = sure.select("value").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << log - 6, dtype=np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    lengths = sure.select(F.octet_length("value").alias("n")).distinct().toArrow().column("n").to_numpy()
    return words, np.sort(lengths).astype(np.int64), log


def _passes(words: np.ndarray, log: int, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), dtype=bool)
    for at in _bits(keys, log):
        ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def pieces(text: bytes, words: np.ndarray, lengths: np.ndarray, log: int) -> Iterator[tuple[int, int]]:
    """(start, end) in bytes of each bounded piece that may be a confirmed literal: all that are, and few besides."""
    n = len(text) - HEAD + 1
    if n <= 0 or not len(lengths):
        return
    signs = np.frombuffer(text, dtype=np.uint8)
    alnum = _ALNUM[signs]
    edge = np.ones(len(text) + 1, dtype=bool)
    edge[1:-1] = ~(alnum[:-1] & alnum[1:])
    begin = edge[:n].copy()
    begin[2:] |= ((signs[:-2] == ord("-")) & (signs[1:-1] == ord("p")))[: n - 2]
    starts = np.flatnonzero(begin)
    heads = np.ndarray((n,), dtype="<u8", buffer=text + b"\0" * (8 - HEAD), strides=(1,))[starts] & np.uint64((1 << 8 * HEAD) - 1)
    ok = _passes(words, log, heads)
    for a, head in zip(starts[ok].tolist(), heads[ok]):
        ends = a + lengths
        ends = ends[ends <= len(text)]
        ends = ends[edge[ends]]
        for b in ends[_passes(words, log, head + (ends - a).astype(np.uint64) * _LENGTH)].tolist():
            yield a, b


def _holders(shared):
    """(ord, hash) of the pieces of each file that may be confirmed literals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths, log = shared.value
        for batch in batches:
            ords, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: set[tuple[int, int]] = set()
            i = 0
            while i < len(contents):
                j, size = i + 1, len(contents[i])
                while j < len(contents) and size + len(contents[j]) <= STRETCH:
                    size += len(contents[j])
                    j += 1
                parts = [c.encode() for c in contents[i:j]]
                text = b"\0".join(parts)
                first = np.cumsum([0] + [len(x) + 1 for x in parts])
                for a, b in pieces(text, words, lengths, log):
                    rows.add((ords[i + int(np.searchsorted(first, a, "right")) - 1], xxhash.xxh3_64_intdigest(text[a:b]) - (1 << 63)))
                i = j
            cols = list(zip(*rows)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ord", "hash"])

    return run


def _hits(content: str, values: list[str] | None) -> list[tuple[int, int]]:
    """(start, end) of the confirmed literals in a file, none within another."""
    if not values:
        return []
    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    return _apart((e - len(v) + 1, e + 1) for e, v in automaton.iter(content) if _bounded(content, e - len(v) + 1, e + 1))


def _apart(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, without those that begin in an earlier or longer one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for o, content, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for a, b in _apart(_hits(content, values) + [m.span() for m in _PEM.finditer(content)]):
                rows.append((o, content.count("\n", 0, a) + 1, a, b))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["ord", "line_no", "start", "end"]
        )


def _bounded(text: str, a: int, b: int) -> bool:
    """The match is a whole literal and no part of a longer one."""
    inner = lambda x, y: x.isalnum() and y.isalnum()
    return not (a > 0 and inner(text[a - 1], text[a]) and text[max(a - 2, 0) : a] != "-p") and not (b < len(text) and inner(text[b - 1], text[b]))


def suspects(file_nodes: DataFrame) -> DataFrame:
    """(ord, content, values): the files with confirmed literals or key blocks, and those literals."""
    literals = cut(index(file_nodes))
    sure = cut(confirmed(literals).select("hash", "value"))
    files = _files(file_nodes).select("ord", "content")
    shared = file_nodes.sparkSession.sparkContext.broadcast(_filter(sure))
    held = files.mapInArrow(_holders(shared), "ord long, hash long").distinct().join(sure, "hash").select("ord", "value")
    held = held.unionByName(literals.filter(F.col("place") == BLOCK).select("ord", F.lit(None).cast("string").alias("value")))
    by_file = cut(held.groupBy("ord").agg(F.collect_set("value").alias("values")))
    size = F.aggregate("values", F.lit(0).cast("long"), lambda n, v: n + F.octet_length(v)) + 16
    return attached(files, by_file, ["ord"], size).select("ord", "content", "values")


def spans(file_nodes: DataFrame) -> DataFrame:
    """(ord, line_no, start, end) of each credential; positions count characters."""
    return suspects(file_nodes).mapInArrow(_rescan, "ord long, line_no int, start int, end int")


def found(file_nodes: DataFrame) -> DataFrame:
    return spans(file_nodes).select("ord", "line_no").distinct()


_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for content, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts, end = [], 0
            for a, b in _hits(content, values):
                parts += [content[end:a], "REDACTED"]
                end = b
            out.append(_without_blocks("".join(parts) + content[end:]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["ord", "content"])


def _without_blocks(content: str) -> str:
    """The lines inside a key block by a line of the same indentation that says so."""
    at = 0
    while m := _PEM.search(content, at):
        end = _BLOCK_END.search(content, m.end())
        body = content[m.end() : end.start() if end else len(content)]
        kept = re.sub(r"[A-Za-z0-9+/=]{8,}", "REDACTED", body)
        content = content[: m.end()] + kept + content[m.end() + len(body) :]
        at = m.end() + len(kept)
    return content


def redacted(file_nodes: DataFrame) -> DataFrame:
    """(ord, content) of the files that held credentials, without them."""
    return suspects(file_nodes).mapInArrow(_redacted, "ord long, content string")
