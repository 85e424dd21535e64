"""Personal information in free text, by weak supervision.

Wide patterns propose spans of five kinds (mailbox, phone, identity number, street address, name). Labelers of three sorts
vote for or against each span or abstain: patterns (a full form, a form that other things have), gazetteers (tokens that
the corpus uses as names, learnt from the places where a name must stand; words that the corpus mostly writes in lower
case) and context (words before and after, a column of a table). All votes weigh the same at first; expectation-
maximisation over the counts of vote patterns then estimates how often each labeler speaks up on true and on other spans,
and with that what each pattern means. A logistic span classifier is trained on those posteriors, over the votes, the
span's shape and the words around it, so that it also decides spans on which the labelers are silent or split.

The corpus is aggregated to counts of vote patterns before anything reaches the driver (at most 2^votes rows a kind,
whatever the corpus); the classifier is fitted on at most SAMPLE_SPANS spans a kind, chosen by hash; the gazetteers stay
tables and are joined to the spans by token.

Defined results: null and empty texts hold nothing; a payload that is not valid JSON holds no posts; repeated rows get
their own results and posts of one id one result; a record whose id is null is left out; a span that runs over a line end
counts where it begins; mailboxes and addresses are whole, however long. Redaction replaces each span by its kind in
brackets.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.nested import thread_nodes
from corpusmill.session import attached, cut, small

KINDS = ("email", "phone", "id_number", "address", "name")
#: Rounds of EM, and how far the first belief of a span is from even when one or more votes lean to one side.
ROUNDS, TILT = 60, 0.2
#: So many spans' worth of the belief how often a labeler against (-1), on no (0) and on either side speaks up on true and on
#: other spans, the same for all; it matters in small tables only.
WEIGHT, HABIT = 20, {-1: (0.02, 0.3), 0: (0.3, 0.3), 1: (0.5, 0.25)}
#: The classifier: spans a kind that it is fitted on at most, steps, features by hash, and the probability from which a
#: span is reported.
SAMPLE_SPANS, STEPS, FEATURES, THRESHOLD = 60_000, 250, 1 << 18, 0.5
#: Precision of the normal prior on its weights.
PRIOR = 0.2
#: A token is a name if it stands so often, and in this share of its capitalised pairs, where a name must stand.
NAME_CUES, NAME_SHARE = 2, 0.25
#: A token is a common word if lower-case uses are this many times its capitalised ones.
COMMON = 0.5

_GAP = r"(?: |[ \t]*\n[ \t]*)"
_MAIL = re.compile(
    r"(?<![\w.+/&-])(?P<user>[A-Za-z0-9][\w.+-]*)(?P<at>@|&#64;|\s?[\[(]\s?at\s?[\])]\s?|\sat\s(?=[\w-]+\sdot\s)|(?-i:\sAT\s)(?=[\w-]+\.\w))(?P<host>[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9-]+)+)", re.I
)
_PHONE = re.compile(r"(?<![\w:/+-])(?<!\d[.,])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?(?:\d{1,5}(?:[ ./-]\(?\d{1,8}\)?){0,5}|\d{10,13})(?![\w-]|[.:]\d)")
_ID = re.compile(r"(?<![\w.-])(?:\d{3}[ -]\d{2}[ -]\d{4}|\d{9}|\d{11}|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{8}-?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,8}|\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![\w-])")
#: Cheap signs that one of the patterns above may match nearby: a run with several digits; what every address form holds.
_DIGITS = re.compile(r"\d[\d ()./-]{4,}\d")
_CAP = r"[A-ZÀ-Þ][\w'’.-]*"
_STREET = r"(?:St|Street|Ave|Avenue|Rd|Road|Lane|Ln|Drive|Dr|Mews|Court|Ct|Close|Way|Terrace|Boulevard|Blvd|Place|Pl|Square|Sq|Row|Crescent|Hill|Walk|Gardens|Grove|Park|Parkway|Pkwy|Yard|Alley|Circle|Cir|Hollow|Quay|Green)"
_ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:(?:Flat|Apt|Unit|Suite|Apartment)\.? \w{{1,4}},{_GAP}?)?\d{{1,5}}[A-Za-z]?,?{_GAP}(?:{_CAP}{_GAP}){{1,3}}?{_STREET}\b\.?"
    rf"|\d{{1,4}}(?: bis| ter)?,?{_GAP}(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours)\b(?: (?:de|du|des|la|le|les|l'|d'|\w[\w'’-]*)){{1,5}}"
    rf"|(?:(?:Calle|Avenida|Avda\.|Plaza|Paseo|Via|Rua|Camino)(?!\w)|C/)(?:{_GAP}(?:de|del|la|las|los|el|{_CAP})){{1,5}},?{_GAP}\d{{1,4}}"
    rf"|(?:(?:Am|An|Auf|Im|In|Zum|Zur|Alte|Alter|Lange|Kurze|Neue|Hohe|Große|Kleine)(?:{_GAP}(?:der|dem|den))?{_GAP})?{_CAP}{_GAP}?\d{{1,4}} ?[a-z]?(?=(?:,{_GAP}|[ \t]*\n[ \t]*)\d{{4,5}}{_GAP}[A-ZÀ-Þ])"
    rf"|[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig){_GAP}\d{{1,4}} ?[a-z]?)(?![\w])"
)
#: What every address form holds, and whether it ends at a word end (True) or before a blank or line end (False).
_PLACES = ahocorasick.Automaton()
for _w in _STREET[3:-1].split("|"):
    for _lead in " \n\t":
        _PLACES.add_word(_lead + _w, True)
for _w in "rue avenue boulevard place chemin allée quai impasse cours Calle C/ Avenida Avda. Plaza Paseo Via Rua Camino straße strasse str. weg gasse platz allee ufer damm ring steig".split():
    _PLACES.add_word(_w, False)
_PLACES.make_automaton()
_POSTCODE = re.compile(r"\d ?[a-z]?,?\s+\d{4,5}\s+[A-ZÀ-Þ]")
#: Letters of the Latin, Greek and Cyrillic scripts.
_LETTERS = [chr(c) for c in (*range(0x41, 0x530), *range(0x1E00, 0x2000))]
_UP, _LOW = ("".join(c for c in _LETTERS if test(c)) for test in (str.isupper, str.islower))
_TOKEN = re.compile(rf"(?<![\w@/#.$-])[{_UP}](?:[{_LOW}'’]+(?:-[{_UP}][{_LOW}]+)*|[{_UP}'’]+(?:-[{_UP}]+)*)?(?![\w@/$])")
_BETWEEN = re.compile(rf"(?:{_GAP}(?:[{_UP}]\.{_GAP})?|,{_GAP}|\.{_GAP}?)$")

# --- context (fixed values) -----------------------------------------------------------------------------------------
_NAME_BEFORE = re.compile(
    r"(?i)(?:\b(?:author|written by|maintained by|maintainer|owner|reporter|thanks to|call|ask(?: for)?|ansprechpartner|contact|todo\(|assignee|reviewed by|name|"
    r"mr|mrs|ms|miss|frau|herr|mme|m\.|dr|prof|regards|dear|sincerely|attn)\b[.:=\"'\s(]*)$"
)
_NAME_AFTER = re.compile(r"(?i)^(?:\s*(?:can be reached|<[\w.+-]+(?:@|&#64;)|, ?(?:tel|tél)\b|; |/ ?[+(\d]|\((?:ssn|passport|dni|social|\+|\d|tax|idnr|steuer|ni )|, flat \d|,[\w.+-]+(?:@|&#64;)))")
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Frau|Herr|Mme|Dr|Prof|Mlle|Sr|Sra)\.? )$", re.I)
_ROW = re.compile(r"(?:^|\n)\d+,\"?$")
_PHONE_BEFORE = re.compile(r"(?i)(?:\b(?:tel|tél|phone|call|mobile|fax|number|reached at|back on|sms sent to|ring|dial|whatsapp|handy|pager|telefon|tel[eé]fono|t[eé]l[eé]phone)\b[^\n\d]{0,40}|[/(,;] ?\"?)$")
_NUMBER_BEFORE = re.compile(r"(?i)\b(?:order|run|build|ticket|part(?: number)?|version|release|port|client|retry|took|id|step|section|page|listening on|invoice|row|rows|tokens|line|issue|pr|sha|hash)\b[\s#:]*[\w.-]{0,3}$")
_ID_BEFORE = re.compile(r"(?i)\b(?:ssn|social security(?: no| number)?|passport(?: no| number)?|pass(?:eport)?(?:[ -]nr| no)?|reisepass(?:-nr)?|dni|nif|nie|nino|ni number|national insurance(?: no| number)?|steuer-?id(?:nr)?|idnr|tax id|tin|id card|personalausweis(?:-nr)?|ausweis(?:-nr)?|identity|national id|num[eé]ro de s[eé]curit[eé] sociale|s[eé]curit[eé] sociale|nir|pasaporte|carte d'identit[eé])\b[\s.:#n°ºo(]*$")
_ADDRESS_BEFORE = re.compile(r"(?i)(?:\b(?:address|adresse|home|wohnhaft|lives at|moved to|send|ship|at|addr=?|domicili|street|deliver)\b[^\n]{0,60}|;\s|,\")$")
_CITY_AFTER = re.compile(rf"^\.?,?{_GAP}?(?:(?:Apt|Unit|Suite|Flat|bajo|bas|\d+\.?[ºª°])[^,\n]{{0,12}}(?:,{_GAP}|[ \t]*\n[ \t]*))?(?:\d{{4,5}}{_GAP}[A-ZÀ-Þ]|[A-ZÀ-Þ][\w-]+,?{_GAP}(?:[A-Z]{{2}}{_GAP}\d{{5}}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_GAP}?\d[A-Z]{{2}}))")

#: The labelers of each kind in the order of their bits, and whether each speaks for (1) or against (-1) a span; 0 is a
#: sign that takes no side.
VOTES = {
    "email": {"plain": 1, "hidden": 1, "top_level": 1, "remote": -1, "in_url": -1, "version": -1},
    "phone": {"international": 1, "grouped": 1, "long": 1, "context": 1, "other_number": -1, "dated": -1},
    "id_number": {"formed": 1, "context": 1, "phone": -1, "other_number": -1, "bare": -1},
    "address": {"street": 1, "city": 1, "context": 1, "numbered_list": -1},
    "name": {"before": 1, "after": 1, "title_or_row": 1, "first_known": 1, "second_known": 1, "common": -1, "initial": 0},
}

_STRUCT = "line_no int, start int, stop int, kind string, first string, second string, votes int, features array<int>"


def _bits(flags: tuple) -> int:
    return sum(1 << i for i, f in enumerate(flags) if f)


def _mails(text: str) -> Iterator[re.Match]:
    """Matches of the mailbox pattern around each sign that stands for an @, from the word before it to where a host ends."""
    spots = []
    for sign in ("@", "&#64;"):
        at = text.find(sign)
        while at >= 0:
            spots.append((at, at + len(sign)))
            at = text.find(sign, at + 1)
    low = text.lower()
    if "at" in low and ("dot" in low or "(at" in low or "[at" in low or "( at" in low or "[ at" in low or " AT " in text):
        spots += [m.span() for m in _AT.finditer(text)]
    end = 0
    for a, b in sorted(spots):
        while a > 0 and text[a - 1].isspace():
            a -= 1
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_.+-"):
            a -= 1
        if m := _MAIL.search(text, max(a, end), _HOST.match(text, b).end()):
            if m.start() < b:
                end = m.end()
                yield m


_AT = re.compile(r"[\[(] ?at ?[\])]|\sat\s(?=[\w-]+\sdot\s)|(?-i:\sAT\s)(?=[\w-]+\.\w)", re.I)
#: All signs of a host, hidden ones too, and the sign after them.
_HOST = re.compile(r"[A-Za-z0-9.\-\[\]()\s]*[\s\S]?")
_WORD = re.compile(r"\S+")
#: Words before and after a street word that an address may take.
REACH = 10


def _addresses(text: str) -> Iterator[re.Match]:
    """Matches of the address pattern in the words around what every address form holds, where a digit is near."""
    ends = lambda e, word: not (text[e + 1 : e + 2].isalnum() or text[e + 1 : e + 2] == "_") if word else text[e + 1 : e + 2].isspace()
    spots = [e for e, word in _PLACES.iter(text) if ends(e, word)] + [m.start() for m in _POSTCODE.finditer(text)]
    if not spots:
        return
    begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    stretches = []
    for e in spots:
        i = bisect_right(begins, e)
        a, b = begins[max(0, i - REACH)], begins[min(len(begins) - 1, i + REACH)]
        if _DIGIT.search(text, a, b):
            stretches.append((a, b))
    for a, b in _merged(stretches):
        end = begins[min(len(begins) - 1, bisect_left(begins, b) + REACH)]
        while m := _ADDRESS.search(text, a, end):
            if m.start() >= b:
                break
            yield m
            a = max(m.end(), m.start() + 1)


_DIGIT = re.compile(r"\d")


def _near(text: str, sign: re.Pattern, before: int, after: int) -> list[tuple[int, int]]:
    return _merged([(max(0, m.start() - before), m.end() + after) for m in sign.finditer(text)])


def _merged(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _inside(text: str, pattern: re.Pattern, stretches: list[tuple[int, int]]) -> Iterator[re.Match]:
    """Matches that begin in one of the stretches; a match may end beyond it."""
    for a, b in stretches:
        at = a
        while m := pattern.search(text, at, min(len(text), b + 120)):
            if m.start() >= b:
                break
            yield m
            at = max(m.end(), m.start() + 1)


def features(text: str, a: int, b: int, kind: str) -> list[int]:
    """Hashes of the span's shape (letters by case in runs, digits one by one) and of what stands around it."""
    before, after = text[max(0, a - 40) : a], text[b : b + 30]
    line = before.rsplit("\n", 1)[-1]
    words = [re.sub(r"\d", "0", w) for w in re.findall(r"\w+|[^\w\s]", line.lower())][-3:]
    following = re.findall(r"\w+|[^\w\s]", after.split("\n", 1)[0].lower())[:2]
    shape = re.sub(rf"[{_LOW}]+", "a", re.sub(rf"[{_UP}]+", "A", re.sub(r"\d", "9", text[a:b])))
    last = words[-1] if words else "^" if line == before or a == 0 else ""
    found = (
        f"s{shape}", f"b{last}", f"c{' '.join(words[-2:])}", f"d{' '.join(words)}", f"a{following[0] if following else '$'}", f"e{' '.join(following)}",
        f"x{last}|{following[0] if following else '$'}",
    )
    return [zlib.crc32(f"{kind}:{f}".encode()) % FEATURES for f in found]


def propose(text: str) -> list[tuple]:
    """(line_no, start, stop, kind, first token, second token, votes, features); tokens are set for names only."""
    out: list[tuple] = []
    add = lambda a, b, kind, flags, x=None, y=None: out.append((text.count("\n", 0, a) + 1, a, b, kind, x, y, _bits(flags), features(text, a, b, kind)))
    for m in _mails(text):
        a, b = m.span()
        before, after = text[max(0, a - 40) : a], text[b : b + 3]
        plain = m["at"] == "@"
        remote = plain and after[:1] in (":", "/") and not after[1:2].isspace() or m["user"].lower() in ("git", "hg", "svn") and plain
        in_url = bool(re.search(r"(?:://|://[^\s/@]*:|:)[^\s]*$", before)) or bool(re.search(r"://\S*$", before))
        last = re.split(r"[.\s]+|dot", m["host"].strip("])( "))[-1]
        add(a, b, "email", (plain, not plain, last.isalpha() and len(last) >= 2, remote, in_url, last.isdigit() or m["host"][:1].isdigit()))
    numbers = _near(text, _DIGITS, 6, 4)
    for m in _inside(text, _PHONE, numbers):
        a, b = m.span()
        v = m[0]
        if v[-1] == ")" and v.count(")") > v.count("("):
            v, b = v[:-1], b - 1
        digits = sum(c.isdigit() for c in v)
        if not 9 <= digits <= 14:
            continue
        before = text[max(0, a - 60) : a].rsplit("\n", 1)[-1]
        groups = re.split(r"[^\d]+", v.strip("(+"))
        dated = bool(re.match(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}|\d+\.\d+\.\d+\.\d+$", v)) or max(map(len, groups)) > 11
        national = bool(re.match(r"(?:1[2-9]\d{2}[2-9]\d{6}|\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}|0\d[\d /()-]{8,})$", v))
        row = bool(re.search(r"(?:^|,)$", before) and before.count(",") >= 2)
        context = bool(_PHONE_BEFORE.search(before)) or row or text[b : b + 9].lower() == " (mobile)"
        add(a, b, "phone", (v[0] == "+" and digits >= 10, national and len(groups) > 1, 10 <= digits <= 13, context and (national or v[0] == "+"), bool(_NUMBER_BEFORE.search(before)), dated or not (national or v[0] == "+")))
    for m in _inside(text, _ID, numbers):
        a, b = m.span()
        v = m[0]
        before = re.sub(r"\s*\n[\s/#*]*", " ", text[max(0, a - 60) : a])
        tail = text[b : b + 5]
        cued = bool(_ID_BEFORE.search(before)) or before.endswith("(") and tail[:1] == ")" and not v.isdigit()
        formed = not v[0].isdigit() or not v[-1].isdigit() or bool(re.match(r"\d{3}-\d{2}-\d{4}$|\d{3} \d{2} \d{4}$", v)) and (v[3] == "-" or cued)
        called = bool(_PHONE_BEFORE.search(before)) and not cued or bool(re.match(r"0\d[\d ]{8,}$", v))
        add(a, b, "id_number", (formed, cued, called, bool(_NUMBER_BEFORE.search(before)) and not cued, v.isdigit() and not cued))
    for m in _addresses(text):
        a, b = m.span()
        v = m[0]
        before, after = text[max(0, a - 80) : a].rsplit("\n", 1)[-1], text[b : b + 60]
        street = bool(re.search(rf"(?i)\b{_STREET}\b|straße|strasse|weg|gasse|platz|allee|\brue\b|calle|avenida|avda|plaza|boulevard|avenue", v))
        listed = bool(re.search(r"(?i)\b(?:section|step|chapter|version|release|row|build|run|page|figure|table|part)\s*$", before))
        add(a, b, "address", (street, bool(_CITY_AFTER.match(after)), bool(_ADDRESS_BEFORE.search(before)), listed))
    last = None
    for m in _TOKEN.finditer(text):
        if last is not None and m.start() - last.end() <= 8 and (gap := text[last.end() : m.start()]) and _BETWEEN.match(gap):
            x, y = last[0], m[0]
            if len(y) > 1 and (len(x) > 1) == (gap[0] != "."):
                a, b = last.span()[0], m.end()
                before, after = text[max(0, a - 40) : a], text[b : b + 24]
                comma, numbered = gap[0] == ",", after[:2].strip()[:1].isdigit()
                if not numbered and (not (comma and (len(x) < 3 or len(y) < 3)) and x.isupper() == y.isupper() or len(x) == 1):
                    add(a, b, "name", (_NAME_BEFORE.search(before), _NAME_AFTER.match(after), _TITLE.search(before) or _ROW.search(text[max(0, a - 6) : a]), False, False, False, len(x) == 1), x.lower(), y.lower())
        last = m
    return out


def records(file_nodes: DataFrame, timelines: DataFrame) -> DataFrame:
    """(origin, rec_id, text) of files and of posts; posts are parsed once and cut, as they are read again."""
    files = file_nodes.filter("ord is not null and content is not null").select(
        F.lit("file_nodes").alias("origin"), F.col("ord").cast("string").alias("rec_id"), F.col("content").cast("string").alias("text")
    )
    f = F.col("fields")
    posts = cut(thread_nodes(timelines).filter("type = 'post'").select(
        F.lit("timelines").alias("origin"), f.getItem("id_str").alias("rec_id"), f.getItem("full_text").alias("text")
    ).filter("rec_id is not null and text is not null").distinct())
    return files.unionByName(posts)


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()))
    names = ["origin", "rec_id", "line_no", "start", "stop", "kind", "first", "second", "votes", "features"]
    for batch in batches:
        rows = []
        for origin, rec, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows += [(origin, rec, *x) for x in propose(text)]
        cols = list(zip(*rows)) if rows else [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def spans(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_proposals, "origin string, rec_id string, " + _STRUCT)


def with_gazetteers(proposed: DataFrame, texts: DataFrame) -> DataFrame:
    """Proposals with the gazetteers' votes. Tokens of names are learnt from the pairs that stand where a name must."""
    names = proposed.filter("kind = 'name'")
    cued = (F.col("votes").bitwiseAND(1) > 0).cast("int") + (F.col("votes").bitwiseAND(2) > 0).cast("int") + (F.col("votes").bitwiseAND(4) > 0).cast("int")
    pairs = names.withColumn("cue", (cued > 0).cast("int")).groupBy("first", "second").agg(F.count("*").alias("n"), F.sum("cue").alias("cues"))
    tokens = pairs.select(F.explode(F.array("first", "second")).alias("token"), "n", "cues").filter(F.length("token") > 1).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("cues").alias("cues"), F.count("*").alias("partners")
    )
    lower = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_@.&#-])\p{Ll}{2,}(?![\p{L}\p{N}_@.(=&#-])"), F.lit(0))).alias("token"))
    lower = lower.groupBy("token").agg(F.count("*").alias("low"))
    gazetteer = cut(tokens.join(lower, "token", "left").select(
        "token", ((F.col("cues") >= NAME_CUES) & (F.col("cues") >= NAME_SHARE * F.col("n"))).alias("known"), (F.coalesce("low", F.lit(0)) > COMMON * F.col("n")).alias("common")
    ))
    gazetteer = small(gazetteer)
    one = gazetteer.select(F.col("token").alias("first"), F.col("known").alias("k1"), F.col("common").alias("c1"))
    two = gazetteer.select(F.col("token").alias("second"), F.col("known").alias("k2"), F.col("common").alias("c2"))
    bit = lambda c, i: F.when(c, F.lit(1 << i)).otherwise(0)
    k1, k2 = F.coalesce("k1", F.lit(False)), F.coalesce("k2", F.lit(False))
    common = (F.coalesce("c1", F.lit(False)) & ~k1) | (F.coalesce("c2", F.lit(False)) & ~k2)
    judged = names.join(one, "first", "left").join(two, "second", "left").withColumn("votes", F.col("votes") + bit(k1, 3) + bit(k2, 4) + bit(common, 5))
    return proposed.filter("kind <> 'name'").unionByName(judged.select(*proposed.columns))


def estimate(counts: dict[int, int], signs: tuple[int, ...]) -> dict[int, float]:
    """What each vote pattern means: EM over pattern counts (labelers independent given the truth). A span's first belief
    leans by the number of votes for it, and the other way if there is any against it; all labelers count alike."""
    if not counts:
        return {}
    patterns = sorted(counts)
    x = np.array([[(p >> i) & 1 for i in range(len(signs))] for p in patterns], dtype=float)
    n = np.array([counts[p] for p in patterns], dtype=float)
    own, other = np.array([HABIT[s] for s in signs]).T
    against = x[:, [s < 0 for s in signs]].sum(axis=1)
    lean = np.where(against > 0, -1, np.minimum(x[:, [s > 0 for s in signs]].sum(axis=1), 2))
    posterior = 0.5 + TILT * np.where(lean == 0, -0.5, lean)  # a span without any vote is rather none
    for _ in range(ROUNDS):
        good, bad = n * posterior, n * (1 - posterior)
        p1, p0 = (x.T @ good + WEIGHT * own) / (good.sum() + WEIGHT), (x.T @ bad + WEIGHT * other) / (bad.sum() + WEIGHT)
        share = (good.sum() + WEIGHT / 2) / (n.sum() + WEIGHT)
        ratio = np.log(share / (1 - share)) + x @ np.log(p1 / p0) + (1 - x) @ np.log((1 - p1) / (1 - p0))
        posterior = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
    return {k: float(v) for k, v in zip(patterns, posterior)}


def _vote_features(kind: str) -> list[int]:
    """The classifier's features of the labelers' votes and of each labeler's silence."""
    return [zlib.crc32(f"{kind}:vote {i}".encode()) % FEATURES for i in range(2 * len(VOTES[kind]))]


def _with_votes(features: np.ndarray, votes: np.ndarray, kind: str) -> np.ndarray:
    own, n = np.array(_vote_features(kind)), len(VOTES[kind])
    cast = (votes[:, None] >> np.arange(n)) & 1
    return np.hstack([features, own[np.arange(n) + n * (1 - cast)]])


def fit(features: np.ndarray, belief: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic classifier for soft labels, by steps scaled to each feature's own slope."""
    known, at = np.unique(features, return_inverse=True)
    at = at.reshape(features.shape)
    w, slope = np.zeros(len(known)), np.full(len(known), 1e-6)
    bias, bias_slope = 0.0, 1e-6
    counts = np.bincount(at.ravel(), minlength=len(known))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(bias + w[at].sum(axis=1), -30, 30)))
        error = np.repeat(p - belief, at.shape[1])
        g = np.bincount(at.ravel(), weights=error, minlength=len(known)) + PRIOR * w
        slope += g * g
        bias_slope += float((p - belief).sum()) ** 2
        w -= 0.5 * g / np.sqrt(slope)
        bias -= 0.5 * float((p - belief).sum()) / np.sqrt(bias_slope)
    out = np.zeros(FEATURES)
    out[known[counts > 0]] = w[counts > 0]
    return out, bias


def train(voted: DataFrame) -> dict[str, tuple[np.ndarray, float]]:
    """The classifier of each kind that has spans. EM sees the counts of all spans."""
    rows = voted.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 2^votes rows a kind
    out = {}
    for kind, signs in VOTES.items():
        meaning = estimate({r.votes: r.n for r in rows if r.kind == kind}, tuple(signs.values()))
        if meaning:
            own = voted.filter(F.col("kind") == kind).select("votes", "features", "start", F.xxhash64("origin", "rec_id", "start").alias("h"))
            sample = own.orderBy("h", "start").limit(SAMPLE_SPANS).select("votes", "features").toArrow()
            votes = sample.column("votes").to_numpy()
            x = np.array(sample.column("features").to_pylist(), dtype=np.int64)
            out[kind] = fit(_with_votes(x, votes, kind), np.array([meaning[v] for v in votes.tolist()]))
    return out


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            n = batch.num_rows
            kinds, votes = np.array(batch.column("kind").to_pylist(), dtype=object), batch.column("votes").to_numpy()
            x = np.array(batch.column("features").to_pylist(), dtype=np.int64) if n else np.zeros((0, 1), dtype=np.int64)
            p = np.zeros(n)
            for kind, (w, bias) in models.items():
                own = np.flatnonzero(kinds == kind)
                if len(own):
                    z = bias + w[_with_votes(x[own], votes[own], kind)].sum(axis=1)
                    p[own] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(p)], names=["origin", "rec_id", "line_no", "start", "stop", "kind", "probability"])

    return run


def judged(texts: DataFrame) -> DataFrame:
    """(origin, rec_id, line_no, start, stop, kind, probability) of every proposed span."""
    proposed = cut(spans(texts))
    voted = cut(with_gazetteers(proposed, texts))
    shared = texts.sparkSession.sparkContext.broadcast(train(voted))
    rows = voted.select("origin", "rec_id", "line_no", "start", "stop", "kind", "votes", "features")
    return rows.mapInArrow(_judge(shared), "origin string, rec_id string, line_no int, start int, stop int, kind string, probability double")


def found(file_nodes: DataFrame, timelines: DataFrame) -> DataFrame:
    return judged(records(file_nodes, timelines)).filter(F.col("probability") >= THRESHOLD).select("origin", "rec_id", "line_no", "kind").distinct()


def redacted(file_nodes: DataFrame, timelines: DataFrame) -> DataFrame:
    """(origin, rec_id, text) of the records with personal information, each span replaced by [KIND]."""
    texts = records(file_nodes, timelines)
    hits = cut(judged(texts).filter(F.col("probability") >= THRESHOLD).groupBy("origin", "rec_id").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts, end = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                    if s["start"] >= end:
                        parts += [text[end : s["start"]], f"[{s['kind'].upper()}]"]
                        end = s["stop"]
                out.append("".join(parts) + text[end:])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["origin", "rec_id", "text"])

    joined = attached(texts, hits, ["origin", "rec_id"], F.size("spans") * 24 + 32).select("origin", "rec_id", "text", "spans")
    return joined.mapInArrow(run, "origin string, rec_id string, text string")
