"""Noise in text from scanned pages: running headers, page numbers, words cut at line ends, misrecognised characters.

Lines are rows, and everything about the order of lines is a window over one scan. Words are grouped by their skeleton:
each letter is replaced by the strokes that scanning confuses it with (m, rn and n, ri end alike), letter by letter, so
that a word and its misreadings always share the skeleton. In a skeleton's group the form that clean texts and scans
support most is the true one; a form far rarer than it is a misreading where the neighbouring words have been seen with
the true form too, or where it is too rare to be a word of its own.

Furniture is found by masking digits (and the letters that stand for digits) and comparing lines of a scan by the
skeletons of what is left: lines that come again, page numbers, and columns that no running text has.

A hyphen at a line's end belongs to the word if the corpus writes the compound with a hyphen more often than without.

Defined results: null content is no case; blank lines have no kind; a scan without text gives nothing; `ord` tells scans
apart, and the same text under another ord is a scan of its own (each counts in the word counts); CRLF ends are line ends;
very long scans are one window partition each, sorted with spilling; a line in capitals within a page is a heading and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, small

SCAN = r"(?i)\.(?:pdf|png|jpe?g|tiff?)$"
CLEAN = r"(?i)(?:^https?://|\.(?:md|rst|txt)$)"
#: Letters and the strokes they are confused by (fixed values).
STROKES = {
    "m": "rrl", "n": "rl", "u": "ll", "ü": "ll", "d": "el", "w": "vv", "h": "b", "i": "l", "í": "l", "1": "l", "|": "l", "!": "l", "0": "o", "5": "s", "c": "e", "q": "g", "9": "g",
    "f": "t", "8": "b", "6": "b",
}
#: A form this much rarer than the group's best is doubtful; this much rarer it needs no context.
DOUBTFUL, CERTAIN = 6, 40
LEAST_WEIGHT = 4
#: How much more a clean text's word counts than a scan's.
CLEAN_WEIGHT = 3

_WORD = r"[\p{L}\p{N}]+"
_COMPOUND = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"


def skeleton(c: Column) -> Column:
    """Letter by letter, so that equal strokes give equal skeletons whatever was read."""
    c = F.lower(c)
    many = {k: v for k, v in STROKES.items() if len(v) > 1}
    ones = {k: v for k, v in STROKES.items() if len(v) == 1}
    c = F.translate(c, "".join(ones), "".join(ones.values()))
    for k, v in many.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def lines(file_nodes: DataFrame) -> DataFrame:
    """(ord, line_no, text) of every line of every scan."""
    rows = file_nodes.filter(F.col("content").isNotNull() & F.col("path").rlike(SCAN) & ~F.col("path").rlike(r"^(?i)https?://"))
    return rows.select(
        F.col("ord").cast("long").alias("ord"), F.posexplode(F.split(F.col("content"), "\n")).alias("at", "raw")
    ).select("ord", (F.col("at") + 1).cast("int").alias("line_no"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"))


def marked(file_nodes: DataFrame) -> DataFrame:
    """Lines with `furniture`, and for lines of text `next_text` (the next line of text) and `cut_before`."""
    rows = lines(file_nodes)
    text = F.col("text")
    blank = text == ""
    image = text.startswith("## Image Text:")
    digit = r"[\dlIOo]"
    # a number, where a scan may have read l, I, O or o for a digit, in page-number dress
    number = text.rlike(rf"^(?i:page|seite|p\.|s\.)\s*{digit}{{1,4}}(?:\s*(?i:of|/|von|de|sur)\s*{digit}{{1,4}})?$") | text.rlike(
        rf"^[\[\-–—(|.\s]*(?=[\dlIOo]*\d){digit}{{1,4}}[\])\-–—|.\s]*$"
    ) | text.rlike(rf"^\[{digit}{{1,4}}\]$|^[-–—] {digit}{{1,4}} [-–—]$") | text.rlike(rf"\s/\s(?:p\.|page|seite)\s*{digit}{{1,4}}$")
    columns = text.rlike(r"\S(?: {2,}|\t+)\S")
    key = skeleton(F.regexp_replace(F.regexp_replace("text", rf"\b(?=\w*\d){digit}+\b", "0"), r"[^\p{L}\p{N}]+", " "))
    w = Window.partitionBy("ord")
    ordered = w.orderBy("line_no")
    filled = F.when(~blank & ~image, F.col("line_no"))
    titled = ~text.rlike(r"[.,;:!?\-]$") & text.rlike(r"^[\p{Lu}\p{N}]") & text.contains(" ") & (F.length("text") <= 70)
    rows = (
        rows.withColumns({"blank": blank, "image": image, "plain": number | columns, "titled": titled & ~blank, "key": F.when(~blank & ~image, key)})
        .withColumn("again", F.count("key").over(Window.partitionBy("ord", "key")))
        .withColumn("first_line", F.min(filled).over(w))
        .withColumn("width", F.max(F.when(~F.col("blank") & ~F.col("plain") & ~F.col("image"), F.length("text"))).over(w))
        .withColumn("following", F.lead("text").over(ordered))
    )
    # a break before the line is full, though the next word would have fitted, is meant
    meant = F.length("text") + 1 + F.length(F.regexp_extract("following", r"^\S+", 0)) <= F.col("width")
    head = (F.col("line_no") == F.col("first_line")) & F.col("titled") & (meant | (F.col("following") == "") | (F.upper("text") == text))
    again = (F.col("again") > 1) & F.col("titled") & (meant | (F.col("following") == "") | (F.upper("text") == text) | F.col("following").isNull())
    # the first line of a page, after the last one's number
    before = F.last(F.when(~F.col("blank"), F.col("plain")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    top = before & F.col("titled") & (meant | (F.col("following") == ""))
    # a line in capitals heads a page if it stands where pages begin or end, else a section
    after = F.first(F.when(~F.col("blank"), F.col("plain")), ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    edge = before | after | (F.col("line_no") == F.col("first_line"))
    capitals = F.col("titled") & (F.upper("text") == text) & text.rlike(r"\p{Lu}{2,}.* .*\p{Lu}{2,}") & (edge | (F.col("again") > 1))
    rows = rows.withColumn("furniture", ~F.col("blank") & ~F.col("image") & F.coalesce(F.col("plain") | head | again | top | capitals, F.lit(False)))
    body = F.when(~F.col("blank") & ~F.col("furniture") & ~F.col("image"), F.col("text"))
    rows = rows.withColumn("body", body)
    later = ordered.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("next_text", F.first("body", ignorenulls=True).over(later)).select("ord", "line_no", "furniture", "body", "next_text")


_HYPHEN = r"^(?s:.*?)([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)-$"


def _with_cuts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`split`: the line's last word goes on in the next line of text and its hyphen must vanish."""
    left = F.regexp_extract("body", _HYPHEN, 1)
    right = F.regexp_extract("next_text", r"^([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)", 1)
    ends = rows.filter(F.col("body").rlike(r"[\p{L}\p{N}]-$") & F.col("next_text").rlike(r"^[\p{L}\p{N}]")).select(
        "ord", "line_no", skeleton(F.concat(left, F.lit("-"), right)).alias("whole"),
        skeleton(F.concat(F.regexp_extract(left, r"([\p{L}\p{N}]+)$", 1), F.regexp_extract(right, r"^([\p{L}\p{N}]+)", 1))).alias("joined"), right.alias("right"),
    )
    seen = counts.groupBy("skel").agg(F.sum("weight").alias("n"))
    ends = ends.join(seen.select(F.col("skel").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(
        seen.select(F.col("skel").alias("joined"), F.col("n").alias("n_joined")), "joined", "left"
    )
    vanish = ~((F.coalesce("n_whole", F.lit(0)) > F.coalesce("n_joined", F.lit(0))) | F.col("right").rlike(r"^\d"))
    return rows.join(ends.select("ord", "line_no", vanish.alias("split")), ["ord", "line_no"], "left").withColumn("split", F.coalesce("split", F.lit(False)))


def _forms(texts: DataFrame, pattern: str, weight: int) -> DataFrame:
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("form")).groupBy("form").agg(
        F.count("*").alias("n")
    ).select("form", "n", F.lit(weight).alias("each"))


def word_counts(file_nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(form, skel, clean, weight) of every word and hyphenated compound of scans' lines and of clean texts. The word at a
    line's end that a hyphen cuts, and the one after it, are left out."""
    clean = file_nodes.filter(F.col("content").isNotNull() & F.col("path").rlike(CLEAN)).select(F.col("content").alias("text"))
    inner = rows.filter("body is not null").select(F.regexp_replace(F.regexp_replace("body", r"[\p{L}\p{N}-]+-$", ""), r"^\S+ ?", "").alias("text"))
    both = None
    for texts, w in ((clean, CLEAN_WEIGHT), (inner, 1)):
        for pattern in (_WORD, _COMPOUND):
            part = _forms(texts, pattern, w)
            both = part if both is None else both.unionByName(part)
    return both.groupBy("form").agg(
        F.sum(F.when(F.col("each") > 1, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.col("n") * F.col("each")).alias("weight")
    ).select("form", skeleton(F.col("form")).alias("skel"), "clean", "weight")


def misreadings(counts: DataFrame) -> DataFrame:
    """(form, best, ratio): forms of a skeleton that are doubtful, and the form that is supported most."""
    w = Window.partitionBy("skel")
    has_digit = F.col("form").rlike(r"\p{N}") & F.col("form").rlike(r"\p{L}")
    letters = F.col("form").rlike(r"^\p{L}+$")
    best = F.max(F.when(letters, F.struct("weight", "form", "clean"))).over(w)
    rows = counts.filter(F.col("form").rlike(_WORD) & ~F.col("form").contains("-")).withColumn("best", best)
    ratio = F.col("best.weight") / F.col("weight")
    doubtful = (ratio >= DOUBTFUL) & (F.col("best.weight") >= LEAST_WEIGHT) & ((F.col("clean") == 0) | (F.col("clean") * 200 < F.col("best.clean")))
    return rows.filter(
        (F.col("form") != F.col("best.form")) & F.col("form").rlike(r"\p{L}") & (F.length("form") >= 2)
        & (doubtful | (has_digit & (F.col("best.weight") >= LEAST_WEIGHT) & (F.length("form") >= 3)))
    ).select("form", F.col("best.form").alias("best"), F.when(has_digit, F.lit(1e9)).otherwise(ratio).alias("ratio"))


def _tokens(rows: DataFrame) -> DataFrame:
    """(ord, line_no, form, before, after) of each word of running text, at the line on which it starts; a cut word is one."""
    goes_on = F.lag(F.when(F.col("body").isNotNull(), F.col("split")), 1).over(Window.partitionBy("ord").orderBy("line_no"))
    text = rows.filter("body is not null").withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    head = F.when(F.col("goes_on"), F.regexp_replace("body", r"^[\p{L}\p{N}]+", "")).otherwise(F.col("body"))
    whole = F.when(F.col("split"), F.concat(F.regexp_replace(head, "-$", ""), F.regexp_extract("next_text", r"^[\p{L}\p{N}]+", 0))).otherwise(head)
    words = F.regexp_extract_all(F.lower(whole), F.lit(_WORD), F.lit(0))
    return (
        text.select("ord", "line_no", words.alias("words")).select("ord", "line_no", "words", F.posexplode("words").alias("at", "form"))
        .select("ord", "line_no", "form", F.get("words", F.col("at") - 1).alias("before"), F.get("words", F.col("at") + 1).alias("after"))
    )


def repaired(file_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with furniture, body and split; misread words with the form chosen for them)."""
    rows = cut(marked(file_nodes))
    counts = cut(word_counts(file_nodes, rows))
    rows = cut(_with_cuts(rows, counts))
    tokens = cut(_tokens(rows))  # used for the counts, the doubtful words and the neighbours of good ones
    # now that cut words are whole, scans' words are counted anew
    whole = counts.filter("clean > 0").select("form", "clean", (F.col("clean") * CLEAN_WEIGHT).alias("weight")).unionByName(
        tokens.groupBy("form").agg(F.lit(0).cast("long").alias("clean"), F.count("*").alias("weight"))
    ).groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("weight").alias("weight"))
    wrong = cut(misreadings(whole.withColumn("skel", skeleton(F.col("form")))))
    odd = tokens.join(small(wrong), "form")
    # context: a neighbour (by skeleton) that stands beside the best form somewhere
    bests = wrong.filter(F.col("ratio") < CERTAIN).select(F.col("best").alias("form")).distinct()
    beside = tokens.join(small(cut(bests)), "form", "left_semi").select(
        "form", F.explode(F.array(F.concat(F.lit("<"), skeleton(F.col("before"))), F.concat(F.lit(">"), skeleton(F.col("after"))))).alias("near")
    ).filter("near is not null").groupBy("form", "near").agg(F.count("*").alias("n"))
    asked = odd.withColumn("id", F.struct("ord", "line_no", "form", "best", "ratio")).select(
        "id", F.col("best").alias("form"),
        F.explode(F.array(F.lit("-"), F.concat(F.lit("<"), skeleton(F.col("before"))), F.concat(F.lit(">"), skeleton(F.col("after"))))).alias("near"),
    ).filter("near is not null")
    backed = asked.join(small(cut(beside)), ["form", "near"], "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("support"))
    misread = backed.filter((F.col("id.ratio") >= CERTAIN) | (F.col("support") > 0)).select("id.ord", "id.line_no", "id.form", "id.best")
    return rows, misread


def found(file_nodes: DataFrame) -> DataFrame:
    """(ord, line_no, kind), distinct."""
    rows, misread = repaired(file_nodes)
    return (
        rows.filter("furniture").select("ord", "line_no", F.lit("furniture").alias("kind"))
        .unionByName(rows.filter("split").select("ord", "line_no", F.lit("split").alias("kind")))
        .unionByName(misread.select("ord", "line_no", F.lit("misread").alias("kind"))).distinct()
    )


def paragraphs(file_nodes: DataFrame) -> DataFrame:
    """(ord, paragraph_no, text): running text without furniture, cut words joined, misread words replaced, a paragraph a
    row. A blank line between two lines of text ends a paragraph unless the text before it runs on."""
    rows, misread = repaired(file_nodes)
    fixes = misread.select("ord", "line_no", "form", "best").distinct().groupBy("ord", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("form", "best"))).alias("fixes"))
    text = rows.join(fixes, ["ord", "line_no"], "left").withColumn("blank", F.col("body").isNull() & ~F.col("furniture"))
    w = Window.partitionBy("ord").orderBy("line_no")
    text = text.filter("body is not null or blank").withColumn("body_before", F.last("body", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.lag("blank").over(w) & F.col("body_before").rlike(r"[.!?:]['\")]*$")
    begins = F.col("body").isNotNull() & (F.col("body_before").isNull() | gap)
    text = text.withColumn("paragraph_no", F.sum(F.when(begins, 1).otherwise(0)).over(w)).filter("body is not null")
    goes_on = F.coalesce(F.lag("split").over(w), F.lit(False))
    line = F.when(goes_on, F.regexp_replace("body", r"^[\p{L}\p{N}]+", "")).otherwise(F.col("body"))
    line = F.when(F.col("split"), F.concat(F.regexp_replace(line, "-$", ""), F.regexp_extract("next_text", r"^[\p{L}\p{N}]+", 0))).otherwise(line)
    words = F.regexp_extract_all(line, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    fixed = F.array_join(F.transform(words, lambda x: F.coalesce(_like(x, F.element_at(F.coalesce("fixes", F.create_map().cast("map<string,string>")), F.lower(x))), x)), "")
    glue = F.when(goes_on | F.coalesce(F.lag("body").over(w).rlike(r"-$") & ~F.lag("split").over(w), F.lit(False)), F.lit("")).otherwise(F.lit(" "))
    text = text.withColumns({"line": fixed, "glue": glue})
    joined = F.array_sort(F.collect_list(F.struct("line_no", "glue", "line")))
    return text.groupBy("ord", "paragraph_no").agg(joined.alias("parts")).select(
        "ord", "paragraph_no", F.regexp_replace(F.array_join(F.transform("parts", lambda p: F.concat(p["glue"], p["line"])), ""), r"^\s+| (?= )", "").alias("text")
    )


def _like(word: Column, best: Column) -> Column:
    """`best` with the capital of `word`."""
    return F.when(word.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(best, 1, 1)), F.substring(best, 2, 10_000))).otherwise(best)
