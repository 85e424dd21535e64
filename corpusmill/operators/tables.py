"""Tables, conversations and transcripts as text.

Null and blank fields are left out of records but their rows keep their numbers; null texts of turns render as ''.
"""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.corpus import numbered


def column_letters(n: Column) -> Column:
    """0 is A, 25 Z, 26 AA, 701 ZZ, 702 AAA, up to five letters."""
    letter = lambda x: F.chr(F.lit(65) + F.pmod(x, F.lit(26)))
    out, rest = letter(n), n
    for _ in range(4):
        rest = F.floor(rest / 26) - 1
        out = F.when(rest >= 0, F.concat(letter(rest), out)).otherwise(out)
    return out


def letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def records(rows: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """(row, line): `Row n: Col A: v; Col B: v` for each row; a whole-number `order` numbers the rows."""
    cells = [F.when(F.trim(F.col(f).cast("string")) != "", F.concat(F.lit(f"Col {letters(i)}: "), F.col(f).cast("string"))) for i, f in enumerate(fields)]
    n = numbered(rows, order, "row")
    return n.select("row", F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), F.concat_ws("; ", *cells)).alias("line"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, body): distinct turns in order, each under its speaker. A conversation is one value by definition."""
    text = F.coalesce("text", F.lit(""))
    label = F.when(F.col("role") == "user", "**User:**\n").when(F.col("role") == "assistant", "**Gemini:**\n").otherwise("**Message:**\n")
    parts = turns.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.concat(label, text, F.lit("\n\n")).alias("part")).distinct()
    ordered = F.array_sort(F.collect_list(F.struct("turn", "part")))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("body"))


def srt_text(srt: Column) -> Column:
    """Lines of speech: no blank lines, numbers or times, no << and >>."""
    lines = F.filter(F.split(srt, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\d+$") & ~x.contains("-->"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), ("<<", ">>"), F.array_join(F.transform(lines, F.trim), "\n"))


def transcript_text(xml: Column) -> Column:
    """The texts of a caption file, one a line."""
    parts = F.transform(F.xpath(xml, F.lit("//text/text()")), lambda x: F.trim(F.replace(F.replace(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("&#39;"), F.lit("'")), F.lit("&quot;"), F.lit('"'))))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def best_tracks(tracks: DataFrame, preferred: str = "en") -> DataFrame:
    """(video_id, track_id): a manual English track, else a manual one of the preferred language, else automatic ones
    alike, else the first; of equals the later (the first, for the last class)."""
    auto = F.col("vss_id").startswith("a.")
    lang = F.regexp_extract("vss_id", r"\.([A-Za-z]+)[^.]*$", 1)
    order = F.when(~auto & (lang == "en"), 0).when(~auto & (lang == preferred), 1).when(auto & (lang == "en"), 2).when(auto & (lang == preferred), 3).otherwise(4)
    key = F.struct(order.alias("o"), F.when(order == 4, F.col("track_id")).otherwise(-F.col("track_id")).alias("t"))
    return tracks.groupBy("video_id").agg(F.min_by("track_id", key).alias("track_id"))


def stream_chunks(raw: DataFrame) -> DataFrame:
    """(ord, chunk): JSON lines that follow a line with their length, from (ord, body); arrays only."""
    lines = raw.select("ord", F.split("body", "\n").alias("l"))
    pairs = lines.select("ord", F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", F.lit(2), F.size("l")))).alias("at", "p"))
    return pairs.filter(F.col("p.0").rlike(r"^\d+$") & F.col("p.1").startswith("[") & F.expr("try_parse_json(p.`1`)").isNotNull()).select("ord", F.col("p.1").alias("chunk"))


def csv_text(text: str, name: str) -> str:
    """A CSV file as a sequence of records under its name. Blank fields are left out, blank lines are no rows; a row of
    another width than the first is an error."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("rows of different widths")
    parts = ["; ".join(f"Col {letters(i)}: {v}" for i, v in enumerate(r) if v.strip()) for r in rows]
    return f"## Dataset: {name}\n\n" + "".join(f"Row {n}: {p}\n" for n, p in enumerate(parts, 1))


def dataset(lines: DataFrame, name: str) -> DataFrame:
    """(row, line) with the header of the data set as row 0, from `records`."""
    head = lines.sparkSession.createDataFrame([(0, f"## Dataset: {name}\n")], "row long, line string")
    return head.unionByName(lines.select(F.col("row").cast("long").alias("row"), "line"))


# --- headers of other sources -------------------------------------------------------------------------------------------


def transcript(title: Column, channel: Column, seconds: Column, body: Column) -> Column:
    """A transcript under its video's title, channel and length; what is missing is `Unknown ...`."""
    or_else = lambda c, what: F.coalesce(c.cast("string"), F.lit(f"Unknown {what}"))
    return F.concat(F.lit("# "), or_else(title, "Title"), F.lit("\n\n**Channel:** "), or_else(channel, "Author"), F.lit("\n**Duration:** "), or_else(seconds, "Duration"), F.lit("s\n\n"), body)


def playable(status: Column) -> Column:
    """Whether a video's saved status lets it be read; none counts as OK."""
    return F.coalesce(status, F.lit("OK")) == "OK"


def shared_conversation(url: Column, body: Column) -> Column:
    """A shared conversation under its link."""
    return F.concat(F.lit("# Gemini Conversation Share\nSource URL: "), url, F.lit("\n\n"), body)


def drive_export(name: Column, url: Column, body: Column, exported: bool = True) -> Column:
    """A document from a drive under its name; what was exported from an online editor also under its link."""
    source = F.concat(F.lit("\nGoogle Workspace Export\nSource URL: "), url) if exported else F.lit("")
    return F.concat(F.lit("# "), name, source, F.lit("\n\n"), body)


def page_value(page: Column, key: str) -> Column:
    """The value of `"key","value"` in a page's global data; null if there is none."""
    found = F.regexp_extract(page, f'"{key}","([^"]*)"', 1)
    return F.when(page.contains(f'"{key}","') & page.rlike(f'"{key}","[^"]*"'), found)
