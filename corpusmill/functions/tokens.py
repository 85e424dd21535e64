"""Token estimates and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.paths import extension

#: Bytes a token by extension (fixed values).
RATIOS = ((("md", "txt", "pdf", "docx"), 4.2), (("rs", "c", "cpp", "java", "go", "ts", "js"), 3.2), (("py", "yaml", "yml"), 3.8), (("json", "html", "xml"), 2.5), (("log", "hash", ""), 1.5))
OTHER_RATIO = 3.5
#: US dollars a million tokens (fixed values).
PRICES = (
    ("GPT-4o", 5.00),
    ("GPT-4o-mini", 0.15),
    ("Claude 3.5 Sonnet", 3.00),
    ("Claude 3 Haiku", 0.25),
    ("Gemini 1.5 Pro", 3.50),
    ("Gemini 1.5 Flash", 0.075),
)


def ratio(path: Column) -> Column:
    ext, out = extension(path), F.lit(OTHER_RATIO)
    for exts, r in reversed(RATIOS):
        out = F.when(ext.isin(*exts), F.lit(r)).otherwise(out)
    return out


def estimate(content: Column, path: Column) -> Column:
    """Bytes by the extension's ratio, rounded up."""
    return F.ceil(F.octet_length(content) / ratio(path)).cast("bigint")


def header_tokens(content: Column) -> Column:
    return F.floor(F.octet_length(content) / 4).cast("bigint")


def costs(total: DataFrame, column: str = "tokens") -> DataFrame:
    """A row of totals by each model's price."""
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).alias("usd_per_million")) for m, p in PRICES))
    rows = total.select("*", F.explode(models).alias("_m")).select(*total.columns, "_m.model", "_m.usd_per_million")
    return rows.withColumn("usd", F.col(column) / F.lit(1e6) * F.col("usd_per_million"))


def parse_threshold(text: str) -> int | None:
    """`12000`, `12k`, `1.5m`; None for anything else."""
    t = text.strip().lower()
    for sign, factor in (("k", 1_000), ("m", 1_000_000)):
        if t.endswith(sign):
            try:
                return int(float(t.rstrip(sign)) * factor)
            except ValueError:
                return None
    return int(t) if t.isdigit() else None
