"""Session helpers: table access, shared checkpoints and checked broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a small side may have before it is no longer broadcast.
BROADCAST_ROWS = 200_000
#: Bytes a small side may have, where they are known.
BROADCAST_BYTES = 64_000_000
#: The most bits of a bitmap of keys, as a power of two (8 MB, at most a million words).
BITMAP_LOG = 26


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context; they need no common path with the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpusmill")) / "corpusmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(archive))
    sc._corpusmill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusmill")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where it names none, a temporary one is set for a local
    master; on a cluster that would be another folder on each machine, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusmill"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder, so that a lost executor costs nothing that came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, and as it is (for a shuffled join) beyond.
    The count is an action, so `df` should be an aggregate or a cut table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def attached(rows: DataFrame, found: DataFrame, keys: list[str], size: Column | None = None, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` (wide: whole texts) joined to `found` (one row a key, a cut table) on `keys`, moving as few of `rows` as can be.
    `found` is broadcast if it has at most `most_rows` rows whose `size` (bytes) sums to at most BROADCAST_BYTES: then no
    text moves. Else a bitmap of the keys' hashes, of at most 2^BITMAP_LOG bits whatever their number, is broadcast, and only
    rows whose bit is set are shuffled for the join. Rows with a null key find nothing."""
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0))).first()
    if n <= most_rows and total <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), keys)
    log = min(BITMAP_LOG, max(16, (64 * n).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(*keys), 64 - log)
    word, bit = F.shiftrightunsigned(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    bitmap = found.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    near = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), "_word").filter(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)
    return near.drop("_word", "_bit", "_bits").join(found, keys)
