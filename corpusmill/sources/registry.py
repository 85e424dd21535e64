"""Parsers by extension: a named plugin, built-in readers, plugins for other extensions, plain text; with errors kept beside
the good rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import html
from corpusmill.functions.paths import extension
from corpusmill.operators.tables import csv_text
from corpusmill.sources import code, office

#: A plugin is given the bytes and the extension; a built-in reader the bytes and the path.
Parser = Callable[[bytes, str], str]

#: Extensions of the readers (fixed values).
CODE = ("rs", "js", "py", "ts", "go", "c", "cpp")
IMAGES = ("png", "jpg", "jpeg", "webp")


class Unavailable(Exception):
    """A source that needs the network, an engine or a library that is not here."""


def plain_text(data: bytes, path: str) -> str:
    return data.decode("utf-8")


def unavailable(data: bytes, path: str) -> str:
    raise Unavailable(f"no reader for {path.rsplit('/', 1)[-1]} here")


class Registry:
    """`full` takes whole pages and code as it is; `extract="symbols"` takes signatures of code instead of skeletons."""

    def __init__(self, full: bool = False, extract: str | None = None) -> None:
        self.plugins: dict[str, Parser] = {}

        def read_code(data: bytes, path: str) -> str:
            text = plain_text(data, path)
            if full:
                return text
            return "\n".join(code.symbol_lines(text)) if extract == "symbols" else code.skeleton_text(text)

        self.builtin: dict[str, Parser] = {
            "docx": office.docx_text, "pptx": office.pptx_text, "xlsx": office.xlsx_text, "ods": office.ods_text,
            "csv": lambda data, path: csv_text(plain_text(data, path), path.rsplit("/", 1)[-1]),
            **dict.fromkeys(("html", "htm"), lambda data, path: html.page_text(plain_text(data, path), full)),
            **dict.fromkeys(CODE, read_code),
            **dict.fromkeys(("pdf", "xls"), unavailable),
        }
        self.images: Parser = unavailable

    def register(self, ext: str, parser: Parser) -> None:
        """A plugin under a name; it serves the extension of that name where no built-in reader does."""
        self.plugins[ext.lower()] = parser

    def provide(self, ext: str, reader: Parser) -> None:
        """A reader for what has none here: an extension such as `pdf`, or `image` for text in pictures."""
        if ext == "image":
            self.images = lambda data, path: f"## Image Text: {path.rsplit('/', 1)[-1]}\n\n{reader(data, path)}"
        else:
            self.builtin[ext.lower()] = reader

    def read(self, data: bytes, path: str, ext: str, plugin: str | None = None) -> str:
        if plugin:
            return self.plugins[plugin](data, ext)
        if ext in self.builtin:
            return self.builtin[ext](data, path)
        if ext in self.plugins:
            try:
                return self.plugins[ext](data, ext)
            except Exception:  # a plugin that was not asked for by name gives way to the usual readers
                pass
        return self.images(data, path) if ext in IMAGES else plain_text(data, path)

    def parse(self, rows: DataFrame, plugin: str | None = None) -> DataFrame:
        """(ord, path, text, error) of (ord, path, content BINARY); text is null where error is set or content null. A row
        that comes with an `error` keeps it. With `plugin` that plugin reads every row; it must be known, and its failure
        ends the run."""
        if plugin and plugin not in self.plugins:
            raise KeyError(f"no plugin {plugin!r}")
        registry = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, errors = [], []
                for path, data, ext, error in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                    text = None
                    if data is not None and error is None:
                        try:
                            text = registry.read(data, path or "", ext or "", plugin)
                        except Exception as e:  # one bad file must not end the run
                            if plugin:
                                raise
                            error = f"{type(e).__name__}: {e}"
                    texts.append(text)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["ord", "path", "text", "error"])

        known = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        wanted = rows.select(F.col("ord").cast("long"), "path", "content", extension(F.col("path")).alias("ext"), known.alias("error"))
        return wanted.mapInArrow(run, "ord long, path string, text string, error string")

    def split(self, rows: DataFrame, strict: bool = False, plugin: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(good, quarantine); `strict` raises at the first bad file instead."""
        parsed = self.parse(rows, plugin)
        if strict:
            bad = F.raise_error(F.concat("path", F.lit(": "), "error"))
            return parsed.withColumn("text", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("text"))).drop("error"), parsed.limit(0)
        return parsed.filter("error IS NULL").drop("error"), parsed.filter("error IS NOT NULL").drop("text")
