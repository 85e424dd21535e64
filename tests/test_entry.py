import importlib

import pytest


def test_queries_and_sql_agree():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "corpusmill"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "corpusmill.llm" not in f.read_text(), f


def test_entry_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() >= 0


TABLES = ("file_nodes", "documents", "conversations", "timelines", "events", "part", "nation", "region", "repos", "lineitem", "labels", "benchmark", "mix_targets")


def names():
    entry = importlib.import_module("__spark_entry__")
    return sorted(entry.oracle_sql())


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, sf, duck, name):
    entry = importlib.import_module("__spark_entry__")
    df = entry.queries()[name](spark, sf)
    r = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    at = [r.columns.index(n) for n in columns]
    text = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
    assert sorted(tuple(text(x[n]) for n in columns) for x in df.collect()) == sorted(tuple(text(x[i]) for i in at) for x in r.fetchall())
