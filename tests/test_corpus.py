import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import corpus as ops
from corpusmill.operators import graph, tables
from corpusmill.plans import pipeline, sinks

SCHEMA = "ord long, path string, content string"


def rows(spark, *items):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(items)], SCHEMA)


@pytest.mark.parametrize("path,rank", [("app.log", 0), ("data.csv", 1), ("README.md", 2), ("main.rs", 3), ("https://x", 3)])
def test_rank(spark, path, rank):
    assert rows(spark, (path, "")).select(ops.rank(F.col("path")).alias("r")).first().r == rank


def test_budget_example(spark):
    df = rows(spark, ("app.log", "a " * 500), ("main.rs", "fn " * 100))
    assert [r.path for r in ops.within_budget(df, 150).collect()] == ["main.rs"]


def spec_budget(items, budget):
    """Brute force: the greedy pass as stated."""
    import math

    ratio = {"md": 4.2, "rs": 3.2, "py": 3.8, "json": 2.5, "log": 1.5, "csv": 3.5}
    rank = {"log": 0, "json": 1, "csv": 1, "md": 2, "rs": 3, "py": 3}
    cost = lambda c, p: math.ceil(len(c.encode()) / ratio[p.rsplit(".", 1)[1]])
    fold = lambda c: "\n".join(x.strip(" \t") for x in c.split("\n")).replace("\n\n\n", "\n\n")
    if sum(cost(c, p) for _, p, c in items) <= budget:
        return {o: "full" for o, _, _ in items}
    used, kept = 0, {}
    for o, p, c in sorted(items, key=lambda x: (-rank[x[1].rsplit(".", 1)[1]], len(x[2].encode()), -x[0])):
        if used + cost(c, p) <= budget:
            used, kept[o] = used + cost(c, p), "full"
        elif rank[p.rsplit(".", 1)[1]] == 3 and used + cost(fold(c), p) <= budget:
            used, kept[o] = used + cost(fold(c), p), "folded"
    return kept


def test_budget_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, f"f{i}.{rng.choice(['md', 'rs', 'py', 'json', 'log', 'csv'])}", "x" + " " * rng.randrange(40) + "\n" + "y" * rng.randrange(1, 60)) for i in range(150)]
    df = spark.createDataFrame(items, SCHEMA)
    for budget in (0, 37, 300, 900, 10**6):
        assert {r.ord: r.mode for r in ops.within_budget(df, budget).collect()} == spec_budget(items, budget)


def test_budget_of_alike_rows_and_fallback(spark):
    rng = random.Random(7)
    # a third of all rows are alike, some hold blanks only, some no text
    items = [(i, "a.rs", "x" * 32) for i in range(100)] + [(100 + i, f"b{i}.py", " " * 38 + "\n" + " " * rng.choice([0, 10])) for i in range(60)] + [(200 + i, "c.md", "y" * rng.randrange(5, 90)) for i in range(60)] + [(300 + i, "e.rs", "") for i in range(20)]
    df = spark.createDataFrame(items, SCHEMA)
    for budget in (0, 5, 205, 700, 1_100, 2_000):
        got = ops.within_budget(df, budget).collect()
        assert {r.ord: r.mode for r in got} == spec_budget(items, budget), budget
        assert [r.ord for r in sorted(got, key=lambda r: r["at"])] == [o for o, p, c in sorted(items, key=lambda x: (x[1], x[0])) if o in {r.ord for r in got}]
    page = spark.createDataFrame([(1, "p.rs", "<p>\n\n <b>   </b>\n</p><!-- " + "long " * 50 + "-->"), (2, "q.rs", '{"a":  [1,   2 ]}' + " " * 100)], SCHEMA)
    assert {r.ord: r.content for r in ops.within_budget(page, 12).collect()} == {1: "<p><b></b></p>", 2: '{"a":[1,2]}'}
    stats = ops.pruning(page, ops.within_budget(page, 12)).first()
    assert (stats.kept_tokens, stats.kept_rows) == (9, 2) and stats.initial_tokens > 100


def test_search_moves_no_content_before_the_top(spark):
    df = spark.createDataFrame([(i, f"f{i}.md", "word " * i + ("needle " if i % 3 == 0 else "")) for i in range(40)], SCHEMA)
    got = ops.search(df, "needle", 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "").replace("ReusedExchange", "") and [r.path for r in got.collect()] == ["f0.md", "f3.md"]


def test_order_by_any_keys(spark):
    df = spark.createDataFrame([(f"{i * 7919 % 1000:04}", i) for i in range(1000)], "k string, v int").repartition(7)
    assert [r.k for r in ops.in_order(df, "k", "n").orderBy("n").collect()] == sorted(f"{i:04}" for i in range(1000))
    assert sorted(r.n for r in ops.in_order(df, ["v", "k"], "n", 1).collect()) == list(range(1, 1001)) and ops.in_order(df.limit(0), "k", "n").count() == 0


def test_refinement_on_entropy(spark):
    text = "a" * 100 + "Jane Doe0123456789XYZ" + "b" * 200 + "Jane Doe"
    assert ops.refined_text(text, 16, 3.5, 4) == "a" * 100 + "[REDACTED]0123456789XYZ" + "b" * 200 + "Jane Doe"
    assert ops.refined_text(text) == text and ops.refined_text("Jane Doe", force=True) == "Jane Doe" and ops.refined_text("x" * 16 + "Jane Doe", force=True) == "x" * 16 + "[REDACTED]"
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "k long, t string")
    spans = ops.merged_spans(ops.entropy_table(df, "k", "t", 16, 3.5), "k", 4).collect()
    assert len(spans) == 1 and spans[0].k == 1 and text[spans[0].start : spans[0].stop].find("0123456789") >= 0
    assert df.select(ops.refined(F.col("t"), 16, 3.5, 4).alias("r")).filter("r like '%REDACTED%'").count() == 1


def test_sinks(spark):
    df = rows(spark, ("b.rs", "two"), ("a.rs", "one \n"), ("README.md", "# T\nintro"))
    text = lambda f: "".join(r.block for r in f.orderBy("place", "ord").collect())
    blocks = "// --- FILE_START: b.rs ---\ntwo\n\n// --- FILE_START: a.rs ---\none \n\n\n// --- FILE_START: README.md ---\n# T\nintro"
    assert text(sinks.combined(df, "x")) == blocks + "\n"
    head = "| # | File | Tokens |\n|---|------|--------|\n| 1 | b.rs | 1 |\n| 2 | a.rs | 2 |\n| 3 | README.md | 3 |\n\n## Project Summary\n\n> **Overview:** intro\n\n**Composition:**\n- **.rs**: 2 files\n- **.md**: 1 files\n\n---\n\n"
    assert text(sinks.combined(df, "x", manifest=True, summary=True)) == head + blocks + "\n"
    assert text(sinks.combined(df, "x", "anthropic")) == '<file path="x">\n<content>\n' + blocks + "\n\n\n</content>\n</file>\n"
    tree = ops.tree_row(df.select("path"))
    assert text(sinks.combined(tree.unionByName(df), "x", manifest=True)).startswith("| # | File | Tokens |\n|---|------|--------|\n| 2 | b.rs | 1 |\n| 3 | a.rs | 2 |\n| 4 | README.md | 3 |\n\n```tree\n.\n  ├── README.md\n  ├── a.rs\n  ├── b.rs\n```\n\n// ---")
    parts = {}
    for r in sinks.chunk_files(df, 3, "x", summary=True, write="o.md").orderBy("name", "place", "ord").collect():
        parts[r.name] = parts.get(r.name, "") + r.block
    assert sorted(parts) == ["o.part1.md", "o.part2.md"] and parts["o.part1.md"].startswith("## Project Summary") and parts["o.part2.md"] == "// --- FILE_START: README.md ---\n# T\nintro\n"
    assert not any(r.block.startswith("##") for r in sinks.chunk_files(tree.unionByName(df), 3, "x", summary=True).collect())
    assert {r.name for r in sinks.split_files(df).collect()} == {"b.rs.md", "a.rs.md", "README.md"} and sinks.tokens_only(df).first().tokens == 6
    assert sinks.combined(df.limit(0), "x", "gpt", manifest=True).count() == 0 and sinks.report(df, df, 3).first().parts == 2


def test_pipeline_outputs(spark, tmp_path):
    df = rows(spark, (".env", "K=1"), ("a.md", "intro\n```py\nx = 1\n# gone\n```\n"), ("z.log", "log"))
    config = pipeline.PipelineConfig(level="contextual", tree=True)
    out = {r.path: r.content for r in pipeline.run(df, config).collect()}
    assert out["a.md"] == "intro\n```py\nx = 1\n```\n" and ".env" in out["_tree.md"] and set(out) == {"_tree.md", "a.md", "z.log"}
    assert pipeline.output(df, pipeline.PipelineConfig(sink="tokens"), "n").first().tokens == 9 and pipeline.output(df, pipeline.PipelineConfig(sink="json"), "n").count() == 2
    pruned = pipeline.run(df, pipeline.PipelineConfig(budget=8)).orderBy("ord").collect()
    assert [r.path for r in pruned] == ["a.md"]
    sinks.write_blocks(sinks.combined(df, "x"), str(tmp_path / "c"))
    sinks.write_named(sinks.chunk_files(df, 1, "x"), str(tmp_path / "n"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "c").glob("part-*"))).startswith("// --- FILE_START: .env") and (tmp_path / "n" / "name=gobbled.part1.md").is_dir()


def test_crawl(spark):
    page = lambda *links: "<article><h1>P</h1>" + "".join(f'<a href="{x}">l</a>' for x in links) + "</article>"
    u = "https://h.test/"
    pages = spark.createDataFrame(
        [(u, page("a", "/b#x", "https://o.test/c", "mailto:x@h.test", "http://[bad"), None), (u + "a", page("d/../b", "/no/z", "img"), "text/html; charset=utf-8"), (u + "b", page("/"), "text/plain"), (u + "no/z", page("/e"), None),
         (u + "e", page(), None), (u + "img", page("/e"), "image/png"), ("https://o.test/c", page(), None), (u + "a", page("/e"), "text/html"), (None, page(), None), (u + "q", None, None)],
        "url string, html string, content_type string",
    ).dropDuplicates(["url"])
    rules = spark.createDataFrame([("h.test", "/no", False)], "host string, prefix string, allow boolean")
    got = [(r.ord, r.path) for r in graph.crawl(pages.filter("html not like '%\"/e\"%' or url like '%no%' or url like '%img%'"), u, rules).orderBy("ord").collect()]
    assert got == [(0, "_tree.md"), (1, u), (2, u + "a"), (3, u + "b")]
    assert [r.path for r in graph.crawl(pages, u, rules, depth=0).collect()] == ["_tree.md", u]


@pytest.mark.parametrize("most", [None, 0])
def test_crawl_broadcasts_what_was_counted(spark, monkeypatch, most):
    """Pages that Spark believes to be small: neither they nor their links are broadcast, nodes only up to the limit."""
    if most is not None:
        monkeypatch.setattr(graph, "SIDE_ROWS", most)
    text = F.col("id").cast("string")
    page = F.concat(F.lit('<p>P</p><a href="/'), (F.col("id") * 2).cast("string"), F.lit('"></a><a href="/'), (F.col("id") * 2 + 1).cast("string"), F.lit('"></a>'))
    pages = spark.range(1, 41).select(F.concat(F.lit("https://h.test/"), text).alias("url"), page.alias("html"))
    rules = spark.createDataFrame([("h.test", "/3", False)], "host string, prefix string, allow boolean")
    store = spark._jsparkSession.sharedState().statusStore()
    ran = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    before = {e.executionId() for e in ran()}
    got = [r.path.rsplit("/", 1)[-1] for r in graph.crawl(pages, "https://h.test/1", rules).orderBy("ord").collect()]
    assert got == ["_tree.md", *(str(n) for n in [1, 2, 4, 5, 10, 11, 8, 9, *range(16, 24), 40])]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sides = [x for e in ran() if e.executionId() not in before for x in re.findall(r"\) BroadcastExchange\s+Input \[\d+\]: \[(.*)\]", e.physicalPlanDescription())]
    names = {re.sub(r"#\d+L?", "", n) for x in sides for n in x.split(", ")}
    assert "prefix" in names and not names & ({"html", "url", "dst", "page_id"} | ({"node"} if most == 0 else set())), names


def test_search_example(spark):
    df = rows(spark, ("main.rs", "pub fn connect_db() {}"), ("utils.rs", "pub fn parse_date() {}"), ("crawler.rs", "pub fn fetch_url() {}"))
    assert [r.path for r in ops.search(df, "connect", 1).collect()] == ["main.rs"]
    assert ops.search(df, "absent", 3).count() == 0
    assert [r.path for r in ops.search(df, 'pub -parse "fetch url"', 3).collect()] == ["crawler.rs"]
    with pytest.raises(ValueError):
        ops.parse_query("a (b")


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ops.within_budget(empty, 10).count() == ops.chunks(empty, 5).count() == ops.manifest(empty).count() == ops.search(empty, "x").count() == 0
    assert ops.metrics(empty, empty).first().asDict() == {"files": 0, "bytes": 0, "tokens": 0, "tokens_saved": 0}


def test_chunks(spark):
    df = rows(spark, *[("a.md", "x" * n) for n in (42, 42, 420, 4, 0, 4)])
    parts = {r.ord: r.part for r in ops.chunks(df, 20).collect()}
    assert parts == {0: 1, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3}


def test_numbering_over_ranges(spark):
    df = spark.range(0, 30_000, 3).withColumnRenamed("id", "k").repartition(7)
    got = ops.numbered(df, "k", "n").collect()
    assert sorted((r.k, r.n) for r in got) == [(3 * i, i + 1) for i in range(10_000)]


def test_flavors(spark):
    df = rows(spark, ("test.txt", "  Hello World\n"))
    body = lambda f: df.select(ops.flavored(F.col("content"), F.col("path"), f).alias("b")).first().b
    assert body("human") == body("gemini") == body("whatever") == "Hello World\n"
    assert body("anthropic").startswith('<file path="test.txt">\n<content>') and "tokens: 3" in body("gpt")


def test_entropy():
    assert ops.entropy(b"AABBCCDD") == 2.0 and ops.entropy(b"ABCDEFGH") == 3.0
    text = "AABBCCDDABCDEFGHAAAA"
    brute = [(i, i + 8) for i in range(len(text) - 7) if ops.entropy(text[i : i + 8].encode()) > 2.5]
    assert ops.entropy_spans(text, 8, 2.5) == brute and ops.entropy_spans("short", 8) == []
    assert len(ops.entropy_spans(text, 8, 9, force=True)) == len(text) - 7


def test_spans(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 70, 80), (1, 200, 210), (2, 0, 5), (1, 0, 10)], "k int, start int, stop int")
    assert sorted(map(tuple, ops.merged_spans(df, "k").collect())) == [(1, 0, 80), (1, 200, 210), (2, 0, 5)]


def test_tree_and_summary(spark):
    df = rows(spark, ("a/b.rs", "x"), ("a/c/d.md", "y"), ("README.md", "# T\n\nfirst\nsecond\n\nthird\nfourth"))
    assert [r.line for r in ops.tree(df).orderBy("entry").collect()] == ["  ├── README.md", "  ├── a/", "    ├── b.rs", "    ├── c/", "      ├── d.md"]
    s = ops.summary(df).first()
    assert (s.files, s.intro, s.extensions) == (3, "first second third", "- **.md**: 2 files\n- **.rs**: 1 files")


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 3), (None, 5), (7, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert {r.node: r.depth for r in graph.reachable(edges, seeds).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.node for r in graph.reachable(edges, seeds, depth=1).collect()} == {1, 2}


def test_tables(spark):
    df = spark.createDataFrame([(1, "Name", "Age"), (2, "Dino", ""), (5, None, "30")], "k long, a string, b string")
    assert [r.line for r in tables.records(df, "k", ["a", "b"]).orderBy("row").collect()] == ["Row 1: Col A: Name; Col B: Age", "Row 2: Col A: Dino", "Row 3: Col B: 30"]
    got = spark.range(0, 20_000, 37).select("id", tables.column_letters(F.col("id")).alias("l")).collect()
    assert all(r.l == tables.letters(r.id) for r in got)
    chat = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 3, None, None)], "conv_id long, turn long, role string, text string")
    assert tables.conversations(chat).first().body == "**User:**\na\n\n**Gemini:**\nb\n\n**Message:**\n\n\n"


def test_pipeline_order(spark):
    df = rows(spark, (".env", "K=1"), ("a.rs", "mail a@b.example \n\n\n\n x"), ("b.log", "SSN"))
    out = pipeline.run(df, pipeline.PipelineConfig(least_rank=1, redact=True, level="safe")).collect()
    assert [(r.path, r.content) for r in out] == [("a.rs", "mail [REDACTED]\n\nx")]


def test_clashing_columns(spark):
    df = rows(spark, ("a.rs", "x y z")).withColumn("rank", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("tokens", F.lit(2))
    assert ops.manifest(ops.corpus(df)).count() == 1 and ops.within_budget(ops.corpus(df), 100).count() == 1
