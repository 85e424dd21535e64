import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import compress, html, paths, redact, tokens


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "path,ext",
    [("a/b.RS", "rs"), (".env", ""), ("dir.d/file", ""), ("https://a.com", "com"), ("x/", ""), ("a.tar.gz", "gz"), ("", ""), (None, None)],
)
def test_extension(spark, path, ext):
    assert one(spark, paths.extension(F.col("p")), p=path) == ext


@pytest.mark.parametrize(
    "path,secret",
    [(".env", True), ("a/.env.local", True), ("k.pem", True), ("x/.aws/credentials", True), ("h/.ssh/known", True), ("env", False), (".env.sample", False)],
)
def test_secret_file(spark, path, secret):
    assert one(spark, paths.is_secret_file(F.col("p")), p=path) is secret


def test_include_exclude(spark):
    p = F.col("p")
    assert one(spark, paths.included(p, ["*.rs"]), p="a/b.rs") and not one(spark, paths.included(p, ["*test*"]), p="my_test.rs")
    assert one(spark, paths.included(p, []), p="x") and one(spark, paths.excluded(p, ["*te*st*"]), p="best_tea")
    assert not one(spark, paths.excluded(p, []), p="x")


@pytest.mark.parametrize(
    "path,name",
    [("https://a.com", "index.md"), ("https://a.com/x/", "x/index.md"), ("https://a.com/a:b.md", "a_b.md"), ("../x.py", "/x.py.md"), ("n.md", "n.md")],
)
def test_safe_name(spark, path, name):
    assert one(spark, paths.safe_name(F.col("p")), p=path) == name


def test_routes(spark):
    p = F.col("p")
    assert one(spark, paths.url_route(p), p="https://netflix.com/a") == "posts"
    assert one(spark, paths.url_route(p, strict=True), p="https://netflix.com/a") == "page"
    assert one(spark, paths.url_route(p), p="dir/file") is None
    assert one(spark, paths.media_id(p, "video"), p="https://youtu.be/abc-1") == "abc-1"


def test_names():
    assert [paths.display_name(x) for x in ([], ["a"], ["a", "b"], ["a", "b", "c"])] == ["clipboard", "a", "a & b", "a and 2 others"]
    assert paths.output_dir("https://a/b c&d") == "a_b_candd_gobbled"


def test_tokens(spark):
    assert one(spark, tokens.estimate(F.col("c"), F.col("p")), c="é" * 10, p="a.md") == 5
    assert one(spark, tokens.estimate(F.col("c"), F.col("p")), c="", p="a") == 0
    assert [tokens.parse_threshold(x) for x in ("12k", " 1.5M ", "700", "x", "k")] == [12_000, 1_500_000, 700, None, None]


@pytest.mark.parametrize(
    "text,out",
    [
        ("My SSN is 123-45-6789.", "My [REDACTED] is [REDACTED]."),
        ("mail test.user@example.com now", "mail [REDACTED] now"),
        ("card 4111-1111-1111-1111!", "card [REDACTED]!"),
        ("", ""),
        (None, None),
    ],
)
def test_redact(spark, text, out):
    assert one(spark, redact.redact(F.col("t")), t=text) == out


def test_forced_refinement(spark):
    assert one(spark, redact.redact(F.col("t"), True), t="Jane Doe met Bob Smith in Seattle") == "[REDACTED] met Bob Smith in Seattle"
    assert one(spark, redact.redact(F.col("t"), True), t="Jane Doe") == "Jane Doe"


def test_compress_strings(spark):
    assert one(spark, compress.compress(F.col("t"), "safe"), t="Paragraph 1. \n\n\n\n Paragraph 2.  \n") == "Paragraph 1.\n\nParagraph 2.\n"
    code = "/// Core rust\nfn main() { // comment here\n/* block */\n}"
    assert one(spark, compress.compress(F.col("t"), "contextual", "rust"), t=code) == "/// Core rust\nfn main() { \n\n}"
    assert one(spark, compress.minify_json(F.col("t")), t='{\n  "key": "value" \n}') == '{"key":"value"}'
    pruned = one(spark, compress.compress(F.col("t"), "aggressive"), t="The quick brown fox jumps over the lazy dog in the morning.")
    assert "quick" in pruned and " the " not in pruned
    assert one(spark, compress.prune_stop_words(F.col("t")), t="the of") == "the of"
    assert one(spark, compress.compress(F.col("t"), "aggressive"), t=None) is None


def test_compression_against_brute_force(spark):
    """Levels and stop words by plain loops over lines and words."""
    import random

    rng = random.Random(6)
    bits = ["the", "The,", "fox", "(of)", "a", "x1", "\n", "\n\n\n", "  ", "\t", "'it's'", "né", "-", "and."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(80)]
    stop = set(compress.stop_words())

    def safe(t):
        t = "\n".join(x.strip(" \t") for x in t.split("\n"))
        while "\n\n\n" in t:
            t = t.replace("\n\n\n", "\n\n")
        return t

    def clean(w):
        w = w.lower()
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        return w

    def hard(t):
        kept = [w for w in safe(t).split() if clean(w) not in stop]
        return " ".join(kept) if kept else safe(t)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", compress.compress(F.col("t"), "safe").alias("s"), compress.compress(F.col("t"), "aggressive").alias("h")).collect()
    assert all((r.s, r.h) == (safe(r.t), hard(r.t)) for r in got)


def test_brace_comments():
    assert compress.brace_comments('x = "// no"; // yes\n') == 'x = "// no"; \n'
    assert compress.brace_comments(None) is None


def test_fences():
    parts = compress.split_fences("a\n```py\nx = 1\n```\nb")
    assert ("py", "x = 1\n") in parts and "".join(t for _, t in parts) == "a\n```py\nx = 1\n```\nb"


def test_markdown_is_compressed_by_its_fences(spark):
    text = "# Title \n\n\n\nprose // stays\n```rust\nfn f() {} // gone\n/// kept\n```\n~~~py\n# gone\ny = 1\n~~~\n```\n# no language\n"
    assert one(spark, compress.compress_markdown(F.col("t"), "contextual"), t=text) == "# Title\n\nprose // stays\n```rust\nfn f() {} \n/// kept\n```\n~~~py\n\ny = 1\n~~~\n```\n# no language\n".replace("{} \n", "{}\n")
    assert one(spark, compress.compress_markdown(F.col("t"), "safe"), t=text) == one(spark, compress.compress(F.col("t"), "safe"), t=text)
    hard = one(spark, compress.compress_markdown(F.col("t"), "aggressive"), t="the fox\n```py\nx = 1 # the\n# gone\n```\nof it")
    assert hard == "fox ```py x = 1 # ```" and one(spark, compress.compress_markdown(F.col("t"), "aggressive"), t=None) is None
    assert "".join(x for _, x in compress.split_fences(text)) == text and compress.split_fences("```js\nopen") == [(None, "```js\n"), ("js", "open"), (None, "")]


def test_html(spark):
    page = "<html><nav>Ignore me</nav><article><h1>T</h1><p>The core content</p></article><footer>footer</footer></html>"
    text = one(spark, html.page_to_markdown(F.col("h")), h=page)
    assert "The core content" in text and "Ignore me" not in text and "footer" not in text and text.startswith("# T")
    assert one(spark, html.auth_wall(F.col("h")), h="Sign in with Google") and not one(spark, html.auth_wall(F.col("h")), h="sign out")
    assert one(spark, html.js_shell(F.col("h")), h="<script>x</script><p>hi") and not one(spark, html.js_shell(F.col("h")), h="<p>" + "w " * 12)
    assert html.to_markdown_text("<ol><li>a</li><li>b</li></ol>") == "1. a\n2. b"
    assert one(spark, html.main_content(F.col("h")), h="no tags") == "no tags"
    assert json.dumps(html.to_markdown_text("")) == '""'
