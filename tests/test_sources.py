import io
import subprocess
import time
import zipfile

import pytest

from corpusmill.sources import code, files, office, registry
from corpusmill.streaming import watch


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office():
    doc = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:p/></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"})
    assert office.docx_text(doc) == "One\nTwo"
    slide = lambda t: f"<s {A}><a:p><a:r><a:t>{t}</a:t></a:r></a:p><a:p/></s>"
    deck = zipped({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/slide3.xml": slide(" ")})
    assert office.pptx_text(deck) == "## Slide 2\n\n- two\n\n---\n\n## Slide 10\n\n- ten\n\n---\n\n"
    sheet = f'<worksheet {S}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>1.5</v></c></row><row r="4"><c r="B4" t="b"><v>1</v></c></row></sheetData></worksheet>'
    book = zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="N"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {S}><si><t>Hi</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert office.xlsx_text(book) == "## Sheet: N\n\nRow 1: Col A: Hi; Col C: 1.5\nRow 3: Col A: true\n\n"
    assert office.xlsx_text(zipped({"xl/workbook.xml": f"<workbook {S}/>"})) == office.EMPTY_BOOK


def test_registry(spark):
    r = registry.Registry()
    r.register("gob", lambda data, ext: "## DUMMY PARSER HIT! " + data.decode())
    rows = spark.createDataFrame([(1, "a.gob", b"Hello"), (2, "b.xyz", b"Plaintext fallback text"), (3, "c.txt", b"\xff\xfe"), (4, "d.pdf", b"%PDF"), (5, "e.docx", b"no zip"), (6, "f.txt", None)], "ord long, path string, content binary")
    good, bad = r.split(rows)
    assert {x.ord: x.text for x in good.collect()} == {1: "## DUMMY PARSER HIT! Hello", 2: "Plaintext fallback text", 6: None}
    assert {x.ord for x in bad.collect()} == {3, 4, 5} and "Unavailable" in bad.filter("ord = 4").first().error
    with pytest.raises(Exception, match="c.txt"):
        r.split(rows.filter("ord = 3"), strict=True)[0].collect()


def test_code():
    src = 'struct P { x: i32 }\nimpl P {\n  fn a(&self) -> i32 { let s = "}"; 1 }\n  fn b() { // }\n  }\n}\npub fn top<\'a>(x: &\'a str) { if x { y } }\n'
    skeleton = code.skeleton_text(src)
    assert skeleton.count("/* body elided */") == 2 and "struct P { x: i32 }" in skeleton and "pub fn top<'a>(x: &'a str) {" in skeleton
    assert code.symbol_lines(src) == ["struct P { ... }", "impl P { ... }", "  fn a(&self) -> i32", "  fn b()", "pub fn top<'a>(x: &'a str)"]
    assert code.symbol_lines(src, "reference")[0].startswith("pub fn top")
    assert code.skeleton_text("") == "" and code.skeleton_text("{ unclosed") == "{ unclosed"


def test_directory_and_git(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in {"a/x.py": "1", "a/y.log": "2", ".env": "3", "z.py": "4", ".hidden": "5"}.items():
        (tmp_path / name).write_text(text)
    got = lambda **k: sorted(r.path for r in files.directory(spark, str(tmp_path), **k).collect())
    assert got() == ["a/x.py", "a/y.log", "z.py"] and got(depth=1) == ["z.py"] and got(include=["*.py"], exclude=["z"]) == ["a/x.py"]
    assert files.text(spark, "stdin", "").count() == 0 and files.text(spark, "stdin", "t").count() == 1
    assert files.changed_files(spark, str(tmp_path), "HEAD") is None
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init")
    git("add", "a", "z.py")
    git("commit", "-m", "m")
    (tmp_path / "z.py").write_text("changed")
    changed = files.changed_files(spark, str(tmp_path), "HEAD")
    assert got(only=changed) == ["z.py"] and files.diffs(spark, str(tmp_path), "HEAD").first().path == "z.py"


def test_scan_keeps_every_name_and_opens_no_secret(spark, tmp_path):
    import os

    names = ["a.py", "pkg/__init__.py", "_config.yml", ".hidden", "deep/er/_x/.y/z.txt", "k.pem", ".ssh/known", "b/.env"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    before = {n: os.stat(tmp_path / n).st_atime_ns for n in names}
    for n in ("k.pem", ".ssh/known", "b/.env"):
        os.chmod(tmp_path / n, 0)
        os.utime(tmp_path / n, ns=(1, 1))
    got = files.directory(spark, str(tmp_path), hidden=True).orderBy("ord").collect()
    kept = sorted(["a.py", "pkg/__init__.py", "_config.yml", ".hidden", "deep/er/_x/.y/z.txt"])
    assert [r.path for r in got] == kept and [r.ord for r in got] == list(range(5)) and all(r.content.decode() == r.path and r.error is None for r in got) and before
    assert all(os.stat(tmp_path / n).st_atime_ns == 1 for n in ("k.pem", ".ssh/known", "b/.env"))
    assert [r.path for r in files.directory(spark, str(tmp_path)).orderBy("ord").collect()] == ["_config.yml", "a.py", "pkg/__init__.py"]
    assert files.listing(spark, str(tmp_path)).count() == 8 and files.directory(spark, str(tmp_path / "none")).count() == 0


def test_wide_directories_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FAN_OUT", 3)
    for i in range(5):
        (tmp_path / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / f"d{i}" / "e" / f"_{i}.txt").write_text("x")
    assert sorted(r.path for r in files.listing(spark, str(tmp_path)).collect()) == [f"d{i}/e/_{i}.txt" for i in range(5)]


def test_single_targets(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one")
    one = files.target(spark, str(tmp_path / "x.txt")).first()
    assert one.path == str(tmp_path / "x.txt") and one.content == b"one"
    assert files.target(spark, str(tmp_path)).first().error and files.target(spark, str(tmp_path), whole=True).first().path == "x.txt"
    r = registry.Registry()
    assert "Unavailable" in r.split(files.target(spark, "https://a.test/x"))[1].first().error


def test_router(spark):
    page = "<html><script>1</script><nav>Menu</nav><article><h1>T</h1><p>" + "word " * 12 + "</p></article></html>"
    rust = "fn a() { 1 }\nstruct S { x: u8 }\n"
    items = [("p.HTML", page), ("q.htm", "<html>Sign in with Google</html>"), ("r.htm", "<script>x</script><p>hi"), ("a.rs", rust), ("d/t.csv", "Name,Age\nDino,30\n\nOld, \n"), ("u.csv", "a,b\nc\n"), ("i.png", "x"), ("n.md", "# x")]
    rows = spark.createDataFrame([(i, p, c.encode()) for i, (p, c) in enumerate(items)], "ord long, path string, content binary")
    got = {r.ord: (r.text, r.error) for r in registry.Registry().parse(rows).collect()}
    assert got[0][0].startswith("# T") and "Menu" not in got[0][0] and "login" in got[1][1] and "scripts" in got[2][1]
    assert got[3][0] == "fn a() { /* body elided */ }\nstruct S { x: u8 }\n" and got[7][0] == "# x"
    assert got[4][0] == "## Dataset: t.csv\n\nRow 1: Col A: Name; Col B: Age\nRow 2: Col A: Dino; Col B: 30\nRow 3: Col A: Old\n" and "ValueError" in got[5][1] and "Unavailable" in got[6][1]
    full = registry.Registry(full=True)
    full.provide("image", lambda data, path: "seen")
    got = {r.ord: r.text for r in full.parse(rows.filter("ord IN (3, 6)")).collect()}
    assert got == {3: rust, 6: "## Image Text: i.png\n\nseen"}
    assert registry.Registry(extract="symbols").parse(rows.filter("ord = 3")).first().text == "fn a()\nstruct S { ... }"


def test_plugins_give_way_unless_asked_for_by_name(spark):
    r = registry.Registry()
    r.register("gob", lambda data, ext: 1 / 0)
    rows = spark.createDataFrame([(1, "a.gob", b"plain")], "ord long, path string, content binary")
    assert r.parse(rows).first().text == "plain"
    with pytest.raises(Exception, match="division by zero"):
        r.parse(rows, plugin="gob").collect()
    with pytest.raises(KeyError):
        r.parse(rows, plugin="none")


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    root.mkdir()
    (root / "_a.txt").write_text("1")
    seen = []

    def until(wanted):
        q = watch.watch(spark, str(root), lambda c: seen.extend((r.path.rsplit("/", 1)[1], r.change) for r in c.collect()), str(state), "200 milliseconds")
        try:
            end = time.time() + 60
            while wanted not in seen and time.time() < end:
                time.sleep(0.2)
            time.sleep(1)
        finally:
            q.stop()

    until(("_a.txt", "created"))
    (root / "b.txt").write_text("2")
    until(("b.txt", "created"))
    assert seen == [("_a.txt", "created"), ("b.txt", "created")] and len(list((state / "snapshots").glob("*.done"))) == 1


def test_watch(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    root.mkdir()
    (root / "a.txt").write_text("1")
    seen = []
    q = watch.watch(spark, str(root), lambda c: seen.extend((r.path.rsplit("/", 1)[1], r.change) for r in c.collect()), str(state), "200 milliseconds")
    try:
        wait = time.time() + 60
        while ("a.txt", "created") not in seen and time.time() < wait:
            time.sleep(0.2)
        (root / "a.txt").write_text("longer now")
        while ("a.txt", "modified") not in seen and time.time() < wait:
            time.sleep(0.2)
    finally:
        q.stop()
    assert seen[:2] == [("a.txt", "created"), ("a.txt", "modified")]
