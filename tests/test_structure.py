"""Chunkers, classification, spans, graphs, store, data source, facade and stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loamline.config import Settings
from loamline.functions.wordpiece import WordPiece
from loamline.operators import chunking, graph, intervals, languages
from loamline.__main__ import parser
from loamline.operators.lexical import LexicalIndex
from loamline.operators.syntax import chunk_source, go_calls, statement_cuts, torn_lines, windows
from loamline.service import Repository
from loamline.sources import catalog
from loamline.sources.repo_files import read_remote_tree, read_tree
from loamline.streaming.incremental import follow
from loamline.workspace import EMBEDDING, SCANNING, STORING, Workspaces, index_folder, match_root, phase_message


def test_paragraphs_and_ids(spark):
    files = spark.createDataFrame([("a.txt", "line one\nline two\n\nsecond para\n\n\nthird para\n"), ("b.txt", "x\n\t\nx"), ("c.txt", "")], "path string, content string")
    got = chunking.with_ids(chunking.paragraphs(files)).orderBy("path", "ord").collect()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [("a.txt", 1, 2), ("a.txt", 4, 4), ("a.txt", 7, 7), ("b.txt", 1, 1), ("b.txt", 3, 3)]
    assert got[4]["id"] == got[3]["id"] + "~1"
    one = spark.createDataFrame([("path", "pass")], "path string, content string").select(chunking.base_id(F.col("path"), F.col("content"))).first()[0]
    assert one == "path#d74ff0ee8da3"


SOURCES = {
    "m.py": "import os\nX = 1\n\n@deco\ndef f(a):\n    return a\n\n\nclass A(B):\n    '''doc'''\n    y = 2\n\n    def g(self):\n        return 1\n",
    "m.go": "package m\n\nimport \"fmt\"\n\n// Top does.\nfunc Top() {\n\tfmt.Println(\"}\")\n}\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Get() int { return t.a }\n",
    "m.rs": "use x::y;\n\n#[derive(Debug)]\npub struct P { a: i32 }\n\nimpl P {\n    /// doc\n    pub fn new() -> P { P { a: 1 } }\n}\n\n#[cfg(test)]\nmod tests {\n    fn t() {}\n}\n",
    "m.java": "package p;\n\npublic class C {\n    int a = 1;\n\n    @Override\n    public int f(int x) {\n        return x;\n    }\n}\n",
    "m.ts": "import {a} from 'b';\n\nexport function f(x: number) {\n  return x;\n}\n\nexport class K {\n  m(): void {\n    a();\n  }\n}\n\nexport const g = (x) => x + 1;\n",
    "m.c": "#include <a.h>\n\nint add(int a, int b)\n{\n  return a + b;\n}\n",
    "m.md": "# title\n\ntext\n",
}


@pytest.mark.parametrize("path", sorted(SOURCES))
def test_every_meaningful_line_is_in_a_chunk(path):
    content = SOURCES[path]
    rows = chunk_source(path, content)
    covered = {n for r in rows for n in range(r[2], r[3] + 1)}
    dropped = set(range(11, 15)) if path == "m.rs" else set()
    for n, line in enumerate(content.split("\n"), 1):
        if any(c.isalnum() or c == "_" for c in line) and n not in dropped:
            assert n in covered, (path, n, line)
    assert [r[1] for r in rows] == list(range(len(rows)))


def test_symbols():
    names = lambda p: {r[4] for r in chunk_source(p, SOURCES[p])}
    assert {"f", "A.g"} <= names("m.py") and {"Top", "T.Get", "T"} <= names("m.go")
    assert {"P", "P.new"} <= names("m.rs") and "tests.t" not in names("m.rs")
    assert "C.f" in names("m.java") and {"f", "K.m", "g"} <= names("m.ts") and "add" in names("m.c")
    f = next(r for r in chunk_source("m.py", SOURCES["m.py"]) if r[4] == "f")
    assert f[2] == 4 and f[5].startswith("@deco")


def test_windows_of_a_long_function():
    content = "def big():\n" + "".join(f"    value_{k} = compute({k}, 'text')\n" for k in range(200))
    rows = chunk_source("b.py", content)
    assert len(rows) >= 2 and rows[0][4] == "big~1" and all(r[6].startswith("python b.py\nbig") for r in rows)
    assert all(rows[k + 1][2] <= rows[k][3] + 1 for k in range(len(rows) - 1))


def test_windows_begin_at_statements():
    content = 'def big():\n    """doc\n    more"""\n' + "".join(f"    call_{k}(\n        {k},\n        'text',\n    )\n" for k in range(60))
    cuts = statement_cuts(content, "python", 0, content.count("\n") - 1)
    assert cuts == [3 + 4 * k for k in range(60)]
    rows = chunk_source("b.py", content)
    assert len(rows) > 2 and rows[0][2] == 1 and all(r[2] - 1 in cuts for r in rows[1:])
    # neighbours share one statement, and no statement is torn
    assert all(rows[k + 1][2] == rows[k][3] - 3 for k in range(len(rows) - 1))
    go = "func Big() {\n" + "".join(f"\tif a{k} {{\n\t\tb{k}(1,\n\t\t\t2)\n\t}}\n" for k in range(5)) + "}\n"
    assert statement_cuts(go, "go", 0, 21) == [5, 9, 13, 17]
    rust = "fn big() {\n    let a = f(1,\n        2);\n    g();\n    match a {\n        1 => 2,\n    }\n}\n"
    assert statement_cuts(rust, "rust", 0, 7) == [3, 4]


def test_lines_within_strings_are_no_cuts():
    text = 'x = """a\nb\nc"""\ny = 1\n'
    assert torn_lines(text, "python") == {1, 2}
    assert torn_lines("a();\n/* one\n two */\nb(`x\ny`);\n", "javascript") == {2, 4}
    assert windows([10] * 6, 0, 5, [], 25, 0, {1, 3, 5}) == [(0, 1), (2, 3), (4, 5)]
    assert windows([10] * 4, 0, 3, [], 10, 0, {1, 2, 3}) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    # one statement over the budget still makes progress
    assert windows([50, 5, 5], 0, 2, [1, 2], 10, 1, set()) == [(0, 0), (1, 2)]


def test_header_sheds_folders_before_the_signature():
    content = "class A:\n    def method(self, first, second):\n        return first\n"
    path = "/".join(["very_long_folder_name"] * 12) + "/m.py"
    plain, capped = (chunk_source(path, content, Settings(max_tokens=120, cap_header=c)) for c in (False, True))
    assert plain[-1][6].startswith(f"python {path}\n") and "def method" in capped[-1][6].split("\n")[2] and len(capped[-1][6]) < len(plain[-1][6])


def test_ids_survive_edits_elsewhere(spark):
    before, after = "def f():\n    pass\n", "import os\n\ndef f():\n    pass\n"
    made = [{r["id"] for r in chunking.syntax_chunks(spark.createDataFrame([("a.py", t)], "path string, content string")).collect()} for t in (before, after)]
    assert made[0] < made[1]


def test_unknown_chunker_and_ids():
    with pytest.raises(ValueError):
        chunking.chunker("none")
    assert chunking.chunker_id("syntax", Settings(max_tokens=100, cap_header=True)) == "syntax+max100+cap"


PATHS = [
    ("django/test/client.py", False), ("django/tests/foo.py", True), ("a/test_x.py", True), ("a/x_test.go", True), ("a/testdata/x.go", True), ("a/x.go", False),
    ("src/test/A.java", True), ("src/main/ATest.java", True), ("web/a.spec.ts", True), ("web/__tests__/a.js", True), ("tests/readme.md", False), ("conftest.py", True),
]


def test_classification(spark):
    df = spark.createDataFrame(PATHS, "path string, want boolean")
    assert all(r[0] == r[1] for r in df.select(languages.is_test(F.col("path")), "want").collect())
    files = [("a.go", "// Code generated by x. DO NOT EDIT.\npackage a\n", True), ("a.go", "package a\n// Code generated by x\n", False), ("a.md", "<!-- @generated -->\n", False)]
    df = spark.createDataFrame(files, "path string, content string, want boolean")
    assert all(r[0] == r[1] for r in df.select(languages.is_generated(F.col("path"), languages.head(F.col("content"))), "want").collect())
    heads = spark.createDataFrame([("a.h", "namespace x\nA::b"), ("a.h", "int a;"), ("a.xyz", "")], "p string, c string").select(languages.language(F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in heads] == ["cpp", "c", None]
    doc = spark.createDataFrame([('"""\nDO NOT EDIT\n"""\nx = 1',)], "c string").select(languages.is_skipped(F.lit("a.py"), F.col("c"))).first()[0]
    assert doc is False
    assert len(languages.by_extension()) == sum(len(x.extensions) for x in languages.LANGUAGES)


def test_spans(spark):
    kind = "path string, start bigint, stop bigint, name string"
    s = spark.createDataFrame([("p", 0, 10, "a"), ("p", 2, 5, "b"), ("p", 12, 15, ""), ("p", 12, 15, "c")], kind)
    r = spark.createDataFrame([("p", 0, 6, "r"), ("p", 0, 6, "q")], kind)
    s = s.withColumn("seq", F.when(F.col("name") == "", 0).otherwise(1))
    rows = lambda df: sorted(tuple(x) for x in df.drop("seq").collect())
    assert rows(intervals.remove_inside(s, r)) == [("p", 0, 10, "a"), ("p", 12, 15, ""), ("p", 12, 15, "c")]
    assert rows(intervals.outermost(intervals.unique_spans(s))) == [("p", 0, 10, "a"), ("p", 12, 15, "c")]
    assert rows(intervals.gaps(s, spark.createDataFrame([("p", 20)], "path string, size bigint"))) == [("p", 10, 12), ("p", 15, 20)]
    assert ("p", 2, 5, "b", "q.r.b") in rows(intervals.qualify(s, r)) and ("p", 0, 10, "a", "") in rows(intervals.innermost_scope(s, r))
    # the first named one in sequence, whatever the alphabet says
    named = spark.createDataFrame([("p", 0, 5, "z", 1), ("p", 0, 5, "a", 2), ("p", 0, 5, "", 0)], f"{kind}, seq int")
    assert rows(intervals.unique_spans(named)) == [("p", 0, 5, "z")]


def test_scopes_of_repeated_rows_against_all_pairs(spark):
    r = random.Random(3)
    span = lambda: (r.choice("pq"), a := r.randrange(30), a + r.randrange(12))  # noqa: E731, F841
    spans = [(*span(), r.choice("ab")) for _ in range(120)]
    spans += spans[:20]
    scopes = [(*span(), r.choice(["s", "t", "u", ""])) for _ in range(60)]
    kind = "path string, start bigint, stop bigint, name string"
    u, v = spark.createDataFrame(spans, kind), spark.createDataFrame(scopes, kind)
    up = {s: sorted((x for x in scopes if x[3] and x[0] == s[0] and x[1] <= s[1] and s[2] <= x[2]), key=lambda x: (x[1], -x[2], x[3])) for s in spans}
    assert sorted(map(tuple, intervals.qualify(u, v).collect())) == sorted((*s, ".".join([*(x[3] for x in up[s]), s[3]])) for s in spans)
    small = {s: min(up[s], key=lambda x: (x[2] - x[1], x[1], x[3]), default=(0, 0, 0, ""))[3] for s in spans}
    assert sorted(map(tuple, intervals.innermost_scope(u, v).collect())) == sorted((*s, small[s]) for s in spans)


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "B"), ("B", "C")], "src string, dst string")
    start = spark.createDataFrame([("C",)], "node string")
    assert sorted(r["node"] for r in graph.impact(edges, start).collect()) == ["A", "B", "D"]
    assert graph.trace(edges, "A", "C") == ["A", "B", "C"] and graph.trace(edges, "C", "A") is None and graph.trace(edges, "Z", "Z") == ["Z"]
    named = spark.createDataFrame([("(*m/s.B).Search",), ("m/s.Search",), ("other",)], "node string")
    assert sorted(r[0] for r in graph.resolve(named, "Search").collect()) == ["(*m/s.B).Search", "m/s.Search"]
    assert [r[0] for r in graph.resolve(named, "OTH").collect()] == ["other"] and graph.resolve(named, "").count() == 0
    assert graph.mermaid(edges).split("\n")[:3] == ["flowchart LR", '  n0["A"]', '  n1["B"]']
    assert go_calls("package m\n\nfunc Top() {\n\tMiddle()\n}\n\nfunc Middle() { x.Bottom() }\n") == [("Middle", "Bottom"), ("Top", "Middle")]


def test_long_chains_and_both_ways_of_searching(spark, monkeypatch):
    n = 20_000
    chain = spark.range(n).select(F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"))
    end = spark.createDataFrame([(f"n{n:05}",)], "node string")
    assert graph.impact(chain, end).count() == n and len(graph.trace(chain, "n00000", f"n{n:05}")) == n + 1
    r = random.Random(5)
    pairs = [(f"v{r.randrange(60)}", f"v{r.randrange(60)}") for _ in range(110)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    starts = spark.createDataFrame([("v1",), ("v2",), ("none",)], "node string")
    near = [sorted(map(tuple, graph.impact(edges, starts).collect())), graph.trace(edges, "v3", "v1"), graph.trace(edges, "v1", "none")]
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    assert near == [sorted(map(tuple, graph.impact(edges, starts).collect())), graph.trace(edges, "v3", "v1"), graph.trace(edges, "v1", "none")]


def test_wordpiece():
    w = WordPiece(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "cafe", "don", "'", "t", "un", "##aff", "##able"], 6)
    assert w.encode("Café") == [2, 4, 3] and w.encode("don't") == [2, 5, 6, 7, 3] and w.encode("unaffable ☃") == [2, 8, 9, 10, 1, 3] and w.encode("") == [2, 3]
    with pytest.raises(ValueError):
        WordPiece(["a"])


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, text in {"a.py": "def alpha():\n    return beta()\n", "pkg/b.go": "package b\n\nfunc Top() { Low() }\n\nfunc Low() {}\n", "pkg/__init__.py": "X = 'token value'\n", "node_modules/x.py": "no", ".git/y.py": "no", "c.bin": "no", "t/test_a.py": "def test(): pass\n"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    os.symlink(root / "a.py", root / "link.py")
    (root / "big.py").write_text("#" * ((4 << 20) + 1))
    return root


def test_source_tree(spark, tree):
    assert sorted(r["path"] for r in read_tree(spark, str(tree)).collect()) == ["a.py", "pkg/__init__.py", "pkg/b.go", "t/test_a.py"]
    assert read_tree(spark, str(tree / ".git")).count() == 0
    os.remove(tree / "link.py")
    one, two = (sorted(map(tuple, df.collect())) for df in (read_tree(spark, str(tree)), read_remote_tree(spark, f"file://{tree}")))
    assert one == two and len(one) == 4


def test_repository(spark, tree, tmp_path):
    repo = Repository(spark, str(tree), f"file://{tmp_path}/index", Settings(dimensions=32))
    first, again = repo.index(), repo.index()
    assert first["files"] == 3 and again == {"files": None, "chunks": first["chunks"], "reused": True}
    assert repo.lines("alpha beta")[0].split()[2].startswith("a.py:")
    set_file = tmp_path / "set.json"
    set_file.write_text('[{"query": "alpha", "relevant": ["a.py"]}, {"query": "zzz", "relevant": ["no"]}]')
    assert repo.evaluation_report(str(set_file))[0].startswith("queries=2 R@5=50.0%")
    assert repo.evaluation_report(str(set_file), True)[:2] == ["   1  alpha", "MISS  zzz"]
    assert repo.impact("o") == {"candidates": ["Low", "Top"], "total": 2}
    assert repo.impact("Low") == {"nodes": ["Top"]} and repo.trace("Top", "Low") == {"path": ["Top", "Low"]}
    assert [m for m, label, _ in repo.diagnose() if label == "index"] == ["ok"]
    assert ("info", "tuning", "dimensions=32") in repo.diagnose() and ("bad", "model", "/no/model.onnx is missing") in repo.diagnose("/no/model.onnx")
    drifted = Repository(spark, str(tree), f"file://{tmp_path}/index", Settings(dimensions=16))
    assert "embedder" in [d for _, label, d in drifted.diagnose() if label == "index"][0]
    assert repo.evaluate([("alpha", ["a.py"])], [1]).first()["recall"] == 1.0


def test_fingerprints_and_upsert(spark):
    assert catalog.stale_fields("schema=1 dim=2", "schema=1 dim=3") == ["dim"]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, catalog.upserted(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_catalog_versions(spark, tmp_path):
    """A table is replaced in one step, from its own rows too, and old versions go."""
    store = catalog.Catalog(spark, f"file://{tmp_path}/c")
    assert store.inspect() == {"fingerprint": None, "chunks": 0} and not store.ensure({"dim": 2})
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    store.upsert(rows)
    store.upsert(spark.createDataFrame([("b", "z")], "id string, content string"))
    assert sorted(map(tuple, store.chunks().collect())) == [("a", "x"), ("b", "z")]
    assert len([f for f in os.listdir(tmp_path / "c") if f.startswith("chunks-")]) == 1
    store.save_lexical("chunk", LexicalIndex.build(store.chunks()))
    assert store.load_lexical("chunk", store.chunks()).postings.count() == 2
    assert store.load_lexical("chunk", rows.limit(1)) is None and store.load_lexical("file") is None
    assert store.ensure({"dim": 2}) and not store.ensure({"dim": 3}) and store.inspect()["chunks"] == 0


def test_workspaces_and_places(tmp_path):
    roots = ["/a/Kube", "/b/kube-tools", "/c/web"]
    assert match_root("/c/web", roots) == "/c/web" and match_root("kube", roots) == "/a/Kube" and match_root("TOOLS", roots) == "/b/kube-tools" and match_root("x", roots) is None
    assert index_folder("/a/b") == "/a/b/.loamline" and index_folder("/a/b", "/i").startswith("/i/b-") and len(index_folder("/a/b", "/i")) == len("/i/b-") + 8
    assert phase_message(EMBEDDING, 5, 20) == "embedding 5/20 chunks ( 25%)" and phase_message(SCANNING, 3, 3) == "scanned 3 files" and phase_message(STORING, 0, 7) == "writing 7 chunks"
    tries = []

    def open_root(root, progress):
        progress(EMBEDDING, 1, 2)
        tries.append(root)
        if len(tries) == 1:
            raise OSError("not yet")
        return root.upper()

    w = Workspaces(open_root)
    assert w.acquire("/r")[0] is None and w.wait("/r", 10)
    with pytest.raises(OSError):
        w.acquire("/r")
    assert w.acquire("/r")[0] is None and w.wait("/r", 10) and w.acquire("/r") == ("/R", "")
    args = parser().parse_args(["search", "root", "where is it", "-k", "3"])
    assert (args.command, args.top, args.spans) == ("search", 3, 2)
    with pytest.raises(SystemExit):
        parser().parse_args(["search", "root"])


def test_stream_of_files(spark, tmp_path):
    store = catalog.Catalog(spark, f"file://{tmp_path}/store")
    into = f"{tmp_path}/in"
    spark.createDataFrame([("a.txt", "one\n\ntwo")], "path string, content string").coalesce(1).write.parquet(into)
    follow(spark, into, store, f"{tmp_path}/state").awaitTermination(120)
    spark.createDataFrame([("a.txt", "one\n\nthree"), ("b.txt", "x")], "path string, content string").coalesce(1).write.mode("append").parquet(into)
    follow(spark, into, store, f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r["content"] for r in store.chunks().collect()) == ["one", "three", "x"]
    # the latest version counts, not the largest text, and an older one changes nothing
    kind = "path string, content string, version bigint"
    for rows in ([("a.txt", "zzz", 3), ("a.txt", "aaa", 4)], [("a.txt", "yyy", 2)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(into)
        follow(spark, into, store, f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r["content"] for r in store.chunks().collect()) == ["aaa", "x"]
