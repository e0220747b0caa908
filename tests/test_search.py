"""Words, BM25, vectors, fusion, hybrid search and evaluation on fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loamline.config import Settings
from loamline.functions import text as tx
from loamline.functions import vectors as vx
from loamline.operators import evaluation, fusion, lexical, nearest
from loamline.operators.hybrid import HybridIndex


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("getDependsOn", ["get", "depends", "on"]),
        ("user_id_map", ["user", "id", "map"]),
        ("where is auth handled", ["where", "is", "auth", "handled"]),
        ("parseJSON()", ["parse", "json"]),
        ("On2Go", ["on2", "go"]),
        ("HTTPServer", ["http", "server"]),
        ("", []),
    ],
)
def test_identifier_words(spark, given, want):
    assert one(spark, tx.identifier_words, given) == want


def test_hash_and_estimate(spark):
    assert one(spark, tx.fnv1a32, "hello") == 1335831723
    assert one(spark, tx.fnv1a32, "") == 2166136261
    assert one(spark, tx.estimate_tokens, "def add(a, b):") == 8


def brute(docs, query):
    words = {i: w.split() for i, w in docs}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        s = 0.0
        for q in query.split():
            df, tf = sum(q in x for x in words.values()), w.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))
        if s:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_bm25_against_brute_force(spark):
    rng = random.Random(42)
    vocabulary = [f"w{chr(97 + k)}" for k in range(13)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 45)))) for i in range(300)] + [(300, "")]
    index = lexical.LexicalIndex.build(spark.createDataFrame(docs, "id bigint, content string"))
    texts = ["wa", "wb wc", "wd wd we", "zz"]
    got = lexical.search(index, spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string"), 20).collect()
    for q, text in enumerate(texts):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        want = brute(docs, text)[:20]
        assert [r["id"] for r in own] == [i for i, _ in want]
        assert all(abs(r["score"] - s) < 1e-9 for r, (_, s) in zip(own, want))


def test_bm25_worked_value(spark):
    docs = spark.createDataFrame([("a", "a b c d e"), ("b", "jwt token x y z u"), ("c", "p q r s t u v")], "id string, content string")
    q = spark.createDataFrame([(0, "jwt token"), (1, "jwt jwt token")], "query_id bigint, query string")
    got = {r["query_id"]: (r["id"], r["score"]) for r in lexical.search(lexical.LexicalIndex.build(docs), q).collect()}
    assert got[0][0] == "b" and abs(got[0][1] - 2 * math.log(8 / 3)) < 1e-9 and abs(got[1][1] - 3 * math.log(8 / 3)) < 1e-9


def test_fusion_values(spark):
    rows = [(0, 0, r + 1, x) for r, x in enumerate("xyz")] + [(0, 1, r + 1, x) for r, x in enumerate("zxw")]
    lists = spark.createDataFrame(rows, "query_id int, list_idx int, rank int, id string")
    plain = [(r["id"], r["score"]) for r in fusion.take(fusion.fuse(lists, 60), 9).orderBy("rank").collect()]
    assert [i for i, _ in plain] == ["x", "z", "y", "w"] and abs(plain[0][1] - (1 / 61 + 1 / 62)) < 1e-12
    soft = {r["id"]: r["score"] for r in fusion.fuse(lists, 60, alpha=0.4).collect()}
    assert abs(soft["x"] - (1 / 61 + 0.4 / 62)) < 1e-12
    both = spark.createDataFrame([(0, 0, 1, "a"), (0, 1, 1, "a")], "query_id int, list_idx int, rank int, id string")
    assert abs(fusion.fuse(both, 60, [1.0, 2.0], n_lists=2).first()["score"] - 3 / 61) < 1e-12
    assert fusion.take(fusion.fuse(lists, 60), 0).count() == 0


def test_vectors(spark):
    assert one(spark, lambda x: vx.quantize(x), [-0.5 / 127, 2.0, -2.0, 0.0], "array<double>") == [-1, 127, -127, 0]
    pairs = [([3.0, 4.0], [3.0, 4.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [1.0, 1.0], 2**-0.5), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, want double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(vx.cosine(F.col("a"), F.col("b")), "want").collect())


def test_quantized_search_equals_exact(spark):
    rng = random.Random(7)

    def unit():
        v = [rng.gauss(0, 1) for _ in range(32)]
        s = math.sqrt(sum(x * x for x in v))
        return [x / s for x in v]

    vectors = spark.createDataFrame([(i, unit()) for i in range(400)] + [(400, None), (401, [])], "id bigint, vector array<double>")
    queries = spark.createDataFrame([(i, unit()) for i in range(10)], "query_id bigint, vector array<double>")
    rows = lambda df: [tuple(r) for r in df.select("query_id", "id", "rank").orderBy("query_id", "rank").collect()]
    assert rows(nearest.nearest_exact(vectors, queries, 10)) == rows(nearest.nearest_rescored(vectors, queries, 10, 6))


def test_scan_writes_few_rows_and_takes_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(11)
    point = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]  # many ties
    rows = [(f"v{i:04}", point()) for i in range(1500)]
    asked = [(i, point()) for i in range(30)]
    vectors = spark.createDataFrame(rows, "id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    assert nearest._scan(vectors, queries, 20, True).count() <= 3 * 30 * 20

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = sorted((q, i, k + 1) for q, v in asked for k, (_, i) in enumerate(sorted((-round(cos(v, w), 9) + 0.0, i) for i, w in rows)[:7]))
    for most in (10_000, 8):
        monkeypatch.setattr(nearest, "MOST_QUERIES", most)
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in nearest.nearest_exact(vectors, queries, 7).collect()) == want
    assert nearest.nearest_exact(vectors.limit(0), queries, 7).count() == 0 and nearest.nearest_exact(vectors, queries.limit(0), 7).count() == 0


def test_hash_vectors_match_expression(spark):
    docs = spark.createDataFrame([(1, "a b a Straße"), (2, ""), (3, None)], "id bigint, t string")
    got = {r["id"]: r["vector"] for r in vx.hash_vectors(docs, "id", F.col("t"), 16).collect()}
    want = docs.select("id", vx.hash_embedding(F.coalesce("t", F.lit("")), 16).alias("v")).collect()
    assert all(all(abs(x - y) < 1e-12 for x, y in zip(got[r["id"]], r["v"])) for r in want)


def chunk_rows(spark, rows):
    return spark.createDataFrame([(i, p, k, 1 + k, 1 + k, "", c, v) for k, (i, p, c, v) in enumerate(rows)], "id string, path string, ord bigint, start_line int, end_line int, symbol string, content string, vector array<double>")


def test_hybrid_files(spark):
    rows = [("a", "f.go", "alpha token", [1.0, 0.0]), ("b", "f.go", "beta", [0.0, 1.0]), ("c", "g.go", "gamma token token", [0.6, 0.8]), ("d", "h.go", "rare", None)]
    index = HybridIndex.build(chunk_rows(spark, rows), Settings(path_tokens=False))
    q = spark.createDataFrame([(0, "token", [1.0, 0.0])], "query_id bigint, query string, vector array<double>")
    wide = index.search_files(q, 10, 2).orderBy("rank", "span_rank").collect()
    narrow = index.search_first_spans(q, 10).orderBy("rank").collect()
    assert [(r["path"], r["score"]) for r in narrow] == [(r["path"], r["score"]) for r in wide if r["span_rank"] == 1]
    assert {r["path"] for r in wide} == {"f.go", "g.go"} and len([r for r in wide if r["path"] == "f.go"]) == 2
    chunks = index.search_chunks(q, 2).orderBy("rank").collect()
    assert [r["rank"] for r in chunks] == [1, 2] and chunks[0]["id"] in "ac"


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "x", 1)], "query_id bigint, id string, rank int")
    gold = spark.createDataFrame([(0, ["b", "b"]), (1, ["q"]), (2, [])], "query_id bigint, relevant array<string>")
    got = {r["k"]: (r["queries"], r["recall"], r["mrr"]) for r in evaluation.evaluate(hits, gold, [1, 3]).collect()}
    assert got[1] == (3, 0.0, 0.5 / 3) and abs(got[3][1] - 1 / 3) < 1e-12
    assert evaluation.report_line(evaluation.evaluate(hits, gold, [3])).first()[0] == "queries=3 R@3=33.3% MRR=0.167"


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("LOAMLINE_FUSION_K", "60")
    monkeypatch.setenv("LOAMLINE_FUSION_ALPHA", "much")
    assert Settings.from_environment().fusion_k == 60 and Settings.from_environment().fusion_alpha == 0.40
