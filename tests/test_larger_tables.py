"""Steps whose cost must not grow faster than their input, and results where they were cut or rounded otherwise."""

import ast
import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column
from pyspark.sql import functions as F

from loamline.functions import vectors as vx
from loamline.operators import evaluation, graph, lexical
from loamline.operators.syntax import chunk_source
from loamline.plans import catalogue
from loamline.sources import catalog, shared


def stages_of(spark, run):
    """Tasks of each stage that ``run`` needs."""
    group = f"stages-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("", "")
    status = spark.sparkContext.statusTracker()
    infos = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    return [i.numTasks for i in infos if i]


def test_a_file_with_many_long_functions_is_parsed_once(monkeypatch):
    calls = []
    parse = ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: calls.append(1) or parse(*a, **k))
    one = "def f{}():\n" + "".join(f"    call({i},\n        'some longer text')\n" for i in range(60))
    rows = chunk_source("a.py", "".join(one.format(k) for k in range(5)))
    assert len(calls) == 1 and len(rows) == 20


def test_statement_windows_of_a_small_file_are_many_tasks(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": pa.array(range(40), pa.int64())}), tmp_path / "customer.parquet")
    got = []
    tasks = stages_of(spark, lambda: got.extend(catalogue.QUERIES["statement_windows"](spark, str(tmp_path)).collect()))
    assert len(got) == 40 and all(r["cut"] and r["at_statements"] for r in got)
    assert max(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = catalogue.QUERIES["statement_windows"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("MapInArrow") < text.index("Repartition")


def test_syntax_chunks_of_a_small_file_are_many_tasks(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": pa.array(range(40), pa.int64()), "p_size": pa.array([1] * 40, pa.int32()), "p_name": ["x"] * 40}), tmp_path / "part.parquet")
    tasks = stages_of(spark, lambda: catalogue.QUERIES["syntax_chunks"](spark, str(tmp_path)).collect())
    assert max(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_small_negative_numbers_keep_their_sign_when_rounded(spark, tmp_path):
    """As in SQL, where round(-1e-8, 6) is -0.0."""
    rows = [[1.0, -1e-8] + [0.0] * 61 + [1e-8], [-1.0, 2.5e-7] + [-2e-7] * 62]
    pq.write_table(pa.table({"vec_id": [1, 2], "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([1, 2], pa.int32())}), tmp_path / "embeddings.parquet")
    for name, key, column in (("l2_normalize", "id", "v"), ("vector_codec", "id", "vector"), ("mean_pool", "label", "pooled")):
        got = {r[key]: [math.copysign(1, x) for x in r[column]] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {k: [math.copysign(1, x) for x in row] for k, row in zip((1, 2), rows)}, name


def best(docs, asked, top):
    """(query, id, rank) by brute force; rows with the same id are one document."""
    words = {}
    for i, text in docs:
        words.setdefault(i, Counter()).update(text.lower().split())
    n, average = len(words), sum(c.total() for c in words.values()) / len(words)
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, text in asked:
        own = {}
        for i, c in words.items():
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / average)) for w in text.split() if w in c]
            if parts:
                own[i] = sum(parts)
        out += [(q, i, k + 1) for k, i in enumerate(sorted(own, key=lambda i: (-round(own[i], 9), i))[:top])]
    return sorted(out)


def test_search_writes_no_pairs_of_queries_and_documents(spark, monkeypatch):
    """Equal documents in different tasks, ids that come twice, blocks of queries, and few scores at once."""
    r = random.Random(9)
    words = ["Wa", "wb", "wc", "wd", *(f"x{chr(97 + k)}y" for k in range(20))]
    docs = [(f"d{i % 390:03}", " ".join(r.choices(words, [8, 5, 3, 2] + [1] * 20, k=i % 7 + 1))) for i in range(400)] + [(f"e{i}", "wa wb") for i in range(30)] + [("f", "")]
    asked = [(i, " ".join(r.choices([w.lower() for w in words], k=4))) for i in range(25)] + [(30, "nothing"), (31, "")]
    table = spark.createDataFrame(docs, "id string, content string").repartition(4)
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    want = best(docs, asked, 6)
    written = []
    best_of = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda found, *a: written.append((found.rdd.getNumPartitions(), best_of(found, *a))) or written[-1][1])
    for index in (lexical.LexicalIndex.build(table), lexical.LexicalIndex.build(table).stored()):
        for most, scores in ((10_000, 4_000_000), (7, 300)):
            monkeypatch.setattr(lexical, "MOST_QUERIES", most)
            monkeypatch.setattr(lexical, "MOST_SCORES", scores)
            assert sorted((x["query_id"], x["id"], x["rank"]) for x in lexical.search(index, queries, 6).collect()) == want
    assert all(rows.count() <= tasks * 25 * 6 for tasks, rows in written)
    assert lexical.search(index, queries, 0).count() == 0 and lexical.search(index, queries.limit(0)).count() == 0


def test_a_stored_index_is_written_without_a_shuffle_of_words(spark, tmp_path):
    pq.write_table(pa.table({"id": pa.array(range(50), pa.int64()), "content": ["Some wordsHere, some"] * 50}), tmp_path / "d.parquet")
    plans = []
    index = lexical.LexicalIndex.build(spark.read.parquet(str(tmp_path / "d.parquet"))).write(lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or shared.kept(df, name))
    assert "Exchange" not in dict(plans)["rows"]
    assert {(x["term"], x["tf"], x["length"]) for x in index.postings.collect()} == {("some", 2, 4), ("words", 1, 4), ("here", 1, 4)}
    assert {(x["term"], x["df"]) for x in index.document_frequency().collect()} == {("some", 50), ("words", 50), ("here", 50)}


def test_passages_are_found_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    words = ["a", "bb", "ccc", "dd\nd", "e", ""]
    texts = [" ".join(r.choices(words, k=r.randrange(12))) for _ in range(150)] + [None, "", "bb", "xbb y"]
    passages = [" ".join(r.choices(words, k=k)) for k in (1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6)] + ["bb", None, "", "bb ccc", "b cc", "b ccc a", "zz yy xx"]
    pq.write_table(pa.table({"id": pa.array(range(len(texts)), pa.int64()), "content": pa.array(texts, pa.string())}), tmp_path / "d.parquet")
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id bigint, passage string")
    want = sorted((q, i) for q, p in enumerate(passages) for i, x in enumerate(texts) if p is not None and x is not None and p in x)
    for most in (100_000, 5):
        monkeypatch.setattr(evaluation, "MOST_PASSAGES", most)
        found = evaluation.holders(docs, asked)
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["x some words here y", "other"]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([7, 8], pa.int64()), "text": ["some words here", "none"]}), tmp_path / "benchmark.parquet")
    gold = catalogue._gold(spark, str(tmp_path))
    assert {x["query_id"]: x["relevant"] for x in gold.collect()} == {7: [1], 8: []}
    assert not any("contains" in line.lower() for line in gold._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_many_texts_are_embedded_at_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b a"), (2, "a b a"), (3, "c"), (4, None)], "id bigint, embed_text string")
    seen = []
    store = catalog.Catalog(spark, f"file://{tmp_path}/cache")
    got = store.embed(texts, "hash-8", 8, lambda t: seen.append(t) or vx.hash_vectors(t, "id", F.col("text"), 8))
    assert seen[0].columns == ["id", "text"] and seen[0].count() == 3  # each text once
    want = {x["id"]: x["v"] for x in texts.select("id", vx.hash_embedding(F.coalesce("embed_text", F.lit("")), 8).alias("v")).collect()}
    assert {x["id"]: [round(v, 12) for v in x["vector"]] for x in got.collect()} == {i: [round(v, 12) for v in x] for i, x in want.items()}
    # the catalogue's query embeds in Python, not by expressions of words times buckets
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": ["one two", "two"]}), tmp_path / "documents.parquet")
    calls = []
    embed = catalog.Catalog.embed
    catalog.Catalog.embed = lambda self, chunks, name, dim, vector, *a: calls.append(not isinstance(vector, Column)) or embed(self, chunks, name, dim, vector, *a)
    try:
        assert catalogue.QUERIES["vector_cache"](spark, str(tmp_path)).count() == 2 and calls == [True, True]
    finally:
        catalog.Catalog.embed = embed


def test_leaves_are_not_joined_with_all_edges_and_edges_are_not_shuffled_at_first(spark, monkeypatch):
    pairs = [(f"leaf{i}", f"m{i % 7}") for i in range(60)] * 2 + [(f"m{i}", "root") for i in range(7)] + [("root", "m0"), ("other", "x")]
    edges, start = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("root",)], "node string")
    want = sorted({("root", s, 2 if s.startswith("leaf") else 1) for s, _ in pairs if s not in ("root", "other")})
    plans = []
    keep = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, label="table": plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, label))
    for few in (5, 0):
        monkeypatch.setattr(graph, "SMALL_EDGES", few)
        plans.clear()
        assert sorted((r["start"], r["node"], r["depth"]) for r in graph.impact(edges, start).collect()) == want
        assert all("Aggregate" not in plan for label, plan in plans if label == "edges")
        # two rounds and no third for the leaves, which no edge leads to
        assert sum("LeftAnti" in plan for _, plan in plans) == 2 and sum(label == "targets" for label, _ in plans) == 1
