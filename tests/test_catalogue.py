"""A few catalogue queries against DuckDB on the smallest tables, and the entry's contract."""

import os

import pytest

import __spark_entry__ as entry
from loamline.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and set(ORACLES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["bm25_batch", "hybrid_files_n2", "paragraph_chunks", "interval_gaps", "recall_at_ks", "quantized_rerank", "is_test_path"])
def test_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    q = c.execute(ORACLES[name])
    names = [x[0] for x in q.description]
    want = sorted((plain(tuple(r[names.index(x)] for x in df.columns)) for r in q.fetchall()), key=repr)
    assert sorted((plain(tuple(r)) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
