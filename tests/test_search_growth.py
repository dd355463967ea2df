"""Searches of many queries do work in proportion to the index, and give the same results."""

import inspect
import random

import numpy as np
import pyarrow as pa
from notelake import catalog
from notelake.config import RetrievalQuery
from notelake.operators import bm25, vector
from notelake.plans import retrieve
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _searched_plainly(index, q, n):
    hits = bm25.scored(index, bm25.query_terms(q)).filter("score > 0")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return hits.withColumn("list_pos", F.row_number().over(order)).filter(F.col("list_pos") <= n)


def _rows(df):
    return sorted((r["query_id"], r["list_pos"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def test_pairs_of_query_and_chunk_are_never_shuffled(spark, monkeypatch):
    r = random.Random(5)
    docs = [(f"c{i}", " ".join(f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randrange(60)))) for i in range(400)] + [(f"z{i}", "w1 w2 same text") for i in range(30)]
    asked = [(f"q{i}", " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(9)))) for i in range(40)]
    index = bm25.built(spark.createDataFrame(docs, "chunk_id string, chunk_text string").repartition(3))
    q = spark.createDataFrame(asked, "query_id string, text string")
    want = _rows(_searched_plainly(index, q, 7))
    assert "Aggregate [query_id" not in _plan(bm25.search(index, q, 7)) and len(want) > 200
    assert _rows(bm25.search(index, q, 7)) == want
    for name, value in (("_HITS", 50), ("_CELLS", 90), ("_HELD", 10)):  # many blocks, trimmed often
        monkeypatch.setattr(bm25, name, value)
    assert _rows(bm25.search(index, q, 7)) == want
    monkeypatch.setattr(bm25, "_SMALL", 3)  # too many terms to send
    assert _rows(bm25.search(index, q, 7)) == want


def test_chunks_may_lie_in_two_batches():
    add = bm25._adder(np.array([0, 2, 3]), np.array([0, 1, 1]), np.array([1.0, 2.0, 3.0]), pa.array(["a", "b"]), 2, pa.int64())
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.float64()))], ["chunk_id", "code", "part"])
    found = [tuple(x.values()) for b in add(iter([batch((1, 0, 0.5), (2, 0, 1.0)), batch((2, 1, 1.0)), batch((2, 0, 0.25), (3, 1, 0.1))])) for x in b.to_pylist()]
    assert sorted(found) == [("a", 1, 0.5), ("a", 2, 1.25), ("b", 1, 1.0), ("b", 2, 5.5)]


def test_cells_are_small():
    """A cell's vectors in double precision and its products stay small beside a Python worker."""
    assert vector._ROWS * 64 * 8 <= 32 << 20 and "4 * _STEP" in inspect.getsource(vector._cell)


def test_semantic_search_needs_no_keyword_index(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalog, "keywords", lambda *_: 1 / 0)
    assert catalog.QUERIES["semantic_search"](spark, sf_dir).count() > 0


def test_texts_are_not_shuffled_and_candidates_are_made_once(spark, sf_dir):
    index, q = catalog.doc_chunks(spark, sf_dir), catalog.asked(spark, sf_dir)
    found = retrieve.search_batch(index, q, RetrievalQuery(top_k=5), catalog.keywords(spark, sf_dir))
    for df in (found.chunks, found.metrics):
        assert "InArrow" not in _plan(df)
    assert "Join LeftSemi" in _plan(found.chunks)
