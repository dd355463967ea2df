"""The keyword index in segments: after any changes it is what building anew gives."""

import random
import shutil

import pytest
from notelake.config import SearchFilter
from notelake.operators import bm25, segments
from notelake.plans import retrieve
from notelake.sources import index as indexes
from notelake.sources import providers

WORDS = [f"w{i}" for i in range(40)] + ["the", "x"]


def frame(spark, chunks):
    return spark.createDataFrame([(c, n, t) for c, (n, t) in chunks.items()], "chunk_id string, note_id string, chunk_text string")


def ids(spark, chunk_ids):
    return spark.createDataFrame([(c,) for c in chunk_ids], "chunk_id string")


def answers(index, queries, limit=5):
    return sorted((r["query_id"], r["list_pos"], r["chunk_id"], round(r["score"], 9)) for r in bm25.search(index, queries, limit).collect())


def same(spark, s, chunks):
    own, new = s.keywords(), bm25.built(frame(spark, chunks))
    q = spark.createDataFrame([(0, "w1 w2 w3 w3"), (1, " ".join(WORDS)), (2, "w39"), (3, "none"), (4, "")], "query_id int, text string")
    assert answers(own, q) == answers(new, q)
    assert sorted((r["term"], r["df"], round(r["idf"], 9)) for r in own.terms.collect()) == sorted((r["term"], r["df"], round(r["idf"], 9)) for r in new.terms.collect())
    assert [tuple(r) for r in own.stats.collect()] == [(n, pytest.approx(a) if a is not None else None) for n, a in new.stats.collect()]
    assert sorted(own.postings.collect()) == sorted(new.postings.select("chunk_id", "term", "tf", "dl").collect())


def test_counts(spark):
    texts = ["b a b c1 b a1 a1", "", None, "the a of", "zz", " ".join(["zz"] * 70 + ["yy"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, chunk_text string")
    got = {r["chunk_id"]: (r["dl"], [tuple(t) for t in r["terms"]]) for r in bm25.counted(rows).collect()}
    assert got == {0: (3, [("a1", 2), ("c1", 1)]), 1: (0, []), 2: (0, []), 3: (0, []), 4: (1, [("zz", 1)]), 5: (71, [("yy", 1), ("zz", 70)])}


def test_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "_MOST", 3)
    r = random.Random(2)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 30)))
    chunks = {f"c{i}": (f"n{i % 9}", text()) for i in range(60)}
    s = segments.SegmentIndex(spark, f"{tmp_path}/k")
    same(spark, s, {})
    s.build(frame(spark, chunks))
    first = s.state()["segments"][0]["name"]
    for k in range(2):
        gone = r.sample(sorted(chunks), 5)
        added = {f"x{k}-{i}": ("n", text()) for i in range(4)} | {c: ("n", text()) for c in r.sample(sorted(chunks.keys() - set(gone)), 3)}
        s.change(frame(spark, added), ids(spark, [*gone, "unknown"]))
        chunks = {c: v for c, v in chunks.items() if c not in gone} | added
        if k == 0:
            assert [x["name"] for x in s.state()["segments"]][0] == first and len(s.state()["segments"]) == 2  # the first stays as it was written
    same(spark, s, chunks)
    s.compact(1)
    assert len(s.state()["segments"]) == 1
    same(spark, s, chunks)
    s.change(frame(spark, {}), ids(spark, chunks))
    same(spark, s, {})
    s.change(frame(spark, {"z": ("n", "w1 w1 w5")}), ids(spark, []))
    same(spark, s, {"z": ("n", "w1 w1 w5")})


def test_follows_an_index(spark, tmp_path):
    """Of three changed notes only their buckets are read and only their chunks are written."""
    def rows(notes, words):
        each = [(f"c{n}-{i}", f"n{n}", "t", "p", [], [], i, 2, 1, f"{words} w{n} w{i}", "x", "y", [1.0]) for n in notes for i in range(2)]
        return spark.createDataFrame(each, indexes.SCHEMA)

    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=64)
    index.ensure()
    index.upsert(rows(range(60), "common"))
    retriever = retrieve.Retriever(index, providers.HashingEmbedder(1), f"{tmp_path}/k")
    assert bm25.search_text(retriever.ensure_keywords(), "w17", 9).count() == 2
    before = retriever.segments.state()["segments"]
    index.upsert(rows([3, 4], "walrus"))
    index.delete_notes(spark.createDataFrame([("n5",)], "note_id string"))
    changed, here = index.since(retriever.segments.corpus, index.snapshot())
    assert changed.count() < 40 and retriever.segments.chunks().filter(here).count() < 40
    own = retriever.ensure_keywords()
    now = retriever.segments.state()["segments"]
    assert now[0]["name"] == before[0]["name"] and [(s["n"], s["dead_n"]) for s in now] == [(120, 6), (4, 0)]
    q = spark.createDataFrame([(0, "walrus common"), (1, "w5"), (2, "w3 w17")], "query_id int, text string")
    assert answers(own, q) == answers(bm25.built(index.payloads()), q)
    assert retriever.ensure_keywords() is own
    only = retrieve.RetrievalQuery(top_k=3, filters=SearchFilter(note_id="n17"), mode="semantic")
    assert {r["note_id"] for r in retriever.search("walrus", only).chunks.collect()} == {"n17"}
    index.patch(spark.createDataFrame([("c17-0", "other title")], "chunk_id string, note_title string"), ["note_title"])
    retriever.ensure_keywords()
    assert sum(s["n"] for s in retriever.segments.state()["segments"]) == 124  # no text changed


def test_catalog_follows_its_tables(spark, tmp_path, sf_dir):
    """Queries of the catalog don't answer from an index of another table under the same path."""
    from notelake import catalog

    for t in ("documents", "benchmark", "embeddings"):
        shutil.copyfile(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    assert catalog.QUERIES["bm25_topk"](spark, str(tmp_path)).count() == 10
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    few.write.parquet(f"{tmp_path}/new")
    (tmp_path / "documents.parquet").unlink()
    (tmp_path / "new").rename(tmp_path / "documents.parquet")
    spark.catalog.clearCache()
    assert catalog.QUERIES["bm25_topk"](spark, str(tmp_path)).count() == 0
