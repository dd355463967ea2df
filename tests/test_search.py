"""Search, fusion, ingestion, storage and streams."""

import math
from datetime import datetime

import numpy as np
import pytest
from notelake.config import RetrievalQuery, SearchFilter, Settings
from notelake.operators import bm25, fusion, limits, sessions, vector
from notelake.plans import answer, ingest, retrieve
from notelake.sources import index as indexes
from notelake.sources import providers
from notelake.sources.storage import VersionedTable, read_text, write_text
from notelake.streaming import limits as stream_limits
from notelake.streaming import sessions as stream_sessions
from pyspark.sql import functions as F


def ranked(spark, names):
    return spark.createDataFrame([(0, n, i + 1) for i, n in enumerate(names)], "query_id int, chunk_id string, list_pos int")


def test_fusion_golden(spark):
    a, b = ranked(spark, "abc"), ranked(spark, "bd")
    got = {r["chunk_id"]: round(r["score"], 8) for r in fusion.fused([(a, 0.7), (b, 0.3)]).collect()}
    assert got == {"a": 0.01623731, "b": 0.01620836, "c": 0.01587302, "d": 0.00483871}
    back = {r["chunk_id"]: round(r["score"], 8) for r in fusion.fused([(b, 0.3), (a, 0.7)]).collect()}
    assert back == {"b": 0.01620836, "d": 0.01577621, "a": 0.01147541, "c": 0.01111111}
    three = fusion.fused([(a, 1.0), (b, 1.0), (ranked(spark, "e"), 1.0)]).orderBy("pos").collect()
    want = {"a": 1 / 61 + 1 / 63 + 1 / 62, "b": 1 / 62 + 1 / 61 + 1 / 62, "c": 1 / 63 + 1 / 63 + 1 / 62, "d": 1 / 62 + 1 / 62, "e": 1 / 61}
    assert {r["chunk_id"]: r["score"] for r in three} == pytest.approx(want)


def test_dedup_order(spark):
    rows = [(0, "a", "n", ["h"], 1), (0, "b", "n", ["h"], 2), (0, "c", "n", ["i"], 3), (0, "d", "n", ["j"], 4), (0, "e", "m", None, 5), (0, "f", "m", [], 6)]
    c = spark.createDataFrame(rows, "query_id int, chunk_id string, note_id string, heading_path array<string>, pos int")
    assert sorted(r["chunk_id"] for r in fusion.deduplicated(c, 2).collect()) == ["a", "c", "e"]
    assert fusion.dedup_counts(c, fusion.deduplicated(c, 2)).first()["deduplicated_count"] == 3


def test_bm25_against_python(spark):
    texts = {"a": "spark joins tables", "b": "spark sorts tables tables", "c": "rare walrus spark", "d": "", "e": "spark spark"}
    k = bm25.built(spark.createDataFrame(list(texts.items()), "chunk_id string, chunk_text string"))
    toks = {i: t.split() for i, t in texts.items()}
    n, avg = 5, sum(map(len, toks.values())) / 5
    vocabulary = {w for t in toks.values() for w in t}
    df = {w: sum(w in t for t in toks.values()) for w in vocabulary}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: r if r >= 0 else 0.25 * mean for w, r in raw.items()}
    q = ["walrus", "tables", "tables", "spark", "absent"]
    want = {}
    for i, t in toks.items():
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q)
        if s > 0:
            want[i] = s
    got = {r["chunk_id"]: r["score"] for r in bm25.search(k, spark.createDataFrame([(1, " ".join(q))], "query_id int, text string"), 9).collect()}
    assert got == pytest.approx(want)
    assert k.is_stale(None) and bm25.search(k, spark.createDataFrame([(1, "the of")], "query_id int, text string"), 9).count() == 0


def test_bm25_saved(spark, tmp_path):
    k = bm25.built(spark.createDataFrame([(i, f"word{i % 7} common x{i}") for i in range(60)], "chunk_id int, chunk_text string"), version="v")
    stored = bm25.saved(k, f"{tmp_path}/k", 3)
    q = spark.createDataFrame([(1, "word3 x10")], "query_id int, text string")
    want = [tuple(r) for r in bm25.search(k, q, 5).orderBy("list_pos").collect()]
    few = bm25.for_terms(stored, ["word3", "x10"])
    assert want and [tuple(r) for r in bm25.search(few, q, 5).orderBy("list_pos").collect()] == want and not stored.is_stale("v")
    assert "In(term, [word3,x10])" in few.postings._jdf.queryExecution().toString()


def test_bm25_two_documents_score_nothing(spark):
    k = bm25.built(spark.createDataFrame([("a", "cat"), ("b", "dog")], "chunk_id string, chunk_text string"))
    assert bm25.search(k, spark.createDataFrame([(1, "cat")], "query_id int, text string"), 9).count() == 0
    empty = bm25.built(spark.createDataFrame([], "chunk_id string, chunk_text string"))
    assert bm25.search(empty, spark.createDataFrame([(1, "cat")], "query_id int, text string"), 9).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    rows = [(f"c{i:02}", [float(v) for v in x[i]], ["t" if i % 2 else "u"], f"n{i % 3}") for i in range(40)] + [("z", [0.0] * 5, ["t"], "n0")]
    ix = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, tags array<string>, note_id string")
    cos = {f"c{i:02}": float(x[i] @ x[0] / np.linalg.norm(x[i]) / np.linalg.norm(x[0])) for i in range(40)}
    want = sorted(cos, key=lambda c: -cos[c])
    assert [r["chunk_id"] for r in vector.search(ix, list(x[0]), 7).orderBy("list_pos").collect()] == want[:7]
    batch = vector.search_batch(ix, spark.createDataFrame([(1, [float(v) for v in x[0]]), (2, [0.0] * 5)], "query_id int, vector array<double>"), 7)
    assert [r["chunk_id"] for r in batch.orderBy("list_pos").collect()] == want[:7]
    only = vector.search(ix, list(x[0]), 50, 0.2, SearchFilter(tags=("t",), note_id="n1"))
    assert {r["chunk_id"] for r in only.collect()} == {c for c in cos if cos[c] >= 0.2 and int(c[1:]) % 2 and int(c[1:]) % 3 == 1}
    assert not SearchFilter().active and SearchFilter(note_path="p").active


def test_vector_grid(spark, monkeypatch):
    """Many cells and merges in two steps, vectors of two lengths, ties, queries of a row each: as one product gives."""
    for name, value in (("_ROWS", 40), ("_QUERIES", 16), ("_STEP", 2), ("_MERGED", 3)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(4)
    x = {i: rng.integers(-2, 3, size=3 if i % 5 else 4).astype(float) for i in range(500)}
    ix = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in x] + [(999, None), (998, [])], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", [float(v) for v in x[i]]) for i in range(70)] + [("none", None)], "query_id string, vector array<double>")
    got = {}
    for r in vector.search_batch(ix, q, 4, 0.1).orderBy("list_pos").collect():
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["chunk_id"]))
    want = {}
    for i in range(70):
        near = [(float(x[i] @ v / np.linalg.norm(x[i]) / np.linalg.norm(v)), k) for k, v in x.items() if len(v) == len(x[i]) and v.any() and x[i].any()]
        best = sorted(((round(s, 9), k) for s, k in near if s >= 0.1), key=lambda t: (-t[0], t[1]))[:4]
        if best:
            want[f"q{i}"] = best
    assert got == want
    empty = ix.limit(0)
    assert vector.search_batch(empty, q, 4).count() == 0 and vector.search_batch(ix, q.limit(0), 4).count() == 0


def test_bucket(spark):
    b = limits.Bucket(60, 3)
    assert [b.allow(t) for t in (0, 0, 0, 0, 1.5, 1.5, 1.0)] == [True, True, True, False, True, False, False]
    r = limits.RateLimiter(60, 1)
    assert r.remaining("x", 0) == 1 and r.check("x", 0) and not r.check("x", 0) and r.bucket_count() == 1
    r.reset("x")
    assert r.bucket_count() == 0 and r.check("x", 0)
    rows = [(i, f"k{i % 3}", float(i % 50)) for i in range(300)]
    got = limits.rate_limited(spark.createDataFrame(rows, "i int, k string, s double"), "k", "s", "i", 30, 4).collect()
    want = {}
    for key in ("k0", "k1", "k2"):
        b = limits.Bucket(30, 4)
        for i, _, s in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            want[i] = b.allow(s)
    assert {r["i"]: r["allowed"] for r in got} == want


def test_sessions_replayed(spark):
    """Who is created, resumed, evicted, expired; what is kept of a history."""
    log = [(0, "open", "a"), (1, "open", "b"), (2, "say", "a", "0"), (2, "say", "a", "1"), (2, "say", "a", "2"), (2, "read", "a"), (3, "open", "c"), (3, "read", "b"), (3, "say", "b", "x")]
    log += [(12, "read", "a"), (12.1, "read", "a"), (12.2, "open", "c"), (12.3, "close", "c"), (12.4, "close", "c"), (13, "open", None)]
    rows = [(store, i, float(at), call, session, "user", text[0] if text else None) for store in ("s", "t") for i, (at, call, session, *text) in enumerate(log)]
    calls = spark.createDataFrame(rows, "store string, seq int, at double, call string, session string, role string, content string")
    got = sessions.replayed(calls, capacity=2, keep=2, ttl=10).orderBy("store", "seq").collect()
    assert [r["outcome"] for r in got[:15]] == ["created", "created", "added", "added", "added", "found", "created", "absent", "absent", "found", "absent", "resumed", "closed", "absent", "created"]
    assert [m["content"] for m in got[5]["messages"]] == ["1", "2"] and got[6]["evicted"] == "b" and [r["live"] for r in got[:3]] == [1, 2, 2] and got[14]["session"]
    assert [tuple(r)[3:] for r in got[:14]] == [tuple(r)[3:] for r in got[15:29]]


def test_sessions_against_a_scan():
    """The replay does what looking through all sessions at every call does."""
    import random

    r = random.Random(3)
    log, at = [], 0.0
    for i in range(3000):
        at += r.random() * 4 + 1e-6
        log.append((at, r.choice(["open", "open", "say", "read", "close"]), r.choice("abcdefg"), "user", str(i)))
    held = {}
    for (t, call, sid, role, text), got in zip(log, sessions.replay(log, capacity=3, keep=4, ttl=9), strict=True):
        if call != "say":
            held = {k: v for k, v in held.items() if t - v[0] <= 9}
        gone, had = None, sid in held
        if call == "open":
            if not had and len(held) >= 3:
                gone = min(held, key=lambda k: held[k][0])
                del held[gone]
            held[sid] = (t, held[sid][1] if had else [])
        elif call == "say" and had:
            held[sid] = (t, [*held[sid][1], (role, text)][-4:])
        shown = held[sid][1] if call == "read" and had else None
        if call == "close":
            held.pop(sid, None)
        assert got[2:] == (gone, len(held), shown) and (got[1] in ("resumed", "added", "found", "closed")) == had


def test_storage(spark, tmp_path):
    p = f"{tmp_path}/deep/state.txt"
    assert read_text(spark, p) is None
    write_text(spark, p, "eins")
    write_text(spark, p, "zwei é")
    assert read_text(spark, p) == "zwei é"
    t = VersionedTable(spark, f"{tmp_path}/t", "a int, b string")
    assert t.read().count() == 0 and not t.exists()
    t.ensure()
    for i in range(5):
        t.overwrite(t.read().unionByName(spark.createDataFrame([(i, "x")], "a int, b string")))
    assert t.read().count() == 5 and len([d for d in (tmp_path / "t").iterdir() if d.name.startswith("v-")]) == 3
    assert t.at_pin(t.pin()).count() == 5
    (tmp_path / "t" / "CURRENT.json").write_text("{broken")
    (tmp_path / "t" / ".CURRENT.json.crc").unlink(missing_ok=True)
    assert t.read().count() == 0
    t.drop()
    assert not (tmp_path / "t").exists()


def notes_table(spark, items):
    import hashlib

    rows = [(p, p.removesuffix(".md"), raw, ["t"], hashlib.sha256(raw.encode()).hexdigest(), datetime(2024, 1, 2)) for p, raw in items.items()]
    return spark.createDataFrame(rows, "relative_path string, title string, raw_content string, tags array<string>, content_hash string, modified_at timestamp")


def test_ingest_sync_and_answer(spark, tmp_path):
    index, state = indexes.ParquetIndex(spark, f"{tmp_path}/index"), VersionedTable(spark, f"{tmp_path}/state", ingest.STATE_SCHEMA)
    provider, settings = providers.HashingEmbedder(32), Settings(chunk_size=50, chunk_overlap=5)
    first = {"a.md": "# Sea\nThe walrus lives on ice.", "b.md": "# Land\nThe camel walks in deserts.", "c.md": "# Same\nbody", "d.md": "# Same\nbody", "e.md": "Bees build hives."}
    full = ingest.ingest_full(notes_table(spark, first), index, provider, settings)
    assert (full.status, full.total_notes, full.total_chunks) == ("completed", 5, 4) and index.count() == 4
    assert ingest.ingest_full(notes_table(spark, {}), index, provider, settings).total_notes == 0 and index.count() == 4
    again = ingest.ingest_full(notes_table(spark, {k: v for k, v in first.items() if k != "e.md"}), index, provider, settings)
    assert again.deleted_stale_chunks == 1 and index.count() == 3
    s = ingest.sync_incremental(notes_table(spark, first), state, index, provider, settings)
    assert (s.new_notes, s.status) == (5, "completed") and index.count() == 4
    version = index.version
    s = ingest.sync_incremental(notes_table(spark, first), state, index, provider, settings)
    assert s.status == "no_changes" and s.unchanged_notes == 5 and index.version == version
    second = {"a.md": "# Sea\nThe walrus sleeps.", "c.md": first["c.md"], "b.md": first["b.md"], "f.md": "Foxes hunt."}
    s = ingest.sync_incremental(notes_table(spark, second), state, index, provider, settings)
    assert (s.new_notes, s.modified_notes, s.deleted_notes, s.unchanged_notes) == (1, 1, 2, 2)
    kept = sorted(r["chunk_text"].split("\n\n")[1] for r in index.payloads().collect())
    assert kept == ["Foxes hunt.", "The camel walks in deserts.", "The walrus sleeps.", "body"]

    retriever = retrieve.Retriever(index, provider)
    hit = retriever.search("where does the walrus sleep", RetrievalQuery(top_k=2)).chunks.orderBy("rank").first()
    assert "walrus" in hit["chunk_text"] and hit["note_path"] == "a.md"
    for mode in ("semantic", "keyword"):
        assert "walrus" in retriever.search("walrus", RetrievalQuery(top_k=1, mode=mode)).chunks.first()["chunk_text"]
    old = retriever.keywords
    assert retriever.ensure_keywords() is old
    assert "parquet" in old.postings._jdf.queryExecution().optimizedPlan().toString() and "regexp" not in old.postings._jdf.queryExecution().optimizedPlan().toString()
    retriever.invalidate()
    assert old.is_stale(index.version) and bm25.search_text(old, "walrus", 1).count() == 1  # stale, and answers all the same
    assert retriever.ensure_keywords() is not old

    q = spark.createDataFrame([(1, "what of the walrus", provider.embed("walrus")), (2, "please jailbreak", provider.embed("x"))], "query_id int, text string, vector array<double>")
    contexts = answer.answer_context(index.read(), q)
    got = {r["query_id"]: r for r in answer.answers(contexts, providers.ExtractiveChat()).collect()}
    assert got[1]["answer"] and got[1]["messages"][0]["role"] == "system" and got[2]["blocked"] and got[2]["answer"] is None
    events = list(answer.stream_answer(retriever.search("walrus").chunks, [{"role": "user", "content": "─" * 68 + "\nIt sleeps. Yes."}], providers.ExtractiveChat()))
    assert events[0]["type"] == "retrieval" and "".join(e.get("delta", "") for e in events) == "It sleeps." and events[-1]["type"] == "done"
    assert index.healthy() and index.info().first()["vector_size"] == 32
    index.drop()


def test_failed_sync_is_repeated(spark, tmp_path):
    class Broken(providers.HashingEmbedder):
        def embed_batch(self, texts):
            raise ValueError("no model")

    index, state = indexes.ParquetIndex(spark, f"{tmp_path}/i"), VersionedTable(spark, f"{tmp_path}/s", ingest.STATE_SCHEMA)
    n = notes_table(spark, {"a.md": "x y"})
    assert ingest.sync_incremental(n, state, index, Broken()).status == "failed"
    s = ingest.sync_incremental(n, state, index, providers.HashingEmbedder(4))
    assert s.new_notes == 1 and s.status == "completed" and index.count() == 1


def picky(size):
    """An embedder that refuses batches with a certain word."""

    class Picky(providers.HashingEmbedder):
        def embed_batch(self, texts):
            if any("poison" in t for t in texts):
                raise ValueError("bad batch")
            return super().embed_batch(texts)

    return Picky(size)


def test_bad_batches_are_apart(spark, tmp_path):
    """A call that fails costs its own chunks; the run tells it, and the next one takes the notes up again."""
    items = {f"n{i}.md": f"note {i}" for i in range(6)} | {"p.md": "poison here"}
    one = Settings(embed_batch_size=1)
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i")
    full = ingest.ingest_full(notes_table(spark, items), index, picky(8), one)
    assert (full.status, full.total_chunks, full.indexed_chunks, index.count()) == ("failed", 7, 6, 6) and full.errors == ["ValueError: bad batch (1 chunks)"]
    state = VersionedTable(spark, f"{tmp_path}/s", ingest.STATE_SCHEMA)
    s = ingest.sync_incremental(notes_table(spark, items), state, index, picky(8), one)
    assert (s.status, s.new_notes, s.new_chunks, state.read().count()) == ("failed", 7, 6, 6)
    s = ingest.sync_incremental(notes_table(spark, items), state, index, providers.HashingEmbedder(8), one)
    assert (s.status, s.new_notes, s.unchanged_notes, index.count(), state.read().count()) == ("completed", 1, 6, 7, 7)
    ingest.record_run(spark, f"{tmp_path}/runs/last.json", s)
    last = ingest.last_run(spark, f"{tmp_path}/runs/last.json")
    assert last["status"] == "completed" and last["new_notes"] == 1 and ingest.last_run(spark, f"{tmp_path}/none") is None


def test_last_row_of_a_key_wins(spark):
    old = spark.createDataFrame([("c1", "x"), ("c2", "y")], "chunk_id string, note_id string")
    new = spark.createDataFrame([("c1", "old", 1), ("c3", "z", 2), ("c1", "new", 3)], "chunk_id string, note_id string, seq int")
    assert sorted(map(tuple, indexes.upserted(old, new, order="seq").collect())) == [("c1", "new"), ("c2", "y"), ("c3", "z")]
    many = spark.createDataFrame([(f"c{i % 100}", f"x{i}", i) for i in range(1000)], "chunk_id string, note_id string, seq int")
    for parts in (3, 7):  # wherever the rows lie
        last = indexes.upserted(old, many.repartition(parts, "note_id"), order="seq")
        assert {r["chunk_id"]: r["note_id"] for r in last.collect()} == {f"c{i % 100}": f"x{i}" for i in range(900, 1000)}
    some = [sorted(map(tuple, indexes.upserted(old, many.repartition(parts, "seq")).collect())) for parts in (2, 5)]
    assert some[0] == some[1]  # without an order: every run keeps the same rows


def test_index_writes_touched_buckets(spark, tmp_path):
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=16)
    index.ensure()
    rows = lambda ids, title: spark.createDataFrame([(f"c{i}", f"n{i}", title, "p", ["t"], ["T"], 0, 1, 1, "text", "x", "y", [1.0]) for i in ids], indexes.SCHEMA)
    index.upsert(rows(range(100), "first"))
    before = index.table._states()[0]["buckets"]
    index.upsert(rows([7], "second"))
    after = index.table._states()[0]["buckets"]
    assert len(before) > 8 and sum(before[k] != after[k] for k in before) == 1 and index.count() == 100
    index.patch(spark.createDataFrame([("c8", "third")], "chunk_id string, note_title string"), ["note_title"])
    index.delete_notes(spark.createDataFrame([("n9",)], "note_id string"))
    index.delete_ids(spark.createDataFrame([("c10",), ("none",)], "chunk_id string"))
    version = index.version
    index.delete_ids(spark.createDataFrame([("none",)], "chunk_id string"))
    titles = {r["chunk_id"]: r["note_title"] for r in index.read().collect()}
    assert index.version == version and len(titles) == 98 and {titles["c7"], titles["c8"], titles["c1"]} == {"first", "second", "third"}
    # a chunk that moves to another note is replaced where it was
    index.upsert(rows([1], "moved").withColumn("note_id", F.lit("other")))
    assert index.count() == 98 and index.ids().count() == 98


def test_sync_stream(spark, tmp_path):
    """Files of one name in two folders are two notes; hidden ones and other kinds of file are none."""
    from notelake.sources.notes import scan_notes
    from notelake.streaming.sync import sync_stream

    for name, body in (("a/x.md", "# A\none"), ("b/x.md", "# B\ntwo"), (".h/x.md", "no"), ("a/y.txt", "no")):
        (tmp_path / "v" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / name).write_text(body)
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=4)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(f"{tmp_path}/v")
    for _ in range(2):
        sync_stream(files, f"{tmp_path}/v", index, providers.HashingEmbedder(4), f"{tmp_path}/check").awaitTermination(120)
    got = index.payloads().collect()
    assert sorted(r["note_path"] for r in got) == ["a/x.md", "b/x.md"] == sorted(r["relative_path"] for r in scan_notes(spark, f"{tmp_path}/v").collect())
    assert all(datetime.fromisoformat(r["indexed_at"]) for r in got)


def test_scheduler():
    waits, runs = [], []

    def run():
        runs.append(1)
        if len(runs) == 1:
            raise RuntimeError("once")

    ingest.run_periodically(run, 2, lambda: len(runs) == 3, waits.append)
    assert waits == [120, 120, 120]
    ingest.run_periodically(run, 0, lambda: False, waits.append)
    assert len(runs) == 3


def test_vectors_of_other_lengths_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000, [1.0, 0.0, 0.0]), (5001, [0.0, 1.0])]
    ix = spark.createDataFrame(rows, "chunk_id int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, None)], "query_id int, vector array<double>")
    got = {}
    for r in vector.search_batch(ix, q, 4).collect():
        got.setdefault(r["query_id"], []).append((r["list_pos"], r["chunk_id"]))
    assert {k: [c for _, c in sorted(v)] for k, v in got.items()} == {1: [0, 1, 2, 3], 2: [5000]}
    assert [r["chunk_id"] for r in vector.search(ix, [1.0, 0.0, 0.0], 3).collect()] == [5000]


def test_bounds_of_results(spark):
    for k in (0, 51):
        with pytest.raises(ValueError):
            RetrievalQuery(top_k=k)
    with pytest.raises(ValueError):
        answer.answer_context(None, None, RetrievalQuery(top_k=21))


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("down")
        return 7

    assert providers.with_retries(call, sleep=waits.append) == 7 and waits == [0.5, 1.0]
    with pytest.raises(providers.Unavailable):
        providers.with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), sleep=waits.append)
    with pytest.raises(ValueError):
        providers.with_retries(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    rows = [(f"k{i % 2}", float(i // 10), datetime(2024, 1, 1, 0, 0, i // 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seconds double, ts timestamp")
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    _run(stream_limits.rate_limited_stream(source, 60, 3), "limited")
    got = sorted((r["key"], r["seconds"], r["allowed"]) for r in spark.table("limited").collect())
    want = []
    for key in ("k0", "k1"):
        b = limits.Bucket(60, 3)
        want += [(key, s, b.allow(s)) for k, s, _ in rows if k == key]
    assert got == sorted(want)
    batch = stream_sessions.session_windows(df, "key", "ts", 5).collect()
    assert sorted((r["key"], r["n_events"]) for r in batch) == [("k0", 30), ("k1", 30)]
