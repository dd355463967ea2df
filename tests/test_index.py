"""The stored index: commits of several writers, growing buckets, values that tell what to read."""

import threading

import pytest
from notelake.config import SearchFilter
from notelake.sources import index as indexes
from notelake.sources.commits import CommitLog, Conflict
from notelake.sources.storage import BucketedTable


def chunks(spark, ids, title="t", notes=1000, tags=("x",)):
    rows = [(f"c{i}", f"n{i % notes}", f"{title} {i % notes}", f"dir/{i % notes}.md", [*tags, f"tag{i % 7}"], ["T"], 0, 1, 1, f"text {i}", "x", "y", [float(i)]) for i in ids]
    return spark.createDataFrame(rows, indexes.SCHEMA)


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.read() == (-1, None)
    assert log.commit(-1, {"a": 1}) == 0 and log.commit(0, {"a": 2}) == 1
    for after in (-1, 0, 2):
        with pytest.raises(Conflict):
            log.commit(after, {"a": 3})
    assert log.read() == (1, {"a": 2}) and log.read(0) == (0, {"a": 1})
    won = []

    def write(k):
        try:
            log.commit(1, {"a": k})
            won.append(k)
        except Conflict:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and log.read() == (2, {"a": won[0]})
    for n in range(2, 100):
        log.commit(n, {"a": n})
    assert log.read() == (100, {"a": 99}) and len(log.numbers()) <= 66


def test_two_writers(spark, tmp_path):
    """Both begin from one state; neither loses the other's rows, whether or not they touch the same buckets."""
    for buckets in (1, 32):
        index = indexes.ParquetIndex(spark, f"{tmp_path}/i{buckets}", buckets=buckets)
        index.ensure()
        index.upsert(chunks(spark, range(20)))
        other = indexes.ParquetIndex(spark, f"{tmp_path}/i{buckets}", buckets=buckets)
        plain, done = index.table._write, []

        def meanwhile(rows, count, plain=plain, other=other, done=done):
            out = plain(rows, count)
            if not done:
                done.append(1)
                other.upsert(chunks(spark, [7, 101], "other"))
                other.delete_notes(spark.createDataFrame([("n3",)], "note_id string"))
            return out

        index.table._write = meanwhile
        index.upsert(chunks(spark, [5, 100], "own"))
        titles = {r["chunk_id"]: r["note_title"] for r in index.read().collect()}
        assert len(titles) == 21 and "c3" not in titles
        assert [titles[c] for c in ("c5", "c100", "c7", "c101", "c0")] == ["own 5", "own 100", "other 7", "other 101", "t 0"]


def test_threads(spark, tmp_path):
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=4)
    index.ensure()
    threads = [threading.Thread(target=index.upsert, args=(chunks(spark, range(10 * k, 10 * k + 10)),)) for k in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert index.count() == index.ids().count() == 30


def test_buckets_grow(spark, tmp_path):
    """Buckets hold few rows on average however many come; rows stay where their key's hash says."""
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=2, most=20)
    index.ensure()
    for k in range(4):
        index.upsert(chunks(spark, range(60 * k, 60 * k + 60)))
        state = index.table._states()[0]
        assert sum(state["rows"].values()) == 60 * k + 60 <= 20 * state["count"] and max(state["rows"].values()) <= 60
        assert sorted(r["chunk_id"] for r in index.read().collect()) == sorted(f"c{i}" for i in range(60 * k + 60))
        for b in state["buckets"]:
            assert {r[0] for r in index.table.read({int(b)}).select(index.table.bucket()).distinct().collect()} == {int(b)}
    index.upsert(chunks(spark, [3], "again"))
    assert index.count() == 240 and index.matching(SearchFilter(note_title="again 3")).count() == 1
    index.delete_notes(index.read().select("note_id"))
    assert index.count() == 0 and index.table._states()[0]["buckets"] == {}


def opened(df):
    return {f.split("bucket=")[1].split("/")[0] for f in df.inputFiles()}


def test_filters_open_matching_buckets(spark, tmp_path):
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=64)
    index.ensure()
    index.upsert(chunks(spark, range(200), tags=()))
    index.upsert(chunks(spark, [500, 501], tags=("rare",)))
    index.patch(spark.createDataFrame([("c9", ["moved"])], "chunk_id string, tags array<string>"), ["tags"])
    everything = index.read().collect()
    for f, most in (
        (SearchFilter(note_id="n17"), 1),
        (SearchFilter(note_path="dir/17.md"), 1),
        (SearchFilter(note_title="t 17", tags=("tag3",)), 1),
        (SearchFilter(tags=("rare", "moved")), 3),
        (SearchFilter(tags=("rare",), note_id="n17"), 1),
        (SearchFilter(tags=("none",)), 0),
        (SearchFilter(note_path="dir/17.md", note_title="t 18"), 0),
        (SearchFilter(tags=("tag1",)), 64),
        (SearchFilter(), 64),
    ):
        df = index.matching(f)
        want = [r["chunk_id"] for r in everything if (not f.tags or set(f.tags) & set(r["tags"])) and f.note_id in (None, r["note_id"]) and f.note_path in (None, r["note_path"]) and f.note_title in (None, r["note_title"])]
        assert sorted(r["chunk_id"] for r in df.collect()) == sorted(want) and len(opened(df)) <= most, f
    assert len(opened(index.read())) > 40


def test_nulls_and_empty(spark, tmp_path):
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=4)
    index.ensure()
    index.upsert(chunks(spark, []))
    assert index.version == index.version and index.count() == 0
    row = ("c1", "n1", None, None, None, None, 0, 1, 1, None, None, None, None)
    index.upsert(spark.createDataFrame([row], indexes.SCHEMA))
    assert index.count() == 1 and index.matching(SearchFilter(note_id="n1")).count() == 1 and index.matching(SearchFilter(tags=("x",))).count() == 0
    table = BucketedTable(spark, f"{tmp_path}/t", "k string, v int", "k", 4)
    assert table.version is None and table.read().count() == 0 and table.holding("k", ["a"]) == set()
    assert table.change(spark.createDataFrame([("a",)], "k string"), lambda own: spark.createDataFrame([("a", 1)], "k string, v int"))
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
