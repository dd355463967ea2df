"""Vectors by the hash of their text, notes that are never embedded, and figures of both."""

from notelake.config import Settings
from notelake.plans import ingest
from notelake.sources import index as indexes
from notelake.sources import providers
from notelake.sources.storage import VersionedTable
from notelake.sources.vectors import VectorStore
from notelake.streaming import sync
from test_search import notes_table, picky


def test_only_new_texts_are_embedded(spark, tmp_path):
    index, state = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=8), VersionedTable(spark, f"{tmp_path}/s", ingest.STATE_SCHEMA)
    store, provider, settings = VectorStore(spark, f"{tmp_path}/v", "hash-8", 4), providers.HashingEmbedder(8), Settings(chunk_size=20, chunk_overlap=0)
    section = lambda name, words: f"## {name}\n{words}\n"
    notes = {"a.md": "# A\n" + "".join(section(f"S{i}", f"text {i}") for i in range(4)), "b.md": "# B\nbody", "c.md": "# B\nbody"}

    def run(now):
        return ingest.sync_incremental(notes_table(spark, now), state, index, provider, settings, vectors=store)

    s = run(notes)
    assert (s.status, s.new_notes, s.new_chunks, s.embedded_texts) == ("completed", 3, 5, 5)  # b and c are one
    moved = {"sub/a.md": notes["a.md"], **{k: notes[k] for k in ("b.md", "c.md")}}
    s = run(moved)
    assert (s.new_notes, s.deleted_notes, s.embedded_texts) == (1, 1, 0)
    moved["sub/a.md"] = notes["a.md"].replace("text 2", "other 2")
    s = run(moved)
    assert (s.modified_notes, s.new_chunks, s.embedded_texts) == (1, 4, 1)
    s = run({"b.md": notes["b.md"]})
    s = run({"b.md": notes["b.md"], "back.md": moved["sub/a.md"]})
    assert (s.new_notes, s.new_chunks, s.embedded_texts) == (1, 4, 0)
    full = ingest.ingest_full(notes_table(spark, moved), index, provider, settings, vectors=store)
    assert (full.status, full.indexed_chunks, full.embedded_texts) == ("completed", 5, 0)
    want = {r["chunk_text"]: provider.embed(r["chunk_text"]) for r in index.read().collect()}
    assert len(want) == 5 and all(max(abs(a - b) for a, b in zip(r["embedding"], want[r["chunk_text"]], strict=True)) < 1e-6 for r in index.read().collect())
    other = VectorStore(spark, f"{tmp_path}/v", "another", 4)
    _, made = other.embedded(index.read().select("chunk_text"), "chunk_text", provider)
    assert made == 5


def test_failed_calls_leave_nothing(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v", "m", 2)
    df = spark.createDataFrame([("good",), ("poison",), (None,), ("good",)], "t string").coalesce(1)
    rows, made = store.embedded(df, "t", picky(4), 1)
    got = {(r["t"], r["vector"] is None, r["error"]) for r in rows.collect()}
    assert made == 2 and got == {("good", False, None), ("poison", True, "ValueError: bad batch"), (None, False, None)} and rows.count() == 4
    rows, made = store.embedded(df, "t", providers.HashingEmbedder(4), 1)
    assert made == 1 and all(r["vector"] for r in rows.collect())
    rows, made = store.embedded(df.limit(0), "t", picky(4))
    assert made == 0 and rows.count() == 0


def test_stream_outlives_a_note(spark, tmp_path):
    """One note that can't be embedded is kept and tried again, ever more seldom; the others are indexed."""
    (tmp_path / "v").mkdir()
    index = indexes.ParquetIndex(spark, f"{tmp_path}/i", buckets=2)
    letters = VersionedTable(spark, f"{tmp_path}/letters", sync.LETTERS)
    files = lambda: spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(f"{tmp_path}/v")
    one = Settings(embed_batch_size=1)

    def run(name, body, provider):
        (tmp_path / "v" / name).write_text(body)
        sync.sync_stream(files(), f"{tmp_path}/v", index, provider, f"{tmp_path}/check", one, letters=letters, attempts=2).awaitTermination(120)
        return sorted(r["note_path"] for r in index.payloads().collect()), [(r["relative_path"], r["attempts"], r["next_batch"]) for r in letters.read().collect()]

    assert run("p.md", "poison", picky(4)) == ([], [("p.md", 1, 1)])
    assert run("a.md", "fine", picky(4)) == (["a.md"], [("p.md", 2, 3)])
    assert run("b.md", "fine, too", providers.HashingEmbedder(4)) == (["a.md", "b.md"], [("p.md", 2, 3)])  # given up
