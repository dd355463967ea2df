"""Full ingestion and incremental synchronisation of an index."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import iso_timestamp
from ..operators.chunk import chunked
from ..session import ship
from ..sources.index import PAYLOAD_COLUMNS, IndexTable, stale_ids
from ..sources.providers import EmbeddingProvider, embedded_or_failed
from ..sources.storage import VersionedTable, read_text, write_text
from ..sources.vectors import VectorStore

log = logging.getLogger(__name__)
STATE_SCHEMA = "relative_path string, content_hash string"


# The names of the figures that a full run and a synchronisation report.


@dataclass
class IndexingStats:
    total_notes: int = 0
    total_chunks: int = 0
    indexed_chunks: int = 0
    embedded_texts: int = 0
    deleted_stale_chunks: int = 0
    duration_ms: float = 0.0
    errors: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "completed" if not self.errors else "failed"


@dataclass
class SyncStats:
    new_notes: int = 0
    modified_notes: int = 0
    deleted_notes: int = 0
    unchanged_notes: int = 0
    new_chunks: int = 0
    embedded_texts: int = 0
    duration_ms: float = 0.0
    errors: list[str] = field(default_factory=list)

    @property
    def has_changes(self) -> bool:
        return bool(self.new_notes or self.modified_notes or self.deleted_notes)

    @property
    def status(self) -> str:
        if not self.has_changes:
            return "failed" if self.errors else "no_changes"
        return "failed" if self.errors else "completed"


def payloads(chunks: DataFrame, notes: DataFrame, indexed_at: str) -> DataFrame:
    """Chunks with the time they are indexed and their note's time of change; of notes with one hash the last by
    path counts, and without a note the time of indexing stands in."""
    own = notes.groupBy(F.col("content_hash").alias("note_id")).agg(F.max_by("modified_at", "relative_path").alias("_m"))
    out = chunks.join(own, "note_id", "left").withColumn("indexed_at", F.lit(indexed_at))
    return out.withColumn("note_modified_at", F.coalesce(iso_timestamp(F.col("_m")), F.col("indexed_at"))).select(*PAYLOAD_COLUMNS)


def diff(current: DataFrame, persisted: DataFrame) -> DataFrame:
    """relative_path, status (new, modified, deleted, unchanged), old_hash, new_hash."""
    now = current.select("relative_path", F.col("content_hash").alias("new_hash"))
    then = persisted.select("relative_path", F.col("content_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return now.join(then, "relative_path", "full_outer").withColumn("status", status)


def diff_counts(d: DataFrame) -> DataFrame:
    """One row: new, modified, deleted and unchanged notes, has_changes."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = d.agg(n("new").alias("new_notes"), n("modified").alias("modified_notes"), n("deleted").alias("deleted_notes"), n("unchanged").alias("unchanged_notes"))
    return out.withColumn("has_changes", F.col("new_notes") + F.col("modified_notes") + F.col("deleted_notes") > 0)


def next_state(current: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The state after a run: all current notes but those that failed, which are tried again."""
    rows = current.select("relative_path", "content_hash")
    return rows if failed is None else rows.join(failed.select("relative_path"), "relative_path", "left_anti")


def dead_notes(d: DataFrame, current: DataFrame) -> DataFrame:
    """note_ids whose chunks go: of deleted and modified notes, unless another live note has the same bytes."""
    gone = d.filter("status in ('deleted', 'modified')").select(F.col("old_hash").alias("note_id")).distinct()
    return gone.join(current.select(F.col("content_hash").alias("note_id")), "note_id", "left_anti")


_SMALL = 100_000  # notes that go to all tasks by their path; they are counted first


def single_notes(notes: DataFrame) -> DataFrame:
    """Of notes with the same bytes the last by path. Only paths and hashes move, and those left out go to all tasks
    where they are few; notes stay where they are."""
    last = W.partitionBy("content_hash").orderBy(F.desc("relative_path"))
    again = notes.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("content_hash")
    left_out = notes.select("content_hash", "relative_path").join(again, "content_hash", "left_semi").withColumn("_n", F.row_number().over(last)).filter("_n > 1").select("relative_path")
    few = left_out.limit(_SMALL + 1).count() <= _SMALL
    return notes.join(F.broadcast(left_out) if few else left_out, "relative_path", "left_anti")


def index_rows(notes: DataFrame, provider: EmbeddingProvider, settings: Settings, indexed_at: str, vectors: VectorStore | None = None) -> tuple[DataFrame, int | None]:
    """Rows of the index for notes, with ``error`` where a chunk's vector could not be had, and, with a store of
    vectors, how many texts were embedded: those that it lacks."""
    p = payloads(chunked(single_notes(notes), settings), notes, indexed_at)
    if vectors is None:
        p, made = p.withColumn("_e", embedded_or_failed(F.col("chunk_text"), provider, settings.embed_batch_size)).select(*PAYLOAD_COLUMNS, "_e.*"), None
    else:
        p, made = vectors.embedded(p, "chunk_text", provider, settings.embed_batch_size)
    return p.select(*PAYLOAD_COLUMNS, F.col("vector").alias("embedding"), "error"), made


def _good(rows: DataFrame) -> DataFrame:
    return rows.filter("error is null").drop("error")


def _errors(rows: DataFrame, most: int = 20) -> list[str]:
    """The commonest messages and how many chunks each cost; a report, so it is short."""
    found = rows.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(most)
    return [f"{r['error']} ({r['n']} chunks)" for r in found.collect()]


def ingest_full(notes: DataFrame, index: IndexTable, provider: EmbeddingProvider, settings: Settings | None = None, on_change: Callable[[], None] | None = None, vectors: VectorStore | None = None) -> IndexingStats:
    """Indexes all notes and deletes chunks that no note has any more. Without notes nothing is deleted. Batches that
    can't be embedded are told as errors; the rest is indexed."""
    s, stats, begun = settings or Settings(), IndexingStats(), time.monotonic()
    ship(notes.sparkSession)
    index.ensure()
    stats.total_notes = notes.count()
    if stats.total_notes:
        try:
            rows, made = index_rows(notes, provider, s, datetime.now(timezone.utc).isoformat(), vectors)
            rows = rows.persist()
            stats.total_chunks = rows.count()
            stats.errors += _errors(rows)
            old = stale_ids(index.read(), rows).persist()
            stats.deleted_stale_chunks = old.count()
            index.upsert(_good(rows))
            stats.indexed_chunks = _good(rows).count()
            stats.embedded_texts = stats.indexed_chunks if made is None else made
            index.delete_ids(old)
            rows.unpersist()
            old.unpersist()
            if on_change:
                on_change()
        except Exception as e:  # noqa: BLE001 - a failed run is reported, not raised
            log.warning("indexing failed: %s", e)
            stats.errors.append(str(e).splitlines()[0])
    stats.duration_ms = round((time.monotonic() - begun) * 1000, 1)
    return stats


def sync_incremental(notes: DataFrame, state: VersionedTable, index: IndexTable, provider: EmbeddingProvider, settings: Settings | None = None, on_change: Callable[[], None] | None = None, vectors: VectorStore | None = None) -> SyncStats:
    """Brings the index up to date with changed notes only. Without changes nothing is written; deletions come
    before new chunks; notes with a chunk that could not be embedded stay out of the state, so the next run takes
    them up again, and a run that fails as a whole is repeated. With a store of vectors only texts that it lacks are
    embedded: a copied or restored note costs none, an edited section its own."""
    s, stats, begun = settings or Settings(), SyncStats(), time.monotonic()
    ship(notes.sparkSession)
    index.ensure()
    d = diff(notes, state.read()).persist()
    counts = diff_counts(d).first()
    stats.new_notes, stats.modified_notes, stats.deleted_notes, stats.unchanged_notes = counts[:4]
    if stats.has_changes:
        try:
            index.delete_notes(dead_notes(d, notes))
            wanted = notes.join(d.filter("status in ('new', 'modified')").select("relative_path"), "relative_path", "left_semi")
            rows, made = index_rows(wanted, provider, s, datetime.now(timezone.utc).isoformat(), vectors)
            rows = rows.persist()
            stats.new_chunks = _good(rows).count()
            stats.embedded_texts = stats.new_chunks if made is None else made
            stats.errors += _errors(rows)
            index.upsert(_good(rows))
            failed = rows.filter("error is not null").select(F.col("note_id").alias("content_hash")).distinct()
            state.overwrite(next_state(notes, wanted.join(failed, "content_hash", "left_semi")))
            rows.unpersist()
            if on_change:
                on_change()
        except Exception as e:  # noqa: BLE001 - a failed run is reported, not raised
            log.warning("synchronisation failed: %s", e)
            stats.errors.append(str(e).splitlines()[0])
    d.unpersist()
    stats.duration_ms = round((time.monotonic() - begun) * 1000, 1)
    return stats


def record_run(spark: SparkSession, path: str, stats: IndexingStats | SyncStats) -> None:
    """Keeps the figures and status of the last run in a small file."""
    write_text(spark, path, json.dumps({**asdict(stats), "status": stats.status, "finished_at": datetime.now(timezone.utc).isoformat()}, sort_keys=True))


def last_run(spark: SparkSession, path: str) -> dict | None:
    """What ``record_run`` kept; None before the first run."""
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def run_periodically(run: Callable[[], object], minutes: float, stop: Callable[[], bool], sleep: Callable[[float], None] = time.sleep) -> None:
    """Sleeps first, then runs, again and again; failures of a run are logged. 0 minutes: off."""
    while minutes > 0 and not stop():
        sleep(60 * minutes)
        try:
            run()
        except Exception:  # noqa: BLE001
            log.exception("a scheduled run failed")
