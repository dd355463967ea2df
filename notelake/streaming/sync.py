"""Synchronisation as a stream: each batch of changed files updates the index."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans.ingest import index_rows
from ..session import ship
from ..sources.index import IndexTable
from ..sources.notes import listing, parsed
from ..sources.providers import EmbeddingProvider
from ..sources.storage import VersionedTable
from ..sources.vectors import VectorStore

#: Notes that wait for their chunks to be embedded, how often that was tried, and the batch that tries again.
LETTERS = "relative_path string, content binary, file_size_bytes long, modified_at timestamp, attempts int, error string, next_batch long"


def sync_stream(files: DataFrame, root: str, index: IndexTable, provider: EmbeddingProvider, checkpoint: str, settings: Settings | None = None, on_change: Callable[[], None] | None = None, vectors: VectorStore | None = None, letters: VersionedTable | None = None, attempts: int = 5) -> StreamingQuery:
    """Indexes the notes among files below ``root`` (as of a binaryFile stream: path, content, length,
    modificationTime) as they come: paths are relative to it and hidden files and other extensions left out, as in a scan.

    A batch that is run again writes the same chunk ids, so the index is the same. With ``letters`` (``LETTERS``), notes
    with a chunk that can't be embedded are kept there and the stream goes on; each later batch takes up those that are
    due, after twice as many batches each time, until ``attempts`` are made; what is left then stays for people to see.
    Without it such a batch fails, so that it is run again. Deleted files are left to ``sync_incremental``, as file
    streams don't tell them.
    """
    ship(files.sparkSession)
    index.ensure()
    s = settings or Settings()
    plain = lambda p: F.regexp_replace(p, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")  # noqa: E731 - without scheme and empty authority
    relative = F.expr("substring(_path, length(_root) + 2)")
    named = files.withColumn("_path", plain(F.col("path"))).withColumn("_root", plain(F.lit(root.rstrip("/"))))
    named = named.select(relative.alias("relative_path"), "content", F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"))
    columns = ["relative_path", "content", "file_size_bytes", "modified_at"]

    def write(batch: DataFrame, batch_id: int) -> None:
        found = listing(batch).filter("status = 'note'").select(*columns, F.lit(0).alias("attempts"))
        if letters is not None:
            kept = letters.read()
            due = kept.filter((F.col("next_batch") <= batch_id) & (F.col("attempts") < attempts)).join(found.select("relative_path"), "relative_path", "left_anti")
            found = found.unionByName(due.select(*found.columns))
        rows, _ = index_rows(parsed(found.select(*columns)), provider, s, datetime.now(timezone.utc).isoformat(), vectors)
        rows = rows.persist()
        try:
            failed = rows.filter("error is not null").groupBy(F.col("note_id").alias("_hash")).agg(F.min("error").alias("error"))
            if letters is None:
                first = failed.first()
                if first:
                    raise RuntimeError(first["error"])
            index.upsert(rows.filter("error is null").drop("error"))
            if letters is not None:
                tried = found.withColumn("_hash", F.sha2("content", 256)).join(failed, "_hash").drop("_hash")
                tried = tried.withColumn("attempts", F.col("attempts") + 1).withColumn("next_batch", batch_id + F.pow(F.lit(2), F.col("attempts") - 1).cast("long"))
                left = kept.join(found.select("relative_path"), "relative_path", "left_anti").unionByName(tried.select(*kept.columns))
                if not (kept.isEmpty() and tried.isEmpty()):
                    letters.overwrite(left)
        finally:
            rows.unpersist()
        if on_change:
            on_change()

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
