"""The index of chunks: schema, upserts, deletes, patches, scans."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SearchFilter
from ..operators.vector import filtered
from .storage import BucketedTable

PAYLOAD = "chunk_id string, note_id string, note_title string, note_path string, tags array<string>, heading_path array<string>, chunk_index int, total_chunks int, word_count int, chunk_text string, indexed_at string, note_modified_at string"
SCHEMA = PAYLOAD + ", embedding array<float>"
PAYLOAD_COLUMNS = tuple(c.split()[0] for c in PAYLOAD.split(", "))


def upserted(index: DataFrame, new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Rows of the index that ``new`` doesn't replace, and ``new``; of its rows with one key the last by the column
    ``order``. Without one, the order is that of all their values: a table has none of its own once it is shuffled, but
    every run keeps the same row."""
    new = last_of_each(new, key, order)
    return index.join(new.select(key), key, "left_anti").unionByName(new.select(*index.columns))


def last_of_each(new: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """Of rows with one key the last, as ``upserted`` tells."""
    last = [F.desc(order)] if order else []
    last += [F.desc(F.xxhash64(*new.columns))]
    return new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*last))).filter("_n = 1").drop("_n")


def without_ids(index: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(ids.select(key).distinct(), key, "left_anti")


def without_notes(index: DataFrame, note_ids: DataFrame) -> DataFrame:
    return index.join(note_ids.select("note_id").distinct(), "note_id", "left_anti")


def patched(index: DataFrame, updates: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """Overwrites the listed columns of the rows that ``updates`` has, also by null; nothing else changes."""
    u = updates.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = index.join(u, F.col(key) == F.col("_key"), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in index.columns])


def stale_ids(index: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys of the index that ``new`` lacks."""
    return index.select(key).distinct().join(new.select(key), key, "left_anti")


def info(index: DataFrame, name: str, embedding: str = "embedding", distance: str = "cosine") -> DataFrame:
    """One row: name, vector_count, vector_size, distance, status."""
    return index.agg(F.count(F.lit(1)).alias("vector_count"), F.coalesce(F.max(F.size(embedding)), F.lit(0)).alias("vector_size")).select(F.lit(name).alias("name"), "vector_count", "vector_size", F.lit(distance).alias("distance"), F.when(F.col("vector_count") > 0, "ready").otherwise("empty").alias("status"))


class IndexTable(ABC):
    """What retrieval and ingestion ask of an index."""

    @abstractmethod
    def ensure(self) -> None: ...

    @abstractmethod
    def drop(self) -> None: ...

    @abstractmethod
    def read(self) -> DataFrame: ...

    @abstractmethod
    def upsert(self, rows: DataFrame, order: str | None = None) -> None: ...

    @abstractmethod
    def matching(self, filters: SearchFilter) -> DataFrame: ...

    @abstractmethod
    def delete_ids(self, ids: DataFrame) -> None: ...

    @abstractmethod
    def delete_notes(self, note_ids: DataFrame) -> None: ...

    @abstractmethod
    def patch(self, updates: DataFrame, columns: list[str]) -> None: ...

    @abstractmethod
    def snapshot(self) -> dict: ...

    @abstractmethod
    def since(self, old: dict | None, new: dict) -> tuple[DataFrame, Column]: ...

    @abstractmethod
    def ids(self) -> DataFrame: ...

    @abstractmethod
    def payloads(self) -> DataFrame: ...

    @abstractmethod
    def count(self) -> int: ...

    @abstractmethod
    def info(self) -> DataFrame: ...

    @abstractmethod
    def healthy(self) -> bool: ...


class ParquetIndex(IndexTable):
    """An index in buckets of Parquet by the hash of note_id: a change of some notes writes their buckets only, a search
    with filters reads the buckets that hold their values. Empty changes write nothing."""

    def __init__(self, spark: SparkSession, path: str, name: str = "chunks", buckets: int = 256, most: int = 100_000):
        self.table, self.name = BucketedTable(spark, path, SCHEMA, "note_id", buckets, most=most, indexed=("tags", "note_path", "note_title")), name

    def ensure(self) -> None:
        self.table.ensure()

    def drop(self) -> None:
        self.table.drop()

    def read(self) -> DataFrame:
        return self.table.read()

    @property
    def version(self) -> str | None:
        return self.table.version

    def snapshot(self) -> dict:
        """What the index is made of just now."""
        state = self.table.log.read()[1] or {}
        return {k: state.get(k) for k in ("version", "count", "buckets")}

    def since(self, old: dict | None, new: dict) -> tuple[DataFrame, Column]:
        """The rows that snapshot ``new`` has in buckets that it doesn't share with ``old``, and the condition on note_id
        that a row is of one of them."""
        if not old or not new["buckets"] or old["count"] != new["count"]:
            return self.table.at(new), F.lit(True)
        changed = [int(k) for k in {*old["buckets"], *new["buckets"]} if old["buckets"].get(k) != new["buckets"].get(k)]
        return self.table.at(new, set(changed)), self.table.bucket(new["count"]).isin(*changed)

    def _notes_of(self, ids: DataFrame) -> DataFrame:
        """note_ids of the chunks with some ids; two columns are read."""
        return self.read().select("chunk_id", "note_id").join(ids.select("chunk_id"), "chunk_id", "left_semi").select("note_id")

    def matching(self, filters: SearchFilter) -> DataFrame:
        """The rows that a filter lets through; buckets without its values aren't opened."""
        asked = {"tags": list(filters.tags), **{c: [v] for c, v in (("note_id", filters.note_id), ("note_path", filters.note_path), ("note_title", filters.note_title)) if v}}
        sets = [self.table.holding(c, vs) for c, vs in asked.items() if vs]
        return filtered(self.table.read(set.intersection(*sets)) if sets else self.read(), filters)

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Of rows with one chunk_id the last by ``order`` (a column beside the index's own) is kept."""
        known = rows.select("note_id").unionByName(self._notes_of(rows))
        counts = rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
        if counts.filter("_n > 1").isEmpty():  # then no row replaces another one, and texts needn't be sorted
            self.table.change(known, lambda own: without_ids(own, rows).unionByName(rows.select(*own.columns)))
        else:
            self.table.change(known, lambda own: upserted(own, rows, order=order))

    def delete_ids(self, ids: DataFrame) -> None:
        self.table.change(self._notes_of(ids), lambda own: without_ids(own, ids))

    def delete_notes(self, note_ids: DataFrame) -> None:
        known = self.read().select("note_id").join(note_ids.select("note_id"), "note_id", "left_semi")
        self.table.change(known, lambda own: without_notes(own, note_ids))

    def patch(self, updates: DataFrame, columns: list[str]) -> None:
        self.table.change(self._notes_of(updates), lambda own: patched(own, updates, columns))

    def ids(self) -> DataFrame:
        return self.read().select("chunk_id").distinct()

    def payloads(self) -> DataFrame:
        return self.read().select(*PAYLOAD_COLUMNS).filter("chunk_id is not null")

    def count(self) -> int:
        return self.read().count()

    def info(self) -> DataFrame:
        return info(self.read(), self.name)

    def healthy(self) -> bool:
        try:
            self.table.version  # noqa: B018
            return True
        except Exception:  # noqa: BLE001 - any failure of the store means it isn't healthy
            return False
