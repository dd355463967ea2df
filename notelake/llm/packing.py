"""Packing token pieces into sequences: first-fit decreasing with a tournament tree, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder_of
from .common import lean, materialise


class CapacityTree:
    """A tournament tree over bins: each inner node has the largest free room below it, so the first bin with
    room for a piece is found, and updated, in a number of steps that is the tree's depth."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, room it had): takes ``length`` of the first bin with that much room."""
        room, i = self.room, 1
        if room[1] < length:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        had = room[i]
        room[i] = had - length
        at = i
        while i > 1:
            i >>= 1
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return at - self.leaves, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; longest first, ties in the order given."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = 2 * sum(lengths) // capacity + 2  # of first-fit bins, at most one is half empty
    tree = CapacityTree(bins, capacity)
    out = [(0, 0)] * len(lengths)
    for i in order:
        b, had = tree.place(lengths[i])
        out[i] = (b, capacity - had)
    return out


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids, one after the other, with ``end_id`` after each; and their lengths with it."""
    out = np.full(len(ids) + len(lengths), end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, cache_bytes: int = 64 << 20) -> DataFrame:
    """(row_id, doc_id, start, length, doc_tokens, ids): each document's ids and ``end_id``, cut after every
    ``capacity`` ids; ids are unsigned 32-bit little-endian. A null text is empty. row_id tells rows of one
    doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = encoder_of(tokenizer, cache_bytes), ["row_id", "doc_id", "start", "length", "doc_tokens", "ids"]
        for b in batches:
            at = 0
            for ids, lengths in encoder.encode(b.column(2)):
                ids, lengths = with_end(ids, lengths, end_id)
                pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, lengths[row] - start)
                rows = pa.array(row + at)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.r_[0, np.cumsum(length)] * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(start), pa.array(length), pa.array(lengths[row]), data], names)
                at += len(lengths)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), "row_id long, doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(pieces: DataFrame, documents: int, capacity: int = 1024, docs_per_group: int = 8192, seed: int = 42) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` ids (row_id, doc_id, start, length, others kept).

    A piece of ``capacity`` ids is a sequence by itself and is not shuffled. The others meet in groups of about
    ``docs_per_group`` documents by a hash of document and row, and each group is packed by itself, so no task
    holds more than a group's last pieces. Sequence ids: bin * groups + group, or negative for full pieces.
    ``pieces`` is read twice: pass a written table.
    """
    groups = max(1, -(-documents // docs_per_group))
    own = pieces.filter(F.col("length") == capacity)
    own = own.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity)
    rest = rest.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row_id"), F.lit(groups)))
    schema = own.schema

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("row_id", "ascending"), ("start", "ascending")]).to_numpy()
        placed = first_fit_decreasing(table["length"].to_numpy()[order].tolist(), capacity)
        where = np.empty((len(order), 2), dtype=np.int64)  # the rows, with their ids, stay in the order they came in
        where[order] = placed
        ids, offsets = where[:, 0] * groups + key[0].as_py(), where[:, 1]
        table = table.drop_columns(["_group"])
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    packed = rest.groupBy("_group").applyInArrow(run, schema)
    return own.unionByName(packed)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, docs_per_group: int = 8192, cache_bytes: int = 64 << 20) -> DataFrame:
    """Sequences of whole documents: row_id, doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    Every row of ``docs`` is a document, also if it repeats a doc_id or text, or has a null doc_id; a null or
    empty text is the end id alone; an empty table packs to nothing; other columns are ignored. Texts of any
    length are cut into pieces, each id in exactly one. ``cache_bytes``, of a worker process, bears on speed and memory only.
    """
    pieces = materialise(token_pieces(docs, tokenizer, end_id, capacity, cache_bytes), "pack-pieces", dictionary=False)
    return pack(pieces, pieces.filter("start = 0").count(), capacity, docs_per_group)
