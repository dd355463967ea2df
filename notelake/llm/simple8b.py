"""Token ids in files of Simple-8b words: 4 bits select how many ids of how many bits share a 64-bit word.

File: magic ``SMP8B001``; the words of all documents; an index; a trailer. Documents are coded one after the
other, in blocks of at most ``BLOCK`` ids that start on a word, so that any block can be decoded by itself. The
index has, per document, doc_id (long), number of ids, and number of blocks (its complement where doc_id is null), and,
per block, the offset of its first word. Selector 0 is the escape: the next word holds one id of 64 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder_of
from .common import lean, materialise, partitions, scratch_path
from .files import new_file, open_file
from .packing import with_end

MAGIC = b"SMP8B001"
BLOCK = 1024
#: Ids per word and bits per id of selectors 1 to 14, most ids first.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_PER_WORD = np.array([1, *COUNTS, 0], dtype=np.int64)
_FOOT = struct.Struct("<QQQ8s")


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    if len(x) and x.max() < 1 << 16:
        return _SHORT[x.astype(np.uint16)]
    need, rest = np.zeros(len(x), dtype=np.uint8), x.copy()
    for step in (48, 32, 16):
        big = rest >> np.uint64(step) > 0
        need[big] += step
        rest[big] >>= np.uint64(step)
    return need + _SHORT[rest.astype(np.uint16)]


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes runs of unsigned 64-bit ids, one after the other in ``values``.

    Returns the words, words per block, and blocks per run. A run of length 0 has no block.
    """
    values = values.astype(np.uint64)
    blocks = -(-lengths // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, dtype=np.int64)
    last = np.cumsum(blocks)[lengths > 0] - 1
    sizes[last] = ((lengths - 1) % BLOCK + 1)[lengths > 0]
    # Blocks lie 60 zeros apart, so that a word at the end of a block can be filled up with zeros.
    pad = COUNTS[0]
    starts = np.cumsum(sizes + pad) - sizes - pad
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))
    room = np.zeros(int((sizes + pad).sum()) + pad, dtype=np.uint64)
    room[place] = values
    need = _bit_lengths(room)
    selector = np.full(len(room), len(COUNTS), dtype=np.uint8)
    reach, most = 1, need  # most[i]: bits of the largest of the ``reach`` ids from i on; reach at most doubles
    for k in range(len(COUNTS) - 2, -1, -1):
        by = COUNTS[k] - reach
        wider = most.copy()
        np.maximum(most[:-by], most[by:], out=wider[:-by])
        reach, most = COUNTS[k], wider
        np.putmask(selector, most <= BITS[k], k + 1)
    selector[need > BITS[-1]] = 0
    # all blocks go on by a word at a time; their places ascend from block to block
    jump, lanes, here, ends = _PER_WORD.astype(np.uint8)[selector], np.arange(len(sizes)), starts, starts + sizes
    places, words_per_block = [], np.zeros(len(sizes), dtype=np.int64)
    while len(lanes):
        places.append(here)
        words_per_block[lanes] += 1
        here = here + jump[here]
        on = here < ends[lanes]
        if not on.all():
            lanes, here = lanes[on], here[on]
    at = np.sort(np.concatenate(places)) if places else np.empty(0, dtype=np.int64)
    chosen = selector[at] if len(at) else np.empty(0, dtype=np.uint8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k, (n, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            ids = room[at[mine][:, None] + np.arange(n)]
            words[mine] |= np.bitwise_or.reduce(ids << (np.arange(n, dtype=np.uint64) * np.uint64(bits)), axis=1)
    escaped = np.flatnonzero(chosen == 0)
    if len(escaped):
        words = np.insert(words, escaped + 1, room[at[escaped]])
        words_per_block += np.bincount(np.searchsorted(np.cumsum(words_per_block), escaped, side="right"), minlength=len(sizes))
    return words, words_per_block, blocks


def decode(words: np.ndarray, words_per_block: np.ndarray, ids_per_block: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, one after the other."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(chosen == 0).tolist():  # the word after an escape is an id, whatever its first bits
        if not raw[i]:
            raw[i + 1] = True
    if (chosen[~raw] == 15).any():
        raise ValueError("selector 15 has no meaning")
    per = np.where(raw, 0, _PER_WORD[chosen])
    ends = np.cumsum(per)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for k, (n, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        mine = np.flatnonzero((chosen == k) & ~raw)
        if len(mine):
            ids = words[mine][:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(bits))
            out[(ends[mine] - n)[:, None] + np.arange(n)] = ids & np.uint64((1 << bits) - 1)
    escaped = np.flatnonzero((chosen == 0) & ~raw)
    out[ends[escaped] - 1] = words[escaped + 1] if len(escaped) else 0
    # of each block, the filling at its end goes
    block_ends = ends[np.cumsum(words_per_block) - 1] if len(words_per_block) else np.empty(0, dtype=np.int64)
    filled = np.diff(np.r_[0, block_ends])
    if (filled < ids_per_block).any() or (filled - ids_per_block >= COUNTS[0]).any():
        raise ValueError("blocks don't have the ids that the index tells")
    keep = np.arange(len(out)) - np.repeat(block_ends - filled, filled) < np.repeat(ids_per_block, filled)
    return out[keep]


#: Files are at most as many, so that what the driver and the tasks hold of their bounds is at most 512 KB.
MOST_FILES = 1 << 15
_SLICE = 1 << 17  # ids coded at a time


_CELLS = 1 << 16  # cells of the first histogram of doc_id; later ones split at most ``MOST_FILES`` cells into 16 each
_NULL = -(1 << 63)  # where rows without doc_id lie


def file_bounds(docs: DataFrame, docs_per_file: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, first, files): ids up to an edge and past the one before lie in ``files`` files from ``first`` on.

    Edges come from a histogram of doc_id by its leading bits, counted in tasks: only counts of cells move, as many as the
    histogram has, however many rows there are. A cell that holds an edge and more than half a file is split by its next
    four bits, down to a single id. An id (or null) that holds as much as several files has as many for itself.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"))
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    wanted = max(1, min(MOST_FILES, -(-n // docs_per_file)))
    if wanted == 1:
        return np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)
    ranks, half = [-(-i * n // wanted) for i in range(1, wanted)], n // wanted // 2
    shift = 0
    while (high >> shift) - (low >> shift) >= _CELLS:
        shift += 1
    cells = _counted(ids, shift)  # (cell, shift, rows), ascending
    while True:
        sums = np.cumsum([c[2] for c in cells])
        at = np.searchsorted(sums, ranks)  # the cell in which a file ends
        crowded = {int(i) for i in np.unique(at) if cells[i][1] and cells[i][2] > half}
        if not crowded:
            break
        finer = max(0, shift - 4)
        parts = _counted(ids, finer, shift, [cells[i][0] for i in sorted(crowded)])
        cells = sorted([*(c for i, c in enumerate(cells) if i not in crowded), *parts], key=lambda c: c[0] << c[1])
        shift = finer
    edges, files = np.unique(np.array([((cells[i][0] + 1) << cells[i][1]) - 1 for i in at], dtype=np.int64), return_counts=True)
    before = np.setdiff1d(edges[(files > 1) & (edges > low)] - 1, edges)  # ids below one that is dealt keep their order
    order = np.argsort(np.r_[edges, before])
    edges, files = np.r_[edges, before][order], np.r_[files, np.ones(len(before), dtype=np.int64)][order]
    files = np.append(files, 1)  # past the last edge
    return edges, np.cumsum(files) - files, files


def _counted(ids: DataFrame, shift: int, above: int = 0, only: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Rows of each cell of ids that agree past ``shift`` bits; of those cells at ``above`` bits that are asked for."""
    if only is not None:
        wanted = ids.sparkSession.createDataFrame([(c,) for c in only], "cell long")  # at most ``MOST_FILES``
        ids = ids.withColumn("cell", F.shiftright("id", above)).join(F.broadcast(wanted), "cell", "left_semi")
    counts = ids.groupBy(F.shiftright("id", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((r["cell"], shift, r["n"]) for r in counts.collect())  # bounded by the number of cells


def token_payloads(docs: DataFrame, tokenizer: str, end_id: int, edges: np.ndarray, first: np.ndarray, files: np.ndarray) -> DataFrame:
    """(file, doc_id, n_tokens, crc, payload): the coded ids of each document with ``end_id`` after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dealt = encoder_of(tokenizer), 0
        for b in batches:
            at = 0
            for ids, lengths in encoder.encode(b.column(1)):
                all_ids, all_lengths = with_end(ids, lengths, end_id)
                ends = np.cumsum(all_lengths)
                for part in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(ends // _SLICE)) + 1):  # a processor's cache holds their arrays
                    low, high = int(ends[part[0]] - all_lengths[part[0]]), int(ends[part[-1]])
                    own, lengths = all_ids[low:high], all_lengths[part]
                    words, per_block, blocks = encode(own, lengths)
                    payload = _payloads(words, per_block, blocks)
                    raw, stops = memoryview(own.tobytes()), (np.cumsum(lengths) * 4).tolist()
                    crc = [zlib.crc32(raw[s:e]) for s, e in zip([0, *stops], stops, strict=False)]
                    rows = b.column(0).slice(at, len(part)).cast(pa.int64())
                    known = rows.fill_null(_NULL).to_numpy(zero_copy_only=False)
                    i = np.searchsorted(edges, known, side="left")
                    file = first[i] + (dealt + np.arange(len(part))) % files[i]
                    dealt += len(part)
                    at += len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(file.astype(np.int32)), rows, pa.array(lengths), pa.array(crc, type=pa.int64()), payload], ["file", "doc_id", "n_tokens", "crc", "payload"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "file int, doc_id long, n_tokens long, crc long, payload binary")


def _payloads(words: np.ndarray, per_block: np.ndarray, blocks: np.ndarray) -> pa.Array:
    """Of each document the words per block, then the words."""
    block_ends, word_ends = np.cumsum(blocks), np.r_[0, np.cumsum(per_block)][np.cumsum(blocks)]
    own = np.diff(np.r_[0, word_ends])
    ends = word_ends + block_ends
    out = np.empty(len(words) + len(per_block), dtype="<u8")
    out[np.arange(len(per_block)) + np.repeat(np.r_[0, word_ends[:-1]], blocks)] = per_block
    out[np.arange(len(words)) + np.repeat(block_ends, own)] = words
    return pa.BinaryArray.from_buffers(pa.binary(), len(blocks), [None, _offsets(ends * 8), pa.py_buffer(out)])


def _offsets(ends: np.ndarray) -> pa.Buffer:
    """Offsets of a binary column; OverflowError past 2 GB, which one document of 2^28 ids or more can reach."""
    if len(ends) and int(ends[-1]) >= 1 << 31:
        raise OverflowError(f"{int(ends[-1])} bytes of ids in one batch: a document is too long")
    return pa.py_buffer(np.r_[0, ends].astype(np.int32))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, docs_per_file: int = 16384) -> DataFrame:
    """Writes the ids of all documents in files and returns their manifest: (file, path, n_docs, n_ids), file
    ascending as the documents' ids do.

    Files take ranges of doc_id of about ``docs_per_file`` rows, of more past ``MOST_FILES`` files; a task writes one
    file. Inside, documents ascend by doc_id, null first, rows that repeat an id by length and checksum of their ids; an
    id with more rows than a file has is dealt to several files, its rows in any order. Only coded ids are shuffled, not
    texts. A null text is empty: its one id is ``end_id``. No documents give no files. Other columns are ignored.
    """
    edges, first, files = file_bounds(docs, docs_per_file)
    coded = token_payloads(docs, tokenizer, end_id, edges, first, files)
    ordered = coded.repartitionById(int(files.sum()), F.col("file")).sortWithinPartitions("file", "doc_id", "n_tokens", "crc")
    folder = scratch_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current, done = None, None, []
        for b in batches:
            for file, doc_id, n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if file != current:
                    if writer:
                        done.append((current, *writer.close()))
                    writer, current = _Writer(folder), file
                writer.add(doc_id, n, payload.as_buffer())
        if writer:
            done.append((current, *writer.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "path", "n_docs", "n_ids"])

    written = ordered.select("file", "doc_id", "n_tokens", "payload").mapInArrow(run, "file long, path string, n_docs long, n_ids long")
    return materialise(written, "token-manifest")


class _Writer:
    def __init__(self, folder: str):
        self.context = new_file(folder, ".smp8b")
        self.path, self.out = self.context.__enter__()
        self.out.write(MAGIC)
        self.docs: list[tuple[int, int, int]] = []
        self.offsets: list[np.ndarray] = []
        self.words, self.ids = 0, 0

    def add(self, doc_id: int | None, n: int, payload: pa.Buffer) -> None:
        blocks = -(-n // BLOCK)
        per_block = np.frombuffer(payload, dtype="<u8", count=blocks)
        self.out.write(payload.slice(8 * blocks))
        self.docs.append((0, n, ~blocks) if doc_id is None else (doc_id, n, blocks))
        ends = self.words + np.cumsum(per_block)
        self.offsets.append(ends - per_block)
        self.words, self.ids = int(ends[-1]), self.ids + n

    def close(self) -> tuple[str, int, int]:
        index = np.array(self.docs, dtype="<i8").tobytes() + np.concatenate(self.offsets).astype("<u8").tobytes()
        self.out.write(index)
        self.out.write(_FOOT.pack(self.words, len(self.docs), sum(len(x) for x in self.offsets), MAGIC))
        self.context.__exit__(None, None, None)
        return self.path, len(self.docs), self.ids


def read_file(uri: str, step: int = 256, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, which of them are null, lengths, all their ids) of a file, at most ``step`` documents and ``most`` ids at a
    time, or one document that has more; raises ValueError on damage."""
    with open_file(uri) as f:
        size = f.size()
        if size < len(MAGIC) + _FOOT.size or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no file of this format")
        words, n, n_blocks, magic = _FOOT.unpack(f.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC or size != 8 + 8 * words + 24 * n + 8 * n_blocks + _FOOT.size:
            raise ValueError(f"{uri} is cut short")
        docs = np.frombuffer(f.read_at(24 * n, 8 + 8 * words), dtype="<i8").reshape(-1, 3).copy()
        null = docs[:, 2] < 0
        docs[null, 2] = ~docs[null, 2]
        offsets = np.frombuffer(f.read_at(8 * n_blocks, 8 + 8 * words + 24 * n), dtype="<u8").astype(np.int64)
        offsets = np.append(offsets, words)
        first = np.cumsum(np.r_[0, docs[:, 2]])
        ends, i = np.cumsum(docs[:, 1]), 0
        while i < n:
            fit = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right"))
            rows = docs[i : min(i + step, max(fit, i + 1))]
            a, b = first[i], first[i + len(rows)]
            data = np.frombuffer(f.read_at(8 * int(offsets[b] - offsets[a]), 8 + 8 * int(offsets[a])), dtype="<u8")
            sizes = np.full(b - a, BLOCK, dtype=np.int64)
            sizes[np.cumsum(rows[:, 2]) - 1] = (rows[:, 1] - 1) % BLOCK + 1
            yield rows[:, 0], null[i : i + len(rows)], rows[:, 1], decode(data, np.diff(offsets[a : b + 1]), sizes)
            i += len(rows)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary of unsigned 32-bit little-endian ids)
    of all documents of the files.

    The starts of files are a prefix sum over the manifest, one row per file; they go to the tasks that read.
    """
    before = F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", "path", F.coalesce(before, F.lit(0)).cast("long").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for doc_ids, null, lengths, ids in read_file(uri):
                    ends = np.cumsum(lengths)
                    raw = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, _offsets(ends * 4), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=null), pa.array(at + ends - lengths), pa.array(lengths), raw], ["doc_id", "start", "n_tokens", "ids"])
                    at += int(ends[-1])

    n = max(1, min(partitions(files.sparkSession) * 4, 10_000))
    dealt = files.repartitionById(n, F.pmod(F.col("file"), F.lit(n)).cast("int"))
    return dealt.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")
