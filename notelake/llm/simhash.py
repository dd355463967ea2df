"""SimHash fingerprints and near-duplicate components by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import neardup
from .bits import planes, within
from .common import Scratch, bounded_broadcast, lean, materialise, own_columns, partitions
from .components import components

#: Rows compared with one another at once, unless one group alone is larger.
_BLOCK = 1024
#: Query rows compared with a block in one step.
_STEP = 64


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z lower-cased; 0 without words.

    A bit is set if it is set in over half of the shingles' XXH64 (seed 42), repeats included; with fewer words
    than ``width`` the whole sequence is the shingle.
    """
    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - width + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[width - 1 :] or [ends[-1]]
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(64, dtype=np.int64), 1 << 16
    for i in range(0, n, step):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + step], stops[i : i + step], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


class _Roots:
    """Union-find over positions; labels are kept in one array so that sets of rows join in vector steps."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[x] = r
                return r
            r = s

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.find(members))
        self.up[roots] = roots[0]


def links(fps: np.ndarray, side: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest (k, 2) of the links among distinct fingerprints; with ``side``, of those between the
    rows where it is 0 and those where it is 1, which may be all."""
    n = len(fps)
    if n < 2:
        return np.empty((0, 2), dtype=fps.dtype)
    sliced = planes(fps)
    mean = np.unpackbits(sliced.view(np.uint8), axis=1).mean(axis=1) * (sliced.shape[1] * 64 / n)
    order = np.argsort(np.abs(mean - 0.5), kind="stable")  # planes that tell most rows apart come first
    asked = np.arange(n) if side is None else np.flatnonzero(side == 0)
    roots = _Roots(n)
    for i in range(0, len(asked), _STEP):
        rows = asked[i : i + _STEP]
        at = 0 if side is not None else i >> 6  # links to earlier rows have been found from there
        near = within(fps[rows], sliced[:, at:], radius, order, rows - 64 * at)
        if not near.any():
            continue
        hits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : n - 64 * at]
        for q in np.flatnonzero(hits.any(axis=1)):
            roots.join(np.append(np.flatnonzero(hits[q]) + 64 * at, rows[q]))
    root = roots.find(np.arange(n))
    moved = np.flatnonzero(root != np.arange(n))
    return np.stack([fps[moved], fps[root[moved]]], axis=1)


def block_count(distinct: int, radius: int) -> int:
    """Blocks to cut 64 bits into: of b blocks at most ``radius`` differ, so b - radius agree in some choice.
    The least b for which a choice leaves about four fingerprints to a bucket."""
    for b in range(radius + 1, 4 * radius + 8):
        if distinct / 2.0 ** (64 * (b - radius) / b) <= 4:
            return b
    return 4 * radius + 8


def masks(blocks: int, radius: int) -> list[int]:
    """One mask of 64 bits for each choice of ``blocks - radius`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_forest(distinct: DataFrame, rows: int, radius: int = 3, shard: int = 32768) -> DataFrame:
    """(a, b): links between fingerprints (column fp, distinct) at most ``radius`` bits apart; every pair of linked
    fingerprints is connected through them, though not every pair is emitted.

    Fingerprints that agree on a choice of blocks meet in one bucket. Buckets of more than ``shard`` rows are cut
    into shards, and each pair of shards is a task of its own. Of hot buckets there are at most
    ``tables * rows / shard``, so the table of them stays a small fraction of the input and joins as Catalyst sees fit.
    """
    spark = distinct.sparkSession
    chosen = masks(block_count(rows, radius), radius)
    entry = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(chosen)]))
    entries = distinct.select("fp", entry.alias("e")).select("fp", "e.t", "e.k")
    hot = entries.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    hot = materialise(hot.select("t", "k", F.ceil(F.col("n") / shard).cast("int").alias("shards")), "simhash-hot")
    if hot.isEmpty():
        pieces = entries.select("fp", "t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    else:
        cut = entries.join(hot, ["t", "k"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        cut = cut.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        pieces = cut.select("fp", "t", "k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") > F.col("o")).cast("int").alias("side"))
    keys = ["t", "k", "i", "j"]
    pieces = pieces.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]
        held: list[np.ndarray] = []  # columns fp, group mark, side of rows whose group may go on

        def compare(fp: np.ndarray, mark: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
            """Whole groups: small ones share a block, as every link found is a link, whichever group it is in."""
            starts = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
            sizes = np.diff(np.r_[starts, len(fp)])
            found, pending, n = [], [], 0
            for a, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                if size > _BLOCK:
                    own = side[a : a + size]
                    found.append(links(fp[a : a + size], own if own.any() else None, radius))
                    continue
                if n + size > _BLOCK:
                    found.append(links(np.unique(np.concatenate(pending)), None, radius))
                    pending, n = [], 0
                pending.append(fp[a : a + size])
                n += size
            if pending:
                found.append(links(np.unique(np.concatenate(pending)), None, radius))
            pairs = np.concatenate(found) if found else np.empty((0, 2), dtype=np.uint64)
            pairs = pairs.astype(np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

        for b in batches:
            col = {x: b.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(b.schema.names)}
            mark = np.stack([col["t"].astype(np.int64), col["k"], col["i"].astype(np.int64), col["j"].astype(np.int64)], axis=1)
            rows_ = [col["fp"].view(np.uint64), mark, col["side"]]
            if held:
                rows_ = [np.concatenate(x) for x in zip(held, rows_, strict=True)]
            last = np.flatnonzero((rows_[1] != rows_[1][-1]).any(axis=1))
            cut_ = last[-1] + 1 if len(last) else 0
            if cut_:
                done = [x[:cut_] for x in rows_]
                yield compare(done[0], _mark_ids(done[1]), done[2])
            held = [x[cut_:] for x in rows_]
        if held:
            yield compare(held[0], _mark_ids(held[1]), held[2])

    return pieces.select("fp", "t", "k", "i", "j", "side").mapInArrow(run, "a long, b long")


def _mark_ids(mark: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, (mark[1:] != mark[:-1]).any(axis=1)])


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id: documents are linked if their fingerprints differ in at most ``radius`` bits;
    component_id is the least doc_id that a document reaches over links, itself included.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows that repeat a doc_id each get a
    row; null ids get the component of their fingerprint (null if no member has an id). An empty table gives no
    rows; other columns are ignored. Whole texts count, however long.
    """
    own = materialise(fingerprints(docs, width), "simhash-fp")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    n = distinct.count()
    rooted = components(link_forest(distinct.select("fp"), n, radius))
    known = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = known.select("fp", "root").join(least, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_groups(rows: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """(fp, c): rows (fp, sim) whose SimHash fingerprints ``sim`` are linked, over links of at most ``radius`` differing
    bits, to other rows, and the least fp of their group. Fingerprints meet in buckets of agreeing blocks."""
    sims = scratch.keep(rows.groupBy("sim").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("rows")), "near-sims")
    rooted = components(link_forest(sims.select(F.col("sim").alias("fp")), sims.count(), radius)).withColumnRenamed("node", "sim")
    known = sims.join(rooted, "sim", "left").withColumn("root", F.coalesce("root", "sim"))
    least = known.groupBy("root").agg(F.min("first").alias("c"), F.sum("rows").alias("rows")).filter("rows > 1").select("root", "c")
    return rows.join(known.select("sim", "root").join(least, "root"), "sim").select("fp", "c")


def near_deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component of near copies stays, with all its columns: the one with the least doc_id (null
    last), of those with the least XXH64 of its words, then of the whole row. Rows that repeat a doc_id with texts of
    different components stay in each.

    Near copies share at least ``similarity`` (Jaccard) of their shingles of ``width`` words. SimHash fingerprints of 64
    bits link rows first, by buckets of agreeing blocks as in ``simhash_components``, and an exact comparison checks each
    with its group's centre; pairs beyond that radius are found as ``neardup`` tells. Null and
    blank texts, which have no shingle, are copies of one another; texts of fewer words than ``width`` are one shingle.
    Whole texts count, however long. An empty table stays empty. Columns may have any name.
    """
    scratch = Scratch()
    rows = scratch.keep(neardup.signed_rows(docs, width).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    groups = scratch.keep(fingerprint_groups(rows.filter("n > 0").select("fp", "sim").distinct(), scratch), "near-groups")
    roots = scratch.keep(neardup.near_roots(rows, groups, width, similarity, scratch), "near-roots")
    own = rows.select("doc_id", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = scratch.keep(own, "near-own")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp"))
    best = materialise(own.groupBy("root").agg(first.alias("w")).select("root", F.col("w.doc_id").alias("best_id"), F.col("w.fp").alias("best_fp")), "near-best")
    repeated = materialise(own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd")), "near-repeated")
    gone = own.join(best, "root").filter("doc_id <> best_id or fp <> best_fp").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialise(gone, "near-gone")
    scratch.drop()
    whole = docs.select(F.struct(*own_columns(docs)).alias("whole"), F.col("doc_id").cast("long").alias("id"))
    once = whole.join(bounded_broadcast(gone, gone.count(), 16), F.col("id") == F.col("gone"), "left_anti")
    if repeated.isEmpty():
        return once.select("whole.*")
    same_id = F.col("id").eqNullSafe(F.col("odd"))
    once = once.join(repeated, same_id, "left_anti")
    many = word_digest_column(whole.join(repeated, same_id, "left_semi").withColumn("text", F.col("whole.text")), "text")
    many = many.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("fp") == F.col("best_fp")), "left_semi")
    order = W.partitionBy("id", "fp").orderBy(F.xxhash64("text"), F.xxhash64(F.to_json("whole")))
    return once.select("whole.*").unionByName(many.withColumn("n", F.row_number().over(order)).filter("n = 1").select("whole.*"))


def word_digest_column(docs: DataFrame, text: str) -> DataFrame:
    """The rows with the XXH64 of their words as column ``fp``."""

    @F.pandas_udf("long")
    def fp(texts):
        import pandas as pd

        values = [xxhash.xxh64_intdigest(b" ".join(neardup.words_of(None if x is None else bytes(x))), 42) for x in texts]
        return pd.Series(np.array(values, dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text).cast("binary")))
