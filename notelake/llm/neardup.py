"""Near copies by word shingles: SimHash groups (``simhash.fingerprint_groups``) come first; of what they leave apart
MinHash bands deal rows into buckets, wide SimHash fingerprints compared in bit slices find candidates inside them. An
exact comparison of shingle sets decides on all."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import planes, within
from .common import Scratch, bounded_broadcast, lean, partitions
from .components import components

#: Bands of as many minima each: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^24 = 7e-5.
BANDS, ROWS = 24, 5
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
#: Shingles whose hashes are multiplied at once.
_STEP = 1024
#: 64-bit words of a SimHash fingerprint of a set of shingles.
WORDS = 48
_SPREAD = np.random.default_rng(43).integers(0, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
#: Standard deviations that the bits of a pair at the least similarity may differ more than expected: a loss of 3e-5.
_SLACK = 4.0
#: Rows of a bucket that one task compares with as many.
SHARD = 4096


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, as in ``simhash.fingerprint``."""
    return (text or b"").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct XXH64 of the word shingles, ascending; with fewer words than ``width`` the whole sequence is one."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - width + 1)
    starts, stops = [0, *(e + 1 for e in ends[: n - 1])], ends[width - 1 :] or [ends[-1]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit hash for each band of minima; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    mixed = hashes ^ (hashes >> _U(32))
    for i in range(0, len(mixed), _STEP):
        np.minimum(least, (_MULTIPLIERS[:, None] * mixed[None, i : i + _STEP]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, ascending each."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def narrow(hashes: np.ndarray) -> int:
    """SimHash of 64 bits of a set of shingles: a bit is set if it is set in over half of their hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text as binary, fp: XXH64 of the words, n: distinct shingles, sim: their SimHash, bands) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, sims, found = [], [], [], []
            for x in b.column(1):
                ws = words_of(x.as_py())
                h = shingles(ws, width)
                fps.append(xxhash.xxh64_intdigest(b" ".join(ws), 42))
                sizes.append(len(h))
                sims.append(narrow(h))
                found.append(bands(h))
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, sims)]
            cols = [b.column(0), b.column(1), signed[0], pa.array(sizes, pa.int32()), signed[1], pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "fp", "n", "sim", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text binary, fp long, n int, sim long, bands array<long>")


def alike(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose shingle sets have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # sets of ``a``, which often recurs
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, key in enumerate(a):
                if key not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[key] = shingles(words_of(batch.column(2)[i].as_py()), width)
                good.append(similarity(held[key], shingles(words_of(batch.column(3)[i].as_py()), width)) >= least)
            kept = [i for i, g in enumerate(good) if g]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], ["a", "b"])

    one = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def sketch(hashes: np.ndarray) -> bytes:
    """SimHash of a set of shingles: of each of ``64 * WORDS`` bits derived from a shingle's hash, whether it is set in
    over half of them."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(hashes), _STEP):
        x = hashes[i : i + _STEP, None] * _SPREAD
        x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(29)
        counts += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _flip(common: int, only_a: int, only_b: int) -> float:
    """Probability that a SimHash bit differs between two sets that have so many shingles in common and alone."""

    def sums(n: int) -> np.ndarray:
        """Distribution of a sum of n signs, from -n up in steps of two."""
        return np.array([math.comb(n, i) for i in range(n + 1)], dtype=float) / 2.0**n

    def above(p: np.ndarray, x: int) -> float:
        n = len(p) - 1
        return float(p[max(0, (n - x) // 2 + 1) :].sum())  # x + sum > 0

    pa_, pb = sums(only_a), sums(only_b)
    out = 0.0
    for i, w in enumerate(sums(common)):
        x = 2 * i - common
        a, b = above(pa_, x), above(pb, x)
        out += w * (a * (1 - b) + b * (1 - a))
    return out


@lru_cache(maxsize=8)
def radii(least: float, most: int = 96) -> np.ndarray:
    """For pairs whose larger set has 0, 1, ... shingles, how many of the bits of two sketches may differ before the
    similarity is surely, but for ``_SLACK``, below ``least``; sets of ``most`` and more take the last, as bits differ
    the less often the larger the sets."""
    bits, out = 64 * WORDS, [0]
    for b in range(1, most + 1):
        p = 0.0
        for a in range(math.ceil(least * b), b + 1):
            common = math.ceil(least * (a + b) / (1 + least) - 1e-9)
            if common <= a:
                p = max(p, _flip(common, a - common, b - common))
        out.append(math.ceil(bits * p + _SLACK * math.sqrt(bits * p * (1 - p))))
    return np.maximum.accumulate(np.array(out)[::-1])[::-1]


def _fitting(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose numbers of shingles allow the similarity."""
    return pairs.filter(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= least).select("a", "b").distinct()


def _sketched(texts: DataFrame, width: int) -> DataFrame:
    """(fp, n, sketch, bands) of texts (fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(words_of(x.as_py()), width) for x in b.column(1)]
            cols = [b.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([sketch(h) for h in sets], pa.binary()), pa.array([bands(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["fp", "n", "sketch", "bands"])

    return texts.mapInArrow(lean(run), "fp long, n int, sketch binary, bands array<long>")


def candidates(members: DataFrame, sketches: DataFrame, least: float, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """(a, b): pairs of one bucket and different components whose sketches allow the similarity, each once.

    ``members``: (k, fp, root). A bucket of more than ``shard`` rows is cut into shards, each pair of which is compared
    by itself. No pair is a row before the comparison has let it through: all distances of a piece are counted at once in
    bit slices. Of several buckets that a pair shares the one of the first band gives it.
    """
    sizes = members.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > shard)
    hot = scratch.keep(sizes.select("k", F.ceil(F.col("rows") / shard).cast("int").alias("shards")), "near-hot")
    cut = members.join(bounded_broadcast(hot, hot.count(), 16), "k", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    cut = cut.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    cut = cut.select("k", "fp", "root", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), (F.col("s") > F.col("o")).cast("int").alias("side"))
    keys, table = ["k", "i", "j"], radii(least)
    rows = cut.join(sketches, "fp").select("k", "i", "j", "side", "fp", "root", "n", "sketch", "bands")
    rows = rows.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)

    def compared(key: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        fp, root, n = (t[c].to_numpy() for c in ("fp", "root", "n"))
        side, band = t["side"].to_numpy(), np.stack(t["bands"].to_numpy())
        own = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype="<u8").reshape(len(fp), WORDS)
        split, small = side.any(), len(fp) <= 64  # fewer rows than a word has lanes: slices gain nothing
        sliced = None if small else planes(own)
        first = np.flatnonzero(band[0] == key)[0]  # the bucket's band
        radius = int(table[np.minimum(n, len(table) - 1)].max())
        asked = np.flatnonzero(side == 0) if split else np.arange(len(fp))
        for i in range(0, len(asked), 256):
            q = asked[i : i + 256]
            if small:
                a, b = np.repeat(q, len(fp)), np.tile(np.arange(len(fp)), len(q))
            else:
                near = within(own[q], sliced, radius, np.arange(64 * WORDS), q)
                hit, b = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(fp)])
                a = q[hit]
            ok = (root[a] != root[b]) & ((side[b] == 1) if split else (fp[a] < fp[b]))
            a, b = a[ok], b[ok]
            most, fewest = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
            apart = np.bitwise_count(own[a] ^ own[b]).sum(axis=1, dtype=np.int64)
            ok = (apart <= table[np.minimum(most, len(table) - 1)]) & (fewest >= least * most) & ~(band[a, :first] == band[b, :first]).any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[a[ok]], fp[b[ok]])), pa.array(np.maximum(fp[a[ok]], fp[b[ok]]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            k, i, j = (t[c].to_numpy() for c in keys)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), len(k)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if held and any(held[0][c][0].as_py() != t[c][x].as_py() for c in keys):
                    yield from compared(held[0]["k"][0].as_py(), pa.concat_tables(held).combine_chunks())
                    held = []
                held.append(t.slice(x, y - x))
        if held:
            yield from compared(held[0]["k"][0].as_py(), pa.concat_tables(held).combine_chunks())

    return rows.mapInArrow(lean(run), "a long, b long")


def near_roots(rows: DataFrame, groups: DataFrame, width: int, least: float, scratch: Scratch) -> DataFrame:
    """(fp, root) of the fingerprints that are linked, over links of ``least`` similarity or more, to others.

    ``rows``: as ``signed_rows`` gives them, with ``_row``, a number of the row. ``groups``: (fp, c), rows of a SimHash
    group and its centre, the least of them. Each row is compared with its group's centre. Rows that share a band are
    candidates, too, as SimHash groups lack pairs that differ in more bits than their radius: first each is compared with
    one row of the bucket, unless they are linked already; of what that leaves in different components, pairs that the
    sketches let through are compared, so a group of near copies costs as many pairs as it has rows and those that come
    close to the similarity, and every other pair of a bucket costs a few bits of a word. The result reads the tables in ``scratch``.
    """
    distinct = scratch.keep(rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("_row").alias("_row")), "near-distinct")
    entries = distinct.select("fp", "n", F.explode("bands").alias("k"))
    centre = F.min(F.struct("fp", "n"))
    buckets = entries.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), centre.alias("c")).filter("rows > 1").select("k", "c")
    shared = scratch.keep(entries.join(buckets, "k").select("k", "fp", "n", F.col("c.fp").alias("c"), F.col("c.n").alias("c_n")), "near-shared")
    sizes = distinct.select("fp", "n")
    close = groups.filter("fp <> c").select(F.col("c").alias("a"), F.col("fp").alias("b"))
    close = close.join(sizes.select(F.col("fp").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("fp").alias("b"), F.col("n").alias("n_b")), "b")
    close = scratch.keep(_fitting(close, least), "near-close")
    ends = shared.select("fp").unionByName(close.select(F.col("a").alias("fp"))).unionByName(close.select(F.col("b").alias("fp")))
    needed = ends.distinct().join(distinct.select("fp", "_row"), "fp")
    needed = scratch.keep(needed, "near-needed")
    texts = rows.select("_row", "text").join(bounded_broadcast(needed, needed.count(), 24), "_row").select("fp", "text")
    texts = scratch.keep(texts, "near-texts")
    linked = scratch.keep(alike(close, texts, width, least), "near-links")

    star = shared.filter("fp <> c").select(F.col("c").alias("a"), F.col("fp").alias("b"), F.col("c_n").alias("n_a"), F.col("n").alias("n_b"))
    star = scratch.keep(_unlinked(_fitting(star, least), components(linked)).join(close, ["a", "b"], "left_anti"), "near-star")
    links = scratch.keep(alike(star, texts, width, least).unionByName(linked), "near-links")

    known = components(links).withColumnRenamed("node", "fp")
    members = shared.join(known, "fp", "left").select("k", "fp", F.coalesce("root", "fp").alias("root"))
    members = scratch.keep(members, "near-members")
    several = members.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("k")
    left = scratch.keep(members.join(several, "k", "left_semi"), "near-left")
    sketches = scratch.keep(_sketched(texts.join(left.select("fp").distinct(), "fp", "left_semi"), width), "near-sketches")
    pairs = candidates(left, sketches, least, scratch).join(star.unionByName(close), ["a", "b"], "left_anti")
    more = scratch.keep(alike(scratch.keep(pairs, "near-pairs"), texts, width, least), "near-links")
    return components(links.unionByName(more)).withColumnRenamed("node", "fp")


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends lie in different components (node, root)."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.filter("root_a is null or root_b is null or root_a <> root_b").select("a", "b")
