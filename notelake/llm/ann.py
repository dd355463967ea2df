"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Vectors are scaled to a common length, with one more coordinate where lengths differ, so that the largest inner
product is the nearest unit vector. In each table, fast Hadamard pseudo-rotations assign a vector to the nearest
signed axis, for one hash or several; the tuple is its bucket. A query visits, in each table, the buckets whose
axes are nearest to it. Inside buckets, candidates are ranked by their inner products on the original vectors.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, partitions

log = logging.getLogger(__name__)
_BLOCK = 2048  # rows of a bucket held at once
_ASKED = 1024  # queries of a bucket held at once; more are dealt to further tasks
_MOST = 512  # probes per table; queries are held against all rows where these would not do


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Hasher:
    """``tables`` tables of ``hashes`` hashes; the last hash of a table looks at ``last`` axes only."""

    dim: int
    tables: int
    hashes: int
    last: int
    scale: float  # the greatest length of a vector
    seed: int = 42

    @property
    def width(self) -> int:
        return 1 << self.dim.bit_length()  # room for one more coordinate

    def _lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Unit vectors whose inner products with lifted queries order as those of the originals."""
        out = np.zeros((len(x), self.width))
        lengths = np.sqrt((x * x).sum(axis=1))
        out[:, : self.dim] = x / (lengths[:, None] if query else self.scale)
        if not query:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (lengths / self.scale) ** 2))
        return out

    def axes(self, x: np.ndarray, query: bool, table: int) -> list[np.ndarray]:
        """For each hash of a table, the inner products with its signed axes."""
        u, out = self._lifted(x, query), []
        for k in range(self.hashes):
            signs = np.random.default_rng([self.seed, table, k]).choice([-1.0, 1.0], (3, self.width))
            r = u
            for s in signs:
                r = hadamard(r * s)
            r = r[:, : self.last if k == self.hashes - 1 else self.width]
            out.append(np.concatenate([r, -r], axis=1))
        return out

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n, tables): the bucket of each row in each table."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for a in self.axes(x, False, t):
                out[:, t] = out[:, t] * a.shape[1] + a.argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """(n, tables, count): each query's nearest buckets, nearest first. Of a sum over hashes only the ``count``
        best of what comes before can be among the ``count`` best."""
        out = []
        for t in range(self.tables):
            score, bucket = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
            for a in self.axes(x, True, t):
                s = (score[:, :, None] + a[:, None, :]).reshape(len(x), -1)
                b = (bucket[:, :, None] * a.shape[1] + np.arange(a.shape[1])).reshape(len(x), -1)
                best = np.argsort(-s, axis=1, kind="stable")[:, :count]
                score, bucket = np.take_along_axis(s, best, 1), np.take_along_axis(b, best, 1)
            out.append(bucket)
        return np.stack(out, axis=1)

    def all_buckets(self) -> int:
        return (2 * self.width) ** (self.hashes - 1) * 2 * self.last


def shaped(dim: int, rows: int, tables: int, scale: float, per_bucket: int = 256, seed: int = 42) -> Hasher:
    """A hasher whose buckets would hold about ``per_bucket`` of ``rows`` rows if all were alike."""
    width, want, hashes = 1 << dim.bit_length(), max(2, rows // per_bucket), 1
    while (2 * width) ** hashes < want:
        hashes += 1
    rest = -(-want // (2 * width) ** (hashes - 1))
    return Hasher(dim, tables, hashes, min(width, 1 << max(0, (rest - 1).bit_length() - 1)), scale, seed)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, coordinate by coordinate from the first, so that equal vectors tie exactly."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec id, score) of each query's k best among the rows, itself left out, ties to smaller ids."""
    rough = q @ x.T
    own = q_ids[:, None] == ids[None, :]
    rough[own] = -np.inf
    if x.shape[0] > k:
        edge = np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        row, col = np.nonzero((rough >= (edge - slack)[:, None]) & ~own)
    else:
        row, col = np.nonzero(~own)
    s = scores(q[row], x[col])
    return _best(row, ids[col], s, k)


def _best(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, each id once."""
    order = np.lexsort((ids, -s, row))
    row, ids, s = row[order], ids[order], s[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])] if len(row) else np.empty(0, dtype=bool)
    row, ids, s = row[fresh], ids[fresh], s[fresh]
    if not len(row):
        return row, ids, s
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return row[place < k], ids[place < k], s[place < k]


def valid_vectors(table: DataFrame, vector: Column) -> DataFrame:
    """(vec_id long, v: array of float or double) of the rows whose vector is not null, zero, or with a null, NaN or
    infinite component; of the rows of the commonest length of vector (ties to the shorter), as there is no inner product
    across lengths. Rows of other lengths are counted in a warning."""
    kind = "float" if dict(table.select(vector.alias("v")).dtypes)["v"] == "array<float>" else "double"
    v = vector.cast(f"array<{kind}>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"), F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if top["d"] is not None and top["all"] > top["most"]:
        log.warning("%d vectors of another length than %d take no part", top["all"] - top["most"], top["d"])
    return rows.filter(F.size("v") == (top["d"] or 0))


def fitted(vectors: DataFrame, k: int, recall: float, tables: int, sample: int = 20_000, asked: int = 256, seed: int = 42) -> tuple[Hasher, int, int]:
    """(hasher, probes per table, rows): the fewest probes that find ``recall`` of the k nearest in a sample; 0 probes
    where more than ``_MOST`` would be needed.

    The sample is the ``sample`` rows of the least hashes, ``asked`` of them queries, whatever the partitions. All rows
    have more near neighbours than a sample, nearer ones, and those are found more often, so recall over all rows is
    higher.
    """
    rows, scale = vectors.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()
    if not rows:
        return Hasher(1, tables, 1, 1, 1.0, seed), 1, 0
    h = F.xxhash64(F.lit(seed), "vec_id")
    share = min(1.0, 1.5 * sample / rows)
    some = vectors.filter(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.pmod(h, F.lit(1 << 20)), "vec_id").limit(sample).toPandas()
    x = np.stack(some["v"].to_numpy()).astype(float)
    hasher = shaped(x.shape[1], rows, tables, float(scale) * (1 + 1e-12), seed=seed)
    q, ids = x[:asked], np.arange(len(x))
    near_q, near, _ = nearest(ids[: len(q)], q, ids, x, k)
    if not len(near):
        return hasher, 1, rows
    most = min(hasher.all_buckets(), _MOST)
    probes, codes = hasher.probes(q, most), hasher.buckets(x)
    rank = np.full(len(near), most)
    for t in range(tables):
        hit = probes[near_q, t] == codes[near, t][:, None]
        rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    need = int(np.quantile(rank, recall, method="higher")) + 1
    return hasher, need if need <= most else 0, rows


def search(table: DataFrame, vector: Column, is_query: Column, k: int = 20, recall: float = 0.96, tables: int = 8, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows, by inner product.

    ``is_query`` is a condition on vec_id. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do vectors of another length than most (a warning counts them), nor rows without vec_id; of rows that
    repeat a vec_id the least vector counts. A query that meets fewer than k candidates in its buckets, and every query
    where ``_MOST`` probes would not reach ``recall``, is held against all rows, in blocks, so each query gets min(k,
    other rows) neighbours. An empty table gives no rows. Buckets get whole vectors, so what a query meets is ranked exactly.
    """
    vectors = materialise(valid_vectors(table, vector).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    hasher, probes, rows = fitted(vectors, k, recall, tables, seed=seed)
    # Of equal vectors only the k + 1 least ids can be near any query: ties go to smaller ids.
    same = W.partitionBy("v").orderBy("vec_id")
    hot = vectors.groupBy(F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1)
    repeated = not hot.isEmpty()
    index = vectors
    if repeated:
        often = materialise(hot.select("h"), "ann-repeated")
        keyed = vectors.withColumn("h", F.xxhash64("v"))
        few, many = keyed.join(often, "h", "left_anti"), keyed.join(often, "h", "left_semi")
        # two steps, so that copies of one vector are first thinned out in many tasks
        part = W.partitionBy("v", "_p").orderBy("vec_id")
        many = many.withColumn("_p", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("_i", F.row_number().over(part)).filter(F.col("_i") <= k + 1)
        many = many.withColumn("_i", F.row_number().over(same)).filter(F.col("_i") <= k + 1)
        index = few.select("vec_id", "v").unionByName(many.select("vec_id", "v"))
    queries = vectors.filter(is_query)
    least = min(k, max(0, rows - 1))
    found, short = None, queries
    if probes:
        kind = f"t int, b long, id long, v {dict(vectors.dtypes)['v']}"
        entries = index.mapInArrow(_bucketed(hasher), kind).withColumn("q", F.lit(0))
        asks = queries.mapInArrow(_probing(hasher, probes), kind).withColumn("q", F.lit(1))
        found = materialise(_ranked(_pieces(entries, asks, rows * tables), k), "ann-found")
        got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = queries.join(got.filter(F.col("n") >= least).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    short = materialise(short, "ann-short")
    if least and (found is None or not short.isEmpty()):
        blocks, whole = max(1, rows // 65_536), F.col("v").cast("array<double>").alias("v")
        every = index.select(F.lit(0).alias("t"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), F.col("vec_id").alias("id"), whole, F.lit(0).alias("q"))
        to_all = short.select(F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.col("vec_id").alias("id"), whole, F.lit(1).alias("q"))
        rest = _ranked(_pieces(every, to_all, rows), k)
        found = rest if found is None else found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    elif found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return found.select("query_id", "rank", "vec_id", "score")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bucketed(hasher: Hasher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                ids, buckets = b.column(0), hasher.buckets(_matrix(b.column(1)).astype(float))
                for t in range(hasher.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, dtype=np.int32)), pa.array(buckets[:, t]), ids, b.column(1)], ["t", "b", "id", "v"])

    return run


def _probing(hasher: Hasher, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                probes = hasher.probes(_matrix(b.column(1)).astype(float), count)
                rows = pa.array(np.repeat(np.arange(len(probes)), probes.shape[2]))
                for t in range(hasher.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(probes[:, t].ravel()), b.column(0).take(rows), b.column(1).take(rows)], ["t", "b", "id", "v"])

    return run


def _pieces(entries: DataFrame, asks: DataFrame, total: int) -> DataFrame:
    """Rows and queries of each bucket, in pieces: a bucket with more than ``cap`` rows or queries is cut on both
    sides, and each part of its rows meets each part of its queries once. At most 4096 buckets hold more than a
    4096th of all entries each, so the table of cut buckets is small."""
    cap = max(16_384, total // 4096)
    both = entries.unionByName(asks)
    sizes = both.groupBy("t", "b").agg(F.sum(1 - F.col("q")).alias("rows"), F.sum("q").alias("asked"))
    cut = sizes.filter((F.col("rows") > cap) | (F.col("asked") > _ASKED)).filter("rows > 0")
    cut = cut.select("t", "b", F.ceil(F.col("rows") / cap).cast("int").alias("row_parts"), F.ceil(F.col("asked") / _ASKED).cast("int").alias("ask_parts"))
    cut = materialise(cut, "ann-cut")
    if cut.isEmpty():
        return both.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    both = both.join(cut, ["t", "b"], "left").withColumns({"row_parts": F.coalesce("row_parts", F.lit(1)), "ask_parts": F.coalesce("ask_parts", F.lit(1))})
    own = F.pmod(F.xxhash64("id"), F.when(F.col("q") == 1, F.col("ask_parts")).otherwise(F.col("row_parts"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("q") == 1, F.col("row_parts")).otherwise(F.col("ask_parts")) - 1))
    both = both.withColumn("_own", own).withColumn("_other", other)
    i = F.when(F.col("q") == 1, F.col("_other")).otherwise(F.col("_own"))
    j = F.when(F.col("q") == 1, F.col("_own")).otherwise(F.col("_other"))
    return both.withColumn("i", i).withColumn("j", j).select("t", "b", "id", "v", "q", "i", "j")


def _ranked(pieces: DataFrame, k: int) -> DataFrame:
    """Ranks candidates inside pieces, by their whole vectors, then over the pieces of each query."""
    keys = ["t", "b", "i", "j"]
    dealt = pieces.repartition(partitions(pieces.sparkSession), *keys).sortWithinPartitions(*keys, F.desc("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, asked, ids = None, [], []  # queries of the current piece: (id, vector)
        q_ids, q = np.empty(0, dtype=np.int64), np.empty((0, 0))
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal best, held
            got = _best(*(np.concatenate(c) for c in zip(*best, strict=True)), k)
            best, held = [got], len(got[0])
            return got

        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (0, 1, 5, 6)], axis=1)
            side, row_ids = batch.column(4).to_numpy(), batch.column(2).to_numpy()
            x = _matrix(batch.column(3)).astype(float)
            cuts = np.flatnonzero((m[1:] != m[:-1]).any(axis=1) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(m)], strict=True):
                if mark is None or (m[a] != mark).any():
                    mark, asked, ids = m[a], [], []
                    q_ids, q = np.empty(0, dtype=np.int64), np.empty((0, x.shape[1]))
                if side[a] == 1:
                    asked.append(x[a:b])
                    ids.append(row_ids[a:b])
                    q, q_ids = np.concatenate(asked), np.concatenate(ids)
                    continue
                if not len(q_ids):
                    continue
                for at in range(a, b, _BLOCK):
                    end = min(b, at + _BLOCK)
                    row, near, s = nearest(q_ids, q, row_ids[at:end], x[at:end], k)
                    best.append((q_ids[row], near, s))
                    held += len(row)
                if held > 400_000:
                    flush()
                    if held > 200_000:
                        yield _found(best[0])
                        best, held = [], 0
        if best:
            yield _found(flush())

    found = dealt.select("t", "b", "id", "v", "q", "i", "j").mapInArrow(run, "query_id long, vec_id long, score double")
    return _best_of(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)


def _found(got: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2])], ["query_id", "vec_id", "score"])
