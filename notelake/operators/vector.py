"""Exact cosine search with filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import SearchFilter

_QUERIES = 1 << 17  # of a cell, on average
_ROWS = 1 << 15  # rows of a cell, on average
_STEP = 512  # queries that are multiplied at a time
_MERGED = 256  # cells whose best rows meet at once


def predicate(f: SearchFilter) -> Column | None:
    """The filter as a condition on index columns; None if nothing is asked."""
    rules = []
    if f.tags:
        rules.append(F.arrays_overlap("tags", F.array(*map(F.lit, f.tags))))
    rules += [F.col(c) == v for c, v in (("note_id", f.note_id), ("note_path", f.note_path), ("note_title", f.note_title)) if v]
    return reduce(lambda a, b: a & b, rules) if rules else None


def filtered(index: DataFrame, f: SearchFilter) -> DataFrame:
    p = predicate(f)
    return index if p is None else index.filter(p)


def dot(a: Column, b: Column) -> Column:
    d = lambda x: x.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(index: DataFrame, vector: list[float], limit: int = 10, threshold: float = 0.0, filters: SearchFilter = SearchFilter(), embedding: str = "embedding", id_column: str = "chunk_id") -> DataFrame:  # noqa: B008
    """The nearest rows of one query: id, score, list_pos. Filters apply before scoring; a threshold of 0 is none.

    A limited sort: every task keeps ``limit`` rows. The payload is not read.
    """
    q = F.array(*[F.lit(float(x)) for x in vector])
    rows = filtered(index, filters).filter(F.size(embedding) == len(vector))  # there is no product across lengths
    rows = rows.select(F.col(id_column), cosine(F.col(embedding), q).alias("score")).filter("score is not null")
    if threshold > 0:
        rows = rows.filter(F.col("score") >= threshold)
    best = rows.orderBy(F.desc("score"), id_column).limit(limit)
    return best.withColumn("list_pos", F.row_number().over(W.orderBy(F.desc("score"), id_column)))


def search_batch(index: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = 0.0, embedding: str = "embedding", id_column: str = "chunk_id") -> DataFrame:
    """query_id, id, score, list_pos for many queries (query_id, vector), ties to the smaller id.

    Rows and queries are dealt to the cells of a grid, each of bounded size: the index is read once, and moves once for
    every ``_QUERIES`` queries. A cell gives on the ``limit`` best rows of each of its queries; those of many cells are
    merged in two steps. A row takes part in queries of its own vector's length.
    """
    spark = index.sparkSession
    rows = index.filter(F.size(embedding) > 0).select(F.col(id_column).alias("_id"), F.col(embedding).alias("_v"))
    asked = queries.filter(F.size("vector") > 0).select("query_id", "vector")
    n, wide = index.count(), -(-max(1, queries.count()) // _QUERIES)
    high = max(1, -(-n // _ROWS), min(-(-n // 2048), spark.sparkContext.defaultParallelism))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = rows.select("*", F.pmod(F.xxhash64("_id"), F.lit(high)).cast("int").alias("_r"), every(wide).alias("_q"))
    asked = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(wide)).cast("int").alias("_q"), every(high).alias("_r"))
    ids, names = rows.schema["_id"].dataType, asked.schema["query_id"].dataType
    schema = f"query_id {names.simpleString()}, {id_column} {ids.simpleString()}, score double, _r int"
    cell = _cell(limit, threshold, id_column, to_arrow_type(ids), to_arrow_type(names))
    found = asked.groupBy("_r", "_q").cogroup(rows.groupBy("_r", "_q")).applyInArrow(cell, schema)
    ranked = [F.desc(F.round("score", 9)), F.col(id_column)]  # products may differ beyond
    if high > _MERGED:
        near = W.partitionBy("query_id", F.pmod("_r", F.lit(-(-high // _MERGED)))).orderBy(*ranked)
        found = found.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= limit)
    order = W.partitionBy("query_id").orderBy(*ranked)
    return found.select("query_id", id_column, "score", F.row_number().over(order).alias("list_pos")).filter(F.col("list_pos") <= limit)


def _matrices(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of vectors, and them as unit vectors; those without a direction are NaN."""
    whole = vectors.combine_chunks()
    sizes, out = pc.list_value_length(whole).to_numpy(zero_copy_only=False), {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = whole.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), d)
        n = np.linalg.norm(x, axis=1)
        out[int(d)] = at, x / np.where(n > 0, n, np.nan)[:, None]
    return out


def _best(scores: np.ndarray, places: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best ``limit`` finite scores of each row, ties to the lesser place."""
    edge = np.partition(scores, -limit, axis=1)[:, -limit] if scores.shape[1] > limit else np.full(len(scores), -np.inf)
    row, col = np.nonzero((scores >= edge[:, None] - 1e-8) & np.isfinite(scores))
    order = np.lexsort((places[col], -np.round(scores[row, col], 9), row))
    row, col = row[order], col[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < limit
    return row[kept], col[kept]


def _cell(limit: int, threshold: float, id_column: str, id_type: pa.DataType, query_type: pa.DataType) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    names = ["query_id", id_column, "score", "_r"]

    def work(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            ids = rows.column("_id").combine_chunks()
            place = np.empty(len(ids), dtype=np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            known = _matrices(rows.column("_v"))
            for d, (at, q) in _matrices(asked.column("vector")).items():
                own, x = known.get(d, (None, None))
                for begin in range(0, len(at) if own is not None else 0, _STEP):
                    # 8 MB of products at a time; of each block of rows the best stay
                    parts = []
                    for low in range(0, len(own), 4 * _STEP):
                        s = q[begin : begin + _STEP] @ x[low : low + 4 * _STEP].T
                        s = np.where(np.isnan(s) | ((s < threshold) if threshold > 0 else False), -np.inf, s)
                        row, col = _best(s, place[own[low : low + 4 * _STEP]], limit)
                        parts.append((row, own[low + col], s[row, col]))
                    row, col, s = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.lexsort((place[col], -np.round(s, 9), row))
                    row, col, s = row[order], col[order], s[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < limit
                    out.append((at[begin + row[kept]], col[kept], s[kept]))
        row, col, s = (np.concatenate([o[i] for o in out]) if out else np.array([], dtype=int) for i in range(3))
        r = pa.array(np.full(len(row), key[0].as_py()), type=pa.int32())
        columns = [asked.column("query_id").take(pa.array(row, pa.int64())), rows.column("_id").take(pa.array(col, pa.int64())), pa.chunked_array([pa.array(s, pa.float64())]), pa.chunked_array([r])]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, (query_type, id_type, pa.float64(), pa.int32()), strict=True)], names)

    return work
