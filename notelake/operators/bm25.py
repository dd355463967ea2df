"""Keyword search: an index of postings and statistics, and BM25 scores of one or many queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.text import keyword_tokens

#: Fixed values of the scoring function.
K1, B, EPSILON = 1.5, 0.75, 0.25
_SALT = 16  # files over which the postings of one term are spread
_SMALL = 100_000  # terms of queries that go to all tasks; they are counted first
_HITS = 1 << 20  # contributions to scores, and
_CELLS = 1 << 21  # scores, that are added up at once, unless one chunk alone has more
_HELD = 1 << 17  # scores that a task keeps beside the best of each query


@dataclass
class KeywordIndex:
    """``postings``: chunk_id, term, tf, dl. ``terms``: term, df, idf. ``stats``: one row (n, avgdl). ``version``
    is that of the corpus it was built from; an index of another version is stale, but can still be searched."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    version: str | None = None

    def is_stale(self, version: str | None) -> bool:
        return self.version is None or self.version != version


def counted(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "chunk_text") -> DataFrame:
    """chunk_id, note_id (null without such a column), mark, dl, terms of chunks: a hash of the text, its length in terms
    and how often each occurs, counted inside the row. Chunks without terms stay: they count in n and the mean length."""
    note = F.col("note_id") if "note_id" in chunks.columns else F.lit(None).cast("string")
    text = F.coalesce(text_column, F.lit(""))
    rows = chunks.select(F.col(id_column).alias("chunk_id"), note.alias("note_id"), F.xxhash64(text).alias("mark"), F.array_sort(keyword_tokens(text)).alias("_t"))
    # places in the sorted terms at which another one begins; a term's count is the distance to the next place
    starts = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (F.get("_t", i - 1) != F.get("_t", i - 2)))
    rows = rows.withColumn("_s", F.when(F.size("_t") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.array(F.size("_t") + 1))
    terms = F.zip_with("_s", ends, lambda a, b: F.struct(F.get("_t", a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return rows.select("chunk_id", "note_id", "mark", F.size("_t").alias("dl"), F.when(F.size("_t") > 0, terms).otherwise(none).alias("terms"))


def exploded(counts: DataFrame, *more: str) -> DataFrame:
    """chunk_id, term, tf, dl (and ``more`` columns): a row per chunk and term of ``counted``. The outer form: of the
    other Spark would infer a filter, and count all terms once more for it."""
    rows = counts.select(*more, "chunk_id", "dl", F.explode_outer("terms").alias("_t")).filter("_t is not null")
    return rows.select(*more, "chunk_id", "_t.term", "dl", "_t.tf")


def by_term(postings: DataFrame) -> DataFrame:
    """Rows of a term lie together, sorted, so a reader that looks for a few terms skips the row groups without them; a
    frequent term is dealt to ``_SALT`` files."""
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(_SALT))
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(n, "term", spread).sortWithinPartitions("term")


def postings_of(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "chunk_text") -> DataFrame:
    """chunk_id, term, tf and the length dl of the chunk in terms; chunks without terms give no rows."""
    return exploded(counted(chunks, id_column, text_column))


def built(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "chunk_text", version: str | None = None) -> KeywordIndex:
    """Builds the index. Chunks without terms count in n and in the mean length.

    The inverse document frequency ln(n - df + 0.5) - ln(df + 0.5) of a term that most chunks have is negative;
    it is replaced by a quarter of the mean over all terms, which is taken before.
    """
    postings = postings_of(chunks, id_column, text_column)
    stats = _statistics(postings, chunks.agg(F.count(F.lit(1)).alias("n")))  # the count reads no text
    terms = _frequencies(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)
    return KeywordIndex(postings, terms, stats, version)


def _statistics(postings: DataFrame, n: DataFrame) -> DataFrame:
    """n and the mean length, which is summed over the postings."""
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return n.crossJoin(F.broadcast(total)).select("n", F.try_divide("total", "n").alias("avgdl"))  # one row each


def _frequencies(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf."""
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats: one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def written(chunks: DataFrame, path: str, id_column: str = "chunk_id", text_column: str = "chunk_text", version: str | None = None) -> KeywordIndex:
    """Builds the index at ``path`` and returns the written one. Texts are taken apart once: postings are written first,
    and everything else is counted from them."""
    spark = chunks.sparkSession
    by_term(postings_of(chunks, id_column, text_column)).write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    _statistics(postings, chunks.agg(F.count(F.lit(1)).alias("n"))).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df.write.mode("overwrite").parquet(f"{path}/df")
    terms = _frequencies(spark.read.parquet(f"{path}/df"), stats)
    terms.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    return loaded(spark, path, version)


def saved(index: KeywordIndex, path: str, partitions: int | None = None) -> KeywordIndex:
    """Writes the index and returns the written one. Postings and terms are ranged and sorted by term, so a reader
    that looks for a few terms skips the row groups without them."""
    spark = index.stats.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in (("postings", index.postings), ("terms", index.terms)):
        df.repartitionByRange(n, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/{name}")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
    return loaded(spark, path, index.version)


def loaded(spark: SparkSession, path: str, version: str | None = None) -> KeywordIndex:
    return KeywordIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats")), version)


def for_terms(index: KeywordIndex, terms: list[str]) -> KeywordIndex:
    """The index with the given terms only: a condition that a written index reads by."""
    wanted = F.col("term").isin(*terms) if terms else F.lit(False)
    return KeywordIndex(index.postings.filter(wanted), index.terms.filter(wanted), index.stats, index.version)


def query_terms(queries: DataFrame, text_column: str = "text") -> DataFrame:
    """query_id, term, n: terms of queries and how often they occur there."""
    tokens = queries.select("query_id", F.explode(keyword_tokens(text_column)).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _weighted(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """query_id, term, w: the weight of a query's term, for terms that the index has."""
    return asked.join(index.terms, "term").select("query_id", "term", (F.col("n") * F.col("idf")).alias("w"))


def _parts(index: KeywordIndex, wanted: DataFrame) -> DataFrame:
    """Postings of the wanted terms, and ``part``: what a weight is multiplied by."""
    hits = index.postings.join(wanted, "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    return hits.withColumn("part", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))


def scored(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of all chunks with a term of the query. A term that repeats in a query counts as
    often. Postings join terms of queries on the term; nothing else of the index moves."""
    hits = _parts(index, _weighted(index, asked))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def _best(index: KeywordIndex, weights: pa.Table, names: DataType, limit: int) -> DataFrame:
    """query_id, chunk_id, score above 0: of each task's chunks the best of each query.

    Few queries meet most chunks, so pairs of both are many times the postings. Postings of the queries' terms are dealt
    by chunk, a row a posting; a task adds up the scores of whole chunks, for all queries at once, and keeps the best.
    """
    spark = index.stats.sparkSession
    term, query = (weights[c].combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
    code = term.indices.to_numpy()
    by_code = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[by_code], np.arange(len(term.dictionary) + 1))
    columns = pa.table({"term": term.dictionary.cast(pa.string()), "code": pa.array(np.arange(len(term.dictionary)), pa.int32())})
    rows = _parts(index, F.broadcast(spark.createDataFrame(columns))).select("chunk_id", "code", "part")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "chunk_id").sortWithinPartitions("chunk_id")
    kind = rows.schema["chunk_id"].dataType
    ids = query.dictionary.cast(to_arrow_type(names))
    add = _adder(starts, query.indices.to_numpy()[by_code], weights["w"].to_numpy()[by_code], ids, limit, to_arrow_type(kind))
    return rows.mapInArrow(add, f"query_id {names.simpleString()}, chunk_id {kind.simpleString()}, score double")


def _adder(starts: np.ndarray, query: np.ndarray, w: np.ndarray, ids: pa.Array, limit: int, kind: pa.DataType) -> Callable[[Iterator], Iterator]:
    """Of batches (chunk_id, code of the term, part), ascending by chunk_id, the best chunks of each query. ``starts``:
    where the queries and weights of each term begin."""
    width, many = len(ids), np.diff(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(width)  # scores that can't be among the best of a query any more
        found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # queries, scores, chunks
        held = None

        def trimmed() -> None:
            if not found:
                return
            q, s, c = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), pa.concat_arrays([f[2] for f in found])
            order = np.lexsort((np.arange(len(q)), -np.round(s, 9), q))  # chunks come in ascending order
            place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            last = order[place == limit - 1]
            floor[q[last]] = np.maximum(s[last] - 1e-8, 0)
            order = np.sort(order[place < limit])
            found[:] = [(q[order], s[order], c.take(pa.array(order)))]

        def scores(t: pa.RecordBatch, begins: np.ndarray) -> None:
            """Adds up whole chunks, which begin at the given rows."""
            code, part = t.column(1).to_numpy(), t.column(2).to_numpy()
            reps = many[code]
            ends = np.append(begins[1:], len(code))
            hits, i = np.cumsum(reps)[ends - 1], 0
            while i < len(begins):
                before = hits[i - 1] if i else 0
                j = max(i + 1, min(int(np.searchsorted(hits, before + _HITS, "right")), i + _CELLS // width))
                a, b = begins[i], ends[j - 1]
                r = reps[a:b]
                at = np.arange(r.sum()) + np.repeat(starts[code[a:b]] - np.cumsum(r) + r, r)
                chunk = np.repeat(np.arange(j - i), ends[i:j] - begins[i:j])
                s = np.bincount(np.repeat(chunk * width, r) + query[at], np.repeat(part[a:b], r) * w[at], (j - i) * width).reshape(-1, width)
                row, q = np.nonzero(s > floor)
                found.append((q, s[row, q], t.column(0).take(pa.array(begins[i:j][row]))))
                if sum(len(f[0]) for f in found) > _HELD + 2 * width * limit:
                    trimmed()
                i = j

        for t in batches:
            if held is not None:
                t = pa.concat_batches([held, t])
            same = t.column(0).dictionary_encode("encode").indices.to_numpy()
            begins = np.append(0, np.flatnonzero(same[1:] != same[:-1]) + 1)
            held = t.slice(begins[-1])
            if len(begins) > 1:
                scores(t.slice(0, begins[-1]), begins[:-1])
        if held is not None and held.num_rows:
            scores(held, np.zeros(1, dtype=np.int64))
        trimmed()
        for q, s, c in found:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), c.cast(kind), pa.array(s)], ["query_id", "chunk_id", "score"])

    return run


def search_text(index: KeywordIndex, query: str, limit: int) -> DataFrame:
    """``search`` for one text: only the postings of its terms are read."""
    one = index.stats.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    terms = [r["term"] for r in query_terms(one).select("term").collect()]
    return search(for_terms(index, terms), one, limit)


def search(index: KeywordIndex, queries: DataFrame, limit: int, text_column: str = "text") -> DataFrame:
    """query_id, chunk_id, score, list_pos: the best chunks with a score above 0, ties to the smaller id.

    Scores are ranked to nine decimals: sums of one and the same terms may differ beyond, by their order. Up to
    ``_SMALL`` terms of queries with their weights go to all tasks; more are joined, and pairs of query and chunk shuffled.
    """
    wanted = _weighted(index, query_terms(queries, text_column))
    few = wanted.limit(_SMALL + 1).toArrow()
    hits = scored(index, query_terms(queries, text_column)).filter("score > 0") if few.num_rows > _SMALL else _best(index, few, wanted.schema["query_id"].dataType, limit)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return hits.withColumn("list_pos", F.row_number().over(order)).filter(F.col("list_pos") <= limit)
