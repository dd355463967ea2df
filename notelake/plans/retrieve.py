"""Search: candidates by vector and keywords, fused, deduplicated, trimmed and enriched."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetrievalQuery
from ..operators import bm25, fusion, vector
from ..operators.segments import SegmentIndex, followed
from ..session import scratch_path
from ..sources.index import IndexTable
from ..sources.providers import EmbeddingProvider


_SMALL = 100_000  # candidates that go to all tasks by their ids; they are counted first


@dataclass
class Retrieval:
    """``chunks``: query_id, rank, score and payload; ``metrics``: per query total_candidates, keyword_candidates,
    deduplicated_count, filters_applied, retrieval_mode."""

    chunks: DataFrame
    metrics: DataFrame


def search_batch(index: DataFrame, queries: DataFrame, options: RetrievalQuery = RetrievalQuery(), keywords: bm25.KeywordIndex | None = None, matching: DataFrame | None = None, once: bool = True) -> Retrieval:  # noqa: B008
    """Answers queries (query_id, text, vector) from an index of chunks; ``matching``: its rows that the filters let
    through, where they have been looked up.

    Both sources give top_k * over_fetch_factor candidates. Filters and the threshold hold for the vectors only,
    unless ``filter_keyword``. Only ids and scores move until the ranks are known; payloads join after trimming.
    ``once``: the candidates of both sources are written to the shared folder, as several steps read them, and the index
    is reduced to their rows where it lies.
    """
    o, n = options, options.top_k * options.over_fetch_factor
    kept = vector.filtered(index, o.filters) if matching is None else matching
    semantic = keyword = None
    if o.mode != "keyword":
        semantic = vector.search_batch(kept, queries, n, o.score_threshold)
    if o.mode != "semantic":
        k = keywords or bm25.built(index)
        keyword = bm25.search(k, queries, n)
        if o.filter_keyword and o.filters.active:
            keyword = keyword.join(kept.select("chunk_id"), "chunk_id", "left_semi")
    if once:
        semantic, keyword = _written(semantic), _written(keyword)
        ids = reduce(DataFrame.unionByName, [x.select("chunk_id") for x in (semantic, keyword) if x is not None]).distinct()
        few = ids.limit(_SMALL + 1).count() <= _SMALL
        index = index.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")
    if o.mode == "hybrid":
        ranked = fusion.fused([(semantic, o.semantic_weight), (keyword, o.keyword_weight)], o.rrf_k, o.symmetric_penalty)
    else:
        ranked = fusion.sorted_by_score(semantic if keyword is None else keyword).select("query_id", "chunk_id", "score", "pos")
    keys = index.select("chunk_id", "note_id", "heading_path")
    candidates = ranked.join(keys, "chunk_id", "left")
    single = fusion.deduplicated(candidates, o.max_chunks_per_note) if o.deduplicate else candidates
    chunks = fusion.enriched(fusion.trimmed(single, o.top_k), index)
    metrics = fusion.dedup_counts(candidates, single).drop("kept")
    if keyword is not None:
        found = keyword.groupBy("query_id").agg(F.count(F.lit(1)).alias("keyword_candidates"))
        metrics = metrics.join(found, "query_id", "left")
    else:
        metrics = metrics.withColumn("keyword_candidates", F.lit(0).cast("long"))
    metrics = metrics.withColumn("keyword_candidates", F.coalesce("keyword_candidates", F.lit(0)))
    return Retrieval(chunks, metrics.withColumns({"filters_applied": F.lit(o.filters.active), "retrieval_mode": F.lit(o.mode)}))


def _written(candidates: DataFrame | None) -> DataFrame | None:
    if candidates is None:
        return None
    path = scratch_path(candidates.sparkSession, "candidates")
    candidates.write.parquet(path)
    return candidates.sparkSession.read.schema(candidates.schema).parquet(path)


def search(index: DataFrame, text: str, embedding: list[float] | None, options: RetrievalQuery = RetrievalQuery(), keywords: bm25.KeywordIndex | None = None, matching: DataFrame | None = None) -> Retrieval:  # noqa: B008
    """Answers one query; of a keyword index only the postings of its terms are read."""
    spark = index.sparkSession
    if keywords is not None:
        asked = spark.createDataFrame([(0, text)], "query_id int, text string")
        keywords = bm25.for_terms(keywords, [r["term"] for r in bm25.query_terms(asked).select("term").collect()])
    one = spark.createDataFrame([(0, text, embedding or [])], "query_id int, text string, vector array<double>")
    return search_batch(index, one, options, keywords, matching, once=False)


class Retriever:
    """Searches an index table and keeps its keyword index below ``folder`` (the shared folder where none is given): in
    segments, to which the first search after a change of the table adds what changed."""

    def __init__(self, index: IndexTable, provider: EmbeddingProvider, folder: str | None = None):
        self.index, self.provider, self.keywords = index, provider, None
        spark = index.read().sparkSession
        self.segments = SegmentIndex(spark, folder or scratch_path(spark, "keywords"))

    def invalidate(self) -> None:
        if self.keywords:
            self.keywords.version = None

    def ensure_keywords(self) -> bm25.KeywordIndex:
        version = self.index.version
        if self.keywords is None or self.keywords.is_stale(version):
            self.keywords = followed(self.segments, self.index).keywords(version)
        return self.keywords

    def search(self, text: str, options: RetrievalQuery = RetrievalQuery()) -> Retrieval:  # noqa: B008
        v = None if options.mode == "keyword" else self.provider.embed(text)
        k = None if options.mode == "semantic" else self.ensure_keywords()
        matching = self.index.matching(options.filters) if options.filters.active else None
        return search(self.index.read(), text, v, options, k, matching)
