"""Reciprocal-rank fusion, deduplication, trimming and enriching of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sorted_by_score(candidates: DataFrame) -> DataFrame:
    """Adds ``pos``: descending by score, ties in the order of ``list_pos``."""
    return candidates.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "list_pos")))


def fused(lists: list[tuple[DataFrame, float]], rrf_k: int = 60, symmetric_penalty: bool = False) -> DataFrame:
    """query_id, chunk_id, score, pos from ranked lists (query_id, chunk_id, list_pos) with weights.

    A document scores weight / (rrf_k + rank) in each list. One that an earlier list has and a later one lacks
    scores there as if it came after the later one's last; one first seen in a later list has no such share of
    earlier ones, unless ``symmetric_penalty``. Ties go to the list of first sight and the rank there.
    """
    rows, sizes = None, None
    for i, (df, weight) in enumerate(lists):
        part = df.select("query_id", "chunk_id", F.lit(i).alias("list_no"), F.col("list_pos").alias("rank"))
        n = df.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"n{i}"))
        rows = part if rows is None else rows.unionByName(part)
        sizes = n if sizes is None else sizes.join(n, "query_id", "full_outer")
        del weight
    ranks = [F.min(F.when(F.col("list_no") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    docs = rows.groupBy("query_id", "chunk_id").agg(*ranks, F.min("list_no").alias("first_list")).join(sizes, "query_id")
    score = F.lit(0.0)
    for i, (_, weight) in enumerate(lists):
        absent = weight / (rrf_k + F.coalesce(f"n{i}", F.lit(0)) + 1)
        if not symmetric_penalty:
            absent = F.when(F.col("first_list") < i, absent).otherwise(0.0)
        score = score + F.coalesce(weight / (rrf_k + F.col(f"r{i}")), absent)
    first_rank = F.coalesce(*[F.when(F.col("first_list") == i, F.col(f"r{i}")) for i in range(len(lists))])
    docs = docs.withColumn("score", score).withColumn("_r", first_rank)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "first_list", "_r")
    return docs.select("query_id", "chunk_id", "score", F.row_number().over(order).alias("pos"))


def heading_deduplicated(candidates: DataFrame) -> DataFrame:
    """The first candidate of each heading of a note."""
    own = W.partitionBy("query_id", "note_id", F.coalesce("heading_path", F.array().cast("array<string>"))).orderBy("pos")
    return candidates.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def note_capped(candidates: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` candidates of each note, the first ones."""
    own = W.partitionBy("query_id", "note_id").orderBy("pos")
    return candidates.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= cap).drop("_n")


def deduplicated(candidates: DataFrame, cap: int) -> DataFrame:
    """One per heading first, then the cap per note."""
    return note_capped(heading_deduplicated(candidates), cap)


def dedup_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, total_candidates, kept, deduplicated_count."""
    a = before.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    b = after.groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))
    out = a.join(b, "query_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("deduplicated_count", F.col("total_candidates") - F.col("kept"))


def trimmed(candidates: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` candidates with their 1-based rank."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("pos"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def enriched(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """Joins the payload of what is left, with defaults for missing fields."""
    empty = F.array().cast("array<string>")
    payload = index.select("chunk_id", "note_id", "note_title", "note_path", "tags", "heading_path", "chunk_index", "total_chunks", "word_count", "chunk_text")
    out = ranked.select("query_id", "rank", "chunk_id", "score").join(payload, "chunk_id", "left")
    strings = {c: F.coalesce(c, F.lit("")) for c in ("note_id", "note_title", "note_path", "chunk_text")}
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("chunk_index", "total_chunks", "word_count")}
    return out.withColumns({**strings, **numbers, "tags": F.coalesce("tags", empty), "heading_path": F.coalesce("heading_path", empty)})
