"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Golden-ratio points fall into the cumulative weights of the sources; a source's r-th point is the slot of its
r-th block. Blocks are equal runs of tokens of the source's shuffled documents, which repeat cyclically up to
``max_repeat`` times; the last block of a source ends exactly at its quota.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise, own_columns, partitions, running_offsets, word_count

GOLDEN = 0.6180339887498949  # fixed value: (sqrt(5) - 1) / 2
_CHUNK = 4096  # slots ranked by one window
_CELLS = 4096  # cells of [0, 1) in which points meet the sources' intervals


@dataclass
class Mixture:
    """``documents``: a row per input row (doc_id, source, key, twin, size, source_size, target, start, quota).
    ``sources``: sizes, weights, targets, quotas. ``schedule``: the slot of each block of each source. ``pieces``: what
    each slot takes. ``points``: number of points; slots from there on hold the blocks that no point was left for."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    points: int

    def taken(self) -> DataFrame:
        """A row per document with the words that the mix takes of it, repeats counted, the first slot that takes some
        (null if none does), and in how many pieces slots take it."""
        keys = ["sid", "start", "doc_id", "size", "source_size", "target"]
        none = F.lit(None).cast("long")
        got = self.pieces.select(*keys, F.col("length").alias("n"), "slot", F.lit(0).cast("long").alias("rows"))
        own = self.documents.select(*keys, F.lit(0).cast("long").alias("n"), none.alias("slot"), F.lit(1).cast("long").alias("rows"))
        out = got.unionByName(own).groupBy(*keys).agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_pieces"), F.sum("rows").alias("rows"))
        # documents without words share a position; one row each
        return out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("i", "rows")


def shuffle_key(seed: int) -> Column:
    """60 bits of the MD5 of seed, doc_id and text, in the upper bits of a long: the order of a source's stream."""
    line = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.shiftleft(F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long"), 4)


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """Sources in code-point order, null last, with weights repeating, and water-filled targets.

    ``sizes``: source, source_size, n_docs. One row per source; windows over this table alone run in one task.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("sid", F.row_number().over(order)).withColumn("weight", w)
    s = s.withColumn("cap", (F.col("source_size") * max_repeat).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    # A level of filling at which the first k sources are full; the right one is the first not above its own level.
    by_level = W.orderBy("level", "sid")
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("_try", (F.col("total") - full) / open_w)
    s = s.withColumn("_fill", F.min_by("_try", F.when(F.col("_try") <= F.col("level"), F.struct("level", "sid"))).over(everything))
    s = s.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("_fill") * F.col("weight")), F.col("cap")))
    s = s.withColumn("quota", F.least(F.round("target").cast("long"), F.col("cap").cast("long")))
    cum = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("hi", F.when(F.col("total") > 0, cum / F.col("total")).otherwise(F.lit(0.0)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0.0)))
    return s.drop("_try", "_fill", "level")


def slot_schedule(sources: DataFrame, n_sources: int, total: int, block: int) -> DataFrame:
    """(slot, sid, block): the r-th golden-ratio point that falls to a source takes its block r.

    Blocks for which rounding leaves no point come after the last point, so that quotas are met exactly.
    """
    spark = sources.sparkSession
    n = -(-total // block)
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod((F.col("id") + F.lit(0.5)) * GOLDEN, F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * _CELLS))
    last = F.least(F.ceil(F.col("hi") * _CELLS), F.lit(_CELLS)) - 1
    cells = sources.filter("hi > lo").withColumn("first", F.floor(F.col("lo") * _CELLS))
    cells = cells.select("sid", "lo", "hi", F.explode(F.sequence(F.col("first"), F.greatest(last, F.col("first")))).alias("cell"))
    cells = bounded_broadcast(cells, n_sources + _CELLS, 48)
    hit = points.join(cells, "cell").filter("u >= lo and u < hi").select("slot", "sid", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    counts = hit.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("sid", "chunk", F.coalesce(before, F.lit(0)).alias("at"))
    rank = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("r", rank).join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("at") + F.col("r")).alias("block"))
    ranked = materialise(ranked, "mix-slots")
    had = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    need = sources.select("sid", F.expr(f"(quota + {block - 1}L) div {block}L").alias("need"))
    need = bounded_broadcast(need, n_sources, 24)
    slots = ranked.join(need, "sid").filter("block < need").select("slot", "sid", "block")
    late = need.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < need")
    late = late.select("sid", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("block"))
    late = late.select((F.lit(n) + F.col("block") * n_sources + F.col("sid")).alias("slot"), "sid", "block")
    return slots.unionByName(late)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, slots: int = 1 << 17, max_block: int = 1 << 20, seed: int = 42, twin: Column | None = None) -> Mixture:
    """Mixes documents (doc_id, text, source) to the sources' weights.

    The size of a document is its number of words. Blocks have ``total / slots`` words, ``max_block`` at most.
    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own,
    last in order; repeated rows are documents of their own; an empty table gives an empty mixture; other
    columns are ignored. Texts of any length count whole. Ties of the shuffle go by doc_id, size and ``twin`` (long), which
    may tell rows of one text apart. The result depends on the rows alone, not on their partitions, so reruns agree.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    base = materialise(docs.select("doc_id", "source", word_count(text).alias("size"), shuffle_key(seed).alias("key"), (F.lit(0).cast("long") if twin is None else twin).alias("twin")), "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = materialise(source_targets(sizes, weights, max_repeat), "mix-sources")
    total, rows, n_sources = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.count(F.lit(1))).first()
    block = min(max(1, total // slots), max_block)
    known = bounded_broadcast(sources.select(F.col("source").alias("_s"), "sid", "source_size", "target", "quota"), n_sources, 96)
    placed = base.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = running_offsets(placed, "sid", "key", "size", ["doc_id", "size", "twin"], rows, "start")
    placed = materialise(placed, "mix-placed")
    schedule = slot_schedule(sources, n_sources, total, block)
    first = F.col("epoch") * F.col("source_size") + F.col("start")
    shown = placed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_repeat - 1).cast("long"))))
    shown = shown.withColumn("at", first).filter("at < quota").withColumn("until", F.least(F.col("at") + F.col("size"), F.col("quota")))
    cut = shown.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}L"), F.expr(f"(until - 1) div {block}L"))))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("until"), (F.col("block") + 1) * block)
    cut = cut.withColumn("offset", lo - F.col("at")).withColumn("length", hi - lo)
    pieces = cut.join(schedule, ["sid", "block"]).select("slot", "sid", "source", "block", "epoch", "doc_id", "key", "twin", "start", "size", "source_size", "target", "offset", "length")
    return Mixture(placed, sources, schedule, pieces, -(-total // block))


def taken_per_document(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, n_pieces: one row per document row (see ``mix``)."""
    out = mix(docs, **options).taken()
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The documents of the mix with their columns, in the order of its slots: a document appears for each slot that
    takes its first word, so a source's words pass its target by less than one document.

    Partitions follow one another as runs of slots do, and rows inside one are in order. Documents without words (null,
    blank) are not part of a mix of words and go. Rows that agree in all columns appear as often together as their slots
    say. An empty table stays empty. Columns may have any name. ``docs`` is read twice.
    """
    columns = [F.to_json(F.struct(c)) if "map" in kind or "variant" in kind else c for c, (_, kind) in zip(own_columns(docs), docs.dtypes, strict=True)]
    m = mix(docs, seed=seed, twin=F.xxhash64(*columns), **options)
    copies = m.pieces.filter("offset = 0").select("slot", "start", F.col("doc_id").alias("m_doc"), F.col("key").alias("m_key"), F.col("twin").alias("m_twin"))
    whole = docs.select(F.struct(*own_columns(docs)).alias("whole"), "doc_id", shuffle_key(seed).alias("key"), F.xxhash64(*columns).alias("twin"))
    keys = ["doc_id", "key", "twin"]
    twins = m.documents.filter("size > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*(F.col(k).alias(f"t_{k}") for k in keys))
    twins = materialise(twins, "mix-twins")
    if not twins.isEmpty():  # one row stands for all that are alike
        same = (F.col("key") == F.col("t_key")) & (F.col("twin") == F.col("t_twin")) & F.col("doc_id").eqNullSafe(F.col("t_doc_id"))
        one = whole.join(twins, same, "left_semi").groupBy(*keys).agg(F.first("whole").alias("whole"))
        whole = whole.join(twins, same, "left_anti").unionByName(one.select(*whole.columns))
    same = (F.col("key") == F.col("m_key")) & (F.col("twin") == F.col("m_twin")) & F.col("doc_id").eqNullSafe(F.col("m_doc"))
    n = partitions(docs.sparkSession)
    part = F.least(F.expr(f"slot * {n}L div {max(1, m.points)}L"), F.lit(n - 1)).cast("int")
    dealt = whole.join(copies, same).select("whole", "slot", "start").repartitionById(n, part)
    return dealt.sortWithinPartitions("slot", "start").select("whole.*")
