"""A keyword index of immutable segments: a change writes what it adds and tombstones for what goes.

A segment holds its chunks (terms with their counts), their postings by term, and how many chunks have each term. The
figures that scores need are sums over segments less those over tombstones, so scores are those of an index built anew.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog, Conflict
from ..sources.storage import remove
from .bm25 import EPSILON, KeywordIndex, built, by_term, counted, exploded

log = logging.getLogger(__name__)
_MOST = 8  # segments before the smaller ones are merged
_SMALL = 100_000  # dead chunks that go to all tasks; the state has their number


class SegmentIndex:
    """Keyword index in a folder; every change is a commit that a concurrent writer can't undo."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_log")

    # state

    def state(self) -> dict:
        return self.log.read()[1] or {"segments": [], "mean": 0.0, "corpus": None}

    @property
    def corpus(self):
        """What the writer said that the index was made of."""
        return self.state()["corpus"]

    def _at(self, segment: dict, what: str) -> str:
        return f"{self.path}/{segment['name']}/{what}"

    def _read(self, what: str, segments: list[dict] | None = None) -> DataFrame | None:
        """A table of all segments, each with the segment's name."""
        segments = self.state()["segments"] if segments is None else segments
        if not segments:
            return None
        return self.spark.read.parquet(*[self._at(s, what) for s in segments])

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        """segment, chunk_id of chunks that were deleted after their segment was written."""
        paths = [p for s in segments for p in s["dead"]]
        return self.spark.read.parquet(*[f"{self.path}/{p}/chunks" for p in paths]) if paths else None

    def chunks(self) -> DataFrame | None:
        """segment, chunk_id, note_id, mark, dl, terms of the live chunks."""
        segments = self.state()["segments"]
        rows, dead = self._read("chunks", segments), self._dead(segments)
        return rows if dead is None else rows.join(dead, ["segment", "chunk_id"], "left_anti")

    def stats(self) -> tuple[int, float]:
        """Live chunks, and their mean length in terms."""
        return _totals(self.state()["segments"])

    def frequencies(self, segments: list[dict] | None = None) -> DataFrame | None:
        """term, df over live chunks: what segments count less what their tombstones do."""
        segments = self.state()["segments"] if segments is None else segments
        own = self._read("terms", segments)
        if own is None:
            return None
        paths = [f"{self.path}/{p}/terms" for s in segments for p in s["dead"]]
        if paths:
            own = own.unionByName(self.spark.read.parquet(*paths).withColumn("df", -F.col("df")))
        return own.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    # writing

    def _write(self, counted: DataFrame) -> dict:
        """A segment of chunks (chunk_id, note_id, mark, dl, terms: array of (term, tf)); postings are made of the chunks
        once these are written."""
        name = f"s-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        counted.withColumn("segment", F.lit(name)).write.parquet(f"{at}/chunks")
        rows = self.spark.read.parquet(f"{at}/chunks")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        by_term(exploded(rows, "segment")).write.parquet(f"{at}/postings")
        self.spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{at}/terms")
        return {"name": name, "n": n, "total": total, "dead": [], "dead_n": 0, "dead_total": 0}

    def _bury(self, ids: DataFrame, segments: list[dict]) -> list[dict]:
        """The segments with tombstones for the chunks of ``ids`` (segment, chunk_id), which are live."""
        own = [s for s in segments if s["n"]]
        if not own:
            return segments
        name = f"d-{uuid.uuid4().hex}"
        gone = self._read("chunks", own).join(ids, ["segment", "chunk_id"], "left_semi").select("segment", "chunk_id", "dl", "terms")
        gone.write.parquet(f"{self.path}/{name}/all")
        gone = self.spark.read.parquet(f"{self.path}/{name}/all")
        sums = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).collect()}  # a row a segment
        out = []
        for s in segments:
            r = sums.get(s["name"])
            if r is not None:
                part = f"{name}/{s['name']}"
                dead = gone.filter(F.col("segment") == s["name"])
                dead.select("segment", "chunk_id").write.parquet(f"{self.path}/{part}/chunks")
                dead.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{self.path}/{part}/terms")
                s = {**s, "dead": [*s["dead"], part], "dead_n": s["dead_n"] + r["n"], "dead_total": s["dead_total"] + r["total"]}
            out.append(s)
        remove(self.spark, f"{self.path}/{name}/all")
        return out

    def _commit(self, number: int, segments: list[dict], corpus: object) -> None:
        """Makes segments the current ones; the mean of all terms' idf is taken once a commit, over their counts."""
        segments = [s for s in segments if s["n"] > s["dead_n"]]
        n, _ = _totals(segments)
        df = self.frequencies(segments)
        mean = df.agg(F.avg(F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] if df is not None else None
        self._sweep(self.log.commit(number, {"segments": segments, "mean": mean or 0.0, "corpus": corpus}))

    def build(self, chunks: DataFrame, corpus: object = None) -> SegmentIndex:
        """Replaces the index by one of chunks (chunk_id, chunk_text, and note_id where there is one)."""
        number, _ = self.log.read()
        self._commit(number, [self._write(counted(chunks))], corpus)
        return self

    def change(self, added: DataFrame, gone: DataFrame, corpus: object = None) -> SegmentIndex:
        """Writes a segment of added chunks and tombstones for the gone ones (chunk_id; unknown ones are none), then
        merges segments if they are many. A chunk that is added again replaces the one before."""
        segment = self._write(counted(added))
        while True:
            number, state = self.log.read()
            segments = (state or {"segments": []})["segments"]
            live = self.chunks()
            if live is not None:
                fresh = self.spark.read.parquet(self._at(segment, "chunks")).select("chunk_id")
                ids = live.select("segment", "chunk_id").join(gone.select("chunk_id").unionByName(fresh).distinct(), "chunk_id", "left_semi")
                segments = self._bury(ids, segments)
            try:
                self._commit(number, [*segments, segment], corpus)
                break
            except Conflict:
                log.info("%s changed meanwhile", self.path)
        self.compact()
        return self

    def compact(self, most: int = _MOST) -> None:
        """Merges the smaller half of the segments where there are more than ``most``, and those most of whose chunks
        are dead, each into one: from their chunks' terms, without the texts. A change by another writer comes first."""
        number, state = self.log.read()
        segments = sorted(state["segments"], key=lambda s: s["dead_n"] - s["n"]) if state else []
        merged = segments[most // 2 :] if len(segments) > most else [s for s in segments if 2 * s["dead_n"] > s["n"]]
        if not merged:
            return
        rows, dead = self._read("chunks", merged), self._dead(merged)
        rows = rows if dead is None else rows.join(dead, ["segment", "chunk_id"], "left_anti")
        kept = [s for s in segments if s not in merged]
        try:
            self._commit(number, [*kept, self._write(rows.drop("segment"))], state["corpus"])
        except Conflict:
            return

    def _sweep(self, number: int) -> None:
        """Removes segments that the two latest states don't have and the one before them had."""
        states = [self.log.read(n)[1] for n in (number - 2, number - 1, number) if n >= 0]
        if len(states) == 3:
            kept = {s["name"] for state in states[1:] for s in state["segments"]}
            for s in states[0]["segments"]:
                if s["name"] not in kept:
                    for path in (s["name"], *s["dead"]):
                        remove(self.spark, f"{self.path}/{path}")

    # searching

    def keywords(self, version: str | None = None) -> KeywordIndex:
        """The live chunks as one index to search: postings of all segments without dead chunks, idf from the counts of
        segments and tombstones, and the mean of all terms' idf that the commit took."""
        state = self.state()
        segments, (n, avgdl) = state["segments"], _totals(state["segments"])
        stats = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(avgdl if n else None).cast("double").alias("avgdl"))
        if not segments:
            return built(self.spark.createDataFrame([], "chunk_id string, chunk_text string"), version=version)
        postings, dead = self._read("postings", segments), self._dead(segments)
        if dead is not None:
            few = sum(s["dead_n"] for s in segments) <= _SMALL  # so the postings needn't move
            postings = postings.join(F.broadcast(dead) if few else dead, ["segment", "chunk_id"], "left_anti")
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.lit(EPSILON * state["mean"])).otherwise(raw)
        terms = self.frequencies(segments).select("term", "df", idf.alias("idf"))
        return KeywordIndex(postings.select("chunk_id", "term", "tf", "dl"), terms, stats, version)


def followed(segments: SegmentIndex, index) -> SegmentIndex:
    """Brings a keyword index up to date with an index of chunks (``snapshot``, ``since``): reads the rows of the buckets
    that changed since, and writes those of other text, or none, than it has."""
    old, new = segments.corpus, index.snapshot()
    if old == new:
        return segments
    rows, here = index.since(old, new)
    rows = rows.select("chunk_id", "note_id", "chunk_text").filter("chunk_id is not null")
    live = segments.chunks()
    if live is None:
        return segments.build(rows, new)
    own, keys = live.filter(here).select("chunk_id", "mark"), ["chunk_id", "mark"]
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("chunk_text", F.lit(""))))
    return segments.change(rows.join(own, keys, "left_anti"), own.join(rows.select(*keys), keys, "left_anti"), new)


def _totals(segments: list[dict]) -> tuple[int, float]:
    n = sum(s["n"] - s["dead_n"] for s in segments)
    return n, sum(s["total"] - s["dead_total"] for s in segments) / n if n else 0.0
