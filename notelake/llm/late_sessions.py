"""Sessions of events that come late, in batches: every version that a session ever had, and what replaced it.

A user's time axis is cut into blocks of batches. What the open session of all events holds where a block begins comes
from sums over segments; then each block is swept alone, in ascending time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_SPAN = 64  # batches a block, at least
_ERA = 256  # segments that one running sum passes over; then eras are summed
_TAIL = ("start", "last", "n", "total", "top")
_OUT = "batch long, start long, end long, n_events long, n_new long, n_retracted long, total long, retracted_batch long, retracted_start long"


def floor_div(x: Column, n: int) -> Column:
    """Quotient towards minus infinity, in long arithmetic."""
    x = x.cast("long")
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n)).cast("long")


@dataclass(slots=True)
class _Session:
    """An open session: its first and last event, events, new ones, sum of values, latest batch, and the sessions of
    the snapshot before that it takes in."""

    start: int
    last: int
    n: int = 0
    new: int = 0
    total: int = 0
    top: int = -(1 << 62)
    inside: list = field(default_factory=list)

    def copy(self) -> _Session:
        return _Session(self.start, self.last, self.n, 0, self.total, self.top)

    def add(self, t: int, batch: int, n: int, total: int) -> None:
        self.last = t
        self.n += n
        self.total += total
        self.top = max(self.top, batch)


class _Sweep:
    """One block of one user, events in ascending time. There is an open session for each batch whose snapshot can still
    get events, and one of all events; a snapshot begins as a copy of the latter. An event updates the snapshots of its
    batch and of those after it."""

    def __init__(self, low: int, high: int, gap: int, interval: int, lateness: int, carried: _Session | None):
        self.low, self.high, self.gap, self.interval, self.lateness = low, high, gap, interval, lateness
        self.reach = lateness + 1 + (gap - 1) // interval  # a version is replaced within so many batches, or never
        self.every, self.open, self.at = carried, {}, None
        self.versions: dict[tuple[int, int], tuple] = {}
        self.replaced: dict[tuple[int, int], tuple[int, int]] = {}

    def _finish(self, batch: int, s: _Session | None) -> None:
        if s is None or not s.new:
            return
        if self.low <= batch < self.high:
            self.versions[batch, s.start] = (batch, s.start, s.last, s.n, s.new, len(s.inside), s.total)
        for old in s.inside:
            if self.low <= old.top < self.high:
                self.replaced[old.top, old.start] = (batch, s.start)

    def _advance(self, i: int | None) -> Iterator[tuple]:
        """Closes the snapshots before batch ``i`` (None: all), gives their settled versions, opens those up to it."""
        for b in sorted(self.open):
            if i is None or b < i:
                self._finish(b, self.open.pop(b))
        for key in [k for k in self.versions if i is None or k[0] + self.reach < i]:
            yield (*self.versions.pop(key), *self.replaced.pop(key, (None, None)))
        if i is not None:
            for b in range(i, i + self.lateness + 1):
                if b not in self.open:
                    s = None
                    if self.every is not None:
                        s = self.every.copy()
                        s.inside.append(self.open.get(b - 1) or self.every.copy())
                    self.open[b] = s
        self.at = i

    def event(self, t: int, batch: int, n: int, total: int) -> Iterator[tuple]:
        i = t // self.interval
        if i != self.at:
            yield from self._advance(i)
        for b in range(batch, i + self.lateness + 1):
            s = self.open[b]
            if s is None or t - s.last > self.gap:
                self._finish(b, s)
                s = self.open[b] = _Session(t, t)
            s.add(t, batch, n, total)
            if b == batch:
                s.new += n
            elif not s.inside or s.inside[-1] is not self.open[b - 1]:
                s.inside.append(self.open[b - 1])
        if self.every is None or t - self.every.last > self.gap:
            self.every = _Session(t, t)
        self.every.add(t, batch, n, total)

    def end(self) -> Iterator[tuple]:
        yield from self._advance(None)


def _chained(df: DataFrame, group: list[str], order: str, gap: int) -> DataFrame:
    """Adds to summaries of stretches of time (first, whole: one session from end to end, and the last session's
    ``_TAIL``) the last session after each, of the group's stretches so far: a_start, a_n, a_total, a_top; a_first, the
    group's first event; a_whole, whether that session fills all of the group so far."""
    w = W.partitionBy(*group).orderBy(order)
    df = df.withColumn("_before", F.lag("last").over(w))
    cut = F.col("_before").isNull() | ~F.col("whole") | (F.col("first") - F.col("_before") > gap)
    df = df.withColumn("_run", F.sum(cut.cast("int")).over(w))
    own = W.partitionBy(*group, "_run").orderBy(order)
    df = df.withColumns({"a_start": F.first("start").over(own), "a_n": F.sum("n").over(own), "a_total": F.sum("total").over(own), "a_top": F.max("top").over(own)})
    return df.withColumns({"a_first": F.first("first").over(w), "a_whole": (F.col("_run") == 1) & F.first("whole").over(w)}).drop("_before", "_run")


def _carried(islands: DataFrame, gap: int) -> DataFrame:
    """user, segment and the last session (``_TAIL``) of all events before the segment; none before a user's first."""
    tail = F.max_by(F.struct(*_TAIL), "start")
    parts = islands.groupBy("user", "segment").agg(F.min("start").alias("first"), (F.count(F.lit(1)) == 1).alias("whole"), tail.alias("_t"))
    parts = parts.select("user", floor_div(F.col("segment"), _ERA).alias("era"), "segment", "first", "whole", "_t.*")
    parts = _chained(parts, ["user", "era"], "segment", gap)
    now = F.struct(F.col("a_start").alias("start"), "last", F.col("a_n").alias("n"), F.col("a_total").alias("total"), F.col("a_top").alias("top"))
    eras = parts.groupBy("user", "era").agg(F.min("first").alias("first"), F.max_by("a_whole", "segment").alias("whole"), F.max_by(now, "segment").alias("_t"))
    eras = _chained(eras.select("user", "era", "first", "whole", "_t.*"), ["user"], "era", gap)
    before = eras.select("user", "era", F.lag(now).over(W.partitionBy("user").orderBy("era")).alias("_c"))
    near = W.partitionBy("user", "era").orderBy("segment")
    parts = parts.select("user", "era", "segment", F.lag(now).over(near).alias("_s"), F.lag("a_whole").over(near).alias("_whole"), F.lag("a_first").over(near).alias("_first"))
    joined = F.col("_whole") & (F.col("_first") - F.col("_c.last") <= gap)  # null without a session before the era
    both = F.struct(F.col("_c.start").alias("start"), F.col("_s.last").alias("last"), (F.col("_c.n") + F.col("_s.n")).alias("n"), (F.col("_c.total") + F.col("_s.total")).alias("total"), F.greatest("_c.top", "_s.top").alias("top"))
    held = F.when(F.col("_s").isNull(), F.col("_c")).when(joined, both).otherwise(F.col("_s"))
    return parts.join(before.hint("merge"), ["user", "era"]).select("user", "segment", held.alias("_t")).filter("_t is not null").select("user", "segment", "_t.*")


def session_versions(events: DataFrame, gap: int = 600, interval: int = 900, lateness: int = 3) -> DataFrame:
    """Every version of every session of events (user, time: long, batch: long, value: long).

    Batch b may hold events of the times [interval * (b - lateness), interval * (b + 1)); others fail the job. After
    each batch, neighbours in time at most ``gap`` apart share a session. One that holds an event of the batch is a new
    version and replaces the standing versions of the sessions that it takes in. Columns: user, batch, start, end,
    n_events, n_new, n_retracted (how many it replaces), total (sum of values), retracted_batch and retracted_start (the
    version that replaces it; null if none).

    Events without user, time or batch take no part; a null value counts as 0; rows that repeat are events each; no
    events give no rows. Events of one user, time and batch are added up first, so a block holds at most
    (``lateness`` + 1) rows a unit of time, however many events a user has, and blocks are swept apart.
    """
    wide = max(_SPAN, gap // interval + 1)  # batches a block: a session that passes over a segment has an event in it
    span, late = wide * interval, lateness * interval
    reach = (lateness + 1 + (gap - 1) // interval) * interval
    kind = dict(events.select("user").dtypes)["user"]
    df = events.select("user", F.col("time").cast("long").alias("t"), F.col("batch").cast("long").alias("b"), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("v"))
    df = df.filter("user is not null and t is not null and b is not null")
    ahead = F.col("b") - floor_div(F.col("t"), interval)
    df = df.withColumn("b", F.when(ahead.between(0, lateness), F.col("b")).otherwise(F.raise_error(F.lit("an event's batch isn't within its lateness")).cast("long")))
    df = df.groupBy("user", "t", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))

    # sessions of all events inside each segment; block k begins where segment k does
    own = df.withColumn("segment", floor_div(F.col("t") + late, span))
    w = W.partitionBy("user", "segment").orderBy("t")
    own = own.withColumn("_new", F.coalesce(F.col("t") - F.lag("t").over(w) > gap, F.lit(True)).cast("int"))
    own = own.withColumn("_island", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0)))
    islands = own.groupBy("user", "segment", "_island").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("b").alias("top"))
    carried = _carried(islands, gap).select("user", F.col("segment").alias("block"), F.lit(0).alias("kind"), F.col("last").alias("t"), F.col("top").alias("b"), "n", "total", "start")

    blocks = F.sequence(floor_div(F.col("t") - reach, span), floor_div(F.col("t") + late, span))
    dealt = df.select("user", F.explode(blocks).alias("block"), F.lit(1).alias("kind"), "t", "b", "n", "total", F.lit(None).cast("long").alias("start"))
    rows = dealt.unionByName(carried).repartition("user", "block").sortWithinPartitions("user", "block", "kind", "t", "b")
    arrow = to_arrow_type(rows.schema["user"].dataType)
    names = ["user", *(c.split()[0] for c in _OUT.split(", "))]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        at, one, out = None, None, []
        for batch in batches:
            for user, block, is_event, t, b, n, total, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (user, block) != at:
                    if one is not None:
                        out += [(at[0], *v) for v in one.end()]
                    held = None if is_event else _Session(start, t, n, 0, total, b)
                    at, one = (user, block), _Sweep(block * wide, (block + 1) * wide, gap, interval, lateness, held)
                if is_event:
                    out += [(user, *v) for v in one.event(t, b, n, total)]
                if len(out) >= 4096:
                    yield packed(out)
                    out = []
        if one is not None:
            out += [(at[0], *v) for v in one.end()]
        if out:
            yield packed(out)

    return rows.mapInArrow(sweep, f"user {kind}, {_OUT}")
