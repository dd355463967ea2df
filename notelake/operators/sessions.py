"""Conversation sessions: time to live, history, capacity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice, tee
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def sessionized(events: DataFrame, key: str, seconds: str, order: str, ttl: float = 3600.0) -> DataFrame:
    """Adds ``session_no`` (from 1): a gap of more than ``ttl`` seconds begins a new session of the same key."""
    own = W.partitionBy(key).orderBy(seconds, order)
    gap = F.col(seconds) - F.lag(seconds).over(own)
    fresh = F.when(gap.isNull() | (gap > ttl), 1).otherwise(0)
    return events.withColumn("_new", fresh).withColumn("session_no", F.sum("_new").over(own)).drop("_new")


def session_stats(sessions: DataFrame, key: str, seconds: str) -> DataFrame:
    return sessions.groupBy(key, "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min(seconds).alias("first_seen"), F.max(seconds).alias("last_active"))


def history(messages: DataFrame, session: str, seq: str, keep: int = 20) -> DataFrame:
    """The last ``keep`` messages of each session."""
    newest = W.partitionBy(session).orderBy(F.desc(seq))
    return messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")


def least_recent_evicted(events: DataFrame, key: str, seconds: str, capacity: int = 100) -> DataFrame:
    """Keys that stay when only the ``capacity`` most recently active are kept: key, last_active, recency."""
    last = events.groupBy(key).agg(F.max(seconds).alias("last_active"))
    best = last.orderBy(F.desc("last_active"), key).limit(capacity)
    return best.withColumn("recency", F.row_number().over(W.orderBy(F.desc("last_active"), key)))


def prompt_history(messages: DataFrame, session: str, seq: str, keep: int = 20) -> DataFrame:
    """Per session, messages before the last (the current one), of the last ``keep`` in all, in order."""
    kept = history(messages, session, seq, keep)
    last = W.partitionBy(session)
    return kept.withColumn("_last", F.max(seq).over(last)).filter(F.col(seq) < F.col("_last")).drop("_last")


#: Calls of a log, and columns that a replay adds.
OPEN, SAY, READ, CLOSE = "open", "say", "read", "close"
REPLAYED = "session string, outcome string, evicted string, live int, messages array<struct<role:string,content:string>>"


def replay(calls: Iterable[tuple], capacity: int = 100, keep: int = 20, ttl: float = 3600.0) -> Iterator[tuple]:
    """What each call (at, call, session, role, content) of one store's log does: (session, outcome, evicted, live,
    messages).

    ``open`` goes on with a live session or creates one, for which the least recently used goes if there are ``capacity``;
    ``say`` adds a message, of which the last ``keep`` stay, and does nothing without the session; ``read`` gives the
    messages and is no use of the session; ``close`` ends it. A session that was last used more than ``ttl`` seconds ago
    is gone. Sessions lie in the order of their last use, so the ones to go are always first.
    """
    used: dict[str, float] = {}
    said: dict[str, list[tuple[str, str]]] = {}

    def end(session: str) -> None:
        del used[session], said[session]

    for at, call, session, role, content in calls:
        while call != SAY and used and at - next(iter(used.values())) > ttl:
            end(next(iter(used)))
        live, evicted, shown = session in used, None, None
        if call == OPEN:
            if not live:
                if len(used) >= capacity:
                    end(evicted := next(iter(used)))
                session = session or str(uuid4())
                said[session] = []
            used.pop(session, None)
            used[session] = at
        elif call == SAY and live:
            said[session] = (said[session] + [(role, content)])[-keep:]
            del used[session]
            used[session] = at
        elif call == READ and live:
            shown = list(said[session])
        elif call == CLOSE and live:
            end(session)
        outcome = {OPEN: ("created", "resumed"), SAY: ("absent", "added"), READ: ("absent", "found"), CLOSE: ("absent", "closed")}[call][live]
        yield session, outcome, evicted, len(used), shown


def replayed(calls: DataFrame, capacity: int = 100, keep: int = 20, ttl: float = 3600.0) -> DataFrame:
    """Replays the call logs (store, seq, at in seconds, call, session, role, content) of many stores: store, seq and
    ``REPLAYED``. The log of one store is one sequence, as who is evicted depends on all calls before, and meets in one
    task, which holds ``capacity`` sessions of ``keep`` messages; stores are dealt to tasks."""
    columns = ["store", "seq", "at", "call", "session", "role", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, log in groupby(rows, key=lambda r: r[0]):
            ahead, behind = tee(log)
            out = zip(behind, replay((r[2:] for r in ahead), capacity, keep, ttl), strict=True)
            while part := list(islice(out, 4096)):
                yield pa.RecordBatch.from_pylist([{"store": r[0], "seq": r[1], "session": s, "outcome": o, "evicted": e, "live": n, "messages": None if m is None else [{"role": x, "content": y} for x, y in m]} for r, (s, o, e, n, m) in part], schema=schema)

    kinds = dict(calls.dtypes)
    ddl = f"store {kinds['store']}, seq {kinds['seq']}, {REPLAYED}"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    dealt = calls.select(*columns).repartition("store").sortWithinPartitions("store", "seq")
    return dealt.mapInArrow(run, ddl)
