"""Token buckets over request logs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Bucket:
    """A bucket starts full, fills by ``per_minute`` / 60 a second up to ``burst``, and pays one token a request.
    Refused requests move its clock too."""

    per_minute: float
    burst: float
    tokens: float | None = None
    last: float = 0.0

    def remaining(self, now: float) -> float:
        """Tokens at a time, without taking any; a clock that goes back takes tokens away."""
        if self.tokens is None:
            return float(self.burst)
        return min(float(self.burst), self.tokens + (now - self.last) * (self.per_minute / 60.0))

    def allow(self, now: float) -> bool:
        tokens = self.remaining(now)
        self.last, ok = now, tokens >= 1.0
        self.tokens = tokens - 1.0 if ok else tokens
        return ok


class RateLimiter:
    """Buckets of one serving process by key."""

    def __init__(self, per_minute: float, burst: float):
        self.per_minute, self.burst = per_minute, burst
        self.buckets: dict[str, Bucket] = {}

    def check(self, key: str, now: float) -> bool:
        return self.buckets.setdefault(key, Bucket(self.per_minute, self.burst)).allow(now)

    def remaining(self, key: str, now: float) -> float:
        """Tokens of a key; the burst for one that has not been seen. Takes none."""
        return self.buckets.get(key, Bucket(self.per_minute, self.burst)).remaining(now)

    def reset(self, key: str) -> None:
        self.buckets.pop(key, None)

    def bucket_count(self) -> int:
        return len(self.buckets)


def rate_limited(requests: DataFrame, key: str, seconds: str, order: str, per_minute: float, burst: float) -> DataFrame:
    """Adds ``allowed`` and ``tokens_left`` to requests, in the order of ``seconds`` then ``order`` in each key.

    Keys are sorted inside partitions and the bucket is carried from row to row, so a key of any size takes the
    memory of one bucket.
    """
    ordered = requests.repartition(F.col(key)).sortWithinPartitions(key, seconds, order)
    at = ordered.columns.index(key), ordered.columns.index(seconds)
    schema = T.StructType([*ordered.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens_left", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, current, begun = Bucket(per_minute, burst), None, False
        for b in batches:
            allowed, left = [], []
            for k, t in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True):
                if not begun or k != current:
                    bucket, current, begun = Bucket(per_minute, burst), k, True
                allowed.append(bucket.allow(t))
                left.append(bucket.tokens)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed), pa.array(left, type=pa.float64())], [*b.schema.names, "allowed", "tokens_left"])

    return ordered.mapInArrow(run, schema)
