"""Token buckets on streams of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import Bucket

IDLE_MS = 3_600_000  # a bucket that has been idle so long is full again under any policy in use


def rate_limited_stream(requests: DataFrame, per_minute: float, burst: float, watermark: str = "10 minutes") -> DataFrame:
    """Decisions (key, seconds, allowed) on a stream of requests (key string, seconds double, ts timestamp).

    State is one bucket a key, dropped when the watermark has passed it by an hour.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        b = Bucket(per_minute, burst, *(state.get if state.exists else (None, 0.0)))
        rows = pd.concat(list(frames)).sort_values("seconds", kind="stable")
        out = pd.DataFrame({"key": rows["key"], "seconds": rows["seconds"], "allowed": [b.allow(t) for t in rows["seconds"]]})
        state.update((b.tokens, b.last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(b.last * 1000)) + IDLE_MS)
        yield out

    keyed = requests.withWatermark("ts", watermark).groupBy("key")
    return keyed.applyInPandasWithState(step, "key string, seconds double, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
