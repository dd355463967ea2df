"""Sessions on streams of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_windows(messages: DataFrame, key: str, ts: str, ttl_seconds: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """key, first_seen, last_active, n_events of sessions that a gap of more than ``ttl_seconds`` ends.

    Windows touch at a gap of exactly the time to live and stay one session, as expiry needs a longer gap. The
    watermark bounds the state.
    """
    w = F.session_window(ts, f"{ttl_seconds} seconds")
    out = messages.withWatermark(ts, watermark).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_active"))
    return out.select(key, "first_seen", "last_active", "n_events")
