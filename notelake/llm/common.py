"""Helpers that every operator of this subpackage shares: scratch storage, words, hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path

#: Java / Python regular expressions for the white space that separates words, and for a word.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of an iteration that nothing reads any more."""
    for path in paths:
        delete_path(spark, path)


def materialise(df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor
    costs no recomputation of what came before. ``dictionary``: whether values may recur."""
    return materialise_at(df, name, dictionary)[0]


def materialise_at(df: DataFrame, name: str, dictionary: bool = True) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Scratch tables of one computation, which go together once nothing reads them any more."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
        out, path = materialise_at(df, name, dictionary)
        self.held.append((df.sparkSession, path))
        return out

    def drop(self) -> None:
        for spark, path in self.held:
            drop_scratch(spark, path)
        self.held.clear()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of record batches; what a batch needed goes back to the system after it, so that idle Python
    workers hold little beside the executor."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

        def each() -> Iterator:
            for b in batches:
                yield b
                del b
                pyarrow.default_memory_pool().release_unused()
                if trim:
                    trim(0)

        yield from run(each())

    return wrapped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def named(column: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of a table, whatever their names."""
    return [named(c) for c in df.columns]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """Marks a table for broadcast only when its counted rows stay under ``limit`` bytes; beyond that
    Catalyst picks a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits_for(rows: int, per_bucket: int) -> int:
    """How many leading hash bits give buckets of about ``per_bucket`` rows; 1 at least."""
    return max(1, (max(1, rows) // per_bucket).bit_length())


def running_offsets(df: DataFrame, group: str, key: str, value: str, ties: list[str], rows: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come before a row in the
    order of the 64-bit hash ``key`` (then ``ties``).

    Three levels of prefix sums by leading hash bits, so that no task sorts more than a few thousand rows of
    a group however many the group has. ``rows`` is the number of all rows.
    """
    from pyspark.sql import Window as W

    low = bits_for(rows, 2048)
    high = max(1, low - 12)
    df = df.withColumns({"_hi": F.shiftrightunsigned(key, 64 - high), "_lo": F.shiftrightunsigned(key, 64 - low)})
    lows = df.groupBy(group, "_hi", "_lo").agg(F.sum(value).alias("_n"))
    before = (W.unboundedPreceding, -1)
    w_hi = W.partitionBy(group).orderBy("_hi").rowsBetween(*before)
    highs = lows.groupBy(group, "_hi").agg(F.sum("_n").alias("_m")).select(group, "_hi", F.coalesce(F.sum("_m").over(w_hi), F.lit(0)).alias("_at_hi"))
    w_lo = W.partitionBy(group, "_hi").orderBy("_lo").rowsBetween(*before)
    starts = lows.select(group, "_hi", "_lo", F.coalesce(F.sum("_n").over(w_lo), F.lit(0)).alias("_at_lo")).join(highs, [group, "_hi"])
    starts = starts.select(group, "_hi", "_lo", (F.col("_at_lo") + F.col("_at_hi")).alias("_at"))
    w_row = W.partitionBy(group, "_hi", "_lo").orderBy(key, *ties).rowsBetween(*before)
    placed = df.withColumn("_in", F.coalesce(F.sum(value).over(w_row), F.lit(0))).join(starts, [group, "_hi", "_lo"])
    return placed.withColumn(out, F.col("_at") + F.col("_in")).drop("_hi", "_lo", "_in", "_at")
