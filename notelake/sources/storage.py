"""Small files and versioned tables on any Hadoop file system, from the driver."""

from __future__ import annotations

import contextlib
import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def _context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else jvm.java.io.File(path).toURI(), spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    jvm, p, fc = _context(spark, path)
    if not fc.util().exists(p):
        return None
    stream = fc.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table: another table under the same path has another listing."""
    _, p, fc = _context(spark, path)
    found, left = [], [p]
    while left:
        for s in fc.util().listStatus(left.pop()):
            if s.isDirectory():
                left.append(s.getPath())
            else:
                found.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return str(sorted(found))


def has_path(spark: SparkSession, path: str) -> bool:
    _, p, fc = _context(spark, path)
    return fc.util().exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside and renames over, so that readers find the old or the new text; makes parent folders."""
    jvm, p, fc = _context(spark, path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(beside, p, kinds)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class VersionedTable:
    """A table in a folder of Parquet versions and a pointer to the current one.

    Each write is a new version; the pointer moves when it is whole, so readers and failed writers never meet a
    half-written table. ``keep`` old versions stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, partition_by: tuple[str, ...] = (), keep: int = 2):
        self.spark, self.path, self.partition_by, self.keep = spark, path.rstrip("/"), partition_by, keep
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _state(self) -> dict:
        text = read_text(self.spark, f"{self.path}/CURRENT.json")
        if text is None:
            return {"version": None, "past": []}
        try:
            state = json.loads(text)
            return {"version": state["version"], "past": list(state["past"])}
        except (ValueError, KeyError, TypeError):
            log.warning("unreadable pointer of %s: taken as empty", self.path)
            return {"version": None, "past": []}

    @property
    def version(self) -> str | None:
        return self._state()["version"]

    def exists(self) -> bool:
        return read_text(self.spark, f"{self.path}/CURRENT.json") is not None

    def ensure(self) -> None:
        """Creates an empty table unless there is one."""
        if not self.exists():
            self.overwrite(self.spark.createDataFrame([], self.schema))

    def read(self) -> DataFrame:
        """The current version; empty where there is none."""
        return self.at_pin(self.version)

    def overwrite(self, df: DataFrame) -> str:
        state, v = self._state(), f"v-{uuid.uuid4().hex}"
        writer = df.select(*self.schema.names).write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{v}")
        past = [x for x in [state["version"], *state["past"]] if x]
        write_text(self.spark, f"{self.path}/CURRENT.json", json.dumps({"version": v, "past": past[: self.keep]}, sort_keys=True))
        for old in past[self.keep :]:
            remove(self.spark, f"{self.path}/{old}")
        return v

    def drop(self) -> None:
        remove(self.spark, self.path)

    def pin(self) -> str | None:
        """What is current, for ``at_pin``; equal as long as nothing is written."""
        return self.version

    def at_pin(self, pin: str | None) -> DataFrame:
        """The rows of a version that was pinned; reading fails once ``keep`` newer ones have come."""
        return self.spark.createDataFrame([], self.schema) if pin is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{pin}")

    def pin_name(self, pin: str | None) -> str | None:
        return pin

    def replace(self, rows: DataFrame) -> str:
        """Makes the table hold these rows."""
        return self.overwrite(rows)


class BucketedTable:
    """A table in buckets by the hash of a key; a change reads and writes the buckets that it touches.

    A log of states names, for each bucket that has rows, the version whose folder holds it. A change that began from an
    old state joins the newer one if that left its buckets alone, else it is made again: writers never lose each other's
    rows. Buckets grow in number (linear hashing: one after the other is split in two), so that they hold ``most`` rows
    on average at most. Beside each bucket's rows lie the values of ``indexed`` columns (text or arrays of it), which tell
    what buckets a search has to read. Folders that neither the current state nor the ``keep`` before it name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 256, keep: int = 2, most: int = 100_000, indexed: tuple[str, ...] = ()):
        from .commits import CommitLog

        self.spark, self.path, self.key, self.buckets, self.keep, self.most, self.indexed = spark, path.rstrip("/"), key, buckets, keep, most, indexed
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.log = CommitLog(spark, f"{self.path}/_log")

    def _states(self) -> list[dict]:
        """The current state, then those before it."""
        numbers = self.log.numbers()[-self.keep - 1 :]
        return [self.log.read(n)[1] for n in reversed(numbers)]

    @property
    def version(self) -> str | None:
        state = self.log.read()[1]
        return state and state["version"]

    def exists(self) -> bool:
        return self.log.read()[1] is not None

    def ensure(self) -> None:
        from .commits import Conflict

        if not self.exists():
            with contextlib.suppress(Conflict):  # another writer made it
                self.log.commit(-1, {"version": f"v-{uuid.uuid4().hex}", "count": self.buckets, "buckets": {}, "rows": {}})

    def _read(self, state: dict | None, only: set[int] | None = None, what: str = "rows/bucket", schema: T.StructType | str | None = None) -> DataFrame:
        own, schema = state["buckets"] if state else {}, schema or self.schema
        paths = [f"{self.path}/{v}/{what}={k}" for k, v in sorted(own.items()) if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, only: list[int] | set[int] | None = None) -> DataFrame:
        """The current rows, of some buckets or all."""
        return self._read(self.log.read()[1], None if only is None else set(only))

    def at(self, state: dict, only: set[int] | None = None) -> DataFrame:
        """The rows of a state that was read before, of some buckets or all."""
        return self._read(state if state.get("buckets") else None, only)

    def bucket(self, count: int | None = None) -> Column:
        """A row's bucket among ``count``: the first of them are split once more than the rest."""
        count = count or (self.log.read()[1] or {"count": self.buckets})["count"]
        half = 1 << (count.bit_length() - 1)
        h = F.xxhash64(self.key)
        low = F.pmod(h, F.lit(half))
        return F.when(low < count - half, F.pmod(h, F.lit(2 * half))).otherwise(low).cast("int")

    def holding(self, column: str, values: list[str]) -> set[int]:
        """The buckets whose rows have any of the values in an indexed column, or in the key."""
        state = self.log.read()[1]
        if state is None:
            return set()
        if column == self.key:
            rows = self.spark.createDataFrame([(v,) for v in values], f"`{column}` string").select(self.bucket(state["count"]))
        else:
            wanted = (F.col("column") == column) & F.col("value").isin(*values)
            rows = self._read(state, None, "values/part", _VALUES).filter(wanted).select("bucket").distinct()
        return {r[0] for r in rows.collect()}  # numbers of buckets, at most as many as there are

    def change(self, keys: DataFrame, new: Callable[[DataFrame], DataFrame]) -> str | None:
        """Replaces the buckets that hold any of ``keys`` by what ``new`` makes of their rows; None if there are no keys."""
        from .commits import Conflict

        written = None
        while True:
            number, state = self.log.read()
            state = state or {"version": None, "count": self.buckets, "buckets": {}, "rows": {}}
            if written is None or (state["buckets"] and state["count"] != written[0]) or any(state["buckets"].get(k) != written[1].get(k) for k in written[2]):
                if not state["buckets"]:  # the first rows come into as many buckets as they ask for, and aren't written again to split them
                    state = {**state, "count": max(state["count"], -(-keys.count() // self.most))}
                touched = {str(r[0]) for r in keys.select(self.bucket(state["count"])).distinct().collect()}  # at most ``count``
                if not touched:
                    return None
                rows = new(self._read(state, set(map(int, touched))))
                written = (state["count"], dict(state["buckets"]), touched, *self._write(rows, state["count"]))
            count, _, touched, version, sizes = written
            try:
                self._commit(number, state, version, touched, sizes, count)
                break
            except Conflict:
                log.info("%s changed meanwhile", self.path)
        self._grow()
        return version

    def _write(self, rows: DataFrame, count: int) -> tuple[str, dict[str, int]]:
        """Writes rows and their indexed values by bucket; the version, and rows by bucket."""
        v = f"v-{uuid.uuid4().hex}"
        rows = rows.select(*self.schema.names).withColumn("bucket", self.bucket(count))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{v}/rows")
        back = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{v}/rows")
        sizes = {str(r["bucket"]): r["n"] for r in back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # reads no column
        if self.indexed and sizes:
            pairs = lambda c, xs: F.transform(xs, lambda x: F.struct(F.lit(c).alias("column"), x.alias("value")))
            kinds, each = dict(back.dtypes), [pairs("", F.array(F.lit("")))]  # a bucket without values has a row, too
            each += [pairs(c, F.coalesce(F.col(c), F.array()) if kinds[c].startswith("array") else F.array(c)) for c in self.indexed]
            values = back.select("bucket", F.explode(F.concat(*each)).alias("_v")).filter("_v.value is not null").select("bucket", "_v.*").distinct()
            values = values.withColumn("part", F.col("bucket")).repartition(max(1, len(sizes) // 16), "part").sortWithinPartitions("part", "column", "value")
            values.write.partitionBy("part").parquet(f"{self.path}/{v}/values")
        return v, sizes

    def _commit(self, number: int, state: dict, version: str, touched: set[str], sizes: dict[str, int], count: int) -> None:
        own = {k: v for k, v in state["buckets"].items() if k not in touched} | dict.fromkeys(sizes, version)
        rows = {k: n for k, n in state["rows"].items() if k not in touched} | sizes
        before = self._states()
        self.log.commit(number, {"version": version, "count": count, "buckets": own, "rows": rows})
        named = {(v, k) for s in [{"buckets": own}, *before[: self.keep]] for k, v in s["buckets"].items()}
        for s in before[self.keep :]:
            for k, v in s["buckets"].items():
                if (v, k) not in named:
                    for what in ("rows/bucket", "values/part"):
                        remove(self.spark, f"{self.path}/{v}/{what}={k}")

    def _grow(self) -> None:
        """Splits as many buckets as the number of rows asks for; another writer's change comes first."""
        from .commits import Conflict

        number, state = self.log.read()
        old = state["count"]
        count = max(old, -(-sum(state["rows"].values()) // self.most))
        if count == old:
            return

        def parent(j: int) -> int:  # where rows of a new bucket lay before
            half = 1 << (old.bit_length() - 1)
            low = j % half
            return j % (2 * half) if low < old - half else low

        touched = {str(parent(j)) for j in range(old, count)} & state["buckets"].keys()
        version, sizes = self._write(self._read(state, set(map(int, touched))), count) if touched else (state["version"], {})
        with contextlib.suppress(Conflict):  # then the next change splits
            self._commit(number, state, version, touched, sizes, count)

    def drop(self) -> None:
        remove(self.spark, self.path)

    def pin(self) -> tuple[int, dict | None]:
        """What is current, for ``at_pin``; equal as long as nothing is committed."""
        return self.log.read()

    def at_pin(self, pin: tuple[int, dict | None]) -> DataFrame:
        """The rows of a state that was pinned; reading fails once ``keep`` newer ones have come."""
        return self._read(pin[1])

    def pin_name(self, pin: tuple[int, dict | None]) -> str | None:
        return pin[1] and f"{pin[0]}:{pin[1]['version']}"

    def replace(self, rows: DataFrame) -> str:
        """Makes the table hold these rows, and none that another writer commits meanwhile."""
        from .commits import Conflict

        written = None
        while True:
            number, state = self.log.read()
            state = state or {"version": None, "count": self.buckets, "buckets": {}, "rows": {}}
            if written is None or written[0] != state["count"]:
                written = (state["count"], *self._write(rows, state["count"]))
            try:
                self._commit(number, state, written[1], set(state["buckets"]), written[2], state["count"])
                break
            except Conflict:
                log.info("%s changed meanwhile", self.path)
        self._grow()
        return written[1]


#: What lies beside the rows of a bucket: its number, and the values of its indexed columns.
_VALUES = "bucket int, column string, value string"
