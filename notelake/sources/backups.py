"""Backups of several tables as of one moment, and their way back."""

from __future__ import annotations

import json
import logging
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import BucketedTable, VersionedTable, _context, read_text, remove, write_text

log = logging.getLogger(__name__)
Table = VersionedTable | BucketedTable


class Damaged(ValueError):
    """A backup's rows are not those that its manifest tells of."""


def digest(rows: DataFrame) -> dict[str, str]:
    """Number of rows and the sum of their hashes, whatever their order and files."""
    h = F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in rows.columns]))).cast("decimal(38,0)")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h")).first()
    return {"rows": str(r["n"]), "hash": str(r["h"])}


class Backups:
    """Backups in folders below one. A manifest, written last, makes a backup count: one that was killed has none.

    It tells of each table the version that was copied, its schema, its rows' number and hash. All versions were current
    together at one moment: the pointers are read twice, and again until none moved between. Versions that writers remove
    while they are copied begin the backup anew.
    """

    def __init__(self, spark: SparkSession, folder: str, tries: int = 5):
        self.spark, self.folder, self.tries = spark, folder.rstrip("/"), tries

    def _names(self) -> list[str]:
        _, p, fc = _context(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in fc.util().listStatus(p) if s.isDirectory()) if fc.util().exists(p) else []

    def manifest(self, name: str) -> dict | None:
        """What a backup holds; None while it isn't whole."""
        text = read_text(self.spark, f"{self.folder}/{name}/MANIFEST.json")
        return None if text is None else json.loads(text)

    def complete(self) -> list[str]:
        """Names of the whole backups, oldest first."""
        return [n for n in self._names() if self.manifest(n) is not None]

    def _pins(self, tables: dict[str, Table]) -> dict:
        for _ in range(self.tries):
            pins = {k: t.pin() for k, t in tables.items()}
            if all(t.pin() == pins[k] for k, t in tables.items()):
                return pins
        raise RuntimeError(f"tables changed {self.tries} times while their versions were read")

    def make(self, tables: dict[str, Table], frames: dict[str, DataFrame] | None = None) -> str:
        """Copies tables as of one moment, and frames (such as the notes of a scan) as they are read then; the name."""
        for attempt in range(self.tries):
            name = f"b-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
            pins = self._pins(tables)
            try:
                held = {k: self._copied(name, k, t.at_pin(pins[k])) | {"version": t.pin_name(pins[k])} for k, t in tables.items()}
            except Exception:
                remove(self.spark, f"{self.folder}/{name}")
                if attempt + 1 == self.tries or all(t.pin() == pins[k] for k, t in tables.items()):
                    raise
                log.info("a table changed while it was copied; the backup begins anew")
                continue
            held |= {k: self._copied(name, k, df) | {"version": None} for k, df in (frames or {}).items()}
            write_text(self.spark, f"{self.folder}/{name}/MANIFEST.json", json.dumps({"tables": held}, sort_keys=True))
            return name
        raise AssertionError  # the last attempt returns or raises

    def _copied(self, name: str, table: str, rows: DataFrame) -> dict:
        path = f"{self.folder}/{name}/{table}"
        rows.write.parquet(path)
        return {"schema": rows.schema.json(), **digest(self.spark.read.schema(rows.schema).parquet(path))}

    def read(self, name: str, table: str) -> DataFrame:
        """The rows of a table in a backup, not checked."""
        held = (self.manifest(name) or {"tables": {}})["tables"].get(table)
        if held is None:
            raise KeyError(f"backup {name} is not whole or has no {table}")
        return self.spark.read.schema(T.StructType.fromJson(json.loads(held["schema"]))).parquet(f"{self.folder}/{name}/{table}")

    def check(self, name: str) -> None:
        """``Damaged`` if any table's rows are not those that were copied, or can't be read."""
        for table, held in (self.manifest(name) or {"tables": {}})["tables"].items():
            try:
                found = digest(self.read(name, table))
            except Exception as e:
                raise Damaged(f"{table} of backup {name} can't be read") from e
            if found != {k: held[k] for k in ("rows", "hash")}:
                raise Damaged(f"{table} of backup {name} has {found['rows']} rows, or others, where {held['rows']} were copied")

    def restore(self, tables: dict[str, Table], name: str | None = None) -> str:
        """Puts the tables back as a backup has them, by default the last whole one; its name.

        All its tables are checked before the first is touched. Tables change one after the other, in the order of
        ``tables``, each at once; a restore that was killed is run again. With the index before the state, a
        synchronisation between finds notes to do again, and none that it takes for done.
        """
        if name is None:
            whole = self.complete()
            if not whole:
                raise FileNotFoundError(f"no whole backup in {self.folder}")
            name = whole[-1]
        missing = tables.keys() - (self.manifest(name) or {"tables": {}})["tables"].keys()
        if missing:
            raise KeyError(f"backup {name} is not whole or has no {sorted(missing)}")
        self.check(name)
        for k, t in tables.items():
            t.replace(self.read(name, k))
        return name

    def prune(self, keep: int) -> list[str]:
        """Removes whole backups but the last ``keep``, and broken ones older than those; the names of the removed. Newer
        ones without a manifest may still be written."""
        last = self.complete()[-keep:] if keep > 0 else []
        gone = [n for n in self._names() if last and n < last[0]]
        for n in gone:
            remove(self.spark, f"{self.folder}/{n}")
        return gone
