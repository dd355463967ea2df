"""The first rows of an index are shuffled and written once."""

from notelake.session import scratch_path
from notelake.sources import index as indexes
from notelake.sources.storage import BucketedTable


def _rows(spark, n):
    return spark.createDataFrame([(str(i), f"n{i}", "T", "p", [], [], 0, 1, 1, "x", "", "", [1.0]) for i in range(n)], indexes.SCHEMA)


def test_first_rows_are_written_once_without_a_window(spark, monkeypatch):
    index = indexes.ParquetIndex(spark, scratch_path(spark, "t"), buckets=2, most=10)
    index.ensure()
    written, real = [], BucketedTable._write
    monkeypatch.setattr(BucketedTable, "_write", lambda self, rows, count: written.append((count, rows._jdf.queryExecution().optimizedPlan().toString())) or real(self, rows, count))
    index.upsert(_rows(spark, 95))
    assert [c for c, _ in written] == [10] and "Window" not in written[0][1]
    assert index.count() == 95 and index.table.log.read()[1]["count"] == 10
    index.upsert(_rows(spark, 3).unionByName(_rows(spark, 3)))  # rows that repeat
    assert index.count() == 95 and "Window" in written[1][1]
