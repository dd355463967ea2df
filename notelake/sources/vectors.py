"""Vectors kept by what they are of: a hash of the model's name and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .providers import EmbeddingProvider, embedded_or_failed
from .storage import BucketedTable

SCHEMA = "key string, vector array<float>"


class VectorStore:
    """Each text is embedded once for a model, whatever note or chunk it stands in and whatever happens to that."""

    def __init__(self, spark: SparkSession, path: str, model: str, buckets: int = 64):
        self.table, self.model = BucketedTable(spark, path, SCHEMA, "key", buckets), model

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat_ws("\0", F.lit(self.model), F.coalesce(text, F.lit(""))).cast("binary"), 256)

    def embedded(self, rows: DataFrame, text: str, provider: EmbeddingProvider, batch: int = 32) -> tuple[DataFrame, int]:
        """The rows with ``vector`` and ``error``, and how many texts were embedded: those that the store lacks, each
        once. Only buckets of the rows' keys are read and written; calls that fail leave nothing in the store."""
        self.table.ensure()
        spark = rows.sparkSession
        keyed = rows.withColumn("_key", self.key(F.col(text)))
        wanted = keyed.select(F.col("_key").alias("key"), F.coalesce(text, F.lit("")).alias("_text")).groupBy("key").agg(F.first("_text").alias("_text"))
        touched = {r[0] for r in wanted.select(self.table.bucket().alias("b")).distinct().collect()}  # numbers of buckets
        lacking = wanted.join(self.table.read(touched).select("key"), "key", "left_anti")
        path = scratch_path(spark, "embedded")  # so that no call is made twice
        lacking.select("key", embedded_or_failed(F.col("_text"), provider, batch).alias("_e")).select("key", "_e.*").write.parquet(path)
        fresh = spark.read.schema("key string, vector array<float>, error string").parquet(path)
        good = fresh.filter("error is null").select("key", "vector")
        made = good.count()
        if made:
            self.table.change(good.select("key"), lambda own: own.join(good, "key", "left_anti").unionByName(good))
        touched = {r[0] for r in wanted.select(self.table.bucket().alias("b")).distinct().collect()}
        known = self.table.read(touched).select(F.col("key").alias("_key"), "vector")
        failed = fresh.filter("error is not null").select(F.col("key").alias("_key"), "error")
        return keyed.join(known, "_key", "left").join(failed, "_key", "left").drop("_key"), made
