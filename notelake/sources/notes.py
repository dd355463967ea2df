"""Scans of folders of markdown notes."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..session import ship

log = logging.getLogger(__name__)
FILE_SCHEMA = "relative_path string, content binary, file_size_bytes long, modified_at timestamp"


def hidden(relative_path: Column) -> Column:
    """Any part of the path begins with a dot."""
    return relative_path.rlike(r"(^|/)\.")


def is_markdown(relative_path: Column) -> Column:
    return F.lower(relative_path).rlike(r"[^/]\.md$")


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    base = root.rstrip("/")
    return pafs.FileSystem.from_uri(base if "://" in base else os.path.abspath(base))


def paths_below(spark: SparkSession, root: str) -> DataFrame:
    """relative_path of every file below a folder. The driver lists the folder itself, tasks list what is below its
    sub-folders. (Spark's own listing leaves out names that begin with an underscore.)"""
    fs, top = _opened(root)
    here = fs.get_file_info(pafs.FileSelector(top))
    files = spark.createDataFrame([(i.base_name,) for i in here if i.type == pafs.FileType.File], "relative_path string")
    folders = spark.createDataFrame([(i.base_name,) for i in here if i.type == pafs.FileType.Directory], "relative_path string")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                left = [f"{top}/{folder}"]
                while left:
                    found = fs.get_file_info(pafs.FileSelector(left.pop()))
                    left += [i.path for i in found if i.type == pafs.FileType.Directory]
                    names = [os.path.relpath(i.path, top) for i in found if i.type == pafs.FileType.File]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["relative_path"])

    return files.unionByName(folders.repartition("relative_path").mapInArrow(below, "relative_path string"))


def listing(paths: DataFrame) -> DataFrame:
    """Adds ``status`` to paths (relative_path): hidden, skipped (another extension) or note."""
    p = F.col("relative_path")
    return paths.withColumn("status", F.when(hidden(p), "hidden").when(is_markdown(p), "note").otherwise("skipped"))


def scan_stats(listed: DataFrame) -> DataFrame:
    """One row: files that are not hidden, notes, skipped ones."""
    count = lambda s: F.count_if(F.col("status") == s)
    return listed.agg(F.count_if(F.col("status") != "hidden").alias("total_files_scanned"), count("note").alias("notes"), count("skipped").alias("skipped_files"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, content, file_size_bytes, modified_at of the notes below a folder; files are read by tasks.
    Of an unreadable file the content is null."""
    ship(spark)
    wanted = listing(paths_below(spark, root)).filter("status = 'note'").select("relative_path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                try:
                    info = fs.get_file_info(f"{top}/{name}")
                    with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                        content = f.read()
                except OSError as e:
                    log.warning("skipped %s: %s", name, e)
                    info, content = None, None
                mtime = pa.array([info and info.mtime_ns // 1000], type=pa.timestamp("us", tz="UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], type=pa.binary()), pa.array([None if content is None else len(content)], type=pa.int64()), mtime], ["relative_path", "content", "file_size_bytes", "modified_at"])

    return wanted.mapInArrow(read, FILE_SCHEMA)


def parsed(files: DataFrame) -> DataFrame:
    """Notes of files (relative_path, content binary, file_size_bytes, modified_at).

    Bytes that are no UTF-8 become replacement characters. Files that could not be read, and notes whose frontmatter
    has tags that are neither text nor a list, are left out; ``parse_failures`` counts them.
    """
    return _columns(files.filter("content is not null")).filter(~F.col("broken")).drop("broken")


def parse_failures(files: DataFrame) -> DataFrame:
    """One row: files that a scan skips though they are notes by name."""
    return _columns(files).agg(F.count_if(F.col("broken") | F.col("content_hash").isNull()).alias("failures"))


def _columns(files: DataFrame) -> DataFrame:
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    df = files.withColumn("raw_content", raw).withColumn("content_hash", F.sha2("content", 256))
    df = df.withColumn("_fm", parse.frontmatter(parse.frontmatter_text(F.col("raw_content")))).withColumn("_body", parse.body(F.col("raw_content")))
    df = df.withColumn("headings", parse.headings(F.col("_body")))
    return df.select(
        "relative_path",
        parse.title(F.col("_fm.title"), F.col("headings"), parse.stem(F.col("relative_path"))).alias("title"),
        "raw_content",
        F.col("_fm.fields").alias("frontmatter"),
        parse.tags(F.col("_fm.tags"), F.col("_body")).alias("tags"),
        parse.wikilinks(F.col("_body")).alias("wikilinks"),
        "headings",
        "content_hash",
        "file_size_bytes",
        "modified_at",
        parse.parsed_datetime(F.coalesce("_fm.created", "_fm.date")).alias("created_at"),
        F.col("_fm.broken").alias("broken"),
    )


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    return parsed(read_files(spark, root))


def scan_preview(notes: DataFrame) -> DataFrame:
    return notes.select("relative_path", "title", "tags", "wikilinks", F.size("headings").alias("heading_count"), "file_size_bytes", "content_hash")


def link_edges(notes: DataFrame) -> DataFrame:
    """source_path, target, pos: a row per wikilink."""
    return notes.select(F.col("relative_path").alias("source_path"), F.posexplode("wikilinks").alias("pos", "target"))


def backlinks(notes: DataFrame) -> DataFrame:
    """title, n_links, n_sources: links to each title that a note has."""
    titles = notes.select("title").distinct()
    e = link_edges(notes).withColumnRenamed("target", "title")
    return e.join(titles, "title", "left_semi").groupBy("title").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("source_path").alias("n_sources"))
