"""Chunking does work in proportion to a note's length."""

import re

from pyspark.sql import functions as F

from notelake.config import Settings
from notelake.functions import text
from notelake.operators import chunk


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _notes(spark, body):
    return spark.createDataFrame([("h", "T", "p.md", ["t"], body)], "content_hash string, title string, relative_path string, tags array<string>, raw_content string")


def test_rows_of_chunks_leave_the_notes_chunks_behind(spark):
    c = chunk.chunked(_notes(spark, "a b\tc " * 400), Settings(chunk_size=50, chunk_overlap=8))
    assert re.search(r"Generate posexplode\(_all#\d+\), \[\d", _plan(c))
    rows = c.orderBy("chunk_index").collect()
    assert len(rows) > 20 and {r["total_chunks"] for r in rows} == {len(rows)}


def test_words_are_counted_by_splitting(spark):
    spaces = [chr(c) for c in range(0x3002) if chr(c).isspace()]
    texts = [f"{s}a{s}{s}b{s}" for s in spaces] + [f"a{chr(c)}b" for c in (*range(1, 0x100), 0x180E, 0x200B, 0x2060, 0x3001, 0xFEFF)] + ["", "　 \x1c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.word_count(F.col("t")).alias("n"), text.words(F.col("t")).alias("w"), text.stripped(F.col("t")).alias("s"), text.right_stripped(F.col("t")).alias("r"))
    assert "regexp" not in _plan(df.select("n"))
    for r in df.collect():
        assert (r["n"], r["w"], r["s"], r["r"]) == (len(r["t"].split()), r["t"].split(), r["t"].strip(), r["t"].rstrip()), repr(r["t"])


def test_null_texts_have_no_count(spark):
    r = spark.range(1).select(F.lit(None).cast("string").alias("t")).select(text.word_count(F.col("t")), text.words(F.col("t")), text.stripped(F.col("t"))).first()
    assert list(r) == [None, None, None]
