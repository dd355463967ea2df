"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, chat, counts, late_sessions, mixing, packing, quality, simhash, simple8b, spelling, templates, urls, warc
from .oracle import ORACLE  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file for the queries; operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("embedding"), F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_per_document(_table(spark, sf_dir, "documents"))


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = simple8b.write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return simple8b.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], schema)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    back = chat.parse_chats(made)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "media_tokens",
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(_table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.main_texts(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").filter("turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"))
    crc = lambda text: F.crc32(text.cast("binary"))
    df = turns.withColumn("c", crc(F.col("conv_id").cast("string"))).withColumn("h", crc(F.concat_ws(":", "conv_id", "turn")))
    div = late_sessions.floor_div
    df = df.withColumn("g", div(F.col("h"), 600)).withColumn("time", div(F.col("c"), 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600)
    late = F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)
    user = 2 * div(F.col("conv_id"), 8) + F.col("c") % 2
    events = df.select(user.alias("user"), "time", (div(F.col("time"), 900) + late).alias("batch"), F.col("h").alias("value"))
    out = late_sessions.session_versions(events)
    return out.withColumnsRenamed({"start": "start_s", "end": "end_s", "total": "h_sum", "retracted_start": "retracted_start_s"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_cross_polytope, op2_mixing, op3_simple8b, op4_simhash, op5_token_counts, op6_chat, op7_quality, op8_urls, op9_packing, op10_warc, op11_spelling, op12_html, op13_late_sessions)}
