"""Context blocks, budgets, prompts and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import estimated_tokens, python_fixed, truncated_to_tokens

RULE = "─" * 68  # fixed value: the line under a citation's header
LEAST_TOKENS = 50  # fixed value: a chunk is cut only if so many tokens are left for its body
BREADCRUMB = r"^\[Note:[^\]]*\]\n\n"

#: Prefix of model names, context window, and budgets of system text, context and response, in tokens.
MODELS = (
    ("qwen2.5", 32768, 500, 6000, 2048),
    ("llama3", 8192, 400, 3000, 1024),
    ("mistral", 8192, 400, 3000, 1024),
    ("phi3", 4096, 300, 1500, 512),
    ("gemma", 8192, 400, 3000, 1024),
    ("deepseek", 32768, 500, 6000, 2048),
    ("default", 4096, 300, 1500, 512),
)
SYSTEM_TEXT = "You answer questions from the excerpts of notes that you are given, cite them by number, and say so when they hold no answer."
NO_ANSWER = "No notes were found that answer this."


def without_breadcrumb(text: Column) -> Column:
    return F.regexp_replace(text, BREADCRUMB, "")


def citation_header(number: Column, title: Column, path: Column, score: Column) -> Column:
    """``[n] title — section > section  (score: 0.00)``."""
    rest = F.array_join(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), " > ")
    place = F.when(F.size(path) > 1, F.concat(F.lit(" — "), rest)).otherwise(F.lit(""))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), title, place, F.lit("  (score: "), python_fixed(score), F.lit(")"))


def context_blocks(ranked: DataFrame, budget: int | Column = 2000) -> DataFrame:
    """The blocks (query_id, rank, block, block_tokens, was_cut) of ranked chunks (query_id, rank, note_title,
    heading_path, score, chunk_text) that fit a budget of tokens.

    Blocks are taken in order while they fit. The first that doesn't is cut if enough is left for its body; all
    after it are left out.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    order = W.partitionBy("query_id").orderBy("rank")
    df = ranked.withColumn("_n", F.row_number().over(order)).withColumn("_head", citation_header(F.col("_n"), F.col("note_title"), F.col("heading_path"), F.col("score")))
    df = df.withColumn("_head", F.concat("_head", F.lit(f"\n{RULE}\n"))).withColumn("_body", without_breadcrumb(F.col("chunk_text")))
    df = df.withColumn("_full", F.concat("_head", "_body")).withColumn("_t", estimated_tokens(F.col("_full")))
    df = df.withColumn("_sum", F.sum("_t").over(order.rowsBetween(W.unboundedPreceding, 0)))
    over = (F.col("_sum") > limit).cast("int")
    df = df.withColumn("_over", F.sum(over).over(order.rowsBetween(W.unboundedPreceding, 0)))
    left = limit - (F.col("_sum") - F.col("_t")) - estimated_tokens(F.col("_head"))
    df = df.withColumn("_left", left).filter((F.col("_over") == 0) | ((F.col("_over") == 1) & (F.col("_sum") > limit) & (F.col("_left") >= LEAST_TOKENS)))
    cut = F.concat("_head", truncated_to_tokens(F.col("_body"), F.col("_left").cast("int")))
    df = df.withColumn("block", F.when(F.col("_over") == 0, F.col("_full")).otherwise(cut))
    return df.select("query_id", "rank", "block", estimated_tokens(F.col("block")).alias("block_tokens"), (F.col("_over") > 0).alias("was_cut"))


def built_context(ranked: DataFrame, budget: int | Column = 2000) -> DataFrame:
    """query_id, context_str, included, total_tokens, was_truncated: blocks joined by blank lines, which no budget
    counts."""
    b = context_blocks(ranked, budget).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_b"), F.count(F.lit(1)).alias("included"), F.sum("block_tokens").alias("total_tokens"), F.max("was_cut").alias("was_truncated")
    )
    return b.select("query_id", F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n").alias("context_str"), "included", "total_tokens", "was_truncated")


def matched_config(models: DataFrame, column: str = "model") -> DataFrame:
    """Adds the budgets of the first family that a model's name begins with, else the default's."""
    fields = ("family", "context_window", "system_budget", "context_budget", "response_budget")
    entry = lambda m: F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, m, strict=True)])
    chosen = entry(MODELS[-1])
    for m in reversed(MODELS[:-1]):
        chosen = F.when(F.startswith(F.col(column), F.lit(m[0])), entry(m)).otherwise(chosen)
    return models.withColumn("_m", chosen).select("*", "_m.*").drop("_m")


def question_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Excerpts of notes:\n\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer from the excerpts and cite them by number."))


def refine_prompt(question: Column, answer: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer so far: "), answer, F.lit("\nFurther excerpts:\n\n"), context, F.lit("\nImprove the answer if they help; else repeat it."))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def assembled_messages(history: Column, user: Column, system: str = SYSTEM_TEXT, keep: int = 20) -> Column:
    """System message, the last ``keep`` of the history (array of role, content), and the user's."""
    last = F.slice(history, F.greatest(F.size(history) - keep + 1, F.lit(1)), keep)
    return F.concat(F.array(message("system", F.lit(system))), last, F.array(message("user", user)))


def sse(event: Column) -> Column:
    """A server-sent event of a struct."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def sse_events(text: Column, schema: str) -> Column:
    """The events of a buffer; blank lines, other lines, ``[DONE]`` and what is no JSON are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("data: "))
    data = F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(7), F.length(x)))), lambda x: (x != "") & (x != "[DONE]"))
    return F.filter(F.transform(data, lambda x: F.from_json(x, schema)), lambda e: e.isNotNull())
