"""From a question to the messages of an answer: guard, retrieve, pack, prompt, ask, clean."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MOST_RESULTS, RetrievalQuery
from ..functions import context, guard
from ..operators import bm25
from ..session import ship
from ..sources.providers import ChatProvider, answered
from .retrieve import search_batch


def answer_context(index: DataFrame, questions: DataFrame, options: RetrievalQuery = RetrievalQuery(top_k=5), budget: int = 2000, keywords: bm25.KeywordIndex | None = None) -> DataFrame:  # noqa: B008
    """query_id, blocked, clean, context_str, included, total_tokens, was_truncated, messages for questions
    (query_id, text, vector, and optionally history: array of role and content).

    Blocked questions get no context; those that find nothing have null context and messages.
    """
    if options.top_k > MOST_RESULTS["answer"]:
        raise ValueError(f"an answer takes at most {MOST_RESULTS['answer']} chunks")
    ship(index.sparkSession)
    checked = guard.validated_queries(questions, "text")
    asked = checked.filter("not blocked").select("query_id", F.col("clean").alias("text"), "vector")
    found = guard.sanitized_chunks(search_batch(index, asked, options, keywords).chunks)
    packed = context.built_context(found, budget)
    out = checked.select("query_id", "blocked", "clean", *(["history"] if "history" in questions.columns else [])).join(packed, "query_id", "left")
    history = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")) if "history" in questions.columns else F.array().cast("array<struct<role:string,content:string>>")
    prompt = context.question_prompt(F.col("context_str"), F.col("clean"))
    return out.withColumn("messages", F.when(F.col("context_str").isNotNull(), context.assembled_messages(history, prompt))).drop("history")


def answers(contexts: DataFrame, provider: ChatProvider) -> DataFrame:
    """Adds ``answer``: the provider's, without leaked text; a fixed text where there was no context; null where
    the question was blocked."""
    asked = contexts.withColumn("_a", F.when(F.col("messages").isNotNull(), answered(F.col("messages"), provider)))
    clean = guard.sanitized_output(F.coalesce("_a", F.lit(context.NO_ANSWER)))["text"]
    return asked.withColumn("answer", F.when(~F.col("blocked"), clean)).drop("_a")


def assemble_chat(sessions: DataFrame, keep: int = 20) -> DataFrame:
    """session_id and messages of the plain chat: system text, up to ``keep`` - 1 messages before the last one (of
    the last ``keep`` in all), and the last one. ``sessions``: session_id, seq, role, content."""
    ordered = sessions.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("_m"))
    kept = F.slice("_m", F.greatest(F.size("_m") - keep + 1, F.lit(1)), keep)
    plain = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    before = F.slice(plain, 1, F.size(plain) - 1)
    last = F.element_at(plain, -1)["content"]
    return ordered.select("session_id", context.assembled_messages(before, last).alias("messages"))


def stream_answer(retrieved: DataFrame, messages: list[dict[str, str]], provider: ChatProvider) -> Iterator[dict]:
    """Events of one streamed answer: the sources, deltas, done; or an error. Runs on the driver over a page of
    results."""
    rows = retrieved.orderBy("rank").select("rank", "note_title", "note_path", "score").collect()
    yield {"type": "retrieval", "candidate_count": len(rows), "sources": [r.asDict() for r in rows]}
    try:
        for d in provider.stream(messages):
            if d["delta"]:
                yield {"type": "delta", "delta": d["delta"], "done": False}
        yield {"type": "done", "done": True}
    except Exception as e:  # noqa: BLE001 - the stream tells its failure
        yield {"type": "error", "error": str(e), "done": True}
