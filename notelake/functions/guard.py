"""Screening of queries, chunks and answers: sanitising, risk scoring, redaction, audit events."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import SYSTEM_TEXT
from .text import given_back, nfkc, stripped

CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
FILTERED = "[FILTERED]"
FILTERED_ANSWER = "[FILTERED: system information]"

#: Patterns by tier, (label, pattern), matched without case.
HIGH = (
    ("jailbreak", r"\bjailbreak\b"),
    ("DAN_mode", r"\b(DAN|do\s+anything\s+now)\b"),
    ("memory_dump", r"\bdump\s+(memory|context|state|config)\b"),
    ("prompt_reveal", r"\breveal\s+(your|the|this)\s+(system\s+)?prompt\b"),
    ("prompt_expose", r"\byour\s+(system\s+)?prompt\s+(is|was|says?|contains?)\b"),
)
MEDIUM = (
    ("ignore_instructions", r"\bignore\s+(all\s+|previous\s+|your\s+)instructions\b"),
    ("override_instructions", r"\b(forget|override|bypass)\s+(your\s+|all\s+|the\s+)?instructions\b"),
    ("from_now_on", r"\bfrom\s+now\s+on\s+(you\s+)?(are|ignore|pretend|forget)\b"),
    ("developer_mode", r"\bdeveloper\s+(mode|override)\b"),
    ("evil_persona", r"\bact\s+as\s+(if\s+you\s+are\s+|an?\s+)?(evil|unrestricted|uncensored|unfiltered)\b"),
    ("no_restrictions", r"\bpretend\s+(you\s+have\s+no|there\s+are\s+no)\s+(restrictions?|rules?|limits?)\b"),
    ("new_instructions", r"\byour\s+new\s+instructions\b"),
)
LOW = (
    ("system_prompt_ref", r"\bsystem\s+prompt\b"),
    ("ignore_above", r"\bignore\s+(all\s+)?above\b"),
    ("hidden_content", r"\bhidden\s+(instructions?|prompt|config)\b"),
    ("your_instructions", r"\byour\s+instructions\b"),
)
CHUNK_ONLY = (
    ("embedded_header", r"(?md)^\s*#{1,3}\s*new\s+instructions?\s*:"),
    ("llama_inst_tag", r"\[INST\]"),
    ("system_tag", r"<\|system\|>|<\|im_start\|>\s*system"),
    ("xml_inst_tag", r"<instructions?>"),
)


#: Of each pattern, texts of which it can't match without one, in lower case.
_NEEDS = {
    "jailbreak": ("jailbreak",), "DAN_mode": ("dan", "anything"), "memory_dump": ("dump",), "prompt_reveal": ("reveal",), "prompt_expose": ("prompt",), "ignore_instructions": ("ignore",), "override_instructions": ("instructions",),
    "from_now_on": ("now",), "developer_mode": ("developer",), "evil_persona": ("evil", "unrestricted", "uncensored", "unfiltered"), "no_restrictions": ("pretend",), "new_instructions": ("instructions",), "system_prompt_ref": ("prompt",),
    "ignore_above": ("ignore",), "hidden_content": ("hidden",), "your_instructions": ("instructions",), "embedded_header": ("instruction",), "llama_inst_tag": ("[inst]",), "system_tag": ("<|system|>", "<|im_start|>"), "xml_inst_tag": ("<instruction",),
}


def _clauses(prompt: str) -> list[str]:
    """Patterns of a prompt's clauses of three words or more, whatever the white space between the words."""
    clauses = [c.split() for c in re.split(r"[,.;:!?]", prompt)]
    return [r"\s+".join(map(re.escape, c)) for c in clauses if len(c) > 2]


#: What an answer must not give away: clauses of this library's system text, and talk of one's own instructions.
LEAKS = (
    *_clauses(SYSTEM_TEXT),
    # The two that follow.
    r"\bmy\s+(system\s+)?instructions?\s+(are|say|include|were?|is)\b",
    r"\bI\s+(was|am|have\s+been)\s+instructed\s+to\b",
)


_LEAK_NEEDS = (*((max(re.findall(r"[a-z]+", c), key=len),) for c in map(str.lower, (x.replace(r"\s+", " ") for x in LEAKS[:-2]))), ("instruction",), ("instructed",))


def _any_case(pattern: str) -> str:
    return "(?iU)" + pattern


def _hits(needs: list[tuple[str, ...]]) -> Callable[[Column], Column]:
    """Places in ``needs`` of those of whose texts one is in a text, without case. One automaton finds the texts that
    have any; only these are looked at for each."""
    # beside what case folding makes equal, i matches two letters more
    each = ["|".join(re.escape(w).replace("i", "[i\u0131\u0130]") for w in ws) for ws in needs]

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        given_back()
        out = np.zeros((len(texts), len(each)), dtype=bool)
        some = pc.match_substring_regex(texts, "|".join(each), ignore_case=True).fill_null(False)
        at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
        left = texts.take(pa.array(at))
        for i, p in enumerate(each):
            out[at, i] = pc.match_substring_regex(left, p, ignore_case=True).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(out.sum(axis=1))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(out)[1], pa.int32()))

    return found


def _possible(text: Column, rows: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """Array of (name, pattern) of the rows (name, pattern, needed texts) that a text has one of the needed texts for."""
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_any_case(p)).alias("pattern")) for n, p, _ in rows])
    return F.transform(_hits([w for _, _, w in rows])(text), lambda i: F.get(every, i))


def _replaced(text: Column, possible: Column, mark: str) -> Column:
    """One possible pattern after the other is replaced, on what is left."""
    return F.aggregate(possible, text, lambda t, r: F.regexp_replace(t, r["pattern"], F.lit(mark)))


def _matched(text: Column, possible: Column) -> Column:
    return F.transform(F.filter(possible, lambda r: F.rlike(text, r["pattern"])), lambda r: r["name"])


def _tiers(context: str) -> list[tuple[str, str, tuple[str, ...]]]:
    tiers = [("high", HIGH), ("medium", MEDIUM), ("low", LOW)] + ([("high", CHUNK_ONLY)] if context == "chunk" else [])
    return [(f"{tier}:{label}", p, _NEEDS[label]) for tier, rows in tiers for label, p in rows]


def sanitized(text: Column, max_length: int = 4000, normalise: bool = True) -> Column:
    """(text, was_truncated, had_control_chars): normalised, without control characters and white space at the
    ends, and cut."""
    source = nfkc(text) if normalise else text
    clean = stripped(F.regexp_replace(source, CONTROLS, ""))
    return F.struct(
        F.substring(clean, 1, max_length).alias("text"),
        (F.length(clean) > max_length).alias("was_truncated"),
        source.rlike(CONTROLS).alias("had_control_chars"),
    )


def matched_patterns(text: Column, context: str = "query") -> Column:
    """Labels ``tier:name`` of the patterns found, tier by tier."""
    return _matched(text, _possible(text, _tiers(context)))


def risk_level(matched: Column) -> Column:
    """The highest tier found; two low ones make medium."""
    has = lambda tier: F.exists(matched, lambda m: m.startswith(tier))
    lows = F.size(F.filter(matched, lambda m: m.startswith("low:")))
    return F.when(F.size(matched) == 0, "none").when(has("high:"), "high").when(has("medium:") | (lows >= 2), "medium").otherwise("low")


def _not_low(possible: Column) -> Column:
    return F.filter(possible, lambda r: ~r["name"].startswith("low:"))


def redacted(text: Column, context: str = "query") -> Column:
    """Spans of high, then medium, then chunk-only patterns are replaced; low ones stay."""
    return _replaced(text, _not_low(_possible(text, _tiers(context))), FILTERED)


def screened(df: DataFrame, column: str, context: str = "query") -> DataFrame:
    """Adds matched_patterns, risk_level, is_suspicious and sanitized_text."""
    text = F.col(column)
    df = df.withColumn("_possible", _possible(text, _tiers(context)))
    df = df.withColumn("matched_patterns", F.when(F.size("_possible") > 0, _matched(text, F.col("_possible"))).otherwise(F.array().cast("array<string>")))
    suspicious = F.size("matched_patterns") > 0
    return df.withColumns({
        "risk_level": risk_level(F.col("matched_patterns")),
        "is_suspicious": suspicious,
        "sanitized_text": F.when(suspicious, _replaced(text, _not_low(F.col("_possible")), FILTERED)).otherwise(text),
    }).drop("_possible")


def validated_queries(df: DataFrame, column: str, max_length: int = 4000, normalise: bool = True) -> DataFrame:
    """Adds ``clean`` and ``blocked``: sanitised queries, redacted where suspicious; high risk is blocked."""
    s = df.withColumn("_s", sanitized(F.col(column), max_length, normalise))
    s = screened(s.withColumn("_t", F.col("_s.text")), "_t")
    clean = F.when(F.col("is_suspicious"), F.col("sanitized_text")).otherwise(F.col("_t"))
    return s.withColumns({"blocked": F.col("risk_level") == "high", "clean": clean, "was_truncated": F.col("_s.was_truncated"), "had_control_chars": F.col("_s.had_control_chars")}).drop("_s", "_t")


def sanitized_chunks(df: DataFrame, column: str = "chunk_text") -> DataFrame:
    """Replaces suspicious spans of chunks; never leaves a chunk out."""
    out = screened(df, column, "chunk")
    return out.withColumn(column, F.col("sanitized_text")).drop("sanitized_text")


def sanitized_output(text: Column) -> Column:
    """(text, was_sanitized): leaked spans are replaced one pattern after the other, on what is left."""
    out = _replaced(text, _possible(text, [("", p, w) for p, w in zip(LEAKS, _LEAK_NEEDS, strict=True)]), FILTERED_ANSWER)
    return F.struct(out.alias("text"), (out != text).alias("was_sanitized"))


def audit_events(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Events (event, risk_level, n_patterns, patterns, preview) of screened rows that are suspicious."""
    return df.filter("is_suspicious").select(
        F.lit(kind).alias("event"), "risk_level", F.size("matched_patterns").alias("n_patterns"), F.array_join("matched_patterns", ",").alias("patterns"), F.substring(text, 1, 50).alias("preview")
    )


def blocked_events(df: DataFrame, text: str) -> DataFrame:
    """Events of validated queries that were blocked."""
    return df.filter("blocked").select(F.lit("query_blocked").alias("event"), "risk_level", F.size("matched_patterns").alias("n_patterns"), F.substring(text, 1, 50).alias("preview"))


def output_events(df: DataFrame, text: str) -> DataFrame:
    """Events of answers from which leaked spans were taken."""
    possible = _possible(F.col(text), [(str(i), p, w) for i, (p, w) in enumerate(zip(LEAKS, _LEAK_NEEDS, strict=True))])
    found = F.filter(possible, lambda r: F.rlike(F.col(text), r["pattern"]))
    return df.withColumn("_p", found).filter(F.size("_p") > 0).select(F.lit("output_sanitized").alias("event"), F.size("_p").alias("n_patterns"), F.substring(text, 1, 50).alias("preview"))


def limit_events(limited: DataFrame, key: str, policy: str) -> DataFrame:
    """Events of requests that a rate limit refused (column ``allowed``)."""
    return limited.filter(~F.col("allowed")).select(F.lit("rate_limited").alias("event"), F.lit(policy).alias("policy"), F.col(key).alias("key"))


def as_json_log(df: DataFrame) -> DataFrame:
    """One JSON object per row, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
