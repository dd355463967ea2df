"""Words, tokens and white space with the meaning they have in Python, as Column expressions.

Java's default ``\\s`` and ``trim`` know ASCII only; ``(?U)`` makes classes Unicode-aware.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space of Python's str.split and strip: Unicode white space and the four ASCII separators.
#: Spelled out, as Java matches its Unicode-aware ``\\s`` several times slower.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]"
#: The same characters, told first by two ranges that letters of ASCII fail at once, and one by one.
_RUN = rf"[\t-\x20\x85-\u3000&&{SPACE}]+"
_EACH_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

#: Words that keyword search leaves out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "that", "this", "it", "its", "i", "you",
    "he", "she", "we", "they", "not", "no", "as", "from", "into", "about",
    "if", "then", "so", "also", "just", "than", "more", "can", "their",
    "there", "when", "which", "who", "what", "how", "all", "any", "each",
    "up", "out", "use", "used", "using", "new", "one", "two", "get", "set",
)


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(_EACH_SPACE))


def right_stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(_EACH_SPACE))


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.array_remove(F.split(text, _RUN), "")


def word_count(text: Column) -> Column:
    """Number of ``words``. A split is several times faster than matching all characters that are no white space."""
    return F.array_size(words(text))


def keyword_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits that are whole words, without stop words and single characters.

    A word boundary lies between word characters of any script and others, so a run with another letter beside it
    is no whole word.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{M}\p{N}_])[a-z0-9]{2,}+(?![\p{L}\p{M}\p{N}_])"), F.lit(0))
    return F.filter(runs, lambda t: ~t.isin(*STOP_WORDS))


def estimated_tokens(text: Column) -> Column:
    """A token for every four characters, one at least; none for empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def truncated_to_tokens(text: Column, budget: Column) -> Column:
    """Cut to a token budget, at the last space where one lies in the second half, with an ellipsis."""
    limit = budget * 4
    head = F.substring(text, F.lit(1), limit)
    at = F.length(head) - F.instr(F.reverse(head), F.lit(" "))  # index of the last space
    has = F.instr(head, F.lit(" ")) > 0
    snapped = F.when(has & (at > F.floor(limit / 2)), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(estimated_tokens(text) <= budget, text).otherwise(F.concat(right_stripped(snapped), F.lit(" …")))


def given_back() -> None:
    """What a batch needed goes back to the system, so that a Python worker holds no more than one batch asks for."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _composed(t: str | None) -> str | None:
    return t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t)


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, for which Spark has no function."""
    for s in texts:
        yield s.map(_composed)
        del s
        given_back()


def excerpt(text: Column, n: int = 300) -> Column:
    return F.substring(text, 1, n)


def point_id(chunk_id: Column) -> Column:
    """A UUID's text from the first 32 hex digits."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(chunk_id, a, n) for a, n in cuts])


def chunk_id(note_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", note_id, index.cast("string")).cast("binary"), 256)


def python_fixed(score: Column, digits: int = 2) -> Column:
    """A double's text with so many digits, rounded on its exact binary value as Python formats it (``format_string``
    rounds half up on the shortest decimal)."""
    return F.call_function("format_number", score, F.lit("0." + "0" * digits))


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first of X-Forwarded-For, else the peer."""
    first = stripped(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", first).otherwise(F.coalesce(peer, F.lit("unknown")))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 in UTC as Python's isoformat writes it: without a fraction where there is none."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("+00:00"))
