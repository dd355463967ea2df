"""Models behind functions: embeddings and chat, with retries. No network is assumed; a hashing embedder and an
extractive answerer stand in."""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

R = TypeVar("R")


class Unavailable(RuntimeError):
    """A provider could not be reached."""


def with_retries(call: Callable[[], R], attempts: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> R:
    """Calls until it succeeds; only connection errors are tried again, after base * 2 ** n seconds."""
    for n in range(attempts):
        try:
            return call()
        except (ConnectionError, TimeoutError) as e:
            if n == attempts - 1:
                raise Unavailable(str(e)) from e
            sleep(base * 2**n)
    raise Unavailable("no attempts")


class EmbeddingProvider(ABC):
    size: int

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


class HashingEmbedder(EmbeddingProvider):
    """Deterministic vectors: each lower-cased word adds 1 or -1 to a hashed coordinate; unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


def embedded_or_failed(text: Column, provider: EmbeddingProvider, batch: int = 32) -> Column:
    """(vector, error) of texts, ``batch`` a call: a call that fails for good leaves its own texts without a vector."""

    @F.pandas_udf("vector array<float>, error string")
    def embed(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in chunks:
            vectors: list = []
            errors: list = []
            for i in range(0, len(s), batch):
                part = s.iloc[i : i + batch].fillna("").tolist()
                try:
                    vectors += with_retries(lambda part=part: provider.embed_batch(part))
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001 - a failed call is reported, the others go on
                    vectors += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            yield pd.DataFrame({"vector": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return embed.asNondeterministic()(text)


class ChatProvider(ABC):
    @abstractmethod
    def chat(self, messages: list[dict[str, str]]) -> str: ...

    def stream(self, messages: list[dict[str, str]]) -> Iterator[dict]:
        """Deltas of an answer; a failure midway ends the stream with done."""
        try:
            for word in re.findall(r"\S+\s*", self.chat(messages)):
                yield {"delta": word, "done": False}
        finally:
            yield {"delta": "", "done": True}


class ExtractiveChat(ChatProvider):
    """Answers with the first sentence of the context in the last message."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        body = messages[-1]["content"].split("─" * 68 + "\n")[-1]
        return re.split(r"(?<=[.!?])\s", body.strip(), maxsplit=1)[0]


def answered(messages: Column, provider: ChatProvider) -> Column:
    """Answers to arrays of (role, content), a call a row, with retries."""

    @F.pandas_udf("string")
    def ask(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda m: None if m is None else with_retries(lambda: provider.chat([dict(x) for x in m])))

    return ask(messages)
