"""Token counts of a unigram tokenizer, without building its tokens.

A text's parts begin at spaces, as the tokenizer's pre-tokenizer has it. In each part Aho-Corasick enumerates the
vocabulary's matches, and dynamic programming over positions carries the best score and its number of pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much less than the worst piece


def zipf_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with the log-probabilities of Zipf's law over their ranks; the files at hand
    have ranks only. Byte pieces and control pieces come first, with score 0; a text that spells one out
    (``<0x41>``) matches it, here as in the tokenizer."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    rank = {i: r for r, i in enumerate(plain)}
    return [(sp.id_to_piece(i), -math.log(rank[i] + 1) - norm if i in rank else 0.0) for i in range(n)]


class UnigramCounter:
    """Counts as ``tokenizers``' Unigram model with byte fallback and a Metaspace pre-tokenizer does.

    Its tie rules: among equal scores at a position the piece that begins first, that is the longest, stays; a
    character that is no piece may be taken as unknown, for which its UTF-8 bytes count.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], cached: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        pieces = dict(vocabulary)
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.cached, self.cache = cached, {}

    def part(self, text: str) -> int:
        """Number of tokens of one part, which begins with the space mark."""
        n = len(text)
        score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        at = 0  # positions up to here are settled
        unknown, singles = self.unknown, self.singles

        def lone(i: int) -> None:
            """A character that is no piece, after all pieces that end with it: it begins last."""
            c = text[i]
            if c not in singles:
                s = score[i] + unknown
                if s > score[i + 1]:
                    score[i + 1], count[i + 1] = s, count[i] + len(c.encode("utf-8", "surrogatepass"))

        for end, (length, s) in self.automaton.iter(text):
            while at < end:  # no match ends at these
                lone(at)
                at += 1
            i = end + 1 - length
            s += score[i]
            if s > score[end + 1]:
                score[end + 1], count[end + 1] = s, count[i] + 1
            if length == 1:
                at = end + 1
        while at < n:
            lone(at)
            at += 1
        return count[n]

    def count(self, text: str | None) -> int:
        """Number of tokens of a whole text; 0 for null and empty."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        parts = marked.split(SPACE)
        if not parts[0] and len(parts) > 1:  # the text begins with a space: no mark is put before it
            parts = parts[1:]
        cache = self.cache
        try:
            return sum(map(cache.__getitem__, parts))
        except KeyError:
            for p in set(parts).difference(cache):
                cache[p] = self.part(SPACE + p)
            total = sum(map(cache.__getitem__, parts))
            if len(cache) > self.cached:
                self.cache = {}
            return total


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_chars for every row, over whole texts; null and empty texts have 0 of both.

    Rows that repeat, and rows without doc_id, are counted like any other; other columns are ignored; an empty
    table gives no rows. Every task builds its automaton from the file once.
    """
    vocabulary = zipf_vocabulary(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary)
        for b in batches:
            n, chars = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for i, x in enumerate(b.column(1)):
                t = x.as_py() or ""
                n[i], chars[i] = counter.count(t), len(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(chars)], ["doc_id", "n_tokens", "n_chars"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
