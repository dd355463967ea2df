"""Chunks of a text by plain loops, to hold the expression against."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from notelake.operators.chunk import SEPARATORS


@dataclass
class _Level:
    """Pieces of a text that are still to be packed, what joins them, and the chunk that is open."""

    separator: str
    pieces: Iterator[str]
    rest: tuple[str, ...]  # narrower separators
    chunk: list[str] = field(default_factory=list)
    words: int = 0


def _cut(source: str, size: int, separators: tuple[str, ...]) -> _Level:
    """A text's pieces at the broadest separator that gives two or more; else runs of ``size`` words."""
    for i, separator in enumerate(separators):
        pieces = list(filter(str.strip, source.split(separator)))
        if len(pieces) > 1:
            return _Level(separator, iter(pieces), separators[i + 1 :])
    every = source.split()
    return _Level(" ", (" ".join(every[i : i + size]) for i in range(0, len(every), size)), ())


def packed_chunks(source: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of at most ``size`` words, in order. Levels of ever narrower separators lie on a stack: pieces join the
    open chunk of the innermost level while they fit; one that is too long by itself opens a level below; what is
    open when a level ends goes on as the open chunk of the level above."""
    if len(source.split()) <= size:
        yield from filter(None, [source.strip()])
        return
    levels = [_cut(source, size, separators)]
    while levels:
        top = levels[-1]
        piece = next(top.pieces, None)
        if piece is None:
            levels.pop()
            done = top.separator.join(top.chunk)
            if levels:
                levels[-1].chunk, levels[-1].words = [done], len(done.split())
            elif top.chunk:
                yield done
            continue
        n = len(piece.split())
        if top.words + n > size:
            if top.chunk:
                yield top.separator.join(top.chunk)
            top.chunk, top.words = [], 0
            if n > size:
                levels.append(_cut(piece, size, top.rest))
                continue
        top.chunk.append(piece)
        top.words += n
