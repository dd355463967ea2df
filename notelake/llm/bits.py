"""Bit-sliced comparison of fingerprints."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONES = _U(0xFFFFFFFFFFFFFFFF)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: bit j of word i of row p is bit p of fingerprint 64 i + j. (bits, ceil(n / 64)) uint64 of (n,) or,
    for fingerprints of several words, (n, words) uint64."""
    n = len(fps)
    padded = np.zeros((-(-n // 64) * 64, *fps.shape[1:]), dtype="<u8")
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, sliced: np.ndarray, radius: int, order: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """For each query, a bit per fingerprint of the block: at most ``radius`` bits differ. (q, words) uint64.

    A carry-save counter of bit_length(radius) planes counts the differing bits of 64 distances per word;
    distances past its range stay marked as over. Words in which every distance is over are abandoned.
    ``queries``: (q,) or (q, words); ``order``: the planes, those that tell most first. ``own``: positions of the queries in the block, which don't count as near.
    """
    width, live = max(1, radius.bit_length()), np.arange(sliced.shape[1])
    shape = (len(queries), len(live))
    count = [np.zeros(shape, dtype=_U) for _ in range(width)]
    over = np.zeros(shape, dtype=_U)
    if own is not None:
        over[np.arange(len(own)), own >> 6] |= _U(1) << (own & 63).astype(_U)
    near = np.zeros(shape, dtype=_U)
    queries = queries.reshape(len(queries), -1)
    for step, p in enumerate(order.tolist()):
        ask = np.where((queries[:, p >> 6] >> _U(p & 63)) & _U(1), _ONES, _U(0))
        carry = sliced[p][None, live] ^ ask[:, None]
        for c in count:
            c ^= carry  # the sum bit; what was set and is now clear carries on
            carry &= ~c
        over |= carry
        if step >= 2 * radius and step % (4 if len(order) == 64 else 32) == 3:
            open_ = (over != _ONES).any(axis=0)
            if not open_.any():
                return near
            if open_.sum() * 2 <= len(live):
                live, over, count = live[open_], over[:, open_], [np.ascontiguousarray(c[:, open_]) for c in count]
    if radius + 1 < 1 << width:  # the counter's range passes the radius: compare its value with the radius
        more, same = np.zeros(over.shape, dtype=_U), np.full(over.shape, _ONES)
        for k in reversed(range(width)):
            bit = _ONES if radius >> k & 1 else _U(0)
            more |= same & count[k] & ~bit
            same &= ~(count[k] ^ bit)
        over |= more
    near[:, live] = ~over
    return near
