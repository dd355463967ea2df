"""Token ids of whole texts by a tokenizers file, in steps over arrays, with a bounded cache of the texts' parts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: ASCII white space; the first bytes of UTF-8 characters of which some are white space.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MAYBE = np.zeros(256, dtype=bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: First bytes of characters that are surely not white space, and those of ASCII.
_SURE = np.zeros(256, dtype=bool)
_SURE[0x21:0x7F] = True
_INK = _SURE.copy()
_SURE[0xC3:0xF5] = True
_SURE &= ~_MAYBE
#: ASCII letters; ASCII punctuation but the apostrophe, which may belong with the letters after it.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = _INK & ~_LETTER
_POINT[[0x27, *range(0x30, 0x3A)]] = False
#: Of a byte: 1 for white space, 2 for such punctuation.
_KINDS = bytes(1 if w else 2 if p else 0 for w, p in zip(_WHITE.tolist(), _POINT.tolist(), strict=True))
#: Parts of up to as many bytes are cached; a key is the part itself, zeros after it, in two words.
_KEY = 16
_KEEP = np.array([[(1 << 8 * min(8, max(0, n - 8 * w))) - 1 for w in range(2)] for n in range(_KEY + 1)], dtype=np.uint64)
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
#: Bytes of texts that are taken apart at a time.
_STEP = 1 << 19


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of ``counts[0]`` items, then those of the next run."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def ink_at(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that is surely not white space begins at each place of the bytes; false where in doubt.
    ``b`` goes on for two bytes after the last place."""
    c = b[at]
    ok = _SURE[c]
    odd = np.flatnonzero(_MAYBE[c])
    if len(odd):
        c, d, e = c[odd], b[at[odd] + 1], b[at[odd] + 2]
        ok[odd] = np.select(
            [c == 0xC2, c == 0xE1, c == 0xE2],
            [(d != 0x85) & (d != 0xA0), (d != 0x9A) & (d != 0xA0), ~(((d == 0x80) & ((e <= 0x8F) | ((e >= 0xA8) & (e <= 0xAF)))) | ((d == 0x81) & (e == 0x9F)))],
            ~((d == 0x80) & (e == 0x80)),
        )
    return ok


class _Table:
    """Ids of parts by open addressing: rows of two key words and a word with the ids' place and number (+ 1). It doubles
    as it fills, up to ``limit`` bytes, past which it begins anew."""

    def __init__(self, limit: int, small: bool):
        self.limit, self.kind = limit, "<u2" if small else "<u4"
        self.clear()

    def clear(self) -> None:
        self.bits, self.rows = 14, np.zeros((1 << 14, 3), dtype=np.uint64)
        self.ids, self.used, self.parts = np.zeros(1 << 14, dtype=self.kind), 0, 0

    def nbytes(self) -> int:
        return self.rows.nbytes + self.ids.nbytes

    def full(self) -> bool:
        """No more parts fit without passing the limit."""
        return self.parts * 5 > 3 << self.bits and 2 * self.rows.nbytes + self.ids.nbytes > self.limit

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _MIX[0] ^ (keys[:, 1] + _MIX[1]) * _MIX[2]
        h ^= h >> _U(29)
        return ((h * _MIX[0]) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The word of each key; 0 where it isn't there."""
        slot = self._slots(keys)
        rows = self.rows[slot]
        hit = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1])
        out = np.where(hit, rows[:, 2], _U(0))
        live = np.flatnonzero(~hit & (rows[:, 2] != 0))
        slot = slot[live]
        while len(live):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            rows, own = self.rows[slot], keys[live]
            hit = (rows[:, 0] == own[:, 0]) & (rows[:, 1] == own[:, 1])
            out[live[hit]] = rows[hit, 2]
            on = ~hit & (rows[:, 2] != 0)
            live, slot = live[on], slot[on]
        return out

    def put(self, keys: np.ndarray, words: np.ndarray) -> None:
        """Adds keys that are not there, each once; none past the limit."""
        while (self.parts + len(keys)) * 5 > 3 << self.bits and (2 * self.rows.nbytes + self.ids.nbytes <= self.limit or self.bits < 15):
            had = self.rows[self.rows[:, 2] != 0]
            self.bits += 1
            self.rows = np.zeros((1 << self.bits, 3), dtype=np.uint64)
            self._put(had[:, :2], had[:, 2])
        if (self.parts + len(keys)) * 10 <= 9 << self.bits:
            self._put(keys, words)
            self.parts += len(keys)

    def _put(self, keys: np.ndarray, words: np.ndarray) -> None:
        live, slot = np.arange(len(keys)), self._slots(keys)
        while len(live):
            free = np.flatnonzero(self.rows[slot, 2] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.rows[slot[won], :2], self.rows[slot[won], 2] = keys[live[won]], words[live[won]]
            on = np.ones(len(live), dtype=bool)
            on[won] = False
            live, slot = live[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def add_ids(self, ids: np.ndarray, keep: bool) -> int:
        """Puts ids into the buffer and gives their place; unless kept, the next ids overwrite them."""
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(ids)), dtype=self.kind)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        at = self.used
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids) * keep
        return at


def takes_parts(tokenizer) -> bool:
    """Whether a tokenizer's own configuration lets a text be taken apart at white space: byte-level BPE without a
    normalizer, whose pre-tokenizer is the byte-level pattern alone and puts no space before a text."""
    t = json.loads(tokenizer.to_str())
    m, p = t["model"], t.get("pre_tokenizer") or {}
    plain = m.get("type") == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    split = p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space", True)
    alone = not any(t.get(k) for k in ("normalizer", "truncation", "padding"))
    return plain and split and alone and not any(a["content"].split() != [a["content"]] for a in t.get("added_tokens", ()))


class BpeEncoder:
    """Encodes texts to unsigned 32-bit ids with the ``tokenizers`` library: those of ``encode(text,
    add_special_tokens=False)`` for any tokenizer file.

    Where the file's own configuration is that of byte-level BPE (``takes_parts``), texts are cut at white space where
    the pre-tokenizer's pattern surely ends a match and looks no further: before white space that follows an ASCII
    character; before the white space that a surely visible character follows, and after it unless it is a space; and
    between an ASCII letter and ASCII punctuation other than an apostrophe. Ids
    of parts are cached; new parts are encoded many at a time in one text, and the ids are told apart by their bytes,
    which have to end where the parts do, else ValueError. Texts that hold an added token's string are encoded whole, and
    so are all texts of other tokenizers. ``cache_bytes`` bounds the cache; it bears on speed only.
    """

    def __init__(self, path: str, cache_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = takes_parts(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # bytes of an id of byte-level BPE, a character of the vocabulary each
        self.newline = vocabulary.get("Ċ", -1)
        self.table = _Table(cache_bytes, len(self.lengths) <= 1 << 16)

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) for runs of the column's texts in their order; a null text is empty. A run
        has about ``_STEP`` bytes of texts, or one text."""
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _STEP, side="right")) - 1)
            yield self._run(column.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end

    def _run(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            whole = np.zeros(len(texts), dtype=bool)
            for token in self.added:
                whole |= pc.match_substring(texts, token.encode()).to_numpy(zero_copy_only=False)
            if not whole.any():
                return self._cut(data, offsets)
        else:
            whole = np.ones(len(texts), dtype=bool)
        ids, counts = [], []
        for i in range(len(texts)):  # few: texts with an added token, and their neighbours in the run
            if whole[i]:
                got = self._library(texts[i].as_py().decode("utf-8", "replace"))
            else:
                got, _ = self._cut(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            ids.append(got)
            counts.append(len(got))
        return np.concatenate(ids), np.array(counts, dtype=np.int64)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes texts apart, a window at a time; a part that a window's end cuts is finished in a later one."""
        size = len(data)
        b = np.zeros(size + 2 * _KEY, dtype=np.uint8)
        b[:size] = data
        text_starts, out, places, counts = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]), [], [], []
        open_ = 0
        for a in range(0, size, _STEP):
            z = min(size, a + _STEP)
            starts = self._starts(b, a, z, text_starts, size)
            if a > open_ or not len(starts):
                starts = np.r_[open_, starts[starts > open_]]
            if z < size:
                starts, ends, open_ = starts[:-1], starts[1:], int(starts[-1])
            else:
                ends = np.r_[starts[1:], size]
            if len(starts):
                ids, n = self._parts(b, starts, ends - starts)
                out.append(ids)
                places.append(starts)
                counts.append(n)
        if not out:
            return np.empty(0, dtype="<u4"), np.zeros(len(offsets) - 1, dtype=np.int64)
        ids, before = np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(counts))]
        return ids, np.diff(before[np.searchsorted(np.concatenate(places), offsets)])

    @staticmethod
    def _starts(b: np.ndarray, a: int, z: int, text_starts: np.ndarray, size: int) -> np.ndarray:
        """Where parts begin in the bytes from a to z of the texts."""
        mark = np.zeros(z - a + 1, dtype=bool)
        kinds = np.frombuffer(b[a:z].tobytes().translate(_KINDS), dtype=np.uint8)
        some = np.flatnonzero(kinds)
        is_white = kinds[some] == 1
        white, point = some[is_white] + a, some[~is_white] + a
        mark[text_starts[np.searchsorted(text_starts, a) : np.searchsorted(text_starts, z)] - a] = True
        mark[white[_INK[b[white - 1]]] - a] = True  # what precedes a text's first byte only marks its start again
        mark[point[_LETTER[b[point - 1]]] - a] = True
        # the last byte of a text is followed by nothing
        ends = np.r_[text_starts[1:], size] - 1
        near = ends[np.searchsorted(ends, a) : np.searchsorted(ends, z)]
        last = np.zeros(len(white), dtype=bool)
        if len(white) and len(near):
            i = np.minimum(np.searchsorted(white, near), len(white) - 1)
            last[i[white[i] == near]] = True
        followed = white[~last]
        followed = followed[ink_at(b, followed + 1)]
        mark[followed - a] = True
        mark[followed[b[followed] != 32] + 1 - a] = True
        # the start that lies just past z belongs to the next window, which finds it by the byte before it
        if a and _WHITE[b[a - 1]] and b[a - 1] != 32 and ink_at(b, np.array([a]))[0] and not (ends == a - 1).any():
            mark[0] = True
        return np.flatnonzero(mark[: z - a]) + a

    def _parts(self, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, and the number of ids of each."""
        short = lengths <= _KEY
        zero = np.flatnonzero(b[starts[0] : starts[-1] + lengths[-1]] == 0)
        if len(zero):  # a key's zeros would be the part's
            short[np.searchsorted(starts, zero + starts[0], side="right") - 1] = False
        at = np.flatnonzero(short)
        windows = np.lib.stride_tricks.sliding_window_view(b, _KEY)
        keys = windows[starts[at]].view("<u8") & _KEEP[lengths[at]]
        found = np.zeros(len(starts), dtype=np.uint64)
        found[at] = self.table.find(keys)
        new = np.flatnonzero(found[at] == 0)
        if len(new):
            own, back = _distinct(keys[new])
            which = at[new[own]]
            ids, place, n = self._encoded(b, starts[which], lengths[which])
            place += self.table.add_ids(ids, True)
            words = (place.astype(np.uint64) << _U(16)) | (n.astype(np.uint64) + _U(1))
            self.table.put(keys[new[own]], words)
            found[at[new]] = words[back]
        place, n = (found >> _U(16)).astype(np.int64), (found & _U(0xFFFF)).astype(np.int64) - 1
        long = np.flatnonzero(~short)
        if len(long):
            ids, place[long], n[long] = self._encoded(b, starts[long], lengths[long])
            place[long] += self.table.add_ids(ids, False)
        out = self.table.ids[_ragged(place, n)].astype("<u4")
        if self.table.full() or self.table.nbytes() > self.table.limit:
            self.table.clear()
        return out, n

    def _encoded(self, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, and where among them each part's begin and how many they are. Parts that begin with a visible
        character follow a line feed, those that begin with a space and a visible one stand as they are, in one text of
        many; the rest are encoded one by one."""
        visible = ink_at(b, starts)
        together = visible | ((b[starts] == 32) & ink_at(b, starts + 1))
        place, n, out, total = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), [], 0
        many, alone = np.flatnonzero(together), np.flatnonzero(~together)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[many]) >> 16)) + 1
        for group in np.split(many, cuts) if len(many) else ():
            got = self._joined(b, starts[group], lengths[group], visible[group])
            if got is None:
                alone = np.r_[alone, group]
                continue
            place[group], n[group] = got[1] + total, got[2]
            out.append(got[0])
            total += len(got[0])
        for i in alone.tolist():
            out.append(self._library(b[starts[i] : starts[i] + lengths[i]].tobytes().decode("utf-8", "replace")))
            place[i], n[i] = total, len(out[-1])
            total += len(out[-1])
        return np.concatenate(out) if out else np.empty(0, dtype="<u4"), place, n

    def _joined(self, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The ids of parts joined to one text, with a line feed before some; None if that is no UTF-8."""
        sizes = lengths + lead
        ends = np.cumsum(sizes)
        text = np.full(int(ends[-1]), 10, dtype=np.uint8)
        text[_ragged(ends - lengths, lengths)] = b[_ragged(starts, lengths)]
        try:
            ids = self._library(text.tobytes().decode())
        except UnicodeDecodeError:
            return None
        reach = np.cumsum(self.lengths[ids])
        stops = np.searchsorted(reach, ends)
        if not len(ids) or reach[-1] != ends[-1] or (reach[stops] != ends).any():
            raise ValueError("ids of a text don't end where its parts do")
        first = np.r_[0, stops[:-1] + 1]
        if (ids[first[lead]] != self.newline).any():
            raise ValueError("a line feed is not an id of its own")
        first += lead
        return ids, first, stops + 1 - first


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct key, number of the distinct key of each)."""
    h = keys[:, 0] * _MIX[1] ^ (keys[:, 1] + _MIX[0]) * _MIX[2]
    _, own, back = np.unique(h, return_index=True, return_inverse=True)
    if (keys[own][back] != keys).any():  # different keys of one hash
        _, own, back = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    return own, back.ravel()


_OF_PROCESS: dict[str, BpeEncoder] = {}


def encoder_of(path: str, cache_bytes: int = 64 << 20) -> BpeEncoder:
    """The encoder of this worker process; its cache, of ``cache_bytes`` at most, serves all tasks that the worker runs."""
    if path not in _OF_PROCESS:
        _OF_PROCESS[path] = BpeEncoder(path, cache_bytes)
    _OF_PROCESS[path].table.limit = cache_bytes
    return _OF_PROCESS[path]
