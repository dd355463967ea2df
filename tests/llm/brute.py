"""Plain Python versions of the operators, to hold their results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, width=3):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(pairs):
    """pairs: (doc_id, fingerprint) -> sorted [(doc_id, fingerprint hex, component)]."""
    up = list(range(len(pairs)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    f = np.array([p[1] for p in pairs], dtype=np.uint64)
    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{x:016x}", least.get(find(i))) for i, (d, x) in enumerate(pairs)]


def repeat_words(ws, k=8):
    seen = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    hit = set()
    for i in range(len(ws) - k + 1):
        if seen[tuple(ws[i : i + k])] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def figures(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n_repeat = repeat_words(ws)
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": n_repeat,
        "base_failed": len(ws) < 20 or 100 * n_repeat > 30 * len(ws),
    }


def targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes: {source: words} -> {source: target}, by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, free = float(sum(sizes.values())), {}, set(order)
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def ids_crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def chat_digest(turns):
    """turns of one conversation, in order: (role, text)."""
    full = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def warc_rows(pages):
    """pages: (page_id, html) -> {page_id: (bytes, digest, type, refers_to)}."""
    by = defaultdict(list)
    for p, h in pages:
        by[(h or "").encode()].append(p)
    out = {}
    for body, ids in by.items():
        for p in ids:
            again = len(body) >= 100 and p != min(ids)
            out[p] = (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(ids) if again else None)
    return out
