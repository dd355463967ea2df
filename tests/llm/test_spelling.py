"""Spelling variants against all pairs by hand."""

import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pytest
from notelake.llm import queries as q
from notelake.llm import spelling
from notelake.llm.common import Scratch


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def grouped(n, near):
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}
    out = []
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, c, len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


def brute(docs):
    n = counted(docs)
    near = {w: set() for w in n}
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    return grouped(n, near)


def by_deletions(docs):
    """As ``brute``, for many words: words that share what is left of them without one code point."""
    n = counted(docs)
    near, left = {w: set() for w in n}, {}
    for w in n:
        for i in range(len(w)):
            left.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for own in left.values():
        for a, b in combinations(own, 2):
            near[a].add(b)
            near[b].add(a)
    return grouped(n, near)


def groups(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    return sorted(map(tuple, spelling.variant_groups(df).select("word", "n", "n_near", "form", "form_n", "root").collect()))


@pytest.mark.parametrize("meeting", [64, 2])
def test_pairs(spark, monkeypatch, meeting):
    """Words over few letters, so that keys are crowded; with two words a key every hole is cut to the end."""
    monkeypatch.setattr(spelling, "_MEETING", meeting)
    r = random.Random(meeting)
    words = {"".join(r.choice("abé") for _ in range(r.choice([1, 2, 3, 5, 6, 7, 11]))) for _ in range(300)} | {"a" * k for k in range(1, 70)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = spelling.near_words(df, Scratch()).collect()
    assert sorted(map(tuple, found)) == sorted((a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_groups(spark):
    r = random.Random(3)
    stems = ["Größe", "hello", "hallo", "hullo", "there", "theré", "ÀÀÀÀÀ", "ààààà", "÷÷÷÷÷", "abcdefghij" * 40]
    docs = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            if r.random() < 0.4:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", "x", "é", w[at].upper()]) + w[at + r.randrange(2) :]
            words.append(w)
        docs.append((i % 50 if i else None, r.choice([" ", "1", "\n", "š"]).join(words)))
    docs += [(7, None), (8, ""), (9, "12 š")]
    got = groups(spark, docs)
    assert got == brute(docs) and len(got) > 20


def test_edges(spark):
    assert groups(spark, []) == [] and groups(spark, [(1, None), (2, "")]) == []
    docs = [(None, "abcde abcde abcde"), (1, "abcdf " * 6), (2, "abcdg " * 6), (3, "vwxyz vwxyz"), (4, "abxdf " * 12), (5, "aéxdf " * 24)]
    got = groups(spark, docs)
    assert got == brute(docs)
    forms = {row[0]: row[3:] for row in got}
    assert forms["abcde"] == ("abcdf", 6, "aéxdf") and forms["abcdf"] == ("abxdf", 12, "aéxdf")  # a tie, and a chain


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = q.op11_spelling(spark, sf_dir).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == by_deletions(docs)
