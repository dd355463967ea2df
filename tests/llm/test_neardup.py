"""Near copies of the pipeline: 5-word shingles, similarity 0.8 or more."""

import random

import pytest
from brute import words
from notelake.llm import neardup, simhash
from pyspark.sql import functions as F


def _sets(text):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def first_of_groups(texts):
    """Least id of each group of transitively linked texts, by comparing all pairs."""
    sets, up = {d: _sets(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) / len(x | y) >= 0.8:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted({find(d) for d in ids})


def _edited(ws, n, seed):
    """The words with ``n`` of them, far apart, replaced."""
    ws, r = list(ws), random.Random(seed)
    for i in range(n):
        ws[(i + 1) * len(ws) // (n + 1)] = f"x{r.random()}"
    return " ".join(ws)


def test_near_copies_go(spark):
    r, rows = random.Random(3), []
    for g in range(12):
        ws = [f"w{r.randrange(5000)}" for _ in range(120)]
        rows += [(g * 10, " ".join(ws)), (g * 10 + 1, _edited(ws, 2, g)), (g * 10 + 2, _edited(ws, 5, g))]  # about 0.84 and 0.65
    assert 0.8 <= neardup.similarity(*(neardup.shingles(neardup.words_of(t.encode()), 5) for _, t in rows[:2])) < 0.9
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == first_of_groups(dict(rows)) == [r[0] for r in rows if r[0] % 10 != 1]


def test_chains_in_one_bucket(spark):
    """Copies that are alike only step by step are one group, whichever row of the bucket comes first."""
    ws = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(ws[7 * i : 7 * i + 120])) for i in range(20)]
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == first_of_groups(dict(rows)) == [0]


def test_repeated_ids_lose_no_group(spark):
    """An id whose rows lie in two groups goes from one of them only."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (7, c), (8, a), (9, b)]
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == [(3, a), (5, b), (7, c)]
    two = simhash.near_deduplicated(spark.createDataFrame([(5, a), (5, b), (5, b)], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in two) == [(5, a), (5, b)]


def test_simhash_groups_link_without_bands(spark, monkeypatch):
    """Buckets of agreeing blocks deal rows: near copies whose fingerprints are close go though no band has them."""
    real = neardup.signed_rows
    monkeypatch.setattr(neardup, "signed_rows", lambda docs, width: real(docs, width).withColumn("bands", F.array().cast("array<long>")))
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*base[: 1500 + i], f"x{i}", *base[1501 + i :]])) for i in range(6)] + [(9, " ".join(f"y{i}" for i in range(50)))]
    sims = [neardup.narrow(neardup.shingles(neardup.words_of(t.encode()), 5)) for _, t in rows]
    assert all((sims[0] ^ s).bit_count() <= 3 for s in sims[:6]) and (sims[0] ^ sims[6]).bit_count() > 3
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == first_of_groups(dict(rows)) == [0, 9]


def test_close_fingerprints_alone_make_no_copy(spark, monkeypatch):
    """The exact comparison decides: rows of one SimHash group that share too little stay."""
    real = neardup.signed_rows
    monkeypatch.setattr(neardup, "signed_rows", lambda docs, width: real(docs, width).withColumn("sim", F.lit(7).cast("long")))
    rows = [(i, " ".join(f"{c}{j}" for j in range(40))) for i, c in enumerate("aabc")]
    kept = simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_stage_equals_all_pairs(spark, sf_dir, texts):
    import corpus_pipeline

    kept = corpus_pipeline.dedup_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == first_of_groups(texts)
