"""The registered queries over whole tables against brute force."""

from collections import defaultdict

import pytest
from brute import chat_digest, components, figures, fingerprint, ids_crc, targets, warc_rows, words
from notelake.llm import queries as q
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path())


def test_mixing(spark, sf_dir, docs):
    rows = q.op2_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = defaultdict(int)
    for d in docs.values():
        sizes[d["source"]] += len(words(d["text"]))
    want, taken = targets(sizes), defaultdict(int)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(words(docs[r["doc_id"]]["text"])) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(rows, key=key) == sorted(q.op2_mixing(spark, sf_dir).collect(), key=key)
    assert all((r["first_slot"] is None) == (r["taken"] == 0) == (r["n_pieces"] == 0) for r in rows)


def test_mixing_schedule(spark, sf_dir, docs):
    """The slots are those that golden-ratio points by hand give, and every prefix of them holds the sources' shares."""
    import numpy as np
    from notelake.llm import mixing

    m = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sizes = defaultdict(int)
    for d in docs.values():
        sizes[d["source"]] += len(words(d["text"]))
    total, want = sum(sizes.values()), targets(sizes)
    block = max(1, total // (1 << 17))
    n = -(-total // block)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    edges = np.cumsum([want[s] for s in order]) / total
    hit = np.searchsorted(edges, ((np.arange(n) + 0.5) * (5**0.5 - 1) / 2) % 1.0, side="right")
    got = defaultdict(dict)
    for r in m.schedule.collect():
        got[r["sid"] - 1][r["block"]] = r["slot"]
    for i, s in enumerate(order):
        slots, need = np.flatnonzero(hit == i), -(-min(round(want[s]), 3 * sizes[s]) // block)
        assert sorted(got[i]) == list(range(need))
        assert [got[i][b] for b in range(min(need, len(slots)))] == slots[:need].tolist()
        assert all(got[i][b] >= n for b in range(len(slots), need)) and abs(len(slots) - need) <= 4
        share = np.cumsum(hit == i) - np.arange(1, n + 1) * want[s] / total
        assert np.abs(share).max() <= 4
    pieces = m.pieces.collect()
    assert len({(r["sid"], r["block"], r["epoch"], r["start"]) for r in pieces}) == len(pieces)
    assert {r["slot"] for r in pieces} == {x for v in got.values() for x in v.values()}


def test_simple8b(spark, sf_dir, docs, tokenizer):
    rows = sorted(q.op3_simple8b(spark, sf_dir).collect())
    start = 0
    assert [r["doc_id"] for r in rows] == sorted(docs)
    for r in rows:
        ids = [*tokenizer.encode(docs[r["doc_id"]]["text"], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), ids_crc(ids))
        start += len(ids)


def test_simhash(spark, sf_dir, docs):
    want = components([(d, fingerprint(r["text"])) for d, r in docs.items()])
    assert sorted(tuple(r) for r in q.op4_simhash(spark, sf_dir).collect()) == sorted(want)


def test_chat(spark, sf_dir):
    conversations = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        conversations[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    text = "</s>[INST] ok [/INST]"
    conversations[-7] = [(0, "user", text), (1, "assistant", text)]
    rows = q.op6_chat(spark, sf_dir).collect()
    assert sorted(r["conv_id"] for r in rows) == sorted(conversations)
    for r in rows:
        assert tuple(r)[1:5] == chat_digest([t[1:] for t in sorted(conversations[r["conv_id"]])])


def test_quality(spark, sf_dir, docs):
    rows = q.op7_quality(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        want = figures(docs[r["doc_id"]]["text"])
        assert {k: r[k] for k in want} == want
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(r["kept"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k for k, y in judged if y) >= 0.98 * sum(y for _, y in judged)
    assert sum(not k for k, y in judged if not y) >= 0.8 * sum(not y for _, y in judged)


def test_quality_against_all_must_pass(spark):
    """On labelled documents past the base rules the posterior keeps good ones that one bad vote would cost, and rejects as
    many bad ones; no estimate is at 0 or 1."""
    from notelake.llm import quality

    folder = "/root/testdata/sf0.01"
    rows = quality.judged(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]).filter("not base_failed")
    one = rows.groupBy(F.col("votes").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = quality.estimated(one).first()
    assert all(0.001 < x < 0.9999 for x in [r["prior"], *r["on_good"], *r["on_bad"]])
    passes = F.forall("votes", lambda v: v >= 0)
    got = rows.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count_if(passes).alias("passes"), F.count_if(passes & ~F.col("kept")).alias("lost"), F.count_if(F.col("kept") & ~passes).alias("won"))
    bad, good = got.orderBy("quality").collect()
    assert good["won"] > 0 and good["lost"] == 0 and bad["kept"] == bad["passes"]


def test_packing(spark, sf_dir, docs, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in q.op9_packing(spark, sf_dir).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_doc) == sorted(docs)
    for d, pieces in by_doc.items():
        ids, at = [*tokenizer.encode(docs[d]["text"], add_special_tokens=False).ids, 0], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == ids_crc(ids[p["start"] : at])
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 1024 - at
    assert padding <= 1024 + 0.02 * 1024 * len(by_sequence)


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = warc_rows([(p["page_id"], p["html"]) for p in pages])
    rows = q.op10_warc(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    assert {r["page_id"]: tuple(r)[1:] for r in rows} == want


@pytest.mark.parametrize("folder", [None, "/root/testdata/sf0.1"])
def test_nearest(spark, sf_dir, folder):
    """At least nine tenths of the nearest rows that comparing all gives, ranked by exact products."""
    import os

    import numpy as np

    folder = folder or sf_dir
    if not os.path.exists(f"{folder}/embeddings.parquet"):
        pytest.skip("tables are not there")
    at = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = np.array(sorted(at))
    x = np.stack([at[i] for i in ids.tolist()])
    by_query = defaultdict(list)
    for r in q.op1_cross_polytope(spark, folder).collect():
        assert r["score"] == pytest.approx(float(at[r["query_id"]] @ at[r["vec_id"]]), abs=1e-12)
        by_query[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert sorted(by_query) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for i, v in by_query.items():
        product = x @ at[i]
        want = [j for j in ids[np.lexsort((ids, -product))].tolist() if j != i][:20]
        assert [t[0] for t in sorted(v)] == list(range(1, len(want) + 1)) and [t[1:] for t in sorted(v)] == sorted(t[1:] for t in v)
        assert i not in [t[2] for t in v] and len({t[2] for t in v}) == len(v)
        hits += len({t[2] for t in v} & set(want))
    assert hits >= 0.9 * sum(map(len, by_query.values()))


def test_token_counts(spark, sf_dir, docs):
    from notelake.llm.counts import zipf_vocabulary
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = zipf_vocabulary(q.tokenizer_path("piece_bpe_32k.model"))
    unigram = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace()
    rows = q.op5_token_counts(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert (r["n_tokens"], r["n_chars"]) == (len(unigram.encode(text, add_special_tokens=False).ids), len(text))


def _grams(host, path):
    """Values of hashed 3- to 5-grams: those of the host have 0.99 of the squared length, those of the path the rest."""
    import zlib

    out = defaultdict(float)
    for mark, text, share in (("h", "^" + host + "$", 0.99), ("p", "^" + path + "$", 0.01)):
        own = {zlib.crc32((mark + text[i : i + n]).encode()) % (1 << 18) for n in (3, 4, 5) for i in range(len(text) + 1 - n)}
        for g in own:
            out[g] += (share / len(own)) ** 0.5
    return out


def _host_path(url):
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    return rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]


def _newton(labelled, penalty):
    """The same regression by Newton's method in the space of the rows: the probability of a URL."""
    import numpy as np

    rows = [_grams(*_host_path(u)) for u, _ in labelled]
    y = np.array([t for _, t in labelled], dtype=float)
    places = defaultdict(list)
    for i, r in enumerate(rows):
        for g, x in r.items():
            places[g].append((i, x))
    n = len(rows)

    def against(grams):
        out = np.zeros(n)
        for g, x in grams.items():
            for i, z in places.get(g, []):
                out[i] += x * z
        return out

    kernel = np.array([against(r) for r in rows])
    a, b = np.zeros(n), 0.0
    for _ in range(30):
        f = kernel @ a + b
        p = 1 / (1 + np.exp(-f))
        w = np.maximum(p * (1 - p), 1e-12)
        system = np.block([[kernel + np.diag(n * penalty / w), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        x = np.linalg.solve(system, np.r_[f + (y - p) / w, 0.0])
        a, b = x[:-1], x[-1]
    return lambda url: 1 / (1 + np.exp(-(against(_grams(*_host_path(url))) @ a + b)))


def test_urls(spark, sf_dir):
    from notelake.llm.urls import PENALTY, judged_urls, labelled_urls

    rules, probability = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}, _newton(labelled_urls(), PENALTY)
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = {p["page_id"]: p["url"] for p in table.collect()}
    found = {r["page_id"]: r["p_unwanted"] for r in judged_urls(table).collect()}
    rows = q.op8_urls(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path = _host_path(pages[r["page_id"]])
        fits = [x for x in rules if ("." + host).endswith("." + x.split("/", 1)[0]) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        p = probability(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and found[r["page_id"]] == pytest.approx(p, abs=2e-3)
        if rule or abs(p - 0.6) > 2e-3:
            assert r["verdict"] == (rules[rule] if rule else "block" if p >= 0.6 else "allow")


def test_pipeline(spark, sf_dir, docs, tokenizer):
    import corpus_pipeline
    from test_neardup import first_of_groups

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, table, sf_dir)
    good = {r["doc_id"] for r in q.op7_quality(spark, sf_dir).collect() if r["kept"]}
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == good
    one = corpus_pipeline.dedup_stage(spark, kept, sf_dir)
    firsts = first_of_groups({d: docs[d]["text"] for d in good})
    assert sorted(r["doc_id"] for r in one.collect()) == firsts
    mixed = corpus_pipeline.mixing_stage(spark, one, sf_dir)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in firsts:
        sizes[docs[d]["source"]] += len(words(docs[d]["text"]))
    passes = defaultdict(int)
    for r in mixed.collect():
        assert tuple(r) == tuple(docs[r["doc_id"]])
        passes[r["doc_id"]] += 1
        taken[r["source"]] += len(words(r["text"]))
    longest = max(len(words(d["text"])) for d in docs.values())
    assert max(passes.values()) <= 3 and all(abs(taken[s] - t) <= longest for s, t in targets(sizes).items())
    rows = corpus_pipeline.packing_stage(spark, mixed, sf_dir).collect()
    total = sum(n * (1 + len(tokenizer.encode(docs[d]["text"], add_special_tokens=False).ids)) for d, n in passes.items())
    assert sum(r["length"] for r in rows) == total
    by_sequence = defaultdict(int)
    for r in rows:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= 1024


def test_mixed_order(spark, docs):
    """Documents stand in the order of slots: every prefix of the mix holds the sources' shares of words."""
    from notelake.llm import mixing

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), s) for i, s in enumerate(["a"] * 500 + ["b"] * 200 + ["c"] * 100)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 800
    seen = defaultdict(int)
    for n, r in enumerate(got, 1):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * w / 8) <= 4 for s, w in zip("abc", (5, 2, 1), strict=True))
