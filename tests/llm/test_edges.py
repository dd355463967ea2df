"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import components, figures, fingerprint, ids_crc, words
from hypothesis import given, settings
from hypothesis import strategies as st
from notelake.llm import ann, bits, bpe, chat, counts, mixing, packing, quality, simhash, simple8b, urls, warc
from notelake.llm import queries as q
from notelake.llm.bpe import BpeEncoder
from notelake.llm.components import components as graph_components
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", " \n\t", "one", "Same text, the very same.", "Same text, the very same.", LONG, "<|endoftext|> é 漢 👍\n\n  x", "a  b\u00a0c \x1c d"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, repeats and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 3 == 0 else "s", i, "c", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", None, 0, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept string, size int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def encoder():
    return BpeEncoder(q.tokenizer_path())


def _split(encoder, texts):
    return [x.tobytes() for ids, n in encoder.encode(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]


_PIECES = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "bc", "é", "\u00a0", "\x1c", "\x85", "!", ",x", "1", "²", "<|endoftext|>", "\u180e", "\u200b", "\u2009", "漢", "\0", "'s", "'", "👍", "\u0301", "ⅷ", "\u3000", "\u2019", "\ufeff", "Word,", "_", "antidisestablishmentarianism"]


@pytest.mark.parametrize("step", [1 << 20, 50, 7])
def test_encoder_equals_library(encoder, monkeypatch, step):
    """Texts of all kinds of white space, in windows of any size, with a cache that begins anew all the time."""
    monkeypatch.setattr(bpe, "_STEP", step)
    r = random.Random(step)
    texts = ["".join(r.choices(_PIECES, k=r.randint(0, 30))) for _ in range(1500)]
    plain = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert _split(encoder, texts) == plain
    monkeypatch.setattr(encoder.table, "limit", 1)
    assert _split(encoder, texts) == plain and _split(encoder, [None, "", None]) == [b"", b"", b""]


def test_encoder_of_other_tokenizers():
    """A file of another kind is not taken apart; its ids are the library's too."""
    other = BpeEncoder(q.tokenizer_path("word_bpe_49k.json"))
    texts = ["Hello, World", " two  words\n", "don't STOP", "", "a<|endoftext|> b"]
    assert not other.parts and _split(other, texts) == [np.array(other.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_encoder_refuses_ids_that_do_not_fit(monkeypatch):
    broken = BpeEncoder(q.tokenizer_path())
    broken.lengths = broken.lengths + 1
    with pytest.raises(ValueError):
        _split(broken, ["some new words"])


def test_mixing_edges(odd, none):
    assert mixing.taken_per_document(none).count() == 0
    rows = mixing.taken_per_document(odd).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["source_size"]] = (sizes.get(r["source_size"], (0,))[0] + r["taken"], r["target"])
    assert all(abs(t - want) <= 1 for t, want in sizes.values())
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and all(words(r["text"]) for r in mixed.collect())
    assert mixing.mixed_documents(none).count() == 0


_CLASHES = ["fp", "_gone", "gone", "root", "_row", "whole", "_key", "key", "_i", "i", "_copies", "_d", "_k", "_s", "sid", "slot", "start", "twin", "n", "id", "a b.c", "size", "_id", "_c_0"]


def test_clashing_columns(spark):
    """Stages give any columns back as they were, also of rows that repeat an id."""
    rows = [(1, "one two three four", "s", *range(len(_CLASHES))), (2, "five six seven", "s", *range(100, 100 + len(_CLASHES))), (2, "eight nine ten", "s", *range(200, 200 + len(_CLASHES)))]
    rows += [(3, "one two three four", "s", *range(300, 300 + len(_CLASHES))), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in _CLASHES))
    kept = simhash.near_deduplicated(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:3])
    mixed = mixing.mixed_documents(docs, weights=(1,))
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(rows)
    assert quality.kept_documents(docs).columns == docs.columns


def test_twins_share_no_pass(spark):
    """Two equal documents fill a target to less than one document past it."""
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, " ".join(f"w{i}" for i in range(5)), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {s: 0 for s in "xy"}
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(words(r["text"]))
    want = {r["source"]: r["target"] for r in mixing.mix(docs).sources.collect()}
    assert want["x"] == pytest.approx(55 / 7) and want["x"] - 1 <= got["x"] < want["x"] + 3


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for top in (1, 2, 60_000, 1 << 33, (1 << 64) - 1):
        lengths = rng.integers(1, 9000, 7)
        values = rng.integers(0, top, int(lengths.sum()), dtype=np.uint64, endpoint=True)
        values[rng.random(len(values)) < 0.5] = 0
        words_, per_block, blocks = simple8b.encode(values, lengths)
        sizes = np.concatenate([[simple8b.BLOCK] * int(n // simple8b.BLOCK) + ([n % simple8b.BLOCK] if n % simple8b.BLOCK else []) for n in lengths]).astype(int)
        assert blocks.sum() == len(sizes) and (simple8b.decode(words_, per_block, sizes) == values).all()


def test_simple8b_edges(odd, none, encoder):
    assert simple8b.read_tokens(simple8b.write_tokens(none, q.tokenizer_path())).count() == 0
    rows = simple8b.read_tokens(simple8b.write_tokens(odd, q.tokenizer_path(), docs_per_file=3)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    want = [(r["doc_id"], ids_crc([*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in odd.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["crc"]) for r in rows) == sorted((d is None, d or 0, c) for d, c in want)
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])


def test_simple8b_hot_id(spark):
    """An id with most rows is dealt to several files; the least long is an id like any other."""
    least = -(1 << 63)
    rows = [(7, f"text {i}") for i in range(50)] + [(i, "x") for i in range(20)] + [(least, "least"), (None, "none")]
    manifest = simple8b.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), q.tokenizer_path(), docs_per_file=8)
    assert max(r["n_docs"] for r in manifest.collect()) < 30
    back = sorted(simple8b.read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in back] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0) if d is not None else (False, 0))


def test_simple8b_bounds(spark):
    """Files hold about as many rows each, whatever the spread of the ids; only an id of its own is dealt to several."""
    r = random.Random(4)
    spread = [r.randrange(-(1 << 63), 1 << 63) for _ in range(300)] + [5 + i for i in range(400)] + [1 << 40 | i << 3 for i in range(300)] + [9] * 200 + [None] * 90
    for ids in (spread, list(range(1000)), [(1 << 63) - 1, -(1 << 63)] * 40, [3] * 50, [None] * 30):
        docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        edges, first, files = simple8b.file_bounds(docs, 50)
        assert 0 <= files.sum() - -(-len(ids) // 50) <= (files > 1).sum() and (np.diff(edges) > 0).all() and first.tolist() == (np.cumsum(files) - files).tolist()
        known = np.array([-(1 << 63) if i is None else i for i in ids], dtype=np.int64)
        at = np.searchsorted(edges, known, side="left")
        for k in np.unique(at):
            own = known[at == k]
            assert len(own) <= 2 * 50 * files[k] and (files[k] == 1 or (own == edges[k]).all())
    assert [x.tolist() for x in simple8b.file_bounds(docs.limit(0), 50)] == [[], [0], [1]]


def test_simple8b_steps(odd):
    """Documents are read by the number of their ids; one with more comes alone."""
    path = simple8b.write_tokens(odd, q.tokenizer_path()).first()["path"]
    whole = [np.concatenate(x) for x in zip(*simple8b.read_file(path), strict=True)]
    for most in (1, 7, 1000):
        parts = list(simple8b.read_file(path, most=most))
        assert all(len(ids) <= most or len(lengths) == 1 for _, _, lengths, ids in parts) and len(parts) > 1
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))
    with pytest.raises(OverflowError):
        simple8b._offsets(np.array([1 << 31]))


def test_simple8b_damage(odd, tmp_path):
    path = simple8b.write_tokens(odd, q.tokenizer_path()).first()["path"].removeprefix("file://")
    data = open(path, "rb").read()
    (tmp_path / "short").write_bytes(data[:-9])
    with pytest.raises(ValueError):
        list(simple8b.read_file(str(tmp_path / "short")))


def test_simhash_edges(odd, none):
    assert simhash.simhash_components(none).count() == 0
    rows = simhash.simhash_components(odd).collect()
    want = components([(r["doc_id"], fingerprint(r["text"])) for r in odd.collect()])
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in rows), key=key) == sorted(want, key=key)
    kept = simhash.near_deduplicated(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and len(ids) == len(set(ids)) and 4 in ids and 5 not in ids
    assert simhash.near_deduplicated(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 6), st.integers(1, 400))
def test_bit_slices(seed, radius, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = centres[rng.integers(0, 5, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    near = bits.within(fps[:9], bits.planes(fps), radius, np.arange(64))
    found = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n]
    assert (found == (np.bitwise_count(fps[:9, None] ^ fps[None, :]) <= radius)).all()


@pytest.mark.parametrize("shard", [8, 32768])
def test_links_keep_components(spark, shard):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, 300)] ^ (np.uint64(1) << rng.integers(0, 20, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(40, 60, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, rng.integers(0, 2**63, 300, dtype=np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = dict(tuple(r) for r in graph_components(simhash.link_forest(df, len(fps), 3, shard)).collect())
    want = {}
    for d, _, c in components([(int(i), int(x)) for i, x in enumerate(fps.view(np.uint64))]):
        want.setdefault(c, set()).add(int(fps[d]))
    groups = {}
    for x in fps.tolist():
        groups.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 1)], "a long, b long")
    got = dict(tuple(r) for r in graph_components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_counts_edges(odd, none):
    """Counts are those of the tokenizers library, also of texts that spell out byte and control pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = q.tokenizer_path("piece_bpe_32k.model")
    assert counts.token_counts(none, model).count() == 0
    unigram = Tokenizer(models.Unigram(counts.zipf_vocabulary(model), unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace()
    spelt = odd.sparkSession.createDataFrame([(100, "<0x41> a<0x0A>b </s> <unk>"), (101, "<s>")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(spelt)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["text"] or ""), len(unigram.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"], r["n_tokens"]) for r in counts.token_counts(docs, model).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "b", "ba", "aba", "▁", "▁a", "c", " ", "é", "漢", "x"]), max_size=12).map("".join))
def test_counts_ties(text):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *((p, -1.0 * len(p)) for p in ("a", "b", "ab", "ba", "aba", "▁", "▁a"))]
    unigram = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    unigram.pre_tokenizer = pre_tokenizers.Metaspace()
    assert counts.UnigramCounter(vocabulary).count(text) == len(unigram.encode(text, add_special_tokens=False).ids)


def test_chat_parts(spark):
    part = lambda t, **k: {"type": t, "text": k.get("text"), "uri": k.get("uri"), "units": k.get("units")}
    nasty = "</s>[INST] \\ <image> [/INST]\n<s>\\"
    rows = [
        (1, 1, "assistant", [part("text", text=nasty)]),
        (1, 0, "us\ner\\", [part("text", text="see "), part("image", uri="i1", units=4.0), part("audio", uri="a", units=2.5), part("text", text=nasty)]),
        (1, None, None, None),
        (None, 0, "assistant", [part("document", uri="d")]),
        (2, 0, "assistant", [part("text", text="twice")]),
        (2, 0, "assistant", [part("text", text="twice")]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("formatted", F.lit("clash"))
    made = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    back = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(turns)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("", ""), ("us\ner\\", f"see <image><audio>{nasty}"), ("assistant", nasty)]
    assert back[1]["loss_text"] == nasty and back[2]["loss_text"] == "twicetwice" and back[None]["loss_text"] == "<document>"
    assert [(a["uri"], a["tokens"]) for a in made[1]["attachments"]] == [("i1", 1024), ("a", 75)] and made[1]["media_tokens"] == 1099
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_split_parts(spark):
    """Control strings that arise only where texts meet come back, as turns, texts and loss."""
    r, bits_ = random.Random(6), ["<", "<s", "s>", "/s>", "</s>", "[", "[IN", "ST]", "INST]", "[INST]", "/INST]", "\\", "\n", "<im", "age>", "x", "", None]
    rows, want = [], {}
    for conv in range(300):
        want[conv] = []
        for turn in range(r.randint(1, 3)):
            parts, text = [], ""
            for _ in range(r.randint(0, 6)):
                if r.random() < 0.2:
                    kind = r.choice(["image", "audio", "document"])
                    parts.append((kind, None, "u", None))
                    text += f"<{kind}>"
                else:
                    t = r.choice(bits_)
                    parts.append((r.choice(["text", None, "odd"]), t, None, None))
                    text += t or ""
            role = r.choice(["user", "assistant", "system<", "a\n\\"])
            rows.append((conv, turn, role, parts))
            want[conv].append((role, text))
    made = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    back = {b["conv_id"]: b for b in chat.parse_chats(made).collect()}
    for conv, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == turns
        assert back[conv]["loss_text"] == "".join(t for role, t in turns if role == "assistant")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<image>", "\\", "\n", "[", "<", "/s>", "x"]), max_size=10).map("".join))
def test_escape_model(text):
    """A Python reading of the escapes: no control string is left, and the text comes back."""
    import re

    out = re.sub(chat._CONTROL, r"\1\\\2", text.replace("\\", "\\\\"))
    assert not re.search(r"</?s>|\[/?INST\]|<image>", out) and re.sub(r"(?s)\\(.)", r"\1", out) == text


def test_quality_edges(odd, none):
    assert quality.judged(none, ["doc_id"]).count() == 0 and quality.kept_documents(none).count() == 0
    rows = quality.judged(odd, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = figures(r["text"])
        assert {k: r[k] for k in want} == want
    assert quality.kept_documents(odd).columns == odd.columns


def test_quality_posterior(spark):
    """Rules that agree raise the posterior of their side; the estimate is the one that plain Python finds."""
    import math

    m = len(quality.RULES)
    data = [([1.0] * m, 900), ([-1.0, 1.0, 1.0, -1.0, *[1.0] * (m - 4)], 40), ([0.0, -1.0, *[1.0] * (m - 2)], 7), ([1.0] * (m - 1) + [0.0], 30)]
    r = quality.estimated(spark.createDataFrame(data, "v array<double>, n long")).first()
    prior, good, bad = quality.PRIOR, [quality.ON_GOOD] * m, [quality.ON_BAD] * m
    more = 2 + quality.WEIGHT * sum(n for _, n in data)
    for _ in range(quality.ROUNDS):
        p = []
        for v, _n in sorted(data):
            z = math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if x > 0 else math.log((1 - g) / b) if x < 0 else 0 for x, g, b in zip(v, good, bad, strict=True))
            p.append(1 / (1 + math.exp(-z)))
        rows = [(v, n, y) for (v, n), y in zip(sorted(data), p, strict=True)]
        prior = (sum(n * y for _, n, y in rows) + more * quality.PRIOR) / (sum(n for _, n, _ in rows) + more)
        good = [(sum(n * y for v, n, y in rows if v[j] > 0) + more * quality.ON_GOOD) / (sum(n * y for v, n, y in rows if v[j]) + more) for j in range(m)]
        bad = [(sum(n * (1 - y) for v, n, y in rows if v[j] < 0) + more * quality.ON_BAD) / (sum(n * (1 - y) for v, n, y in rows if v[j]) + more) for j in range(m)]
    assert r["prior"] == pytest.approx(prior) and list(r["on_good"]) == pytest.approx(good) and list(r["on_bad"]) == pytest.approx(bad)


def test_urls_edges(spark):
    rows = [(1, None, 5), (2, "no scheme", 5), (3, "http://A.Example.NET/en/x?y=/", 5), (3, "http://a.net", 5), (None, "x://b.org/fr/", 5), (4, "http://cheapcasino.example.org/x", 5), (5, "a://h/b://c", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule int")
    got = [tuple(r)[1:4] + (r["verdict"],) for r in urls.judged_urls(pages).collect()]
    assert got[0][:3] == got[1][:3] == ("", "", None)
    assert got[2:6] == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("a.net", "", None, got[3][3]), ("b.org", "/fr/", "org/fr/", "allow"), ("cheapcasino.example.org", "/x", None, "block")]
    assert got[0][3] == got[1][3] == "allow" and got[6][:2] == ("h", "/b://c") and urls.judged_urls(pages.limit(0)).count() == 0


def test_urls_held_out():
    """Hosts that training did not see, made of words that it saw in others, are told apart at the threshold that ships."""
    got = urls.held_out()
    right = sum((p >= urls.THRESHOLD) == bool(y) for _, y, p in got)
    assert len(got) == len(urls.labelled_hosts()) and right >= 0.9 * len(got)


def test_urls_held_out_by_word():
    """The threshold is the least step that leaves hosts of wanted words that training never saw alone; of hosts of
    unwanted words that it never saw about a third are found."""
    got = urls.held_out(by_word=True)
    blocked = lambda t, y: sum(p >= t for _, z, p in got if z == y) / sum(z == y for _, z, _ in got)
    assert urls.THRESHOLD == next(t / 20 for t in range(1, 20) if blocked(t / 20, 0) <= 0.02) and blocked(urls.THRESHOLD, 1) >= 0.3


def test_urls_pages_of_a_host():
    """Pages of a host get one verdict, whatever the digits and lengths of their paths, save hosts at the threshold."""
    model = urls.trained(urls.labelled_urls())
    hosts = [f"www.{h}.example.com" for h, _, _ in urls.labelled_hosts()[::5]] + [f"{w}.example.org" for w in ("ththat", "qorivel", "casinoland", "slowfood")]
    paths = ["/", "/en/1", "/fr/77.html", "/de/123456789/", "/a/very/long/path/of/many/words/0123456789/index.html"]
    got = np.array([[model.probability(h, p) for p in paths] for h in hosts])
    assert np.ptp(got, axis=1).max() < 0.06 and ((got >= urls.THRESHOLD).any(axis=1) != (got >= urls.THRESHOLD).all(axis=1)).mean() < 0.03


def test_urls_long(spark):
    """Very long hosts and paths are judged whole."""
    long = "x" * 300_000
    pages = spark.createDataFrame([(1, f"http://{long}.net/{long}"), (2, f"http://a.example.com/{long}?q"), (3, "://"), (4, "")], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged_urls(pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == (f"{long}.net", f"/{long}", "net/") and got[2]["path"] == f"/{long}" and got[3]["host"] == ""


def test_packing_edges(odd, none, encoder):
    """Every id of every row lies in one piece, pieces lie gapless in sequences of at most the capacity."""
    path = q.tokenizer_path()
    assert packing.packed_documents(none, path).count() == 0
    rows = packing.packed_documents(odd, path, end_id=3).collect()
    by_row, by_sequence = {}, {}
    for r in rows:
        by_row.setdefault(r["row_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    got = []
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))]
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in pieces), dtype="<u4").tolist()
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
        got.append((pieces[0]["doc_id"] is None, pieces[0]["doc_id"] or 0, ids))
    assert sorted(got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, [*encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 3]) for r in odd.collect())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(p["length"] for p in pieces[:i]) for i in range(len(pieces))] and sum(r["length"] for r in pieces) <= 1024


def test_pipeline_edges(spark, tmp_path):
    """Nulls, blanks, repeated ids and rows, very long texts, clashing columns and an empty table go through all stages."""
    import corpus_pipeline

    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(n)) + "."
    texts = [prose(80) for _ in range(12)] + [None, "", " \n", "short", prose(20_000)]
    rows = [(i, t, "s" if i % 2 else None, i, "c", 1) for i, t in enumerate(texts)]
    rows += [rows[0], (0, prose(90), "s", 0, "d", 2), (None, prose(90), "t", 0, None, None), (77, texts[1] + " more", "s", 0, "e", 3)]
    for name, table in (("full", rows), ("empty", rows[:0])):
        docs = spark.createDataFrame(table, "doc_id long, text string, source string, fp long, kept string, slot int")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        after = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
            docs = out
            after.append([tuple(x) for x in docs.collect()])
        left = after[-1]
        assert set(left) <= set(rows)
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ends = sorted((p["doc_id"] is None, p["doc_id"] or 0) for p in packed if p["start"] == 0)
        assert ends == sorted((x[0] is None, x[0] or 0) for x in left)
        if name == "full":  # of the copies one stays; what has no words goes; both rows of an id that differ stay
            assert sorted(str(x[0]) for x in after[1]) == sorted(map(str, [*range(12), 16, None, 0]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_first_fit_decreasing(lengths):
    bins, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= 64), len(bins))
        bins += [0] * (b == len(bins))
        want[i] = (b, bins[b])
        bins[b] += lengths[i]
    assert packing.first_fit_decreasing(lengths, 64) == [want[i] for i in range(len(lengths))]


def test_warc_edges(spark):
    big = "x" * 200
    rows = [(1, "u", None, 1), (2, None, "", 1), (5, "http://a/é\r\nb", big, 1), (3, "u", big, 1), (3, "u", big, 1), (4, "u", "y" * 99, 1), (6, "u", "y" * 99, 1), (None, "u", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == [(0, 200, "response", None), (1, 0, "response", None), (2, 0, "response", None), (3, 200, "response", None), (3, 200, "response", None), (4, 99, "response", None), (5, 200, "revisit", 3), (6, 99, "response", None)]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_damage():
    import io

    raw = warc.render(1, "http://a/", b"hello", None)
    assert warc.parse(raw).payload == b"hello"
    for bad in (raw.replace(b"hello", b"hellO"), raw.replace(b"Content-Length: 5", b"Content-Length: 6"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"WARC-Date: ", b"X: ")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    import zstandard

    data = warc.dictionary_frame(b"") + zstandard.ZstdCompressor().compress(raw)
    assert list(warc.read_archive(io.BytesIO(data), step=3)) == [raw]
    for bad in (data[:-1], data[8:], data[:7]):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(bad)))


def test_ann_edges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0) for i in range(45)]
    rows += [(200, None, 0), (220, [0.0] * 6, 0), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (260, [float("nan")] * 6, 0), (280, [float("inf")] + [0.0] * 5, 0), (None, [1.0] * 6, 0), (300, [1.0], 0), (20, rows[20][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.search(table, F.col("embedding"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    at = {r[0]: np.array(r[1]) for r in rows[:105]}
    assert sorted(got) == [0, 20, 40, 100, 120, 140]
    for qid, near in got.items():
        want = sorted((-float(sum(at[qid][k] * v[k] for k in range(6))), i) for i, v in at.items() if i != qid)[:20]
        assert len(near) == 20
        assert len({n[1] for n in near} & {w[1] for w in want}) >= 18
    exact = {}
    monkeypatch.setattr(ann, "_MOST", 1)
    for r in ann.search(table, F.col("embedding"), F.col("vec_id") % 20 == 0, recall=1.0).collect():
        exact.setdefault(r["query_id"], []).append(r["vec_id"])
    for qid, near in exact.items():  # too few probes for the recall: every query against all rows
        want = sorted((-float(sum(at[qid][k] * v[k] for k in range(6))), i) for i, v in at.items() if i != qid)[:20]
        assert set(near) == {w[1] for w in want}
    monkeypatch.undo()
    few = ann.search(table.filter("vec_id < 5"), F.col("embedding"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.search(table.limit(0), F.col("embedding"), F.col("vec_id") % 20 == 0).count() == 0
