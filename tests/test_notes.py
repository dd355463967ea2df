"""Parsing and chunking against cases and plain Python readings."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from notelake.config import Settings
from notelake.functions import parse, text
from notelake.operators import chunk
from notelake.sources import notes
from plain_chunks import packed_chunks
from pyspark.sql import functions as F


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "raw string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


RAW = None  # the column, which needs a session


@pytest.fixture(autouse=True, scope="module")
def raw_column(spark):
    global RAW
    RAW = F.col("raw")




@pytest.mark.parametrize(
    ("raw", "title", "tags", "body"),
    [
        ("---\ntitle: A\ntags: [x, y]\n---\nbody", "A", ["x", "y"], "body"),
        ("no fence", None, [], "no fence"),
        ("---\n{: bad\n---\nbody", None, [], "body"),
        ("---\n- a\n- b\n---\nbody", None, [], "body"),
        ("---\r\ntitle: B\r\n---\r\nbody", "B", [], "body"),
        ("---\n---\nbody", None, [], "---\n---\nbody"),
        ("---\ntags: one\n---\n", None, ["one"], ""),
        (" ---\ntitle: A\n---\n", None, [], " ---\ntitle: A\n---\n"),
    ],
)
def test_frontmatter(spark, raw, title, tags, body):
    r = one(spark, raw, parse.frontmatter(parse.frontmatter_text(RAW)), parse.body(RAW))
    assert (r.c0["title"], r.c0["tags"], r.c1) == (title, tags, body)


def test_numeric_tags_break_a_note(spark):
    files = [(p, bytearray(b), len(b)) for p, b in (("a.md", b"---\ntags: 5\n---\nx"), ("b.md", b"ok \xff"))]
    df = spark.createDataFrame(files, "relative_path string, content binary, file_size_bytes long").withColumn("modified_at", F.current_timestamp())
    assert [r["raw_content"] for r in notes.parsed(df).collect()] == ["ok �"]
    assert notes.parse_failures(df).first()["failures"] == 1


def test_headings(spark):
    raw = "# One ##\ntext # no\n###### Six\n#no\n## A\u0085b\n#\n\nnext\n####### seven"
    want = [(len(m[1]), m[2].strip()) for m in re.finditer(r"^(#{1,6})\s+(.+?)(?:\s+#+)?\s*$", raw, re.M)]
    assert [(h["level"], h["text"]) for h in one(spark, raw, parse.headings(RAW)).c0] == want


def test_links_and_tags(spark):
    raw = "[[A]] [[B|alias]] [[F/C#h]] [[ D ]] [x](y#z) #Tag #tag/Sub #1no http://a/#no"
    r = one(spark, raw, parse.wikilinks(RAW), parse.tags(F.array(F.lit(" #Own "), F.lit("TAG"), F.lit("")), RAW))
    assert r.c0 == ["A", "B", "F/C", "D"] and r.c1 == ["own", "tag", "tag/sub"]


def test_titles_and_stems(spark):
    heads = parse.headings(RAW)
    t = lambda fm: parse.title(F.lit(fm), heads, F.lit("stem"))
    r = one(spark, "## two\n# first", t(" own "), t(None), t(""))
    assert tuple(r) == ("own", "first", "first")
    assert one(spark, "a/b.c.md", parse.stem(RAW), parse.title(F.lit(None).cast("string"), F.filter(heads, lambda h: h["level"] > 9), F.lit("stem")))[:] == ("b.c", "stem")


@pytest.mark.parametrize(("value", "want"), [("2024-02-03", "2024-02-03 00:00:00"), ("2024-02-03T04:05", "2024-02-03 04:05:00"), ("2024-02-03T04:05:06", "2024-02-03 04:05:06"), ("2024-02-30", None), ("soon", None), (None, None)])
def test_dates(spark, value, want):
    got = one(spark, value, F.date_format(parse.parsed_datetime(RAW), "yyyy-MM-dd HH:mm:ss")).c0
    assert got == want


def test_scan(spark, tmp_path):
    for name, body in (("a.md", "# A"), ("sub/_b c.MD", "x"), (".hid/c.md", "x"), ("d.png", ""), (".e.md", "x"), ("sub/f.txt", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    got = {r["relative_path"]: r for r in notes.scan_notes(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.md", "sub/_b c.MD"] and got["a.md"]["title"] == "A"
    assert got["a.md"]["content_hash"] == hashlib.sha256(b"# A").hexdigest()
    assert tuple(notes.scan_stats(notes.listing(notes.paths_below(spark, str(tmp_path)))).first()) == (4, 2, 2)


def test_unreadable_files_are_skipped(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.md").write_text("---\ntags: 5\n---\ny")
    (tmp_path / "gone.md").symlink_to(tmp_path / "nothing")
    monkeypatch.setattr(notes, "paths_below", lambda s, r: s.createDataFrame([("a.md",), ("b.md",), ("gone.md",)], "relative_path string"))
    files = notes.read_files(spark, str(tmp_path))
    assert [r["relative_path"] for r in notes.parsed(files).collect()] == ["a.md"] and notes.parse_failures(files).first()["failures"] == 2


def cut(source, size):
    return [c for c in packed_chunks(source, size) if c.strip()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["w", "two words", "a. ", "b! ", "\n", "\n\n", " ", "long one here? ", "x y"]), max_size=60), st.integers(1, 9))
def test_split_bounds(parts, size):
    source = "".join(parts)
    chunks = cut(source, size)
    assert all(0 < len(c.split()) <= size for c in chunks)
    letters = lambda s: re.sub(r"[^a-z]", "", s)
    assert letters("".join(chunks)) == letters(source)


def test_split_cases():
    assert cut("", 5) == [] and cut("  a b  ", 5) == ["a b"]
    assert cut("a b c\n\nd e\n\nf g", 4) == ["a b c", "d e\n\nf g"]
    assert cut("w " * 7, 3) == ["w w w", "w w w", "w"]
    assert cut("one two. three four. five", 2) == ["one two", "three four", "five"]
    # the last part of what was cut goes on
    assert cut("a\n\nb c d e f. g\n\nh", 4) == ["a", "b c d e", "f. g\n\nh"]


def test_packed_is_what_loops_give(spark):
    r = random.Random(8)
    parts = ["w", "two words", "a. ", "b! ", "\n", "\n\n", " ", "long one here? ", "x y", "\u00a0", ". ", "\t", "é. "]
    texts = [None, "", " \n ", "w " * 50, "a.b " * 9, *("".join(r.choice(parts) for _ in range(r.randrange(1, 80))) for _ in range(400))]
    for size in (1, 3, 8):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        for row in df.select("t", chunk.packed(F.col("t"), size).alias("c")).collect():
            assert (row["c"] or []) == cut(row["t"] or "", size), (row["t"], size)


def note_rows(spark, raws, **fields):
    rows = [(f"p{i}.md", fields.get("title", "T"), r, ["t"], hashlib.sha256(r.encode()).hexdigest()) for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, "relative_path string, title string, raw_content string, tags array<string>, content_hash string")


def test_sections_and_breadcrumbs(spark):
    raw = "intro\n# H1\na\n## H2\nb\n### H3\nc\n## H2b\n\n# Next\nd"
    got = chunk.chunked(note_rows(spark, [raw])).orderBy("chunk_index").collect()
    assert [r["heading_path"] for r in got] == [["T"], ["H1"], ["H1", "H2"], ["H1", "H2", "H3"], ["Next"]]
    assert got[3]["chunk_text"] == "[Note: H1 | Section: H2 > H3]\n\nc" and got[0]["chunk_text"] == "[Note: T]\n\nintro"
    assert [r["total_chunks"] for r in got] == [5] * 5 and got[0]["word_count"] == 3
    assert got[2]["chunk_id"] == hashlib.sha256(f"{got[0]['note_id']}:2".encode()).hexdigest()
    deep = chunk.chunked(note_rows(spark, ["## Only\nx"])).first()
    assert deep["heading_path"] == ["T", "Only"]
    assert chunk.chunked(note_rows(spark, ["", "  \n", "# H\n## I"])).count() == 0


def test_overlap_against_python(spark):
    random.seed(4)
    raws = [" ".join(f"w{i}" for i in range(n)) for n in (5, 20, 47, 100)] + ["# H\n" + ". ".join(" ".join(random.choices("abc", k=k)) for k in range(1, 14))]
    got = {}
    for r in chunk.chunked(note_rows(spark, raws), Settings(chunk_size=20, chunk_overlap=6)).orderBy("note_path", "chunk_index").collect():
        got.setdefault(r["note_path"], []).append(r["chunk_text"].split("]\n\n", 1)[1])
    for i, raw in enumerate(raws):
        plain = cut(raw.removeprefix("# H\n"), 20)
        want = [c if j == 0 else " ".join(plain[j - 1].split()[-6:]) + "\n\n" + c for j, c in enumerate(plain)]
        assert got[f"p{i}.md"] == want


def test_settings_guard():
    with pytest.raises(ValueError):
        Settings(chunk_size=10, chunk_overlap=10)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB1 é_ -.\n漢", max_size=12), min_size=1, max_size=6))
def test_tokens_words_estimates(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    rows = df.select("raw", text.keyword_tokens(RAW).alias("k"), text.words(RAW).alias("w"), text.estimated_tokens(RAW).alias("e"), text.stripped(RAW).alias("s")).collect()
    for r in rows:
        t = r["raw"]
        assert r["k"] == [x for x in re.findall(r"\b[a-z0-9]+\b", t.lower()) if x not in text.STOP_WORDS and len(x) > 1]
        assert r["w"] == t.split() and r["s"] == t.strip() and r["e"] == (max(1, len(t) // 4) if t else 0)


def test_python_fixed(spark):
    values = [i / 1000 for i in range(0, 3000, 5)] + [0.125, 0.375, 2.675, -0.005]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert [r[0] for r in df.select(text.python_fixed(F.col("v"))).collect()] == [f"{v:.2f}" for v in values]
