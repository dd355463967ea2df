"""Main texts of pages: hand-made pages of many shapes, templates, and the given pages against plain cutting."""

import html
import random
import re

import pytest
from notelake.llm import queries as q
from notelake.llm import templates
from notelake.llm.common import Scratch

NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav>"
FOOT = "<footer>&copy; 2024 Site <a href=/imprint>Imprint</a></footer>"


def texts(spark, pages, extra=()):
    rows = [(i, u, h, *["z" for _ in extra]) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, ", ".join(["page_id long", "url string", "html string", *[f"`{c}` string" for c in extra]]))
    out = templates.main_texts(df)
    assert out.columns == ["page_id", "url", "html", *[c for c in extra if c != "text"], "text"]
    return [r["text"] for r in sorted(out.collect(), key=lambda r: r["page_id"])]


def sentence(r):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(6, 30))) + "."


def shaped(kind, r, n):
    """A page of a site's shape and the blocks of its article."""
    blocks = [sentence(r) for _ in range(n)]
    ps = "".join(f"<p>{b}</p>" for b in blocks)
    menu = "".join(f"<li><a href='/{i}'>Item {r.choice('xyz')}{i}</a></li>" for i in range(6))
    if kind == "article":
        title = sentence(r)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body><header class=top><a>Logo</a><h2>Slogan</h2></header>{NAV}<div class='ad-box'>{sentence(r)}</div><article id=post-{n}><h1>{title}</h1>{ps}<section class=comments><h3>2 comments</h3><p>{sentence(r)}</p></section></article><aside>{sentence(r)}</aside>{FOOT}</body></html>"
        return page, [title, *blocks]
    if kind == "divs":
        title = sentence(r)
        page = f"<html><body><div class=wrap><div id=menu><ul>{menu}</ul></div><h1>{title}</h1><div class=story>{ps}</div><div class='side-bar'>{' '.join(sentence(r) for _ in range(20))}</div><div class=cookie-notice>We use cookies.</div><form><p>Write to us</p><input name=q><button>Send</button></form></div></body></html>"
        return page, [title, *blocks]
    page = f"<body><main>{ps}<div class='share'>Share this</div></main>{FOOT}<script>var x = '<p>no</p>';</script>"
    return page, blocks


@pytest.mark.parametrize("kind", ["article", "divs", "main"])
@pytest.mark.parametrize("hosts", [1, 30])
def test_shapes(spark, kind, hosts):
    """Thirty pages of one host, which share its template, and of thirty hosts with a page each."""
    r = random.Random(hosts)
    made = [shaped(kind, r, 2 + i % 5) for i in range(30)]
    got = texts(spark, [(f"http://h{i % hosts}.example.com/{i}", page) for i, (page, _) in enumerate(made)])
    assert got == ["\n\n".join(blocks) for _, blocks in made]


def test_copies(spark):
    """A page that stands at many addresses keeps its whole text, also where all of a host's pages are alike."""
    page, blocks = shaped("article", random.Random(1), 4)
    same = "<p>This line is on every page.</p>"
    others = [page.replace("</h1>", f"</h1>{same}<p>{i}</p>") for i in range(5)]
    got = texts(spark, [("http://a.b/1", page)] * 6 + [("http://c.d/", o) for o in others])
    want = "\n\n".join(blocks)
    assert got == [want] * 6 + [want.replace(blocks[0], f"{blocks[0]}\n\nThis line is on every page.\n\n{i}", 1) for i in range(5)]


def test_place_by_template(spark):
    """The place is that of the group: on one page, the box beside has more text than the article."""
    r = random.Random(4)
    shape = "<body><div class=left>{}</div><div class=right><p>{}</p></div></body>"
    pages = [shape.format("".join(f"<p>{sentence(r)}</p>" for _ in range(9)), "short") for _ in range(8)]
    pages.append(shape.format("<p>tiny article</p>", sentence(r) * 30))
    assert texts(spark, [("http://a.b/", p) for p in pages])[-1] == "tiny article"


def test_classes(spark):
    """Tokens of one occurrence vector are a class; where their order or nesting differs, elements stand alone."""
    pages = [f"<body><div class=a><p>fixed</p></div>{'<div class=b>x%d</div><div class=c>y%d</div>' % (i, i) if i % 2 else '<div class=c>y%d</div><div class=b>x%d</div>' % (i, i)}<ul>{'<li>z' * (i + 1)}</ul></body>" for i in range(6)]
    rows = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, doc long, source string")
    template, _ = templates.deduced_templates(rows, Scratch())
    marks = {m["token"]: m["class"] for m in template.first()["marks"]}
    tokens = [[t for t, _ in templates.tokens_of(p)] for p in pages]
    shared = set.intersection(*map(set, tokens))
    assert set(marks) == shared
    by = {}
    for t, c in marks.items():
        by.setdefault(c, set()).add(t)
    sizes = sorted(len(v) for v in by.values())
    assert sizes == [1, 2, 2, 2, 2, 2, 2, 3]  # the fixed text; body, a, p, b, c, ul: as b and c change places, one by one; li and its text
    pages = [p.replace("class=b", "class=q").replace("class=c", "class=q") for p in pages]
    rows = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, doc long, source string")
    template, _ = templates.deduced_templates(rows, Scratch())
    by = {}
    for m in template.first()["marks"]:
        by.setdefault(m["class"], set()).add(m["token"])
    assert sorted(len(v) for v in by.values()) == [2, 3, 9]  # q; li and its text; body, a, p, its text and ul together


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain &lt;text&gt;\n here", "plain <text> here"),
        ("<article><p>a<b>b</b>c <i>d<p>e<br>f&amp;nbsp;&nbsp;g", "abc d\n\ne f&nbsp; g"),
        ("<article>one<p>two</p>three<div>four<!-- no --></div>five</article>six", "one\n\ntwo\n\nthree\n\nfour\n\nfive"),
        ("<head><title>t</title><meta x></head><body><p>x</p><script>if (a < b) '</p>'</script>y</body>", "x\n\ny"),
        ("<title>t</title><p>x</p><style>never closed <p>z", "x"),
        ("<body><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\nc\n\nd\n\n1\n\n2\n\n3"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x <button>like</button>y</p><footer>f</footer></article>", "T\n\nx y"),
        ("<nav>only</nav><footer>menus</footer>", ""),
        ("<p>1 < 2 && a<b</p> > c", "1 < 2 && a > c"),
        ('<p title="a > b">x</p><p title="open>y</p>', "x\n\ny"),
        ("<h1>a<h2>b</h1>c</p></b></div>", "a\n\nb\n\nc"),
        ("&#x41;&#66;&eacute;&bogus;&amp", "ABé&bogus;&"),
        ("<?xml version='1.0'?><!DOCTYPE x></ ><body>x", "x"),
        ("<article><p>a <!-- open", "a"),
        ("<p>a</p><a href='", "a"),
    ],
)
def test_blocks(source, want):
    assert templates.main_text(source, None) == want


def test_edges(spark):
    assert texts(spark, []) == []
    long = "<article>" + "<p>word</p>" * 20_000 + "<div>" * 3_000 + "deep"
    rows = [("http://x.y/", None), (None, ""), (None, "<p>a</p>"), ("no host", "<p>a</p>"), ("http://x.y/", "<p>a</p>"), ("http://x.y/", "<p>a</p>"), ("HTTP://X.Y?q", long), ("http://x.y", "\n ")]
    got = texts(spark, rows, extra=("text", "host", "a.b", "_page", "doc", "place"))
    assert got == ["", "", "a", "a", "a", "a", "\n\n".join(["word"] * 20_000 + ["deep"]), ""]


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = q.op12_html(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        source = pages[r["page_id"]]["html"]
        inside = source[source.index("<article>") + 9 : source.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert (r["url"], r["text"]) == (pages[r["page_id"]]["url"], "\n\n".join(filter(None, blocks)))
        assert r["n_chars"] == len(r["text"])
