"""Main texts of web pages, by deducing the template that the pages of a host share.

A page is a sequence of tokens: elements that open and close, by their path, and blocks of text. Tokens that occur
equally often on every page of a group share an occurrence vector and so a class. Classes whose tokens keep one order
and nest with the others make the template; what stands between its tokens are slots. The element around the slots
with the most text of the pages' own is where the group's articles lie.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, lean, named, text_or_empty

#: Elements of HTML by what they mean for text.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CONTAINERS = frozenset("article aside body center details div fieldset main section td".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
_DROPPED = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Words of class, id and role that tell what isn't the article.
_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|side-?bars?|widgets?|menus?|menubar|nav|navbar|navigation|breadcrumbs?|foot|footers?|copyright|colophon|contentinfo|complementary|cookies?|cookie\w*|consent|gdpr|notices?"
    r"|notification\w*|alerts?|pop-?ups?|modals?|overlays?|newsletters?|subscri\w*|sign-?up|log-?in|search|share|sharing|social|related|recommend\w*|comment\w*|disqus|discussion|replies|respond|pagination|pager|toolbar|tracking)(?![a-z])"
)
_HEADS = re.compile(r"(?<![a-z])(?:headers?|masthead)(?![a-z])")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z>][^>]*)?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

# Low bits of a token: its kind, then what its element is.
OPEN, CLOSE, TEXT = 0, 1, 2
_CONTAINER, _OUT, _ARTICLE, _MAIN, _TITLE = 4, 8, 16, 32, 64
_LOW = 255
_LEAST_PAGES = 3  # of a host, for a template of its own
_SUPPORT = 10  # a token of a template is on one page in so many, and on two
_PER_TASK = 1024  # pages that share one copy of their group's template


def host_of(url: Column) -> Column:
    """The host, in lower case; empty for null and for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


class _Element(NamedTuple):
    tag: str
    block: bool
    path: str  # hash of the parent's and its own name, so that deep nesting stays small
    drop: int  # 0: nothing, 1: all but headings, 2: all
    mute: bool  # inside a dropped inline element
    closing: int  # its token where it closes


@lru_cache(maxsize=1 << 16)
def _named(parent: str, label: str, flags: int) -> tuple[str, int, int]:
    """An element's path, and its tokens where it opens and closes."""
    path = f"{_signed(f'{parent}/{label}', 0):x}"
    return path, _signed(path, flags | OPEN), _signed(path, flags | CLOSE)


def _signed(path: str, flags: int) -> int:
    import xxhash

    n = xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) & ~_LOW | flags
    return n - (1 << 64) if n >> 63 else n


def _is_heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def tokens_of(source: str) -> Iterator[tuple[int, str]]:
    """(token, text) of a page in order; elements that aren't closed end where HTML ends them."""
    stack = [_Element("", True, "", 0, False, 0)]
    pieces: list[str] = []

    def flush() -> Iterator[tuple[int, str]]:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            top = next(e for e in reversed(stack) if e.block)
            out = _OUT if top.drop == 2 or (top.drop == 1 and not _is_heading(top.tag)) else 0
            yield _signed(f"{top.path}\0{text}", TEXT | out | (_TITLE if top.tag == "h1" else 0)), text

    def close(depth: int) -> Iterator[tuple[int, str]]:
        """Ends all elements from ``depth`` on."""
        if any(e.block for e in stack[depth:]):
            yield from flush()
        while len(stack) > depth:
            e = stack.pop()
            if e.block:
                yield e.closing, ""

    at = 0
    while at < len(source):
        m = _TAG.search(source, at)
        end = m.start() if m else len(source)
        if end > at and not stack[-1].mute:
            pieces.append(entities.unescape(source[at:end]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag in _BLOCKS
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag or (_is_heading(tag) and _is_heading(stack[depth].tag)):
                    yield from close(depth)
                    break
                if (stack[depth].block and not block) or stack[depth].tag in _ENDS.get(tag, ()):
                    break
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if block:  # what the new element ends: a paragraph, the head, an item of the same list, a heading
            top = len(stack) - 1
            while not stack[top].block:
                top -= 1
            if stack[top].tag in ("p", "head") or (_is_heading(tag) and _is_heading(stack[top].tag)):
                yield from close(top)
            if tag in _ENDS:
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in same:
                        yield from close(depth)
                        break
                    if stack[depth].tag in _ENDS[tag]:
                        break
            yield from flush()
        if tag in _RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = ended.end() if ended else len(source)
            continue
        if tag in _VOID:
            continue
        names = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(m[3])} if len(m[3]) > 3 else {}
        parent, sectioning = stack[-1], tag in ("article", "main", "body", "html")
        drop = 2 if tag in _DROPPED else 1 if tag == "header" else 0
        if names and not drop and not sectioning:
            said = " ".join(names.values()).replace("_", "-")
            drop = 2 if _NAMES.search(said) else 1 if _HEADS.search(said) else 0
        if drop == 1 and not any(e.tag in ("article", "main") for e in stack):
            drop = 2
        drop = max(drop, parent.drop)
        if not block:
            stack.append(_Element(tag, False, parent.path, drop, parent.mute or (drop == 2 and parent.drop < 2), 0))
            continue
        label = re.sub(r"\d+", "", f"{tag}.{names.get('class', '')}#{names.get('id', '')}") if names else tag
        main = _MAIN if tag == "main" or names.get("role") == "main" else 0
        flags = (_CONTAINER if tag in _CONTAINERS else 0) | (_OUT if drop else 0) | (_ARTICLE if tag == "article" else 0) | main
        path, opening, closing = _named(parent.path, label, flags)
        stack.append(_Element(tag, True, path, drop, parent.mute, closing))
        yield opening, ""
    yield from close(1)
    yield from flush()


def _places(tokens: list[int], sizes: list[int], template: Container[int] | None = None) -> Counter:
    """How many characters of text, other than the template's own, lie in each element where an article may lie: one
    that the template has (where given), that is once on the page and isn't dropped. Text counts for the outermost
    article around it, else the outermost main element, else the innermost container."""
    times, around, found = Counter(tokens), [], Counter()
    for token, size in zip(tokens, sizes, strict=True):
        kind = token & 3
        if kind == OPEN:
            fits = token & _CONTAINER and not token & _OUT and times[token] == 1 and (template is None or token in template)
            around.append(token if fits else None)
        elif kind == CLOSE:
            around.pop()
        elif not token & _OUT and (template is None or token not in template):
            fit = [t for t in around if t is not None]
            best = next((t for t in fit if t & _ARTICLE), None) or next((t for t in fit if t & _MAIN), None) or (fit[-1] if fit else None)
            if best is not None:
                found[best] += size
    return found


def _own_place(tokens: list[int], sizes: list[int]) -> int | None:
    """The element with most text on one page."""
    found = _places(tokens, sizes)
    return max(found, key=lambda t: (found[t], t), default=None)


def _checked(tokens: list[int], classes: dict[int, int]) -> Iterator[tuple[int, int, bool]]:
    """(class, hash of its tokens' order, whether it keeps that order all along and nests with the others) of a page's
    classes."""
    own: dict[int, list[int]] = {}
    for t in tokens:
        if t in classes:
            own.setdefault(classes[t], []).append(t)
    order = {c: list(dict.fromkeys(ts)) for c, ts in own.items()}
    bad = {c for c, ts in own.items() if len(ts) % len(order[c]) or ts != order[c] * (len(ts) // len(order[c]))}
    rank = {t: i for c, ts in order.items() for i, t in enumerate(ts)}
    inside: list[list[int]] = []  # classes that are under way, and the rank of the token seen last
    for t in tokens:
        c = classes.get(t)
        if c is None or c in bad or len(order[c]) == 1:
            continue
        if rank[t] == 0:
            inside.append([c, 0])
            continue
        if inside[-1][0] != c:  # it began before another that hasn't ended
            bad.update(x for x, _ in inside[next(i for i, (x, _) in enumerate(inside) if x == c) + 1 :])
            inside = [x for x in inside if x[0] not in bad]
        inside[-1][1] = rank[t]
        if rank[t] == len(order[c]) - 1:
            inside.pop()
    for c, ts in order.items():
        yield c, _signed(",".join(map(str, ts)), 0), c not in bad


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for b in _small(batches):
        skeletons, tokens, sizes, kinds, times, own = [], [], [], [], [], []
        for source in b.column(2).to_pylist():
            pairs = list(tokens_of(source))
            tokens.append([t for t, _ in pairs])
            sizes.append([len(x) for _, x in pairs])
            own.append(_own_place(tokens[-1], sizes[-1]))
            n = Counter(tokens[-1])
            kinds.append(list(n))
            times.append(list(n.values()))
            skeletons.append(_signed(",".join(map(str, sorted(t for t in n if t & 3 == OPEN and t & _CONTAINER))), 0))
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(skeletons, pa.int64()), pa.array(tokens, longs), pa.array(sizes, ints), pa.array(kinds, longs), pa.array(times, ints), pa.array(own, pa.int64())], ["host", "doc", "skeleton", "tokens", "sizes", "kinds", "times", "own"])


def _with_template(pages: DataFrame, template: DataFrame) -> DataFrame:
    """Pages beside their group's template (group, pages, marks: array of (token, class)), one copy for ``_PER_TASK``."""
    copies = F.sequence(F.lit(0).cast("long"), F.floor(F.col("pages") / _PER_TASK))
    dealt = template.select("group", F.explode(copies).alias("copy"), F.col("marks.token").alias("t"), F.col("marks.class").alias("c"))
    return pages.withColumn("copy", F.pmod("doc", F.floor(F.col("pages") / _PER_TASK) + 1)).join(dealt, ["group", "copy"])


def _each_page(b: pa.RecordBatch) -> Iterator[tuple]:
    """(group, tokens, sizes, template: class by token) of rows; rows of one group lie together and share a template."""
    last, template = None, {}
    for i, group in enumerate(b.column(0).to_pylist()):
        if group != last or i == 0:
            last, template = group, dict(zip(b.column(3)[i].as_py(), b.column(4)[i].as_py(), strict=True))
        yield group, b.column(1)[i].as_py(), b.column(2)[i].as_py(), template


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(group, *x) for group, tokens, _, template in _each_page(b) for x in _checked(tokens, template)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["group", "class", "order", "ok"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for group, tokens, sizes, template in _each_page(b):
            for place, chars in _places(tokens, sizes, template).items():
                found[group, place] += chars
        rows = [(*k, n) for k, n in found.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(3)], ["group", "place", "chars"])


def deduced_templates(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of pages (host, doc: hash of the source, source): (group, pages, marks) templates, and (host, doc, place): the
    element in which the articles of a distinct page's group lie, for the pages that have it once and, looked at alone,
    would have chosen another.

    Hosts with ``_LEAST_PAGES`` distinct pages are groups; pages of smaller ones are grouped by the elements that they
    are made of. Only tokens and counts move, added up per group and token first.
    """
    kinds = "host string, doc long, skeleton long, tokens array<long>, sizes array<int>, kinds array<long>, times array<int>, own long"
    each = pages.mapInArrow(lean(_tokenised), kinds).dropDuplicates(["host", "doc"])
    each = scratch.keep(each, "page-tokens")
    hosts = each.groupBy("host").agg(F.count(F.lit(1)).alias("of_host")).filter(F.col("of_host") >= _LEAST_PAGES)
    group = F.when(F.col("of_host").isNotNull(), F.xxhash64(F.lit("host"), "host")).otherwise(F.xxhash64(F.lit("skeleton"), "skeleton"))
    each = each.join(hosts, "host", "left").withColumn("group", group).drop("of_host", "skeleton")
    sizes = each.groupBy("group").agg(F.count(F.lit(1)).alias("pages"))
    each = scratch.keep(each.join(sizes, "group"), "page-groups")

    times = each.select("group", "pages", "doc", F.explode(F.arrays_zip("kinds", "times")).alias("_o"))
    vector = [F.bit_xor(F.xxhash64("doc", "_o.times", F.lit(i))).alias(f"v{i}") for i in (0, 1)]
    marks = times.groupBy("group", F.col("_o.kinds").alias("token")).agg(F.count(F.lit(1)).alias("support"), F.max("pages").alias("pages"), *vector)
    marks = marks.filter((F.col("support") >= 2) & (F.col("support") * _SUPPORT >= F.col("pages")))
    marks = scratch.keep(marks.withColumn("class", F.xxhash64("support", "v0", "v1")), "page-classes")

    def gathered(df: DataFrame) -> DataFrame:  # at most _SUPPORT times a page's tokens
        return df.groupBy("group").agg(F.max("pages").alias("pages"), F.collect_list(F.struct("token", "class")).alias("marks"))

    seen = _with_template(each, gathered(marks)).select("group", "tokens", "sizes", "t", "c")
    checks = seen.mapInArrow(lean(_check), "group long, class long, order long, ok boolean").groupBy("group", "class").agg((F.min("ok") & (F.min("order") == F.max("order"))).alias("ok"))
    single = F.when(F.col("token").bitwiseAND(3) == TEXT, F.col("token")).otherwise(F.col("token") - F.col("token").bitwiseAND(3))
    valid = marks.join(checks, ["group", "class"]).withColumn("class", F.when(F.col("ok"), F.col("class")).otherwise(single))  # what isn't valid as a whole falls into its elements
    template = scratch.keep(gathered(valid), "page-templates")

    placed = _with_template(each, template).select("group", "tokens", "sizes", "t", "c")
    places = placed.mapInArrow(lean(_place), "group long, place long, chars long").groupBy("group", "place").agg(F.sum("chars").alias("chars"))
    places = places.filter("chars > 0").groupBy("group").agg(F.max_by("place", F.struct("chars", "place")).alias("place"))
    once = F.size(F.filter("tokens", lambda t: t == F.col("place"))) == 1
    others = each.select("group", "host", "doc", "tokens", "own").join(places, "group").filter(~F.col("place").eqNullSafe(F.col("own")) & once)
    return template, others.select("host", "doc", "place")


def main_text(source: str, place: int | None) -> str:
    """Blocks of text inside the element ``place``; of a page without it, inside the one with most text of its own. A
    title right before an element that is no article belongs to it."""
    pairs = list(tokens_of(source))
    tokens = [t for t, _ in pairs]
    if tokens.count(place) != 1:
        place = _own_place(tokens, [len(x) for _, x in pairs])
    if place is None:
        return "\n\n".join(x for t, x in pairs if x and not t & _OUT)
    begin, end = tokens.index(place), tokens.index(place | CLOSE)
    out = [x for t, x in pairs[begin:end] if x and not t & _OUT]
    if not place & _ARTICLE and not any(t & 3 == TEXT and t & _TITLE for t in tokens[begin:end]):
        out[:0] = [x for t, x in pairs[:begin] if x and t & _TITLE and not t & _OUT][-1:]
    return "\n\n".join(out)


def main_texts(pages: DataFrame, url: Column | None = None, source: Column | None = None) -> DataFrame:
    """The pages with ``text``, the main text: paragraphs and other blocks joined by an empty line.

    A null page has an empty text, as has one without an article; a null URL belongs to the empty host; rows that
    repeat get the same text each; very long pages are read whole; no pages give no rows. Columns of any names stay,
    but for ``text``.
    """
    scratch = Scratch()
    url, source = F.col("url") if url is None else url, text_or_empty("html") if source is None else source
    kept = [c for c in pages.columns if c != "text"]
    own = F.struct(*map(named, kept)).alias("_page")
    rows = pages.select(own, host_of(url).alias("host"), source.alias("_source")).withColumn("doc", F.xxhash64("_source"))
    _, places = deduced_templates(rows.select("host", "doc", "_source"), scratch)
    places = scratch.keep(places, "page-places")  # few: the sources themselves needn't be shuffled then
    joined = rows.join(bounded_broadcast(places, places.count(), 64), ["host", "doc"], "left").select("_page", "_source", "place")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            texts = [main_text(s, p) for s, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_page", "text"])

    schema = joined.select("_page", F.lit("").alias("text")).schema
    out = joined.mapInArrow(lean(extract), schema)
    return out.select(*[F.col("_page").getField(c).alias(c) for c in kept], "text")
