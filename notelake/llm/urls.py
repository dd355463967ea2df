"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_URL = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")

#: Words of hosts that are unwanted, and of hosts that are not; words put beside the former, and beside either.
UNWANTED = ("casino", "poker", "roulette", "jackpot", "blackjack", "slots", "betting", "bookmaker", "wager", "lottery", "viagra", "cialis", "pharmacy", "steroid", "dietpill", "weightloss", "porn", "adult", "xxx", "escort", "webcam", "hookup", "nude", "fetish", "spam", "phishing", "malware", "trojan", "warez", "keygen", "cracked", "torrent", "payday", "loan", "debt", "forex", "pyramid", "doubler", "giveaway", "replica", "counterfeit", "clickbait", "popup", "ads", "adserver", "banner", "affiliate", "backlink")
WANTED = ("news", "weather", "library", "museum", "science", "garden", "recipe", "history", "travel", "music", "forum", "developer", "research", "health", "council", "book", "archive", "journal", "theatre", "nature", "school", "university", "hospital", "bakery", "cycling", "astronomy", "chemistry", "language", "grammar", "railway", "heritage", "poetry", "gallery", "orchestra", "kitchen", "climate", "geology", "mountain", "harbour", "village", "parish", "football", "cricket", "chess", "law", "charity", "wildlife", "software")
PUSHY = ("cheap", "free", "instant", "lucky", "bonus", "hot", "cash", "quick")
PLAIN = ("best", "my", "the", "pro", "online", "hub", "zone", "club", "world", "direct", "central", "daily", "first", "live")
SYLLABLES = ("ba", "cor", "den", "el", "fin", "gra", "hol", "in", "ka", "lo", "mer", "nor", "o", "pel", "ri", "sa", "tan", "u", "ver", "wic", "ter", "ton", "by", "field", "ley", "son", "tion", "ther", "ing", "es")
SHAPES = ("http://www.{}.example.com/en/1", "https://{}.example.org/fr/2?ref=x", "http://m.{}.example.net/de/3.html", "https://blog.{}.example.com/es/4/", "https://{}.example.net/en/5#top")
#: Unwanted from this probability on: of steps of 0.05 the least at which five folds by word (``held_out``) block at most
#: 2 in 100 wanted hosts.
THRESHOLD = 0.6


def labelled_hosts() -> list[tuple[str, int, str]]:
    """(host, unwanted, first word that it is made of): each word alone, beside others of its kind and beside others that
    tell little, and invented names, which are wanted. No host occurs twice."""
    rng, out = np.random.default_rng(8), {}
    for y, words in ((1, UNWANTED), (0, WANTED)):
        for w in words:
            out[w] = (y, w)
            for others, n in ((words, 4), (PUSHY + PLAIN if y else PLAIN, 4)):
                for other in rng.choice([x for x in others if x != w], n, replace=False):
                    pair = (w, str(other)) if rng.random() < 0.5 else (str(other), w)
                    out.setdefault(("-" if rng.random() < 0.5 else "").join(pair), (y, w))
    for _ in range(len(out) // 3):
        name = "".join(rng.choice(SYLLABLES, rng.integers(2, 5)))
        out.setdefault(name, (0, name))
    return [(h, y, w) for h, (y, w) in out.items()]


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: each host in one shape, all shapes alike often for both labels."""
    return [(SHAPES[i % len(SHAPES)].replace("{}", h), y) for i, (h, y, _) in enumerate(labelled_hosts())]


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
    ``#`` or the end. Both empty for null and without ``://``."""
    m = _URL.match(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def grams(mark: str, text: str, low: int = 3, high: int = 5) -> list[str]:
    """Character n-grams of a host or path, marked apart, ends included."""
    text = f"^{text}$"
    return [mark + text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]


#: Share of a URL's squared length that its host has; its path has the rest. What the host says is alike on all its pages.
HOST_SHARE = 0.99


@dataclass(frozen=True)
class UrlModel:
    """Logistic regression; the weights of ``2 ** bits`` hashed n-grams (CRC-32 of their UTF-8), a bias, and the share of
    unwanted URLs in the labels."""

    bits: int
    weights: np.ndarray
    bias: float
    share: float = 0.5

    def features(self, host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the n-grams and their values, alike among a host's and among a path's: each has its share of a vector
        of unit length, so neither part weighs less beside a longer one."""
        mask, slots, values = (1 << self.bits) - 1, [], []
        for mark, text, share in (("h", host, HOST_SHARE), ("p", path, 1 - HOST_SHARE)):
            own = np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in grams(mark, text)), dtype=np.int64))
            slots.append(own)
            values.append(np.full(len(own), np.sqrt(share / max(1, len(own)))))
        return np.concatenate(slots), np.concatenate(values)

    def probability(self, host: str, path: str) -> float:
        """Probability that the URL is unwanted; of one without any n-gram the labels' share (a bias says nothing alone)."""
        slots, values = self.features(host, path)
        if not len(slots):
            return self.share
        return float(1 / (1 + np.exp(-(self.bias + (self.weights[slots] * values).sum()))))


#: Weight of half the squared length of the weights beside the mean loss.
PENALTY = 3e-5


def trained(labelled: Sequence[tuple[str, int]], bits: int = 18, rounds: int = 1500, penalty: float = PENALTY) -> UrlModel:
    """The least mean logistic loss plus ``penalty`` on the whole labelled table, which is small (thousands of rows at
    most), by accelerated gradient descent. The loss has one minimum, so the model is that of any solver."""
    model = UrlModel(bits, np.zeros(1 << bits), 0.0)
    rows = [(model.features(*host_and_path(u)), y) for u, y in labelled]
    if not rows:
        return model
    y, sizes = np.array([r[1] for r in rows], dtype=float), np.array([len(r[0][0]) for r in rows])
    slots, col = np.unique(np.concatenate([r[0][0] for r in rows]), return_inverse=True)
    row, value = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[0][1] for r in rows])
    w, b = np.zeros(len(slots)), 0.0
    ahead_w, ahead_b, root = w, b, np.sqrt(penalty / 0.5)  # the loss curves by 0.5 at most: unit vectors and a bias
    momentum = (1 - root) / (1 + root)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(np.bincount(row, value * ahead_w[col], len(rows)) + ahead_b))) - y
        new_w = ahead_w - 2 * (np.bincount(col, value * g[row], len(slots)) / len(rows) + penalty * ahead_w)
        new_b = ahead_b - 2 * g.mean()
        ahead_w, ahead_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    weights = np.zeros(1 << bits)
    weights[slots] = w
    return UrlModel(bits, weights, float(b), float(y.mean()))


def held_out(by_word: bool = False, folds: int = 5, **options) -> list[tuple[str, int, float]]:
    """(host, unwanted, probability) of every labelled host by a model that was trained without that host and a fifth of
    the others; ``by_word``: without any host that has its first word."""
    hosts, urls = labelled_hosts(), labelled_urls()
    order = np.random.default_rng(5).permutation(len(hosts))
    words = {w: i % folds for i, w in enumerate(dict.fromkeys(hosts[i][2] for i in order))}
    fold = [words[w] if by_word else int(np.flatnonzero(order == i)[0]) % folds for i, (_, _, w) in enumerate(hosts)]
    out = []
    for k in range(folds):
        bad = {w for w, f in words.items() if f == k} if by_word else set()
        model = trained([u for u, (h, _, _), f in zip(urls, hosts, fold, strict=True) if f != k and not any(w in h for w in bad)], **options)
        out += [(h, y, model.probability(*host_and_path(u))) for (u, _), (h, y, _), f in zip(urls, hosts, fold, strict=True) if f == k]
    return out


def by_domain(rules: Iterable[str]) -> dict[str, list[tuple[str, str]]]:
    """(start of path, rule) by the rules' hosts."""
    out: dict[str, list[tuple[str, str]]] = {}
    for rule in rules:
        at = rule.find("/")
        out.setdefault(rule[:at], []).append((rule[at:], rule))
    return out


def matching_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> str | None:
    """The longest rule (host and start of path; ties to the lesser) that fits the host or a parent domain of it; of rules
    ``by_domain`` only those of these domains are tried."""
    labels = host.split(".")
    domains = (".".join(labels[i:]) for i in range(len(labels)))
    fit = [rule for d in domains for start, rule in rules.get(d, ()) if path.startswith(start)]
    return min(fit, key=lambda rule: (-len(rule), rule), default=None)


#: The rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def judged_urls(pages: DataFrame, rules: dict[str, str] = RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, p_unwanted, verdict for every row: the longest fitting rule's verdict, else block
    where the model finds the URL unwanted with at least ``threshold``.

    Rules are ``host/path``: they fit the host and its subdomains where the path starts alike. Null urls and those
    without ``://`` have an empty host and path, fit no rule and get the verdict of the labels' share of unwanted ones
    (allow as shipped). Only the ids and urls are read. Rows that repeat are judged each; an empty table gives no rows.
    The model (bounded by its number of slots) goes to the tasks with the function.
    """
    model, own_rules = trained(labelled_urls() if labelled is None else labelled), by_domain(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "host", "path", "rule", "p_unwanted", "verdict"]
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = host_and_path(url)
                rule, p = matching_rule(host, path, own_rules), model.probability(host, path)
                out.append((host, path, rule, p, rules[rule] if rule else "block" if p >= threshold else "allow"))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, p_unwanted double, verdict string")
