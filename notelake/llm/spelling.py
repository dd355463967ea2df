"""Spelling variants: words one edit apart, by an even-partition pigeonhole join, and the commonest form of each.

One edit leaves one half of a word as it is. So a word is indexed by what is left of it when either half is cut out, and
probed by the same of words as long, and by what words one longer leave with a hole one wider. Where a key has too many
words, its hole is cut in half again: the edit lies in one half, the other one joins the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

#: A run of letters; lower case is made of A to Z alone.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ONE_IN = 97  # runs of which one loses a code point
_MEETING = 64  # words that may meet under one key before its hole is cut again
_KEY = ("length", "low", "high", "rest")


def runs(text: Column) -> Column:
    """Maximal runs of letters of a whole text, A to Z lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.translate(r, _UPPER, _LOWER))


def with_slips(run: Column, doc_id: Column) -> Column:
    """The run, or, if its hash with the document's id is divisible by 97, the run without one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % _ONE_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n: the words of all texts with so many code points and occurrences at least. Null texts have none; a null
    doc_id counts as an empty one; rows that repeat count each."""
    own = docs.select("doc_id", text_or_empty().alias("text"))
    words = own.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).filter(F.char_length("run") >= least_length)
    words = words.select(with_slips(F.col("run"), F.col("doc_id")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _cut(word: Column, low: Column, high: Column) -> Column:
    """The word without the code points from ``low`` up to ``high``."""
    return F.concat(F.substring(word, F.lit(1), low), F.substring(word, high + 1, F.char_length(word)))


def _halved(entries: DataFrame) -> DataFrame:
    """Entries with either half of their hole filled. ``longer`` words have a hole one wider at its end."""
    mid = F.call_function("div", F.col("low") + F.col("high"), F.lit(2)).cast("int")
    holes = F.array(F.struct(mid.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), mid.alias("high")))
    out = entries.select("word", "longer", "length", F.explode(holes).alias("_h")).select("word", "longer", "length", "_h.*")
    return out.withColumn("rest", _cut(F.col("word"), F.col("low"), F.col("high") + F.col("longer").cast("int")))


def _keyed(words: DataFrame) -> DataFrame:
    """Every word's keys: as an indexed word, which also probes words as long, and as one longer than indexed ones."""
    roles = F.array(F.lit(False), F.lit(True))
    out = words.select("word", F.explode(roles).alias("longer"))
    length = F.char_length("word") - F.col("longer").cast("int")
    return _halved(out.select("word", "longer", length.alias("length"), F.lit(0).alias("low"), length.alias("high")))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: all pairs of different words (column ``word``, distinct) that one inserted, deleted or replaced code point
    turns into each other, both ways round.

    Entries are written once a level; a key's words are joined with each other only where few meet, else its hole is
    halved, until it is one code point wide. So a frequent beginning or ending costs some more keys, not pairs.
    """
    entries, pairs = _keyed(words.select("word").distinct()), None
    while True:
        entries = scratch.keep(entries, "spelling-keys")
        sizes = entries.groupBy(*_KEY).agg(F.count_if(~F.col("longer")).alias("indexed"), F.count(F.lit(1)).alias("probes"))
        sizes = sizes.filter("indexed > 0 and probes > 1").withColumn("split", (F.col("probes") > _MEETING) & (F.col("high") - F.col("low") > 1))
        sizes = scratch.keep(sizes, "spelling-sizes")
        met = sizes.filter("not split").select(*_KEY)
        few = entries.join(met, list(_KEY))
        indexed = few.filter("not longer").select(*_KEY, F.col("word").alias("a"))
        probes = few.select(*_KEY, F.col("word").alias("b"), "longer")
        found = indexed.join(probes, list(_KEY)).filter("longer or a < b").filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")
        found = scratch.keep(found, "spelling-pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
        hot = sizes.filter("split").select(*_KEY)
        if hot.isEmpty():
            break
        entries = _halved(entries.join(hot, list(_KEY)).select("word", "longer", "length", "low", "high"))
    pairs = pairs.distinct()  # an edit among equal letters leaves both halves whole
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Each round doubles the steps; counts at least double along
    them, so that there are few rounds."""
    roots = scratch.keep(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        joined = scratch.keep(roots.join(up, "root", "left"), "spelling-roots")
        roots = joined.select("word", F.coalesce("_up", "root").alias("root"))
        if joined.filter("_up is not null").isEmpty():
            return roots


def variant_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root: the words of all texts and, of each one's near words, the commonest (ties:
    the smallest) if it occurs at least ``ratio`` times as often. ``root``: where forms lead in the end, or the word.

    Empty tables, and texts without letters, give no rows; very long texts and runs count whole.
    """
    scratch = Scratch()
    words = scratch.keep(word_counts(docs, least_length, least_count), "spelling-words")
    near = near_words(words, scratch)
    known = near.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").groupBy(F.col("a").alias("word"))
    best = known.agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("k"), "b")).alias("_b"))
    out = words.join(best, "word", "left")
    wanted = -F.col("_b.k") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wanted, F.col("_b.b")).alias("form"), F.when(wanted, -F.col("_b.k")).alias("form_n"))
    out = scratch.keep(out, "spelling-forms")
    roots = _roots(out.filter("form is not null"), scratch)
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
