"""Quality rules by weak supervision (DataFrame functions only).

Rules on a text's own figures vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of
vote patterns estimates the share of good documents and two accuracies of each rule, how often its vote is right
on good documents and on bad ones, taking rules as independent given the quality; a document's posterior
probability of being good decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, named, text_or_empty

WINDOW = 8  # words of a repeated window
#: name: (ratio, good if at most or at least, bad if at least or at most). Fixed values of the rules.
_HIGH_IS_BAD = {"symbols": (0.05, 0.25), "repeats": (0.05, 0.2), "dup_lines": (0.1, 0.4), "capitals": (0.2, 0.5), "word_length": (7.5, 12.0)}
_HIGH_IS_GOOD = {"letters": (0.9, 0.83), "length": (50.0, 20.0)}
RULES = (*_HIGH_IS_BAD, *_HIGH_IS_GOOD)
ROUNDS = 25
#: Where expectation-maximisation begins: share of good documents, accuracy of a vote on good documents, accuracy on
#: bad ones (a rule knows one kind of fault, so it misses most others). These are means of Beta priors, too.
PRIOR, ON_GOOD, ON_BAD = 0.85, 0.98, 0.4
#: Weight of the Beta priors: this share of the documents, and 2 more, so that it is alike at every size.
WEIGHT = 0.01


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the array ``words``: words in 8-word windows that occur twice or more.

    Windows are compared by 64-bit hashes inside the row; only rows with a window that recurs sort theirs.
    """
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    seq = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_w", F.transform(seq, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
    df = df.withColumn("_any", F.size(F.array_distinct("_w")) < F.size("_w"))
    pairs = F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.col("_any"), pairs))

    def again(x: Column, k: Column) -> Column:
        beside = lambda j: F.coalesce(F.get("_s", j)["h"] == x["h"], F.lit(False))
        return beside(k - 1) | beside(k + 1)

    df = df.withColumn("_p", F.array_sort(F.transform(F.filter("_s", again), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_p", start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")))
    return df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_h", "_w", "_any", "_s", "_p")


def measured(docs: DataFrame) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_capitals
    (long). A null text has no words."""
    text = text_or_empty()
    df = docs.withColumn("_text", text).withColumn("words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("_joined", F.array_join("words", ""))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length("_joined").cast("long"),
        "n_symbols": F.regexp_count("_joined", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_letters": (F.length("_joined") - F.length(F.regexp_replace("_joined", r"\p{L}+", ""))).cast("long"),
        "n_capitals": F.regexp_count("_joined", F.lit(r"\p{Lu}")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    return _repeat_words(df).drop("_text", "_lines", "_joined", "words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> Column:
    """The rules' votes as an array of double, in the order of ``RULES``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratio = {"symbols": per("n_symbols", "n_words"), "repeats": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "capitals": per("n_capitals", "n_letters"), "word_length": per("word_chars", "n_words"), "letters": per("n_letters", "word_chars"), "length": F.col("n_words").cast("double")}
    out = []
    for name in RULES:
        x = ratio[name]
        if name in _HIGH_IS_BAD:
            good, bad = _HIGH_IS_BAD[name]
            out.append(F.when(x <= good, 1.0).when(x >= bad, -1.0).otherwise(0.0))
        else:
            good, bad = _HIGH_IS_GOOD[name]
            out.append(F.when(x >= good, 1.0).when(x <= bad, -1.0).otherwise(0.0))
    return F.array(*out)


def posterior(v: Column, on_good: Column, on_bad: Column, prior: Column) -> Column:
    """Probability of good given votes: log-odds add up over the rules that vote."""
    pro = F.zip_with(on_good, on_bad, lambda g, b: F.log(g / (1 - b)))
    con = F.zip_with(on_good, on_bad, lambda g, b: F.log((1 - g) / b))
    odds = F.transform(F.arrays_zip(v.alias("v"), pro.alias("pro"), con.alias("con")), lambda x: F.when(x["v"] > 0, x["pro"]).when(x["v"] < 0, x["con"]).otherwise(0.0))
    return 1 / (1 + F.exp(-(F.log(prior / (1 - prior)) + _sum(odds, lambda x: x))))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))


def estimated(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row (prior, on_good, on_bad) by expectation-maximisation over patterns (v: votes, n: documents).

    There are at most 3 ** rules patterns, whatever the input, so they fit one row; the rounds are one
    expression over it. Without documents the start values come back. Estimates are means under Beta priors: each
    counts ``WEIGHT`` of the documents, and 2, more votes that are as accurate as at the start, so none reaches 0 or 1,
    and a rule that never votes on one kind of document stays near where it began.
    """
    rules = range(len(RULES))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct(F.col("v").alias("v"), F.col("n").cast("double").alias("n")))).alias("all"))
    many = lambda x: F.array(*[F.lit(x)] * len(RULES))
    start = F.struct(F.lit(PRIOR).alias("prior"), many(ON_GOOD).alias("on_good"), many(ON_BAD).alias("on_bad"))

    def maximised(t: Column) -> Column:
        """New parameters from patterns with their posterior p."""

        more = 2 + WEIGHT * _sum(t, lambda x: x["n"])

        def mean(right: Column, voted: Column, start: float) -> Column:
            return (right + more * start) / (voted + more)

        def on_good(j: int) -> Column:
            vote = lambda x: F.get(x["v"], F.lit(j))
            right = _sum(t, lambda x: F.when(vote(x) > 0, x["n"] * x["p"]).otherwise(0.0))
            voted = _sum(t, lambda x: F.when(vote(x) != 0, x["n"] * x["p"]).otherwise(0.0))
            return mean(right, voted, ON_GOOD)

        def on_bad(j: int) -> Column:
            vote = lambda x: F.get(x["v"], F.lit(j))
            right = _sum(t, lambda x: F.when(vote(x) < 0, x["n"] * (1 - x["p"])).otherwise(0.0))
            voted = _sum(t, lambda x: F.when(vote(x) != 0, x["n"] * (1 - x["p"])).otherwise(0.0))
            return mean(right, voted, ON_BAD)

        share = mean(_sum(t, lambda x: x["n"] * x["p"]), _sum(t, lambda x: x["n"]), PRIOR)
        return F.struct(share.alias("prior"), F.array(*map(on_good, rules)).alias("on_good"), F.array(*map(on_bad, rules)).alias("on_bad"))

    def round_(s: Column, _: Column) -> Column:
        scored = F.transform("all", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(x["v"], s["on_good"], s["on_bad"], s["prior"]).alias("p")))
        return F.get(F.transform(F.array(scored), maximised), F.lit(0))  # computes ``scored`` once

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, round_).alias("p")).select("p.*")


def _scored(docs: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """The columns as _c_0, _c_1, ..., which no figure can replace, the figures, p_good and kept.

    Columns and figures are written once; estimating and judging read them. (Filters on figures that are not
    written would be pushed below the projections that compute them, and compute them again in each use.)
    """
    df = measured(docs.select(*[named(c).alias(f"_c_{i}") for i, c in enumerate(columns)], F.col("text").cast("string").alias("text"))).drop("text")
    df = materialise(df.withColumn("base_failed", base_failed()).withColumn("votes", votes()), "quality")
    patterns = df.filter("not base_failed").groupBy(F.col("votes").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    fitted = F.broadcast(estimated(patterns))  # one row
    df = df.crossJoin(fitted).withColumn("p_good", posterior(F.col("votes"), F.col("on_good"), F.col("on_bad"), F.col("prior")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judged(docs: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """``columns`` of each row with its figures, base_failed, votes, p_good and kept.

    Documents that fail the base rules are not kept and take no part in estimating accuracies. Null, empty and
    blank texts fail. Rows that repeat count each; an empty table gives no rows; other columns are left out.
    """
    own = [F.col(f"_c_{i}").alias(c) for i, c in enumerate(columns)]
    return _scored(docs, columns, threshold).select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "votes", "p_good", "kept")


def kept_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns, whatever their names. Null, empty and blank texts go;
    rows that repeat stay or go each; whole texts count, however long; an empty table stays empty."""
    own = [F.col(f"_c_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _scored(docs, docs.columns, threshold).filter("kept").select(*own)
