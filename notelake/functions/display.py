"""What a reader of results sees: highlights, previews, badges, facets, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SLOW_REQUEST_MS, SearchFilter
from .text import right_stripped

#: Least scores of the badges.
BADGES = ((0.8, "excellent"), (0.6, "good"), (0.4, "fair"))
#: Statuses of services, best first.
STATUSES = ("ok", "degraded", "unavailable")


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlighted(text: Column, query: Column) -> Column:
    """HTML-escaped text with the query's words of two characters or more marked, in any case."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: F.length(w) > 1)
    quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(quoted, "|"), F.lit(")"))
    return F.when(F.size(words) == 0, escaped_html(text)).otherwise(F.regexp_replace(escaped_html(text), pattern, F.lit("<mark>$1</mark>")))


def preview(text: Column, n: int = 320) -> Column:
    return F.when(F.length(text) > n, F.concat(right_stripped(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def badge(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BADGES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def tag_facet(results: DataFrame) -> DataFrame:
    """Distinct tags of results, in order."""
    return results.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def active_filters(f: SearchFilter, default_mode: bool = True) -> int:
    """How many filters are set."""
    return len(f.tags) + sum(map(bool, (f.note_id, f.note_path, f.note_title))) + (not default_mode)


def slow_request(ms: Column, limit: float = SLOW_REQUEST_MS) -> Column:
    return ms > limit


def rolled_up(statuses: DataFrame, group: str, column: str = "status") -> DataFrame:
    """The worst status of each group."""
    names = F.array(*map(F.lit, STATUSES))
    worst = F.max(F.array_position(names, F.col(column)))
    return statuses.groupBy(group).agg(worst.alias("_w")).select(group, F.element_at(names, F.col("_w").cast("int")).alias("status"))


def milliseconds(nanoseconds: Column) -> Column:
    return F.round(nanoseconds / 1e6, 2)


def debounced(keys: DataFrame, session: str, ms: str, text: str, wait: int = 350, least: int = 2) -> DataFrame:
    """Inputs that a search follows: no later one within ``wait`` ms, and ``least`` characters or more."""
    return search_actions(keys, session, ms, text, None, wait, least).filter("action = 'search'").drop("action")


def search_actions(keys: DataFrame, session: str, ms: str, text: str, filters: str | None = None, wait: int = 350, least: int = 2) -> DataFrame:
    """Adds ``action``, what follows an input: ``clear`` at once for a blank one, ``search`` once no other input has come
    for ``wait`` ms, or at once where the column ``filters`` is another than before; null for inputs that are too short
    or overtaken."""
    order = W.partitionBy(session).orderBy(ms)
    gap = F.lead(ms).over(order) - F.col(ms)
    long = F.length(F.trim(text)) >= least
    moved = F.lit(False) if filters is None else F.coalesce(~F.col(filters).eqNullSafe(F.lag(filters).over(order)) & (F.row_number().over(order) > 1), F.lit(False))
    action = F.when(F.trim(text) == "", "clear").when(long & (moved | gap.isNull() | (gap >= wait)), "search")
    return keys.withColumn("action", action)
