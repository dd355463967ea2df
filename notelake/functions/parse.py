"""Parsing of markdown notes: frontmatter, headings, links, tags, titles and dates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import stripped

try:
    import yaml
except ImportError:  # without it every frontmatter is taken as invalid
    yaml = None

#: The patterns of the note format. ``(?d)`` makes only line feeds end lines.
FENCE = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
HEADING = r"(?mdU)^(#{1,6})\s+(.+?)(?:\s+#+)?\s*$"
WIKILINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"
INLINE_TAG = r"(?U)(?<!\S)#([A-Za-z][A-Za-z0-9_/-]*)"

FRONTMATTER = T.StructType()
for _name, _type in (("fields", T.MapType(T.StringType(), T.StringType())), ("title", T.StringType()), ("created", T.StringType()), ("date", T.StringType()), ("tags", T.ArrayType(T.StringType())), ("broken", T.BooleanType())):
    FRONTMATTER.add(_name, _type)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def has_frontmatter(raw: Column) -> Column:
    return raw.rlike(FENCE)


def frontmatter_text(raw: Column) -> Column:
    """The YAML between the fences; null without a fence."""
    return F.when(has_frontmatter(raw), F.regexp_extract(raw, FENCE, 1))


def body(raw: Column) -> Column:
    """The note without its frontmatter, whether or not that is valid."""
    return F.regexp_replace(raw, FENCE, "")


def _plain(value: object) -> str | None:
    import datetime

    if value is None:
        return None
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def _fields(text: str | None) -> dict:
    if text is None or yaml is None:
        return {}
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


@F.pandas_udf(FRONTMATTER)
def frontmatter(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Fields of frontmatter texts: all as strings, and title, created, date and tags typed; falsy ones are null.

    Invalid YAML and YAML that is no mapping have no fields. ``broken``: tags are neither text nor a list, for
    which scanning skips the note.
    """
    for s in texts:
        rows = []
        for text in s:
            data = _fields(text)
            tags = data.get("tags") or []
            tags = [tags] if isinstance(tags, str) else tags
            broken = not isinstance(tags, (list, tuple, dict, set))
            rows.append({
                "fields": {str(k): _plain(v) for k, v in data.items()},
                "title": str(data["title"]) if data.get("title") else None,
                "created": _plain(data.get("created") or None),
                "date": _plain(data.get("date") or None),
                "tags": [] if broken else [str(t) for t in tags],
                "broken": broken,
            })
        yield pd.DataFrame(rows, columns=["fields", "title", "created", "date", "tags", "broken"])


frontmatter = frontmatter.asNondeterministic()  # else a filter on its result moves below it and runs it twice


def headings(text: Column) -> Column:
    """Array of (level, text) of ATX headings in order; code fences don't matter."""
    both = F.arrays_zip(_found(text, HEADING, 1).alias("marks"), _found(text, HEADING, 2).alias("text"))
    return F.transform(both, lambda h: F.struct(F.length(h["marks"]).alias("level"), stripped(h["text"]).alias("text")))


def wikilinks(text: Column) -> Column:
    """Link targets in order, repeats kept."""
    return F.transform(_found(text, WIKILINK, 1), stripped)


def tags(frontmatter_tags: Column, text: Column) -> Column:
    """Tags of the frontmatter, then inline ones, lower-cased, each once."""
    own = F.transform(F.coalesce(frontmatter_tags, F.array().cast("array<string>")), lambda t: F.regexp_replace(stripped(F.lower(t)), "^#+", ""))
    inline = F.transform(_found(text, INLINE_TAG, 1), F.lower)
    return F.array_distinct(F.concat(F.filter(own, lambda t: t != ""), inline))


def title(fm_title: Column, heads: Column, stem: Column) -> Column:
    """The frontmatter's title, else the first heading of level 1, else the file's stem."""
    first = F.get(F.filter(heads, lambda h: h["level"] == 1), F.lit(0))["text"]
    return F.coalesce(F.when(fm_title != "", stripped(fm_title)), first, stem)


def stem(path: Column) -> Column:
    """The last part of a path without its extension; a leading dot is no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def parsed_datetime(value: Column) -> Column:
    """UTC timestamp of the three accepted forms, and of what YAML made of dates; null for others."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
    plain = [F.try_to_timestamp(value, F.lit(f)) for f in forms]
    zoned = F.when(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?[+-]\d\d:\d\d$"), F.try_to_timestamp(value))
    return F.coalesce(*plain, zoned)
