r"""Chat formatting of typed content parts (DataFrame functions only).

A turn is written ``<s>[INST]role\ntext[/INST]</s>``, an assistant's ``<s>role\ntext</s>``. Inside roles and texts
a backslash is doubled and one is put after the first character of anything that reads like a control string or
placeholder, so neither can occur there; taking a backslash away from before each character restores the text.
Parts other than text become ``<image>``, ``<audio>`` or ``<document>``, and what they stand for is recorded apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The control strings of the template, and the placeholders of parts.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
PLACEHOLDERS = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
_CONTROL = r"([<\[])(/?s>|/?INST\]|image>|audio>|document>)"
#: Tokens of a placeholder per unit of its part (an image tile, a second of sound, a page).
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,uri:string,units:double>"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, "$1\\\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """Content of one text part; null is empty."""
    one = F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("units"))
    return F.array(one)


def _content(parts: Column) -> Column:
    """What parts read as, in order: placeholders, and between them the texts that follow one another, joined and then
    escaped, so that no control string arises where two meet. Parts of unknown type read as their text."""
    mark = lambda p: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv]), p["type"]), F.lit(""))

    def visit(s: Column, p: Column) -> Column:
        media = F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False))
        done = F.when(media, F.concat(s["done"], escaped(s["text"]), mark(p))).otherwise(s["done"])
        text = F.when(media, F.lit("")).otherwise(F.concat(s["text"], F.coalesce(p["text"], F.lit(""))))
        return F.struct(done.alias("done"), text.alias("text"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))
    return F.aggregate(parts, start, visit, lambda s: F.concat(s["done"], escaped(s["text"])))


def _attachments(parts: Column) -> Column:
    """(type, uri, tokens) of the parts that are not text, in order."""

    def one(p: Column) -> Column:
        per = F.lit(0)
        for kind, n in UNIT_TOKENS.items():
            per = F.when(p["type"] == kind, F.lit(n)).otherwise(per)
        units = F.ceil(F.greatest(F.coalesce(p["units"], F.lit(1.0)), F.lit(1.0)))
        return F.struct(p["type"].alias("type"), p["uri"].alias("uri"), (units * per).cast("long").alias("tokens"))

    return F.transform(F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDERS)), one)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation from turns (conv_id, turn, role, parts: array of ``PART``):

    conv_id, formatted, loss_spans (array of start and length in code points of ``formatted``, the assistant's
    contents), attachments (array of turn, type, uri, tokens), media_tokens.

    Turns are ordered by turn, null first, ties by role and content. Null roles, parts and texts are empty; a
    null conv_id is a conversation; no turns give no rows; other columns are ignored. A conversation becomes one
    string, so it meets in one task, as its result does.
    """
    content = _content(F.coalesce("parts", F.array().cast(f"array<{PART}>")))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), content.alias("content"), _attachments(F.coalesce("parts", F.array().cast(f"array<{PART}>"))).alias("media"))
    # A line feed inside a role is escaped too, as the first one outside ends it.
    name = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    learnt = F.col("role") == "assistant"
    t = t.withColumn("head", F.concat(F.when(learnt, F.lit(OPEN)).otherwise(F.lit(OPEN + ASK)), name, F.lit("\n")))
    t = t.withColumn("tail", F.when(learnt, F.lit(CLOSE)).otherwise(F.lit(ASKED + CLOSE)))
    size = F.length("head") + F.length("content") + F.length("tail")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("i", F.row_number().over(order)).withColumn("start", before + F.length("head"))
    span = F.when(learnt, F.struct(F.col("start"), F.length("content").cast("long").alias("length")))
    one = F.struct("i", F.concat("head", "content", "tail").alias("text"), span.alias("span"), F.transform("media", lambda m: F.struct(F.col("turn"), m["type"].alias("type"), m["uri"].alias("uri"), m["tokens"].alias("tokens"))).alias("media"))
    t = t.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    t = t.select("conv_id", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("formatted"), F.array_compact(F.transform("all", lambda x: x["span"])).alias("loss_spans"), F.flatten(F.transform("all", lambda x: x["media"])).alias("attachments"))
    return t.withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, m: s + m["tokens"]))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Reads ``formatted`` back: conv_id, turns (array of role and text, placeholders as they stand), loss_text
    (all text under the loss spans, unescaped), media_tokens."""
    # Neither CLOSE nor a line feed that ends a role can occur unescaped elsewhere.
    parts = F.filter(F.split("formatted", "(?<=</s>)"), lambda x: x != "")
    pattern = r"(?s)^<s>(?:\[INST\])?((?:[^\\\n]|\\.)*+)\n(.*?)(?:\[/INST\])?</s>$"
    turns = F.transform(parts, lambda x: F.struct(unescaped(F.regexp_extract(x, pattern, 1)).alias("role"), unescaped(F.regexp_extract(x, pattern, 2)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), "media_tokens")
