"""Structured replies of a language model: lines, the section each stands in, and what the sections hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section heads.
SUMMARY_HEADS = {"SUMMARY:": "summary", "KEY_POINTS:": "points", "KEY POINTS:": "points", "CHARACTERS:": "characters"}
SYNOPSIS_HEADS = {"SYNOPSIS:": "summary", "CHARACTERS:": "characters", "THEMES:": "themes"}


def _sections(reply: Column, heads: dict[str, str]) -> Column:
    """array<struct<section, head, line>>: each trimmed line with the section it stands in; a head's own line has the rest of it."""
    trimmed = F.transform(F.split(reply, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))

    def step(acc: Column, line: Column) -> Column:
        name, rest = F.lit(None).cast("string"), line
        for head, section in reversed(heads.items()):
            hit = F.startswith(F.upper(line), F.lit(head))
            name = F.when(hit, section).otherwise(name)
            rest = F.when(hit, F.regexp_replace(F.substring(line, len(head) + 1, 1_000_000), r"^[ \t]+|[ \t]+$", "")).otherwise(rest)
        section = F.coalesce(name, acc["section"])
        return F.struct(section.alias("section"), F.concat(acc["out"], F.array(F.struct(section.alias("section"), name.isNotNull().alias("head"), rest.alias("line")))).alias("out"))

    zero = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<section:string,head:boolean,line:string>>").alias("out"))
    return F.aggregate(trimmed, zero, step, lambda a: a["out"])


def _text(lines: Column, section: str) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: (x["section"] == section) & (x["line"] != "")), lambda x: x["line"]), " ")


def _bullets(lines: Column, section: str) -> Column:
    own = F.filter(lines, lambda x: (x["section"] == section) & ~x["head"] & x["line"].startswith("-"))
    return F.filter(F.transform(own, lambda x: F.regexp_replace(F.substring(x["line"], 2, 1_000_000), r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")


def parse_summary(replies: DataFrame) -> DataFrame:
    """summary, key_points and characters of replies (id, reply); without a summary section the whole reply."""
    cut = replies.select("id", "reply", _sections(F.col("reply"), SUMMARY_HEADS).alias("lines"))
    text = _text(F.col("lines"), "summary")
    heads = F.filter("lines", lambda x: (x["section"] == "characters") & x["head"] & (x["line"] != ""))
    people = F.filter(F.transform(F.split(F.coalesce(F.get(F.reverse(heads), F.lit(0))["line"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return cut.select("id", F.when(text == "", F.col("reply")).otherwise(text).alias("summary"), _bullets(F.col("lines"), "points").alias("key_points"), people.alias("characters"))


def parse_synopsis(replies: DataFrame) -> DataFrame:
    """synopsis, characters (name, description) and themes of replies (id, reply)."""
    cut = replies.select("id", "reply", _sections(F.col("reply"), SYNOPSIS_HEADS).alias("lines"))
    text = _text(F.col("lines"), "summary")
    pairs = F.transform(F.filter(_bullets(F.col("lines"), "characters"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("description")))
    return cut.select("id", F.when(text == "", F.col("reply")).otherwise(text).alias("synopsis"), F.filter(pairs, lambda p: (p["name"] != "") & (p["description"] != "")).alias("characters"), _bullets(F.col("lines"), "themes").alias("themes"))
