"""Canonical fragment identifiers of positions in a book."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _step(text: Column) -> Column:
    """The number that text begins with, null for none or beyond int range."""
    return F.regexp_extract(text, r"^(\d{1,9})(?!\d)", 1).try_cast("int")


def _even(step: Column) -> Column:
    return (step > 0) & (step % 2 == 0)


def _spine(content: Column, ok: Column) -> Column:
    step = _step(F.substring(content, 4, 1_000_000))
    good = ok & content.startswith("/6/") & F.coalesce(_even(step), F.lit(False))
    idref = F.nullif(F.regexp_extract(content, r"^/6/\d+\[([^\]]*)\]", 1), F.lit(""))
    return F.struct(good.alias("ok"), (F.floor(step / 2) - 1).cast("int").alias("spine_index"), idref.alias("idref"))


def parse_base(cfi: Column) -> Column:
    """struct<spine_index, idref> of epubcfi(/6/N[id]!...), null if malformed; what follows the last bracket is let through."""
    content = F.regexp_extract(cfi, r"(?s)^epubcfi\((.*)\)", 1)
    s = _spine(content, cfi.startswith("epubcfi(") & cfi.contains(")"))
    return F.when(s["ok"], F.struct(s["spine_index"].alias("spine_index"), s["idref"].alias("idref")))


def parse_full(cfi: Column) -> Column:
    """struct<spine_index, idref, dom_path, char_offset>; odd steps of the path are dropped; null if malformed."""
    content = F.regexp_extract(cfi, r"(?s)^epubcfi\((.*)\)$", 1)
    parts = F.split(content, "!")
    s = _spine(parts[0], cfi.startswith("epubcfi(") & cfi.endswith(")"))
    path = F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ":")
    steps = F.transform(F.split(path[0], "/"), _step)
    dom = F.transform(F.filter(steps, lambda n: F.coalesce(_even(n), F.lit(False))), lambda n: (F.floor(n / 2) - 1).cast("int"))
    offset = F.get(path, F.lit(1)).try_cast("int")
    return F.when(s["ok"], F.struct(s["spine_index"].alias("spine_index"), s["idref"].alias("idref"), dom.alias("dom_path"), offset.alias("char_offset")))


def _head(spine_index: Column, idref: Column) -> Column:
    return F.concat(F.lit("epubcfi(/6/"), ((spine_index + 1) * 2).cast("string"), F.coalesce(F.concat(F.lit("["), idref, F.lit("]")), F.lit("")), F.lit("!"))


def generate_base(spine_index: Column, idref: Column) -> Column:
    return F.concat(_head(spine_index, idref), F.lit(")"))


def generate_full(spine_index: Column, idref: Column, dom_path: Column, char_offset: Column) -> Column:
    steps = F.array_join(F.transform(dom_path, lambda i: F.concat(F.lit("/"), ((i + 1) * 2).cast("string"))), "")
    return F.concat(_head(spine_index, idref), F.coalesce(steps, F.lit("")), F.coalesce(F.concat(F.lit(":"), char_offset.cast("string")), F.lit("")), F.lit(")"))
