"""Rewriting of section markup, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that have no end tag.
VOID = ["area", "base", "br", "col", "command", "embed", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr"]
SCHEME = "epub"

#: Patterns of a body, an empty element and an image.
_BODY = r"(?is)<body[^>]*>(.*?)</body>"
_EMPTY = r"(?s)^<([a-zA-Z][a-zA-Z0-9]*)\b([^>]*?)\s*/>(.*)$"
_IMAGE = r"""(?is)^<img([^>]*)src\s*=\s*["']([^"']+)["']([^>]*)>(.*)$"""


def body(html: Column) -> Column:
    """What the first body element holds; the whole markup if there is none. Null stays null."""
    return F.when(F.regexp_like(html, F.lit(_BODY)), F.regexp_extract(html, _BODY, 1)).otherwise(html)


def close_empty(html: Column) -> Column:
    """`<i/>` becomes `<i></i>`, with the name in lower case, but for elements that have no end tag."""

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, _EMPTY, 1))
        made = F.concat(F.lit("<"), name, F.regexp_extract(part, _EMPTY, 2), F.lit("></"), name, F.lit(">"), F.regexp_extract(part, _EMPTY, 3))
        return F.when((name != "") & ~name.isin(VOID), made).otherwise(part)

    return F.array_join(F.transform(F.split(html, "(?=<)"), one), "")


def resolve(base: Column, path: Column) -> Column:
    """A path relative to the folder `base`; only one that begins with `../` has its dots worked out."""
    steps = F.filter(F.split(base, "/"), lambda x: x != "")
    up = F.aggregate(
        F.split(path, "/"),
        steps,
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when((x == ".") | (x == ""), a).otherwise(F.concat(a, F.array(x))),
    )
    return F.when(F.startswith(path, F.lit("../")), F.array_join(up, "/")).when(base == "", path).otherwise(F.concat_ws("/", base, path))


def image_links(html: Column, base: Column, images: Column, scheme: str = SCHEME) -> Column:
    """Sources of images that the array `images` of paths has, by path or by file name, become `scheme`://image/path."""
    names = F.transform(images, lambda p: F.substring_index(p, "/", -1))

    def one(part: Column) -> Column:
        at = lambda i: F.regexp_extract(part, _IMAGE, i)
        path = resolve(base, at(2))
        known = (at(2) != "") & (F.array_contains(images, path) | F.array_contains(names, F.substring_index(path, "/", -1)))
        return F.when(known, F.concat(F.lit("<img"), at(1), F.lit(f'src="{scheme}://image/'), path, F.lit('"'), at(3), F.lit(">"), at(4))).otherwise(part)

    return F.array_join(F.transform(F.split(html, "(?i)(?=<img)"), one), "")
