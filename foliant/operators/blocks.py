"""Typed blocks of marked-up text."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import BLOCK_TYPES, ENTITIES

#: The elements that are blocks, what a text-only div must not hold, and an image by itself.
TEXT = r"p|h[1-6]|li|blockquote|pre|td"
OPEN, CLOSE = re.compile(rf"<({TEXT})(?=[\s>])", re.I), re.compile(rf"</({TEXT})>", re.I)
NESTED = re.compile(r"<(p|h[1-6]|li|blockquote|pre|div|table|ul|ol)\s*[^>]*>", re.I)
IMAGE = re.compile(r"<image[^>]*(?:xlink:)?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>", re.I)
IMG = re.compile(r"<img[^>]*src\s*=\s*[\"']([^\"']+)[\"'][^>]*/?\s*>", re.I)
#: How images name their files.
IMAGE_PATHS = [re.compile(r"<img[^>]*src\s*=\s*[\"']([^\"']+)[\"']"), re.compile(r"xlink:href\s*=\s*[\"']([^\"']+)[\"']"), re.compile(r"<image[^>]*href\s*=\s*[\"']([^\"']+)[\"']")]

NAME = re.compile(r"<[a-zA-Z0-9]+")

SCHEMA = "spine_item_id string, ordinal int, block_id string, type string, text string, html string, start int"


def plain(html: str) -> str:
    tags = html.rfind(">") + 1  # beyond it no tag ends
    text = re.sub(r"<[^>]+>", "", html[:tags]) + html[tags:]
    for entity, to in ENTITIES:
        text = text.replace(entity, to)
    return re.sub(r"\s+", " ", text).strip()


def block_key(item: str, text: str, ordinal: int) -> str:
    normal = re.sub(r"\s+", " ", text).strip().lower()
    return hashlib.sha256(f"{item}|{normal}|{ordinal}".encode()).hexdigest()[:12]


class Marks:
    """Where what a pattern finds stands in a text."""

    def __init__(self, pattern: str, text: str):
        self.at = [m.span() for m in re.finditer(pattern, text, re.I)]
        self.starts = [a for a, _ in self.at]

    def after(self, place: int) -> tuple[int, int] | None:
        """The first that begins at a place or behind it."""
        i = bisect_left(self.starts, place)
        return self.at[i] if i < len(self.at) else None


class Taken:
    """Places that blocks have: intervals that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)

    def has(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a


def _opened(html: str, pattern: re.Pattern) -> Iterator[tuple[re.Match, int]]:
    """Each beginning of a tag with the place of its end; after send(place) the scan goes on there, else behind the beginning. One pass, whatever is left open."""
    at = end = 0
    while m := pattern.search(html, at):
        if end < m.end():
            end = html.find(">", m.end())
            if end < 0:
                return
        at = (yield m, end) or m.start() + 1


def _each(tags: Iterator[tuple[re.Match, int]], take: Callable[[re.Match, int], int | None]) -> None:
    """take(beginning, end of tag) gives where the scan goes on, or None for behind the beginning."""
    place = None
    try:
        while True:
            m, end = tags.send(place)
            place = take(m, end)
    except StopIteration:
        return


def text_blocks(html: str) -> list[tuple[int, int, str, str]]:
    """(start, end, element, content): each element reaches to the first end tag of its name that leaves it a character; without one it is none."""
    ends: dict[str, list[int]] = {}
    for m in CLOSE.finditer(html):
        ends.setdefault(m[1].lower(), []).append(m.start())
    out = []

    def take(m: re.Match, end: int) -> int | None:
        name = m[1].lower()
        own = ends.get(name, [])
        i = bisect_left(own, end + 2)
        if i == len(own):
            return None
        out.append((m.start(), own[i] + len(name) + 3, name, html[end + 1 : own[i]]))
        return out[-1][1]

    _each(_opened(html, OPEN), take)
    return out


def inner_divs(html: str) -> list[tuple[int, int, str]]:
    """(start, end, content) of divs without a div in them."""
    begins, ends, out = Marks("<div", html), Marks("</div>", html), []

    def take(m: re.Match, end: int) -> int | None:
        close, inner = ends.after(end + 2), begins.after(end + 1)
        if not close or (inner and inner[0] < close[0]):
            return None
        out.append((m.start(), close[1], html[end + 1 : close[0]]))
        return close[1]

    _each(_opened(html, re.compile(r"<div(?=[\s>])", re.I)), take)
    return out


def image_spans(html: str) -> Iterator[list[tuple[int, int]]]:
    """Where images stand: divs that hold one alone, figures, drawings with an image in them, images; each kind in order."""
    alone = re.compile(r"\s*(?:(<img[^>]*>)\s*</div>|<svg[^>]*>)", re.I)
    drawn, svg, figures = Marks(r"</svg>\s*</div>", html), Marks("</svg>", html), Marks("</figure>", html)
    spans: list[tuple[int, int]] = []

    def of_div(m: re.Match, end: int) -> int | None:
        inside = alone.match(html, end + 1)
        close = (inside.span() if inside[1] else drawn.after(inside.end())) if inside else None
        if not close:
            return None
        spans.append((m.start(), close[1]))
        return close[1]

    def of_figure(m: re.Match, end: int) -> int | None:
        if close := figures.after(end + 1):
            spans.append((m.start(), close[1]))
        return close[1] if close else len(html)

    held: list[re.Match | None] = []

    def of_svg(m: re.Match, end: int) -> int | None:
        if not held or (held[0] and held[0].start() <= end):
            held[:] = [IMAGE.search(html, end + 1)]
        close = svg.after(held[0].end()) if held[0] else None
        if close:
            spans.append((m.start(), close[1]))
        return close[1] if close else len(html)

    sources = Marks("src", html)

    def of_img(m: re.Match, end: int) -> int | None:
        source = sources.after(m.end())
        found = IMG.match(html, m.start()) if source and source[0] < end else None
        if found:
            spans.append(found.span())
        return found.end() if found else None

    for pattern, take in ((r"<div", of_div), (r"<figure", of_figure), (r"<svg", of_svg), (r"<img", of_img)):
        spans.clear()
        _each(_opened(html, re.compile(pattern, re.I)), take)
        yield list(spans)


def find(html: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, text) of the blocks in order: text elements, then innermost text-only divs and images beside them."""
    found: list[tuple[int, int, str, str]] = []
    taken = Taken()
    for a, b, name, inside in text_blocks(html):
        if text := plain(inside):
            found.append((a, b, BLOCK_TYPES[name], text))
    divs = inner_divs(html)
    for a, b, *_ in found:
        taken.add(a, b)
    free = [(a, b, "paragraph", text) for a, b, inside in divs if not taken.has(a, b) and not NESTED.search(inside[: inside.rfind(">") + 1]) and (text := plain(inside))]
    for a, b, *_ in free:
        taken.add(a, b)
    found += free
    for spans in image_spans(html):
        for a, b in spans:
            if not taken.has(a, b):
                taken.add(a, b)
                path = next((x[1] for p in IMAGE_PATHS if (x := p.search(html[a:b]))), "image")
                found.append((a, b, "image", path))
    return sorted(found)


def annotate(html: str, item: str) -> str:
    """The markup with each block's id and spine item on its opening tag."""
    parts, at = [], 0
    for k, (a, _, _, text) in enumerate(find(html)):
        end = NAME.match(html, a).end()
        parts += [html[at:end], f' data-block-id="{block_key(item, text, k)}" data-spine-item-id="{item}"']
        at = end
    return "".join(parts) + html[at:]


def parse(sections: DataFrame) -> DataFrame:
    """Blocks of sections (spine_item_id, html), with their places; row-local, so nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, html in zip(frame["spine_item_id"], frame["html"], strict=True):
                rows += [(item, k, block_key(item, text, k), kind, text, html[a:b], a) for k, (a, b, kind, text) in enumerate(find(html or ""))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return sections.selectExpr("cast(spine_item_id as string) spine_item_id", "html").mapInPandas(run, SCHEMA)


def annotated(sections: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(html=[annotate(h or "", i) for i, h in zip(frame["spine_item_id"], frame["html"], strict=True)])

    return sections.selectExpr("cast(spine_item_id as string) spine_item_id", "html").mapInPandas(run, "spine_item_id string, html string")
