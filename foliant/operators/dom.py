"""Positions in the element tree of marked-up text: text nodes to fragment identifiers and back.

A position is the path of a block, each step the place among its parent's elements, and an offset in that block's text, in UTF-16 units. The tree is that of the body, by HTML's rules for
void elements, raw text, character references and end tags left out; rows of tables get the body that they lack. Misnested formatting is not rearranged, and depth has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Elements that positions are counted from.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote div section article figure figcaption pre tr td th".split())
#: Fixed values of HTML: elements without content, with unmarked content, those that end a paragraph, and those that stand outside the body.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
FRAME = frozenset(("html", "head", "body"))
#: What a begin tag ends, and what it can't end beyond.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPE = ("button", "caption", "table", "td", "th", "object", "template", "marquee")
SECTIONS = ("tbody", "thead", "tfoot", "caption", "colgroup")
ROWS = ("tr", "td", "th", *SECTIONS)
ENDS = {"li": (("li",), ("ul", "ol", *SCOPE)), "dt": (("dt", "dd"), ("dl", *SCOPE)), "dd": (("dt", "dd"), ("dl", *SCOPE)), "option": (("option",), ("select", "datalist")), "tr": (("tr", "caption", "colgroup"), ("table",))}
ENDS |= {x: (("td", "th"), ("table", "tr")) for x in ("td", "th")} | {x: (SECTIONS, ("table",)) for x in SECTIONS}
#: An element that must stand in others, and the one that is put between.
PARENTS = {"tr": [(("table",), "tbody")]} | {x: [(("table",), "tbody"), (("tbody", "thead", "tfoot"), "tr")] for x in ("td", "th")}

#: Where a tag begins; its end or a value in it, whose quote is the group; a value without quotes.
MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
SIGN, VALUE = re.compile(r"""=\s*(["']?)|>"""), re.compile(r"[^\s>]*")
SCHEMA = "kind string, number int, element string, path array<int>, start int, end int, base int"
#: Steps of paths that a batch holds.
BATCH = 200_000


def units(text: str) -> int:
    """The length of a text in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def behind(html: str, mark: str, at: int) -> int:
    """Behind the next mark from a place on; -1 for none."""
    found = html.find(mark, at)
    return found + len(mark) if found >= 0 else -1


def tag_end(html: str, at: int) -> int:
    """Behind the tag whose name ends at a place; -1 without an end, as where a quoted value is left open."""
    while sign := SIGN.search(html, at):
        if sign[0] == ">":
            return sign.end()
        at = sign.end()
        if sign[1]:
            at = behind(html, sign[1], at)
            if at < 0:
                return -1
        else:
            at = VALUE.match(html, at).end()
    return -1


class Tree:
    """Elements (name, parent, place among its elements, start and end of its text) and text nodes (element, start, end), in document order; element 0 is the body."""

    def __init__(self, html: str):
        self.reset()
        self.read(html.replace("\r\n", "\n").replace("\r", "\n"))
        self.close(0)
        self.ends[0] = self.length

    def reset(self) -> None:
        self.names, self.parents, self.places, self.children, self.starts, self.ends, self.blocks = ["body"], [-1], [0], [0], [0], [0], [-1]
        self.texts: list[list[int]] = []
        self.length, self.last = 0, -1
        self.stack, self.open = [0], {"body": [0]}

    def push(self, name: str, empty: bool = False) -> None:
        parent, number = self.stack[-1], len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        self.places.append(self.children[parent])
        self.children[parent] += 1
        self.children.append(0)
        self.starts.append(self.length)
        self.ends.append(self.length)
        self.blocks.append(number if name in BLOCKS else self.blocks[parent])
        self.last = -1
        if not empty:
            self.open.setdefault(name, []).append(len(self.stack))
            self.stack.append(number)

    def close(self, depth: int) -> None:
        """End the elements at a depth and below it."""
        while len(self.stack) > max(depth, 1):
            number = self.stack.pop()
            self.ends[number] = self.length
            self.open[self.names[number]].pop()
            self.last = -1

    def top(self, names: tuple[str, ...]) -> int:
        """The depth of the innermost open element of some names; 0 for none."""
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=0)

    def text(self, text: str) -> None:
        if text:
            if self.last < 0:
                self.last = len(self.texts)
                self.texts.append([self.stack[-1], self.length, self.length])
            self.length += units(text)
            self.texts[self.last][2] = self.length

    def begin(self, name: str, closed: bool) -> None:
        if name in ENDS_P and (depth := self.top(("p",))) > self.top(SCOPE):
            self.close(depth)
        if name in HEADINGS and self.names[self.stack[-1]] in HEADINGS:
            self.close(len(self.stack) - 1)
        ended, kept = ENDS.get(name, ((), ()))
        if (depth := self.top(ended)) > self.top(kept):
            self.close(depth)
        for around, between in PARENTS.get(name, ()):
            if self.names[self.stack[-1]] in around:
                self.push(between)
        self.push(name, name in VOID or (closed and bool(self.top(("svg", "math")) or name in ("svg", "math"))))

    def end(self, name: str) -> None:
        if name == "br" or (name == "p" and self.top(("p",)) <= self.top(SCOPE)):
            self.begin(name, False)
            if name == "p":
                self.close(len(self.stack) - 1)
        else:
            kept = () if name == "table" else ("table",) if name in ROWS else ("table", "td", "th", "caption")
            if (depth := self.top((name,))) > self.top(kept):
                self.close(depth)

    def read(self, html: str) -> None:
        at, seen = 0, False
        while mark := MARK.search(html, at):
            self.text(unescape(html[at : mark.start()]))
            name = (mark[2] or "").lower()
            if mark[3]:
                self.last = -1
                at = behind(html, "-->", mark.start() + 2)
            elif not name:
                self.last = -1
                at = behind(html, ">", mark.start())
            else:
                at = tag_end(html, mark.end())
            if at < 0:  # nothing ends it
                return
            if name == "body" and not mark[1] and not seen:
                seen = True
                self.reset()
            elif name in FRAME or not name:
                continue
            elif mark[1]:
                self.end(name)
            else:
                self.begin(name, html[at - 2] == "/")
                if name in RAW:
                    close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                    inside = html[at : close.start() if close else len(html)]
                    self.text(unescape(inside) if name in ("textarea", "title") else inside)
                    self.close(len(self.stack) - 1)
                    at = tag_end(html, close.end()) if close else -1
                    if at < 0:
                        return
                elif name == "pre" and html[at : at + 1] == "\n":
                    at += 1
        self.text(unescape(html[at:]))

    def path(self, number: int) -> list[int]:
        out = []
        while number > 0:
            out.append(self.places[number])
            number = self.parents[number]
        return out[::-1]

    def rows(self) -> Iterator[tuple[str, int, str, list[int], int, int, int]]:
        """Elements with their paths, then text nodes with the path of the block around them, or of their parent without one, and where its text begins."""
        for i, name in enumerate(self.names):
            yield "element", i, name, self.path(i), self.starts[i], self.ends[i], self.starts[i]
        for k, (parent, start, end) in enumerate(self.texts):
            block = self.blocks[parent] if self.blocks[parent] > 0 else parent
            yield "text", k, self.names[block], self.path(block), start, end, self.starts[block]


def parse(sections: DataFrame) -> DataFrame:
    """The trees of sections (id, html), a row an element and a row a text node: kind, number in document order, element, path, start and end in the body's text, base.

    For a text node, element and path are those of the block that its positions count from, and base is where that block's text begins. A null html has no rows. Row-local: nothing is shuffled.
    """
    kind = sections.schema["id"].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("id").type, pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()]
            made = lambda held, kinds=kinds: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
            # one page at a time is a text in Python
            for key, html in zip(batch["id"], batch["html"], strict=True):
                key = key.as_py()
                for row in Tree(html.as_py()).rows():
                    held.append((key, *row))
                    size += 1 + len(row[3])
                    if size > BATCH:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    return sections.select("id", "html").where("html is not null").mapInArrow(run, f"id {kind}, {SCHEMA}")


def positions(tree: DataFrame, unit: str = "last") -> DataFrame:
    """(id, node, element, dom_path, char_offset, node_offset) of a place in each text node: behind its `last` character, in its `middle`, or at its `first`.

    At a node's start the offset is also that of the end of the node before, so resolve gives that one, where it is in the same block.
    """
    length = F.col("end") - F.col("start")
    place = {"last": length, "middle": F.ceil(length / 2).cast("int"), "first": F.lit(0)}[unit]
    texts = tree.where("kind = 'text'").withColumn("node_offset", place)
    return texts.select("id", F.col("number").alias("node"), "element", F.col("path").alias("dom_path"), (F.col("start") - F.col("base") + F.col("node_offset")).alias("char_offset"), "node_offset")


def resolve(tree: DataFrame, points: DataFrame) -> DataFrame:
    """points (id, dom_path, char_offset, ...) with found, whether the path leads to an element, and the text node and offset in it.

    The node is the first in which the element's text reaches the offset; null, as the element itself is meant, where the offset is null, zero or less, or beyond its text. Points that repeat each
    have their row; columns of their own are kept. One shuffle by id and path, one by id.
    """
    asked = points.select("id", F.col("dom_path").alias("path"), F.struct(*points.columns).alias("__row"))
    elements = tree.where("kind = 'element'").select("id", "path", "start", "end")
    offset = F.col("__row.char_offset")
    placed = asked.join(elements, ["id", "path"], "left")
    at = F.when((offset > 0) & (F.col("start") + offset <= F.col("end")), (F.col("start") + offset).cast("int"))
    placed = placed.select("id", "__row", F.col("start").isNotNull().alias("found"), at.alias("at"))
    none = F.lit(None)
    nodes = tree.where("kind = 'text'").select("id", F.struct("number", "start").alias("node"), F.col("end").alias("at"), F.lit(0).alias("kind"), none.cast(placed.schema["__row"].dataType).alias("__row"), none.cast("boolean").alias("found"))
    wanted = placed.select("id", none.cast(nodes.schema["node"].dataType).alias("node"), "at", F.lit(1).alias("kind"), "__row", "found")
    # from the end of each text on: the last node seen is the first that ends at a place or behind it
    back = Window.partitionBy("id").orderBy(F.col("at").desc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = nodes.union(wanted).withColumn("node", F.last("node", ignorenulls=True).over(back)).where("kind = 1")
    reached = F.col("at").isNotNull()
    return seen.select("__row.*", "found", F.when(reached, F.col("node.number")).alias("to_node"), F.when(reached, F.col("at") - F.col("node.start")).alias("to_offset"))
