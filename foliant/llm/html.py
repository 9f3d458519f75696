"""Main text of web pages by equivalence-class template deduction.

A page is read as a sequence of tokens: its containers, each in the role that its path gives it, and the running
text that belongs to them. Neutral siblings of one kind (div, div, div) are told apart by their place among them, and what repeats
beyond that, or repeats by name, is one repeating role. Over the pages of a host every token has an occurrence vector: how often each page
has it. Tokens that share a vector form an equivalence class.

A container is part of the template if its vector is a multiple of that of the pages that have it, if its parents are part too, and if the
containers of its class stand on the page in the order that they have on all pages; any other is content of the slot around it.
Texts that share their container's vector, or that of all pages of a layout, are the template's own. What is left, each distinct text counted once, is the slots'
running text. The article is the slot that holds it, followed from the root down to where it spreads out; sibling slots of one class may hold it
together, and the rest of a page, outside all parts of the template, is a slot as well. Names in tags and classes decide between slots that
hold comparable amounts, and alone on pages of which no other page of the host has a container.

Vectors are compared by two sums of hashes, which combine before they shuffle; a host with a third of
all pages is as many partial sums as there are tasks. Pages are grouped by layout, the set of their containers, and a
page takes the template of its layout, which has no more tokens than its pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise
from .urlfilter import split_url

#: HTML elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "dialog", "fieldset", "menu"}
#: Containers only where they have a name.
LISTS = {"ul", "ol", "dl", "table", "figure", "details"}
BLOCKS = CONTAINERS | LISTS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "figcaption", "address", "hr", "summary", "legend", "label", "button", "option"}
BOILER_TAGS = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "button", "fieldset"}
#: Words in a class, id or role that name a container's part.
BOILER_WORDS = {"nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "side", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "form", "subscribe", "subscription", "newsletter", "signup", "login", "search", "comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "widgets", "toolbar", "copyright", "complementary", "contentinfo", "disclaimer", "skip", "tags"}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "main", "maincontent", "articlebody", "text", "body"}

#: A quote that nothing closes is part of a value that ends at white space or the tag's end.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>]*))"""
NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*"
EQUALS = r"[ \t\n\f\r]*=[ \t\n\f\r]*"
ATTRIBUTE = re.compile(rf"({NAME})(?:{EQUALS}{VALUE})?|[ \t\n\f\r/]+")
_BARE = VALUE.replace("(", "").replace(")", "").replace("?:", "")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\f\r/]+|{NAME}(?:{EQUALS}(?:{_BARE}))?)*+)(?:>|(\Z))|[^<]+|<", re.S)
NAMED = ("class", "id", "role")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
DIGITS = re.compile(r"\d+")
#: Distinct pages that a text of a class must be on to be the template's.
SUPPORT = 3
#: Neutral siblings up to this number have roles by their place; more are one repeating role.
PLACES = 8
#: Containers nested deeper are content of the one at this depth, but for menus, notices and so on, which stand directly in it.
DEPTH = 64


class Page:
    """blocks: (container path, text, link characters) in page order; paths: containers in the order of their beginnings, with their numbers of occurrences."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str]] = []  # parent's number, name
        self.found: list[tuple[int, str, int]] = []  # container's number, text, link characters
        self.stack: list[tuple[str, int]] = []  # open containers: tag, number
        self.opened: dict[str, int] = {}
        self.words: list[str] = []
        self.linked: list[list[str]] = []  # the words of each link of the block
        self.in_link = False
        self.read(source)
        roles = self.roles()
        self.blocks = [(roles[n], text, links) for n, text, links in self.found]
        self.paths: dict[str, int] = {}
        for role in roles[:-1]:
            self.paths[role] = self.paths.get(role, 0) + 1

    def roles(self) -> list[str]:
        """The path of each container, and last the empty one of what is outside all."""
        alike: dict[tuple[int, str], int] = {}
        for node in self.nodes:
            alike[node] = alike.get(node, 0) + 1
        seen: dict[tuple[int, str], int] = {}
        out: list[str] = []
        for node in self.nodes:
            parent, name = node
            if (m := alike[node]) > 1:
                k = seen[node] = seen.get(node, 0) + 1
                name += f"@{k}:{m}" if m <= PLACES and "." not in name else "@"
            out.append(f"{out[parent] if parent >= 0 else ''}/{name}")
        return [*out, ""]

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.found.append((self.stack[-1][1] if self.stack else -1, text, sum(len(" ".join("".join(x).split())) for x in self.linked)))
        self.words, self.linked = [], []

    def read(self, source: str) -> None:
        at, lower = 0, None
        while m := TOKEN.match(source, at):
            at = m.end()
            if m[2] is None:
                if m[0][0] != "<" or m[0] == "<":
                    self.words.append(html.unescape(m[0]))
                    if self.in_link:
                        if not self.linked:
                            self.linked.append([])
                        self.linked[-1].append(self.words[-1])
                continue
            if m[4] is not None:
                break  # the page ends within a tag
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                if m[3].endswith("/") and tag == "svg":
                    continue
                lower = lower or source.lower()
                if len(lower) != len(source):  # some characters change length
                    lower = re.sub(r"[A-Z]", lambda x: x[0].lower(), source)
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    break
                at = source.find(">", end) + 1 or len(source)
                continue
            if tag == "a":
                self.in_link = not closing
                if self.in_link:
                    self.linked.append([])
            elif tag == "br":
                self.words.append(" ")
            if tag in BLOCKS:
                self.flush()
                self.in_link = False
                self.close(tag) if closing else self.open(tag, m[3])
        self.flush()

    def open(self, tag: str, attributes: str) -> None:
        if tag not in CONTAINERS and tag not in LISTS:
            return
        names = sorted({DIGITS.sub("#", x).replace("/", "|") for name, *value in ATTRIBUTE.findall(attributes) if name.lower() in NAMED for x in "".join(value).split()}) if attributes else []
        number = self.stack[-1][1] if self.stack else -1
        element = ".".join([tag, *names])
        if len(self.stack) >= DEPTH and number >= 0:
            new = is_boiler(f"/article/{element}") and not is_boiler(f"/article/{self.nodes[number][1]}")
        else:
            new = tag in CONTAINERS or bool(names)
        if new:
            self.nodes.append((number, element))
            number = len(self.nodes) - 1
        self.stack.append((tag, number))
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def close(self, tag: str) -> None:
        while self.opened.get(tag):
            last = self.stack.pop()[0]
            self.opened[last] -= 1
            if last == tag:
                return


def tag_of(element: str) -> str:
    return element.split(".", 1)[0].split("@", 1)[0]


def words_in(element: str) -> set[str]:
    """The parts of an element's class, id and role names, lower-cased."""
    return {p.lower() for name in element.split("@", 1)[0].split(".")[1:] for p in PARTS.findall(name)}


@lru_cache(100_000)
def is_boiler(path: str) -> bool:
    """Whether an element on the path is a menu, header, footer, sidebar, notice, advert, form or comment section.

    A header inside an article holds its title and stays.
    """
    inside = False
    for element in path.split("/")[1:]:
        tag, names = tag_of(element), words_in(element)
        if tag in BOILER_TAGS or (tag == "header" and not inside):
            return True
        if tag in ("article", "main"):
            names &= {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "sponsored", "promo", "related"}
        elif tag in ("html", "body"):
            names = set()
        elif inside:
            names -= {"header", "text", "side", "form", "tags"}
        if names & BOILER_WORDS:
            return True
        inside = inside or tag in ("article", "main")
    return False


@lru_cache(100_000)
def tier(path: str) -> int:
    """How clearly a container says that it holds the article: 3 by element, 2 by role, 1 by name, 0 not at all."""
    element = path.rpartition("/")[2]
    tag = tag_of(element)
    if tag == "article":
        return 3
    if tag == "main" or "main" in element.split("@", 1)[0].split(".")[1:]:
        return 2
    return 1 if tag in ("div", "section") and words_in(element) & CONTENT_WORDS else 0


class Template:
    """Of the pages of one layout, from rows (token, a, b, times, each, place, fresh): its containers' classes, and the running text that pages have in each.

    A container's class is the key of its occurrence vector, (times, a, b). each says how often every page that has it has it, 0 if that varies.
    Texts that are the template's own are rows too (#), and a layout has one of its own (=), so that a page without any row is one that no template knows.
    """

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        boxes = [r for r in rows if r[0].startswith("/")]
        self.kind = {token: (times, a, b) for token, a, b, times, *_ in boxes}
        self.fresh = {token: fresh for token, *_, fresh in boxes}
        self.fixed = {r[0] for r in rows if r[0].startswith("#")}
        self.parts = {token for token, _, _, _, each, _, _ in boxes if each}
        self.parts = {t for t in self.parts if all(p in self.parts for p in prefixes(t))}
        self.classes: dict[tuple, list[str]] = {}
        for token, _, _, _, _, _, _ in sorted((r for r in boxes if r[0] in self.parts), key=lambda r: (r[5], r[0])):
            self.classes.setdefault(self.kind[token], []).append(token)

    def on(self, page: Page) -> list[str]:
        """The template's parts on a page: classes in another order than on all pages are none of it, and neither is what they hold."""
        at = {p: i for i, p in enumerate(page.paths)}
        good: set[str] = set()
        for tokens in self.classes.values():
            places = [at[t] for t in tokens if t in at]
            if places == sorted(places):
                good.update(tokens)
        return [p for p in page.paths if p in good and all(q in good for q in prefixes(p))]

    def main(self, page: Page) -> tuple[list[str], set[str]]:
        """The article's containers on a page of this layout, none for the whole page, and the containers that are left out."""
        if not self.rows:
            return [], set()
        holds = self.holdings(page)
        if all(map(is_root, self.kind)) or not holds[""]:
            return by_words(page.paths), {p for p in page.paths if is_boiler(p)}
        parts_on = self.on(page)
        if not parts_on:  # containers recur, but none as part of a template: the whole page is its slot
            return [], set()
        inner: dict[str, list[str]] = {}
        for p in parts_on:
            if holds[p]:
                inner.setdefault(next(prefixes(p), ""), []).append(p)
        tops, out = [""], set()
        while len(tops) == 1 and (parts := inner.get(tops[0])):
            top, most = tops[0], max(holds[p] for p in parts)
            near = sorted((p for p in parts if holds[p] >= TIE * most), key=lambda p: (-holds[p], p))
            # a tie: names decide
            near = [p for p in near if not says_boiler(p, top)] or near
            near = [p for p in near if tier(p) >= 2] or near
            near = [p for p in near if self.kind[p] == self.kind[near[0]]]
            held, rest = sum(holds[p] for p in near), holds[top] - sum(holds[p] for p in parts)
            if is_root(top):
                if held < rest:  # the rest of the page is the slot
                    out = {p for p in parts if holds[p] < TIE * rest} | {p for p in parts_on if not holds[p] and not is_root(p)}
                    break
            elif held < holds[top] * (0.95 if tier(top) or says_boiler(near[0], top) else 0.6 if self.kind[top] == self.kind[near[0]] else 0.9):
                break
            tops = near
        return [t for t in tops if not is_root(t)], out | {p for t in tops for p in page.paths if p != t and below(p, t) and says_boiler(p, t) and holds[t] - holds[p] >= 0.2 * holds[t]}

    def holdings(self, page: Page) -> dict[str, float]:
        """The running text in and below each container: an average page's, or this page's in those that only it has."""
        holds = dict.fromkeys(page.paths, 0.0) | {"": 0.0}
        found = [(p, self.fresh[p]) for p in page.paths if p in self.fresh] + [(p, max(0, len(text) - links)) for p, text, links in page.blocks if p not in self.fresh]
        for p, n in found:
            for q in {p, *prefixes(p), ""}:
                holds[q] += n
        return holds


#: A slot that holds this part of what its largest sibling holds is tied with it.
TIE = 0.25


def is_root(path: str) -> bool:
    return all(tag_of(x) in ("html", "body") for x in path.split("/")[1:])


def says_boiler(path: str, top: str) -> bool:
    """Whether the last element of a path below top names itself a menu, notice and so on; inside an article or a slot of a page less does."""
    inside = not is_root(top) or any(tag_of(x) in ("article", "main") for x in path.split("/")[1:-1])
    return is_boiler(("/article/" if inside else "/") + path.rpartition("/")[2])


def by_words(paths: dict[str, int]) -> list[str]:
    """The article's containers on a page without a template, by names alone: those of the clearest kind."""
    open_ = [p for p in paths if not is_boiler(p)]
    best = max((tier(p) for p in open_), default=0)
    return [p for p in open_ if best and tier(p) == best]


def prefixes(path: str) -> Iterator[str]:
    at = path.rfind("/")
    while at > 0:
        yield path[:at]
        at = path.rfind("/", 0, at)


def below(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def extract(page: Page, template: Template) -> str:
    """The article's blocks, joined by line ends.

    Inside the article's containers nothing is left out for being repeated or a link. Where the page itself is the slot, texts of the
    template go, unless they are most of the page. Without any template the whole page is the text.
    """
    tops, out = template.main(page)
    kept = [x for x in page.blocks if (not tops or any(below(x[0], t) for t in tops)) and not (out and (x[0] in out or any(p in out for p in prefixes(x[0]))))]
    if not tops and template.rows:
        slot = [x for x in kept if text_key(*x[:2]) not in template.fixed] if template.fixed else kept
        kept = slot if 2 * sum(len(x[1]) for x in slot) >= sum(len(x[1]) for x in kept) else kept
    return "\n".join(text for _, text, _ in kept)


def text_key(path: str, text: str) -> str:
    import xxhash

    return "#" + xxhash.xxh64_hexdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"))


def layout_of(page: Page) -> tuple[str, str]:
    """The key of a page's layout, and its containers."""
    import xxhash

    paths = "\n".join(sorted(page.paths))
    return "=" + xxhash.xxh128_hexdigest(paths.encode("utf-8", "surrogatepass")), paths


def tokens(pages: DataFrame) -> DataFrame:
    """(host, token, path, pages, a, b, times, text, place): token statistics over all pages of each host.

    a and b are sums over pages of hash(page) x occurrences: equal sums, equal occurrence vectors. text is the running
    text, without links; place the sum of where a container stands among its page's. Tokens are containers (a path), texts (# and a key; path is their container),
    layouts (= and a key; path lists the containers), and contents (@ and a key; path is the layout's key).
    """

    def setup():
        import xxhash

        def step(batch: pa.RecordBatch) -> dict:
            total: dict[tuple[str, str, str], list[int]] = {}
            for url, source in zip(batch["url"].to_pylist(), batch["html"], strict=True):
                text = source.as_py() or ""
                host, page = split_url(url)[0], Page(text)
                content = xxhash.xxh128_intdigest(text.encode("utf-8", "surrogatepass"))
                a, b = content & 0xFFFFFFF, content >> 100
                layout, paths = layout_of(page)
                seen: dict[tuple[str, str], list[int]] = {(p, p): [n, 0, i] for i, (p, n) in enumerate(page.paths.items())} | {(layout, paths): [1, 0, 0], (f"@{content:032x}", layout): [1, 0, 0]}
                for path, block, links in page.blocks:
                    x = seen.setdefault((text_key(path, block), path), [0, 0, 0])
                    x[0] += 1
                    x[1] += max(0, len(block) - links)
                for (token, path), (n, size, place) in seen.items():
                    t = total.setdefault((host, token, path), [0] * 6)
                    for i, v in enumerate((1, a * n, b * n, n, size, place)):
                        t[i] += v
            return {c: [k[i] for k in total] for i, c in enumerate(("host", "token", "path"))} | {c: [v[i] for v in total.values()] for i, c in enumerate(SUMS)}

        return step

    parts = map_batches(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "host string, token string, path string, " + ", ".join(f"{c} long" for c in SUMS), setup)
    return parts.groupBy("host", "token", "path").agg(*[F.sum(c).alias(c) for c in SUMS])


SUMS = ("pages", "a", "b", "times", "text", "place")


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(host, layout, template): of each layout, its containers on two distinct pages of the host or more, the texts of its classes, and a row of its own.

    A text is the template's if its occurrence vector is its container's or the layout's, on at least `support` distinct pages.
    """
    stats = materialise(tokens(pages), "tokens")
    of = lambda mark: stats.where(F.col("token").startswith(mark))
    size = of("@").groupBy("host", F.col("path").alias("layout")).agg(F.count("*").alias("size"))
    layouts = of("=").select("host", F.col("token").alias("layout"), "path", "pages", "a", "b").join(size, ["host", "layout"])
    parts = materialise(layouts.select("host", "layout", "size", "a", "b", F.explode(F.split("path", "\n")).alias("path")), "layouts")
    # the vector of the pages that have a container is the sum of its layouts'
    whole = parts.groupBy("host", "path").agg(F.sum("size").alias("size"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    each = F.expr("if(times % pages = 0 and a = all_a * (times div pages) and b = all_b * (times div pages), times div pages, 0)")
    boxes = of("/").select("host", "path", "pages", "a", "b", "times", "place").join(whole, ["host", "path"]).where("size > 1").withColumn("each", each)
    boxes = materialise(boxes.drop("all_a", "all_b"), "containers")
    again = of("#").where(F.col("pages") >= support)
    by_layout = again.join(layouts.where(F.col("size") >= support).select("host", "layout", "pages", "a", "b"), ["host", "pages", "a", "b"]).select("host", "layout", "path", "token")
    by_box = again.join(boxes.where(F.col("size") >= support).select("host", "path", "pages", "a", "b"), ["host", "path", "pages", "a", "b"]).select("host", "path", "token").join(parts, ["host", "path"]).select("host", "layout", "path", "token")
    fixed = materialise(by_layout.union(by_box).distinct(), "fixed")
    # each distinct text counts once
    fresh = of("#").groupBy("host", "path").agg(F.sum(F.col("text") / F.col("times")).alias("fresh"))
    less = again.join(fixed.select("host", "path", "token").distinct(), ["host", "path", "token"]).groupBy("host", "path").agg(F.sum(F.col("text") / F.col("times")).alias("less"))
    known = boxes.join(fresh, ["host", "path"], "left").join(less, ["host", "path"], "left")
    left = F.round(F.greatest(F.coalesce("fresh", F.lit(0.0)) - F.coalesce("less", F.lit(0.0)), F.lit(0.0)) / F.col("size"), 3)
    row = lambda token, *values: F.struct(F.col(token).alias("token"), *[v.cast("double" if n == "fresh" else "long").alias(n) for n, v in zip(("a", "b", "times", "each", "place", "fresh"), values, strict=True)]).alias("row")
    none = [F.lit(0)] * 6
    rows = parts.select("host", "layout", "path").join(known.select("host", "path", row("path", *map(F.col, ("a", "b", "times", "each", "place")), left)), ["host", "path"]).select("host", "layout", "row")
    texts = fixed.select("host", "layout", row("token", *none))
    own = layouts.select("host", "layout", row("layout", *none))
    return rows.union(texts).union(own).groupBy("host", "layout").agg(F.collect_list("row").alias("template"))


def main_text(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html); text is empty if there is none.

    A null html is an empty page, and pages without a host form a group of their own. Repeated rows each have
    their text; no rows, no result; whole pages are read, however long. Only these three columns are read. Templates of up to `broadcast_bytes` in all are
    broadcast and each page is then read once; beyond, layouts are joined, and Spark splits a skewed one.
    """
    spark, found = pages.sparkSession, materialise(templates(pages), "templates")
    size = found.select(F.sum(F.length("host") + F.aggregate("template", F.lit(0), lambda n, x: n + F.length(x["token"]) + 100)).alias("n")).first().n or 0
    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.col("url").cast("string").alias("at"))
    if size <= broadcast_bytes:
        table = {(r.host, r.layout): [tuple(x) for x in r.template] for r in found.collect()}
        return _extracted(rows, kind, spark.sparkContext.broadcast(table))

    def place():
        def step(batch: pa.RecordBatch) -> dict:
            keys = [(split_url(u)[0], layout_of(Page(x.as_py() or ""))[0]) for u, x in zip(batch["at"].to_pylist(), batch["html"], strict=True)]
            return {c: batch[c] for c in ("page_id", "url", "html")} | {"host": [k[0] for k in keys], "layout": [k[1] for k in keys]}

        return step

    placed = map_batches(rows, f"page_id {kind['page_id']}, url {kind['url']}, html string, host string, layout string", place)
    return _extracted(placed.join(found, ["host", "layout"], "left"), kind, None)


def _extracted(rows: DataFrame, kind: dict[str, str], shared) -> DataFrame:
    """page_id, url and text of rows with their html, and the host and layout's template unless `shared` has all of them."""

    def setup():
        known: dict[tuple[str, str], Template] = {}

        def template(key: tuple[str, str], rows: list[tuple]) -> Template:
            if key not in known:
                if len(known) > 500:
                    known.clear()
                known[key] = Template(rows)
            return known[key]

        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for i, source in enumerate(batch["html"]):
                page = Page(source.as_py() or "")
                if shared is not None:
                    key = split_url(batch["at"][i].as_py())[0], layout_of(page)[0]
                    out.append(extract(page, template(key, shared.value.get(key, []))))
                else:
                    key = batch["host"][i].as_py(), batch["layout"][i].as_py()
                    out.append(extract(page, known[key] if key in known else template(key, [tuple(r.values()) for r in batch["template"][i].as_py() or []])))
            return {"page_id": batch["page_id"], "url": batch["url"], "text": out}

        return step

    columns = ["page_id", "url", "html", "at"] if shared is not None else ["page_id", "url", "html", "host", "layout", "template"]
    return map_batches(rows.select(*columns), f"page_id {kind['page_id']}, url {kind['url']}, text string", setup)
