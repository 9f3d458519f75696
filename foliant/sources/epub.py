"""EPUB archives: binaryFile rows in, spine sections, navigation and resources out.

A row is a whole archive, so nothing is shuffled and archives are read where they lie; a
column-pruned metadata scan never inflates content. What a task holds is one archive and HELD bytes of rows.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "path string, title string, author string, spine_index int, spine_item_id string, href string, media_type string, ncx_label string, html string, css string, error string"
HTML = ("application/xhtml+xml", "text/html")
#: Bytes of rows that are handed on at once.
HELD = 4_000_000
_KINDS = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


class EpubError(ValueError):
    pass


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, made one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _handed(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows as a schema has them, each of about HELD bytes and at most 10,000 rows, a longer row apart."""
    fields = [(x.split()[0], _KINDS[x.split()[1]]) for x in schema.split(", ")]
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], names=[n for n, _ in fields])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if size > HELD or len(held) == 10_000:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in root.iter() if _local(x) == name]


def container_path(xml: bytes) -> str:
    """The package document's path: the last rootfile's full-path."""
    paths = [p for x in _all(ET.fromstring(xml), "rootfile") if (p := x.get("full-path"))]
    if not paths:
        raise EpubError("container missing")
    return paths[-1]


def package(xml: bytes, base: str) -> dict:
    """title, author, manifest {id: (path, media type)} of complete items, spine [idref]."""
    root = ET.fromstring(xml)
    text = lambda name: next((x.text.strip() for x in _all(root, name) if x.text and x.text.strip()), None)
    items = {x.get("id"): (posixpath.normpath(posixpath.join(base, x.get("href"))), x.get("media-type")) for x in _all(root, "item") if x.get("id") and x.get("href") and x.get("media-type")}
    spine = [x.get("idref") for x in _all(root, "itemref") if x.get("idref")]
    if not spine:
        raise EpubError("spine missing")
    return {"title": text("title"), "author": text("creator"), "manifest": items, "spine": spine}


def navigation(xml: bytes) -> list[tuple[str, str]]:
    """(label, target) of each navigation point of an NCX, in the order in which they end.

    A point's label and target are those last seen before it ends and since a point last began or
    ended; so a point with points inside is lost, as its own are gone when it ends.
    """
    points, label, target, in_label = [], None, None, False
    for event, node in ET.iterparse(io.BytesIO(xml), ("start", "end")):
        name = _local(node)
        if event == "start":
            if name == "navPoint":
                label = target = None
            elif name == "navLabel":
                in_label = True
            elif name == "content" and node.get("src"):
                target = node.get("src")
        elif name == "text" and in_label:
            label = (node.text or "").strip()
        elif name == "navLabel":
            in_label = False
        elif name == "navPoint":
            if label and target:
                points.append((label, target))
            label = target = None
    return points


def sections(data: bytes, content: bool = True, most: int | None = None) -> list[dict]:
    """One dict a spine item that is in the manifest and is HTML, in spine order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "META-INF/container.xml" not in names:
            raise EpubError("container missing")
        root = container_path(z.read("META-INF/container.xml"))
        if root not in names:
            raise EpubError("package missing")
        pack = package(z.read(root), posixpath.dirname(root))
        labels: dict[str, str] = {}
        for path, kind in pack["manifest"].values():
            if kind == "application/x-dtbncx+xml" and path in names:
                labels |= {src.partition("#")[0]: label for label, src in navigation(z.read(path))}
        css = "\n".join(z.read(p).decode("utf-8", "replace") for p, kind in pack["manifest"].values() if kind == "text/css" and p in names) if content else None
        out: list[dict] = []
        for idref in pack["spine"]:
            path, kind = pack["manifest"].get(idref, (None, None))
            if kind not in HTML or path not in names:
                continue
            if most is not None and len(out) >= most:
                break
            label = None
            for src, text in labels.items():  # a later point that fits overwrites
                if path.endswith(src) or src.endswith(path):
                    label = text
            out.append({"title": pack["title"], "author": pack["author"], "spine_index": len(out), "spine_item_id": idref, "href": path, "media_type": kind, "ncx_label": label, "html": z.read(path).decode("utf-8", "replace") if content else None, "css": css})
        if not out:
            raise EpubError("empty content")
        return out


def read_sections(archives: DataFrame, content: bool = True, most: int | None = None) -> DataFrame:
    """SECTIONS rows of archives (path, content). A broken archive gives one row with `error` alone."""
    names = [x.split()[0] for x in SECTIONS.split(", ")]

    def rows(archives: Iterable[tuple]) -> Iterator[tuple]:
        for path, data in archives:
            try:
                found = sections(bytes(data), content, most)
            except (EpubError, zipfile.BadZipFile, ET.ParseError, TypeError) as e:
                found = [{"error": str(e) or type(e).__name__}]
            yield from (tuple(({"path": path} | s).get(n) for n in names) for s in found)

    return archives.select("path", "content").mapInArrow(lambda batches: _handed(rows(_rows(batches)), SECTIONS), SECTIONS)


RESOURCES = "path string, resource string, file_name string, media_type string, content binary"


def read_resources(archives: DataFrame, kinds: str = "image/") -> DataFrame:
    """RESOURCES rows of the manifest's items whose media type begins with `kinds`; an item that the archive lacks, and a broken archive, give none.

    resource is the item's path in the archive; file_name is what relative references may name it by.
    """
    def rows(archives: Iterable[tuple]) -> Iterator[tuple]:
        for path, data in archives:
            found = []
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    there = set(z.namelist())
                    root = container_path(z.read("META-INF/container.xml"))
                    for item, kind in package(z.read(root), posixpath.dirname(root))["manifest"].values():
                        if kind.startswith(kinds) and item in there:
                            found.append((path, item, posixpath.basename(item), kind, z.read(item)))
            except (EpubError, zipfile.BadZipFile, ET.ParseError, KeyError, TypeError):
                continue
            yield from found

    return archives.select("path", "content").mapInArrow(lambda batches: _handed(rows(_rows(batches)), RESOURCES), RESOURCES)


def write_archives(sections: DataFrame) -> DataFrame:
    """(path, content): an archive of the sections (path, title, author, spine_item_id, place, label, html, image) of each path, by place.

    A null label is no navigation point, a null image (binary, PNG) no item of the manifest.

    An archive is one row, so the sections of a path meet in one task, which holds one archive at a time.
    """

    def archive(rows: Iterable[tuple]) -> bytes:
        out, items, images, refs, points = io.BytesIO(), [], [], [], []
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", "application/epub+zip")
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>')
            for i, (_, title, author, item, label, html, image) in enumerate(rows):
                head = head if i else f"<dc:title>{escape(title or '')}</dc:title><dc:creator>{escape(author or '')}</dc:creator>"
                items.append(f'<item id={quoteattr(item)} href="s{i}.xhtml" media-type="application/xhtml+xml"/>')
                refs.append(f"<itemref idref={quoteattr(item)}/>")
                z.writestr(f"OPS/s{i}.xhtml", (html or "").encode("utf-8", "replace"))
                if label:
                    points.append(f'<navPoint><navLabel><text>{escape(label)}</text></navLabel><content src="s{i}.xhtml"/></navPoint>')
                if image is not None:
                    images.append(f'<item id="image{i}" href="img/p{i}.png" media-type="image/png"/>')
                    z.writestr(f"OPS/img/p{i}.png", image)
            z.writestr("OPS/content.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{head}</metadata><manifest>{"".join(items + images)}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{"".join(refs)}</spine></package>')
            z.writestr("OPS/toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{"".join(points)}</navMap></ncx>')
        return out.getvalue()

    schema = "path string, content binary"
    columns = ("path", "title", "author", "spine_item_id", "label", "html", "image")
    placed = sections.repartition("path").sortWithinPartitions("path", F.col("place").asc_nulls_last()).select(*columns)
    return placed.mapInArrow(lambda batches: _handed(((path, archive(rows)) for path, rows in groupby(_rows(batches), key=lambda r: r[0])), schema), schema)


def section_at(archives: DataFrame, index: int) -> DataFrame:
    """The section at a place in the spine of each archive that has one; a negative place has none."""
    found = read_sections(archives, most=index + 1) if index >= 0 else read_sections(archives, content=False, most=0)
    return found.where((F.col("spine_index") == index) & F.col("error").isNull())


def scan(spark: SparkSession, path: str, content: bool = True, most: int | None = None) -> DataFrame:
    """All .epub files below a path, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read_sections(files.where(F.lower("path").endswith(".epub")), content, most)


def new_books(found: DataFrame, library: DataFrame) -> DataFrame:
    """Rows of found (title) whose title the library lacks, in either case; the library is read once, so copies within found all stay."""
    known = library.select(F.lower("title").alias("__title")).distinct()
    return found.join(known, F.lower(found.title) == F.col("__title"), "left_anti")
