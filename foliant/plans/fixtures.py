"""Small fixed tables for tests, as SQL that both engines read, and questions that the router's query adds to those of the tables."""

from __future__ import annotations

import io
import zipfile


def _values(columns: str, rows: str) -> str:
    return f"SELECT * FROM (VALUES {rows.strip()}) AS t({columns})"


FIXTURES = {
    "questions": _values("question_id, question, title, author", "('f1', 'In this book, what happens in chapter 3?', 'Alice', 'Lewis Carroll'), ('f2', 'What is the capital of France?', 'Alice', 'Lewis Carroll'), ('f3', 'Who is Alice?', 'Wonderland', NULL), ('f4', 'What did Carroll mean?', 'Wonderland', 'Lewis Carroll'), ('f5', 'Tell me about the plot and the story', 'Wonderland', NULL), ('f6', 'Please search for cats', 'Wonderland', NULL), ('f7', 'Hello', '', NULL), ('f8', 'Why did Victor go north when all the others stayed behind in the town?', 'Wonderland', NULL), ('f9', '', NULL, NULL)"),
    "summaries": _values("id, reply", "(1, 'SUMMARY: It begins.\nIt goes on.\n\nKEY_POINTS:\n- first\n-second\nno point\nCHARACTERS: Ann, Bob ,, Cy'), (2, 'free text'), (3, 'summary:\n a \nKEY POINTS:\n- p\nCHARACTERS:\nDee')"),
    "synopses": _values("id, reply", "(1, 'SYNOPSIS: All of it.\nMore.\nCHARACTERS:\n- Ann: the heroine: brave\n- Bob\n- : none\nTHEMES:\n- love\n- '), (2, 'nothing here')"),
    "markup": _values("id, html", "(1, '<p>a<i/>b<br/>c<Span class=\"x\" />d</p>'), (2, 'plain'), (3, '<div/><hr/><a id=\"n\"/>'), (4, '')"),
    "pictures": _values("id, base_path, html", "(1, 'OPS/text', '<p><img alt=\"a\" src=\"../img/cover.jpg\"/>x<img src=\"none.png\"></p>'), (2, '', '<IMG SRC=''fig.svg''>'), (3, 'OPS', '<img src=\"img/plate.png\" width=\"3\"> and <b>text</b>')"),
    "encyclopedia": _values("query, status, body", """('sea', 200, '{"title": "Sea", "description": "body of water", "extract": "A sea is large.", "thumbnail": {"source": "t.jpg", "width": 1, "height": 1}, "content_urls": {"desktop": {"page": "http://e.org/Sea"}}}'), ('ship', 200, '{"title": "Ship", "extract": "A ship floats.", "originalimage": {"source": "o.jpg"}}'), ('gone', 404, '{"title": "Not found."}'), ('busy', 503, ''), ('odd', 200, 'no json')"""),
    "encyclopedia_search": _values("query, status, body", """('sea', 200, '{"query": {"search": [{"pageid": 1, "title": "Sea", "snippet": "the <b>sea</b> is"}, {"pageid": 2, "title": "Sea ice", "snippet": "ice"}]}}'), ('none', 200, '{"query": {"search": []}}'), ('busy', 500, '{}')"""),
    "place_search": _values("query, status, body", """('bath', 200, '[{"place_id": 1, "lat": "51.38", "lon": "-2.36", "display_name": "Bath, Somerset, UK", "type": "city", "address": {"city": "Bath", "state": "Somerset", "country": "UK"}}, {"place_id": 2, "lat": "x", "lon": "1", "display_name": "Nowhere", "type": "none"}]'), ('51.4,-2.3', 200, '{"place_id": 3, "lat": "51.4", "lon": "-2.3", "display_name": "Hill Farm, UK", "type": "farm"}'), ('busy', 429, '[]')"""),
}


def sample_epub() -> bytes:
    """A book of two sections with nested navigation and an image."""
    files = {
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>',
        "OPS/content.opf": '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Sample EPUB</dc:title><dc:creator>A. Writer</dc:creator></metadata><manifest><item id="c1" href="text/c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="text/c2.xhtml" media-type="application/xhtml+xml"/><item id="pic" href="p.png" media-type="image/png"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="s.css" media-type="text/css"/></manifest><spine toc="ncx"><itemref idref="c1"/><itemref idref="pic"/><itemref idref="gone"/><itemref idref="c2"/></spine></package>',
        "OPS/toc.ncx": '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Parent</text></navLabel><content src="text/c1.xhtml"/><navPoint><navLabel><text> Child </text></navLabel><content src="text/c2.xhtml#x"/></navPoint></navPoint></navMap></ncx>',
        "OPS/text/c1.xhtml": "<html><body><p>Hello from EPUB</p></body></html>",
        "OPS/text/c2.xhtml": "<html><body><h1>Two</h1><p>More text</p></body></html>",
        "OPS/s.css": "p { margin: 0 }",
        "OPS/p.png": "x",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()
