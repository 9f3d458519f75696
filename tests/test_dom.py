"""Positions in element trees against a walk over trees of objects, and fixed pages."""

import random
from html import escape

import pytest
from pyspark.sql import functions as F

from foliant.functions import cfi
from foliant.operators import dom


def grown(rng, depth=0):
    """A random element: a name and a list of texts and elements; no two texts on end."""
    kids, last = [], True
    for _ in range(rng.randrange(0, 5)):
        if not last and rng.random() < 0.6:
            kids.append("".join(rng.choice(["a", "é", "𝄞", "<", "&", '"', " ", "\n", "word"]) for _ in range(rng.randrange(1, 9))))
            last = True
        elif depth < 5:
            kids.append(("span" if depth > 2 else rng.choice(["div", "section", "span", "figure", "em", "blockquote"]), *grown(rng, depth + 1)))
            last = False
    return (kids,)


def marked(rng, kids):
    out = []
    for k in kids:
        if isinstance(k, str):
            out.append(escape(k) if rng.random() < 0.5 else "".join(f"&#{ord(c)};" if c in "<&é" else c for c in k))
        else:
            attribute = rng.choice(["", " a=b'c", " title='>'", ' x="</div>" y', " data-q = \"it's\""])
            out.append(f"<{k[0]}{attribute}>{marked(rng, k[1])}</{rng.choice([k[0], k[0].upper()])}>")
    return "".join(out)


def walked(kids):
    """(text, [(name, path) of its ancestors], where each ancestor's text begins), by recursion."""
    out, length = [], 0

    def go(kids, above):
        nonlocal length
        place = 0
        for k in kids:
            if isinstance(k, str):
                out.append((k, above, length))
                length += len(k.encode("utf-16-le")) // 2
            else:
                go(k[1], [*above, (k[0], above[-1][1] + [place], length)])
                place += 1

    go(kids, [("body", [], 0)])
    return out


def test_random_trees_against_a_walk(spark):
    rng = random.Random(3)
    pages = [grown(rng)[0] for _ in range(150)]
    rows = [(i, f"<!DOCTYPE html><html><head><title>x</title></head><body class=a>{marked(rng, kids)}</body></html>") for i, kids in enumerate(pages)]
    tree = dom.parse(spark.createDataFrame(rows, "id long, html string")).cache()
    for unit in ("last", "middle"):
        want = []
        for i, kids in enumerate(pages):
            for k, (text, above, start) in enumerate(walked(kids)):
                length = len(text.encode("utf-16-le")) // 2
                own = length if unit == "last" else (length + 1) // 2
                block = next((a for a in reversed(above) if a[0] in dom.BLOCKS), above[-1])
                want.append((i, k, block[0], tuple(block[1]), start - block[2] + own, own))
        at = dom.positions(tree, unit)
        assert sorted((r.id, r.node, r.element, tuple(r.dom_path), r.char_offset, r.node_offset) for r in at.collect()) == sorted(want) and len(want) > 200
        back = dom.resolve(tree, at).collect()
        assert len(back) == len(want) and all(r.found and (r.to_node, r.to_offset) == (r.node, r.node_offset) for r in back)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>one<p>two", [("p", [0], 0, 3), ("p", [1], 3, 6)]),
        ("a<br>b<!-- c -->d", [("body", [], 0, 1), ("body", [], 1, 2), ("body", [], 2, 3)]),
        ("x</i>y", [("body", [], 0, 2)]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("li", [0, 0], 0, 1), ("li", [0, 0, 0, 0], 1, 2), ("li", [0, 1], 2, 3)]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", [("td", [0, 0, 0, 0], 0, 1), ("td", [0, 0, 0, 1], 1, 2), ("th", [0, 0, 1, 0], 2, 3), ("body", [], 3, 4)]),
        ("<script>if (a<b) '</p>'</script><p>z", [("script", [0], 0, 15), ("p", [1], 15, 16)]),
        ("<h1>a<h2>b</h2>", [("h1", [0], 0, 1), ("h2", [1], 1, 2)]),
        ("<p>a<div>b</div>c</p>d", [("p", [0], 0, 1), ("div", [1], 1, 2), ("body", [], 2, 3), ("body", [], 3, 4)]),
        ("<pre>\nab\r\nc</pre>", [("pre", [0], 0, 4)]),
        ("<svg><path/><g/></svg><p>1 < 2 &amp; &eacute;</p>", [("p", [1], 0, 9)]),
        ("<p title='open>a</p>", []),
        ("<p>a</p><!-- open", [("p", [0], 0, 1)]),
        ("<dl><dt>a<dd>b</dl><b>c", [("dt", [0, 0], 0, 1), ("dd", [0, 1], 1, 2), ("b", [1], 2, 3)]),
        ("", []),
    ],
)
def test_fixed_pages(html, want):
    assert [(r[2], r[3], r[4], r[5]) for r in dom.Tree(html).rows() if r[0] == "text"] == want


def test_resolve_at_edges(spark):
    tree = dom.parse(spark.createDataFrame([(1, "<p>ab<i>cd</i></p><p></p>"), (2, None), (3, "")], "id long, html string"))
    asked = [(1, [0], 2), (1, [0], 3), (1, [0], 4), (1, [0], 5), (1, [0], 0), (1, [0], None), (1, [0], -1), (1, [0, 0], 1), (1, [0, 0], 3), (1, [1], 1), (1, [7], 1), (1, None, 1), (1, [], 3), (2, [], 1), (3, [], 1), (9, [0], 1), (1, [0], 2)]
    points = spark.createDataFrame([(*a, "x") for a in asked], "id long, dom_path array<int>, char_offset int, found2 string")
    got = sorted(((r.id, r.dom_path, r.char_offset, r.found, r.to_node, r.to_offset) for r in dom.resolve(tree, points).collect()), key=repr)
    node = {(0, 2): (0, 2), (0, 3): (1, 1), (0, 4): (1, 2)}
    want = []
    for i, path, offset in asked:
        found = (i == 1 and path in ([0], [0, 0], [1], [])) or (i == 3 and path == [])
        to = node.get((0, offset), (None, None)) if i == 1 and path in ([0], []) else (1, 1) if path == [0, 0] and offset == 1 else (None, None)
        want.append((i, path, offset, found, *to))
    assert got == sorted(want, key=repr)


def test_identifiers_round_trip(spark):
    tree = dom.parse(spark.createDataFrame([(1, "<div><p>ab</p>x<p>c<b>d</b></p></div>")], "id long, html string"))
    named = dom.positions(tree).select("node", cfi.generate_full(*map(F.expr, ("2", "'c'", "dom_path", "char_offset"))).alias("cfi"))
    assert [r.cfi for r in named.orderBy("node").collect()] == ["epubcfi(/6/6[c]!/2/2:2)", "epubcfi(/6/6[c]!/2:3)", "epubcfi(/6/6[c]!/2/4:1)", "epubcfi(/6/6[c]!/2/4:2)"]


def test_long_and_deep_pages_take_linear_time():
    assert len(dom.Tree("<p>" * 100_000).names) == 100_001
    deep = dom.Tree("<div>" * 50_000 + "x")
    assert len(deep.path(deep.texts[0][0])) == 50_000
    assert dom.Tree("<" * 200_000).length == 200_000 and dom.Tree("<a b='" * 50_000).length == 0


def test_pages_are_read_one_at_a_time(spark):
    import pyarrow as pa

    pages = spark.createDataFrame([(1, "<p>a</p>")], "id long, html string")
    assert "MapInPandas" not in dom.parse(pages)._jdf.queryExecution().toString()
    caught = []
    pages.select = lambda *c: type("Caught", (), {"where": lambda self, w: self, "mapInArrow": lambda self, run, schema: caught.append(run)})()
    dom.parse(pages)
    got = list(caught[0](iter([pa.RecordBatch.from_pydict({"id": [7, 8], "html": ["<p>a</p>" * 40_000, "<p>b</p>" * 40_000]})])))
    assert len(got) > 1 and max(b.num_rows for b in got) <= dom.BATCH and sum(b.num_rows for b in got) == 2 * (1 + 80_000)
