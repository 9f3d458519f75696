"""The block scan against the patterns that define it, and its time on markup that is left open."""

import random
import re
import time

import pytest

from foliant.functions.text import BLOCK_TYPES
from foliant.operators import blocks

TEXT_BLOCK = re.compile(r"<(p|h[1-6]|li|blockquote|pre|td)(\s[^>]*)?>(.+?)</\1>", re.I | re.S)
INNER_DIV = re.compile(r"<div(\s[^>]*)?>((?:(?!<div).)+?)</div>", re.I | re.S)
IMAGES = [
    re.compile(r"<div[^>]*>\s*(?:<img[^>]*>|<svg[^>]*>[\s\S]*?</svg>)\s*</div>", re.I),
    re.compile(r"<figure[^>]*>[\s\S]*?</figure>", re.I),
    re.compile(r"<svg[^>]*>[\s\S]*?<image[^>]*(?:xlink:)?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>[\s\S]*?</svg>", re.I),
    re.compile(r"<img[^>]*src\s*=\s*[\"']([^\"']+)[\"'][^>]*/?\s*>", re.I),
]


def by_patterns(html):
    found = []
    taken = lambda a, b: any(a < y and x < b for x, y, *_ in found)
    for m in TEXT_BLOCK.finditer(html):
        if text := blocks.plain(m[3]):
            found.append((m.start(), m.end(), BLOCK_TYPES[m[1].lower()], text))
    found += [(m.start(), m.end(), "paragraph", text) for m in INNER_DIV.finditer(html) if not taken(m.start(), m.end()) and not blocks.NESTED.search(m[2]) and (text := blocks.plain(m[2]))]
    for pattern in IMAGES:
        for m in pattern.finditer(html):
            if not taken(m.start(), m.end()):
                path = next((x[1] for p in blocks.IMAGE_PATHS if (x := p.search(m[0]))), "image")
                found.append((m.start(), m.end(), "image", path))
    return sorted(found)


BITS = ["<p>", "</p>", "<P class=a>", "</P>", "<div>", "</div>", "<div id=x>", "<img src='a.png'>", '<img src="b>c">', "<img>", "<svg>", "</svg>", "<figure>", "</figure>", "<image href='i.png'/>", '<image xlink:href="j.png">', "text ", "  ", "\n", "<h1>", "</h1>", "<li", "<td>", "</td>", "<pre>", "</pre>", ">", "<", "&amp;", "<table>", "<divider>", "<figures x>", "<span>", "</span>", "src='q'", "<p\n"]


@pytest.mark.parametrize("seed", range(4))
def test_scan_equals_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        html = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 24)))
        assert blocks.find(html) == by_patterns(html), html


@pytest.mark.parametrize("html", ["<p>", "<figure>", "<div>", "<div><svg>", "<img ", "<p ", "<svg><image ", "<td>x<td>", "<p>a</p", "<div> "])
def test_scan_is_linear_where_markup_is_left_open(html):
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        blocks.find(html * n)
        took.append(time.time() - began)
    assert took[1] < 10 and took[1] < 12 * took[0] + 0.5


def test_a_very_long_text_is_annotated_once():
    html = "<p>word</p>" * 20_000
    began = time.time()
    assert blocks.annotate(html, "s").count("data-block-id") == 20_000 and time.time() - began < 10
