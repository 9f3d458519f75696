"""Attributes by the HTML grammar, links in normalised text, deep containers."""

import random
import re
import time

from foliant.llm import html


def tag_end(s, at):
    """The end of the tag whose attributes begin at `at`, one character at a time, and its attributes; a value whose quote nothing closes ends like a bare one."""
    found, state, name, value, quote = [], "between", "", "", ""
    while at < len(s):
        c = s[at]
        if state == "between":
            if c == ">":
                return at + 1, found
            if c not in " \t\n\f\r/":
                state, name = "name", c
        elif state == "name":
            if c in " \t\n\f\r/>":
                rest = re.match(r"[ \t\n\f\r]*=", s[at:])
                if c not in "/>" and rest:
                    at += rest.end() - 1
                    state = "before"
                else:
                    found.append((name, ""))
                    state = "between"
                    continue
            elif c == "=":
                state = "before"
            else:
                name += c
        elif state == "before":
            if c in " \t\n\f\r":
                pass
            elif c in "\"'" and c in s[at + 1 :]:
                state, quote, value = "quoted", c, ""
            elif c == ">":
                found.append((name, ""))
                return at + 1, found
            else:
                state, value = "bare", c
        elif state == "quoted":
            if c == quote:
                found.append((name, value))
                state = "between"
            else:
                value += c
        elif state == "bare":
            if c in " \t\n\f\r>":
                found.append((name, value))
                state = "between"
                continue
            value += c
        at += 1
    return len(s), found


def test_random_attributes_against_a_slow_parser():
    rng = random.Random(1)
    for _ in range(4000):
        source = "<p " + "".join(rng.choice(["a", "id", "=", " ", '"', "'", ">", "/", "\n", "é", "x=y ", 'b="c" ', "d='e' "]) for _ in range(rng.randrange(1, 14))) + ">after"
        end, found = tag_end(source, 2)
        m = html.TOKEN.match(source)
        assert m[2] == "p" and (m.end() == end or m[4] is not None), source
        got = [(n, "".join(v)) for n, *v in html.ATTRIBUTE.findall(m[3]) if n]
        assert got == found, source


def text(source):
    return html.extract(html.Page(source), html.Template([]))


def test_quotes_keep_the_text():
    assert text("<p title=l'eau>First paragraph</p><p>it's second</p><p>third</p>") == "First paragraph\nit's second\nthird"
    assert text('<p title="x>First</p><p>second</p>') == "First\nsecond"
    assert text("<p a='1>2' b=\"3>4\" c=5 d>only</p>") == "only"
    read = html.Page('<div data-class="nav">kept</div><div class=nav>menu</div><section title=\'class="nav"\'>kept too</section>')
    assert [(html.is_boiler(path), block) for path, block, _ in read.blocks] == [(False, "kept"), (True, "menu"), (False, "kept too")]


def test_links_are_measured_in_normalised_text():
    page = html.Page("<p>Read <a href=x>\n      the &amp; <b>whole</b> report\n    </a> today</p><p><a>One</a> <a> two  three </a></p><p>a<a> b </a></p>")
    assert page.blocks == [("", "Read the & whole report today", 18), ("", "One two three", 12), ("", "a b", 1)]


def test_blocks_that_are_links_alone_stay(spark):
    rows = [(i, "http://h.org/", f"<p>Read <b>number {i}</b> of the story, which is long enough.</p><p><a href=r>The whole report {i}</a></p>") for i in range(6)]
    rows += [(9, "http://h.org/", "<div><p>alone</p></div>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Read number {i} of the story, which is long enough.\nThe whole report {i}" for i in range(6))


def test_menus_at_any_depth(spark):
    for depth in (3, 63, 64, 65, 1000):
        inner = "<div>" * depth + "<nav><div>menu</div></nav><section class=comments>said</section>story" + "</div>" * depth
        read = html.Page(f"<body>{inner}<p>end</p></body>")
        assert [(html.is_boiler(path), block) for path, block, _ in read.blocks] == [(True, "menu"), (True, "said"), (False, "story"), (False, "end")]
        read = html.Page("<body><nav>" + "<div>" * depth + "deep menu" + "</div>" * depth + "</nav><p>end</p></body>")
        assert [(html.is_boiler(path), block) for path, block, _ in read.blocks] == [(True, "deep menu"), (False, "end")]
        rows = [(i, "http://h.org/", f"<body><div class=top>{inner.replace('story', f'the long story number {i} is told here')}</div><p>end</p></body>") for i in range(2)]
        if depth in (65, 1000):
            got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
            assert all("the long story" in t and "menu" not in t for t in got.values()), got
    began = time.time()
    assert text("<div>" * 50_000 + "x") == "x" and time.time() - began < 20
