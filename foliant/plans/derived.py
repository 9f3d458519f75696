"""Columns that the parquet tables lack, derived from those that they have, as SQL that both engines read; `$name` stands for a table.

Order lines are sections of books: an order is a book, and books share the ids of their sections.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LINES = "(SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM $lineitem GROUP BY l_orderkey, l_linenumber)"
_HEAD = "replace(substring(text, 1, 30), chr(10), ' ')"
_DAY = "('' || CAST(o_orderdate AS DATE))"

DERIVED = {
    "css": "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'p { margin-left: ' || p_size || '%; }' WHEN 1 THEN 'p { margin: 1.25em ' || p_size || '%; }' WHEN 2 THEN 'div { padding: 0 ' || p_size || '% 2em; width: ' || p_size || '%; }' WHEN 3 THEN 'a { Padding-Left: 5%; MARGIN-RIGHT:' || p_size || '%; }' ELSE 'b { color: red }' END AS css FROM $part",
    "boxes": f"SELECT o AS view_id, 'x' || n AS block_id, n * 20 + s % 7 AS y0, n * 20 + 5 + p % 40 AS y1, o % 90 AS view_top, o % 90 + 60 AS view_bottom FROM {_LINES} l",
    "spine": f"SELECT 'b' || o AS book_id, n AS pos, CASE WHEN p % 9 = 0 THEN 'gone' ELSE 'c' || n END AS idref FROM {_LINES} l",
    "manifest": f"SELECT 'b' || o AS book_id, 'c' || n AS id, CASE s % 3 WHEN 0 THEN 'OPS/ch' || n || '.xhtml' WHEN 1 THEN 'OPS/text/ch' || n || '.xhtml' ELSE 'OPS/img/p' || n || '.jpg' END AS href, CASE s % 3 WHEN 2 THEN 'image/jpeg' ELSE 'application/xhtml+xml' END AS media_type FROM {_LINES} l",
    "points": f"SELECT 'b' || o AS book_id, n AS ord, 'Part ' || n || ' of ' || p AS label, CASE p % 4 WHEN 0 THEN 'ch' || n || '.xhtml' WHEN 1 THEN 'text/ch' || n || '.xhtml#a' WHEN 2 THEN 'ch' || (n % 3 + 1) || '.xhtml#b' ELSE 'x' || n || '.xhtml' END AS src FROM {_LINES} l",
    "sections": f"SELECT 'b' || o AS book_id, 's' || n AS spine_item_id, CASE WHEN n % 3 > 0 THEN 'Title ' || s END AS title, CASE WHEN p % 2 = 0 THEN 'Label ' || p END AS ncx_label FROM {_LINES} l",
    "places": f"SELECT 'b' || o AS book_id, 's' || n AS chapter_id, n * 5 % 8 AS place FROM {_LINES} l",
    "chapter_requests": "SELECT 'b' || o_orderkey AS book_id, CASE o_custkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 's2' WHEN 2 THEN 's' || o_custkey % 9 WHEN 3 THEN 'chapter ii' ELSE '2' END AS chapter_id, 's1' AS current_id FROM $orders",
    "stored_summaries": f"SELECT 'b' || o AS book_id, 's' || n AS chapter_id, 'Part ' || p || ' goes.' AS summary, 'a' || s || ';b' AS key_points, CASE WHEN s % 3 = 0 THEN 'Ann' END AS characters FROM {_LINES} l WHERE p % 2 = 0",
    "requests": f"SELECT 'b' || o AS book_id, CASE p % 5 WHEN 0 THEN 'OPS/img/p' || n || '.jpg' WHEN 1 THEN 'p' || n || '.jpg' WHEN 2 THEN 'img/p' || n || '.jpg' WHEN 3 THEN 'none' || n || '.gif' ELSE 'fig' || n || '.svg' END AS request FROM {_LINES} l",
    "files": f"SELECT 'b' || o AS book_id, CASE s % 4 WHEN 0 THEN 'OPS/img/p' || n || '.jpg' WHEN 1 THEN 'OPS/p' || n || '.jpg' WHEN 2 THEN 'x/fig' || n || '.svg' ELSE 'OPS/cover' || n || '.png' END AS path FROM {_LINES} l",
    "anchors": f"SELECT 'b' || o AS book_id, CASE p % 5 WHEN 0 THEN 'ch' || n || '.xhtml' WHEN 1 THEN 'text/ch' || (n % 4 + 1) || '.xhtml#n' || s WHEN 2 THEN '#top' WHEN 3 THEN 'https://example.org/ch1.xhtml' ELSE 'other.xhtml' END AS link FROM {_LINES} l",
    "found": "SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || p_partkey % 50 AS title, 'f' || p_partkey || '.epub' AS file_path FROM $part",
    "owned": "SELECT p_name || p_partkey % 50 AS title FROM $part WHERE p_partkey % 7 = 0",
    "library": "SELECT 'b' || o_orderkey AS book_id, o_orderpriority || ' ' || o_custkey AS title, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS last_opened_ts, o_orderdate AS import_ts FROM $orders",
    "stored_synopses": "SELECT 'b' || o_orderkey AS book_id, 'Worth ' || o_orderstatus || '.' AS synopsis, CASE WHEN o_custkey % 2 = 0 THEN 'Emma' END AS characters, 'love;' || o_orderpriority AS themes FROM $orders WHERE o_orderkey % 3 = 0",
    "cfis": "SELECT doc_id AS id, CASE doc_id % 11 WHEN 0 THEN 'epubcfi(/6/' || doc_id % 40 * 2 || '[ch' || doc_id || ']!)' WHEN 1 THEN 'epubcfi(/6/' || (doc_id % 40 + 1) * 2 || '!)' WHEN 2 THEN 'epubcfi(/6/2!/4/' || doc_id % 30 || ')' WHEN 3 THEN 'epubcfi(/6/4[ch02]!/4/2/1:' || n_chars || ')' WHEN 4 THEN 'epubcfi(/6/8[' || source || ']!/4/2)' WHEN 5 THEN 'epubcfi(/6/' || doc_id || '!)' WHEN 6 THEN 'epubcfi(/5/4!)' WHEN 7 THEN source WHEN 8 THEN 'epubcfi(/6/4!) tail' WHEN 9 THEN 'epubcfi(/6/0!)' ELSE 'epubcfi(/6/6[a]!/4[id]/' || doc_id % 12 || ':x)' END AS cfi FROM $documents",
    "markdown": f"SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '# ' || {_HEAD} WHEN 1 THEN 'a' || chr(10) || '## ' || {_HEAD} || chr(10) || 'b' WHEN 2 THEN '####### ' || {_HEAD} ELSE {_HEAD} || ' # here' END AS text FROM $documents",
    "addresses": "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS road, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS city, CASE WHEN c_custkey % 5 < 3 THEN 'T' || c_custkey END AS town, CASE WHEN c_custkey % 7 = 0 THEN 'V' END AS village, CASE WHEN c_custkey % 2 = 0 THEN 'S' || c_nationkey END AS state, CASE WHEN c_custkey % 4 = 0 THEN 'UK' END AS country, 'at ' || c_name AS name FROM $customer",
    "summaries": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'SUMMARY: Order ' || o_orderkey || '.' || chr(10) || 'It goes on.' || chr(10) || chr(10) || 'KEY_POINTS:' || chr(10) || '- first ' || o_custkey || chr(10) || '-second' || chr(10) || 'no point' || chr(10) || 'CHARACTERS: Ann, Bob ,, C' || o_custkey WHEN 1 THEN 'free text ' || o_orderpriority ELSE 'summary:' || chr(10) || ' ' || o_orderstatus || ' ' || chr(10) || 'KEY POINTS:' || chr(10) || '- p' || o_custkey || chr(10) || 'CHARACTERS:' || chr(10) || 'Dee' END AS reply FROM $orders",
    "synopses": "SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'SYNOPSIS: All of ' || o_orderkey || '.' || chr(10) || 'More.' || chr(10) || 'CHARACTERS:' || chr(10) || '- Ann: the heroine: ' || o_custkey || chr(10) || '- Bob' || chr(10) || '- : none' || chr(10) || 'THEMES:' || chr(10) || '- ' || o_orderpriority || chr(10) || '- ' ELSE 'nothing in ' || o_orderkey END AS reply FROM $orders",
    "pictures": f"SELECT 'b' || o AS book_id, n AS id, CASE s % 3 WHEN 0 THEN 'OPS/text' WHEN 1 THEN '' ELSE 'OPS' END AS base_path, CASE p % 3 WHEN 0 THEN '<p><img alt=\"a\" src=\"../img/p' || n || '.jpg\"/>x<img src=\"none.png\"></p>' WHEN 1 THEN '<IMG SRC=\"fig' || n || '.svg\">' ELSE '<img src=\"img/p' || n || '.jpg\" width=\"3\"> and <b>text</b>' END AS html FROM {_LINES} l",
    "styled": f"SELECT 'b' || o AS book_id, 's' || n AS spine_item_id, CASE WHEN s % 2 = 0 THEN 'OPS' ELSE '' END AS base_path, CASE p % 4 WHEN 0 THEN '<link rel=\"stylesheet\" href=\"a' || n || '.css\"/><LINK href=\"x/b' || (n % 4 + 1) || '.css\">' WHEN 1 THEN '<link href=\"OPS/a' || n || '.css\">' WHEN 2 THEN '<link href=\"gone.css\"><link href=\"q/c' || (n % 3 + 1) || '.css\">' ELSE '<p>none</p>' END AS html FROM {_LINES} l",
    "styles": f"SELECT 'b' || o AS book_id, CASE s % 4 WHEN 0 THEN 'OPS/a' || n || '.css' WHEN 1 THEN 'OPS/x/b' || n || '.css' WHEN 2 THEN 'lib/c' || n || '.css' ELSE 'other/c' || n % 2 || '.css' END AS path, 'p {{ width: ' || p || ' }}' AS css FROM {_LINES} l",
    "asked_conversations": "SELECT 'c' || o_orderkey AS conv_id, o_orderpriority AS book_title, o_orderdate AS updated_ts FROM $orders",
    "tool_calls": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '{"query": "order ' || o_custkey || '", "scope": "full_book", "limit": ' || o_custkey % 9 || '}' WHEN 1 THEN '{"query": null}' WHEN 2 THEN '[1, ' || o_custkey || ']' WHEN 3 THEN 'no json ' || o_custkey WHEN 4 THEN '' ELSE '{"scope": "current_chapter", "query": "' || o_orderpriority || '"}' END AS arguments FROM $orders""",
    "times": f"SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN {_DAY} || 'T07:08:09Z' WHEN 1 THEN {_DAY} || 'T07:08:09.250Z' WHEN 2 THEN {_DAY} || 'T09:08:09+02:00' WHEN 3 THEN {_DAY} WHEN 4 THEN 'soon' ELSE substring({_DAY}, 1, 4) || '-02-31T00:00:00Z' END AS t FROM $orders",
    "encyclopedia": """SELECT p_name || ' ' || p_partkey AS query, CASE p_partkey % 5 WHEN 3 THEN 404 WHEN 4 THEN 500 ELSE 200 END AS status, CASE p_partkey % 5 WHEN 0 THEN '{"title": "' || p_name || '", "description": "' || p_type || '", "extract": "Of size ' || p_size || '.", "thumbnail": {"source": "t' || p_partkey || '.jpg", "width": 1}, "content_urls": {"desktop": {"page": "http://e.org/' || p_partkey || '"}}}' WHEN 1 THEN '{"title": "' || p_name || '", "extract": "' || p_brand || '", "originalimage": {"source": "o.jpg"}}' WHEN 2 THEN '{"title": "none"}' ELSE '{}' END AS body FROM $part""",
    "encyclopedia_search": """SELECT p_name || ' ' || p_partkey AS query, CASE p_partkey % 4 WHEN 3 THEN 500 ELSE 200 END AS status, CASE WHEN p_partkey % 3 = 0 THEN '{"query": {"search": []}}' ELSE '{"query": {"search": [{"pageid": 1, "title": "' || p_name || '", "snippet": "the <b>' || p_type || '</b> is"}, {"pageid": 2, "title": "' || p_brand || '", "snippet": "size ' || p_size || '"}]}}' END AS body FROM $part""",
    "place_search": """SELECT c_name AS query, CASE WHEN c_custkey % 6 = 5 THEN 500 ELSE 200 END AS status, CASE WHEN c_custkey % 2 = 0 THEN '[{"place_id": 1, "lat": "' || c_custkey % 90 || '.5", "lon": "-2.36", "display_name": "' || c_name || ', Somerset, UK", "type": "city", "address": {"city": "' || c_mktsegment || '", "state": "Somerset", "country": "UK"}}, {"place_id": 2, "lat": "x", "lon": "1", "display_name": "Nowhere", "type": "none"}]' ELSE '{"place_id": 3, "lat": "51.4", "lon": "-' || c_custkey % 7 || '", "display_name": "A road, ' || c_name || '", "name": "' || c_mktsegment || '"}' END AS body FROM $customer""",
    "swipes": f"SELECT o AS id, n - 2 AS start_page, p % 6 - 1 AS current_page, s % 3 * 2 AS total_pages, CAST((p % 5 - 2) * 0.5 AS DOUBLE) AS velocity, o % 3 AS spine_index, o % 2 * 2 + 1 AS total_spines FROM {_LINES} l",
}


def in_duckdb(name: str) -> str:
    """The SQL of a derived table, over tables of their own names."""
    return re.sub(r"\$(\w+)", r"\1", DERIVED[name])


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table of the tables in a folder."""
    return spark.sql(re.sub(r"\$(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", DERIVED[name]))
