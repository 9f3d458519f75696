"""Prefix sums over ranges against windows within a book."""

import random

import pytest

from foliant.operators import positions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    counts = [("one", i, rng.randrange(0, 9)) for i in range(300)] + [("two", i, 3) for i in range(20)] + [("none", 0, 0)]
    asked = [(b, p) for b in ("one", "two", "none", "gone") for p in (*range(-2, 70, 3), 5, 5, 5, 5, 1500, None)]
    places = [(b, i, rng.randrange(0, 5)) for b in ("one", "two", "gone") for i in (0, 1, 7, 19, 20, 299, 300, 999)]
    kinds = "book_id string, spine_index int, pages int", "book_id string, global_page long", "book_id string, spine_index int, local_page long"
    return [spark.createDataFrame(x, k).repartition(3) for x, k in zip((counts, asked, places), kinds, strict=True)]


def test_ranges_equal_windows(tables):
    counts, asked, places = tables
    for f, other in ((positions.local_position, asked), (positions.global_page, places), (positions.starting_page, places)):
        assert rows(f(counts, other, most=5)) == rows(f(counts, other)), f
    assert rows(positions.starts(counts, most=5)) == rows(positions.starts(counts))


def test_locations_over_ranges(tables):
    counts, asked, _ = tables
    sections = counts.selectExpr("book_id", "spine_index", "pages * 900 as length")
    bounds = positions.boundaries(sections)
    assert rows(positions.boundaries(sections, most=5)) == rows(bounds)
    wanted = asked.selectExpr("book_id", "global_page as location").where("location is not null")
    assert rows(positions.spine_of_location(bounds, wanted, most=5)) == rows(positions.spine_of_location(bounds, wanted))


def test_a_book_of_all_rows_is_many_ranges(tables):
    counts, _, _ = tables
    dealt = positions._ranges(counts.where("book_id = 'one'"), ["spine_index"], 5)
    assert dealt.select("__range").distinct().count() > 2 and positions._ranges(counts, ["spine_index"], 1000) is None
