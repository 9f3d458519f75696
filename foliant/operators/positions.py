"""Pages and locations by prefix sums.

Within a book they run over its sections in order. Books of up to BOOK rows are windows; with a larger one all rows are sorted into ranges, each range is summed up
by itself, and what the ranges before it come to is carried in, so one book of all rows is as many tasks as there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import small, written

LOCATION = 1024
#: Rows of a book that one task takes in a window.
BOOK = 1_000_000


def _ranges(rows: DataFrame, order: list[str | Column], most: int) -> DataFrame | None:
    """rows sorted by book and order into ranges, their number in __range; None if no book has over `most` rows."""
    n, top = rows.groupBy("book_id").count().agg(F.sum("count"), F.max("count")).first()
    if not n or top <= most:
        return None
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // most))
    dealt = rows.repartitionByRange(parts, "book_id", *order).sortWithinPartitions("book_id", *order)
    return written(dealt.withColumn("__range", F.spark_partition_id()), "ranges")


def _sum_before(rows: DataFrame, value: str, name: str, most: int) -> DataFrame:
    """rows (book_id, spine_index, ...) with the sum of a column over the sections before each in its book."""
    dealt = _ranges(rows, ["spine_index"], most)
    if dealt is None:
        before = Window.partitionBy("book_id").orderBy("spine_index").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    totals = dealt.groupBy("book_id", "__range").agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy("book_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("book_id", "__range", F.sum("__total").over(earlier).alias("__carried")).where("__carried is not null")  # at most one a range
    own = Window.partitionBy("book_id", "__range").orderBy("spine_index").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(small(carried), ["book_id", "__range"], "left")
    return summed.select(*rows.columns, (F.col("__own") + F.coalesce("__carried", F.lit(0))).alias(name))


def starts(counts: DataFrame, most: int = BOOK) -> DataFrame:
    """counts (book_id, spine_index, pages) with first_page, the section's first page in the book."""
    return _sum_before(counts, "pages", "first_page", most).withColumn("first_page", F.col("first_page") + 1)


def global_page(counts: DataFrame, places: DataFrame, most: int = BOOK) -> DataFrame:
    """global_page of places (book_id, spine_index, local_page); 1 for a section that the book lacks."""
    joined = places.join(starts(counts, most), ["book_id", "spine_index"], "left")
    return joined.select(*places.columns, F.coalesce(F.col("first_page") + F.col("local_page"), F.lit(1)).alias("global_page"))


def starting_page(counts: DataFrame, places: DataFrame, most: int = BOOK) -> DataFrame:
    """starting_page of places (book_id, spine_index); one past the last section counts, anything else is 1."""
    total = counts.groupBy("book_id").agg(F.count("*").alias("__n"), F.sum("pages").alias("__all"))
    joined = places.join(starts(counts, most), ["book_id", "spine_index"], "left").join(total, "book_id", "left")
    page = F.when((F.col("spine_index") <= 0) | (F.col("spine_index") > F.col("__n")), 1).when(F.col("spine_index") == F.col("__n"), F.col("__all") + 1).otherwise(F.col("first_page"))
    return joined.select(*places.columns, F.coalesce(page, F.lit(1)).alias("starting_page"))


def _last_before(sections: DataFrame, at: str, columns: list[str], asked: DataFrame, place: str, most: int) -> DataFrame:
    """asked (book_id, place, ...) with __s, the columns of its book's last section that begins at or before the place, __any, whether the book has sections, and __end, its last section.

    Sections and requests are sorted together once, and nothing is gathered in a row.
    """
    one = sections.select("book_id", F.col(at).cast("long").alias("__at"), F.lit(0).alias("__kind"), F.struct(*columns).alias("__section"), F.lit(None).cast(asked.schema.simpleString()).alias("__row"))
    two = asked.select("book_id", F.col(place).cast("long").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(one.schema["__section"].dataType).alias("__section"), F.struct(*asked.columns).alias("__row"))
    order = [F.col("__at"), F.col("__kind"), F.col("__section.spine_index")]
    last = F.struct("__at", "__section.spine_index", "__section")
    section = F.when(F.col("__kind") == 0, last)
    both = one.union(two)
    # requests for one place have no order of their own; a hash of theirs lets ranges divide them
    dealt = _ranges(both.withColumn("__hash", F.when(F.col("__kind") == 1, F.xxhash64("__row"))), [*order, "__hash"], most)
    if dealt is None:
        book = Window.partitionBy("book_id")
        upto = book.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("__s", F.last("__section", ignorenulls=True).over(upto)).withColumn("__any", F.max(F.col("__kind") == 0).over(book)).withColumn("__end", F.max(section).over(book)["__section"])
        return found.where("__kind = 1").select("__row.*", "__s", "__any", "__end")
    totals = dealt.groupBy("book_id", "__range").agg(F.max(section).alias("__last"))
    earlier = Window.partitionBy("book_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("book_id", "__range", F.last("__last", ignorenulls=True).over(earlier)["__section"].alias("__carried")).where("__carried is not null")
    ends = totals.groupBy("book_id").agg(F.max("__last")["__section"].alias("__end"))
    upto = Window.partitionBy("book_id", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__own", F.last("__section", ignorenulls=True).over(upto)).where("__kind = 1").join(small(carried), ["book_id", "__range"], "left").join(small(ends), "book_id", "left")
    return found.select("__row.*", F.coalesce("__own", "__carried").alias("__s"), F.col("__end").isNotNull().alias("__any"), "__end")


def local_position(counts: DataFrame, pages: DataFrame, most: int = BOOK) -> DataFrame:
    """(spine_index, local_page) of pages (book_id, global_page): (0, 0) below 1, for a null page or an empty book; past the end the last page."""
    first = starts(counts, most).select("book_id", "spine_index", "first_page", "pages")
    found = _last_before(first, "first_page", ["first_page", "spine_index", "pages"], pages, "global_page", most)
    none = ~F.coalesce(F.col("__any"), F.lit(False)) | F.col("global_page").isNull() | (F.col("global_page") < 1)
    inside = F.col("global_page") < F.col("__s.first_page") + F.col("__s.pages")
    spine = F.when(none, 0).when(inside, F.col("__s.spine_index")).otherwise(F.col("__end.spine_index"))
    local = F.when(none, 0).when(inside, F.col("global_page") - F.col("__s.first_page")).otherwise(F.greatest(F.lit(0), F.col("__end.pages") - 1))
    return found.select(*pages.columns, spine.cast("int").alias("spine_index"), local.cast("long").alias("local_page"))


def locations(sections: DataFrame, size: int = LOCATION) -> DataFrame:
    """One row a location of sections (book_id, spine_index, length): char_offset is a multiple of `size`."""
    n = F.greatest(F.lit(1), F.floor(F.col("length") / size)).cast("int")
    return sections.select("book_id", "spine_index", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("book_id", "spine_index", "i", (F.col("i") * size).alias("char_offset"))


def boundaries(sections: DataFrame, size: int = LOCATION, most: int = BOOK) -> DataFrame:
    """The index of each section's first location in the book."""
    n = F.greatest(F.lit(1), F.floor(F.col("length") / size)).cast("int")
    return _sum_before(sections.select("book_id", "spine_index", n.alias("n")), "n", "boundary", most)


def spine_of_location(bounds: DataFrame, asked: DataFrame, most: int = BOOK) -> DataFrame:
    """The section with the greatest boundary up to each location (book_id, location); null before the first. Books without sections have no rows."""
    found = _last_before(bounds, "boundary", ["boundary", "spine_index"], asked.select("book_id", "location"), "location", most)
    return found.where("__any").select("book_id", "location", F.col("__s.spine_index").alias("spine_index"))


def visible_block(boxes: DataFrame, top: str = "view_top", bottom: str = "view_bottom") -> DataFrame:
    """The first block whose box overlaps each view, half open."""
    seen = boxes.where((F.col("y0") < F.col(bottom)) & (F.col("y1") > F.col(top)))
    return seen.groupBy("view_id").agg(F.min_by("block_id", F.struct("y0", "block_id")).alias("block_id"))
