"""Arithmetic of pages, swipes and scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VELOCITY = 0.5


def swipe(start_page: Column, current_page: Column, total_pages: Column, velocity: Column, spine_index: Column, total_spines: Column) -> Column:
    """struct<action, page>: what a swipe does. Only velocities beyond the threshold turn a page."""
    last = F.greatest(F.lit(0), total_pages - 1)
    snap = lambda page: F.struct(F.lit("snap").alias("action"), page.cast("int").alias("page"))
    act = lambda name: F.struct(F.lit(name).alias("action"), F.lit(None).cast("int").alias("page"))
    forward = F.when(start_page < last, snap(F.least(start_page + 1, last))).when(spine_index < total_spines - 1, act("transition_forward")).otherwise(act("bounce"))
    backward = F.when(start_page > 0, snap(F.greatest(start_page - 1, F.lit(0)))).when(spine_index > 0, act("transition_backward")).otherwise(act("bounce"))
    return F.when(velocity > VELOCITY, forward).when(velocity < -VELOCITY, backward).otherwise(snap(F.greatest(F.lit(0), F.least(current_page, last))))


def page_count(content: Column, page: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(content / page)).cast("int")


def current_page(offset: Column, page: Column, pages: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.round(offset / page), pages - 1)).cast("int")


def scrub_value(page: Column, total: Column) -> Column:
    """A global page's place on the scrubber, 0 to 1."""
    return (page - 1) / F.greatest(F.lit(1), total - 1)


def scrub_page(value: Column, total: Column) -> Column:
    return (F.round(value * (total - 1)) + 1).cast("int")


def position_percent(ordinal: Column, total: Column) -> Column:
    return F.round((ordinal + 1) / total * 100).cast("int")
