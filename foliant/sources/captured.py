"""Captured replies of public lookup services, as tables: nothing is asked for over a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_address

SUMMARY = "title string, description string, extract string, thumbnail struct<source:string>, originalimage struct<source:string>, content_urls struct<desktop:struct<page:string>>"
HITS = "query struct<search:array<struct<pageid:long,title:string,snippet:string>>>"
PLACE = "place_id long, lat string, lon string, display_name string, name string, type string, address struct<road:string,city:string,town:string,village:string,state:string,country:string>"


def outcome(status: Column, parsed: Column) -> Column:
    """found, not_found (404), http_error (no other 2xx), or invalid for a reply that cannot be read."""
    return F.when(status == 404, "not_found").when(~status.between(200, 299) | status.isNull(), "http_error").when(parsed.isNull(), "invalid").otherwise("found")


def summaries(replies: DataFrame) -> DataFrame:
    """query, outcome, title, description, extract, image and page of encyclopedia summaries (query, status, body)."""
    read = replies.select("query", "status", F.from_json("body", SUMMARY).alias("s")).withColumn("outcome", outcome(F.col("status"), F.concat("s.title", "s.extract")))
    field = lambda c: F.when(F.col("outcome") == "found", F.col(c))
    return read.select("query", "outcome", *[field(f"s.{c}").alias(c) for c in ("title", "description", "extract")], F.coalesce(field("s.thumbnail.source"), field("s.originalimage.source")).alias("image"), field("s.content_urls.desktop.page").alias("page"))


def search_hits(replies: DataFrame) -> DataFrame:
    """query, rank, title and snippet without markup, of encyclopedia searches (query, status, body); replies that are not 2xx or cannot be read have no rows."""
    read = replies.where(F.col("status").between(200, 299)).select("query", F.posexplode(F.from_json("body", HITS)["query"]["search"]).alias("at", "hit"))
    return read.select("query", (F.col("at") + 1).alias("rank"), F.col("hit.title").alias("title"), F.regexp_replace("hit.snippet", "<[^>]+>", "").alias("snippet"))


def places(replies: DataFrame) -> DataFrame:
    """query, rank, lat, lon, name and address of place searches (query, status, body): a list of places, or one place, as a reverse lookup gives it.

    The first is what geocoding takes. Places without numbers for both coordinates are left out.
    """
    one = F.from_json("body", PLACE)
    many = F.from_json("body", f"array<struct<{PLACE.replace(' struct', ':struct').replace(' string', ':string').replace(' long', ':long').replace(', ', ',')}>>")
    listed = F.when(F.ltrim("body").startswith("["), many).otherwise(F.array(one))
    read = replies.where(F.col("status").between(200, 299)).select("query", F.posexplode(listed).alias("at", "p"))
    address = short_address(*[F.col(f"p.address.{c}") for c in ("road", "city", "town", "village", "state", "country")], F.col("p.display_name"))
    lat, lon = (F.expr(f"try_cast(p.{c} as double)") for c in ("lat", "lon"))
    known = read.select("query", (F.col("at") + 1).alias("rank"), lat.alias("lat"), lon.alias("lon"), F.coalesce("p.name", F.element_at(F.split("p.display_name", ","), 1)).alias("name"), address.alias("address"))
    return known.where("lat is not null and lon is not null")
