"""Connected components of a link table by alternating star contractions.

Each round is two aggregations and two joins over the links; nothing is gathered on the
driver but a count and a checksum. The number of rounds grows with the logarithm of the
longest path; operators here hand in stars, which take two or three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node that can be reached.

    Null ends, links from a node to itself and repeated links change nothing; no links, no rows.
    A node with very many links is met by Spark's splitting of skewed joins; neighbours are never gathered in a list.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        # large star: a node's larger neighbours link to its smallest
        both = edges.union(edges.select("b", "a"))
        # written, so that the join has two plain sides and Spark can split a node with very many links
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = materialise(kept.where("a <> b").distinct(), "links")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
