"""Connected components by alternating stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import stage


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns node and component (its smallest node) for each node that occurs in a link.

    Each round lets every node point its neighbours at the smallest one it knows (a large star, then a small
    star), so the longest path about halves. Minima are pre-aggregated; the joins that spread them may be split by
    Spark where one node has very many links. Rounds are written to the shared folder. Self-links and links with a
    null end are ignored; a table without links gives no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")) \
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = stage(edges, "links")
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .distinct()
        large = stage(large, "links")
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(roots).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(edges.select(F.col("v"), F.col("v")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """No centre is a leaf as well, and no leaf has two centres: then each star is a whole component."""
    if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").count().where("count > 1").isEmpty()
