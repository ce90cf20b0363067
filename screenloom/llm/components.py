"""Connected components of a link table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that a link touches; root is the smallest node reachable.

    ``links`` has the long columns a and b; repeats, both directions, self links and nulls may occur
    (self links and nulls say nothing and go).  No links give no rows.  Each round turns the links
    into fewer, flatter stars, so the rounds grow with the logarithm of the node count; each is
    written to the shared folder, which cuts the lineage.  A hub is only ever aggregated with
    map-side combine and joined as the many side.
    """
    edges = stored(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = _print_of(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = _print_of(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _print_of(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal link sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least).distinct()
