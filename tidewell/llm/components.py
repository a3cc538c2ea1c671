"""Connected components over a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialise


def _digest(edges: DataFrame):
    """Count and order-free hash sum of a link table; equal digests mean that it is stable."""
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return (both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v: link every smaller neighbour of a node to the least of them."""
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    moved = (edges.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """(node, root): every node that a link names except the roots, with the least node of its
    component.  Links of a node with itself and repeated links change nothing; no links give
    an empty result.

    Each round is two joins and two distinct steps on a table that never has more links than
    the first; rounds grow with the logarithm of the longest path.  Every round is written to
    the shared folder.  A node with very many links is one key of a plain join, which Spark
    splits (adaptive skew join), and of a map-side combined minimum.
    """
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = materialise(edges, label)
    before = _digest(edges)
    while before[0]:
        edges = materialise(_small_star(_large_star(edges)), label)
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
