"""Connected components of a link table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """Every pair with the least neighbour of its first end (itself included)."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return pairs.join(least, F.col("a") == F.col("of")).select("a", "b", "m")


def connected(links: DataFrame) -> DataFrame:
    """``id, label`` of every id in ``links`` (``a``, ``b``, longs): the least id it is connected with.

    Each round replaces links by links to the least neighbour, first for larger, then for smaller
    neighbours; after a logarithmic number of rounds only stars are left. Rounds are tables in the
    shared folder. Loops and repeated links do no harm; no links give no rows.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(large.where(F.col("a") != F.col("b")).distinct(), "links")
        small = _stars(down)
        shorter = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where(F.col("a") != F.col("b"))
            .distinct(),
            "links",
        )
        release(edges, down)
        edges = shorter
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        seen = state
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    centres = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return stars.unionByName(centres)
