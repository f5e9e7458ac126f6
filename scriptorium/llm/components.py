"""Connected components of a table of links, by large-star and small-star rounds.

Links never go to the driver; each round is two aggregations and two joins over
the links, written to the shared folder, and the number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, forget, stash


def _large_star(links: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours with the smallest of its neighbours and itself."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours with the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, space: Workspace | None = None) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    `links` has columns a and b (long); links of a node with itself are ignored.
    The last round's table goes into `space`, to be deleted with the caller's own.
    """
    now = stash(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        after = stash(_small_star(_large_star(now)), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if mark == seen:
            break
        seen = mark
    if space is not None:
        space.tables.append(now)
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
