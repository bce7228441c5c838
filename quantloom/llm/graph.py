"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.base import prepare


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link to another node; root is the smallest node reachable.

    Nodes are of one orderable type. Each round is two joins on node keys, so a hot node's rows are split by
    the engine's skew handling, and each round is cut by checkpoint() into the shared folder: a lost executor
    costs one round at most. Null ends and self links are ignored; an empty table gives an empty result.
    """
    prepare(links.sparkSession)
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct().checkpoint()
    last = _signature(edges)
    while last[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = down.union(lowest.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = _signature(edges)
        if now == last:
            break
        last = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select("v", "v").distinct())
