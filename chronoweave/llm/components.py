"""Connected components of a link table, by rounds of star contraction; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, tag: str = "cc") -> DataFrame:
    """links: (a long, b long). Returns (node, component), component the smallest node reachable, for every node of a link.

    Alternating large and small stars. Each round is a written table, so a lost executor costs one round. Nulls and
    loops are ignored, repeated links are harmless, and an empty table gives an empty one.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = materialize(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    known = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), tag)
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(edges)
        edges = after
        if (state["n"], state["h"]) == known:
            break
        known = (state["n"], state["h"])
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
