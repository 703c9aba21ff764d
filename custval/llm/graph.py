"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custval.session import materialize


def components(links: DataFrame) -> DataFrame:
    """Components of the links (u, v): one row (node, component) per linked node, component = its smallest node.

    Alternating large-star and small-star steps: each is one partial aggregate
    (the smallest neighbour of every node) and one join with the links, so a
    node with very many links is split by the join's skew handling and never
    gathered.  Each round is written to the shared checkpoint folder.  Ids are
    any ordered type; null ends and self links are ignored.
    """
    ordered = links.where("u < v or v < u").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ordered = materialize(ordered, "links")
    before = None
    while True:
        both = ordered.union(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        ordered = materialize(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        state = ordered.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    # a star for each component: every node but the smallest points to it
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        ordered.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
