"""Components of undirected links, for any number of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Tables


def least_members(links: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, node, least: the smallest node of the component of each linked node; links join nodes of the same keys.

    Each round, every node's larger neighbours and the node move to its smallest neighbour, and then its smaller ones; it ends
    when nothing moves, after about log N rounds. Only links cross the shuffle, pre-aggregated, and a round's tables replace the last one's.
    Links compress to small files, so joins are told not to broadcast them.
    """
    tables = Tables(links.sparkSession)
    edges = tables.save(links.where(F.col(a) != F.col(b)).select(*keys, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = tables.save(both.join(least.hint("merge"), [*keys, "u"]).where("v > u and v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = up.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        moved = up.join(least.hint("merge"), [*keys, "u"]).where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        new = tables.save(moved.unionByName(least.select(*keys, "u", F.col("m").alias("v"))).distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        tables.drop(edges, up)
        edges = new
        if now == mark:
            return edges.select(*keys, F.col("u").alias("node"), F.col("v").alias("least"))
        mark = now
