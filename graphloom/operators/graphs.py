"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.store import keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every end of an edge; a component is named by its smallest id.

    Self-loops name a single node; null ends are ignored; an empty table gives none.  Every round aggregates minima before the
    shuffle, shrinks paths to stars and cuts the lineage, until nothing is left to join; rounds grow with the logarithm of the longest
    path.  Ids may be of any type that has an order.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    state = keep(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = state.select(F.col("u").alias("id")).unionByName(state.select(F.col("v").alias("id"))).distinct()
    state = state.where("u <> v")
    while True:
        # Large star: larger neighbours move to the least id around u.
        around = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u and u itself move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # A forest of stars: every u points once, at a node that points nowhere.
        chained = after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        state = after
        if not chained and state.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
    return nodes.join(state.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
