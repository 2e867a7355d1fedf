"""Density and clustering over neighbour lists ``(gid, rank, nid, k)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.hashing import int_hash
from graphloom.functions.stats import grouped_order_statistic, product
from graphloom.operators.graphs import components
from graphloom.operators.lsh import shared_neighbours
from graphloom.store import keep


def local_density(neighbours: DataFrame, shared: bool = False) -> DataFrame:
    """``(gid, density, sd)``: mean product with the other neighbours, list size less one, and its deviation.

    With ``shared`` every product is weighted by the shared-neighbour similarity.  A list of one has null density.
    """
    rows = neighbours
    if shared:
        rows = rows.join(shared_neighbours(neighbours).select("gid", "nid", "similarity"), ["gid", "nid"]).withColumn("k", F.col("k") * F.col("similarity"))
    size = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    other = rows.where("gid <> nid").join(size, "gid")
    mean = other.groupBy("gid").agg(F.try_divide(F.sum("k"), F.first("n") - 1).alias("density"))
    spread = other.join(mean, "gid").groupBy("gid").agg(F.sqrt(F.try_divide(F.sum((F.col("k") - F.col("density")) * (F.col("k") - F.col("density"))), F.first("n") - 1)).alias("sd"))
    return mean.join(spread, "gid")


def sampled(ids: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    """About ``fraction`` of the ids, by hash; all of them at 1."""
    return ids if fraction >= 1 else ids.where(int_hash(F.col("gid"), seed) < int(fraction * (1 << 31)))


def densest(density: DataFrame, count: int = 20) -> DataFrame:
    """The ``count`` instances of highest density, ties by id."""
    return density.where("density is not null").orderBy(F.desc(F.round("density", 9)), "gid").limit(count)


def dense_centres(neighbours: DataFrame, density: DataFrame, count: int = 20, most_shared: int = 3, sample: float = 1.0) -> DataFrame:
    """``(centre, rank, members)``: centres by density, accepted while their neighbours meet the accepted ones' in at most ``most_shared``.

    At most ``count`` short lists reach one group.
    """
    top = densest(sampled(density, sample), count).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("density", 9)), "gid")))  # at most count rows
    lists = top.join(neighbours, "gid").groupBy("gid", top["rank"]).agg(F.sort_array(F.collect_set("nid")).alias("members"))

    def greedy(frame):
        seen: set[int] = set()
        keep_ = []
        frame = frame.sort_values("rank")
        for members in frame.members:
            ok = not keep_ or len(seen & set(members)) <= most_shared
            keep_.append(ok)
            if ok:
                seen |= set(members)
        return frame[keep_]

    rows = lists.select(F.col("gid").alias("centre"), "rank", "members")
    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda f: greedy(f).drop(columns="one"), "centre bigint, rank int, members array<bigint>")


def connected_centres(neighbours: DataFrame, density: DataFrame, count: int = 20, least_shared: int = 3) -> DataFrame:
    """``(cluster, members)``: centres joined where they share neighbours; every component of at least two gives its neighbourhoods' union."""
    top = keep(densest(density, count).select("gid"))
    lists = top.join(neighbours, "gid").select(F.col("gid").alias("centre"), "nid")
    met = lists.toDF("a", "nid").join(lists.toDF("b", "nid"), "nid").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_shared)
    groups = components(met)
    return groups.join(lists, groups["id"] == lists["centre"]).groupBy(F.col("component").alias("cluster")).agg(F.sort_array(F.collect_set("nid")).alias("members"))


def quick_shift_parents(neighbours: DataFrame, density: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``(gid, parent)``: the first neighbour of higher density, unless the step is too long for the spread; otherwise itself.

    Instances without a density of their own are their own parents.
    """
    own = density.select("gid", F.round("density", 9).alias("density"), "sd")
    far = own.select(F.col("gid").alias("nid"), F.col("density").alias("far"))
    higher = neighbours.join(own, "gid").join(far, "nid").where("far > density")
    first = higher.groupBy("gid").agg(F.min_by(F.struct("nid", "k", "density", "sd"), "rank").alias("p"))
    bar = F.try_divide(F.abs(F.col("p.k") - F.col("p.density")), F.col("p.sd")) > F.lit(1 / threshold)
    chosen = first.select("gid", F.when(F.coalesce(bar, F.lit(False)), F.col("p.nid")).alias("up"))
    return neighbours.select("gid").distinct().join(chosen, "gid", "left").select("gid", F.coalesce("up", "gid").alias("parent"))


def tree_roots(parents: DataFrame) -> DataFrame:
    """``(gid, root)`` by pointer jumping: the path halves in every round, until none is left.

    Parents must not form a circle of two or more, which has no root; those of ``quick_shift_parents`` rise in density and cannot.
    """
    state = keep(parents.select("gid", F.col("parent").alias("root")))
    while True:
        up = state.select(F.col("gid").alias("root"), F.col("root").alias("next"))
        after = keep(state.join(up, "root", "left").select("gid", F.coalesce("next", "root").alias("next"), "root"))
        moved = after.where("next <> root").limit(1).count()
        state = after.select("gid", F.col("next").alias("root"))
        if not moved:
            break
    return state


def quick_shift_clusters(neighbours: DataFrame, density: DataFrame, threshold: float = 1.0) -> DataFrame:
    """``(cluster, gid, weight)`` with each member's summed product with neighbours in its cluster, for ordering members."""
    roots = tree_roots(quick_shift_parents(neighbours, density, threshold))
    both = neighbours.join(roots, "gid").join(roots.toDF("nid", "other"), "nid")
    weight = both.where("root = other and gid <> nid").groupBy("gid").agg(F.sum("k").alias("weight"))
    return roots.join(weight, "gid", "left").select(F.col("root").alias("cluster"), "gid", F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))


def cluster_extension(clusters: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``(cluster, gid)`` of neighbours of members that are in another cluster or none."""
    near = clusters.select("cluster", "gid").join(neighbours.select("gid", "nid"), "gid").select("cluster", F.col("nid").alias("gid")).distinct()
    return near.join(clusters.select("cluster", "gid"), ["cluster", "gid"], "left_anti")


def voronoi_density(neighbours: DataFrame, products: DataFrame) -> DataFrame:
    """``(gid, p, log_p)``: 1 by the product, over an instance's neighbours, of their median distance 1 - k to the others, normalised.

    Distances of 0 are left out of the medians; a neighbour without any other distance counts 1.  ``products (gid_a, gid_b, k)``
    must hold the pairs of neighbours.
    """
    a = neighbours.select("gid", F.col("nid").alias("gid_a"))
    b = neighbours.select("gid", F.col("nid").alias("gid_b"))
    pairs = a.join(b, "gid").where("gid_a <> gid_b").join(products, ["gid_a", "gid_b"], "left").select("gid", "gid_a", F.round(1 - F.coalesce("k", F.lit(0.0)), 9).alias("d"))
    medians = grouped_order_statistic(pairs.where("d <> 0"), ["gid", "gid_a"], "d", {"m": 0.5})
    every = a.join(medians, ["gid", "gid_a"], "left").select("gid", F.abs(F.coalesce("m", F.lit(1.0))).alias("m"))
    volume = every.groupBy("gid").agg(product("m").alias("v"))
    inverse = volume.where("v > 0").select("gid", (1 / F.col("v")).alias("w"))
    total = inverse.agg(F.sum("w").alias("t"))
    return inverse.join(total, F.lit(True)).select("gid", (F.col("w") / F.col("t")).alias("p"), F.log(F.col("w") / F.col("t")).alias("log_p"))


def pre_cluster_filter(sizes: DataFrame, count: int = 10_000) -> DataFrame:
    """``(gid, score)``: instances whose median bucket size is among the ``count`` largest, ties kept.

    ``sizes (gid, slot, size)``; with no more than ``count`` instances all are kept.
    """
    scores = keep(grouped_order_statistic(sizes, ["gid"], "size", {"score": 0.5}))
    bar = scores.orderBy(F.desc("score")).limit(count).agg(F.min("score").alias("bar"))
    return scores.join(bar, F.lit(True)).where("score >= bar").select("gid", "score")


def label_spreading(neighbours: DataFrame, targets: DataFrame, alpha: float = 0.99, rounds: int = 3) -> DataFrame:
    """``(gid, f)``: f <- alpha S f + (1 - alpha) y, where S is the row-normalised neighbour matrix without self."""
    edges = neighbours.where("gid <> nid and k <> 0").select("gid", "nid", "k")
    total = edges.groupBy("gid").agg(F.sum("k").alias("t"))
    s = keep(edges.join(total, "gid").select("gid", "nid", F.try_divide("k", "t").alias("s")))
    every = neighbours.select("gid").distinct().join(targets.select("gid", "y").groupBy("gid").agg(F.max("y").alias("y")), "gid", "left").select("gid", F.coalesce("y", F.lit(0.0)).alias("y"))
    base = keep(every)
    f = base.withColumn("f", F.col("y"))
    for _ in range(rounds):
        pulled = s.join(f.select(F.col("gid").alias("nid"), "f"), "nid").groupBy("gid").agg(F.sum(F.col("s") * F.col("f")).alias("g"))
        f = keep(base.join(pulled, "gid", "left").select("gid", "y", (F.lit(alpha) * F.coalesce("g", F.lit(0.0)) + F.lit(1 - alpha) * F.col("y")).alias("f")))
    return f.select("gid", "f")
