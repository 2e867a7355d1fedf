"""Min-hash signatures, candidates and nearest neighbours as joins; large buckets are never self-joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.hashing import int_hash
from graphloom.operators.skew import unsent
from graphloom.operators.vectors_ops import dot_products
from graphloom.store import keep

#: Signature shape, bucket bound and candidate excess by default (fixed values).
FUNCTIONS, REPEATS, BUCKET, EXCESS, NEIGHBOURS = 400, 10, 1000, 5.0, 10


def signatures(features: DataFrame, functions: int = FUNCTIONS, repeats: int = REPEATS) -> DataFrame:
    """``(gid, slot, key)``: in each repeat a fid's hash falls in one of functions / repeats slots, which keeps the least.

    Values play no part.  A slot without a row is empty.
    """
    width = functions // repeats
    size = F.lit((1 << 31) // width)
    keyed = features.select("gid", "fid").distinct().select("gid", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("l"), "fid").withColumn("key", int_hash(F.col("fid"), F.col("l")))
    slot = F.least(F.floor(F.col("key") / size).cast("int"), F.lit(width - 1)) + (F.col("l") - 1) * width
    return keyed.groupBy("gid", slot.cast("int").alias("slot")).agg(F.min("key").alias("key"))


def fixed_minhash(features: DataFrame, functions: int) -> DataFrame:
    """``(gid, slot, key)`` by ``functions`` independent hashes."""
    keyed = features.select("gid", F.explode(F.sequence(F.lit(1), F.lit(functions))).alias("slot"), "fid")
    return keyed.groupBy("gid", "slot").agg(F.min(int_hash(F.col("fid"), F.col("slot"))).alias("key"))


def full_signatures(signed: DataFrame, functions: int = FUNCTIONS) -> DataFrame:
    """``(gid, signature)`` with every slot, empty ones as 2^31."""
    filled = signed.groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "key"))).alias("m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), lambda s: F.coalesce(F.col("m")[s], F.lit(1 << 31)))
    return filled.select("gid", slots.alias("signature"))


def index(signed: DataFrame, columns: DataFrame | None = None, most: int = BUCKET) -> DataFrame:
    """``(gid, slot, key)`` of the indexed instances in buckets of fewer than ``most``; key 0 is never indexed."""
    rows = signed.where("key <> 0")
    if columns is not None:
        rows = rows.join(columns.select("gid").distinct(), "gid", "left_semi").select("gid", "slot", "key")
    small = rows.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < most).select("slot", "key")
    return rows.join(unsent(small), ["slot", "key"], "left_semi").select("gid", "slot", "key")


def bucket_sizes(signed: DataFrame, indexed: DataFrame) -> DataFrame:
    """``(gid, slot, size)`` of the bucket that each slot of a signature meets, 0 if there is none."""
    counts = indexed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"))
    return signed.join(counts, ["slot", "key"], "left").select("gid", "slot", F.coalesce("n", F.lit(0)).alias("size"))


def candidates(rows: DataFrame, indexed: DataFrame, k: int = NEIGHBOURS, excess: float = EXCESS) -> DataFrame:
    """``(gid, nid, hits)``: instances met in at least two buckets, the k x excess most met, ties by id.

    With a non-positive excess all instances met in at least -excess buckets.
    """
    met = rows.select("gid", "slot", "key").join(unsent(indexed.withColumnRenamed("gid", "nid")), ["slot", "key"]).groupBy("gid", "nid").agg(F.count(F.lit(1)).alias("hits"))
    if excess <= 0:
        return met.where(F.col("hits") >= -excess)
    w = Window.partitionBy("gid").orderBy(F.desc("hits"), "nid")
    return met.where("hits >= 2").withColumn("r", F.row_number().over(w)).where(F.col("r") <= int(excess * k)).drop("r")


def top_k(products: DataFrame, k: int = NEIGHBOURS, digits: int = 9) -> DataFrame:
    """``(gid, rank, nid, k)`` of ``(gid_a, gid_b, k)``, by product, ties by id; the product is rounded before it is compared."""
    rounded = products.select(F.col("gid_a").alias("gid"), F.col("gid_b").alias("nid"), F.round("k", digits).alias("k"))
    w = Window.partitionBy("gid").orderBy(F.desc("k"), "nid")
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("gid", "rank", "nid", "k")


def _packed(features: DataFrame) -> DataFrame:
    rows = features.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("e"))
    return rows.select("gid", F.col("e.fid").alias("fids"), F.col("e.value").alias("vals"))


def exact_neighbours(rows: DataFrame, columns: DataFrame, k: int = NEIGHBOURS, digits: int = 9, block_rows: int = 2_000) -> DataFrame:
    """The k column instances of largest product for every row instance, itself included; products of 0 are left out.

    Blocks of rows meet blocks of columns as matrix products over slices of their features, and only the k best of each
    row leave a task: no pair is ever shuffled, however many instances share a feature.
    """
    import numpy as np
    import pandas as pd

    a, b = _packed(rows), _packed(columns)
    n, m = (max(1, -(-t.select("gid").distinct().count() // block_rows)) for t in (rows, columns))
    part = lambda count: F.pmod(F.xxhash64("gid"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = a.select(part(n).alias("i"), every(m).alias("j"), F.lit(True).alias("asks"), "gid", "fids", "vals")
    given = b.select(every(n).alias("i"), part(m).alias("j"), F.lit(False).alias("asks"), "gid", "fids", "vals")

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame[frame["asks"]], frame[~frame["asks"]].sort_values("gid")
        if not len(p) or not len(q):
            return pd.DataFrame({"gid_a": [], "gid_b": [], "k": []})
        flat = [(np.repeat(np.arange(len(t)), t["fids"].map(len)), np.concatenate(t["fids"].to_list()), np.concatenate(t["vals"].to_list())) for t in (p, q)]
        known = np.intersect1d(flat[0][1], flat[1][1])
        total = np.zeros((len(p), len(q)))
        for lo in range(0, len(known), 4096):
            slice_ = known[lo : lo + 4096]
            sides = []
            for (of, fid, val), size in zip(flat, total.shape):
                at = np.searchsorted(slice_, fid)
                ok = (at < len(slice_)) & (slice_[np.minimum(at, len(slice_) - 1)] == fid)
                dense = np.zeros((size, len(slice_)))
                dense[of[ok], at[ok]] = val[ok]
                sides.append(dense)
            total += sides[0] @ sides[1].T
        total = np.round(total, digits)
        near = np.argsort(-total, axis=1, kind="stable")[:, :k]  # equal products stay in order of id
        best = np.take_along_axis(total, near, 1)
        i, j = np.nonzero(best != 0)
        return pd.DataFrame({"gid_a": p["gid"].to_numpy()[i], "gid_b": q["gid"].to_numpy()[near[i, j]], "k": best[i, j]})

    found = asked.unionByName(given).groupBy("i", "j").applyInPandas(products, "gid_a bigint, gid_b bigint, k double")
    return top_k(found, k, digits)


def approximate_neighbours(rows: DataFrame, columns: DataFrame, k: int = NEIGHBOURS, functions: int = FUNCTIONS, repeats: int = REPEATS, most: int = BUCKET, excess: float = EXCESS, whole: bool = True) -> DataFrame:
    """Candidates by signature, then their exact products; no pair outside a bucket is met.

    Buckets of ``most`` instances or more are not self-joined.  Their instances meet each other exactly instead, block
    against block, so that they lose no neighbour; without ``whole`` such buckets are dropped.
    """
    signed, given = keep(signatures(rows, functions, repeats)), keep(signatures(columns, functions, repeats))
    pairs = candidates(signed, index(given, most=most), k, excess).select(F.col("gid").alias("gid_a"), F.col("nid").alias("gid_b"))
    a = rows.select(F.col("gid").alias("gid_a"), "fid", F.col("value").alias("x"))
    b = columns.select(F.col("gid").alias("gid_b"), "fid", F.col("value").alias("y"))
    products = pairs.join(unsent(a), "gid_a").join(unsent(b), ["gid_b", "fid"], "left").groupBy("gid_a", "gid_b").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("k"))
    if whole:
        large = keep(given.where("key <> 0").groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("slot", "key"))
        inside = lambda t, s: keep(t.join(s.join(large, ["slot", "key"], "left_semi").select("gid").distinct(), "gid", "left_semi"))
        met = exact_neighbours(inside(rows, signed), inside(columns, given), k)
        products = products.unionByName(met.select(F.col("gid").alias("gid_a"), F.col("nid").alias("gid_b"), "k")).groupBy("gid_a", "gid_b").agg(F.max("k").alias("k"))
    return top_k(products, k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """Only neighbours that have the instance as a neighbour too."""
    back = neighbours.select(F.col("nid").alias("gid"), F.col("gid").alias("nid"))
    return neighbours.join(back, ["gid", "nid"], "left_semi").select("gid", "rank", "nid", "k")


def shared_neighbours(neighbours: DataFrame) -> DataFrame:
    """``(gid, nid, shared, similarity)`` of every neighbour pair: common neighbours, and as part of both list sizes."""
    lists = neighbours.groupBy("gid").agg(F.collect_set("nid").alias("l"))  # at most k ids a row
    both = neighbours.select("gid", "nid").join(lists, "gid").join(lists.toDF("nid", "m"), "nid", "left")
    common = F.size(F.array_intersect("l", F.coalesce("m", F.array().cast("array<bigint>"))))
    return both.select("gid", "nid", common.alias("shared"), F.try_divide(common, F.sqrt(F.size("l") * F.coalesce(F.size("m"), F.lit(0)))).alias("similarity"))


def neighbour_lists(neighbours: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``(gid, ids, products, targets, vector)``: the lists in rank order; ``vector`` holds id + 1 and product."""
    rows = neighbours
    if targets is not None:
        rows = rows.join(targets.select(F.col("gid").alias("nid"), "y").dropDuplicates(["nid"]), "nid", "left")
    else:
        rows = rows.withColumn("y", F.lit(None).cast("double"))
    row = rows.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("rank", "nid", "k", "y"))).alias("l"))
    vector = F.transform("l", lambda e: F.struct((e["nid"] + 1).alias("fid"), e["k"].alias("value")))
    return row.select("gid", F.col("l.nid").alias("ids"), F.col("l.k").alias("products"), F.col("l.y").alias("targets"), vector.alias("vector"))


def accuracy(approximate: DataFrame, exact: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``(gid, accuracy)``: exact neighbours that the approximate list has, by how many it could have."""
    hit = exact.select("gid", "nid").join(approximate.select("gid", "nid", F.lit(1).alias("hit")), ["gid", "nid"], "left")
    return hit.groupBy("gid").agg((F.count("hit") / F.least(F.lit(k), F.count(F.lit(1)))).alias("accuracy"))


def sparsified(dense: DataFrame, cut: float = 0.0) -> DataFrame:
    """Sign features of dense vectors, so that signatures can tell them apart: 2i above ``cut``, 2i + 1 below minus it."""
    each = dense.select("gid", F.posexplode("x").alias("i", "v"))
    fid = F.when(F.col("v") > cut, F.col("i") * 2).when(F.col("v") < -cut, F.col("i") * 2 + 1)
    return each.select("gid", fid.cast("bigint").alias("fid"), F.lit(1.0).alias("value")).where("fid is not null")


