"""Operators on long-form sparse vectors ``(gid, fid, value)`` and on dense ones ``(gid, x)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of scaled products (fixed value).
LIMIT = 1e9
#: Parts over which the rows of one feature are spread when all pairs of its holders are asked for.
SALTS = 8


def dot_products(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``(gid_a, gid_b, k)`` of all row and column instances that share a feature; pairs without one have product 0."""
    salt = F.pmod(F.xxhash64("gid"), F.lit(SALTS)).cast("int")  # rows of one feature are spread, its columns copied
    a = rows.select(F.col("gid").alias("gid_a"), "fid", F.col("value").alias("x"), salt.alias("salt"))
    b = columns.select(F.col("gid").alias("gid_b"), "fid", F.col("value").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return a.join(b, ["fid", "salt"]).groupBy("gid_a", "gid_b").agg(F.sum(F.col("x") * F.col("y")).alias("k"))


def dense_features(dense: DataFrame) -> DataFrame:
    """A dense table ``(gid, x array)`` in long form, zeros left out."""
    return dense.select("gid", F.posexplode("x").alias("fid", "value")).where("value <> 0").select("gid", F.col("fid").cast("bigint").alias("fid"), F.col("value").cast("double").alias("value"))


def _blocks_met(rows: DataFrame, columns: DataFrame, block_rows: int) -> DataFrame:
    """Rows and columns of dense tables, each copied to every block of the other side; blocks hold about ``block_rows``."""
    n, m = (max(1, -(-t.count() // block_rows)) for t in (rows, columns))
    part = lambda count: F.pmod(F.xxhash64("gid"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = rows.select(part(n).alias("i"), every(m).alias("j"), F.lit(True).alias("row"), "gid", "x")
    return a.unionByName(columns.select(every(n).alias("i"), part(m).alias("j"), F.lit(False).alias("row"), "gid", "x"))


def dense_dots(rows: DataFrame, columns: DataFrame, block_rows: int = 2_000) -> DataFrame:
    """``(gid_a, gid_b, k)`` of every row with every column instance of dense tables, block against block as matrix products.

    The result has a line for every pair because that is what the operator gives; each task multiplies two blocks of about
    ``block_rows``.
    """
    import numpy as np
    import pandas as pd

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame[frame["row"]], frame[~frame["row"]]
        if not len(p) or not len(q):
            return pd.DataFrame({"gid_a": [], "gid_b": [], "k": []})
        k = np.stack(p["x"].to_list()).astype(float) @ np.stack(q["x"].to_list()).astype(float).T
        return pd.DataFrame({"gid_a": np.repeat(p["gid"].to_numpy(), len(q)), "gid_b": np.tile(q["gid"].to_numpy(), len(p)), "k": k.ravel()})

    return _blocks_met(rows, columns, block_rows).groupBy("i", "j").applyInPandas(products, "gid_a bigint, gid_b bigint, k double")


def dense_neighbours(rows: DataFrame, columns: DataFrame, k: int = 10, digits: int = 9, block_rows: int = 2_000) -> DataFrame:
    """``(gid, rank, nid, k)``: the k column instances of largest product for every row, itself included, ties by id.

    Products are rounded to ``digits`` first.  Only the k best of a row leave a task, so n k lines a column block are
    shuffled and never the products of all pairs.
    """
    import numpy as np
    import pandas as pd
    from graphloom.operators.lsh import top_k

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame[frame["row"]], frame[~frame["row"]].sort_values("gid")
        if not len(p) or not len(q):
            return pd.DataFrame({"gid_a": [], "gid_b": [], "k": []})
        products = np.round(np.stack(p["x"].to_list()).astype(float) @ np.stack(q["x"].to_list()).astype(float).T, digits)
        near = np.argsort(-products, axis=1, kind="stable")[:, :k]  # equal products stay in order of id
        values = np.take_along_axis(products, near, 1)
        return pd.DataFrame({"gid_a": np.repeat(p["gid"].to_numpy(), near.shape[1]), "gid_b": q["gid"].to_numpy()[near.ravel()], "k": values.ravel()})

    return top_k(_blocks_met(rows, columns, block_rows).groupBy("i", "j").applyInPandas(best, "gid_a bigint, gid_b bigint, k double"), k, digits)


def neighbour_products(neighbours: DataFrame, dense: DataFrame) -> DataFrame:
    """``(gid_a, gid_b, k)`` of every two different instances that are neighbours of a third; at most k^2 pairs an instance."""
    a, b = neighbours.select("gid", F.col("nid").alias("gid_a")), neighbours.select("gid", F.col("nid").alias("gid_b"))
    pairs = a.join(b, "gid").where("gid_a < gid_b").select("gid_a", "gid_b").distinct()
    both = pairs.join(dense.select(F.col("gid").alias("gid_a"), F.col("x").alias("xa")), "gid_a").join(dense.select(F.col("gid").alias("gid_b"), F.col("x").alias("xb")), "gid_b")
    k = F.aggregate(F.zip_with("xa", "xb", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    found = both.select("gid_a", "gid_b", k.alias("k"))
    return found.unionByName(found.select(F.col("gid_b").alias("gid_a"), F.col("gid_a").alias("gid_b"), "k"))


def gram_summary(gram: DataFrame, rows: DataFrame, columns: DataFrame, rr: DataFrame, cc: DataFrame) -> DataFrame:
    """Mean products between rows and columns, and within each without the diagonal, and their ratio."""
    n, m = rows.select("gid").distinct().count(), columns.select("gid").distinct().count()
    mean = lambda g, pairs, off: g.where("gid_a <> gid_b" if off else "true").agg((F.sum("k") / F.lit(float(max(pairs, 1)))).alias("v"))
    rc = mean(gram, n * m, False).withColumnRenamed("v", "mean_rc")
    r = mean(rr, n * (n - 1), True).withColumnRenamed("v", "mean_rr")
    c = mean(cc, m * (m - 1), True).withColumnRenamed("v", "mean_cc")
    return rc.join(r, F.lit(True)).join(c, F.lit(True)).withColumn("similarity", F.try_divide(F.col("mean_rc"), F.sqrt(F.col("mean_rr") * F.col("mean_cc"))))  # three single rows


def target_alignment(gram: DataFrame, targets: DataFrame) -> DataFrame:
    """Sum of k y y over pairs i <> j, by the root of the sum of their squares times n(n - 1)."""
    y = targets.select("gid", "y")
    both = gram.where("gid_a <> gid_b").join(y.toDF("gid_a", "ya"), "gid_a").join(y.toDF("gid_b", "yb"), "gid_b")
    n = y.select("gid").distinct().agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = both.agg(F.sum(F.col("k") * F.col("ya") * F.col("yb")).alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    return sums.join(n, F.lit(True)).select(F.try_divide(F.col("s"), F.sqrt(F.col("q") * (F.col("n") * F.col("n") - F.col("n")))).alias("alignment"))


def scaled(features: DataFrame, model: DataFrame) -> DataFrame:
    """x times w per feature, bounded, at unit length; features without a weight vanish."""
    from graphloom.operators.kernels import unit_length

    product = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("value") * F.col("w")))
    return unit_length(features.join(model.select("fid", "w"), "fid").select("gid", "fid", product.alias("value")))


def elementwise(a: DataFrame, b: DataFrame, limit: float | None = None) -> DataFrame:
    """Product per (gid, fid), bounded by +-limit if given."""
    product = F.col("value") * F.col("other")
    if limit is not None:
        product = F.greatest(F.lit(-limit), F.least(F.lit(limit), product))
    return a.join(b.withColumnRenamed("value", "other"), ["gid", "fid"]).select("gid", "fid", product.alias("value"))


def binarised(features: DataFrame) -> DataFrame:
    return features.where("value <> 0").withColumn("value", F.lit(1.0))


def correlation_laplacian(parts: DataFrame, neighbours: int) -> DataFrame:
    """``(fid_i, fid_j, v)``: rows of the normalised Laplacian of features that occur at the same vertices.

    ``parts (gid, vid, fid, value)``.  Row fid_i adds the vectors of all vertices having fid_i and keeps the entries above its
    (neighbours + 1)-th largest; a row with no more entries than that keeps all.  The diagonal is left out, the rest divided
    by minus the row's norm, and the diagonal set to 1.
    """
    from pyspark.sql import Window

    a = parts.select("gid", "vid", F.col("fid").alias("fid_i")).distinct()
    b = parts.select("gid", "vid", F.col("fid").alias("fid_j"), "value")
    summed = a.join(b, ["gid", "vid"]).groupBy("fid_i", "fid_j").agg(F.round(F.sum("value"), 9).alias("s"))
    w = Window.partitionBy("fid_i").orderBy(F.desc("s"), "fid_j")
    ranked = summed.withColumn("r", F.row_number().over(w))
    bar = ranked.where(F.col("r") == neighbours + 1).select("fid_i", F.col("s").alias("bar"))
    kept = ranked.join(bar, "fid_i", "left").where("(bar is null or s > bar) and fid_i <> fid_j")
    norm = kept.groupBy("fid_i").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    off = kept.join(norm, "fid_i").select("fid_i", "fid_j", (-F.col("s") / F.col("n")).alias("v"))
    one = summed.select("fid_i").distinct().select("fid_i", F.col("fid_i").alias("fid_j"), F.lit(1.0).alias("v"))
    return off.unionByName(one)


def smoothed(features: DataFrame, neighbours: DataFrame, least: float, bits: int = 15, code: int = 42) -> DataFrame:
    """Each vector with the mean of its neighbours of ``least`` < k < 1 added under rehashed fids, at unit length."""
    from graphloom.operators.kernels import rehash, unit_length

    near = neighbours.where((F.col("k") > least) & (F.round("k", 6) < 1)).select("gid", "nid")
    size = near.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    added = near.join(features.withColumnRenamed("gid", "nid"), "nid").groupBy("gid", "fid").agg(F.sum("value").alias("s"))
    mean = added.join(size, "gid").select("gid", "fid", (F.col("s") / F.col("n")).alias("value"))
    return unit_length(features.unionByName(rehash(mean, code, bits)).groupBy("gid", "fid").agg(F.sum("value").alias("value")))
