"""Features of next-generation nodes: each attribute map has its own namespace and its own projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import hash_text, hash_values, int_hash
from graphloom.operators.kernels import unit_length
from graphloom.operators.nodes import profile_entries

#: Feature namespaces of the attribute maps (fixed values).
NUMBER, DISCRETE, BOOL, SPARSE = 1, 2, 3, 4


def signed_projection(vectors: DataFrame, width: int) -> DataFrame:
    """``(gid, k, value)``: ``width`` sparse random projections with weights +-sqrt(3), each with chance 1/6."""
    each = vectors.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(width))))
    draw = int_hash(F.col("fid"), F.col("k")) % 6
    weight = F.when(draw == 0, 1.0).when(draw == 1, -1.0)
    return each.withColumn("w", weight).where("w is not null").groupBy("gid", "k").agg((F.sqrt(F.lit(3.0)) * F.sum(F.col("value") * F.col("w"))).alias("value"))


def orthant_projection(vectors: DataFrame, width: int) -> DataFrame:
    """``(gid, fid, value)``: the projections' positive and negative parts as features of their own."""
    p = signed_projection(vectors, width)
    return p.where("value <> 0").select("gid", (F.col("k") * 2 + (F.col("value") < 0).cast("int")).cast("bigint").alias("fid"), F.abs("value").alias("value"))


def minhash_projection(vectors: DataFrame, width: int) -> DataFrame:
    """``(gid, k, fid)``: for each of ``width`` hashes the fid of least hash, ties by fid."""
    each = vectors.where("value <> 0").select("gid", "fid", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("k"))
    return each.groupBy("gid", "k").agg(F.min_by("fid", F.struct(int_hash(F.col("fid"), F.col("k")).alias("h"), "fid")).alias("fid"))


def attribute_features(nodes: DataFrame, bits: int = 30) -> DataFrame:
    """``(gid, fid, value)`` of nodes ``(nid, m_number, m_discrete, m_bool, m_svector)``: every namespace at unit length, then the whole.

    Null maps and values give nothing; discrete values are compared in lower case without outer blanks.
    """
    key = lambda space, *parts: hash_values(F.lit(space), *parts, bits=bits).alias("fid")
    number = nodes.select("nid", F.explode("m_number").alias("key", "value")).where("value is not null").select(F.lit(NUMBER).alias("space"), "nid", key(NUMBER, hash_text("key", bits)), "value")
    discrete = nodes.select("nid", F.explode("m_discrete").alias("key", "text")).where("text is not null")
    known = discrete.select("key", F.lower(F.trim("text")).alias("text")).distinct().withColumn("fid", key(DISCRETE, hash_text("key", bits), hash_text("text", bits)))
    discrete = discrete.select("nid", "key", F.lower(F.trim("text")).alias("text")).join(known, ["key", "text"]).select(F.lit(DISCRETE).alias("space"), "nid", "fid", F.lit(1.0).alias("value"))
    truth = nodes.select("nid", F.explode("m_bool").alias("key", "flag")).where("flag").select(F.lit(BOOL).alias("space"), "nid", key(BOOL, hash_text("key", bits)), F.lit(1.0).alias("value"))
    sparse = profile_entries(nodes).select(F.lit(SPARSE).alias("space"), "nid", key(SPARSE, F.col("fid")), "value")
    every = number.unionByName(discrete).unionByName(truth).unionByName(sparse).groupBy("space", "nid", "fid").agg(F.sum("value").alias("value"))
    norm = every.groupBy("space", "nid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n")).where("n > 0")
    scaled = every.join(norm, ["space", "nid"]).groupBy(F.col("nid").alias("gid"), "fid").agg(F.sum(F.col("value") / F.col("n")).alias("value"))
    return unit_length(scaled)
