"""Neighbourhood kernels as plans: codes of radius 0 and 1, pair features, normalisation, minimum kernel, strings.

Features are long form ``(gid, fid, value)``.  Larger radii and the tree kernels are in ``local_kernels``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import hash_array, hash_text, hash_values, int_hash, mask_of, prefix_states
from graphloom.operators.graph_ops import degrees
from graphloom.operators.skew import unsent
from graphloom.store import keep

#: Above this root degree a neighbourhood has code 1 (fixed value).
MOST_DEGREE = 10
#: First value of the hash of real-vector features (fixed value).
REAL_VECTOR = 7919


def label_codes(vertices: DataFrame, bits: int = 15) -> DataFrame:
    """``(gid, vid, code)``: the hash of the label; only distinct labels are hashed."""
    known = vertices.select("label").distinct().withColumn("code", hash_text("label", bits))
    return vertices.select("gid", "vid", "label").join(known, "label").select("gid", "vid", "code")


def neighbour_codes(vertices: DataFrame, edges: DataFrame, bits: int = 15) -> DataFrame:
    """``(gid, vid, code)`` of radius 1: the label with the sorted neighbour and edge labels."""
    far = vertices.select("gid", F.col("vid").alias("dst"), F.col("label").alias("far"))
    around = edges.join(unsent(far), ["gid", "dst"]).groupBy("gid", F.col("src").alias("vid")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("-", "far", F.col("label")))), ".").alias("around")
    )
    text = vertices.select("gid", "vid", "label").join(unsent(around), ["gid", "vid"], "left").select("gid", "vid", F.concat("label", F.lit(":"), F.coalesce("around", F.lit(""))).alias("text"))
    known = text.select("text").distinct().withColumn("code", hash_text("text", bits))
    return text.join(known, "text").select("gid", "vid", "code")


def vertex_codes(vertices: DataFrame, edges: DataFrame, radius: int, bits: int = 15) -> DataFrame:
    """``(gid, r, vid, code)`` for r = 0..radius (at most 1), hubs guarded by code 1."""
    codes = [label_codes(vertices, bits), *([neighbour_codes(vertices, edges, bits)] if radius else [])]
    every = codes[0].withColumn("r", F.lit(0))
    for r, c in enumerate(codes[1:], 1):
        every = every.unionByName(c.withColumn("r", F.lit(r)))
    hub = degrees(edges).where(F.col("degree") > MOST_DEGREE).select("gid", "vid", F.lit(True).alias("hub"))
    return every.join(unsent(hub), ["gid", "vid"], "left").select("gid", "r", "vid", F.when(F.col("hub"), 1).otherwise(F.col("code")).alias("code"))


def pair_features(vertices: DataFrame, distances: DataFrame, codes: DataFrame, bits: int = 15, by_vertex: bool = True) -> DataFrame:
    """``(gid, vid, r, d, fid, count)`` per source vertex: pairs of codes at a distance, and the far code alone.

    Only distinct (r, d, code, code) are hashed; they repeat heavily.  Without ``by_vertex`` there is no vid, and pairs are hashed and
    counted at once, which shuffles them only once.
    """
    sources = vertices.where("is_viewpoint and is_kernel_point and not is_dead and not is_abstraction").select("gid", F.col("vid").alias("src"))
    targets = vertices.where("is_kernel_point and not is_dead and not is_abstraction").select("gid", F.col("vid").alias("dst"))
    pairs = distances.join(unsent(sources), ["gid", "src"], "left_semi").join(unsent(targets), ["gid", "dst"], "left_semi")
    a = codes.select("gid", "r", F.col("vid").alias("src"), F.col("code").alias("ca"))
    b = codes.select("gid", "r", F.col("vid").alias("dst"), F.col("code").alias("cb"))
    coded = pairs.join(unsent(a), ["gid", "src"]).join(unsent(b), ["gid", "r", "dst"])
    low, high = F.least("ca", "cb"), F.greatest("ca", "cb")
    both = coded.select("gid", F.col("src").alias("vid"), "r", "d", F.explode(F.array(F.struct(low.alias("x"), high.alias("y")), F.struct(F.lit(0).cast("bigint").alias("x"), F.col("cb").alias("y")))).alias("p"))
    if not by_vertex:
        fid = hash_values(F.col("r"), F.col("d"), F.col("p.x"), F.col("p.y"), bits=bits)
        return both.groupBy("gid", "r", "d", fid.alias("fid")).agg(F.count(F.lit(1)).cast("double").alias("count"))
    counted = both.groupBy("gid", "vid", "r", "d", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count(F.lit(1)).alias("count"))
    hashed = counted.select("r", "d", "x", "y").distinct().withColumn("fid", hash_values(F.col("r"), F.col("d"), F.col("x"), F.col("y"), bits=bits))
    return counted.join(hashed, ["r", "d", "x", "y"]).groupBy("gid", "vid", "r", "d", "fid").agg(F.sum("count").cast("double").alias("count"))


def abstraction_features(vertices: DataFrame, edges: DataFrame, distances: DataFrame, codes: DataFrame, bits: int = 15) -> DataFrame:
    """``(gid, vid, r, d, fid, count)`` of abstract vertices: everything at a distance from the part side with everything from the abstract side.

    A vertex without either side is an error of the data and is raised.
    """
    tops = vertices.where("is_abstraction").select("gid", F.col("vid").alias("top"))
    side = lambda flag: edges.where(flag).select("gid", F.col("src").alias("top"), F.col("dst").alias("src")).join(tops, ["gid", "top"], "left_semi")
    reach = lambda e: e.join(distances, ["gid", "src"]).select("gid", "top", "d", F.col("dst").alias("vid")).distinct().join(codes, ["gid", "vid"])
    counts = lambda e, name: reach(e).groupBy("gid", "top", "d", "r", F.col("code").alias(name)).agg(F.count(F.lit(1)).alias(f"n{name}"))
    lower, upper = counts(side("is_part_of"), "x"), counts(side("is_abstraction_of"), "y")
    given = tops.join(lower.select("gid", "top", F.lit(1).alias("l")).distinct(), ["gid", "top"], "left").join(upper.select("gid", "top", F.lit(1).alias("u")).distinct(), ["gid", "top"], "left")
    if given.where("l is null or u is null").limit(1).count():
        raise ValueError("abstract vertex without a part or an abstract side")
    met = lower.join(upper, ["gid", "top", "d", "r"])
    fid = hash_values(F.col("r"), F.col("d"), F.col("x"), F.col("y"), bits=bits)
    return met.groupBy("gid", F.col("top").alias("vid"), "r", "d", fid.alias("fid")).agg(F.sum(F.col("nx") * F.col("ny")).cast("double").alias("count"))


def instance_vectors(parts: DataFrame, normalise: bool = True) -> DataFrame:
    """``(gid, fid, value)``: counts normalised within (r, d), added, and normalised again; raw sums if ``normalise`` is off."""
    cells = parts.groupBy("gid", "r", "d", "fid").agg(F.sum("count").alias("c"))
    if not normalise:
        return cells.groupBy("gid", "fid").agg(F.sum("c").alias("value"))
    norms = cells.groupBy("gid", "r", "d").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    added = cells.join(norms, ["gid", "r", "d"]).groupBy("gid", "fid").agg(F.sum(F.col("c") / F.col("n")).alias("value"))
    return unit_length(added)


def unit_length(features: DataFrame) -> DataFrame:
    """Values divided by the instance's norm; instances of norm 0 are left out."""
    norms = features.groupBy("gid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n")).where("n > 0")
    return features.join(norms, "gid").select("gid", "fid", (F.col("value") / F.col("n")).alias("value"))


def vertex_vectors(parts: DataFrame) -> DataFrame:
    """``(gid, vid, fid, value)`` per vertex, not normalised."""
    return parts.groupBy("gid", "vid", "fid").agg(F.sum("count").alias("value"))


def minimum_kernel(features: DataFrame, bits: int = 15) -> DataFrame:
    """Every (fid, value) becomes one binary feature H(fid, j) for each j below the value."""
    steps = features.where("value > 0").select("gid", "fid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil("value") - 1)).alias("j"))
    return steps.select("gid", hash_values(F.col("fid"), F.col("j"), bits=bits).alias("fid")).distinct().withColumn("value", F.lit(1.0))


def rehash(features: DataFrame, code: int, bits: int = 15) -> DataFrame:
    """fid -> H(fid, code); of colliding features the one of the larger old fid holds."""
    moved = features.select("gid", hash_values(F.col("fid"), code, bits=bits).alias("new"), "fid", "value")
    return moved.groupBy("gid", F.col("new").alias("fid")).agg(F.max_by("value", "fid").alias("value"))


def real_vector_features(pairs: DataFrame, projections: int = 1, bits: int = 15) -> DataFrame:
    """``(gid, fid, value)`` of context features ``(gid, fid, vec)``: sparse random projections of the real vectors.

    fid' = H(7919, k, fid); every coordinate counts +-sqrt(3) with chance 1/6 each, by the integer hash of (fid', coordinate).
    """
    each = pairs.where("vec is not null").select("gid", "fid", "vec", F.explode(F.sequence(F.lit(0), F.lit(projections - 1))).alias("k"))
    keyed = each.select("gid", hash_values(REAL_VECTOR, F.col("k"), F.col("fid"), bits=bits).alias("fid"), "vec")
    draw = lambda x, i: int_hash(i + 1, F.col("fid").bitwiseAND(F.lit(0x7FFF)).cast("int")) % 6
    terms = F.transform("vec", lambda x, i: F.when(draw(x, i) == 0, x).when(draw(x, i) == 1, -x).otherwise(0.0))
    value = F.sqrt(F.lit(3.0)) * F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.coalesce(t, F.lit(0.0)))
    return keyed.select("gid", "fid", value.alias("value")).groupBy("gid", "fid").agg(F.sum("value").alias("value"))


def vector_codes(features: DataFrame, bits: int = 30) -> DataFrame:
    """``(gid, code)``: one hash of a whole vector, H over its (fid, value in ten-thousandths, cut off) in order of fid."""
    row = features.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("fid", F.when(F.col("value") < 0, F.ceil(F.col("value") * 10_000)).otherwise(F.floor(F.col("value") * 10_000)).alias("v")))).alias("e"))
    return row.select("gid", hash_array(F.flatten(F.transform("e", lambda e: F.array(e["fid"], e["v"]))), bits).alias("code"))


def _string_cells(text: str | None, radius: int, distance: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position of a text the combination (r, d), numbered in order, and the fid of each of its features."""
    mask = np.int64(mask_of(bits))
    start, word = np.uint64(0xAAAAAAAA), np.uint64(0xFFFFFFFF)

    def h4(r: int, d: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = np.full(len(x), start, np.uint64)
        for i, v in enumerate((np.full(len(x), r), np.full(len(x), d), x, y)):
            v = v.astype(np.uint64)
            t = ~((((h << np.uint64(11)) + v) & word) ^ (h >> np.uint64(5))) if i % 2 else (h << np.uint64(7)) ^ (v * (h >> np.uint64(3)))
            h = (h ^ t) & word
        return h.astype(np.int64) & mask

    codes = np.frombuffer((text or "").encode(), np.int8)
    n, combos, fids = len(codes), [], []
    states = prefix_states(codes, radius + 1) if n else None
    for r in range(radius + 1 if n else 0):
        c = np.where(np.arange(n) + r < n, states[:, r] & mask, 0)
        for d in range(distance + 1):
            far = c[np.minimum(np.arange(n) + d, n - 1)]
            fids.append(np.r_[h4(r, d, np.minimum(c, far), np.maximum(c, far)), h4(r, d, np.zeros(n, np.int64), far)])
            combos.append(np.full(2 * n, r * (distance + 1) + d))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *combos]), np.concatenate([none, *fids])


def string_vectors(texts: DataFrame, radius: int = 2, distance: int = 5, bits: int = 15) -> DataFrame:
    """``(gid, fid, value)`` of whole texts ``(gid, text)``: substring pairs by prefix hashing, normalised as ``instance_vectors`` does.

    A text is complete in its row, so its vector is made there and nothing is shuffled.  Null and empty texts have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, text in zip(batch["gid"].to_pylist(), batch["text"].to_pylist()):
                combo, fid = _string_cells(text, radius, distance, bits)
                if not len(fid):
                    continue
                key, count = np.unique((combo << np.int64(bits)) | fid, return_counts=True)
                at = key >> np.int64(bits)
                norm = np.sqrt(np.bincount(at, count.astype(float) ** 2))
                f, place = np.unique(key & np.int64(mask_of(bits)), return_inverse=True)
                value = np.bincount(place, count / norm[at], len(f))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), gid)), pa.array(f), pa.array(value / np.sqrt((value**2).sum()))], names=["gid", "fid", "value"])

    return texts.select("gid", "text").mapInArrow(run, "gid bigint, fid bigint, value double")


def string_positions(texts: DataFrame, radius: int = 2, distance: int = 5, bits: int = 15) -> DataFrame:
    """``(gid, vid, fid, value)``: the features that start at each byte of a text, not normalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, text in zip(batch["gid"].to_pylist(), batch["text"].to_pylist()):
                combo, fid = _string_cells(text, radius, distance, bits)
                if not len(fid):
                    continue
                n = len((text or "").encode())
                vid = np.tile(np.arange(n), len(fid) // n)
                key, count = np.unique((vid << np.int64(bits)) | fid, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), gid)), pa.array((key >> np.int64(bits)).astype(np.int32)), pa.array(key & np.int64(mask_of(bits))), pa.array(count.astype(float))], names=["gid", "vid", "fid", "value"])

    return texts.select("gid", "text").mapInArrow(run, "gid bigint, vid int, fid bigint, value double")


def nspdk(vertices: DataFrame, edges: DataFrame, distances: DataFrame, radius: int = 1, bits: int = 15, normalise: bool = True) -> DataFrame:
    """The pair kernel for radius 0 or 1, abstraction features included."""
    codes = keep(vertex_codes(vertices, edges, radius, bits))
    parts = pair_features(vertices, distances, codes, bits)
    parts = parts.unionByName(abstraction_features(vertices, edges, distances, codes, bits))
    return instance_vectors(parts, normalise)
