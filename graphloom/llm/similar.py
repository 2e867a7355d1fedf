"""Problem 2: the most similar vectors of every vector, by navigable small-world graphs per shard.

Vectors that can reach the least cosine go to the shards of their most telling features (``vectors.route``).  A shard builds a hierarchical
small-world graph over a signed sketch, held as flat neighbour arrays; the rows that each search met are
scored by their exact cosines, then once more with the neighbours of their neighbours.  The lists of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.kernels import ShardVectors, SmallWorld, best, feature_seeds, once, refine
from graphloom.llm.vectors import TASK, classes_of_copies, route, shared_units
from graphloom.operators.records import mix64
from graphloom.store import keep

SKETCH, DEGREE, EF, HINTS = 64, 6, 16, 8
#: Neighbours that a neighbour proposes, rows listing a row that count as its neighbours, and rounds.
REFINE = 8, 6, 4
LINKS = "field_name string, id_a bigint, id_b bigint, cosine double"


def open_shard(t: pa.Table):
    """Ids, whether the row only asks, and the unit vectors, the asking rows last."""
    t = t.sort_by([("asks", "ascending"), ("id", "ascending")])
    ids, asks = t["id"].to_numpy(), t["asks"].to_numpy()
    fids, vals = t["fids"].combine_chunks(), t["vals"].combine_chunks()
    lengths = fids.value_lengths().to_numpy()
    return ids, asks, ShardVectors(fids.flatten().to_numpy(), vals.flatten().to_numpy(), lengths, normed=True), mix64(ids, 3).view(np.int64)


def _hints(hints: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The first of each line's hints among the rows from ``lo`` to ``hi``, numbered from ``lo``."""
    return -np.sort(-once(np.where((hints >= lo) & (hints < hi), hints - lo, -1)), axis=1)[:, :HINTS]


def _both_ways(points: np.ndarray, salt: np.ndarray, hints: np.ndarray, m: int, width: int) -> np.ndarray:
    """For every row the rows met in the graph over its own part and in that over the other; the first part has ``m`` rows."""
    n, ids = len(points), np.full((len(points), 2 * width), -1, np.int64)
    for lo, hi in ((0, m), (m, n)):
        inside = _hints(hints, lo, hi)
        world = SmallWorld(points[lo:hi], salt[lo:hi], inside[lo:hi], DEGREE, width)
        rest = np.r_[0:lo, hi:n]
        for rows, got, at in ((np.arange(lo, hi), world.own()[0], 0), (rest, world.search(points[rest], inside[rest])[0], width)):
            ids[rows, at : at + got.shape[1]] = np.where(got >= 0, got + lo, -1)
    return ids


def _shard_links(k: int, least: float):
    def links(t: pa.Table) -> pa.Table:
        field, apart = t["field_name"][0].as_py(), t["first"][0].as_py() != t["second"][0].as_py()
        ids, asks, sv, salt = open_shard(t)
        m = int((~asks).sum())
        if apart and m in (0, sv.n):
            return pa.table({"field_name": [], "id_a": [], "id_b": [], "cosine": []}, _schema())
        hints, points, width = feature_seeds(sv, salt, 6, 2), sv.sketch(SKETCH), max(EF, k)
        if apart:
            ids_of, width = _both_ways(points, salt, hints, m, width), 2 * width
        else:
            ids_of, _ = SmallWorld(points, salt, _hints(hints, 0, sv.n), DEGREE, width).own()
        near, cos = best(ids_of.astype(np.int64), sv.cosines(np.arange(sv.n), ids_of), width)
        rows = np.flatnonzero((near[:, 0] >= 0) & (cos[:, 0] >= max(least, 0.2) - 0.2))
        near, cos = refine(sv, near, cos, rows, *REFINE)
        cos = np.round(np.clip(cos, -1, 1), 6)
        i, j = np.nonzero((near >= 0) & (cos >= least))
        a, b, c = ids[i], ids[near[i, j]], cos[i, j]
        order = np.lexsort((b, -c, i))
        keep_ = _first(i[order], k)
        a, b, c = a[order][keep_], b[order][keep_], c[order][keep_]
        return pa.table({"field_name": pa.array([field] * len(a), pa.string()), "id_a": a, "id_b": b, "cosine": c}, _schema())

    return links


def _first(groups: np.ndarray, k: int) -> np.ndarray:
    if not len(groups):
        return np.zeros(0, bool)
    first = np.r_[True, groups[1:] != groups[:-1]]
    return np.arange(len(groups)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k


def _schema() -> pa.Schema:
    return pa.schema([("field_name", pa.string()), ("id_a", pa.int64()), ("id_b", pa.int64()), ("cosine", pa.float64())])


def most_similar(vectors: DataFrame, k: int = 5, least: float = 0.0, features: int = 4, shard_rows: int = 4_000) -> DataFrame:
    """``(field_name, id_a, id_b, cosine, rank)``: up to k other vectors of the field for every vector.

    ``vectors`` is ``(field_name, id, fids, vals)``, one row per vector, fids distinct, values finite and not zero.

    * cosines are exact and rounded to 6 decimals before ranking; ties go to the smaller id; pairs below ``least`` are left out;
    * which vectors are met is approximate; identical vectors are handled exactly, in classes of any size;
    * a vector without a feature in common with another has no row; an empty table gives none.
    """
    units = keep(shared_units(vectors, least, features))
    total = units.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], LINKS + ", rank int")
    members = classes_of_copies(units, total)
    routed = route(units, members, total, shard_rows)
    found = routed.groupBy(*TASK).applyInArrow(_shard_links(k, least), LINKS)
    links = found.dropDuplicates(["field_name", "id_a", "id_b"])
    by_cosine = Window.partitionBy("field_name", "id_a").orderBy(F.desc("cosine"), "id_b")
    links = keep(links.withColumn("rank", F.row_number().over(by_cosine)).where(F.col("rank") <= k).drop("rank"))

    # Classes of identical vectors: a neighbour stands for its k+1 smallest members, and members are neighbours of each other.
    in_class = Window.partitionBy("field_name", "rep").orderBy("id")
    smallest = keep(members.withColumn("r", F.row_number().over(in_class)).where(F.col("r") <= k + 1).select("field_name", "rep", F.col("id").alias("member")))
    to_members = links.join(smallest.withColumnRenamed("rep", "id_b"), ["field_name", "id_b"], "left")
    to_members = to_members.select("field_name", "id_a", F.coalesce("member", "id_b").alias("id_b"), "cosine")
    itself = smallest.select("field_name", F.col("rep").alias("id_a"), F.col("member").alias("id_b"), F.lit(1.0).alias("cosine"))
    lists = to_members.unionByName(itself if least <= 1 else itself.limit(0))
    lists = lists.withColumn("rank", F.row_number().over(by_cosine)).where(F.col("rank") <= k + 1)
    others = members.where("id <> rep").select("field_name", F.col("rep").alias("id_a"), "id", "n")
    for_copies = others.join(lists, ["field_name", "id_a"]).select("field_name", F.col("id").alias("id_a"), "id_b", "cosine")
    every = lists.select("field_name", "id_a", "id_b", "cosine").unionByName(for_copies).where("id_a <> id_b")
    return every.withColumn("rank", F.row_number().over(by_cosine)).where(F.col("rank") <= k)
