"""Problem 4: how distinctive a term is in its record, by graph-of-words weighting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import salted_lookup
from graphloom.store import keep

WINDOW = 4
ENTRIES = "field_name string, record_id bigint, fid bigint, value double, share double, degree int"


def window_degrees(record: np.ndarray, term: np.ndarray, window: int) -> np.ndarray:
    """Distinct other terms of the record that stand less than ``window`` places from any place of the term.

    Records are contiguous and terms in order.  An edge joins two terms within a window; the degree of a
    term in that graph is returned at each of its places.
    """
    n = len(record)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((term, record))
    repeated = (record[order][1:] == record[order][:-1]) & (term[order][1:] == term[order][:-1])
    if not repeated.any():  # every neighbour is a different term
        degree = np.zeros(n, np.int64)
        for step in range(1, window):
            same = record[step:] == record[:-step]
            degree[step:] += same
            degree[:-step] += same
        return degree
    a, b = [], []
    for step in range(1, window):
        i = np.flatnonzero((record[step:] == record[:-step]) & (term[step:] != term[:-step]))
        a += [i, i + step]
        b += [i + step, i]
    a, b = np.concatenate(a), np.concatenate(b)
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(np.r_[True, ~repeated]) - 1
    edges = np.unique(np.c_[group[a], group[b]], axis=0)
    return np.bincount(edges[:, 0], minlength=n)[group]


def _entries(window: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["fids"].value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths)
            fid, val = batch["fids"].flatten().to_numpy(), batch["vals"].flatten().to_numpy()
            reads, place = batch["reads"].flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), batch["reads"].value_lengths().to_numpy())
            order = np.lexsort((fid, row))
            fid, val = fid[order], val[order]
            total = np.bincount(row, val, batch.num_rows)[row] if len(row) else val
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.round(val / total, 6)
            at = np.lexsort((reads, place))  # a term has one degree, whatever the number of its places
            first = np.ones(len(at), bool)
            first[1:] = (place[at][1:] != place[at][:-1]) | (reads[at][1:] != reads[at][:-1])
            degree = window_degrees(place, reads, window)[at[first]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["field_name"].take(pa.array(row)), batch["id"].take(pa.array(row)), pa.array(fid), pa.array(val), pa.array(share, mask=total == 0), pa.array(degree)],
                names=["field_name", "record_id", "fid", "value", "share", "degree"],
            )

    return entries


def distinctive_terms(vectors: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(field_name, record_id, fid, value, share, degree, held_by, score)`` of every entry of ``(field_name, id, fids, vals, reads)``.

    * ``reads``: the record's fids in the order in which they were recorded, each at least once; without that column, ``fids``;
    * ``degree``: distinct neighbours in the record's graph of words, whose edges join fids less than ``window`` places apart in ``reads``;
      a fid recorded again and again beside others has more neighbours than one recorded once, and one at the ends fewer;
    * ``held_by``: records of the field that hold the fid; ``score`` = degree x ln(records of the field / held_by);
    * ``share``: value as part of the sum of the record's values, to 6 decimals; null where that sum is 0;
    * an empty table gives none; a fid held by every record scores 0.
    """
    if "reads" not in vectors.columns:
        vectors = vectors.withColumn("reads", F.col("fids"))
    vectors = keep(vectors.select("field_name", "id", "fids", "vals", "reads"))
    sizes = vectors.groupBy("field_name").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("fids")).alias("entries")).collect()  # a row per field
    if not sizes:
        return vectors.sparkSession.createDataFrame([], ENTRIES + ", held_by bigint, score double")
    entries = vectors.mapInArrow(_entries(window), ENTRIES)
    held = vectors.select("field_name", F.explode("fids").alias("fid")).groupBy("field_name", "fid").agg(F.count(F.lit(1)).alias("held_by"))
    counted = salted_lookup(entries, held, ["field_name", "fid"], "held_by", sum(r["entries"] for r in sizes))
    records = F.create_map(*[F.lit(x) for r in sizes for x in (r["field_name"], float(r["records"]))])
    score = F.round(F.col("degree") * F.log(records[F.col("field_name")] / F.col("held_by")), 6)
    return counted.select("field_name", "record_id", "fid", "value", "share", "degree", "held_by", score.alias("score"))
