"""Current next-generation nodes: the last loaded row of every node, and its vectors and discrete values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.records import SEQUENCES

_MAPS = ("m_number", "m_discrete", "m_bool", "m_svector")


def current_nodes(nodes: DataFrame, columns: tuple[str, ...] = ("m_discrete", "m_svector")) -> DataFrame:
    """``nid`` and ``columns`` of the row loaded last.

    Rows without ``nid`` are left out; a null load time is earliest; ties are settled by the record time and then
    by the text of the maps, so that the result never depends on row order.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in _MAPS if c in nodes.columns]))
    ranked = F.struct(F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**63) + 1)).alias("a"),
                      F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(2**63) + 1)).alias("b"), text.alias("c"))
    last = nodes.where("nid is not null").groupBy(F.col("nid").cast("bigint").alias("nid")).agg(F.max_by(F.struct(*columns), ranked).alias("r"))
    return last.select("nid", *[F.col(f"r.{c}").alias(c) for c in columns])


def profile_entries(current: DataFrame, attribute: str = "profile") -> DataFrame:
    """``(nid, fid, value, occurrences)`` of a vector attribute.

    Null and zero (and NaN or infinite) values mean the fid is not held; equal (fid, value) entries count once
    in ``value`` and each in ``occurrences``; different values of one fid are added.
    """
    flat = current.select("nid", F.explode(F.col("m_svector")[attribute]).alias("e")).select("nid", "e.fid", "e.value")
    held = flat.where("fid is not null and value is not null and value <> 0 and not isnan(value) and abs(value) < double('infinity')")
    each = held.groupBy("nid", "fid", "value").agg(F.count(F.lit(1)).alias("m"))
    return each.groupBy("nid", "fid").agg(F.sum("value").alias("value"), F.sum("m").alias("occurrences")).where("value <> 0")


def _pack_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        entries = batch["entries"]
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False))
        flat = entries.flatten()
        fid, val = flat.field("fid"), flat.field("value")
        ok = (flat.is_valid().to_numpy(zero_copy_only=False) & fid.is_valid().to_numpy(zero_copy_only=False) & val.is_valid().to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0, bool)
        fids, vals = pc.fill_null(fid, 0).to_numpy(zero_copy_only=False), pc.fill_null(val, 0.0).to_numpy(zero_copy_only=False)
        ok &= np.isfinite(vals) & (vals != 0)
        row, fids, vals = row[ok], fids[ok], vals[ok]
        order = np.lexsort((vals, fids, row))
        r, f, v = row[order], fids[order], vals[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1]) | (v[1:] != v[:-1])
        r, f, v = r[new], f[new], v[new]  # equal entries count once, different values of a fid are added
        start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (f[1:] != f[:-1])]) if len(r) else np.zeros(0, np.int64)
        r, f, v = r[start], f[start], np.add.reduceat(v, start) if len(start) else v
        r, f, v = r[v != 0], f[v != 0], v[v != 0]
        here = np.unique(r)
        held = _held(row, fids, r, f)
        lists = lambda of, what: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=batch.num_rows)[here])].astype(np.int32)), pa.array(what))
        yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(here)), lists(r, f), lists(r, v), lists(row[held], fids[held])], names=["id", "fids", "vals", "reads"])


def _held(row: np.ndarray, fids: np.ndarray, r: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether each (row, fid) is among the pairs (r, f)."""
    _, code = np.unique(np.r_[fids, f], return_inverse=True)
    width = int(code.max(initial=0)) + 1
    return np.isin(row * width + code[: len(fids)], r * width + code[len(fids) :])


def profile_sequences(current: DataFrame, attribute: str = "profile") -> DataFrame:
    """``(id, fids, vals, reads)``: ``profile_vectors`` and the fids held, in the order of the stored entries, repeats included."""
    rows = current.where(F.col("m_svector")[attribute].isNotNull()).select(F.col("nid").alias("id"), F.col("m_svector")[attribute].alias("entries"))
    return rows.mapInArrow(_pack_entries, SEQUENCES)


def profile_vectors(current: DataFrame, attribute: str = "profile") -> DataFrame:
    """``(id, fids, vals)`` in the packed form of ``records.current_vectors``, one row per node holding a fid."""
    return profile_sequences(current, attribute).select("id", "fids", "vals")
