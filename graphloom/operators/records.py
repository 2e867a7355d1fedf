"""Current sparse vectors: the last loaded value of every (record, feature), packed one row per record.

The long form arrives with repeats and superseded values.  Rows are reduced inside each scan task first, so
that a record or feature holding a large share of all rows is pre-aggregated before the one shuffle by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows reduced at once inside a scan task.
CHUNK_ROWS = 500_000
NO_TIME = np.iinfo(np.int64).min

PACKED = "id bigint, fids array<bigint>, vals array<double>"
SEQUENCES = PACKED + ", reads array<bigint>"
_PARTIAL = "id bigint, fids array<bigint>, vals array<double>, times array<bigint>"


def _by_pair(ids, fids):
    """Order by (id, fid), equal pairs in any order, and whether each row but the last has the pair of the next."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    low, span = int(fids.min()), int(fids.max()) - int(fids.min()) + 1
    if (int(ids.max()) - int(ids.min()) + 1) * span < 1 << 63:  # both fit one key, and one sort does
        key = (ids - ids.min()) * span + (fids - low)
        order = np.argsort(key)
        key = key[order]
        return order, key[1:] == key[:-1]
    order = np.lexsort((fids, ids))
    return order, (ids[order][1:] == ids[order][:-1]) & (fids[order][1:] == fids[order][:-1])


def _latest(ids, fids, vals, times):
    """Rows of the last (time, value) of each (id, fid), sorted by (id, fid)."""
    order, same = _by_pair(ids, fids)
    if len(ids):  # only the rows of a pair that occurs twice are compared further
        twin = np.r_[False, same] | np.r_[same, False]
        rows = order[twin]
        order[twin] = rows[np.lexsort((vals[rows], times[rows], fids[rows], ids[rows]))]
    at = order[np.r_[~same, True]] if len(ids) else order
    return ids[at], fids[at], vals[at], times[at]


def _every(ids, fids, vals, times):
    """Rows without exact repeats, sorted by (id, fid, time, value)."""
    order = np.lexsort((vals, times, fids, ids))
    ids, fids, vals, times = ids[order], fids[order], vals[order], times[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (fids[1:] != fids[:-1]) | (times[1:] != times[:-1]) | (vals[1:] != vals[:-1])
    return ids[new], fids[new], vals[new], times[new]


def _lists(ids, columns, names):
    """One row per run of equal ids; each column becomes a list column."""
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[start, len(ids)].astype(np.int32))
    arrays = [pa.array(ids[start])] + [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["id", *names])


def _numbers(column: pa.ChunkedArray | pa.Array, null, kind) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _reduce_scan(reduce):
    def flush(held):
        t = pa.Table.from_batches(held)
        vals = _numbers(t["val"], -np.inf, np.float64)
        vals = np.where(np.isnan(vals), -np.inf, vals)  # a null or NaN value sorts before any number of that time
        out = reduce(_numbers(t["id"], 0, np.int64), _numbers(t["fid"], 0, np.int64), vals, _numbers(t["at"], NO_TIME, np.int64))
        return _lists(out[0], out[1:], ["fids", "vals", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)

    return run


def unpack(table: pa.Table | pa.RecordBatch, lists: list[str], key: str = "id"):
    """Row keys repeated per list entry, and the flat values of the list columns."""
    columns = [c.combine_chunks() if isinstance(c := table[n], pa.ChunkedArray) else c for n in lists]
    lengths = pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False)
    return np.repeat(table[key].to_numpy(), lengths), [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def _reduce_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    ids, (fids, vals, times) = unpack(pa.Table.from_batches(held), ["fids", "vals", "times"])
    ids, fids, vals, _ = _latest(ids, fids, vals, times)
    live = np.isfinite(vals) & (vals != 0)
    yield _lists(ids[live], (fids[live], vals[live]), ["fids", "vals"])


def _plain(rows: DataFrame, key: str, fid: str, value: str, at: str) -> DataFrame:
    return rows.select(
        F.col(key).cast("bigint").alias("id"),
        F.col(fid).cast("bigint").alias("fid"),
        F.col(value).cast("double").alias("val"),
        F.unix_micros(F.col(at).cast("timestamp")).alias("at"),
    ).where("id is not null and fid is not null")


def current_vectors(rows: DataFrame, key: str = "gid", fid: str = "fid", value: str = "value", at: str = "loaded_at") -> DataFrame:
    """``(id, fids, vals)``: each record's current vector with its fids ascending.

    * rows without a key or fid are left out; exact repeats count once;
    * of several values of one (key, fid) the one loaded last holds; a null time is earliest; at equal times the
      largest value holds and null or NaN is least;
    * null, NaN, infinite and zero values mean that the fid is not held; a record holding no fid has no row;
    * an empty table gives an empty result; other columns are ignored whatever their names.
    """
    return _plain(rows, key, fid, value, at).mapInArrow(_reduce_scan(_latest), _PARTIAL).repartition("id").mapInArrow(_reduce_record, PACKED)


def _sequence_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    ids, (fids, vals, times) = unpack(pa.Table.from_batches(held), ["fids", "vals", "times"])
    ids, fids, vals, times = _every(ids, fids, vals, times)
    last = np.ones(len(ids), bool)
    last[:-1] = (ids[1:] != ids[:-1]) | (fids[1:] != fids[:-1])
    live = last & np.isfinite(vals) & (vals != 0)
    term = np.cumsum(np.r_[True, last[:-1]]) - 1 if len(ids) else np.zeros(0, np.int64)
    read = live[last][term] & np.isfinite(vals)
    i, f, t = ids[read], fids[read], times[read]
    order = np.lexsort((f, t, i))
    packed, reads = _lists(ids[live], (fids[live], vals[live]), ["fids", "vals"]), _lists(i, (f[order],), ["reads"])
    yield pa.RecordBatch.from_arrays([*packed.columns, reads["reads"]], names=["id", "fids", "vals", "reads"])


def current_sequences(rows: DataFrame, key: str = "gid", fid: str = "fid", value: str = "value", at: str = "loaded_at") -> DataFrame:
    """``(id, fids, vals, reads)``: ``current_vectors`` and the record's held fids in the order in which they were loaded.

    A fid stands in ``reads`` once for every different value or time it was loaded with a number; of one time, fids ascend.  Nulls, repeats, ties
    and empty tables count as in ``current_vectors``.
    """
    return _plain(rows, key, fid, value, at).mapInArrow(_reduce_scan(_every), _PARTIAL).repartition("id").mapInArrow(_sequence_record, SEQUENCES)


def bucket_counts(fids: DataFrame, column: str, bits: int) -> np.ndarray:
    """How many rows fall in each of 2^bits hash buckets of ``column``; at most 2^bits numbers reach the driver.

    The buckets give an upper bound of every value's row count in space that does not grow with the data.
    """
    counted = fids.where(F.col(column).isNotNull()).groupBy(bucket_of(column, bits).alias("b")).count()
    out = np.zeros(1 << bits, np.int64)
    table = counted.toArrow()
    out[table["b"].to_numpy()] = table["count"].to_numpy()
    return out


#: Multipliers of the 64-bit mixing hash (fixed values).
MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def bucket_of(column: str, bits: int):
    """SQL twin of ``bucket_of_numpy``: an xor-folded bucket that needs no overflowing product."""
    x = F.col(column)
    mixed = x.bitwiseXOR(F.shiftrightunsigned(x, 17)).bitwiseXOR(F.shiftrightunsigned(x, 31)).bitwiseXOR(F.shiftrightunsigned(x, 47))
    return mixed.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def bucket_of_numpy(fids: np.ndarray, bits: int) -> np.ndarray:
    x = fids.astype(np.int64).view(np.uint64)
    mixed = x ^ (x >> np.uint64(17)) ^ (x >> np.uint64(31)) ^ (x >> np.uint64(47))
    return (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mixing hash of integers, as unsigned numbers."""
    h = x.astype(np.int64).view(np.uint64) + np.uint64((seed * MIX_B + MIX_A) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_B)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_A | 1)
    return h ^ (h >> np.uint64(31))
