"""The vector fields of the test tables, their shared entries, identical vectors, and the routing of vectors to shards.

Entries travel in blocks: a task sends one row of parallel arrays to every bucket instead of one row per entry, so counting the
holders of every feature costs array operations and few rows, whatever the size of the collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.nodes import current_nodes, profile_sequences, profile_vectors
from graphloom.operators.records import current_sequences, current_vectors, mix64
from graphloom.operators.skew import salted_lookup
from graphloom.store import keep

INSTANCES, PROFILES, DISCRETE = "mp_instance", "m_svector", "m_discrete"
#: Entries that a task gathers before it sends them on.
CHUNK = 1_000_000
#: A feature held by more than one in HOT of a task's vectors travels as a count and spreads over all buckets.
HOT, HOT_ROWS = 64, 2048
#: A feature with up to this many holders shares its shard with the features that occur beside it.
LIGHT = 512
#: Entries of a block at most.
PIECE = 1 << 22
_KINDS = {"ids": np.int64, "fids": np.int64, "vals": np.float64, "counts": np.int32, "names": np.int64}


def _schema(*names: str) -> str:
    """Blocks are the plain bytes of arrays, which the JVM copies whole instead of element by element."""
    return ", ".join(["bucket int", "field_name string", *(f"{n} binary" for n in names)])


BLOCK = _schema("ids", "fids", "vals", "counts")
UNIT = "field_name string, id bigint, fids array<bigint>, vals array<double>, h1 bigint, h2 bigint, light array<bigint>, anchor bigint, own array<bigint>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instance_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_vectors(table(spark, sf_dir, "features")).select(F.lit(INSTANCES).alias("field_name"), "id", "fids", "vals")


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_nodes(table(spark, sf_dir, "nodes"), ("m_svector",))
    return profile_vectors(nodes).select(F.lit(PROFILES).alias("field_name"), "id", "fids", "vals")


def instance_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_sequences(table(spark, sf_dir, "features")).select(F.lit(INSTANCES).alias("field_name"), "id", "fids", "vals", "reads")


def node_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_nodes(table(spark, sf_dir, "nodes"), ("m_svector",))
    return profile_sequences(nodes).select(F.lit(PROFILES).alias("field_name"), "id", "fids", "vals", "reads")


def _blocks(field: str, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per bucket with the entries that go there; of more than ``PIECE`` entries, one per bucket and piece."""
    for lo in range(0, len(bucket), PIECE):
        order = lo + np.argsort(bucket[lo : lo + PIECE], kind="stable")
        sent = bucket[order]
        start = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
        ends = np.r_[start, len(sent)].astype(np.int32)
        flat = {n: np.ascontiguousarray(c[order], _KINDS[n]) for n, c in columns.items()}
        packed = [pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends * np.int32(c.itemsize)), pa.py_buffer(c)]) for c in flat.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sent[start].astype(np.int32)), pa.array([field] * len(start), pa.string()), *packed], names=["bucket", "field_name", *columns])


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False)


def _unblocked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column, kind = batch[name], np.dtype(_KINDS[name])
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (int(ends[-1]) - int(ends[0])) // kind.itemsize, int(ends[0]))


def _by_field(batches: Iterator[pa.RecordBatch], names: list[str]):
    """Flat arrays of the blocks of all batches, by field."""
    held: dict[str, list] = {}
    for batch in batches:
        for field in batch["field_name"].unique().to_pylist():
            part = batch.filter(pa.compute.equal(batch["field_name"], field))
            held.setdefault(field, []).append([_unblocked(part, n) for n in names])
    for field in sorted(held):
        yield field, [np.concatenate(c) for c in zip(*held[field])]


def _in_chunks(send, lists: list[str]):
    """``send`` the batches of a field whenever their ``lists`` hold ``CHUNK`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for field in batch["field_name"].unique().to_pylist():
                part = batch.filter(pa.compute.equal(batch["field_name"], field))
                held.setdefault(field, []).append(part)
                rows[field] = rows.get(field, 0) + sum(len(part[n].flatten()) for n in lists)
                if rows[field] >= CHUNK:
                    yield from send(field, held.pop(field))
                    rows[field] = 0
        for field in sorted(held):
            yield from send(field, held[field])

    return run


def _to_features(buckets: int):
    """Entries of unit vectors, to the bucket of their feature; those of hot features to any bucket, with their share in counts."""

    def send(field: str, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([p["fids"].value_lengths().to_numpy() for p in parts])
        n = len(lengths)
        row = np.repeat(np.arange(n), lengths)
        ids = np.concatenate([p["id"].to_numpy() for p in parts])[row]
        fids, vals = (np.concatenate([_flat(p, c) for p in parts]) for c in ("fids", "vals"))
        norm = np.sqrt(np.bincount(row, vals * vals, n))
        vals = vals / np.where(norm > 0, norm, 1)[row]
        counts = np.zeros(len(fids), np.int32)
        bucket = (mix64(fids, 11) % np.uint64(buckets)).astype(np.int64)
        if n >= HOT_ROWS:
            seen, code, held = np.unique(fids, return_inverse=True, return_counts=True)
            hot = held * HOT > n
            at = hot[code]
            bucket[at] = (mix64(ids[at], 13) % np.uint64(buckets)).astype(np.int64)
            counts[at] = -np.maximum(1, held[code[at]] * 1_000_000 // n)
            ids, fids, bucket = np.r_[ids, held[hot]], np.r_[fids, seen[hot]], np.r_[bucket, (mix64(seen[hot], 11) % np.uint64(buckets)).astype(np.int64)]
            vals, counts = np.r_[vals, np.full(hot.sum(), np.nan)], np.r_[counts, np.zeros(hot.sum(), np.int32)]
        return _blocks(field, bucket, {"ids": ids, "fids": fids, "vals": vals, "counts": counts})

    return _in_chunks(send, ["fids"])


def _count_holders(buckets: int):
    """Entries with the holders of their feature, to the bucket of their vector; entries without a second holder end here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for field, (ids, fids, vals, counts) in _by_field(batches, ["ids", "fids", "vals", "counts"]):
            hot, total = counts < 0, np.isnan(vals)
            plain = ~hot
            _, code = np.unique(fids[plain], return_inverse=True)
            held = np.bincount(code, np.where(total[plain], ids[plain], 1)).astype(np.int64)
            counts = counts.copy()
            counts[plain] = np.minimum(held[code], np.iinfo(np.int32).max)
            go = ~total & (hot | (counts > 1))
            bucket = (mix64(ids[go], 5) % np.uint64(buckets)).astype(np.int64)
            yield from _blocks(field, bucket, {"ids": ids[go], "fids": fids[go], "vals": vals[go], "counts": counts[go]})

    return run


def _ranked(groups: np.ndarray) -> np.ndarray:
    if not len(groups):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _assemble(buckets: int, least: float, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for field, (ids, fids, vals, counts) in _by_field(batches, ["ids", "fids", "vals", "counts"]):
            order = np.lexsort((fids, ids))
            ids, fids, vals, counts = ids[order], fids[order], vals[order], counts[order].astype(np.int64)
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            n = len(start)
            counts = np.where(counts < 0, np.maximum(2, -counts * n * buckets // 1_000_000), counts)
            row = np.repeat(np.arange(n), np.diff(np.r_[start, len(ids)]))
            shared = np.bincount(row, vals * vals, n)
            live = shared >= least * least - 1e-6  # a cosine never exceeds the norm of the shared entries
            go = live[row]
            key, ids, fids, vals, counts = ids[start][live], ids[go], fids[go], vals[go], counts[go]
            whole = shared[live] >= 1 - 1e-9  # only a vector without entries of its own can have copies
            n = len(key)
            if not n:
                continue
            row = (np.cumsum(live) - 1)[row[go]]
            lengths = np.bincount(row, minlength=n)
            starts = np.cumsum(lengths) - lengths
            entry = mix64(fids, 17) ^ mix64(np.round(vals * 1e10).astype(np.int64), 19)
            hashes = [np.add.reduceat(mix64(entry.view(np.int64), s), starts).view(np.int64) for s in (23, 29)]

            score = np.abs(vals) / np.sqrt(np.sqrt(counts))
            order = np.lexsort((fids, -score, row))
            top = order[_ranked(row[order]) < features]
            of, f, light = row[top], fids[top], counts[top] <= LIGHT
            label = mix64(f, 31).view(np.int64)
            anchor = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(anchor, of[light], label[light])

            def lists(at, what):
                return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of[at], minlength=n))].astype(np.int32)), pa.array(what[at]))

            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [pa.array([field] * n, pa.string()), pa.array(key), pa.ListArray.from_arrays(offsets, pa.array(fids)), pa.ListArray.from_arrays(offsets, pa.array(vals)),
                 *[pa.array(h, mask=~whole) for h in hashes], lists(light, f), pa.array(anchor), lists(~light, label)],
                names=["field_name", "id", "fids", "vals", "h1", "h2", "light", "anchor", "own"],
            )
            for lo in range(0, n, 8192):
                yield out.slice(lo, 8192)

    return run


def shared_units(vectors: DataFrame, least: float = 0.0, features: int = 3) -> DataFrame:
    """Unit vectors without the entries that no other vector of the field holds, and what routes and identifies them.

    ``vectors`` is ``(field_name, id, fids, vals)``, one row per vector, fids distinct, values finite and not zero.  ``vals``
    become parts of the unit vector, so the products of two rows are exact cosines.  Vectors whose shared entries have a norm
    below ``least`` reach that cosine with nobody and are left out; no other is.

    ``h1, h2`` are equal for identical unit vectors and null where there can be none.  A vector is routed by the ``features``
    entries of highest |value| / holders^(1/4): ``light`` has the fids of up to ``LIGHT`` holders, ``anchor`` the least hash of those, ``own``
    the hashes of the others.  Holders are counted exactly; those of hot features are estimated from their share.
    """
    buckets = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = vectors.select(F.col("field_name").cast("string").alias("field_name"), F.col("id").cast("bigint").alias("id"), F.col("fids").cast("array<bigint>").alias("fids"), F.col("vals").cast("array<double>").alias("vals"))
    sent = plain.mapInArrow(_to_features(buckets), BLOCK).repartitionById(buckets, "bucket")
    counted = sent.mapInArrow(_count_holders(buckets), BLOCK).repartitionById(buckets, "bucket")
    return counted.mapInArrow(_assemble(buckets, least, features), UNIT)


def classes_of_copies(units: DataFrame, total: int) -> DataFrame:
    """``(field_name, rep, id, n)`` of every vector that has n > 1 copies; ``rep`` is the smallest id of its class.

    Only hashes are shuffled; a class may hold any share of the rows.
    """
    keyed = units.where("h1 is not null").select("field_name", "id", "h1", "h2")
    classes = keyed.groupBy("field_name", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keep(salted_lookup(keyed, classes, ["field_name", "h1", "h2"], "n", max(total, 1), "inner").select("field_name", "rep", "id", "n"))


def _to_light(buckets: int):
    """Light features with their vector's anchor, to the bucket of the feature; names of a vector's own, to that of the vector."""

    def send(field: str, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, anchor = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("id", "anchor"))
        light, own = (np.concatenate([p[c].value_lengths().to_numpy() for p in parts]) for c in ("light", "own"))
        fids, names = (np.concatenate([_flat(p, c) for p in parts]) for c in ("light", "own"))
        own_ids = np.repeat(ids, own)
        bucket = np.r_[mix64(fids, 11) % np.uint64(buckets), mix64(own_ids, 5) % np.uint64(buckets)].astype(np.int64)
        columns = {"ids": np.r_[np.repeat(ids, light), own_ids], "fids": np.r_[fids, np.zeros(len(names), np.int64)], "names": np.r_[np.repeat(anchor, light), names]}
        return _blocks(field, bucket, columns | {"counts": np.repeat([1, 0], [len(fids), len(names)])})

    return _in_chunks(send, ["light", "own"])


def _name(buckets: int):
    """Names of vectors, to the bucket of the vector: a light feature's is the least anchor of its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for field, (ids, fids, names, counts) in _by_field(batches, ["ids", "fids", "names", "counts"]):
            light = counts > 0
            seen, code = np.unique(fids[light], return_inverse=True)
            least = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(least, code, names[light])
            names = names.copy()
            names[light] = least[code]
            yield from _blocks(field, (mix64(ids, 5) % np.uint64(buckets)).astype(np.int64), {"ids": ids, "names": names})

    return run


def _collect_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for field, (ids, names) in _by_field(batches, ["ids", "names"]):
        order = np.lexsort((names, ids))
        ids, names = ids[order], names[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])]
        ids, names = ids[new], names[new]
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(ids)].astype(np.int32)), pa.array(names))
        out = pa.RecordBatch.from_arrays([pa.array([field] * len(start), pa.string()), pa.array(ids[start]), lists], names=["field_name", "id", "names"])
        for lo in range(0, len(start), 8192):
            yield out.slice(lo, 8192)


TASK = ["field_name", "shard", "first", "second"]


def route(units: DataFrame, members: DataFrame, total: int, shard_rows: int) -> DataFrame:
    """Send every representative of ``units`` (kept) to the shards of its routing features.

    Light features that occur beside each other in a vector take the name of the least of them, so the vectors of one neighbourhood
    mostly go to one shard together instead of to one per feature.  Names share shards of about ``shard_rows``.  A shard above
    twice ``shard_rows`` is divided into parts of which every two meet, so that no task grows and no pair that shares a
    name is lost; the tasks of such a shard grow as the square of its parts.

    Returns ``(field_name, shard, first, second, asks, id, fids, vals)``; rows of part ``second`` ask those of ``first``.
    """
    buckets = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spare = members.where("id <> rep").select("field_name", "id")
    rows = units.select("field_name", "id", "light", "anchor", "own").join(spare, ["field_name", "id"], "left_anti")
    sent = rows.mapInArrow(_to_light(buckets), _schema("ids", "fids", "names", "counts")).repartitionById(buckets, "bucket")
    named = sent.mapInArrow(_name(buckets), _schema("ids", "names")).repartitionById(buckets, "bucket")
    chosen = keep(named.mapInArrow(_collect_names, "field_name string, id bigint, names array<bigint>"))
    count = chosen.agg(F.sum(F.size("names"))).first()[0] or 0
    shards = max(1, -(-count // shard_rows))
    shard = F.transform("names", lambda name: F.pmod(F.xxhash64("field_name", name), F.lit(shards)).cast("int"))
    chosen = chosen.select("field_name", "id", F.explode(F.array_distinct(shard)).alias("shard"))
    sizes = chosen.groupBy("field_name", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard_rows)  # at most one line for so many rows
    parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / (2 * shard_rows)).cast("int")
    placed = chosen.join(F.broadcast(sizes), ["field_name", "shard"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    meets = placed.select("field_name", "shard", "id", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    first, second = F.least("part", "other"), F.greatest("part", "other")
    meets = meets.select("field_name", "shard", "id", first.alias("first"), second.alias("second"), (F.col("part") > F.col("other")).alias("asks"))
    routed = meets.join(units.select("field_name", "id", "fids", "vals"), ["field_name", "id"])
    tasks = min(shards, 8 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return routed.repartition(tasks, *TASK)  # a stated number, as tasks are long for their bytes and must not be merged
