"""Problem 3: records that hold nearly the same terms, by a blocked sparse product of the record-by-term incidence matrix.

With terms from rare to frequent, two sets above the threshold share one among the first few of both, so the product begins with those
entries.  A task holds the postings of a slice of terms and multiplies that slice with its transpose: it accumulates overlap counts by pair and
discards pairs that their sizes, or the places of the shared term, rule out.  Counts of all slices are added, pairs are discarded again by
what their overlap could still become, and the product is completed for those that remain.  A term held by too many records is divided by
the next shared term, as often as needed and as long as every pair above the threshold shares so many, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.records import bucket_counts, bucket_of_numpy
from graphloom.operators.skew import hashed_key, salted_lookup, with_key_counts
from graphloom.store import keep

COUNT_BITS = 22
#: Records that may share a block of the product; larger ones are divided by a further term.  Records that share more terms
#: are likelier pairs, so every further term allows a block GROWTH times as large.
BLOCK_ROWS, GROWTH = 64, 4
LONGEST_KEY = 6
#: Postings of a task, and records of one term that meet those of another part of it in one task.
SLICE_ROWS, PART_ROWS = 100_000, 2_048
_PRODUCT = "field_name string, id_a bigint, id_b bigint, c bigint, la int, lb int, na int, nb int, t double, divided boolean"


def _rare_first(counts):
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.arange(batch.num_rows)
            lengths = batch["toks"].value_lengths().to_numpy()
            toks = batch["toks"].flatten().to_numpy()
            of = np.repeat(at, lengths)
            toks = toks[np.lexsort((toks, known[bucket_of_numpy(toks, COUNT_BITS)], of))]
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["field_name"], batch["id"], pa.ListArray.from_arrays(offsets, pa.array(toks)), batch["t"]], names=["field_name", "id", "toks", "t"])

    return order


def near_duplicates(sets: DataFrame, least_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Pairs between representatives, and membership in classes of equal sets.

    ``sets`` is ``(field_name, id, toks array<bigint>, t)``: distinct terms and the least share of the union.  Returns
    ``(field_name, id_a, id_b, share)`` with id_a < id_b, each the smallest id of its set, and ``(field_name, rep, id, n)`` for
    every record whose set occurs n > 1 times.

    Sets under ``least_size`` and null sets take no part; shares are exact, rounded to 6 decimals; records of different fields
    never meet; an empty table gives none.
    """
    spark = sets.sparkSession
    sets = keep(sets.where(F.size("toks") >= least_size).select("field_name", "id", "toks", "t"))
    total = sets.count()
    keyed = sets.select("field_name", "id", *hashed_key(F.array_sort("toks")))
    classes = keyed.groupBy("field_name", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(salted_lookup(keyed, classes, ["field_name", "h1", "h2"], "n", max(total, 1), "inner").select("field_name", "rep", "id", "n"))
    counts = spark.sparkContext.broadcast(bucket_counts(sets.select(F.explode("toks").alias("tok")), "tok", COUNT_BITS).astype(np.int32))
    ordered = sets.mapInArrow(_rare_first(counts), "field_name string, id bigint, toks array<bigint>, t double")
    ordered = keep(ordered.join(members.where("id <> rep").select("field_name", "id"), ["field_name", "id"], "left_anti"))

    n = F.size("toks")
    prefix = (n - F.ceil(F.col("t") * n - 1e-9) + 1).cast("int")
    shared = F.ceil(F.col("t") / (1 + F.col("t")) * (n + F.ceil(F.col("t") * n - 1e-9)) - 1e-6)  # terms that a pair of this record shares at least
    longest = max(1, min(LONGEST_KEY, ordered.agg(F.min(shared)).first()[0] or 1))
    keys = ordered.select("field_name", "id", n.alias("n"), "t", F.posexplode(F.slice("toks", F.lit(1), prefix)).alias("pos", "key"))
    postings = None
    for length in range(1, longest + 1):
        counted = with_key_counts(keys, ["field_name", "key"], max(1, total * 5), "block", least=2)
        last = length == longest
        counted = keep(counted) if not last else counted
        most = BLOCK_ROWS * GROWTH ** (length - 1)
        part = (counted if last else counted.where(F.col("block") <= most)).select("field_name", "key", "id", "n", "pos", "t", "block", F.lit(length).alias("length"))
        postings = part if postings is None else postings.unionByName(part)
        large = counted.where(F.col("block") > most)
        if last or large.limit(1).count() == 0:
            break
        more = F.slice("toks", F.col("pos") + 2, F.greatest(F.lit(0), prefix + length - F.col("pos") - 1))
        longer = large.drop("t", "n").join(ordered, ["field_name", "id"]).select("field_name", "id", n.alias("n"), "t", "pos", "key", F.posexplode(more).alias("step", "tok"))
        keys = longer.select("field_name", "id", "n", "t", (F.col("pos") + 1 + F.col("step")).alias("pos"), F.xxhash64("key", "tok").alias("key"))
    counted = _product(postings, max(1, total * 5 // SLICE_ROWS)).groupBy("field_name", "id_a", "id_b").agg(
        F.sum("c").alias("c"), F.max("la").alias("la"), F.max("lb").alias("lb"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("t").alias("t"), F.bool_or("divided").alias("divided")
    )
    need = F.ceil(F.col("t") / (1 + F.col("t")) * (F.col("na") + F.col("nb")) - 1e-6)
    possible = F.col("c") + F.least(F.col("na") - F.col("la"), F.col("nb") - F.col("lb")) - 1  # after the last shared place either set may hold only shared terms
    pairs = counted.where(F.col("divided") | (possible >= need)).select("field_name", "id_a", "id_b")
    a = ordered.select("field_name", F.col("id").alias("id_a"), F.col("toks").alias("ta"), "t")
    b = ordered.select("field_name", F.col("id").alias("id_b"), F.col("toks").alias("tb"))
    both = pairs.join(a, ["field_name", "id_a"]).join(b, ["field_name", "id_b"])
    overlap = F.size(F.array_intersect("ta", "tb"))
    share = F.round(overlap / (F.size("ta") + F.size("tb") - overlap), 6)
    found = both.withColumn("share", share).where("share >= t").select("field_name", "id_a", "id_b", "share")
    return found, members


def _product(postings: DataFrame, slices: int) -> DataFrame:
    """Overlap counts of the pairs that a slice of terms gives; a term with many records is multiplied part against part."""
    parts = F.ceil(F.col("block") / PART_ROWS).cast("int")
    placed = postings.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    slice_ = F.when(F.col("parts") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(slices)))
    met = met.select("field_name", "key", "id", "n", "pos", "t", "length", "part", slice_.alias("slice"), F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    return met.groupBy("slice", "x", "y").applyInArrow(_slice_product, _PRODUCT)


def _slice_product(t: pa.Table) -> pa.Table:
    names = t["field_name"].combine_chunks().dictionary_encode()
    field, (key, id_, n, pos, share, length, part) = names.indices.to_numpy(), (t[c].to_numpy() for c in ("key", "id", "n", "pos", "t", "length", "part"))
    order = np.lexsort((id_, key, length, field))
    field, key, id_, n, pos, share, length, part = (c[order] for c in (field, key, id_, n.astype(np.int64), pos.astype(np.int64), share, length, part))
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (field[1:] != field[:-1]) | (length[1:] != length[:-1])])
    sizes = np.diff(np.r_[starts, len(key)])
    across = t["x"][0].as_py() != t["y"][0].as_py()
    lefts, rights = [], []
    for m in np.unique(sizes):
        if m < 2:
            continue
        i, j = np.triu_indices(m, 1)
        step = max(1, 1_000_000 // len(i))
        blocks = starts[sizes == m]
        for lo in range(0, len(blocks), step):
            at = blocks[lo : lo + step, None]
            a, b = (at + i).ravel(), (at + j).ravel()
            need = np.ceil(share[a] / (1 + share[a]) * (n[a] + n[b]) - 1e-6)
            ok = (np.minimum(n[a], n[b]) >= share[a] * np.maximum(n[a], n[b]) - 1e-6) & (length[a] + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1 >= need)
            ok &= id_[a] != id_[b]
            if across:
                ok &= part[a] != part[b]
            lefts.append(a[ok])
            rights.append(b[ok])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *lefts]), np.concatenate([none, *rights])
    order = np.lexsort((id_[b], id_[a], field[a]))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (id_[a][1:] != id_[a][:-1]) | (id_[b][1:] != id_[b][:-1]) | (field[a][1:] != field[a][:-1])
    first = np.flatnonzero(new)
    plain = (length[a] == 1).astype(np.int64)
    gather = lambda f, v: f.reduceat(v, first) if len(first) else v
    p, q = a[first], b[first]
    columns = [names.dictionary.take(pa.array(field[p])).cast(pa.string()), id_[p], id_[q], gather(np.add, plain), gather(np.maximum, pos[a]).astype(np.int32), gather(np.maximum, pos[b]).astype(np.int32), n[p].astype(np.int32), n[q].astype(np.int32), share[p], gather(np.minimum, plain) == 0]
    return pa.table([pa.array(c) for c in columns], ["field_name", "id_a", "id_b", "c", "la", "lb", "na", "nb", "t", "divided"])


def all_pairs(found: DataFrame, members: DataFrame) -> DataFrame:
    """``(field_name, id_a, id_b)`` with every copy of both ends, and pairs of copies; each row once."""
    left = members.select("field_name", F.col("rep").alias("id_a"), F.col("id").alias("ia"))
    right = members.select("field_name", F.col("rep").alias("id_b"), F.col("id").alias("ib"))
    wide = found.select("field_name", "id_a", "id_b").join(left, ["field_name", "id_a"], "left").join(right, ["field_name", "id_b"], "left")
    wide = wide.select("field_name", F.coalesce("ia", "id_a").alias("a"), F.coalesce("ib", "id_b").alias("b"))
    same = members.select("field_name", "rep", F.col("id").alias("a")).join(members.select("field_name", "rep", F.col("id").alias("b")), ["field_name", "rep"]).where("a < b")
    every = wide.unionByName(same.select("field_name", "a", "b"))
    return every.select("field_name", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def instance_sets(vectors: DataFrame, share: float = 0.8) -> DataFrame:
    return vectors.select("field_name", "id", F.col("fids").alias("toks"), F.lit(share).alias("t"))


def word_sets(nodes: DataFrame, field: str, share: float = 0.75) -> DataFrame:
    """The set of (attribute, word) of every current node; words are runs of letters and digits in lower case."""
    pairs = nodes.select("nid", F.explode("m_discrete").alias("attr", "value"))
    words = pairs.select("nid", "attr", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))).alias("word"))
    tokens = words.groupBy("nid").agg(F.collect_set(F.xxhash64("attr", "word")).alias("toks"))
    return tokens.select(F.lit(field).alias("field_name"), F.col("nid").alias("id"), "toks", F.lit(share).alias("t"))
