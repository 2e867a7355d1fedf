"""Problem 5: the frequency of every distinct value, from compressed bitmaps of record ids per term."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from graphloom.operators.nodes import profile_entries

BITS = 15
#: Ids from which a bitmap of 2^15 bits is no larger than a list of 16-bit ids (fixed by the two layouts).
DENSE = 2048


@pandas_udf(BinaryType())
def container_of(ids: pd.Series) -> pd.Series:
    """A container of low id bits: byte 0 and a sorted 16-bit list, or byte 1 and a bitmap of 4096 bytes."""

    def pack(low) -> bytes:
        low = np.unique(np.asarray(low, np.uint16))
        if len(low) < DENSE:
            return b"\0" + low.astype("<u2").tobytes()
        bits = np.zeros(1 << BITS, np.uint8)
        bits[low] = 1
        return b"\1" + np.packbits(bits, bitorder="little").tobytes()

    return ids.map(pack)


@pandas_udf(ArrayType(IntegerType()))
def ids_of(container: pd.Series) -> pd.Series:
    """The low id bits that a container holds, ascending."""

    def unpack(c: bytes):
        if c[0] == 0:
            return np.frombuffer(c, "<u2", offset=1).astype(np.int32)
        return np.flatnonzero(np.unpackbits(np.frombuffer(c, np.uint8, offset=1), bitorder="little")).astype(np.int32)

    return container.map(unpack)


def cardinality(container: str = "container"):
    """Ids in a container, from its length or its set bits; nothing is unpacked."""
    c = F.col(container)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\0"), (F.length(c) - 1) / 2).otherwise(F.bitmap_count(F.expr(f"substring({container}, 2)"))).cast("bigint")


def postings(entries: DataFrame) -> DataFrame:
    """``(field_name, attr, term, bucket, container, occurrences)`` of ``(field_name, attr, term, record_id, occurrences)``.

    Ids are divided into buckets of 2^15, so a term held by any share of the records spreads over all buckets and
    no group exceeds one bucket.  Repeated (term, record) rows unite; negative ids have their own buckets.
    """
    bucket = F.shiftright("record_id", BITS).alias("bucket")
    low = F.col("record_id").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    grouped = entries.groupBy("field_name", "attr", "term", bucket).agg(F.collect_set(low).alias("low"), F.sum("occurrences").alias("occurrences"))
    return grouped.select("field_name", "attr", "term", "bucket", container_of("low").alias("container"), "occurrences")


def union_postings(*tables: DataFrame) -> DataFrame:
    """The union of postings of the same shape: containers unite per bucket and occurrences add."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    keys = ["field_name", "attr", "term", "bucket"]
    low = every.select(*keys, F.explode(ids_of("container")).alias("low"))
    ids = low.groupBy(*keys).agg(F.collect_set("low").alias("low"))
    return ids.join(every.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences")), keys).select(*keys, container_of("low").alias("container"), "occurrences")


def term_frequencies(index: DataFrame, holders: DataFrame, rare: int = 2, common: float = 0.4) -> DataFrame:
    """``(field_name, attr, term, records, occurrences, mark)`` of every term in postings ``index``.

    ``records`` is the cardinality of the term's bitmaps.  ``mark`` is ``rare`` up to ``rare`` records, ``common`` above the share
    ``common`` of the records that have the field (``holders``: a line ``(field_name, holders)`` per field), else ``useful``;
    a term that is both is ``rare``.
    """
    totals = index.groupBy("field_name", "attr", "term").agg(F.sum(cardinality()).alias("records"), F.sum("occurrences").alias("occurrences"))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * F.col("holders"), "common").otherwise("useful")
    return totals.join(F.broadcast(holders), "field_name").select("field_name", "attr", "term", "records", "occurrences", mark.alias("mark"))


#: The attributes of ``m_discrete`` whose values are counted (fixed by the problem).
ATTRIBUTES = ["label", "role", "origin", "tissue"]


def node_entries(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of current nodes for ``postings`` and the holders of each field.

    Values are compared in lower case, trimmed, each run of blanks as one; empty and null values are no terms.  Fids of
    ``profile`` are written in decimal digits; null and zero entries are not held, repeated ones count as occurrences.
    """
    wanted = F.map_filter("m_discrete", lambda k, v: k.isin(ATTRIBUTES) & v.isNotNull())
    values = nodes.select("nid", F.explode(wanted).alias("attr", "value"))
    term = F.trim(F.regexp_replace(F.lower("value"), r"[\s ]+", " "))
    discrete = values.select(F.lit("m_discrete").alias("field_name"), "attr", term.alias("term"), F.col("nid").alias("record_id"), F.lit(1).cast("bigint").alias("occurrences")).where("term <> ''")
    vector = profile_entries(nodes).select(F.lit("m_svector").alias("field_name"), F.lit("profile").alias("attr"), F.col("fid").cast("string").alias("term"), F.col("nid").alias("record_id"), "occurrences")
    held = nodes.agg(F.count("m_discrete").alias("d"), F.count(F.col("m_svector")["profile"]).alias("s"))
    holders = held.select(F.explode(F.create_map(F.lit("m_discrete"), F.col("d"), F.lit("m_svector"), F.col("s"))).alias("field_name", "holders"))
    return discrete.unionByName(vector), holders
