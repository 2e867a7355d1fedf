"""Joins and counts that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it has more than 1/HEAVY of all rows, so there are fewer than HEAVY heavy keys at any size.
HEAVY = 10_000


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` to ``table`` (one line per key; ``weight`` = rows having the key), spreading heavy keys.

    Lines of heavy keys are broadcast: fewer than ``HEAVY`` by definition.  Rows of heavy keys then carry a salt that
    matches nothing, so the shuffle join of the rest spreads them evenly.
    """
    limit = max(1, total // HEAVY)
    values = [c for c in table.columns if c not in keys]
    heavy = table.where(F.col(weight) > limit).select(*keys, *(F.col(v).alias(f"_h_{v}") for v in values))
    light = table.where(F.col(weight) <= limit).withColumn("_salt", F.lit(0)).withColumn("_light", F.lit(True))
    marked = rows.join(F.broadcast(heavy), keys, "left")
    is_heavy = F.col(f"_h_{weight}").isNotNull()
    salt = F.when(is_heavy, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).otherwise(0).cast("int")
    joined = marked.withColumn("_salt", salt).join(light, [*keys, "_salt"], "left")
    if how == "inner":
        joined = joined.where(is_heavy | F.col("_light"))
    picked = [F.when(is_heavy, F.col(f"_h_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return joined.select(*rows.columns, *picked)


def with_key_counts(rows: DataFrame, keys: list[str], total: int, name: str = "n", least: int = 1) -> DataFrame:
    """``rows`` with the number of rows that have the same keys; rows of rarer keys than ``least`` are left out."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) >= least)
    return salted_lookup(rows, counts, keys, name, total, "inner" if least > 1 else "left")


def unsent(table: DataFrame) -> DataFrame:
    """``table`` for a join that must not send it, or its other side, to every executor.

    Tables of few distinct values are much smaller as files than as rows, and Spark estimates a scan by its files, so it would gather millions
    of rows in the driver to broadcast them.
    """
    return table.hint("merge")


def hashed_key(*columns: Column | str) -> list[Column]:
    """A 128-bit key of the columns; two different rows share one with a chance below 1e-18 at 1e10 rows."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(*columns, F.lit(0x5BD1E995)).alias("h2")]
