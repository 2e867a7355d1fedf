"""Order statistics and summaries as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_statistic(values: Column, q: float) -> Column:
    """The element at 0-based place ceil(n q) of an array in ascending order, the last if past the end; null if empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(F.ceil(n * F.lit(q)).cast("int") + 1, n)))


def grouped_order_statistic(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Order statistics per group by rank, so a group of any size is sorted on disk and never gathered."""
    from pyspark.sql import Window

    known = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    ranked = known.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)))
    place = lambda q: F.least(F.ceil(F.col("_n") * F.lit(q)) + 1, F.col("_n"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == place(q), F.col(value))).alias(name) for name, q in qs.items()])


def summary(rows: DataFrame, keys: list[str], value: str, missing: float = -1.0) -> DataFrame:
    """num, sum, avg, sd, min, q05, q25, q50, q75, q95, max per group, after values equal to ``missing`` are left out."""
    kept = rows.where(F.col(value) != missing)
    plain = kept.groupBy(*keys).agg(F.count(value).alias("num"), F.sum(value).alias("sum"), F.avg(value).alias("avg"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return plain.join(grouped_order_statistic(kept, keys, value, {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}), keys)


def median_absolute_difference(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median of absolute differences from the median, both by ``order_statistic``."""
    middle = grouped_order_statistic(rows, keys, value, {"m": 0.5})
    apart = rows.join(middle, keys).withColumn("_a", F.abs(F.col(value) - F.col("m")))
    return grouped_order_statistic(apart, keys, "_a", {"mad": 0.5})


def product(value: Column | str) -> Column:
    """Product of a column of non-negative numbers."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.min(c) == 0, 0.0).otherwise(F.exp(F.sum(F.when(c > 0, F.log(c)))))
