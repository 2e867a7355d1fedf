"""Streaming counterparts of the online actions: scoring, features and bucket counts of arriving instances.

Scoring keeps no state: a micro-batch is scored as a table.  Bucket counts are kept per batch, so that a batch that runs again replaces its own part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators import learning, lsh


def long_form(packed: DataFrame) -> DataFrame:
    """``(gid, fid, value)`` of rows ``(gid, fids, vals)``."""
    return packed.select("gid", F.explode(F.arrays_zip("fids", "vals")).alias("e")).select("gid", F.col("e.fids").alias("fid"), F.col("e.vals").alias("value"))


def per_batch(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``make(batch)`` to ``path/batch=<id>`` for every micro-batch; running a batch again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, model: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Margins and predictions of arriving packed instances."""
    return per_batch(stream, lambda b: learning.predict(long_form(b), model), path, checkpoint)


def count_buckets(stream: DataFrame, path: str, checkpoint: str, functions: int = lsh.FUNCTIONS, repeats: int = lsh.REPEATS) -> StreamingQuery:
    """Bucket counts of arriving instances, per batch; ``bucket_totals`` adds them."""
    counted = lambda b: lsh.signatures(long_form(b), functions, repeats).groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_batch(stream, counted, path, checkpoint)


def bucket_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("slot", "key").agg(F.sum("n").alias("n"))


def online_features(stream: DataFrame, featurise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Features of arriving graphs or texts; an instance must arrive within one batch."""
    return per_batch(stream, featurise, path, checkpoint)
