"""Problem 7: mix sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.store import keep

LEVELS = 4096


def source_key(source: str | Column) -> Column:
    """A source's name without case, outer blanks or a choice of separator."""
    column = F.col(source) if isinstance(source, str) else source
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_\-]+", "_")


def poisson_steps(mean: float, cap: int) -> np.ndarray:
    """P(X <= j) for j below ``cap``; a uniform number above step j means more than j copies."""
    j = np.arange(cap)
    return np.cumsum(np.exp(j * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in j])))


def solve_mean(level: np.ndarray, tokens: np.ndarray, cap: int, target: float) -> np.ndarray:
    """Steps of the Poisson mean whose capped copies of these tokens come nearest to ``target``.

    Copies never fall as the mean grows, because every document keeps its uniform number; so the mean is found by bisection on the
    tokens that it really yields.
    """
    u = (level + 0.5) / LEVELS
    total = tokens.sum()
    if target >= cap * total:
        return np.full(cap, -1.0)

    def made(log_mean: float) -> tuple[float, np.ndarray]:
        steps = poisson_steps(math.exp(log_mean), cap)
        return float((tokens * (u[:, None] > steps[None, :]).sum(1)).sum()), steps

    low, high = -16.0, 7.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if made(middle)[0] < target else (low, middle)
    return min((made(low), made(high)), key=lambda m: abs(m[0] - target))[1]


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None) -> DataFrame:
    """``(shuffle_key, doc_id, source, copy, n_tokens)``: the mixture in its global random order; texts are joined by ``doc_id``.

    ``documents`` has ``doc_id, source, n_tokens``; ``targets`` is a short table ``(source, target_share, max_repeats)``.  Every document
    of a target source gets a hash-seeded uniform number and as many copies as the inverted Poisson distribution of the source's mean
    gives, at most ``max_repeats``.  The mean meets the target in the tokens really made.

    * the size is ``total_tokens``, or by default that of all documents of the target sources; a source that can't reach its part of
      that with ``max_repeats`` of every record stays at its cap, and ``share_report`` gives the shares then reached;
    * shares are taken over the target sources that have tokens; others cannot contribute and are reported with 0;
    * documents of other or no sources, and of no tokens, are not used;
    * targets with a null or non-positive share or cap take nothing; of repeated targets of one source the largest share holds.
    """
    spark = documents.sparkSession
    goals = {}
    for name, share, cap in targets.select(source_key("source"), "target_share", "max_repeats").collect():
        if name is not None and share and share > 0 and cap and cap > 0 and share > goals.get(name, (0, 0))[0]:
            goals[name] = (float(share), int(cap))
    schema = "shuffle_key bigint, doc_id bigint, source string, copy int, n_tokens bigint"
    if not goals:
        return spark.createDataFrame([], schema)
    level = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(LEVELS)).cast("int")
    own = keep(documents.select("doc_id", source_key("source").alias("source"), "n_tokens", level.alias("level")).where(F.col("source").isin(sorted(goals)) & (F.col("n_tokens") > 0)))
    levels = own.groupBy("source", "level").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # at most LEVELS lines a target source
    present = {s: rows for s, rows in levels.groupby("source")}
    if not present:
        return spark.createDataFrame([], schema)
    whole = sum(goals[s][0] for s in present)
    size = float(total_tokens if total_tokens is not None else levels.tokens.sum())
    steps = {s: solve_mean(rows.level.to_numpy(), rows.tokens.to_numpy(), goals[s][1], size * goals[s][0] / whole) for s, rows in present.items()}
    table = F.create_map(*[x for s, p in sorted(steps.items()) for x in (F.lit(s), F.array(*[F.lit(float(v)) for v in p]))])
    u = (F.col("level") + 0.5) / LEVELS
    copies = F.size(F.filter(table[F.col("source")], lambda p: u > p))
    each = own.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.xxhash64("doc_id", "copy", F.lit(seed)).alias("shuffle_key")
    return each.select(key, "doc_id", "source", "copy", "n_tokens").orderBy("shuffle_key", "doc_id", "copy")


def mixture_checks(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, records_over_cap, copies_out_of_line, strangers)`` of every target source; all 0 in a sound mixture.

    Records used more than ``max_repeats`` times, records whose copies aren't numbered 1, 2, ..., and rows of sources without a target.
    """
    goal = targets.select(source_key("source").alias("source"), "max_repeats")
    used = keep(mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("last"), F.countDistinct("copy").alias("kinds")))
    per = used.join(F.broadcast(goal), "source").groupBy("source").agg(F.sum((F.col("n") > F.col("max_repeats")).cast("bigint")).alias("over"), F.sum(((F.col("n") != F.col("last")) | (F.col("n") != F.col("kinds"))).cast("bigint")).alias("odd"))
    strange = used.join(F.broadcast(goal), "source", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    return goal.select("source").distinct().join(per, "source", "left").join(strange, F.lit(True)).select("source", F.coalesce("over", F.lit(0)).alias("records_over_cap"), F.coalesce("odd", F.lit(0)).alias("copies_out_of_line"), "strangers")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, documents, copies, most, tokens, reached_share)`` of every target source."""
    mixed = keep(mixed.select("source", "doc_id", "copy", "n_tokens"))
    total = mixed.agg(F.sum("n_tokens")).first()[0] or 0
    made = mixed.groupBy("source").agg(F.sum((F.col("copy") == 1).cast("bigint")).alias("documents"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most"), F.sum("n_tokens").alias("tokens"))
    goal = targets.select(source_key("source").alias("source"), "target_share", "max_repeats")
    joined = F.broadcast(goal).join(made, "source", "left").na.fill(0, ["documents", "copies", "most", "tokens"])
    return joined.withColumn("reached_share", F.round(F.col("tokens") / F.lit(float(max(total, 1))), 6))
