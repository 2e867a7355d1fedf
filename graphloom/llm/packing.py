"""Problem 6: fill containers of fixed capacity with texts, splitting only texts larger than a container.

Only the histogram of sizes reaches the driver; its length is bounded by the capacity.  Shallow combinations of sizes
that fill the container are enumerated over size bins, their repeat counts solved by non-negative least squares against
the histogram and rounded down to what is there; gaps and the remaining sizes are packed greedily.  The plan is a list
of (combination, repeats); texts find their container by size and ordinal, without meeting each other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.store import keep

BINS, STEPS, SALTS = 128, 200, 256


def combinations(bins: np.ndarray, full: int) -> np.ndarray:
    """Rows of up to three of ``bins``, descending and padded with 0, that add up to ``full``."""
    held = np.zeros(full + 1, bool)
    held[bins[bins <= full]] = True
    rows = [np.array([[full, 0, 0]])] if held[full] else []
    have = np.flatnonzero(held)
    two = have[(have * 2 >= full) & (have < full)]
    two = two[held[full - two]]
    rows.append(np.c_[two, full - two, np.zeros(len(two), int)])
    a, b = np.meshgrid(have, have, indexing="ij")
    c = full - a - b
    ok = (a >= b) & (c > 0) & (b >= c)
    ok[ok] = held[c[ok]]
    rows.append(np.c_[a[ok], b[ok], c[ok]])
    return np.concatenate(rows).astype(np.int64)


def solve_repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative x that brings the sizes used by ``combos`` near ``histogram`` in least squares.

    Multiplicative steps x <- x A'h / A'Ax keep x non-negative and never raise the error; A has at most three entries a
    column, so a step is two gathers and a count.
    """
    if not len(combos):
        return np.zeros(0)
    target = histogram.astype(float).copy()
    target[0] = 0
    use = combos > 0
    x = np.full(len(combos), max(target.sum(), 1) / (3 * len(combos)))
    for _ in range(steps):
        made = np.bincount(combos[use], np.broadcast_to(x[:, None], combos.shape)[use], len(target))
        up, down = (target[combos] * use).sum(1), (made[combos] * use).sum(1)
        x = x * up / np.maximum(down, 1e-12)
    return x


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """``([(size, items), ...], containers)``: which sizes share a container, and how many containers look so."""
    left = {int(s): int(c) for s, c in zip(sizes, counts) if c > 0}
    width = max(1, -(-capacity // BINS))
    full = capacity // width
    binned = -(-np.array(sorted(left), dtype=np.int64) // width)
    by_bin: dict[int, list[int]] = {}
    for s, b in zip(sorted(left), binned):
        by_bin.setdefault(int(b), []).append(s)  # the largest last
    histogram = np.zeros(full + 2, np.int64)
    for b, members in by_bin.items():
        if b <= full:
            histogram[b] = sum(left[s] for s in members)
    combos = combinations(np.array([b for b in by_bin if b <= full], dtype=np.int64), full)
    repeats = solve_repeats(combos, histogram)
    open_runs: list[tuple[list[int], int]] = []
    for at in np.argsort(-repeats, kind="stable"):
        want = int(repeats[at] + 0.5)
        if want < 1:
            break
        parts = [int(b) for b in combos[at] if b]
        while want > 0:
            chosen, need = [], {}
            for b in parts:
                pool = by_bin[b]
                i = len(pool) - 1
                while i >= 0 and left[pool[i]] - need.get(pool[i], 0) < 1:
                    i -= 1
                if i < 0:
                    break
                chosen.append(pool[i])
                need[pool[i]] = need.get(pool[i], 0) + 1
            if len(chosen) < len(parts):
                break
            times = min(want, *(left[s] // n for s, n in need.items()))
            for s, n in need.items():
                left[s] -= n * times
            want -= times
            open_runs.append((chosen, times))
    order = [s for s in sorted(left) if left[s] > 0]
    done: list[tuple[list[tuple[int, int]], int]] = []

    def largest(limit: int) -> int | None:
        i = bisect_right(order, limit) - 1
        return order[i] if i >= 0 else None

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            order.pop(bisect_right(order, s) - 1)

    def fill(items: dict[int, int], times: int) -> None:
        """Give each of ``times`` equal containers the largest sizes that still fit, dividing the run when one runs out."""
        work = [(items, times)]
        while work:
            have, times = work.pop()
            gap = capacity - sum(s * n for s, n in have.items())
            s = largest(gap) if gap else None
            if s is None:
                done.append((sorted(have.items()), times))
                continue
            if left[s] >= times:
                n = min(gap // s, left[s] // times)
                take(s, n * times)
                work.append((have | {s: have.get(s, 0) + n}, times))
            else:
                some = left[s]
                take(s, some)
                work += [(have, times - some), (have | {s: have.get(s, 0) + 1}, some)]

    for chosen, times in sorted(open_runs, key=lambda r: sum(r[0])):
        items: dict[int, int] = {}
        for s in chosen:
            items[s] = items.get(s, 0) + 1
        fill(items, times)
    while order:
        s = order[-1]
        times = max(1, left[s] // max(1, capacity // s))
        take(s, times)
        fill({s: 1}, times)
    return done


def places(runs: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every size, by ordinal: where each run of ordinals starts, its first container, and the items of it per container."""
    out: dict[int, list[list[int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for items, times in runs:
        for size, n in items:
            out.setdefault(size, []).append([used.get(size, 0), base, n])
            used[size] = used.get(size, 0) + n * times
        base += times
    return {s: tuple(np.array(rows, np.int64).T) for s, rows in out.items()}


def _place(found):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = found.value
        for batch in batches:
            box, size, ordinal = (batch[c].to_numpy() for c in ("container_id", "tokens", "ordinal"))
            number = np.zeros(len(box), np.int64)
            order = np.lexsort((size, box))
            cut = np.flatnonzero(np.r_[True, (box[order][1:] != box[order][:-1]) | (size[order][1:] != size[order][:-1])]) if len(box) else []
            for rows in np.split(order, cut[1:]) if len(box) else []:
                start, base, per = where[int(box[rows[0]])][int(size[rows[0]])]
                at = np.searchsorted(start, ordinal[rows], "right") - 1
                number[rows] = base[at] + (ordinal[rows] - start[at]) // per[at]
            columns = [batch["container_id"], pa.array(number), batch["doc_id"], batch["piece"], batch["first_token"], batch["tokens"]]
            yield pa.RecordBatch.from_arrays(columns, names=["container_id", "container_no", "doc_id", "piece", "first_token", "tokens"])

    return place


PACKED = "container_id int, container_no bigint, doc_id bigint, piece bigint, first_token bigint, tokens bigint"


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_id, container_no, doc_id, piece, first_token, tokens)``: every text's place, for every container kind.

    ``sizes`` is ``(doc_id, n_tokens)``; ``containers`` a short fixed table ``(container_id, capacity)``.  A text larger than a
    container becomes pieces of full capacity and a rest; all others stay whole.  Texts of no tokens need no
    place and have no row; rows of equal ``doc_id`` are packed each; container kinds with a null or non-positive capacity are left out.
    """
    spark = sizes.sparkSession
    kinds = [(int(r[0]), int(r[1])) for r in containers.select("container_id", "capacity").where("capacity > 0 and container_id is not null").distinct().collect()]
    if not kinds:
        return spark.createDataFrame([], PACKED)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in kinds]))
    whole = sizes.where("n_tokens > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n"), each.alias("k"))
    pieces = whole.select(F.col("k.container_id").alias("container_id"), F.col("k.capacity").alias("capacity"), "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("k.capacity")))).alias("piece"))
    first = (F.col("piece") * F.col("capacity")).alias("first_token")
    pieces = keep(pieces.select("container_id", "doc_id", "piece", first, F.least("capacity", F.col("n") - F.col("piece") * F.col("capacity")).alias("tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int").alias("salt")))
    # Ordinals within a size, however frequent: positions within a salt, plus the counts of the salts before.
    by_salt = pieces.groupBy("container_id", "tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = by_salt.withColumn("before", F.sum("n").over(Window.partitionBy("container_id", "tokens").orderBy("salt")) - F.col("n"))
    histogram = by_salt.groupBy("container_id", "tokens").agg(F.sum("n").alias("n")).toPandas()
    found = {}
    for i, capacity in kinds:
        own = histogram[histogram.container_id == i]
        found[i] = places(plan(own.tokens.to_numpy(), own.n.to_numpy(), capacity))
    place_of = spark.sparkContext.broadcast(found)
    row = F.row_number().over(Window.partitionBy("container_id", "tokens", "salt").orderBy("doc_id", "piece")) - 1
    numbered = pieces.withColumn("row", row).join(before.drop("n"), ["container_id", "tokens", "salt"])
    ordinal = (F.col("row") + F.col("before")).cast("bigint").alias("ordinal")
    return numbered.select("container_id", "doc_id", "piece", "first_token", "tokens", ordinal).mapInArrow(_place(place_of), PACKED)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_id, capacity, containers, tokens, unused)`` with the unused share of all space."""
    used = packed.groupBy("container_id").agg((F.max("container_no") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    unused = F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)
    return used.join(F.broadcast(containers.select("container_id", "capacity").distinct()), "container_id").select("container_id", "capacity", "containers", "tokens", unused.alias("unused"))


def packing_checks(packed: DataFrame, sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container_id, documents, overfull, wrong_pieces, needlessly_divided)`` of every container kind.

    Documents placed; containers above their capacity; documents whose pieces don't cover each token once; and documents that fit a
    container but were divided.  The last three are 0 in a sound packing.
    """
    kinds = F.broadcast(containers.where("capacity > 0 and container_id is not null").select("container_id", F.col("capacity").cast("bigint").alias("capacity")).distinct())
    boxes = packed.groupBy("container_id", "container_no").agg(F.sum("tokens").alias("t")).join(kinds, "container_id")
    over = boxes.groupBy("container_id").agg(F.sum((F.col("t") > F.col("capacity")).cast("bigint")).alias("overfull"))
    docs = packed.groupBy("container_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.countDistinct("first_token").alias("starts"))
    docs = docs.join(sizes.select("doc_id", "n_tokens"), "doc_id").join(kinds, "container_id")
    wrong = (F.col("t") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens")) | (F.col("starts") != F.col("pieces"))
    divided = (F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))
    per = docs.groupBy("container_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(wrong.cast("bigint")).alias("wrong_pieces"), F.sum(divided.cast("bigint")).alias("needlessly_divided"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return kinds.join(per, "container_id", "left").join(over, "container_id", "left").select("container_id", *[zero(c) for c in ("documents", "overfull", "wrong_pieces", "needlessly_divided")])
