"""Linear models: stochastic gradient training, prediction, metrics, validation, self-training, embedding.

Training is sequential by definition, so one model trains in one task over packed rows; models of several tasks or folds
train side by side.  Everything around it is joins and aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.sampling import cross_validation_folds, hash_places
from graphloom.store import keep

#: Bias step, scale floor and clamp of the sparsifying weights (fixed values).
BIAS_RATE, SCALE_FLOOR, WEIGHT_LIMIT = 0.01, 1e-9, 1e3
MODEL = "task int, fid bigint, w double"
#: Cells of a Laplacian that a trainer may hold.
LAPLACIAN_CELLS = 2_000_000
BIAS_FID = -1


@dataclass
class TrainConfig:
    lam: float = 1e-4
    epochs: int = 10
    sparsify: int = 0
    loss: str = "hinge"
    seed: int = 1
    laplacian_rate: float = 0.0


def _slope(loss: str, z: float) -> float:
    """How hard a margin z pushes, by loss."""
    if loss == "hinge":
        return 1.0 if z < 1 else 0.0
    if loss == "squared_hinge":
        return 2 * (1 - z) if z < 1 else 0.0
    if loss == "log":
        return 1 / (1 + np.exp(z))
    if loss == "smooth_hinge":
        return 0.0 if z >= 1 else 1.0 if z <= 0 else 1 - z
    raise ValueError(f"unknown loss {loss}")


def sgd(rows: list[tuple[np.ndarray, np.ndarray, float]], config: TrainConfig, laplacian: dict[int, list[tuple[int, float]]] | None = None) -> tuple[dict[int, float], float]:
    """Weights and bias after passes over ``rows`` (fids, values, y) in the given order."""
    top = np.sqrt(1 / np.sqrt(config.lam))
    eta0 = top / max(1.0, _slope(config.loss, -top))
    t0 = 1 / (eta0 * config.lam)
    ids = np.unique(np.concatenate([f for f, _, _ in rows])) if rows else np.zeros(0, np.int64)
    at = [(np.searchsorted(ids, f), v, y) for f, v, y in rows]
    mask = np.ones(len(ids))
    w, bias = np.zeros(len(ids)), 0.0
    for turn in range(config.sparsify + 1):
        factor = mask if turn < config.sparsify or turn == 0 else (mask != 0).astype(float)
        w, bias, scale, t = np.zeros(len(ids)), 0.0, 1.0, t0
        for epoch in range(config.epochs):
            for i, v, y in at:
                eta = 1 / (config.lam * t)
                scale *= 1 - eta * config.lam
                if scale < SCALE_FLOOR:
                    w *= scale
                    scale = 1.0
                x = v * factor[i]
                push = _slope(config.loss, y * (w[i] @ x * scale + bias))
                if push:
                    w[i] += x * (eta * push * y / scale)
                    bias += BIAS_RATE * eta * push * y
                t += 1
            if laplacian and epoch and config.laplacian_rate:
                w = w * scale
                scale = 1.0
                known = {int(f): k for k, f in enumerate(ids)}
                step = np.zeros(len(ids))
                for f, row in laplacian.items():
                    if f in known:
                        step[known[f]] = sum(c * w[known[g]] for g, c in row if g in known)
                w -= config.laplacian_rate * np.where(np.abs(step) > SCALE_FLOOR, step, 0)
        w = w * scale
        mask = np.clip(mask * w, -WEIGHT_LIMIT, WEIGHT_LIMIT) if turn < config.sparsify else mask
    final = w * (mask != 0) if config.sparsify else w
    return {int(f): float(x) for f, x in zip(ids, final) if x}, float(bias)


def packed(features: DataFrame) -> DataFrame:
    """``(gid, fids, vals)`` with fids ascending."""
    rows = features.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("fid", "value"))).alias("e"))
    return rows.select("gid", F.col("e.fid").alias("fids"), F.col("e.value").alias("vals"))


def one_class(features: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where a class is missing, copies of all instances with turned signs and labels, numbered -1 - gid."""
    if targets.where("y < 0").limit(1).count() and targets.where("y > 0").limit(1).count():
        return features, targets
    turned = features.select((-1 - F.col("gid")).alias("gid"), "fid", (-F.col("value")).alias("value"))
    return features.unionByName(turned), targets.unionByName(targets.select((-1 - F.col("gid")).alias("gid"), (-F.col("y")).alias("y")))


def laplacian_rows(laplacian: DataFrame) -> dict[int, list[tuple[int, float]]]:
    """``vectors_ops.correlation_laplacian`` as rows by feature, for the trainer; an error above LAPLACIAN_CELLS cells.

    The hash space of the features bounds its rows, and the number of neighbours their lengths.
    """
    cells = laplacian.select("fid_i", "fid_j", "v").limit(LAPLACIAN_CELLS + 1).toPandas()
    if len(cells) > LAPLACIAN_CELLS:
        raise ValueError(f"the Laplacian has more than {LAPLACIAN_CELLS} cells; use fewer hash bits or neighbours")
    return {int(i): list(zip(rows.fid_j.astype(int), rows.v.astype(float))) for i, rows in cells.groupby("fid_i")}


def train_tasks(features: DataFrame, targets: DataFrame, config: TrainConfig | None = None, laplacian: dict[int, list[tuple[int, float]]] | None = None) -> DataFrame:
    """``(task, fid, w)`` of one model per task of ``targets (task, gid, y)``; only +1 and -1 rows train; the bias has fid -1.

    With ``laplacian`` and ``config.laplacian_rate`` features that occur together are pulled together after every pass but the first.
    """
    config = config or TrainConfig()
    shared = features.sparkSession.sparkContext.broadcast(laplacian) if laplacian else None
    rows = packed(features)
    labelled = targets.where("y in (1, -1)").dropDuplicates(["task", "gid"]).select("task", "gid", "y")
    ranked = hash_places(labelled, ["task", "y"], config.seed).withColumnsRenamed({"among": "n", "place": "r"})
    most = ranked.groupBy("task").agg(F.max("n").alias("m"))
    times = F.floor((F.col("m") - 1 - F.col("r")) / F.col("n"))
    dealt = ranked.join(most, "task").withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), times)))
    dealt = dealt.select("task", "gid", "y", ((F.col("r") + F.col("t") * F.col("n")) * 2 + (F.col("y") < 0).cast("int")).alias("pos"))

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        weights, bias = sgd([(np.asarray(f), np.asarray(v, float), y) for f, v, y in zip(frame.fids, frame.vals, frame.y)], config, shared.value if shared else None)
        return pd.DataFrame({"task": key[0], "fid": [BIAS_FID, *weights], "w": [bias, *weights.values()]})

    return dealt.join(rows, "gid").select("task", "pos", "y", "fids", "vals").groupBy("task").applyInPandas(fit, MODEL)


def train(features: DataFrame, targets: DataFrame, config: TrainConfig | None = None, laplacian: dict[int, list[tuple[int, float]]] | None = None) -> DataFrame:
    """``(fid, w)`` of one model; a missing class is made by turned copies."""
    f, t = one_class(features, targets.where("y in (1, -1)"))
    return train_tasks(f, t.withColumn("task", F.lit(0)), config, laplacian).select("fid", "w")


def predict(features: DataFrame, model: DataFrame) -> DataFrame:
    """``(gid, margin, prediction)``: w x + bias, and its sign with 0 as -1.  Instances without known features get the bias."""
    bias = model.where(F.col("fid") == BIAS_FID).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("b"))
    dots = features.join(model, "fid", "left").groupBy("gid").agg(F.sum(F.coalesce(F.col("value") * F.col("w"), F.lit(0.0))).alias("s"))
    out = dots.join(bias, F.lit(True)).select("gid", (F.col("s") + F.col("b")).alias("margin"))
    return out.withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(-1.0))


def predict_tasks(features: DataFrame, models: DataFrame) -> DataFrame:
    """``(gid, task, margin)`` of all models for every instance."""
    bias = models.where(F.col("fid") == BIAS_FID).select("task", F.col("w").alias("b"))
    ids = features.select("gid").distinct()
    dots = features.join(models, "fid").groupBy("gid", "task").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    tasks = [r[0] for r in bias.select("task").distinct().collect()]  # a row per model
    every = ids.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    return every.join(dots, ["gid", "task"], "left").join(bias, "task").select("gid", "task", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("margin"))


def metrics(scored: DataFrame) -> DataFrame:
    """Counts, error, precision, recall and F of both classes and their means, from ``(y, prediction)``; 0 / 0 is null."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    up, down, said = F.col("y") > 0, F.col("y") < 0, F.col("prediction") > 0
    counts = scored.agg(n(up & said).alias("tp"), n(down & said).alias("fp"), n(down & ~said).alias("tn"), n(up & ~said).alias("fn"), n((F.col("y") == 0) | (up != said)).alias("errors"), F.count(F.lit(1)).alias("total"))
    d = F.try_divide
    out = counts.select("*", d("tp", F.col("tp") + F.col("fp")).alias("precision_pos"), d("tp", F.col("tp") + F.col("fn")).alias("recall_pos"), d("tn", F.col("tn") + F.col("fn")).alias("precision_neg"), d("tn", F.col("tn") + F.col("fp")).alias("recall_neg"))
    f = lambda p, r: d(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    out = out.withColumn("f_pos", f("precision_pos", "recall_pos")).withColumn("f_neg", f("precision_neg", "recall_neg"))
    return out.withColumn("f_balanced", (F.col("f_pos") + F.col("f_neg")) / 2)


def cross_validate(features: DataFrame, targets: DataFrame, folds: int = 10, config: TrainConfig | None = None) -> DataFrame:
    """``(gid, y, fold, margin, prediction)``: every labelled instance scored by the model that did not see its fold; all folds train at once."""
    config = config or TrainConfig()
    dealt = keep(cross_validation_folds(targets.where("y in (1, -1)").dropDuplicates(["gid"]), folds, config.seed))
    tasks = dealt.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("task <> fold").select("task", "gid", "y")
    models = keep(train_tasks(features, tasks, config))
    test = dealt.join(features, "gid").join(models, (F.col("fold") == F.col("task")) & (features["fid"] == models["fid"]), "left")
    bias = models.where(F.col("fid") == BIAS_FID).select(F.col("task").alias("fold"), F.col("w").alias("b"))
    scored = test.groupBy(dealt["gid"], "y", "fold").agg(F.sum(F.coalesce(F.col("value") * F.col("w"), F.lit(0.0))).alias("s")).join(F.broadcast(bias), "fold")
    out = scored.select("gid", "y", "fold", (F.col("s") + F.col("b")).alias("margin"))
    return out.withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(-1.0))


def bias_variance(features: DataFrame, targets: DataFrame, runs: int = 10, folds: int = 10, config: TrainConfig | None = None) -> DataFrame:
    """``(gid, accuracy, mean_margin, sd_margin, bias, variance)`` over cross-validations with growing seeds; the last two are sums."""
    config = config or TrainConfig()
    every = None
    for run in range(runs):
        one = cross_validate(features, targets, folds, TrainConfig(**{**config.__dict__, "seed": config.seed + run})).withColumn("run", F.lit(run))
        every = one if every is None else every.unionByName(one)
    every = keep(every)
    mean = every.groupBy("gid").agg(F.avg("margin").alias("mean_margin"), F.stddev_samp("margin").alias("sd_margin"), F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("accuracy"))
    both = every.join(mean, "gid")
    return both.groupBy("gid", "accuracy", "mean_margin", "sd_margin").agg(F.sum(F.pow(F.col("y") - F.col("mean_margin"), 2)).alias("bias"), F.sum(F.pow(F.col("mean_margin") - F.col("prediction"), 2)).alias("variance"))


def learning_curve(features: DataFrame, targets: DataFrame, points: int = 10, config: TrainConfig | None = None) -> DataFrame:
    """``(point, gid, y, is_test, margin)``: the first 1/points tests; training grows by 1/points."""
    config = config or TrainConfig()
    dealt = keep(cross_validation_folds(targets.where("y in (1, -1)").dropDuplicates(["gid"]), points, config.seed))
    tasks = dealt.where("fold > 0").withColumn("task", F.explode(F.sequence(F.col("fold"), F.lit(points - 1)))).select("task", "gid", "y")
    margins = predict_tasks(features.join(dealt.select("gid"), "gid", "left_semi"), keep(train_tasks(features, tasks, config)))
    scored = margins.join(dealt, "gid").where("fold = 0 or fold <= task")
    return scored.select(F.col("task").alias("point"), "gid", "y", (F.col("fold") == 0).alias("is_test"), "margin")


def self_train(features: DataFrame, targets: DataFrame, rounds: int = 3, threshold: float = 1.0, only: str | None = None, config: TrainConfig | None = None, laplacian: dict[int, list[tuple[int, float]]] | None = None) -> DataFrame:
    """``(fid, w)``: unlabelled (0) instances with confident margins join the training set each round.

    Of the positive margins those at or above their ``threshold`` quantile count as +1 and of the negative ones those at or below
    their 1 - ``threshold`` quantile as -1; at the default 1 only the extremes.  If all margins have one sign, both quantiles are taken over all
    of them.  ``only`` restricts what is added to ``positive`` or ``negative``.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be a quantile")
    labelled = targets.where("y in (1, -1)").select("gid", "y")
    rest = features.join(targets.where("y = 0").select("gid").distinct(), "gid", "left_semi").select("gid", "fid", "value")
    model = keep(train(features, labelled, config, laplacian))
    for _ in range(rounds):
        scored = keep(predict(rest, model))
        margin = F.col("margin")
        at = lambda which, q: F.percentile_approx(F.when(which, margin), q)
        bars = scored.agg(
            at(margin > 0, threshold).alias("up"), at(margin <= 0, 1 - threshold).alias("down"), at(F.lit(True), threshold).alias("high"), at(F.lit(True), 1 - threshold).alias("low"),
            F.coalesce(F.bool_or(margin > 0) & F.bool_or(margin <= 0), F.lit(True)).alias("both"),
        )
        hi, lo = F.when(F.col("both"), F.col("up")).otherwise(F.col("high")), F.when(F.col("both"), F.col("down")).otherwise(F.col("low"))
        picked = scored.join(F.broadcast(bars), F.lit(True)).select("gid", F.when(margin >= hi, 1.0).when(margin <= lo, -1.0).alias("y")).where("y is not null")
        if only:
            picked = picked.where("y > 0" if only == "positive" else "y < 0")
        model = keep(train(features, labelled.unionByName(picked), config, laplacian))
    return model


def parameter_search(features, targets: DataFrame, grid: dict[str, list], rounds: int = 1, folds: int = 3, start: dict | None = None) -> tuple[dict, list[dict]]:
    """Coordinate line search: one parameter at a time, by the balanced F of cross-validation; the best value of each is kept.

    ``features`` is a table, or a function of a dict of kernel parameters that gives one; parameters of ``TrainConfig`` go to the
    trainer and all others to that function.  Returns the best values and every trial with its score.
    """
    own = set(TrainConfig.__dataclass_fields__)
    best = {**TrainConfig().__dict__, **(start or {})}
    made: dict[tuple, DataFrame] = {}
    tried = []
    for _ in range(rounds):
        for name, values in grid.items():
            scores = []
            for value in values:
                now = {**best, name: value}
                shape = {k: v for k, v in now.items() if k not in own}
                if tuple(shape.items()) not in made:
                    made[tuple(shape.items())] = features(shape) if callable(features) else features
                f = metrics(cross_validate(made[tuple(shape.items())], targets, folds, TrainConfig(**{k: v for k, v in now.items() if k in own}))).first()["f_balanced"]
                scores.append((f if f is not None else -1.0, value))
                tried.append({**now, "f_balanced": f})
            best[name] = max(scores, key=lambda s: s[0])[1]
    return best, tried


def embed(neighbours: DataFrame, dims: int = 2, iterations: int = 200, epsilon: float = 0.01, tau: float = 0.0005, non_neighbours: int = 100, seed: int = 1, restarts: int = 1, tau_exponents: int = 1, start: DataFrame | None = None) -> DataFrame:
    """``(gid, x, distortion)``: low-dimensional places by pulling neighbours to 1 - k and pushing sampled others away, all at once per step.

    One trial sees all neighbour lists, n x K numbers; trials, ``restarts`` random starts for each of ``tau_exponents`` values tau, tau / 10, ..., run side
    by side, and that of least ``distortion`` is kept, ties to the first.  ``distortion`` is one less the mean share of neighbours kept, above
    chance.  ``start (gid, x)`` gives the first restart's places; others begin at random.
    """
    restarts, tau_exponents = max(1, restarts), max(1, tau_exponents)

    def place(key, frame: pd.DataFrame) -> pd.DataFrame:
        trial = int(key[0])
        push = tau / 10 ** (trial // restarts)
        ids, first, src = np.unique(frame.gid.to_numpy(), return_index=True, return_inverse=True)
        ok = np.isin(frame.nid.to_numpy(), ids) & (frame.nid.to_numpy() != frame.gid.to_numpy())
        src, dst, goal = src[ok], np.searchsorted(ids, frame.nid.to_numpy()[ok]), 1 - frame.k.to_numpy()[ok]
        rng, n = np.random.default_rng(seed + trial % restarts), len(ids)
        x = rng.uniform(-1, 1, (n, dims))
        if trial % restarts == 0:
            for i, given in enumerate(frame.x0.to_numpy()[first]):
                if given is not None and len(given) == dims:
                    x[i] = given
        for _ in range(iterations):
            gap = x[dst] - x[src]
            dist = np.sqrt((gap**2).sum(1)) + 1e-12
            move = np.zeros_like(x)
            np.add.at(move, src, gap * (epsilon * (dist - goal) / dist)[:, None])
            other = rng.integers(0, n, (n, min(non_neighbours, n)))
            away = x[:, None] - x[other]
            move += (away * (push / (np.sqrt((away**2).sum(2)) + 1e-3))[..., None]).sum(1)
            x += move
        kept, k = 0.0, max(1, int(np.bincount(src, minlength=n).max(initial=1)))
        want = [set(g) for g in np.split(dst[np.argsort(src, kind="stable")], np.cumsum(np.bincount(src, minlength=n))[:-1])]
        for i in range(n):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            kept += len(want[i] & set(np.argsort(d)[:k].tolist()))
        return pd.DataFrame({"trial": trial, "gid": ids, "x": list(x), "distortion": 1 - (kept / n / k - k / n)})

    lists = neighbours.select("gid", "nid", "k")
    known = lists.join(start.select("gid", F.col("x").alias("x0")), "gid", "left") if start is not None else lists.withColumn("x0", F.lit(None).cast("array<double>"))
    trials = restarts * tau_exponents
    tried = known.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).groupBy("trial").applyInPandas(place, "trial int, gid bigint, x array<double>, distortion double")
    if trials == 1:
        return tried.drop("trial")
    tried = keep(tried)
    best = tried.select("trial", "distortion").distinct().orderBy("distortion", "trial").limit(1).select("trial")
    return tried.join(F.broadcast(best), "trial").drop("trial")


def average_stress(places: DataFrame, products: DataFrame) -> DataFrame:
    """``(stress)``: mean squared gap between low-dimensional distance and 1 - k over the given pairs."""
    a, b = places.select(F.col("gid").alias("gid_a"), F.col("x").alias("xa")), places.select(F.col("gid").alias("gid_b"), F.col("x").alias("xb"))
    far = F.sqrt(F.aggregate(F.zip_with("xa", "xb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    both = products.where("gid_a <> gid_b").join(a, "gid_a").join(b, "gid_b")
    return both.agg(F.avg(F.pow(far - (1 - F.col("k")), 2)).alias("stress"))
