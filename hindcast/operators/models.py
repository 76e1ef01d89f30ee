"""Linear forecasters over rolling snapshots and sequence representations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.constants import LASSO_SELECTOR_ALPHA
from hindcast.functions.ids import config_id
from hindcast.operators.backtest import with_mode
from hindcast.operators.policies import prefix_moments, selection_masks

# Sweeps of the coordinate solver where a configuration names none; the selector gets as many as a lasso.
MAX_ITER, TOLERANCE = 10_000, 1e-10


def solve_batch(gram: np.ndarray, cross: np.ndarray, n: np.ndarray, mask: np.ndarray, kind: str, alpha: float, l1_ratio: float, max_iter: int = MAX_ITER) -> tuple[np.ndarray, bool]:
    """Standardised coefficients of many small problems at once, and whether the solver settled.

    ``gram`` (b, p, p) and ``cross`` (b, p) are the standardised XᵀX and Xᵀy of each snapshot.
    Ridge minimises |y-Xw|² + a|w|²; lasso and elastic net minimise |y-Xw|²/2n + a·r|w|₁ + a(1-r)|w|²/2.
    """
    b, p, _ = gram.shape
    keep = mask.astype(float)
    if kind == "ridge":
        g = gram * keep[:, :, None] * keep[:, None, :]
        g[:, np.arange(p), np.arange(p)] += alpha + (1 - keep)
        return np.linalg.solve(g, (cross * keep)[:, :, None])[:, :, 0], True
    ratio = 1.0 if kind == "lasso" else l1_ratio
    weight = np.zeros((b, p))
    diagonal = gram[:, np.arange(p), np.arange(p)] / n[:, None]
    for _ in range(max_iter):
        largest = 0.0
        for j in range(p):
            rest = (cross[:, j] - np.einsum("bk,bk->b", gram[:, j, :], weight)) / n + diagonal[:, j] * weight[:, j]
            moved = np.sign(rest) * np.maximum(np.abs(rest) - alpha * ratio, 0.0)
            scale = diagonal[:, j] + alpha * (1 - ratio)
            new = np.where(scale > 0, moved / np.where(scale > 0, scale, 1.0), 0.0) * keep[:, j]
            largest = max(largest, float(np.max(np.abs(new - weight[:, j]), initial=0.0)))
            weight[:, j] = new
        if largest <= TOLERANCE * max(1.0, float(np.max(np.abs(weight), initial=0.0))):
            return weight, True
    return weight, False


def solve_each(gram: np.ndarray, cross: np.ndarray, n: np.ndarray, mask: np.ndarray, kind: str, alpha: float, l1_ratio: float, max_iter: int = MAX_ITER) -> tuple[np.ndarray, np.ndarray]:
    """``solve_batch`` for problems that settle one by one: each stops at its own sweep, and whether it got there.

    Sweeps are made over all that have not settled, so that the others of a batch change neither its weights nor its end.
    """
    b, p, _ = gram.shape
    if kind == "ridge":
        return solve_batch(gram, cross, n, mask, kind, alpha, l1_ratio)[0], np.ones(b, bool)
    ratio = 1.0 if kind == "lasso" else l1_ratio
    weight, converged, at = np.zeros((b, p)), np.zeros(b, bool), np.arange(b)
    keep = mask.astype(float)
    diagonal = gram[:, np.arange(p), np.arange(p)] / n[:, None]
    scale = diagonal + alpha * (1 - ratio)
    now = np.zeros((b, p))
    for _ in range(max_iter):
        largest = np.zeros(len(at))
        for j in range(p):
            rest = (cross[:, j] - np.einsum("bk,bk->b", gram[:, j, :], now)) / n + diagonal[:, j] * now[:, j]
            moved = np.sign(rest) * np.maximum(np.abs(rest) - alpha * ratio, 0.0)
            new = np.where(scale[:, j] > 0, moved / np.where(scale[:, j] > 0, scale[:, j], 1.0), 0.0) * keep[:, j]
            np.maximum(largest, np.abs(new - now[:, j]), out=largest)
            now[:, j] = new
        settled = largest <= TOLERANCE * np.maximum(1.0, np.abs(now).max(axis=1, initial=0.0))
        if settled.any():
            weight[at[settled]], converged[at[settled]] = now[settled], True
            open_ = ~settled
            at, now, gram, cross, n, diagonal, scale, keep = (v[open_] for v in (at, now, gram, cross, n, diagonal, scale, keep))
        if not len(at):
            break
    weight[at] = now
    return weight, converged


def fit_linear(moments: DataFrame, keys: list[str], features: int, configs: list[dict]) -> DataFrame:
    """One fitted model per snapshot and configuration.

    ``moments`` holds the features followed by the raw and the residual target, and a feature mask. Each
    row already is a whole snapshot, so fitting is a map over Arrow batches without a shuffle. Columns
    without variance are not scaled and get no weight. ``max_iter`` comes from a configuration's parameters;
    ``converged`` says whether all snapshots of the batch settled within it.
    """
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*keys).schema.fields]
    fields = ", ".join([*key_fields, "date date, config int, n_train bigint, intercept double, coef array<double>, standardised array<double>, converged boolean, n_features bigint"])
    size = features + 2
    upper = np.triu_indices(size)
    plans = [(i, c["model_type"], float(c["params"].get("alpha", 1.0)), float(c["params"].get("l1_ratio", 0.5)), c["mode"], int(c["params"].get("max_iter", MAX_ITER))) for i, c in enumerate(configs)]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            n = pdf["n"].to_numpy(float)
            sums = np.stack(pdf["sums"].to_numpy())
            shift = np.stack(pdf["shift"].to_numpy())
            mask = np.stack(pdf["mask"].to_numpy()).astype(bool)
            square = np.zeros((len(pdf), size, size))
            square[:, upper[0], upper[1]] = np.stack(pdf["products"].to_numpy())
            square = square + np.triu(square, 1).transpose(0, 2, 1)
            centred = square - sums[:, :, None] * sums[:, None, :] / n[:, None, None]
            raw_variance = np.einsum("bii->bi", centred)[:, :features] / n[:, None]
            # Rounding leaves a constant column with a tiny variance; treat it as constant.
            level = np.einsum("bii->bi", square)[:, :features] / n[:, None]
            varied = raw_variance > 1e-12 * np.maximum(level, 1e-300)
            spread = np.where(varied, np.sqrt(np.maximum(raw_variance, 0)), 1.0)
            gram = centred[:, :features, :features] / (spread[:, :, None] * spread[:, None, :])
            means = shift + sums / n[:, None]
            out = []
            for index, kind, alpha, l1_ratio, mode, max_iter in plans:
                y = features + (mode == "residual")
                cross = centred[:, :features, y] / spread
                weight, converged = solve_batch(gram.copy(), cross, n, mask & varied, kind, alpha, l1_ratio, max_iter)
                coef = weight / spread
                intercept = means[:, y] - np.einsum("bp,bp->b", coef, means[:, :features])
                part = pdf[[*keys, "date"]].copy()
                part["config"], part["n_train"] = index, pdf["n"]
                part["intercept"], part["coef"], part["standardised"] = intercept, list(coef), list(weight)
                part["converged"], part["n_features"] = converged, mask.sum(axis=1)
                out.append(part)
            yield pd.concat(out, ignore_index=True)

    return moments.select(*keys, "date", "n", "shift", "sums", "products", "mask").mapInPandas(fit, fields)


def linear_configs(alphas: dict[str, list[dict]], modes: list[str]) -> list[dict]:
    return [{"model_type": t, "params": p, "mode": m} for t, grid in alphas.items() for p in grid for m in modes]


def backtest_linear(
    panel: DataFrame, series_keys: list[str], model_keys: list[str], features: list[str], target: str, baseline: str,
    configs: list[dict], evaluated: Column, fit_on: Column, embargo: int, min_train: int = 24, policy: str = "none",
    family: str = "features", transform: str = "identity", base_features: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rolling forecasts of many linear configurations from one pass of moments.

    ``model_keys`` ⊆ ``series_keys`` decide which series share a model. ``evaluated`` marks as-of rows;
    ``fit_on`` is the month whose fit serves a row. ``n_features`` counts the columns left by policy and
    transform, ``n_train`` the training rows of the as-of month. Returns (predictions, fits).
    """
    frame = panel.withColumn("_residual", F.col(target) - F.col(baseline))
    columns = [*features, target, "_residual"]
    moments = prefix_moments(frame, model_keys, columns, [baseline], embargo, one_row_per_month=model_keys == series_keys)
    ready = selection_masks(moments.where(F.col("n") >= min_train), features[:base_features], policy)
    if base_features is not None and base_features < len(features):
        # Appended transforms of a dropped feature are dropped with it.
        ready = ready.withColumn("mask", F.flatten(F.array_repeat(F.col("mask"), len(features) // base_features)))
    asked = panel.where(evaluated).withColumn("fit_date", fit_on)
    needed = asked.select(*model_keys, F.col("fit_date").alias("date")).distinct()
    if model_keys:
        # One model per key: keep the fits spread out. A pooled model has at most one row per month.
        needed = needed.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), *model_keys, "date")
    snapshots = ready.join(needed, [*model_keys, "date"], "left_semi")
    if not model_keys:
        # The moments of a pooled model come out of one running sum; its months are solved in as many tasks as there are.
        snapshots = snapshots.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "date")
    fits = fit_linear(snapshots, model_keys, len(features), configs)
    described = F.array(
        *[
            F.struct(
                F.lit(c["model_type"]).alias("model_type"),
                F.lit(c["mode"]).alias("mode"),
                config_id(
                    F.lit(c["model_type"]), F.lit(c["mode"]), F.lit(family),
                    F.create_map(*[F.lit(x) for k, v in sorted(c["params"].items()) for x in (k, str(v))]), F.lit(policy), F.lit(transform),
                ).alias("config_id"),
                F.lit(json.dumps(c["params"], sort_keys=True)).alias("hyperparameters_json"),
            )
            for c in configs
        ]
    )
    x = F.array(*[F.col(c).cast("double") for c in features])
    rows = asked.where(F.forall(x, lambda v: v.isNotNull())).withColumn("_x", x)
    fitted = fits.withColumnRenamed("date", "fit_date")
    # What a row's own month could have been trained on, whichever month's fit serves it.
    known = moments.select(*model_keys, "date", F.col("n").cast("bigint").alias("_n_as_of"))
    joined = rows.join(fitted.drop("n_train"), [*model_keys, "fit_date"]).join(known, [*model_keys, "date"], "left")
    dot = F.aggregate(F.zip_with("_x", "coef", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    chosen = joined.withColumn("_d", F.get(described, F.col("config")))
    predictions = chosen.select(
        *series_keys,
        F.col("date").alias("as_of_date"),
        "fit_date",
        (F.col("fit_date") == F.col("date")).alias("model_refit"),
        "_d.*",
        F.coalesce("_n_as_of", F.lit(0)).alias("n_train"),
        F.col(target).alias("actual"),
        F.col(baseline).alias("seasonal_naive_prediction"),
        with_mode(F.col("intercept") + dot, F.col(baseline), F.col("_d.mode")).alias("prediction"),
        "n_features",
    )
    return predictions, fits.withColumn("_d", F.get(described, F.col("config"))).select("*", "_d.*").drop("_d")


def feature_importance(fits: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Long table of coefficients ranked by size inside each run."""
    names = F.array(*[F.lit(c) for c in features])
    long = fits.select(*keys, "date", "config_id", F.explode(F.arrays_zip(names.alias("feature_name"), F.col("standardised").alias("importance"))).alias("z"))
    w = W.partitionBy(*keys, "date", "config_id").orderBy(F.abs("z.importance").desc(), F.col("z.feature_name"))
    return long.select(
        *keys,
        F.col("date").alias("as_of_date"),
        "config_id",
        "z.feature_name",
        F.lit("coefficient").alias("importance_type"),
        "z.importance",
        F.abs("z.importance").alias("importance_abs"),
        F.row_number().over(w).cast("bigint").alias("rank"),
    )


def lasso_selection(moments: DataFrame, keys: list[str], features: list[str], alpha: float = LASSO_SELECTOR_ALPHA) -> DataFrame:
    """Features with a non-zero lasso weight in each snapshot, strongest first.

    ``moments`` holds the features, the target and (unused here) a second target column.
    """
    whole = moments.withColumn("mask", F.array(*[F.lit(True)] * len(features)))
    config = [{"model_type": "lasso", "params": {"alpha": alpha}, "mode": "raw"}]
    fits = fit_linear(whole, keys, len(features), config)
    names = F.array(*[F.lit(c) for c in features])
    scored = F.zip_with("standardised", names, lambda s, c: F.struct((-F.abs(s)).alias("size"), c.alias("feature")))
    kept = F.transform(F.array_sort(F.filter(scored, lambda e: e["size"] < 0)), lambda e: e["feature"])
    return fits.select(
        *keys, "date", "n_train", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(features[0]))).alias("selected_features")
    )


# --- sequence representations (B22) -----------------------------------------------------------------


def sequence_representation(samples: DataFrame, train: Column, components: int | None = 20, share: float = 0.95) -> DataFrame:
    """Scale flattened sequences and project them on principal components fitted on training rows.

    ``components`` fixes how many; None keeps as many as explain ``share`` of the variance. Both fits are
    distributed aggregations; only the loading matrix reaches the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    flat = F.flatten(F.transform("sequence", lambda s: s["features"]))
    vectors = samples.withColumn("_v", array_to_vector(flat))
    fitted = vectors.where(train)
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(fitted)
    width = len(scaler.mean)
    k = width if components is None else min(components, width)
    pca = PCA(k=k, inputCol="_s", outputCol="_r").fit(scaler.transform(fitted))
    if components is None:
        k = int(np.searchsorted(np.cumsum(pca.explainedVariance.toArray()), share) + 1)
    shown = pca.transform(scaler.transform(vectors))
    return shown.withColumn("representation", F.slice(vector_to_array("_r"), 1, k)).drop("_v", "_s", "_r")
