"""Wide leaderboards, complexity profiles and dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.constants import (
    BASE_INTERPRETABILITY,
    CONFIG_KEYS,
    DEFAULT_INTERPRETABILITY,
    EVALUATION_PERIODS,
    EVALUATION_SCOPES,
    LEADERBOARD_METRICS,
    SCORE_RECIPES,
)
from hindcast.functions.scalar import array_total, clip, list_param, number_param, params_map, safe_ratio, weighted_score
from hindcast.operators.distribution import ranked
from hindcast.operators.metrics import backtest_metrics, champion, family_summary, rolling_error
from hindcast.operators.reshape import with_defaults
from hindcast.session import materialize

# Period columns compared with the pre-event period, by ratio kind.
RATIO_PERIODS = {"shock_penalty": "covid_shock", "recovery_ratio": "recovery", "recent_recovery_ratio": "recent"}
REFERENCE_PERIOD = "pre_covid"
# Ratio column prefix -> metric behind it.
RATIO_METRICS = {"": "mae", "rmse_": "rmse", **{f"{r}_score_": f"selection_score_{r}" for r in SCORE_RECIPES}}


def ratio_columns(present: list[str]) -> dict[str, Column]:
    """Shock, recovery and recent ratios against the pre-event period (V2)."""
    out = {}
    for prefix, metric in RATIO_METRICS.items():
        base = f"{REFERENCE_PERIOD}_{metric}"
        for kind, period in RATIO_PERIODS.items():
            if base in present and f"{period}_{metric}" in present:
                out[f"{prefix}{kind}"] = safe_ratio(f"{period}_{metric}", base)
    return out


def wide_leaderboard(metrics: DataFrame, details: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per configuration with ``{scope}_{metric}`` columns, overall aliases and ratios (V1, V2)."""
    keys = keys or CONFIG_KEYS
    names = [m for m in LEADERBOARD_METRICS if m in metrics.columns]
    wide = (
        metrics.dropna(subset=keys).groupBy(*keys).pivot("evaluation_scope", EVALUATION_SCOPES)
        .agg(*[F.first(m).alias(m) for m in names])
    )
    plain = [m for m in names if m not in ("mae_improvement_vs_naive", "rmse_improvement_vs_naive")]
    wide = wide.withColumns({m: F.col(f"overall_{m}") for m in plain})
    wide = wide.withColumns(
        {
            **ratio_columns(wide.columns),
            "shock_abs_increase": F.col("covid_shock_mae") - F.col(f"{REFERENCE_PERIOD}_mae"),
        }
    )
    return wide if details is None else attach(wide, details, ["hyperparameters_json"])


def attach(left: DataFrame, right: DataFrame, columns: list[str], key: str = "model_config_id") -> DataFrame:
    """Left join of extra columns; of several rows of a key on the right the least one in these columns counts."""
    extra = [c for c in columns if c in right.columns and c not in left.columns]
    if not extra:
        return left
    one = right.groupBy(key).agg(F.min(F.struct(*extra)).alias("_least")).select(key, *[F.col("_least")[c].alias(c) for c in extra])
    return left.join(one, key, "left")


def rank_leaderboard(wide: DataFrame, metric: str = "selection_score") -> DataFrame:
    """Global position by score."""
    table = materialize(wide)
    return ranked(table, [], metric, True, "model_config_id")


def enrich_scores(df: DataFrame) -> DataFrame:
    """Recompute score and ratio columns of an older leaderboard from its MAE and RMSE columns (A5, V2)."""
    present = set(df.columns)
    scores: dict[str, Column] = {}
    for prefix in ["", *[f"{p}_" for p in EVALUATION_PERIODS]]:
        if {f"{prefix}mae", f"{prefix}rmse"} <= present:
            for recipe in SCORE_RECIPES:
                scores[f"{prefix}selection_score_{recipe}"] = weighted_score(f"{prefix}mae", f"{prefix}rmse", recipe)
    out = df.withColumns(scores)
    balanced = {
        f"{prefix}selection_score": F.col(f"{prefix}selection_score_balanced")
        for prefix in ["", *[f"{p}_" for p in EVALUATION_PERIODS]]
        if f"{prefix}selection_score" not in out.columns and f"{prefix}selection_score_balanced" in out.columns
    }
    out = out.withColumns(balanced) if balanced else out
    ratios = ratio_columns(out.columns)
    return out.withColumns(ratios) if ratios else out


def transform_build_pivot(leaderboard: DataFrame, builds: list[str], metric: str = "selection_score") -> DataFrame:
    """Best score per transform and build (V4)."""
    return leaderboard.groupBy("feature_transform").pivot("model_build", builds).agg(F.min(metric))


# --- complexity (A7-A9) ----------------------------------------------------------------------------

RUN_DEFAULTS = {
    "feature_transform": "identity",
    "feature_policy_params_json": "{}",
    "dropped_feature_names_json": "[]",
    "selected_feature_names_json": "[]",
    "aic": (None, "double"),
    "bic": (None, "double"),
    "representation_policy": "tabular_raw",
    "representation_params_json": "{}",
    "n_representation_features": (None, "double"),
    "sequence_length": (None, "double"),
    "sequence_stride": (None, "double"),
    "prediction_head": "direct_horizon",
    "training_window_months": (None, "double"),
    "validation_strategy": "rolling_as_of",
    "early_stopping_used": False,
    "epochs_trained": (None, "double"),
    "best_epoch": (None, "double"),
    "framework": "",
    "framework_version": "",
    "hardware_type": "cpu",
    "device": "cpu",
    "gpu_name": "",
    "cuda_version": "",
}
FIRST_OF_RUN = [
    "experiment_id", "pipeline_run_id", "hyperparameters_json", "feature_policy_params_json", "representation_policy",
    "representation_params_json", "sequence_length", "sequence_stride", "prediction_head", "training_window_months",
    "validation_strategy", "early_stopping_used", "framework", "framework_version", "hardware_type", "device",
    "gpu_name", "cuda_version", "selected_feature_names_json", "selected_base_feature_names_json",
    "dropped_feature_names_json",
]


def _dense_head(width: Column, params: Column) -> Column:
    """Weights of a dense head: each layer, then one output unit."""
    sizes = F.coalesce(list_param(params, "dense_head_sizes"), F.array().cast("array<double>"))
    start = F.struct(F.lit(0.0).alias("total"), width.alias("width"))
    grown = F.aggregate(
        sizes, start, lambda s, d: F.struct((s["total"] + s["width"] * d + d).alias("total"), d.alias("width"))
    )
    return grown["total"] + grown["width"] + 1.0


def model_size(model_type: Column, features: Column, json_text: Column) -> Column:
    """A size proxy that is comparable across model types."""
    p = params_map(json_text)
    n = F.coalesce(features, F.lit(0.0))

    def number(name: str, default: float) -> Column:
        return number_param(p, name, default)

    def order(name: str) -> Column:
        return array_total(F.transform(F.coalesce(list_param(p, name), F.array().cast("array<double>")), F.abs))

    forest = number("n_estimators", 1) * F.greatest(number("max_depth", 12), F.lit(1.0))
    boosted = (
        number("n_estimators", 1) * F.greatest(number("max_depth", 1), F.lit(1.0))
        * F.greatest(number("colsample_bytree", 1), F.lit(0.1))
    )
    hidden = number("hidden_size", 1)
    perceptron = number("sequence_length", 1) * n * hidden + hidden + _dense_head(hidden, p)
    repeated = F.array_repeat(hidden, number("num_layers", 1).cast("int"))
    listed = list_param(p, "recurrent_hidden_sizes")
    layers = F.when(F.size(listed) > 0, listed).otherwise(repeated)
    gates = F.when(model_type == "lstm", 4.0).when(model_type == "gru", 3.0).otherwise(1.0)
    start = F.struct(F.lit(0.0).alias("total"), n.alias("width"))
    recurrent = F.aggregate(
        layers,
        start,
        lambda s, h: F.struct((s["total"] + gates * (s["width"] * h + h * h + h)).alias("total"), h.alias("width")),
    )
    network = recurrent["total"] + _dense_head(F.element_at(layers, -1), p)
    size = (
        F.when(model_type == "naive", F.lit(1.0))
        .when(model_type.isin("ridge", "lasso", "elastic_net"), n)
        .when(model_type.isin("random_forest", "extra_trees"), forest)
        .when(model_type == "xgboost", boosted)
        .when(model_type.isin("arima", "sarima", "sarimax"), order("order") + order("seasonal_order") + n)
        .when(model_type == "mlp", perceptron)
        .when(model_type.isin("rnn", "gru", "lstm"), network)
        .otherwise(n)
    )
    return F.greatest(size, F.lit(1.0))


def run_profile(runs: DataFrame) -> DataFrame:
    """Per configuration: first settings, means, ranges and totals over its runs."""
    work = with_defaults(runs, RUN_DEFAULTS)
    for column, source in {
        "n_features_before_policy": "n_features",
        "n_features_after_policy": "n_features",
        "selected_base_feature_names_json": "selected_feature_names_json",
    }.items():
        if column not in work.columns:
            work = work.withColumn(column, F.col(source))

    def earliest(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("as_of_date")))

    after = "n_features_after_policy"
    profile = work.groupBy(*CONFIG_KEYS).agg(
        *[earliest(c).alias(c) for c in FIRST_OF_RUN if c in work.columns],
        F.avg("n_representation_features").alias("n_representation_features"),
        F.max("epochs_trained").alias("epochs_trained"),
        F.min("best_epoch").alias("best_epoch"),
        F.max("n_features_before_policy").alias("n_input_features"),
        F.round(F.avg(after), 3).alias("n_selected_features"),
        F.min(after).alias("min_selected_features"),
        F.max(after).alias("max_selected_features"),
        F.avg("train_seconds").alias("avg_train_seconds"),
        F.sum("train_seconds").alias("total_train_seconds"),
        # Runs of one configuration are bounded by the as-of months; a distinct count would exchange
        # every run with all its settings.
        F.size(F.collect_set("model_run_id")).cast("bigint").alias("model_run_count"),
        F.sum(F.col("model_refit").cast("int")).alias("refit_count"),
        F.avg("n_train").alias("avg_n_train"),
        F.avg("aic").alias("aic_mean"),
        F.avg("bic").alias("bic_mean"),
    )
    size_features = F.coalesce("n_representation_features", "n_selected_features")
    reduction = safe_ratio(F.col("n_input_features") - F.col("n_selected_features"), F.col("n_input_features"))
    return profile.withColumns(
        {
            "feature_reduction_ratio": F.coalesce(reduction, F.lit(0.0)),
            "model_size_proxy": model_size(F.col("model_type"), size_features, F.col("hyperparameters_json")),
            "compute_proxy": F.greatest(F.col("total_train_seconds"), F.lit(0.0)),
        }
    )


def complexity_scores(profile: DataFrame) -> DataFrame:
    """0-100 complexity, compute and interpretability scores relative to all configurations.

    The bounds are one aggregated row read as a scalar, not a window over the whole table.
    """
    profile = materialize(profile)
    parts = {
        "features": F.coalesce("n_selected_features", F.lit(0.0)),
        "size": F.log1p(F.coalesce("model_size_proxy", F.lit(0.0))),
        "compute": F.log1p(F.coalesce("compute_proxy", F.lit(0.0))),
    }
    bounds = profile.agg(
        F.struct(
            *[F.min(c).alias(f"low_{n}") for n, c in parts.items()], *[F.max(c).alias(f"high_{n}") for n, c in parts.items()]
        ).alias("b")
    )
    out = profile.withColumn("_b", bounds.scalar())

    def unit(name: str) -> Column:
        low, high = F.col(f"_b.low_{name}"), F.col(f"_b.high_{name}")
        return F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(parts[name] - low, high - low))

    base = F.lit(DEFAULT_INTERPRETABILITY)
    for family, value in BASE_INTERPRETABILITY.items():
        base = F.when(F.col("model_family") == family, F.lit(value)).otherwise(base)
    complexity = (unit("features") * 0.40 + unit("size") * 0.35 + unit("compute") * 0.25) * 100
    clarity = clip(base - unit("features") * 0.25 * 100 - unit("size") * 0.15 * 100, 0.0, 100.0)
    return out.withColumns(
        {
            "complexity_score": F.round(complexity, 3),
            "compute_score": F.round(unit("compute") * 100, 3),
            "interpretability_score": F.round(clarity, 3),
        }
    ).drop("_b")


OVERALL_IN_PROFILE = ["mae", "rmse", "r2", "r2_adjusted", "selection_score"] + [f"selection_score_{r}" for r in SCORE_RECIPES]


def complexity_profile(runs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    scored = complexity_scores(run_profile(runs))
    if metrics is None:
        return scored
    overall = metrics.where(F.col("evaluation_scope") == "overall").select(
        "model_config_id", *[F.col(c).alias(f"overall_{c}") for c in OVERALL_IN_PROFILE if c in metrics.columns]
    )
    return scored.join(overall, "model_config_id", "left")


# --- dashboard tables (B24, U5) --------------------------------------------------------------------

PATH_COLUMNS = [
    "config_id", "source_model_config_id", "as_of_date", "target_date", "model_family", "model_build", "model_type",
    "ensemble_method", "mode", "feature_family_name", "feature_policy", "feature_transform", "feature_set_id", "actual",
    "prediction", "baseline_prediction", "seasonal_naive_prediction", "model_refit", "error", "abs_error",
    "evaluation_period", "shock_period_flag",
]
PROFILE_COLUMNS = [
    "n_input_features", "n_selected_features", "feature_reduction_ratio", "representation_policy",
    "n_representation_features", "sequence_length", "prediction_head", "validation_strategy", "framework",
    "hardware_type", "device", "model_size_proxy", "complexity_score", "interpretability_score", "compute_score",
    "aic_mean", "bic_mean",
]


def champion_rows(facts: DataFrame, champion_row: DataFrame, key: str = "config_id") -> DataFrame:
    """Facts of the champion (J9): the champion is one row, so its id is read as a scalar and filters the scan."""
    return facts.where(F.col(key) == champion_row.select(key).scalar())


def of_selected(facts: DataFrame, selected: DataFrame, key: str = "model_config_id") -> DataFrame:
    """Facts whose configuration is in the selected set."""
    return facts.join(selected.select(key).distinct(), key, "left_semi")


def overview(leaderboard: DataFrame, paths: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """The best configurations and their paths with rank (J7, T2); ``top`` bounds the broadcast side."""
    from hindcast.operators.explore import top_rows

    best = top_rows(leaderboard, "selection_score", True, top)
    ranks = best.select("config_id", "rank")
    joined = paths.join(F.broadcast(ranks), "config_id").withColumn("model_config_id", F.col("config_id"))
    return best, joined


def dashboard_outputs(predictions: DataFrame, runs: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """Every presentation table of an experiment."""
    predictions = with_defaults(predictions, {"source_model_config_id": "", "feature_transform": "identity"})
    paths = predictions.select(*[c for c in PATH_COLUMNS if c in predictions.columns])
    profile = complexity_profile(runs, metrics)
    details = runs.select("model_config_id", "hyperparameters_json")
    board = attach(wide_leaderboard(metrics, details), profile, PROFILE_COLUMNS)
    board = rank_leaderboard(board)
    best, best_paths = overview(board, paths)
    return {
        "forecast_paths": paths,
        "performance_over_time": rolling_error(paths),
        "model_leaderboard": board,
        "feature_family_summary": family_summary(metrics),
        "champion_predictions": champion_rows(predictions, champion(metrics)),
        "overview_top_models": best,
        "overview_prediction_paths": best_paths,
        "complexity_profile": profile,
    }


def recombine(predictions: list[DataFrame], runs: list[DataFrame], tasks: int | None = None, in_order: bool = False) -> dict[str, DataFrame]:
    """Union several experiments and recompute everything that depends on all of them.

    ``tasks`` are the partitions of the united facts by configuration, where the session's number is too few;
    ``in_order`` is that of ``backtest_metrics``.
    """
    from functools import reduce

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    facts, all_runs = union(predictions), union(runs)
    if tasks:
        facts, all_runs = facts.repartition(tasks, "config_id"), all_runs.repartition(tasks, "config_id")
    metrics = materialize(backtest_metrics(facts, in_order=in_order))
    tables = dashboard_outputs(facts, all_runs, metrics)
    return {"predictions": facts, "model_runs": all_runs, "metrics": metrics, "champion": champion(metrics), **tables}
