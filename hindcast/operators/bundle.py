"""Curated bundles: retention by metric quantiles and partition manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.constants import RETENTION_HIGHER, RETENTION_LOWER, RETENTION_SECONDARY_HIGHER, RETENTION_SECONDARY_LOWER
from hindcast.functions.scalar import path_safe
from hindcast.operators.distribution import exact_quantiles, unpivot_numbers
from hindcast.operators.explore import top_per_group, top_rows
from hindcast.operators.leaderboard import of_selected
from hindcast.operators.metrics import family_summary
from hindcast.session import materialize


def retained_by_metric(
    leaderboard: DataFrame, keep_fraction: float, secondary: bool = False
) -> DataFrame:
    """(model_config_id, reason) for every metric in whose best share a configuration lies.

    All metrics are handled in one long frame: one exact quantile per metric, one join with those
    thresholds (one row per metric), one filter.
    """
    lower = RETENTION_LOWER + (RETENTION_SECONDARY_LOWER if secondary else [])
    higher = RETENTION_HIGHER + (RETENTION_SECONDARY_HIGHER if secondary else [])
    present = [m for m in [*lower, *higher] if m in leaderboard.columns]
    long = unpivot_numbers(leaderboard, ["model_config_id"], present).where(F.col("value").isNotNull())
    # Higher-is-better metrics are mirrored so that one quantile serves both directions.
    mirrored = long.withColumn("value", F.when(F.col("variable").isin(higher), -F.col("value")).otherwise(F.col("value")))
    limits = exact_quantiles(mirrored, ["variable"], "value", [keep_fraction]).select("variable", F.col("quantile").alias("limit"))
    return mirrored.join(F.broadcast(limits), "variable").where(F.col("value") <= F.col("limit")).select(
        "model_config_id", F.col("variable").alias("reason")
    )


def retention_reasons(
    leaderboard: DataFrame, champion_id: DataFrame, keep_fraction: float, include_baseline: bool = True,
    secondary: bool = False, per_build: int = 0, score: str = "selection_score_balanced",
) -> DataFrame:
    """Every (configuration, reason) pair of the curated set."""
    board = materialize(leaderboard)
    parts = [retained_by_metric(board, keep_fraction, secondary)]
    if include_baseline:
        parts.append(
            board.where(F.col("model_family") == "baseline").select("model_config_id", F.lit("always_baseline").alias("reason"))
        )
    if per_build > 0:
        best = top_per_group(board, ["model_build"], score, True, per_build)
        parts.append(best.select("model_config_id", F.lit("always_top_per_model_build").alias("reason")))
    parts.append(champion_id.select("model_config_id", F.lit("always_champion").alias("reason")))
    reasons = parts[0]
    for part in parts[1:]:
        reasons = reasons.unionByName(part)
    return reasons


def selected_configs(reasons: DataFrame) -> DataFrame:
    return reasons.select("model_config_id").distinct()


def reason_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count_distinct("model_config_id").alias("configurations"))


def partition_manifest(df: DataFrame, dataset: str, column: str = "model_build", key: str = "model_config_id") -> DataFrame:
    """Rows and distinct configurations per partition value, with the folder name it gets."""
    counts = df.groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("configs")
    )
    folder = F.concat(F.lit(f"{dataset}/{column}="), path_safe("value"))
    return counts.select(F.lit(dataset).alias("dataset"), "value", folder.alias("path"), "rows", "configs")


def curate(tables: dict[str, DataFrame], reasons: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """The public bundle: every table cut to the selected configurations, full metadata kept aside."""
    selected = materialize(selected_configs(reasons))
    board, paths = tables["model_leaderboard"], tables["forecast_paths"]
    if "model_config_id" not in paths.columns:
        paths = paths.withColumn("model_config_id", F.col("config_id"))
    kept_board, kept_paths = of_selected(board, selected), of_selected(paths, selected)
    best = top_rows(kept_board.drop("rank"), "selection_score", True, top)
    out = {
        "model_leaderboard": kept_board,
        "model_leaderboard_full": board,
        "forecast_paths": kept_paths,
        "feature_family_summary": family_summary(kept_board),
        "feature_family_summary_full": family_summary(board),
        "overview_top_models": best,
        "overview_prediction_paths": kept_paths.join(F.broadcast(best.select("model_config_id", "rank")), "model_config_id"),
    }
    if "complexity_profile" in tables:
        out["complexity_profile_full"] = tables["complexity_profile"]
        out["complexity_profile"] = of_selected(tables["complexity_profile"], selected)
    if "performance_over_time" in tables:
        performance = tables["performance_over_time"]
        if "model_config_id" not in performance.columns:
            performance = performance.withColumn("model_config_id", F.col("config_id"))
        out["performance_over_time"] = of_selected(performance, selected)
    return out
