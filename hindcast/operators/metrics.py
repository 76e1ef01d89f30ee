"""Backtest metrics, champions and rolling errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.constants import CONFIG_KEYS, MODEL_ORDER, SCORE_RECIPES, SIMPLICITY_THRESHOLD
from hindcast.functions.scalar import steady, weighted_score
from hindcast.operators.distribution import ranked
from hindcast.session import materialize


def backtest_metrics(predictions: DataFrame, keys: list[str] | None = None, series_keys: list[str] | None = None, in_order: bool = False) -> DataFrame:
    """One row per (configuration, scope): overall plus every evaluation period (A2-A5).

    Directions follow one series from month to month: where a configuration forecasts several, ``series_keys``
    name their columns, and the hits of all series are added up. Without them the facts are exchanged
    once by ``config_id``, which serves the ordered windows and the aggregation. Configurations with a NULL key are left out.

    Sums of errors are kept to twelve significant digits, so that equal errors in another order give equal scores.
    ``in_order`` keeps every digit instead and adds the months of a configuration one after another, as SQL adds
    ordered rows: scores equal to the last bit are what ranks and limits of the checks are made of.
    """
    if in_order and series_keys:
        raise ValueError("months follow one another in one series: in_order and series_keys exclude each other")
    keys = keys or CONFIG_KEYS
    series = series_keys or []
    facts = predictions
    if "feature_transform" in facts.columns:
        facts = facts.withColumn("feature_transform", F.coalesce("feature_transform", F.lit("identity")))
    facts = facts.dropna(subset=keys)

    def same_direction(*partition: str) -> Column:
        w = W.partitionBy("config_id", *series, *partition).orderBy("as_of_date")
        moved = F.signum(F.col("actual") - F.lag("actual").over(w))
        expected = F.signum(F.col("prediction") - F.lag("prediction").over(w))
        return (moved == expected).cast("int")

    # Sums around one actual value of the configuration: any shift gives the same variance, this one keeps it accurate.
    if series:
        # A few configurations hold all rows of many series: one row each is sent to the facts, which stay where they are.
        facts = facts.join(F.broadcast(facts.groupBy("config_id").agg(F.min("actual").alias("_first"))), "config_id")
        first = F.col("_first")
    else:
        first = F.first("actual").over(W.partitionBy("config_id").orderBy("as_of_date"))
    facts = facts.withColumns(
        {
            "_hit_all": same_direction(),
            "_hit_period": same_direction("evaluation_period"),
            "_a": F.col("actual") - first,
            "_gap": F.abs(F.col("prediction") - F.col("actual")),
            "_naive": F.abs(F.col("seasonal_naive_prediction") - F.col("actual")),
        }
    )
    constants = [c for c in ["experiment_id", "pipeline_run_id", "target", "horizon"] if c in predictions.columns]
    measures = {
        "evaluation_start_date": (F.min, F.col("target_date")),
        "evaluation_end_date": (F.max, F.col("target_date")),
        "n_features": (F.max, F.col("n_features")),
        "_low": (F.min, F.col("actual")),
        "_high": (F.max, F.col("actual")),
        "n_predictions": (F.sum, F.lit(1)),
        "_a1": (F.sum, F.col("_a")),
        "_a2": (F.sum, F.col("_a") * F.col("_a")),
        "_timed": (F.sum, F.col("train_seconds").isNotNull().cast("int")),
    }
    added = {
        "_gaps": F.col("_gap"),
        "_sse": F.col("_gap") * F.col("_gap"),
        "_naive_gaps": F.col("_naive"),
        "_naive_sse": F.col("_naive") * F.col("_naive"),
        "total_train_seconds": F.col("train_seconds"),
    }
    sums_in = {"_hit_all": added, "_hit_period": added}
    if in_order:
        # Running sums: no term is negative, so the greatest is the whole sum.
        facts = facts.withColumns(
            {
                f"{h}{n}": F.sum(c).over(W.partitionBy("config_id", *part).orderBy("as_of_date").rowsBetween(W.unboundedPreceding, W.currentRow))
                for h, part in (("_hit_all", []), ("_hit_period", ["evaluation_period"]))
                for n, c in added.items()
            }
        )
        sums_in = {h: {n: F.col(f"{h}{n}") for n in added} for h in sums_in}
    collect = F.max if in_order else F.sum
    hits = {"_hits": F.sum, "_moves": F.sum, **dict.fromkeys(added, collect)}
    # First per period, then periods are added up to "overall": the rows are not duplicated.
    periods = facts.groupBy(*keys, "evaluation_period").agg(
        *[F.first(c).alias(c) for c in constants],
        *[how(c).alias(n) for n, (how, c) in measures.items()],
        *[
            F.struct(F.sum(h).alias("_hits"), F.count(h).alias("_moves"), *[collect(c).alias(n) for n, c in terms.items()]).alias(f"{h}s")
            for h, terms in sums_in.items()
        ],
    )
    scope = F.explode(
        F.array(
            F.struct(F.lit("overall").alias("scope"), F.col("_hit_alls").alias("h")),
            F.struct(F.col("evaluation_period").alias("scope"), F.col("_hit_periods").alias("h")),
        )
    )
    sums = (
        periods.withColumn("_s", scope).select("*", F.col("_s.scope").alias("evaluation_scope"), "_s.h.*")
        .groupBy(*keys, "evaluation_scope")
        .agg(
            *[F.first(c).alias(c) for c in constants],
            *[how(n).alias(n) for n, (how, _) in measures.items()],
            *[how(n).alias(n) for n, how in hits.items()],
        )
    )
    count = F.col("n_predictions")

    def kept(total: Column) -> Column:
        return total if in_order else steady(total)

    sums = sums.withColumns({c: kept(F.col(c)) for c in added})
    sums = sums.withColumns(
        {
            "n_features": F.col("n_features").cast("bigint"),
            "mae": F.col("_gaps") / count,
            "rmse": F.sqrt(F.col("_sse") / count),
            "mae_naive": F.col("_naive_gaps") / count,
            "rmse_naive": F.sqrt(F.col("_naive_sse") / count),
            "_sst": kept(F.col("_a2") - F.col("_a1") * F.col("_a1") / count),
            "_constant": F.col("_high") == F.col("_low"),
            "diracc": F.try_divide("_hits", "_moves"),
            "avg_train_seconds": F.try_divide("total_train_seconds", "_timed"),
        }
    )
    perfect = F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("n_predictions") > 1, F.when(F.col("_constant"), perfect).otherwise(1 - F.try_divide("_sse", "_sst")))
    n, p = F.col("n_predictions"), F.col("n_features")
    adjusted = F.when(
        (F.col("model_family") == "linear") & (n > p + 1), 1 - F.try_divide((1 - F.col("r2")) * (n - 1), n - p - 1)
    )
    scores = {f"selection_score_{name}": weighted_score("mae", "rmse", name) for name in SCORE_RECIPES}
    return (
        sums.withColumn("r2", r2)
        .withColumns(
            {
                "r2_adjusted": adjusted,
                "mae_improvement_vs_naive": F.col("mae_naive") - F.col("mae"),
                "rmse_improvement_vs_naive": F.col("rmse_naive") - F.col("rmse"),
                **scores,
            }
        )
        .withColumn("selection_score", F.col("selection_score_balanced"))
        .drop(*[c for c in sums.columns if c.startswith("_")])
    )


def rank_metrics(metrics: DataFrame) -> DataFrame:
    """Position within the scope by selection score; equal scores are ordered by configuration."""
    table = materialize(metrics)
    return ranked(table, ["evaluation_scope"], "selection_score", True, "model_config_id")


FAMILY_BEST = {
    "min": [
        "selection_score", "selection_score_typical", "selection_score_balanced", "selection_score_large_error",
        "rmse", "mae",
    ],
    "max": ["r2", "r2_adjusted", "diracc", "rmse_improvement_vs_naive", "mae_improvement_vs_naive"],
}


def family_summary(frame: DataFrame) -> DataFrame:
    """Best and average metrics per (family, mode) over overall rows; NULL groups stay."""
    overall = frame.where(F.col("evaluation_scope") == "overall") if "evaluation_scope" in frame.columns else frame
    pick = {"min": F.min, "max": F.max}
    best = [
        pick[how](c).alias(f"best_{c}") for how, columns in FAMILY_BEST.items() for c in columns if c in frame.columns
    ]
    means = [F.avg(c).alias(f"avg_{c}") for c in ["rmse", "mae"] if c in frame.columns]
    return overall.groupBy("feature_family_name", "mode").agg(*best, *means)


def champion(metrics: DataFrame) -> DataFrame:
    """The simplest configuration within 2 % of the best overall score (T5), as one row."""
    overall = metrics.where(F.col("evaluation_scope") == "overall")
    best = overall.agg(F.min("selection_score").alias("b")).scalar()
    order = F.create_map(*[F.lit(v) for pair in MODEL_ORDER.items() for v in pair])
    return (
        overall.withColumn("best_raw_selection_score", best)
        .withColumn("equivalence_threshold", F.col("best_raw_selection_score") * (1 + SIMPLICITY_THRESHOLD))
        .where(F.col("selection_score") <= F.col("equivalence_threshold"))
        .withColumn("model_order", F.coalesce(F.try_element_at(order, F.col("model_type")), F.lit(99)))
        .orderBy("model_order", "n_features", "selection_score", "mae", "rmse", "model_config_id")
        .limit(1)
    )


def rolling_error(predictions: DataFrame, windows: tuple[int, ...] = (3, 6, 12), series_keys: list[str] | None = None) -> DataFrame:
    """Mean absolute error over the last months per configuration and series; short starts allowed."""
    w = W.partitionBy("config_id", *(series_keys or [])).orderBy("as_of_date")
    return predictions.withColumns(
        {f"rolling_{k}mo_mae": F.avg("abs_error").over(w.rowsBetween(-(k - 1), 0)) for k in windows}
    )
