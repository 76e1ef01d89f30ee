"""Panels and experiment tables derived from the given tables, in Spark and as SQL.

* ``demand``: monthly order value per order priority, NULL in months without orders.
* ``supply``: monthly shipped quantity per supplier, 0 in months without shipments.
* ``predictions``: closed-form forecasters over ``supply``. Each stands in for one model type, so that
  the taxonomy, metrics and leaderboards see a realistic experiment whose values SQL can reproduce.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.operators.backtest import evaluation_frame, score_predictions
from hindcast.operators.features import past_rolling
from hindcast.operators.panel import exact_sum, on_spine, series_window, tasks_for, to_monthly
from hindcast.operators.reshape import ensemble_method, model_build, model_family
from hindcast.plans.registry import cte, table

HORIZON = 3
AS_OF_START = "1997-01-01"
PERIODS = [
    ("pre_covid", None, "1998-12-01"),
    ("covid_shock", "1999-01-01", "1999-09-01"),
    ("recovery", "1999-10-01", "2000-06-01"),
    ("recent", "2000-07-01", None),
]
REGIME = {"start": "1999-01-01", "post_start": "2000-01-01", "names": ("event_observed", "event_active", "event_post", "months_since_event")}

# model_type, policy, transform, number of features, parameters
FORECASTERS = [
    ("naive", "none", "identity", 0, "{}"),
    ("ridge", "corr_pruned", "identity", 2, '{"alpha": 1.0}'),
    ("lasso", "none", "log_signed", 3, '{"alpha": 100.0, "max_iter": 5000}'),
    ("random_forest", "tree_top_20", "identity", 6, '{"max_depth": 4, "n_estimators": 200}'),
    ("xgboost", "none", "identity", 13, '{"colsample_bytree": 0.8, "max_depth": 3, "n_estimators": 500}'),
    ("lstm", "none", "identity", 12, '{"dense_head_sizes": [16, 8], "hidden_size": 32, "num_layers": 2}'),
]


def demand(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "series")
    monthly = to_monthly(
        orders, ["series"], "o_orderdate", {"y": exact_sum("o_totalprice"), "n": F.count(F.lit(1))}
    )
    return on_spine(monthly, ["series"])


def tasks(spark: SparkSession, folder: str) -> int:
    """Partitions of everything that is made from the lines of suppliers."""
    return tasks_for(table(spark, folder, "lineitem"))


def supply(spark: SparkSession, folder: str, measures: tuple[str, ...] = ("y", "v", "n")) -> DataFrame:
    """Only the named measures are read and carried along."""
    made = {"y": F.sum("l_quantity"), "v": exact_sum("l_extendedprice"), "n": F.count(F.lit(1))}
    empty = {"y": 0.0, "v": 0.0, "n": 0}
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "series")
    monthly = to_monthly(lines, ["series"], "l_shipdate", {m: made[m] for m in measures})
    return on_spine(monthly, ["series"], fill={m: empty[m] for m in measures}, tasks=tasks(spark, folder))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts by configuration; they are dealt by it here, in as many parts as they need, which serves all that follows."""
    w = series_window(["series"])
    frame = supply(spark, folder, ("y",)).withColumns(
        {
            "target_value": F.lead("y", HORIZON).over(w),
            "last1": F.lag("y", 1).over(w),
            "last13": F.lag("y", 13).over(w),
            "mean3": past_rolling("y", w, 3, "mean"),
            "mean6": past_rolling("y", w, 6, "mean"),
            "n_train": F.row_number().over(w) - 1,
        }
    )
    evaluated = evaluation_frame(frame, ["series"], "target_value", HORIZON, AS_OF_START).where("last13 IS NOT NULL")
    naive = F.col("seasonal_naive_proxy")
    made = [
        naive,
        F.col("last1"),
        F.col("mean3"),
        F.col("mean6"),
        F.col("last1") + (F.col("last1") - F.col("last13")) * HORIZON / 12,
        (naive + F.col("mean6")) / 2,
    ]
    options = F.array(
        *[
            F.struct(
                F.lit(t).alias("model_type"),
                F.lit(policy).alias("feature_policy"),
                F.lit(transform).alias("feature_transform"),
                F.lit(count).alias("n_features"),
                F.lit(params).alias("hyperparameters_json"),
                value.cast("double").alias("prediction"),
            )
            for (t, policy, transform, count, params), value in zip(FORECASTERS, made)
        ]
    )
    rows = evaluated.select(
        F.col("series").alias("series_key"),
        F.col("date").alias("as_of_date"),
        "target_date",
        F.col("target_value").alias("actual"),
        naive.alias("seasonal_naive_prediction"),
        "n_train",
        F.explode(options).alias("o"),
    ).select("*", "o.*").drop("o").withColumn("config_id", F.concat("model_type", F.lit("__s"), F.col("series_key").cast("string")))
    rows = rows.repartition(tasks(spark, folder), "config_id")
    shaped = rows.withColumns(
        {
            "experiment_id": F.lit("exp"),
            "pipeline_run_id": F.lit("run"),
            "target": F.lit("y"),
            "horizon": F.lit(HORIZON),
            "mode": F.when(F.col("series_key") % 2 == 0, "raw").otherwise("residual"),
            "feature_family_name": F.concat(F.lit("family_"), (F.col("series_key") % 7).cast("string")),
            "feature_set_id": F.concat(F.lit("fs_"), (F.col("series_key") % 7).cast("string")),
            "model_family": model_family(),
            "model_build": model_build(),
            "ensemble_method": ensemble_method(),
            "model_refit": (F.col("model_type") != "xgboost") | (F.month("as_of_date") == 1),
            "train_seconds": F.col("n_features") * 0.001 + F.month("as_of_date") * 0.0001,
            "n_features_before_policy": F.col("n_features") + 2,
            "n_features_after_policy": F.col("n_features") + F.month("as_of_date") % 3,
        }
    )
    return score_predictions(shaped, PERIODS)


# --- the same in SQL -------------------------------------------------------------------------------

cte("demand_obs", "", """
  SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y, count(*) AS n
  FROM orders GROUP BY 1, 2""")
cte("demand", "demand_obs", """
  SELECT s.series, s.date, o.y, o.n
  FROM (SELECT k.series, CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 MONTH)) AS DATE) AS date
        FROM (SELECT DISTINCT series FROM demand_obs) k, (SELECT min(date) lo, max(date) hi FROM demand_obs) b) s
  LEFT JOIN demand_obs o USING (series, date)""")
cte("supply_obs", "", """
  SELECT l_suppkey AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS y,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) AS n
  FROM lineitem GROUP BY 1, 2""")
cte("supply", "supply_obs", """
  SELECT s.series, s.date, coalesce(o.y, 0) AS y, coalesce(o.v, 0) AS v, coalesce(o.n, 0) AS n
  FROM (SELECT k.series, CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 MONTH)) AS DATE) AS date
        FROM (SELECT DISTINCT series FROM supply_obs) k, (SELECT min(date) lo, max(date) hi FROM supply_obs) b) s
  LEFT JOIN supply_obs o USING (series, date)""")
cte("evaluated", "supply", f"""
  SELECT * FROM (
    SELECT *, CAST(date + INTERVAL {HORIZON} MONTH AS DATE) AS target_date,
           lag(target_value, 12) OVER (PARTITION BY series ORDER BY date) AS naive
    FROM (SELECT *, lead(y, {HORIZON}) OVER w AS target_value, lag(y, 1) OVER w AS last1, lag(y, 13) OVER w AS last13,
                 avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3,
                 avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS mean6,
                 row_number() OVER w - 1 AS n_train
          FROM supply WINDOW w AS (PARTITION BY series ORDER BY date)))
  WHERE date >= DATE '{AS_OF_START}' AND target_value IS NOT NULL AND naive IS NOT NULL AND last13 IS NOT NULL""")

_FORMULAS = ["naive", "last1", "mean3", "mean6", f"last1 + (last1 - last13) * {HORIZON} / 12", "(naive + mean6) / 2"]
_BRANCHES = "\n  UNION ALL\n".join(
    f"""  SELECT series, date, target_date, target_value, naive, n_train, '{t}' AS model_type, '{p}' AS feature_policy,
         '{tr}' AS feature_transform, {n} AS n_features, '{js}' AS hyperparameters_json, {formula} AS prediction
  FROM evaluated"""
    for (t, p, tr, n, js), formula in zip(FORECASTERS, _FORMULAS)
)
FAMILY_SQL = """CASE WHEN {0} = 'naive' THEN 'baseline' WHEN {0} IN ('ridge', 'lasso') THEN 'linear'
         WHEN {0} IN ('random_forest', 'xgboost') THEN 'tree' ELSE 'neural_net' END"""
cte("made", "evaluated", _BRANCHES)
cte("pred", "made", f"""
  SELECT *, abs(error) AS abs_error, error * error AS squared_error,
         CASE WHEN actual = 0 THEN NULL ELSE abs(error) / abs(actual) END AS ape,
         abs(naive_error) AS naive_abs_error, evaluation_period = 'covid_shock' AS shock_period_flag
  FROM (SELECT series AS series_key, date AS as_of_date, target_date, target_value AS actual,
               naive AS seasonal_naive_prediction, n_train, model_type, feature_policy, feature_transform, n_features,
               hyperparameters_json, prediction, model_type || '__s' || series AS config_id,
               model_type || '__s' || series AS model_config_id,
               model_type || '__s' || series || '__as_of_' || strftime(date, '%Y-%m-%d') AS model_run_id,
               CASE WHEN series % 2 = 0 THEN 'raw' ELSE 'residual' END AS mode,
               'family_' || (series % 7) AS feature_family_name, 'fs_' || (series % 7) AS feature_set_id,
               {FAMILY_SQL.format('model_type')} AS model_family,
               CASE WHEN model_type = 'naive' THEN 'seasonal_naive' ELSE model_type END AS model_build,
               CASE model_type WHEN 'random_forest' THEN 'bagging' WHEN 'xgboost' THEN 'boosting' ELSE '' END AS ensemble_method,
               model_type <> 'xgboost' OR month(date) = 1 AS model_refit,
               n_features * CAST(0.001 AS DOUBLE) + month(date) * CAST(0.0001 AS DOUBLE) AS train_seconds,
               n_features + 2 AS n_features_before_policy, n_features + month(date) % 3 AS n_features_after_policy,
               prediction - target_value AS error, naive - target_value AS naive_error,
               CASE WHEN target_date >= DATE '2000-07-01' THEN 'recent' WHEN target_date >= DATE '1999-10-01' THEN 'recovery'
                    WHEN target_date >= DATE '1999-01-01' THEN 'covid_shock' ELSE 'pre_covid' END AS evaluation_period
        FROM made)""")
