"""Backtest, metric, leaderboard, bundle and mart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.constants import (
    CONFIG_KEYS,
    EVALUATION_PERIODS,
    EVALUATION_SCOPES,
    LEADERBOARD_METRICS,
    MODEL_ORDER,
    RETENTION_HIGHER,
    RETENTION_LOWER,
    SCORE_RECIPES,
)
from hindcast.operators import backtest as bt
from hindcast.operators import bundle as bd
from hindcast.operators import explore as ex
from hindcast.operators import leaderboard as lb
from hindcast.operators import metrics as mt
from hindcast.operators.panel import series_window
from hindcast.operators.reshape import with_taxonomy
from hindcast.plans import fixtures as fx
from hindcast.plans.registry import cte, query, r6, rounded6, with_ctes
from hindcast.session import materialize

KEYS = ", ".join(CONFIG_KEYS)
SCORES_SQL = ", ".join(
    f"CAST({a} AS DOUBLE) * mae + CAST({b} AS DOUBLE) * rmse AS selection_score_{name}" for name, (a, b) in SCORE_RECIPES.items()
)
cte("hits", "pred", """
  SELECT *, sign(actual - lag(actual) OVER w) = sign(prediction - lag(prediction) OVER w) AS hit_all,
         sign(actual - lag(actual) OVER p) = sign(prediction - lag(prediction) OVER p) AS hit_period
  FROM pred WINDOW w AS (PARTITION BY config_id ORDER BY as_of_date),
                   p AS (PARTITION BY config_id, evaluation_period ORDER BY as_of_date)""")
cte("scoped", "hits", """
  SELECT *, 'overall' AS evaluation_scope, hit_all AS hit FROM hits
  UNION ALL SELECT *, evaluation_period, hit_period FROM hits""")
cte("metrics", "scoped", f"""
  SELECT *, CASE WHEN model_family = 'linear' AND n_predictions > n_features + 1
                 THEN 1 - (1 - r2) * (n_predictions - 1) / (n_predictions - n_features - 1) END AS r2_adjusted,
         mae_naive - mae AS mae_improvement_vs_naive, rmse_naive - rmse AS rmse_improvement_vs_naive,
         {SCORES_SQL}, CAST(0.75 AS DOUBLE) * mae + CAST(0.25 AS DOUBLE) * rmse AS selection_score
  FROM (SELECT *, CASE WHEN n_predictions > 1 THEN CASE WHEN constant THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END
                       ELSE 1 - sse / sst END END AS r2
        FROM (SELECT {KEYS}, evaluation_scope, min(target_date) AS evaluation_start_date, max(target_date) AS evaluation_end_date,
                     count(*) AS n_predictions, max(n_features) AS n_features, avg(abs_error) AS mae, sqrt(avg(squared_error)) AS rmse,
                     avg(naive_abs_error) AS mae_naive, sqrt(avg(naive_error * naive_error)) AS rmse_naive,
                     sum(squared_error) AS sse, var_pop(actual) * count(actual) AS sst, max(actual) = min(actual) AS constant,
                     avg(CAST(hit AS INT)) AS diracc, avg(train_seconds) AS avg_train_seconds, sum(train_seconds) AS total_train_seconds
              FROM scoped GROUP BY {KEYS}, evaluation_scope))""")
cte("ranked", "metrics", """
  SELECT *, row_number() OVER (PARTITION BY evaluation_scope ORDER BY selection_score, model_config_id) AS rank FROM metrics""")

_RATIOS = {
    f"{prefix}{kind}": f"{period}_{metric} / nullif(pre_covid_{metric}, 0)"
    for prefix, metric in lb.RATIO_METRICS.items()
    for kind, period in lb.RATIO_PERIODS.items()
}
_PLAIN = [m for m in LEADERBOARD_METRICS if not m.endswith("_vs_naive")]
cte("board", "metrics", f"""
  SELECT *, {', '.join(f'overall_{m} AS {m}' for m in _PLAIN)},
         {', '.join(f'{sql} AS {name}' for name, sql in _RATIOS.items())},
         covid_shock_mae - pre_covid_mae AS shock_abs_increase
  FROM (SELECT {KEYS}, {', '.join(f"max({m}) FILTER (WHERE evaluation_scope = '{s}') AS {s}_{m}" for s in EVALUATION_SCOPES for m in LEADERBOARD_METRICS)}
        FROM metrics GROUP BY {KEYS})""")
LABELS = """CASE model_build WHEN 'seasonal_naive' THEN 'Baseline: Seasonal naive' WHEN 'ridge' THEN 'Linear: Ridge' WHEN 'lasso' THEN 'Linear: Lasso'
  WHEN 'random_forest' THEN 'Tree: Random forest' WHEN 'xgboost' THEN 'Tree: XGBoost' ELSE 'Neural Net: LSTM' END"""
cte("labelled", "board", f"""
  SELECT *, {LABELS} AS model_build_label, CASE feature_transform WHEN 'identity' THEN 'No transform' ELSE 'Signed log' END AS feature_transform_label,
         CASE model_type {' '.join(f"WHEN '{f[0]}' THEN '{f[4]}'" for f in fx.FORECASTERS)} END AS hyperparameters_json FROM board""")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return mt.backtest_metrics(fx.predictions(spark, folder), in_order=True)


def board(spark: SparkSession, folder: str) -> DataFrame:
    return lb.wide_leaderboard(metrics(spark, folder))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    types = F.create_map(*[F.lit(v) for f in fx.FORECASTERS for v in (f[0], f[4])])
    return with_taxonomy(board(spark, folder)).withColumn("hyperparameters_json", types[F.col("model_type")])


# --- evaluation ------------------------------------------------------------------------------------


@query("prediction_facts", "B13 B14 B17 P10 P16 X7", with_ctes("pred", f"""
SELECT config_id, model_run_id, as_of_date, target_date, model_family, model_build, ensemble_method, mode, feature_family_name,
       {r6('actual', 'actual')}, {r6('prediction', 'prediction')}, {r6('error', 'error')}, {r6('abs_error', 'abs_error')},
       {r6('squared_error', 'squared_error', 4)}, {r6('ape', 'ape', 9)}, {r6('naive_error', 'naive_error')}, evaluation_period, shock_period_flag, model_refit
FROM pred"""))
def prediction_facts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(
        fx.predictions(spark, folder).select(
            "config_id", "model_run_id", "as_of_date", "target_date", "model_family", "model_build", "ensemble_method", "mode",
            "feature_family_name", "actual", "prediction", "error", "abs_error", "squared_error", "ape", "naive_error",
            "evaluation_period", "shock_period_flag", "model_refit",
        ),
        ape=9,
        squared_error=4,
    )


@query("evaluation_frame", "P8 P14", with_ctes("demand", """
SELECT series, date, CAST(date + INTERVAL 3 MONTH AS DATE) AS target_date, round(t, 2) + 0.0 AS actual, round(s, 2) + 0.0 AS naive
FROM (SELECT *, lag(t, 12) OVER (PARTITION BY series ORDER BY date) AS s
      FROM (SELECT *, lead(y, 3) OVER (PARTITION BY series ORDER BY date) AS t FROM demand))
WHERE date BETWEEN DATE '1998-01-01' AND DATE '2001-01-01' AND t IS NOT NULL AND s IS NOT NULL AND (month(date) - 1) % 2 = 0"""))
def evaluation_frame(spark: SparkSession, folder: str) -> DataFrame:
    frame = fx.demand(spark, folder).withColumn("t", F.lead("y", 3).over(series_window(["series"])))
    out = bt.evaluation_frame(frame, ["series"], "t", 3, "1998-01-01", "2001-01-01", step=2)
    return rounded6(out.select("series", "date", "target_date", F.col("t").alias("actual"), F.col("seasonal_naive_proxy").alias("naive")), 2)


def _training_sql(embargo: int) -> str:
    return f"""(SELECT count(*) FROM frame t WHERE t.series = e.series AND t.t IS NOT NULL AND t.l IS NOT NULL
       AND t.date < CAST(e.date - INTERVAL {embargo} MONTH AS DATE)) AS n_train_embargo_{embargo}"""


cte("frame", "demand", "SELECT *, lead(y, 3) OVER w AS t, lag(y, 1) OVER w AS l FROM demand WINDOW w AS (PARTITION BY series ORDER BY date)")


@query("training_counts", "B5 J11", with_ctes("frame", f"""
SELECT series, date, {', '.join(_training_sql(e) for e in (0, 2, 3))} FROM frame e WHERE date >= DATE '1998-01-01'"""))
def training_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot sizes by running windows; the check counts the rows of an explicit ``date < as_of`` join."""
    w = series_window(["series"])
    frame = fx.demand(spark, folder).withColumns({"t": F.lead("y", 3).over(w), "l": F.lag("y", 1).over(w)})
    for embargo in (0, 2, 3):
        frame = bt.training_rows(frame, ["series"], ["t", "l"], embargo).withColumnRenamed("n_train", f"n_train_embargo_{embargo}")
    kept = frame.where(F.col("date") >= F.lit("1998-01-01").cast("date"))
    return rounded6(kept.select("series", "date", *[f"n_train_embargo_{e}" for e in (0, 2, 3)]))


@query("refit_schedule", "B6", with_ctes("demand", """
, recursive_fit AS (SELECT 1)
SELECT series, date, CAST(fit AS DATE) AS fit_date, fit = date AS model_refit
FROM (SELECT series, date, first + to_months(CAST(floor(m / 6.0) * 6 AS INT)) AS fit
      FROM (SELECT series, date, min(date) OVER (PARTITION BY series) AS first,
                   (year(date) * 12 + month(date)) - min(year(date) * 12 + month(date)) OVER (PARTITION BY series) AS m
            FROM demand WHERE date >= DATE '1998-01-01' AND (month(date) - 1) % 2 = 0))""").replace(", recursive_fit AS (SELECT 1)\n", ""))
def refit_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Refit every 5 months on a 2-month as-of grid acts every 6 months."""
    start = F.lit("1998-01-01").cast("date")
    evaluated = fx.demand(spark, folder).where((F.col("date") >= start) & (F.pmod(F.month("date") - 1, F.lit(2)) == 0))
    return bt.refit_schedule(evaluated.select("series", "date"), ["series"], 5, 2)


@query("forward_months", "J12", with_ctes("demand", """
SELECT e.series, e.date AS as_of_date, count(*) AS steps, CAST(sum(d.n) AS BIGINT) AS n
FROM demand e JOIN demand d ON d.series = e.series AND d.date > CAST(e.date - INTERVAL 2 MONTH AS DATE) AND d.date <= CAST(e.date + INTERVAL 3 MONTH AS DATE)
WHERE e.date >= DATE '1998-01-01' GROUP BY 1, 2 HAVING count(*) = 5"""))
def forward_months(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.demand(spark, folder).select("series", "date", "n")
    evaluated = rows.where(F.col("date") >= F.lit("1998-01-01").cast("date"))
    sliced = bt.forward_months(evaluated, rows, ["series"], 1, 3)
    return rounded6(sliced.groupBy("series", "as_of_date").agg(F.max("steps").alias("steps"), F.sum("n").alias("n")))


@query("holdout_split", "B23", with_ctes("demand", """
SELECT series, date, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY date DESC) <= 12 THEN 'valid' ELSE 'train' END AS split,
       CASE WHEN date >= DATE '2000-06-01' THEN 'test' WHEN date >= DATE '1999-06-01' THEN 'valid' ELSE 'train' END AS date_split FROM demand"""))
def holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    base = fx.demand(spark, folder).select("series", "date")
    return bt.holdout(base, ["series"], 12).withColumn("date_split", bt.date_split("date", "2000-06-01", "1999-06-01"))


# --- metrics and leaderboard -----------------------------------------------------------------------

METRIC_OUT = [
    "mae", "rmse", "r2", "r2_adjusted", "diracc", "mae_naive", "rmse_naive", "mae_improvement_vs_naive",
    "rmse_improvement_vs_naive", "selection_score", *[f"selection_score_{r}" for r in SCORE_RECIPES], "total_train_seconds",
]


@query("backtest_metrics", "A2 A3 A4 A5 W21", with_ctes("ranked", f"""
SELECT config_id, evaluation_scope, evaluation_start_date, evaluation_end_date, n_predictions, n_features, rank,
       {', '.join(r6(m, m, 6) for m in METRIC_OUT)} FROM ranked"""))
def backtest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = mt.rank_metrics(metrics(spark, folder))
    return rounded6(out.select("config_id", "evaluation_scope", "evaluation_start_date", "evaluation_end_date", "n_predictions", "n_features", "rank", *METRIC_OUT), 6)


@query("champion", "T5", with_ctes("metrics", f"""
SELECT config_id, model_type, {r6('selection_score', 'selection_score')}, {r6('best', 'best_raw_selection_score')},
       {r6('best * CAST(1.02 AS DOUBLE)', 'equivalence_threshold')}
FROM (SELECT *, min(selection_score) OVER () AS best FROM metrics WHERE evaluation_scope = 'overall')
WHERE selection_score <= best * CAST(1.02 AS DOUBLE)
ORDER BY CASE model_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in MODEL_ORDER.items())} ELSE 99 END, n_features, selection_score, mae, rmse, model_config_id
LIMIT 1"""))
def champion(spark: SparkSession, folder: str) -> DataFrame:
    row = mt.champion(materialize(metrics(spark, folder)))
    return rounded6(row.select("config_id", "model_type", "selection_score", "best_raw_selection_score", "equivalence_threshold"))


SUMMARY_SQL = ", ".join(
    [r6(f"min({c})", f"best_{c}") for c in mt.FAMILY_BEST["min"]]
    + [r6(f"max({c})", f"best_{c}") for c in mt.FAMILY_BEST["max"]]
    + [r6("avg(rmse)", "avg_rmse"), r6("avg(mae)", "avg_mae")]
)


@query("family_summary", "A6", with_ctes("metrics", f"""
SELECT feature_family_name, mode, {SUMMARY_SQL} FROM metrics WHERE evaluation_scope = 'overall' GROUP BY 1, 2"""))
def family_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(mt.family_summary(metrics(spark, folder)))


BOARD_OUT = ["mae", "rmse", "r2", "diracc", "selection_score"] + [f"{p}_{m}" for p in EVALUATION_PERIODS for m in ("mae", "rmse", "selection_score_typical")] + [
    *_RATIOS, "shock_abs_increase",
]


@query("leaderboard_wide", "V1 V2 J6 W22", with_ctes("board", f"""
SELECT config_id, model_family, row_number() OVER (ORDER BY selection_score, model_config_id) AS rank, n_predictions, {', '.join(r6(m, m, 6) for m in BOARD_OUT)} FROM board"""))
def leaderboard_wide(spark: SparkSession, folder: str) -> DataFrame:
    out = lb.rank_leaderboard(board(spark, folder))
    return rounded6(out.select("config_id", "model_family", "rank", "n_predictions", *BOARD_OUT), 6)


@query("enriched_scores", "A5 V2", with_ctes("board", f"""
SELECT config_id, {', '.join(r6(m, m) for m in ('selection_score_typical', 'recovery_selection_score_balanced', 'large_error_score_shock_penalty'))},
       {r6('recovery_selection_score', 'recovery_selection_score')} FROM board"""))
def enriched_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores rebuilt from the MAE and RMSE columns alone, as for an older artifact."""
    bare = board(spark, folder).select("config_id", "mae", "rmse", *[f"{p}_{m}" for p in EVALUATION_PERIODS for m in ("mae", "rmse")])
    out = lb.enrich_scores(bare)
    return rounded6(out.select("config_id", "selection_score_typical", "recovery_selection_score_balanced", "large_error_score_shock_penalty", "recovery_selection_score"))


@query("transform_build_pivot", "V4", with_ctes("board", f"""
SELECT feature_transform, {r6("min(selection_score) FILTER (WHERE model_build = 'ridge')", 'ridge')},
       {r6("min(selection_score) FILTER (WHERE model_build = 'lasso')", 'lasso')},
       {r6("min(selection_score) FILTER (WHERE model_build = 'xgboost')", 'xgboost')} FROM board GROUP BY 1"""))
def transform_build_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(lb.transform_build_pivot(board(spark, folder), ["ridge", "lasso", "xgboost"]))


@query("performance_over_time", "W20", with_ctes("pred", f"""
SELECT config_id, as_of_date, {', '.join(r6(f'avg(abs_error) OVER (PARTITION BY config_id ORDER BY as_of_date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)', f'rolling_{k}mo_mae') for k in (3, 6, 12))}
FROM pred"""))
def performance_over_time(spark: SparkSession, folder: str) -> DataFrame:
    out = mt.rolling_error(fx.predictions(spark, folder))
    return rounded6(out.select("config_id", "as_of_date", "rolling_3mo_mae", "rolling_6mo_mae", "rolling_12mo_mae"))


cte("profile", "pred", f"""
  SELECT *, ln(1 + size) AS lsize, ln(1 + total_train_seconds) AS lcompute
  FROM (SELECT *, (n_input_features - n_selected_features) / nullif(n_input_features, 0) AS feature_reduction_ratio,
        CASE model_type WHEN 'naive' THEN 1.0 WHEN 'ridge' THEN greatest(1.0, n_selected_features) WHEN 'lasso' THEN greatest(1.0, n_selected_features)
             WHEN 'random_forest' THEN 800.0 WHEN 'xgboost' THEN CAST(500 AS DOUBLE) * 3 * CAST(0.8 AS DOUBLE)
             ELSE 4 * (n_selected_features * 32 + 32 * 32 + 32) + 4 * (32 * 32 + 32 * 32 + 32) + (32 * 16 + 16) + (16 * 8 + 8) + 8 + 1 END AS size
        FROM (SELECT {KEYS}, max(n_features_before_policy) AS n_input_features, round(avg(n_features_after_policy), 3) AS n_selected_features,
                     min(n_features_after_policy) AS min_selected_features, max(n_features_after_policy) AS max_selected_features,
                     avg(train_seconds) AS avg_train_seconds, sum(train_seconds) AS total_train_seconds, count(DISTINCT model_run_id) AS model_run_count,
                     CAST(sum(CAST(model_refit AS INT)) AS BIGINT) AS refit_count, avg(n_train) AS avg_n_train
              FROM pred GROUP BY {KEYS}))""")
cte("scored", "profile", """
  SELECT *, 100 * (CAST(0.4 AS DOUBLE) * uf + CAST(0.35 AS DOUBLE) * us + CAST(0.25 AS DOUBLE) * uc) AS complexity_score, 100 * uc AS compute_score,
         greatest(0.0, least(100.0, CASE model_family WHEN 'baseline' THEN 100.0 WHEN 'linear' THEN 86.0 WHEN 'tree' THEN 58.0 ELSE 50.0 END
                  - 25 * uf - 15 * us)) AS interpretability_score
  FROM (SELECT *, (n_selected_features - min(n_selected_features) OVER ()) / (max(n_selected_features) OVER () - min(n_selected_features) OVER ()) AS uf,
               (lsize - min(lsize) OVER ()) / (max(lsize) OVER () - min(lsize) OVER ()) AS us,
               (lcompute - min(lcompute) OVER ()) / (max(lcompute) OVER () - min(lcompute) OVER ()) AS uc FROM profile)""")


def profile(spark: SparkSession, folder: str, with_metrics: bool = False) -> DataFrame:
    runs = fx.predictions(spark, folder)
    return lb.complexity_profile(runs, mt.backtest_metrics(runs, in_order=True) if with_metrics else None)


@query("complexity_profile", "A7 A8 A9 X8 P17", with_ctes("scored metrics", f"""
SELECT s.config_id, n_input_features, {r6('n_selected_features', 'n_selected_features', 3)}, min_selected_features, max_selected_features, model_run_count, refit_count,
       {r6('s.avg_train_seconds', 'avg_train_seconds')}, {r6('avg_n_train', 'avg_n_train')}, {r6('feature_reduction_ratio', 'feature_reduction_ratio')},
       {r6('size', 'model_size_proxy')}, {r6('complexity_score', 'complexity_score', 3)}, {r6('compute_score', 'compute_score', 3)},
       {r6('interpretability_score', 'interpretability_score', 3)}, {r6('m.mae', 'overall_mae', 6)}
FROM scored s LEFT JOIN (SELECT config_id, mae FROM metrics WHERE evaluation_scope = 'overall') m USING (config_id)"""))
def complexity_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = profile(spark, folder, True)
    return rounded6(
        out.select(
            "config_id", "n_input_features", "n_selected_features", "min_selected_features", "max_selected_features", "model_run_count",
            "refit_count", "avg_train_seconds", "avg_n_train", "feature_reduction_ratio", "model_size_proxy", "complexity_score",
            "compute_score", "interpretability_score", "overall_mae",
        ),
        overall_mae=6,
    )


# --- retention and mart ----------------------------------------------------------------------------

KEEP = 0.05
cte("long_metrics", "board", "\n  UNION ALL ".join(
    f"SELECT model_config_id, '{m}' AS reason, {'-' if m in RETENTION_HIGHER else ''}{m} AS value FROM board WHERE {m} IS NOT NULL AND NOT isnan({m})"
    for m in [*RETENTION_LOWER, *RETENTION_HIGHER]))
cte("champ", "metrics", f"""
  SELECT model_config_id FROM (SELECT *, min(selection_score) OVER () AS best FROM metrics WHERE evaluation_scope = 'overall')
  WHERE selection_score <= best * CAST(1.02 AS DOUBLE)
  ORDER BY CASE model_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in MODEL_ORDER.items())} ELSE 99 END, n_features, selection_score, mae, rmse, model_config_id LIMIT 1""")
cte("reasons", "long_metrics champ", f"""
  SELECT model_config_id, l.reason FROM long_metrics l
  JOIN (SELECT reason, quantile_cont(value, CAST({KEEP} AS DOUBLE)) AS lim FROM long_metrics GROUP BY 1) q ON q.reason = l.reason WHERE l.value <= q.lim
  UNION ALL SELECT model_config_id, 'always_baseline' FROM board WHERE model_family = 'baseline'
  UNION ALL SELECT model_config_id, 'always_top_per_model_build' FROM (SELECT *, row_number() OVER (PARTITION BY model_build ORDER BY selection_score_balanced, model_config_id) AS rn FROM board) WHERE rn <= 3
  UNION ALL SELECT model_config_id, 'always_champion' FROM champ""")


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    measured = materialize(metrics(spark, folder))
    return bd.retention_reasons(lb.wide_leaderboard(measured), mt.champion(measured), KEEP, per_build=3)


@query("retention", "A10 U3", with_ctes("reasons", "SELECT DISTINCT model_config_id FROM reasons"))
def retention(spark: SparkSession, folder: str) -> DataFrame:
    """Configurations in the best 5 % of any of 43 metrics, plus baseline, top per build and champion."""
    return bd.selected_configs(_reasons(spark, folder))


@query("retention_reasons", "A10", with_ctes("reasons", "SELECT reason, count(DISTINCT model_config_id) AS configurations FROM reasons GROUP BY 1"))
def retention_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return bd.reason_counts(_reasons(spark, folder))


@query("curated_bundle", "B25 J8", with_ctes("reasons pred", """
SELECT 'forecast_paths' AS artifact, count(*) AS rows, count(DISTINCT config_id) AS configs FROM pred WHERE config_id IN (SELECT model_config_id FROM reasons)
UNION ALL SELECT 'model_leaderboard', count(*), count(DISTINCT config_id) FROM board WHERE config_id IN (SELECT model_config_id FROM reasons)
UNION ALL SELECT 'model_leaderboard_full', count(*), count(DISTINCT config_id) FROM board
UNION ALL SELECT 'overview_top_models', least(5, count(DISTINCT model_config_id)), least(5, count(DISTINCT model_config_id)) FROM reasons"""))
def curated_bundle(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    measured = materialize(mt.backtest_metrics(facts, in_order=True))
    wide = lb.wide_leaderboard(measured)
    reasons = bd.retention_reasons(wide, mt.champion(measured), KEEP, per_build=3)
    tables = bd.curate({"model_leaderboard": wide, "forecast_paths": facts}, reasons)
    names = ["forecast_paths", "model_leaderboard", "model_leaderboard_full", "overview_top_models"]
    counts = [
        tables[n].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("config_id").alias("configs")).select(F.lit(n).alias("artifact"), "rows", "configs")
        for n in names
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("partition_manifest", "S8 X5", with_ctes("pred", """
SELECT 'forecast_paths_by_build' AS dataset, model_build AS value, 'forecast_paths_by_build/model_build=' || model_build AS path,
       count(*) AS rows, count(DISTINCT model_config_id) AS configs FROM pred GROUP BY 2"""))
def partition_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return bd.partition_manifest(fx.predictions(spark, folder), "forecast_paths_by_build")


@query("champion_predictions", "J9 B24", with_ctes("champ pred", f"""
SELECT config_id, as_of_date, {r6('prediction', 'prediction')} FROM pred WHERE config_id IN (SELECT model_config_id FROM champ)"""))
def champion_predictions(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    chosen = mt.champion(materialize(mt.backtest_metrics(facts, in_order=True)))
    return rounded6(lb.champion_rows(facts, chosen).select("config_id", "as_of_date", "prediction"))


@query("overview_paths", "J7 T2 B24", with_ctes("board pred", f"""
SELECT p.config_id, p.target_date, t.rank, {r6('p.prediction', 'prediction')}
FROM pred p JOIN (SELECT config_id, row_number() OVER (ORDER BY selection_score, model_config_id) AS rank FROM board) t USING (config_id) WHERE t.rank <= 5"""))
def overview_paths(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    _, paths = lb.overview(lb.wide_leaderboard(mt.backtest_metrics(facts, in_order=True)), facts.select("config_id", "target_date", "prediction"))
    return rounded6(paths.select("config_id", "target_date", "rank", "prediction"))


@query("recombined", "U1 U5 S11", with_ctes("metrics", f"""
SELECT config_id, evaluation_scope, n_predictions, {r6('mae', 'mae', 6)} FROM metrics"""))
def recombined(spark: SparkSession, folder: str) -> DataFrame:
    """Two halves of an experiment, one without an optional column, united and measured again."""
    facts = fx.predictions(spark, folder)
    linear = facts.where(F.col("model_family").isin("linear", "baseline")).withColumn("source_model_config_id", F.lit("seed"))
    other = facts.where(~F.col("model_family").isin("linear", "baseline"))
    out = lb.recombine([linear, other], [linear, other], fx.tasks(spark, folder), in_order=True)["metrics"]
    return rounded6(out.select("config_id", "evaluation_scope", "n_predictions", "mae"), 6)
