"""Leaderboard exploration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.constants import BUILD_ORDER, EVALUATION_PERIODS, FAMILY_ORDER
from hindcast.functions.scalar import params_display
from hindcast.operators import explore as ex
from hindcast.operators import leaderboard as lb
from hindcast.operators import metrics as mt
from hindcast.operators.reshape import build_label, with_taxonomy
from hindcast.plans import fixtures as fx
from hindcast.plans.experiment_queries import LABELS, board, labelled, profile
from hindcast.plans.registry import cte, query, r6, rounded6, with_ctes

BUILDS = "model_family, model_build, model_build_label"


@query("rank_by_metric", "T1 P13 W22", with_ctes("labelled", f"""
SELECT config_id, {r6('r2', 'r2')}, row_number() OVER (ORDER BY -r2, model_config_id) AS rank FROM labelled
WHERE r2 IS NOT NULL AND model_family <> 'baseline'"""))
def rank_by_metric(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ex.rank_by(ex.without_baselines(labelled(spark, folder)), "R-squared")
    return rounded6(ranked.select("config_id", "r2", "rank"))


@query("top_total", "T2 T8", with_ctes("board", f"""
SELECT config_id, {r6('mae', 'mae')}, row_number() OVER (ORDER BY mae, model_config_id) AS rank FROM board ORDER BY mae, model_config_id LIMIT 25"""))
def top_total(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.top_rows(board(spark, folder), "mae", True, 25).select("config_id", "mae", "rank"))


@query("top_per_build", "T3", with_ctes("board", f"""
SELECT * FROM (SELECT model_build, config_id, {r6('rmse', 'rmse')}, row_number() OVER (PARTITION BY model_build ORDER BY rmse, model_config_id) AS group_rank FROM board)
WHERE group_rank <= 5"""))
def top_per_build(spark: SparkSession, folder: str) -> DataFrame:
    out = ex.top_per_group(board(spark, folder), ["model_build"], "rmse", True, 5)
    return rounded6(out.select("model_build", "config_id", "rmse", "group_rank"))


@query("top_fraction", "T4 B2 U2", with_ctes("board", f"""
SELECT config_id, {r6('selection_score', 'selection_score')}, rn AS rank
FROM (SELECT *, row_number() OVER (ORDER BY selection_score, model_config_id) AS rn, count(*) OVER () AS n FROM board WHERE model_family = 'linear')
WHERE rn <= greatest(1, ceil(n * CAST(0.1 AS DOUBLE)))"""))
def top_fraction(spark: SparkSession, folder: str) -> DataFrame:
    picked = ex.seeds(board(spark, folder), {"model_family": "linear"}, "selection_score", 0.1)
    return rounded6(picked.select("config_id", "selection_score", "rank"))


@query("taxonomy_order", "T6 P16", with_ctes("board", f"""
SELECT DISTINCT model_family, model_build, {LABELS} AS model_build_label,
       CASE model_family {' '.join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(FAMILY_ORDER))} END AS family_order,
       CASE model_build {' '.join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(BUILD_ORDER))} END AS build_order FROM board"""))
def taxonomy_order(spark: SparkSession, folder: str) -> DataFrame:
    builds = fx.predictions(spark, folder).select("model_family", "model_build").distinct()
    return rounded6(ex.taxonomy_order(builds.withColumn("model_build_label", build_label())))


@query("largest_errors", "T7", with_ctes("board pred", f"""
SELECT as_of_date, {r6('abs_error', 'abs_error')}, row_number() OVER (ORDER BY abs_error DESC, as_of_date) AS rank
FROM pred WHERE config_id = (SELECT config_id FROM board ORDER BY selection_score, model_config_id LIMIT 1) ORDER BY pred.abs_error DESC, as_of_date LIMIT 20"""))
def largest_errors(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    best = ex.top_rows(lb.wide_leaderboard(mt.backtest_metrics(facts, in_order=True)), "selection_score", True, 1)
    worst = ex.largest_errors(facts, best.select("config_id").scalar(), 20)
    return rounded6(worst.select("as_of_date", "abs_error", "rank"))


@query("middle_row", "T10", with_ctes("pred", f"""
SELECT config_id, as_of_date, {r6('prediction', 'prediction')} FROM
  (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY as_of_date) - 1 AS i, count(*) OVER (PARTITION BY config_id) AS n FROM pred)
WHERE i = n // 2"""))
def middle_row(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.middle_row(fx.predictions(spark, folder).select("config_id", "as_of_date", "prediction"), "config_id", "as_of_date"))


@query("model_labels", "T11 P22 X8", with_ctes("labelled", """
SELECT config_id, '#' || row_number() OVER (ORDER BY selection_score_balanced, model_config_id) || ' | ' || model_build_label || ' | ' || mode || ' | ' || feature_family_name
       || ' | ' || feature_transform_label || ' | ' || params AS label, shown AS hyperparameters
FROM (SELECT *, CASE model_type WHEN 'naive' THEN 'params: none' WHEN 'ridge' THEN 'alpha=1.0' WHEN 'lasso' THEN 'alpha=100.0, max_iter=5000'
             WHEN 'random_forest' THEN 'n=200, depth=4' WHEN 'xgboost' THEN 'n=500, depth=3, colsample_bytree=0.8'
             ELSE 'dense_head_sizes=[16, 8], hidden_size=32, num_layers=2' END AS params,
             CASE model_type WHEN 'naive' THEN 'N/A' WHEN 'ridge' THEN 'alpha=1.0' WHEN 'lasso' THEN 'alpha=100.0, max_iter=5000'
             WHEN 'random_forest' THEN 'max_depth=4, n_estimators=200' WHEN 'xgboost' THEN 'colsample_bytree=0.8, max_depth=3, n_estimators=500'
             ELSE 'dense_head_sizes=[16, 8], hidden_size=32, num_layers=2' END AS shown FROM labelled)"""))
def model_labels(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ex.rank_by(labelled(spark, folder), "Balanced score")
    parts = F.split(ex.model_label("Balanced score"), r" \| ")
    text = F.concat_ws(" | ", F.slice(parts, 1, 5), F.element_at(parts, -1))
    return ranked.select("config_id", text.alias("label"), params_display("hyperparameters_json").alias("hyperparameters"))


@query("metric_tables", "P22", with_ctes("labelled", f"""
SELECT row_number() OVER (ORDER BY rmse, model_config_id) AS rank, model_build_label, feature_family_name, mode, {r6('mae', 'mae', 6)}, {r6('recent_rmse', 'recent_rmse', 6)} FROM labelled"""))
def metric_tables(spark: SparkSession, folder: str) -> DataFrame:
    table = ex.metric_table(ex.rank_by(labelled(spark, folder), "RMSE"), "ranked")
    return rounded6(table.select("rank", "model_build_label", "feature_family_name", "mode", "mae", "recent_rmse"), 6)


@query("curated_rows", "T13", with_ctes("board", """
SELECT entry, config_id, rank FROM (
  SELECT w.entry, b.config_id, b.rank, row_number() OVER (PARTITION BY w.entry ORDER BY b.rank) AS rn
  FROM (SELECT *, row_number() OVER (ORDER BY selection_score_balanced, model_config_id) AS rank FROM board) b
  JOIN (VALUES (0, 'family_1', 'raw'), (1, 'family_3', NULL), (2, 'family_1', 'residual')) w(entry, f, m)
    ON b.feature_family_name = w.f AND (w.m IS NULL OR b.mode = w.m)) WHERE rn = 1"""))
def curated_rows(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ex.rank_by(board(spark, folder), "Balanced score")
    rows = ex.curated_rows(ranked, [("family_1", "raw"), ("family_3", None), ("family_1", "residual")])
    return rounded6(rows.select("entry", "config_id", "rank"))


SIGNATURES = """SELECT model_config_id, list(CASE WHEN model_type = 'naive' THEN 0 ELSE round(prediction, 3) END ORDER BY target_date) AS sig FROM pred GROUP BY 1, model_type"""


@query("distinct_paths", "A33", with_ctes("board pred", f"""
SELECT model_config_id, path_rank, dup AS duplicate_count FROM (
  SELECT *, (SELECT count(*) FROM ranked_sig WHERE rank <= m.m) - m.n AS dup
  FROM (SELECT r.model_config_id, l.path_rank FROM leaders l JOIN ranked_sig r ON r.rank = l.first_rank),
       (SELECT max(first_rank) m, count(*) n FROM leaders) m)
""").replace("\nSELECT model_config_id, path_rank, dup", f""", sigs AS ({SIGNATURES}),
ranked_sig AS (SELECT s.*, b.rank FROM sigs s JOIN (SELECT model_config_id, row_number() OVER (ORDER BY selection_score_balanced, model_config_id) AS rank FROM board) b USING (model_config_id)),
leaders AS (SELECT *, row_number() OVER (ORDER BY first_rank) AS path_rank FROM (SELECT sig, min(rank) AS first_rank FROM ranked_sig GROUP BY sig) ORDER BY first_rank LIMIT 200)
SELECT model_config_id, path_rank, dup"""))
def distinct_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Baselines are given one shared path here so that duplicates exist."""
    facts = fx.predictions(spark, folder)
    ranked = ex.rank_by(lb.wide_leaderboard(mt.backtest_metrics(facts, in_order=True)), "Balanced score")
    flat = facts.withColumn("prediction", F.when(F.col("model_type") == "naive", F.lit(0.0)).otherwise(F.col("prediction")))
    chosen = ex.distinct_paths(ranked.select("model_config_id", "rank"), flat, 200)
    return rounded6(chosen.select("model_config_id", "path_rank", "duplicate_count"))


@query("explore_paths", "T12 P11 P12 S9", with_ctes("board pred", f"""
SELECT p.config_id, p.target_date, {r6('p.prediction', 'prediction')} FROM pred p WHERE p.target_date BETWEEN DATE '1999-01-01' AND DATE '1999-09-01' AND p.config_id IN (
  SELECT config_id FROM (SELECT *, row_number() OVER (PARTITION BY model_build ORDER BY mae, model_config_id) AS rn FROM board
                         WHERE model_family <> 'baseline' AND mode = 'raw' AND feature_family_name IN ('family_1', 'family_2', 'family_4'))
  WHERE rn <= 3 ORDER BY mae, model_config_id LIMIT 10)"""))
def explore_paths(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    choices = {"mode": "raw", "feature_family_name": ["family_1", "family_2", "family_4"], "feature_policy": "All"}
    _, paths = ex.explore(
        lb.wide_leaderboard(mt.backtest_metrics(facts, in_order=True)), facts, choices, "MAE", 3, 10, "1999-01-01", "1999-09-01"
    )
    return rounded6(paths.select("config_id", "target_date", "prediction"))


@query("average_paths", "A11 J7", with_ctes("pred", f"""
SELECT 'avg::' || model_build AS model_config_id, model_build, target_date, {r6('avg(prediction)', 'prediction', 7)}, {r6('avg(seasonal_naive_prediction)', 'seasonal_naive_prediction', 7)},
       arg_min(actual, model_config_id) AS actual FROM pred GROUP BY model_family, model_build, target_date"""))
def average_paths(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    models = with_taxonomy(facts.select("model_config_id", "model_family", "model_build", "model_type").distinct())
    out = ex.average_paths(facts, models)
    return rounded6(out.select("model_config_id", "model_build", "target_date", "prediction", "seasonal_naive_prediction", "actual"), 7)


@query("average_performance", "A12 W20", with_ctes("pred", f"""
SELECT 'avg::' || model_build AS config_id, as_of_date, {r6('avg(r6)', 'rolling_6mo_mae', 7)} FROM (
  SELECT *, avg(abs_error) OVER (PARTITION BY config_id ORDER BY as_of_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS r6 FROM pred)
GROUP BY model_build, as_of_date"""))
def average_performance(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    models = with_taxonomy(facts.select("config_id", "model_family", "model_build", "model_type").distinct())
    out = ex.average_performance(mt.rolling_error(facts), models)
    return rounded6(out.select("config_id", "as_of_date", "rolling_6mo_mae"), 7)


@query("target_windows", "P12 W27", with_ctes("pred", """
SELECT min(target_date) AS first_date, max(target_date) AS last_date, greatest(min(target_date), DATE '1999-01-01') AS start_date,
       least(max(target_date), DATE '1999-09-01') AS end_date, '1 month' AS interval FROM pred"""))
def target_windows(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder).select("target_date")
    bounds = ex.date_bounds(facts, "target_date")
    window = ex.default_window(bounds, "1999-01-01", "1999-09-01")
    interval = ex.month_interval(facts, "target_date")
    return bounds.withColumns(
        {
            "start_date": window.select("start_date").scalar(),
            "end_date": window.select("end_date").scalar(),
            "interval": interval.scalar(),
        }
    )


@query("metric_mapping", "A13", with_ctes("labelled", f"""
SELECT {BUILDS}, {r6('avg(mae)', 'mae')}, {r6('avg(recent_mae)', 'recent_mae')}, {r6('avg(shock_penalty)', 'shock_penalty')}, count(*) AS configurations
FROM labelled GROUP BY {BUILDS}"""))
def metric_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.metric_mapping(labelled(spark, folder), ["mae", "recent_mae", "shock_penalty"]))


def _summary_sql(group: str) -> str:
    return f"""
SELECT {group}, count(DISTINCT config_id) AS configurations, {r6('min(selection_score_balanced)', 'best_balanced_score')},
       {r6('median(selection_score_balanced)', 'median_balanced_score')}, {r6('min(mae)', 'best_mae')}, {r6('median(mae)', 'median_mae')},
       {r6('min(rmse)', 'best_rmse')}, {r6('max(r2)', 'best_r2')} FROM labelled GROUP BY {group}"""


@query("build_summary", "A14", with_ctes("labelled", _summary_sql(BUILDS)))
def build_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.group_summary(labelled(spark, folder), ex.BUILD_KEYS))


@query("policy_summary", "A14 A15", with_ctes("labelled", _summary_sql("model_build_label, feature_policy")))
def policy_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.group_summary(labelled(spark, folder), ["model_build_label", "feature_policy"]))


@query("scope_counts", "A15", with_ctes("pred", """
SELECT feature_family_name, model_build, count(DISTINCT config_id) AS configurations FROM pred GROUP BY 1, 2"""))
def scope_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ex.scope_counts(fx.predictions(spark, folder), ["feature_family_name", "model_build"])


@query("period_difficulty", "A16", with_ctes("board", "\nUNION ALL\n".join(f"""
SELECT '{p}' AS period, {r6(f'min({p}_mae)', 'best_mae')}, {r6(f'median({p}_mae)', 'median_mae')}, {r6(f'min({p}_rmse)', 'best_rmse')}, {r6(f'median({p}_rmse)', 'median_rmse')},
       {r6(f'(median({p}_mae) - min({p}_mae)) / median({p}_mae)', 'best_vs_median_improvement')} FROM board""" for p in EVALUATION_PERIODS)))
def period_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.period_difficulty(board(spark, folder)))


_MAES = ", ".join(f"{p}_mae" for p in EVALUATION_PERIODS)


@query("robustness", "A17 X11", with_ctes("board", f"""
SELECT config_id, {r6(f'greatest({_MAES})', 'worst_period_mae')}, {r6(f'greatest({_MAES}) - least({_MAES})', 'period_mae_spread')},
       {r6('list_avg(list_filter([' + _MAES + '], lambda x: x IS NOT NULL))', 'period_mae_mean')},
       {r6(f'CAST(0.5 AS DOUBLE) * selection_score_balanced + CAST(0.3 AS DOUBLE) * greatest({_MAES}) + CAST(0.2 AS DOUBLE) * (greatest({_MAES}) - least({_MAES}))', 'robustness_rank_score')} FROM board"""))
def robustness(spark: SparkSession, folder: str) -> DataFrame:
    out = ex.robustness(board(spark, folder))
    return rounded6(out.select("config_id", "worst_period_mae", "period_mae_spread", "period_mae_mean", "robustness_rank_score"))


@query("operational_footprint", "A18", with_ctes("scored", f"""
SELECT model_family, model_build, {LABELS} AS model_build_label, count(DISTINCT config_id) AS configurations, {r6('sum(total_train_seconds)', 'total_train_seconds')},
       {r6('median(total_train_seconds)', 'median_config_train_seconds')}, {r6('median(avg_train_seconds)', 'median_refit_train_seconds')},
       {r6('median(refit_count)', 'refit_count')}, {r6('median(avg_n_train)', 'avg_n_train')}, {r6('median(compute_score)', 'compute_score', 2)}, {r6('median(complexity_score)', 'complexity_score', 2)}
FROM scored GROUP BY 1, 2, 3"""))
def operational_footprint(spark: SparkSession, folder: str) -> DataFrame:
    labelled_profile = profile(spark, folder).withColumn("model_build_label", build_label())
    return rounded6(ex.operational_footprint(labelled_profile), compute_score=2, complexity_score=2)


@query("sensitivity_bins", "A19", with_ctes("scored board", f"""
, src AS (SELECT s.total_train_seconds * 1000 + b.pre_covid_mae AS x, b.mae AS y FROM scored s JOIN board b USING (config_id)),
e AS (SELECT list_distinct(list_sort(quantile_cont(x, [0.0, 1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0, 1.0]))) AS e FROM src),
b AS (SELECT x, y, greatest(len(list_filter(list_sort(e), lambda v: v < x)), 1) - 1 AS bin FROM src, e)
SELECT bin, count(*) AS configurations, {r6('min(y)', 'best')}, {r6('median(y)', 'median')} FROM b GROUP BY bin""").replace("\n\n,", "\n,"))
def sensitivity_bins(spark: SparkSession, folder: str) -> DataFrame:
    facts = fx.predictions(spark, folder)
    wide = lb.wide_leaderboard(mt.backtest_metrics(facts, in_order=True)).select("config_id", "mae", "pre_covid_mae")
    seconds = lb.run_profile(facts).select("config_id", "total_train_seconds")
    frame = wide.join(seconds, "config_id").withColumn("x", F.col("total_train_seconds") * 1000 + F.col("pre_covid_mae"))
    return rounded6(ex.sensitivity(frame, "x", "mae", True).select("bin", "configurations", "best", "median"))


@query("sensitivity_values", "A19 X9", with_ctes("labelled", f"""
SELECT CASE model_type WHEN 'ridge' THEN '1.0' ELSE '100.0' END AS setting, count(*) AS configurations, {r6('min(mae)', 'best')}, {r6('median(mae)', 'median')}
FROM labelled WHERE model_type IN ('ridge', 'lasso') GROUP BY 1"""))
def sensitivity_values(spark: SparkSession, folder: str) -> DataFrame:
    frame = ex.with_parameter_columns(labelled(spark, folder), ["alpha", "hidden_size"])
    return rounded6(ex.sensitivity_by_value(frame, "hp_alpha", "mae", True))


@query("parameter_rows", "X9 X10", with_ctes("board", """
SELECT b.model_config_id, v.name, v.value, v.number, v.first, v.total, v.largest, v.items FROM board b JOIN (VALUES
  ('ridge', 'hp_alpha', '1.0', 1.0, NULL, NULL, NULL, NULL), ('lasso', 'hp_alpha', '100.0', 100.0, NULL, NULL, NULL, NULL),
  ('lasso', 'hp_max_iter', '5000', 5000.0, NULL, NULL, NULL, NULL), ('random_forest', 'hp_max_depth', '4', 4.0, NULL, NULL, NULL, NULL),
  ('random_forest', 'hp_n_estimators', '200', 200.0, NULL, NULL, NULL, NULL), ('xgboost', 'hp_colsample_bytree', '0.8', 0.8, NULL, NULL, NULL, NULL),
  ('xgboost', 'hp_max_depth', '3', 3.0, NULL, NULL, NULL, NULL), ('xgboost', 'hp_n_estimators', '500', 500.0, NULL, NULL, NULL, NULL),
  ('lstm', 'hp_dense_head_sizes', '[16, 8]', NULL, 16.0, 24.0, 16.0, 2), ('lstm', 'hp_hidden_size', '32', 32.0, NULL, NULL, NULL, NULL),
  ('lstm', 'hp_num_layers', '2', 2.0, NULL, NULL, NULL, NULL)) v(model_type, name, value, number, first, total, largest, items) USING (model_type)
""").replace("v.number, v.first, v.total, v.largest, v.items FROM", "CAST(v.number AS DOUBLE) AS number, CAST(v.first AS DOUBLE) AS first, CAST(v.total AS DOUBLE) AS total, CAST(v.largest AS DOUBLE) AS largest, CAST(v.items AS BIGINT) AS items FROM"))
def parameter_rows(spark: SparkSession, folder: str) -> DataFrame:
    configs = fx.predictions(spark, folder).select("model_config_id", "hyperparameters_json").distinct()
    return rounded6(ex.parameter_long(configs))


@query("column_variation", "A20", with_ctes("board", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, round(avg(CAST(TRY_CAST({c} AS DOUBLE) IS NOT NULL AS INT)), 4) + 0.0 AS numeric_share,
       count(DISTINCT {c}) > 1 AS is_varied, avg(CAST(TRY_CAST({c} AS DOUBLE) IS NOT NULL AS INT)) >= 0.9 AS is_mostly_numeric FROM board WHERE {c} IS NOT NULL"""
    for c in ("mode", "model_build", "n_predictions", "feature_set_id"))))
def column_variation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.column_variation(board(spark, folder), ["mode", "model_build", "n_predictions", "feature_set_id"]))


@query("build_comparison", "A35", with_ctes("labelled", f"""
SELECT {BUILDS}, {r6('min(mae)', 'best_mae')}, {r6('min(rmse)', 'best_rmse')}, {r6('max(diracc)', 'best_metric')} FROM labelled GROUP BY {BUILDS}"""))
def build_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.build_comparison(labelled(spark, folder), "Directional accuracy"))


@query("build_share", "A35", with_ctes("board", """
SELECT model_build, count(*) AS in_top, count(*) / 50.0 AS share FROM (SELECT * FROM board ORDER BY selection_score, model_config_id LIMIT 50) GROUP BY 1
""").replace("count(*) / 50.0", "CAST(count(*) AS DOUBLE) / 50"))
def build_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded6(ex.build_share(board(spark, folder), "selection_score", True, 50))
