"""A whole experiment on the supplier panel, its facts, runs, metrics and champion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators import backtest as bt
from hindcast.operators import experiment as ex
from hindcast.plans import fixtures as fx
from hindcast.plans.registry import cte, query, r4, rounded, with_ctes
from hindcast.plans.stats_queries import EMBARGO, FEATURES, feature_panel

FAMILIES = {"last": ["y_lag1"], "pair": ["y_lag1", "y_lag12"]}
MODELS = [("naive", {}), ("ridge", {"alpha": 1.0}), ("ridge", {"alpha": 10.0})]
MODES, POLICIES, TRANSFORMS = ["raw", "residual"], ["none", "variance_pruned", "corr_pruned"], ["identity", "log_signed"]
START = "2000-01-01"


def _when() -> tuple[Column, Column]:
    first = F.lit(START).cast("date")
    return (F.col("date") >= first) & F.col("target").isNotNull() & F.col("baseline").isNotNull(), bt.fit_date(F.col("date"), first, 3, 1)


def _run(spark: SparkSession, folder: str) -> ex.Experiment:
    """Two families, three policies, two transforms, two modes and two penalties, one model per supplier and quarter."""
    evaluated, fit_on = _when()
    return ex.run_experiment(
        feature_panel(spark, folder), ["series"], FAMILIES, MODELS, MODES, POLICIES, TRANSFORMS, "target", "baseline",
        evaluated, fit_on, EMBARGO, fx.HORIZON, 3, periods=fx.PERIODS,
    )


# The same fits in SQL: four columns, of which each configuration uses some, and the normal equations of a
# ridge solved by elimination. Unused columns get a one on the diagonal and a zero elsewhere.
_X = ["x1", "x2", "x3", "x4"]
_OF = {"last": ("x1", "x3"), "pair": ("x1", "x2", "x3", "x4")}


def _log(c: str) -> str:
    return f"sign({c}) * ln(1 + abs({c}))"


cte("rpanel", "fpanel", f"""
  SELECT series, date, CAST(target AS DOUBLE) AS target, CAST(baseline AS DOUBLE) AS baseline, y_lag1 IS NOT NULL AS has_last, y_lag1 IS NOT NULL AND y_lag12 IS NOT NULL AS has_pair,
         CAST(coalesce(y_lag1, 0) AS DOUBLE) AS x1, CAST(coalesce(y_lag12, 0) AS DOUBLE) AS x2, coalesce({_log('y_lag1')}, 0.0) AS x3, coalesce({_log('y_lag12')}, 0.0) AS x4,
         CAST(DATE '{START}' + to_months(CAST(((year(date) - 2000) * 12 + month(date) - 1) // 3 * 3 AS INT)) AS DATE) AS fit_date
  FROM fpanel""")


def _moments_sql(family: str) -> str:
    pairs = [(a, b) for i, a in enumerate(_X) for b in _X[i:]]
    sums = [f"covar_pop({a}, {b}) * count(*) AS g_{a}_{b}" for a, b in pairs]
    sums += [f"covar_pop({a}, target) * count(*) AS c_raw_{a}" for a in _X] + [f"covar_pop({a}, target - baseline) * count(*) AS c_residual_{a}" for a in _X]
    means = ", ".join(f"avg({a}) AS m_{a}" for a in _X)
    return f"""SELECT t.series, d.fit_date, '{family}' AS family, count(*) AS n, {', '.join(sums)}, {means}, avg(target) AS m_raw, avg(target - baseline) AS m_residual
      FROM (SELECT DISTINCT series, fit_date FROM rpanel WHERE date >= DATE '{START}' AND target IS NOT NULL AND baseline IS NOT NULL) d
      JOIN rpanel t ON t.series = d.series AND t.date < CAST(d.fit_date - INTERVAL 3 MONTH AS DATE)
      WHERE t.target IS NOT NULL AND t.baseline IS NOT NULL AND t.has_{family} GROUP BY 1, 2 HAVING count(*) >= 24"""


def _grid_sql() -> str:
    rows = []
    for family in FAMILIES:
        for policy in POLICIES:
            for transform in TRANSFORMS:
                for mode in MODES:
                    for alpha in (1.0, 10.0):
                        name = "__".join(["ridge", mode, family, *([f"policy-{policy}"] if policy != "none" else []), *([f"transform-{transform}"] if transform != "identity" else []), f"alpha-{alpha}"])
                        rows.append(f"('{name}', '{family}', '{policy}', '{transform}', '{mode}', {alpha}::DOUBLE)")
    return ", ".join(rows)


cte("rmoments", "rpanel", "\n  UNION ALL ".join(_moments_sql(f) for f in FAMILIES))
_SECOND = "(family = 'pair' AND keep_second)"
_USE = {"x1": "keep_first", "x2": _SECOND, "x3": "keep_first AND feature_transform = 'log_signed'", "x4": f"{_SECOND} AND feature_transform = 'log_signed'"}


def _entry(a: str, b: str) -> str:
    first, second = sorted((a, b))
    ridge = " + alpha" if a == b else ""
    return f"CASE WHEN u_{a} AND u_{b} THEN g_{first}_{second} / (s_{a} * s_{b}){ridge} ELSE {1 if a == b else 0}.0 END AS a_{a}_{b}"


# The policies look at the two base columns; each keeps the first if nothing would stay.
cte("rmasked", "rmoments", f"""
  SELECT *, {', '.join(f"({use}) AND g_{x}_{x} > 1e-9 AS u_{x}" for x, use in _USE.items())}, {', '.join(f"CASE WHEN g_{x}_{x} > 1e-9 THEN sqrt(g_{x}_{x} / n) ELSE 1.0 END AS s_{x}" for x in _X)}
  FROM (SELECT *, CASE policy WHEN 'variance_pruned' THEN g_x1_x1 / (n - 1) > 1e-8 OR family = 'last' OR g_x2_x2 / (n - 1) <= 1e-8 ELSE true END AS keep_first,
          CASE policy WHEN 'variance_pruned' THEN g_x2_x2 / (n - 1) > 1e-8
               WHEN 'corr_pruned' THEN NOT coalesce(g_x1_x1 > 1e-9 AND g_x2_x2 > 1e-9 AND abs(g_x1_x2) / nullif(sqrt(g_x1_x1 * g_x2_x2), 0) > 0.95, false) ELSE true END AS keep_second
        FROM rmoments JOIN (VALUES {_grid_sql()}) AS c(config_id, family, policy, feature_transform, mode, alpha) USING (family))""")
_PASS = "config_id, series, fit_date, family, policy, feature_transform, mode, n, keep_first, keep_second, " + ", ".join(f"s_{x}, m_{x}" for x in _X) + ", m_raw, m_residual"
cte("relim0", "rmasked", f"SELECT {_PASS}, {', '.join(_entry(a, b) for a in _X for b in _X)}, {', '.join(f'CASE WHEN u_{a} THEN CASE mode WHEN $$raw$$ THEN c_raw_{a} ELSE c_residual_{a} END / s_{a} ELSE 0.0 END AS b_{a}' for a in _X)} FROM rmasked")
for _k, _pivot in enumerate(_X):
    _rest = [x for x in _X if x != _pivot]
    cte(f"relim{_k + 1}", f"relim{_k}", f"SELECT {_PASS}, " + ", ".join(
        [f"a_{a}_{b} - a_{a}_{_pivot} * a_{_pivot}_{b} / a_{_pivot}_{_pivot} AS a_{a}_{b}" for a in _rest for b in _X]
        + [f"b_{a} - a_{a}_{_pivot} * b_{_pivot} / a_{_pivot}_{_pivot} AS b_{a}" for a in _rest]
        + [f"a_{_pivot}_{b}" for b in _X] + [f"b_{_pivot}"]) + f" FROM relim{_k}")
cte("rfits", "relim4", f"SELECT {_PASS}, {', '.join(f'b_{x} / a_{x}_{x} / s_{x} AS w_{x}' for x in _X)} FROM relim4")
_SELECTED = "'[' || concat_ws(', ', CASE WHEN keep_first THEN '\"y_lag1\"' END, CASE WHEN family = 'pair' AND keep_second THEN '\"y_lag12\"' END) || ']'"
_DROPPED = "'[' || concat_ws(', ', CASE WHEN NOT keep_first THEN '\"y_lag1\"' END, CASE WHEN family = 'pair' AND NOT keep_second THEN '\"y_lag12\"' END) || ']'"
cte("rfacts", "rfits rpanel", f"""
  SELECT f.config_id, 'linear' AS model_family, 'ridge' AS model_build, 'ridge' AS model_type, f.mode, f.family AS feature_family_name, f.policy AS feature_policy, f.feature_transform,
         p.series, p.date AS as_of_date, f.fit_date, CAST(f.n AS BIGINT) AS n_train, p.target AS actual, p.baseline AS seasonal_naive_prediction,
         CASE f.mode WHEN 'raw' THEN m_raw ELSE m_residual + p.baseline END + {' + '.join(f'w_{x} * (p.{x} - m_{x})' for x in _X)} AS prediction,
         {_SELECTED} AS selected_feature_names_json, {_DROPPED} AS dropped_feature_names_json,
         (keep_first::INT + (f.family = 'pair' AND keep_second)::INT) * CASE f.feature_transform WHEN 'identity' THEN 1 ELSE 2 END AS n_features
  FROM rfits f JOIN rpanel p ON p.series = f.series AND p.fit_date = f.fit_date
  WHERE p.date >= DATE '{START}' AND p.target IS NOT NULL AND p.baseline IS NOT NULL AND CASE f.family WHEN 'last' THEN p.has_last ELSE p.has_pair END
  UNION ALL SELECT 'naive__raw__baseline_naive', 'baseline', 'seasonal_naive', 'naive', 'raw', 'baseline_naive', 'none', 'identity', series, date, fit_date, 0, target, baseline, baseline, '[]', '[]', 0
  FROM rpanel WHERE date >= DATE '{START}' AND target IS NOT NULL AND baseline IS NOT NULL""")
_PERIOD = "CASE WHEN target_date <= DATE '1998-12-01' THEN 'pre_covid' WHEN target_date BETWEEN DATE '1999-01-01' AND DATE '1999-09-01' THEN 'covid_shock' WHEN target_date BETWEEN DATE '1999-10-01' AND DATE '2000-06-01' THEN 'recovery' WHEN target_date >= DATE '2000-07-01' THEN 'recent' ELSE 'pre_covid' END"
cte("rscored", "rfacts", f"""
  SELECT *, {_PERIOD} AS evaluation_period, abs(prediction - actual) AS gap, abs(seasonal_naive_prediction - actual) AS naive_gap FROM (SELECT *, CAST(as_of_date + INTERVAL 3 MONTH AS DATE) AS target_date FROM rfacts)""")
cte("rscoped", "rscored", """
  SELECT *, sign(actual - lag(actual) OVER w) = sign(prediction - lag(prediction) OVER w) AS hit, 'overall' AS evaluation_scope FROM rscored WINDOW w AS (PARTITION BY config_id, series ORDER BY as_of_date)
  UNION ALL SELECT *, sign(actual - lag(actual) OVER w) = sign(prediction - lag(prediction) OVER w) AS hit, evaluation_period FROM rscored WINDOW w AS (PARTITION BY config_id, series, evaluation_period ORDER BY as_of_date)""")
cte("rmetrics", "rscoped", """
  SELECT config_id, model_type, feature_family_name, evaluation_scope, count(*) AS n_predictions, CAST(max(n_features) AS BIGINT) AS n_features, avg(gap) AS mae, sqrt(avg(gap * gap)) AS rmse,
         avg(naive_gap) AS mae_naive, 1 - sum(gap * gap) / (var_pop(actual) * count(*)) AS r2, avg(CAST(hit AS INT)) AS diracc,
         CAST(0.75 AS DOUBLE) * avg(gap) + CAST(0.25 AS DOUBLE) * sqrt(avg(gap * gap)) AS selection_score FROM rscoped GROUP BY 1, 2, 3, 4""")
_METRICS = ["mae", "rmse", "mae_naive", "r2", "diracc", "selection_score"]


@query("experiment_predictions", "B1 B5 B6 B7 B8 B13 B14 B15 B17", with_ctes("rscored", f"""
SELECT config_id, series, as_of_date, target_date, fit_date, fit_date = as_of_date AS model_refit, evaluation_period, n_train, CAST(n_features AS BIGINT) AS n_features,
       {r4('actual', 'actual')}, {r4('prediction', 'prediction', 3)}, {r4('gap', 'abs_error', 3)} FROM rscored"""))
def experiment_predictions(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(spark, folder).predictions
    return rounded(out.select("config_id", "series", "as_of_date", "target_date", "fit_date", "model_refit", "evaluation_period", "n_train", "n_features", "actual", "prediction", "abs_error"), prediction=3, abs_error=3)


@query("experiment_runs", "B1 B12 B18 X8", with_ctes("rfacts", """
SELECT config_id || '__as_of_' || strftime(as_of_date, '%Y-%m-%d') AS model_run_id, series, n_train, selected_feature_names_json, dropped_feature_names_json,
       CASE feature_policy WHEN 'corr_pruned' THEN '{"threshold": 0.95}' WHEN 'variance_pruned' THEN '{"threshold": 1e-08}' ELSE '{}' END AS feature_policy_params_json,
       CASE model_type WHEN 'naive' THEN '{}' ELSE '{"alpha": ' || regexp_extract(config_id, '[0-9.]+$') || '}' END AS hyperparameters_json,
       CASE feature_family_name WHEN 'pair' THEN '["y_lag1", "y_lag12"]' WHEN 'last' THEN '["y_lag1"]' ELSE '[]' END AS feature_names_json,
       CASE feature_transform WHEN 'identity' THEN 'tabular_raw' ELSE 'tabular_log_signed' END AS representation_policy,
       CAST(3 AS BIGINT) AS refit_frequency_months, 'succeeded' AS status FROM rfacts"""))
def experiment_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(spark, folder).runs
    return rounded(out.select("model_run_id", "series", "n_train", "selected_feature_names_json", "dropped_feature_names_json", "feature_policy_params_json", "hyperparameters_json", "feature_names_json", "representation_policy", "refit_frequency_months", "status"))


@query("experiment_metrics", "A2 A3 A4 A5 B1 B15", with_ctes("rmetrics", f"""
SELECT config_id, evaluation_scope, n_predictions, n_features, {', '.join(r4(m, m, 3) for m in _METRICS)} FROM rmetrics"""))
def experiment_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Several suppliers under one configuration: directions follow each of them."""
    out = _run(spark, folder).metrics
    return rounded(out.select("config_id", "evaluation_scope", "n_predictions", "n_features", *_METRICS), 3)


@query("experiment_champion", "T5 B1", with_ctes("rmetrics", f"""
SELECT config_id, model_type, n_predictions, n_features, {r4('mae', 'mae', 3)}, {r4('selection_score', 'selection_score', 3)}
FROM (SELECT *, CASE model_type WHEN 'naive' THEN 0 ELSE 1 END AS place FROM rmetrics WHERE evaluation_scope = 'overall' AND selection_score <= 1.02 * (SELECT min(selection_score) FROM rmetrics WHERE evaluation_scope = 'overall'))
ORDER BY place, n_features, selection_score, mae, rmse, config_id LIMIT 1"""))
def experiment_champion(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(spark, folder).champion
    return rounded(out.select("config_id", "model_type", "n_predictions", "n_features", "mae", "selection_score"), 3)


@query("experiment_importance", "B19", with_ctes("rfits", f"""
SELECT config_id, series, fit_date AS as_of_date, feature_name, {r4('weight', 'importance', 3)} FROM (
  {' UNION ALL '.join(f"SELECT config_id, series, fit_date, '{name}' AS feature_name, w_{x} * s_{x} AS weight FROM rfits WHERE {_USE[x]}" for x, name in (('x1', 'y_lag1'), ('x2', 'y_lag12'), ('x3', 'y_lag1__log_signed'), ('x4', 'y_lag12__log_signed')))})"""))
def experiment_importance(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(spark, folder).importances
    return rounded(out.select("config_id", "series", "as_of_date", "feature_name", "importance"), 3)


@query("experiment_trees", "B1 B11 B16 B18")
def experiment_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Linear, bagged and boosted configurations of one grid, each with the policies that apply to it."""
    evaluated, fit_on = _when()
    models = [
        ("ridge", {"alpha": 1.0}), ("lasso", {"alpha": 1.0}), ("elastic_net", {"alpha": 1.0, "l1_ratio": 0.5}),
        ("random_forest", {"n_estimators": 20, "max_depth": 4}), ("extra_trees", {"n_estimators": 20, "max_depth": 4}),
        ("xgboost", {"colsample_bytree": 0.8, "learning_rate": 0.05, "max_depth": 3, "n_estimators": 50}),
    ]
    out = ex.run_experiment(
        feature_panel(spark, folder), ["series"], {"all": FEATURES}, models, ["residual"], ["none", "lasso_selected", "tree_top_3", "mutual_info_top_3"], ["identity"], "target", "baseline",
        evaluated, fit_on, EMBARGO, fx.HORIZON, 3, periods=fx.PERIODS,
    )
    return rounded(out.metrics.select("config_id", "evaluation_scope", "n_predictions", "n_features", *_METRICS), 3)
