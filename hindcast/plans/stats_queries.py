"""Exploratory statistics, tests, policies and model queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.functions.calendar import month_number
from hindcast.operators import backtest as bt
from hindcast.operators import eda
from hindcast.operators import features as feat
from hindcast.operators import models as md
from hindcast.operators import policies as pol
from hindcast.operators import selection as sel
from hindcast.operators import stats as st
from hindcast.operators import trees as tr
from hindcast.operators.panel import exact_sum, on_spine, series_window, to_monthly
from hindcast.plans import fixtures as fx
from hindcast.plans.panel_queries import WIN, strict
from hindcast.plans.registry import cte, query, r4, rounded, table, with_ctes
from hindcast.session import materialize

# --- profiles --------------------------------------------------------------------------------------

_COVER = {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


@query("column_coverage", "A21", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, {r4(f'(count(*) - count({c})) * 100.0 / count(*)', 'null_pct')}, count(DISTINCT {c}) AS distinct_values FROM orders"
    for c, t in _COVER.items()).replace("CASE WHEN isnan((count(*)", "CASE WHEN isnan(1.0 * (count(*)"))
def column_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.column_coverage(table(spark, folder, "orders").select(*_COVER)))


_NUM = ["l_extendedprice", "l_quantity", "l_discount"]


def _profile_sql(c: str) -> str:
    points = ", ".join(r4(f"quantile_cont({c}, CAST({p} AS DOUBLE))", n) for n, p in eda.PROFILE_POINTS.items())
    return f"""SELECT '{c}' AS variable, count({c}) AS n, {r4(f'avg({c})', 'mean')}, {r4(f'stddev_samp({c})', 'std')}, {r4(f'min({c})', 'min')}, {r4(f'max({c})', 'max')},
      {r4(f'max(abs({c}))', 'abs_max')}, {r4(f'skewness({c})', 'skew')}, {r4(f'quantile_cont({c}, CAST(0.75 AS DOUBLE)) - quantile_cont({c}, CAST(0.25 AS DOUBLE))', 'iqr')}, {points} FROM lineitem"""


@query("numeric_summary", "A22 A23", "\nUNION ALL\n".join(_profile_sql(c) for c in _NUM))
def numeric_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Moments and exact percentiles of raw columns: values are counted before they are ordered."""
    return rounded(eda.numeric_summary(table(spark, folder, "lineitem"), _NUM).drop("missing_pct"))


@query("availability_report", "A26 A34 P24", with_ctes("demand", """
SELECT v AS variable, min(date) FILTER (WHERE x IS NOT NULL) AS first_available, max(date) FILTER (WHERE x IS NOT NULL) AS last_available,
       count(x) AS observed_months, count(*) - count(x) AS missing_months, round((count(*) - count(x)) * CAST(100 AS DOUBLE) / count(*), 4) + 0.0 AS missing_pct
FROM (SELECT date, 'y' AS v, y AS x FROM demand UNION ALL SELECT date, 'n', CAST(n AS DOUBLE) FROM demand) GROUP BY 1"""))
def availability_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.availability(fx.demand(spark, folder), ["y", "n"]))


@query("artifact_summary", "A34", with_ctes("supply demand", """
SELECT 'supply' AS artifact, count(*) AS rows, CAST(5 AS BIGINT) AS columns, min(date) AS first_date, max(date) AS last_date, count(*) - count(t) AS target_nulls
FROM (SELECT *, lead(y, 3) OVER (PARTITION BY series ORDER BY date) AS t FROM supply)
UNION ALL SELECT 'demand', count(*), 4, min(date), max(date), count(*) - count(y) FROM demand"""))
def artifact_summary(spark: SparkSession, folder: str) -> DataFrame:
    target = F.lead("y", 3).over(series_window(["series"]))
    supply = fx.supply(spark, folder).withColumn("t", target).drop("n")
    parts = eda.artifact_summary("supply", supply, "t").unionByName(eda.artifact_summary("demand", fx.demand(spark, folder), "y"))
    return rounded(parts)


@query("flag_summary", "A28 A27", with_ctes("supply", """
SELECT 'event_active' AS variable, CAST(sum(a) AS DOUBLE) AS active_rows_or_mean, CAST(min(a) AS DOUBLE) AS min, CAST(max(a) AS DOUBLE) AS max FROM f
UNION ALL SELECT 'months_since_event', round(avg(m), 4) + 0.0, min(m), max(m) FROM f""").replace("\nSELECT 'event_active'", """, f AS (
  SELECT CAST(date >= DATE '1999-01-01' AND date < DATE '2000-01-01' AS INT) AS a,
         CASE WHEN date >= DATE '1999-01-01' THEN (year(date) - 1999) * 12 + month(date) - 1 ELSE 0 END AS m FROM supply)
SELECT 'event_active'"""))
def flag_summary(spark: SparkSession, folder: str) -> DataFrame:
    flags = fx.supply(spark, folder, ("y",)).withColumns(feat.regime_columns(**fx.REGIME))
    return rounded(eda.flag_summary(flags, ["event_active", "months_since_event"]))


# --- calendar-month changes ------------------------------------------------------------------------

cte("mom", "supply", """
  SELECT series, date, 'y' AS variable, (y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) * 100 AS value, abs(lag(y) OVER w) AS prior FROM supply WINDOW w AS (PARTITION BY series ORDER BY date)
  UNION ALL SELECT series, date, 'v', (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) * 100, abs(lag(v) OVER w) FROM supply WINDOW w AS (PARTITION BY series ORDER BY date)""")


@query("change_by_month", "A24 W18", with_ctes("mom", f"""
SELECT series, variable, month(date) AS month_num, {r4('avg(value)', 'avg_mom_pct')}, {r4('median(value)', 'median_mom_pct')}, {r4('avg(value) - median(value)', 'mean_minus_median')}
FROM mom WHERE date <= DATE '1998-12-01' GROUP BY 1, 2, 3"""))
def change_by_month(spark: SparkSession, folder: str) -> DataFrame:
    changes = eda.monthly_changes(fx.supply(spark, folder, ("y", "v")), ["series"], ["y", "v"], "1998-12-01")
    return rounded(eda.change_by_month(changes, ["series"]))


@query("change_callouts", "A24", with_ctes("mom", f"""
SELECT series, variable, month(date) AS month_num, monthname(min(date)) AS month, {r4('avg(value)', 'avg_mom_pct')}
FROM mom WHERE date <= DATE '1998-12-01' GROUP BY 1, 2, 3 HAVING abs(avg(value)) > 2"""))
def change_callouts(spark: SparkSession, folder: str) -> DataFrame:
    changes = eda.monthly_changes(fx.supply(spark, folder, ("y", "v")), ["series"], ["y", "v"], "1998-12-01")
    out = eda.change_callouts(eda.change_by_month(changes, ["series"]))
    return rounded(out.select("series", "variable", "month_num", "month", "avg_mom_pct"))


@query("change_diagnostics", "A25", with_ctes("mom", f"""
SELECT series, variable, {r4('quantile_cont(prior, CAST(0.05 AS DOUBLE))', 'prior_abs_p05')}, {r4('max(abs(value))', 'max_abs_mom_pct')}, {r4('avg(abs(value))', 'mean_abs_mom_pct')},
       {r4('median(abs(value))', 'median_abs_mom_pct')} FROM mom WHERE date <= DATE '1998-12-01' GROUP BY 1, 2"""))
def change_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.change_diagnostics(fx.supply(spark, folder), ["series"], ["y", "v"], "1998-12-01"))


@query("event_delta", "A24 A31", with_ctes("mom", f"""
SELECT series, variable, month(date) AS month_num, {r4("avg(value) FILTER (WHERE date <= DATE '1998-12-01')", 'pre_event_avg')}, {r4('avg(value)', 'full_avg')},
       {r4("avg(value) - avg(value) FILTER (WHERE date <= DATE '1998-12-01')", 'full_minus_pre')} FROM mom GROUP BY 1, 2, 3"""))
def event_delta(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.event_delta(fx.supply(spark, folder), ["series"], ["y", "v"], "1998-12-01"))


# --- correlations ----------------------------------------------------------------------------------


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


_PAIRS = [("y", "v"), ("y", "n"), ("v", "n")]


@query("pearson_pairs", "E1", with_ctes("supply", "\nUNION ALL\n".join(
    f"SELECT series, '{a}' AS a, '{b}' AS b, {r4(f'corr({a}, {b})', 'pearson')}, count(*) AS n FROM supply GROUP BY 1" for a, b in _PAIRS)))
def pearson_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.pearson_pairs(fx.supply(spark, folder), ["series"], ["y", "v", "n"]))


def _ranked(a: str, b: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (PARTITION BY series ORDER BY {c}) + (count(*) OVER (PARTITION BY series, {c}) - 1) / 2.0"

    return f"""SELECT series, '{a}' AS a, '{b}' AS b, {_corr('rx', 'ry')} AS rho, {_corr('x', 'y')} AS r FROM
      (SELECT series, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, CAST({rank(a)} AS DOUBLE) AS rx, CAST({rank(b)} AS DOUBLE) AS ry FROM demand WHERE {a} IS NOT NULL AND {b} IS NOT NULL) GROUP BY 1"""


@query("spearman_comparison", "E2 J15", with_ctes("demand", f"""
SELECT series, a, b, {r4('r', 'pearson')}, {r4('rho', 'spearman')}, {r4('rho - r', 'delta')} FROM ({_ranked('y', 'n')})"""))
def spearman_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.correlation_comparison(fx.demand(spark, folder), ["series"], ["y", "n"]).drop("n"))


def _transformed_sql(name: str, column: str) -> str:
    """One column under one transform, as a SQL expression over window w (ordered) and m (month group)."""
    lag = {"first_difference": 1, "mom_pct": 1, "yoy_pct": 12, "annual_difference": 12}.get(name)
    if lag is None:
        return column
    step = f"{column} - lag({column}, {lag}) OVER w"
    return f"({step}) / nullif(lag({column}, {lag}) OVER w, 0)" if name.endswith("pct") else step


_METHODS = ["levels", "first_difference", "mom_pct", "yoy_pct", "annual_difference"]
_PARTS = [
    f"SELECT series, '{m}' AS method, {', '.join(f'CAST({_transformed_sql(m, c)} AS DOUBLE) AS {c}' for c in ('y', 'v', 'n'))} FROM supply WINDOW w AS (PARTITION BY series ORDER BY date)"
    for m in _METHODS
]
_CENTRED = ", ".join(f"{c} - avg({c}) OVER m AS {c}" for c in ("y", "v", "n"))
_PARTS.append(
    "SELECT series, 'residuals', " + ", ".join(
        f"{c} - tc * sum(tc * {c}) OVER s / sum(tc * tc) OVER s" for c in ("y", "v", "n")
    ) + f""" FROM (SELECT series, {_CENTRED}, t - avg(t) OVER m AS tc FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS DOUBLE) AS t FROM supply)
         WINDOW m AS (PARTITION BY series, month(date))) WINDOW s AS (PARTITION BY series)"""
)
cte("transformed", "supply", " UNION ALL ".join(_PARTS))


@query("transform_comparison", "E1 E3 E5", with_ctes("transformed", f"""
SELECT series, b, round(max(abs(r)), 6) + 0.0 AS max_abs_r, arg_max(method, abs(r)) AS best_method FROM (
  SELECT series, method, 'v' AS b, corr(y, v) AS r FROM transformed GROUP BY 1, 2 UNION ALL SELECT series, method, 'n', corr(y, n) FROM transformed GROUP BY 1, 2) GROUP BY 1, 2"""))
def transform_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Strongest correlation with the target over levels, changes and residuals."""
    return rounded(eda.transform_comparison(fx.supply(spark, folder), ["series"], ["v", "n"], "y"), 6)


@query("lagged_correlations", "E4", with_ctes("supply", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT series, 'v' AS predictor, {k} AS lag_months, {r4('corr(y, x)', 'correlation')}, count(*) AS n FROM (SELECT series, y, lag(v, {k}) OVER ({WIN}) AS x FROM supply) WHERE x IS NOT NULL GROUP BY 1"
    for k in range(13)) + ") WHERE n > 20"))
def lagged_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.lagged_correlations(fx.supply(spark, folder, ("y", "v")), ["series"], "y", ["v"]))


@query("residualise", "E5", with_ctes("supply", f"""
SELECT series, date, {r4('yc - slope * tc', 'y')} FROM (
  SELECT *, sum(tc * yc) OVER (PARTITION BY series) / nullif(sum(tc * tc) OVER (PARTITION BY series), 0) AS slope FROM (
    SELECT series, date, y - avg(y) OVER m AS yc, t - avg(t) OVER m AS tc FROM (SELECT *, CAST(row_number() OVER ({WIN}) - 1 AS DOUBLE) AS t FROM supply)
    WINDOW m AS (PARTITION BY series, month(date))))"""))
def residualise(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.residuals(fx.supply(spark, folder, ("y",)), ["series"], ["y"]))


FEATURES = ["y_lag1", "y_lag2", "y_lag12", "y_rollmean_3", "y_rollstd_3", "y_yoy_diff"]


def feature_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier panel with a handful of history features, target and seasonal baseline."""
    w = series_window(["series"])
    spec = feat.LagSpec(["y"], lags=[1, 2, 12], rolling=[3])
    return fx.supply(spark, folder, ("y",)).select(
        "series", "date", "y", *[c.alias(n) for n, c in feat.lag_columns(spec, w).items()],
        F.lead("y", 3).over(w).alias("target"), F.lag("y", 9).over(w).alias("baseline"),
    )


cte("fpanel", "supply", f"""
  SELECT series, date, y, lag(y, 1) OVER w AS y_lag1, lag(y, 2) OVER w AS y_lag2, lag(y, 12) OVER w AS y_lag12,
         {strict('avg', 'y', 3)} AS y_rollmean_3, {strict('stddev_samp', 'y', 3)} AS y_rollstd_3, lag(y, 1) OVER w - lag(y, 13) OVER w AS y_yoy_diff,
         lead(y, 3) OVER w AS target, lag(y, 9) OVER w AS baseline FROM supply WINDOW w AS ({WIN})""")
cte("screen", "fpanel", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, corr({c}, target) AS r, count({c}) AS n FROM fpanel WHERE target IS NOT NULL" for c in FEATURES))


@query("target_correlations", "E6 A29 P20", with_ctes("screen", f"""
SELECT feature, {r4('r', 'corr_with_target', 6)}, {r4('abs(r)', 'abs_corr', 6)}, n,
       CASE WHEN feature LIKE '%roll%' THEN 'rolling' WHEN feature LIKE '%\\_lag%' ESCAPE '\\' THEN 'lag' WHEN feature LIKE '%yoy%' THEN 'change_rate' ELSE 'other' END AS category
FROM screen WHERE n >= 30"""))
def target_correlations(spark: SparkSession, folder: str) -> DataFrame:
    from hindcast.operators.families import feature_category

    rules = [("roll", "rolling"), ("_lag", "lag"), ("_diff|yoy", "change_rate")]
    return rounded(eda.target_correlations(feature_panel(spark, folder), FEATURES, "target", feature_category(F.col("feature"), rules)), 6)


@query("category_rollup", "A29", with_ctes("screen", f"""
SELECT category, count(*) AS features, {r4('max(abs(r))', 'max_abs_corr', 6)}, {r4('median(abs(r))', 'median_abs_corr', 6)} FROM (
  SELECT r, CASE WHEN feature LIKE '%roll%' THEN 'rolling' WHEN feature LIKE '%\\_lag%' ESCAPE '\\' THEN 'lag' ELSE 'change_rate' END AS category FROM screen) GROUP BY 1"""))
def category_rollup(spark: SparkSession, folder: str) -> DataFrame:
    from hindcast.operators.families import feature_category

    rules = [("roll", "rolling"), ("_lag", "lag"), ("_diff|yoy", "change_rate")]
    screen = eda.target_correlations(feature_panel(spark, folder), FEATURES, "target", feature_category(F.col("feature"), rules))
    return rounded(eda.category_rollup(screen), 6)


@query("collinear_pairs", "E7", with_ctes("fpanel", "SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r4(f'corr({a}, {b})', 'pearson', 6)}, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r4(f'abs(corr({a}, {b}))', 'abs_corr', 6)} FROM fpanel WHERE target IS NOT NULL"
    for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + ") WHERE abs_corr >= 0.3"))
def collinear_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(eda.collinear_pairs(feature_panel(spark, folder), FEATURES, "target", threshold=0.3), 6)


@query("observation_summary", "A30 S3", with_ctes("demand_obs", """
SELECT series, count(*) AS observations, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM demand_obs GROUP BY 1"""))
def observation_summary(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "series")
    observed = to_monthly(orders, ["series"], "o_orderdate", {"n": F.count(F.lit(1))})
    nested = observed.groupBy("series").agg(
        F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.col("n").cast("string").alias("value"))).alias("observations")
    )
    return rounded(eda.observation_summary(nested, "series", "observations"))


# Order priorities and the columns they become; any other priority counts as ``other``.
_PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
_NAMED = ", ".join(f"'{k}'" for k in _PRIORITIES)


@query("nested_observations", "S3 P2 J3", with_ctes("demand_obs", f"""
SELECT date, {', '.join(f"CAST(sum(n) FILTER (WHERE series = '{k}') AS DOUBLE) AS {v}" for k, v in _PRIORITIES.items())},
       CAST(sum(n) FILTER (WHERE series IS NULL OR series NOT IN ({_NAMED})) AS DOUBLE) AS other FROM demand_obs GROUP BY 1"""))
def nested_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly counts packed into the nested response layout, one document a series, then read back wide by series."""
    from hindcast.sources.readers import OBSERVATION_SCHEMA, explode_observations, observations_wide

    names = F.create_map(*[F.lit(v) for pair in _PRIORITIES.items() for v in pair])
    series = F.coalesce(F.try_element_at(names, F.coalesce("o_orderpriority", F.lit(""))), F.lit("other"))
    monthly = to_monthly(table(spark, folder, "orders").withColumn("series", series), ["series"], "o_orderdate", {"n": F.count(F.lit(1))})
    cells = F.collect_list(F.struct(F.col("date").cast("string").alias("date"), F.col("n").cast("string").alias("value")))
    body = F.struct(F.col("series").alias("series_id"), F.struct("observations").alias("response"))
    documents = monthly.groupBy("series").agg(cells.alias("observations")).select(
        F.to_json(F.struct(F.lit("orders").alias("source_name"), F.lit("x").alias("provider"), F.create_map("series", body).alias("series"))).alias("text")
    )
    raw = documents.select(F.from_json("text", OBSERVATION_SCHEMA).alias("d")).select("d.*")
    return rounded(observations_wide(explode_observations(raw), [*_PRIORITIES.values(), "other"]))


# --- tests -----------------------------------------------------------------------------------------


def yoy_panel(spark: SparkSession, folder: str) -> DataFrame:
    w = series_window(["series"])
    changes = fx.demand(spark, folder).select("series", "date", *[F.try_divide(F.col(c) - F.lag(c, 12).over(w), F.lag(c, 12).over(w)).alias(c) for c in ("y", "n")])
    return changes.withColumns(
        {"target": F.lead("y", 3).over(w), "target_date": F.add_months("date", 3)}
    ).withColumn("post", F.col("target_date") >= F.lit("1999-01-01").cast("date"))


cte("yoy", "demand", f"""
  SELECT *, lead(y, 3) OVER ({WIN}) AS target, date + INTERVAL 3 MONTH >= DATE '1999-01-01' AS post FROM (
    SELECT series, date, (y - lag(y, 12) OVER w) / nullif(lag(y, 12) OVER w, 0) AS y,
           (n - lag(n, 12) OVER w) / CAST(nullif(lag(n, 12) OVER w, 0) AS DOUBLE) AS n FROM demand WINDOW w AS ({WIN}))""")


def _ssr(where: str) -> str:
    f = f"FILTER (WHERE {where})"
    return f"(regr_syy(target, y) {f} - pow(regr_sxy(target, y) {f}, 2) / regr_sxx(target, y) {f})"


@query("chow_simple", "E10", with_ctes("yoy", f"""
SELECT series, {r4('((pooled - split) / 2) / (split / (pre_n + post_n - 4))', 'f_statistic')}, CAST(2 AS BIGINT) AS df1, pre_n + post_n - 4 AS df2, pre_n, post_n FROM (
  SELECT series, {_ssr('true')} AS pooled, {_ssr('NOT post')} + {_ssr('post')} AS split,
         count(*) FILTER (WHERE NOT post AND y IS NOT NULL AND target IS NOT NULL) AS pre_n, count(*) FILTER (WHERE post AND y IS NOT NULL AND target IS NOT NULL) AS post_n
  FROM yoy GROUP BY 1)"""))
def chow_simple(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.chow_simple(yoy_panel(spark, folder), ["series"], "target", "y", "post"))


@query("chow_test", "E10 V5")
def chow_test(spark: SparkSession, folder: str) -> DataFrame:
    """Break test with several regressors and its p-value."""
    return rounded(st.chow_test(yoy_panel(spark, folder), ["series"], "target", ["y", "n"], "post"), 6)


@query("welch_test", "E11", with_ctes("yoy", f"""
SELECT series, {r4('m1', 'pre_mean')}, {r4('m2', 'post_mean')}, n1 AS pre_n, n2 AS post_n, {r4('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 't_statistic')},
       {r4('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))', 'df')} FROM (
  SELECT series, avg(target) FILTER (WHERE NOT post) AS m1, avg(target) FILTER (WHERE post) AS m2, var_samp(target) FILTER (WHERE NOT post) AS v1,
         var_samp(target) FILTER (WHERE post) AS v2, count(target) FILTER (WHERE NOT post) AS n1, count(target) FILTER (WHERE post) AS n2 FROM yoy GROUP BY 1)"""))
def welch_test(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.welch_test(yoy_panel(spark, folder), ["series"], "target", "post"))


@query("welch_p_values", "E11 E8")
def welch_p_values(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(st.with_t_p_value(st.welch_test(yoy_panel(spark, folder), ["series"], "target", "post")), 6)


@query("granger_screen", "E8")
def granger_screen(spark: SparkSession, folder: str) -> DataFrame:
    tests = st.granger_f_tests(yoy_panel(spark, folder), ["series"], "y", ["n"], max_lag=6)
    return rounded(st.granger_screening(tests, ["series"]), 6)


@query("hac_regression", "E9 V5")
def hac_regression(spark: SparkSession, folder: str) -> DataFrame:
    panel = yoy_panel(spark, folder).withColumn("after", F.col("post").cast("double"))
    return rounded(st.hac_regression(panel, ["series"], "target", ["y", "n", "after"]), 6)


# --- policies --------------------------------------------------------------------------------------

EMBARGO = 3
_USABLE = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "target", "baseline"])
cte("snap", "fpanel", f"""
  SELECT e.date AS as_of, t.* FROM (SELECT DISTINCT date FROM fpanel WHERE date >= DATE '2000-07-01') e
  JOIN fpanel t ON t.date < CAST(e.date - INTERVAL {EMBARGO} MONTH AS DATE) WHERE {_USABLE}""")


def _moments(spark: SparkSession, folder: str, columns: list[str], keys: list[str]) -> DataFrame:
    moments = pol.prefix_moments(feature_panel(spark, folder), keys, columns, ["baseline"], EMBARGO, one_row_per_month=bool(keys))
    late = (F.col("date") >= F.lit("2000-07-01").cast("date"))
    return moments.where(late)


@query("variance_by_snapshot", "B7 J11", with_ctes("snap", "\nUNION ALL\n".join(
    f"SELECT as_of AS date, '{c}' AS feature, count(*) AS n, {r4(f'var_samp({c})', 'variance')} FROM snap GROUP BY 1" for c in FEATURES)))
def variance_by_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Variances of pooled snapshots from running sums; the check builds every snapshot by a range join."""
    moments = _moments(spark, folder, [*FEATURES, "target"], [])
    return rounded(pol.variances(moments, [], FEATURES_AND_TARGET).where(F.col("feature") != "target").select("date", "feature", "n", "variance"))


FEATURES_AND_TARGET = [*FEATURES, "target"]


@query("correlation_by_snapshot", "B8 J11", with_ctes("snap", "\nUNION ALL\n".join(
    f"SELECT as_of AS date, '{a}' AS a, '{b}' AS b, {r4(f'corr({a}, {b})', 'r', 6)} FROM snap GROUP BY 1" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])))
def correlation_by_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    moments = _moments(spark, folder, FEATURES_AND_TARGET, [])
    out = pol.correlations(moments, [], FEATURES_AND_TARGET).where(F.col("b") != "target")
    return rounded(out.select("date", "a", "b", "r"), 6)


_CLOSE = [f"SELECT as_of, '{b}' AS f FROM snap GROUP BY 1 HAVING abs(corr({a}, {b})) > 0.3" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@query("corr_prune", "B8 B12", with_ctes("snap", f"""
, dropped AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(_CLOSE)})), days AS (SELECT DISTINCT as_of FROM snap)
SELECT d.as_of AS date, {len(FEATURES)} - count(x.f) AS n_features_after_policy, coalesce(string_agg(x.f, ',' ORDER BY x.f), '') AS dropped
FROM days d LEFT JOIN dropped x ON x.as_of = d.as_of GROUP BY 1""").replace("\n\n,", "\n,"))
def corr_prune(spark: SparkSession, folder: str) -> DataFrame:
    """A column goes if any earlier column is too close; a low threshold makes the rule act on this data."""
    masked = pol.selection_masks(_moments(spark, folder, FEATURES_AND_TARGET, []), FEATURES, "corr_pruned", 0.3)
    kept = pol.pruned_features(masked, [], FEATURES, "corr_pruned")
    return rounded(kept.select("date", "n_features_after_policy", F.array_join(F.array_sort("dropped_features"), ",").alias("dropped")))


_VARIED = " || ".join(f"CASE WHEN var_samp({c}) > 1e-8 THEN ',{c}' ELSE '' END" for c in FEATURES)
_FLAT = " || ".join(f"CASE WHEN var_samp({c}) > 1e-8 THEN '' ELSE ',{c}' END" for c in FEATURES)


@query("policy_records", "B7 B12", with_ctes("snap", f"""
SELECT series, as_of AS date, count(*) AS n_train, {len(FEATURES)} AS n_features_before_policy, substr({_VARIED}, 2) AS selected, substr({_FLAT}, 2) AS dropped
FROM snap GROUP BY 1, 2 HAVING count(*) > 1"""))
def policy_records(spark: SparkSession, folder: str) -> DataFrame:
    """Variance pruning per supplier and snapshot with its full record."""
    masked = pol.selection_masks(_moments(spark, folder, FEATURES_AND_TARGET, ["series"]).where("n > 1"), FEATURES, "variance_pruned")
    records = pol.pruned_features(masked, ["series"], FEATURES, "variance_pruned")
    return rounded(
        records.select(
            "series", "date", "n_train", "n_features_before_policy", F.array_join("selected_features", ",").alias("selected"),
            F.array_join("dropped_features", ",").alias("dropped"),
        )
    )


@query("lasso_selected", "B10")
def lasso_selected(spark: SparkSession, folder: str) -> DataFrame:
    moments = _moments(spark, folder, [*FEATURES, "target", "baseline"], []).where("n > 24")
    return rounded(md.lasso_selection(moments, [], FEATURES))


# With two columns a path has a closed form: the column of the greater correlation enters first and stays,
# the other one enters where its correlation with the residual reaches the penalty.
_SHARES = [0.9, 0.6, 0.3, 0.1, 0.02]
cte("pairstats", "snap", """
  SELECT series, as_of, mode, n, sd, r, CASE WHEN abs(ca) >= abs(cb) THEN 'y_lag1' ELSE 'y_lag12' END AS leader, CASE WHEN abs(ca) >= abs(cb) THEN ca ELSE cb END AS c1, CASE WHEN abs(ca) >= abs(cb) THEN cb ELSE ca END AS c2
  FROM (SELECT series, as_of, mode, count(*) AS n, stddev_pop(t) AS sd, corr(y_lag1, y_lag12) AS r, corr(y_lag1, t) * stddev_pop(t) AS ca, corr(y_lag12, t) * stddev_pop(t) AS cb
        FROM (SELECT *, 'target' AS mode, target AS t FROM snap UNION ALL SELECT *, 'residual' AS mode, target - baseline AS t FROM snap) GROUP BY 1, 2, 3 HAVING count(*) > 24)""")
cte("pairpath", "pairstats", f"""
  SELECT *, CASE WHEN abs(rest) <= a THEN single ELSE (c1 - a * sign(c1) - r * (c2 - a * sign(rest))) / (1 - r * r) END AS w1,
         CASE WHEN abs(rest) <= a THEN 0.0 ELSE (c2 - a * sign(rest) - r * (c1 - a * sign(c1))) / (1 - r * r) END AS w2
  FROM (SELECT *, c2 - r * single AS rest FROM (SELECT *, share * abs(c1) AS a, sign(c1) * (abs(c1) - share * abs(c1)) AS single
        FROM pairstats, (SELECT unnest({_SHARES}) AS share)))""")


def _pair_paths(spark: SparkSession, folder: str) -> DataFrame:
    panel = feature_panel(spark, folder).withColumn("residual", F.col("target") - F.col("baseline"))
    pair = ["y_lag1", "y_lag12"]
    moments = pol.prefix_moments(panel, ["series"], [*pair, "target", "residual"], FEATURES, EMBARGO, one_row_per_month=True)
    asked = moments.where((F.col("date") >= F.lit("2000-07-01").cast("date")) & (F.col("n") > 24))
    return sel.lasso_paths(asked, ["series"], pair, ["target", "residual"])


@query("lasso_path", "B10", with_ctes("pairpath", f"""
SELECT series, as_of AS date, mode, n AS n_train, share, round(a / sd, 6) + 0.0 AS penalty,
       round(CASE leader WHEN 'y_lag1' THEN w1 ELSE w2 END / sd, 6) + 0.0 AS y_lag1, round(CASE leader WHEN 'y_lag1' THEN w2 ELSE w1 END / sd, 6) + 0.0 AS y_lag12 FROM pairpath"""))
def lasso_path(spark: SparkSession, folder: str) -> DataFrame:
    """Weights at five shares of the greatest penalty, per supplier, month and target, in units of the target's deviation."""
    paths = materialize(_pair_paths(spark, folder))
    out = None
    for share in _SHARES:
        one = sel.path_weights(paths, ["series"], F.col("greatest") * share).select(
            "series", "date", "mode", "n_train", F.lit(share).alias("share"), (F.col("at") / F.col("spread")).alias("penalty"),
            *[(F.get("weights", F.lit(i)) / F.col("spread")).alias(c) for i, c in enumerate(("y_lag1", "y_lag12"))],
        )
        out = one if out is None else out.unionByName(one)
    return rounded(out, 6)


@query("lasso_entries", "B10", with_ctes("pairstats", """
SELECT series, as_of AS date, mode, leader AS feature, CAST(0 AS BIGINT) AS step, round(abs(c1) / sd, 6) + 0.0 AS penalty FROM pairstats
UNION ALL
SELECT series, as_of, mode, CASE leader WHEN 'y_lag1' THEN 'y_lag12' ELSE 'y_lag1' END, 1, round(greatest((c2 - r * c1) / (1 - r * sign(c1)), -(c2 - r * c1) / (1 + r * sign(c1))) / sd, 6) + 0.0 FROM pairstats"""))
def lasso_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The penalties at which the two columns enter, per supplier, month and target."""
    paths = _pair_paths(spark, folder).where("feature IS NOT NULL AND entered")
    return rounded(paths.select("series", "date", "mode", "feature", "step", (F.col("penalty") / F.col("spread")).alias("penalty")), 6)


def _mi_sql(bins: int = 4) -> str:
    cut = "CAST(DATE '2000-01-01' - INTERVAL 3 MONTH AS DATE)"
    points = "[0.25, 0.5, 0.75]"
    cols = ["y_lag1", "y_lag12", "target"]
    edges = ", ".join(f"quantile_cont({c}, {points}) FILTER (WHERE date < {cut}) AS e_{c}" for c in cols)
    usable = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    binned = ", ".join(f"len(list_filter(e_{c}, lambda v: v < {c})) AS b_{c}" for c in cols)
    parts = " UNION ALL ".join(f"SELECT series, date, '{c}' AS feature, b_{c} AS x, b_target AS y FROM binned" for c in cols[:2])
    return with_ctes("fpanel", f"""
, usable AS (SELECT * FROM fpanel WHERE {usable}), edges AS (SELECT series, {edges} FROM usable GROUP BY 1),
binned AS (SELECT u.series, u.date, {binned} FROM usable u JOIN edges USING (series)),
long AS ({parts}),
days AS (SELECT DISTINCT date AS as_of FROM fpanel WHERE date >= DATE '2000-01-01'),
cells AS (SELECT l.series, d.as_of, l.feature, x, y, CAST(count(*) AS DOUBLE) AS k FROM long l JOIN days d ON l.date < CAST(d.as_of - INTERVAL 3 MONTH AS DATE) GROUP BY 1, 2, 3, 4, 5),
marg AS (SELECT *, sum(k) OVER (PARTITION BY series, as_of, feature) AS n, sum(k) OVER (PARTITION BY series, as_of, feature, x) AS kx, sum(k) OVER (PARTITION BY series, as_of, feature, y) AS ky FROM cells)
SELECT series, as_of AS date, feature, CAST(max(n) AS BIGINT) AS n, round(sum(k / n * ln(k * n / (kx * ky))), 6) + 0.0 AS score FROM marg GROUP BY 1, 2, 3""").replace("\n\n,", "\n,")


@query("mutual_information", "B9", _mi_sql())
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    scores = pol.mutual_information(feature_panel(spark, folder), ["series"], ["y_lag1", "y_lag12"], "target", "2000-01-01", EMBARGO)
    return rounded(scores.drop("position"), 6)


@query("mi_top_k", "B9 T9")
def mi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    scores = pol.mutual_information(feature_panel(spark, folder), ["series"], FEATURES, "target", "2000-01-01", EMBARGO)
    return rounded(pol.top_features(scores, ["series", "date"], 3), 6)


# Nearest neighbours by brute force: every pair of rows of every snapshot. Euler's constant cancels in the digammas.
_NEAR = ["y_lag1", "y_lag12"]
_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in [*_NEAR, "target"])
_DIGAMMA = "CASE WHEN {0} > 1 THEN list_sum(list_transform(range(1, {0}), lambda v: 1.0::DOUBLE / v)) ELSE 0.0 END"
cte("nearest", "nrows", f"""
  SELECT series, as_of, feature, i, n, list_sort(list(greatest(dx, dy)) FILTER (WHERE i <> j))[3] AS radius, list(dx) AS dxs, list(dy) AS dys
  FROM (SELECT a.series, a.as_of, a.feature, a.date AS i, b.date AS j, a.n, abs(a.x - b.x) / a.sx AS dx, abs(a.y - b.y) / a.sy AS dy
        FROM nrows a JOIN nrows b ON a.series = b.series AND a.as_of = b.as_of AND a.feature = b.feature) GROUP BY 1, 2, 3, 4, 5""")
cte("nscores", "nearest", f"""
  SELECT series, as_of, feature, n, greatest({_DIGAMMA.format('n')} + 1.5 - avg({_DIGAMMA.format('nx')} + {_DIGAMMA.format('ny')}), 0.0) AS score
  FROM (SELECT *, len(list_filter(dxs, lambda v: v < radius OR v = 0)) AS nx, len(list_filter(dys, lambda v: v < radius OR v = 0)) AS ny FROM nearest) GROUP BY 1, 2, 3, 4""")
cte("nrows", "fpanel", f"""
  SELECT *, coalesce(nullif(stddev_pop(x) OVER w, 0), 1) AS sx, coalesce(nullif(stddev_pop(y) OVER w, 0), 1) AS sy, count(*) OVER w AS n
  FROM (SELECT e.series, e.as_of, p.date, CAST(p.target AS DOUBLE) AS y, f.feature, CAST(CASE f.feature WHEN 'y_lag1' THEN y_lag1 ELSE y_lag12 END AS DOUBLE) AS x
        FROM (SELECT series, date AS as_of FROM fpanel WHERE date >= DATE '2000-01-01' AND month(date) IN (1, 4, 7, 10) AND target IS NOT NULL AND baseline IS NOT NULL) e
        JOIN fpanel p ON p.series = e.series AND p.date < CAST(e.as_of - INTERVAL {EMBARGO} MONTH AS DATE), (SELECT unnest(['y_lag1', 'y_lag12']) AS feature) f
        WHERE {_KNOWN}) WINDOW w AS (PARTITION BY series, as_of, feature) QUALIFY count(*) OVER w > 3""")


def _neighbours(spark: SparkSession, folder: str, features: list[str]) -> DataFrame:
    """Information at the months in which models are fitted anew."""
    evaluated, fit_on = _evaluated()
    return sel.neighbour_information(feature_panel(spark, folder), ["series"], features, "target", evaluated & (fit_on == F.col("date")), EMBARGO)


@query("neighbour_information", "B9", with_ctes("nscores", """
SELECT series, as_of AS date, feature, n, round(score, 6) + 0.0 AS score FROM nscores"""))
def neighbour_information(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-neighbour information with the target per supplier and fit date; the check compares every pair of rows."""
    return rounded(_neighbours(spark, folder, _NEAR).drop("position"), 6)


@query("neighbour_top_k", "B9 T9", with_ctes("nscores", """
SELECT series, as_of AS date, feature, n, round(round(score, 9), 6) + 0.0 AS score, CAST(1 AS BIGINT) AS rank
FROM nscores QUALIFY row_number() OVER (PARTITION BY series, as_of ORDER BY round(score, 9) DESC, feature) = 1"""))
def neighbour_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The more informative of two columns; scores that differ by rounding alone are ties."""
    scores = _neighbours(spark, folder, _NEAR).withColumn("score", F.round("score", 9))
    return rounded(pol.top_features(scores, ["series", "date"], 1).drop("position"), 6)


def _evaluated() -> tuple[Column, Column]:
    """As-of months from 2000 on that can be scored, and the month whose fit serves each: refits are quarterly."""
    first = F.lit("2000-01-01").cast("date")
    return (F.col("date") >= first) & F.col("target").isNotNull() & F.col("baseline").isNotNull(), bt.fit_date(F.col("date"), first, 3, 1)


@query("tree_top_k", "B11 T9")
def tree_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The three features that a hundred extra trees use most, per supplier, fit date and target."""
    scores = tr.tree_scores(feature_panel(spark, folder), ["series"], FEATURES, "target", "baseline", *_evaluated(), EMBARGO, ("raw", "residual"))
    return rounded(pol.top_features(scores, ["series", "date", "mode"], 3), 6)


# --- models ----------------------------------------------------------------------------------------

LINEAR_GRID = md.linear_configs(
    {"ridge": [{"alpha": 1.0}, {"alpha": 10.0}], "lasso": [{"alpha": 1.0}], "elastic_net": [{"alpha": 1.0, "l1_ratio": 0.5}]}, ["raw", "residual"]
)


def _linear(spark: SparkSession, folder: str, keys: list[str], policy: str = "none") -> tuple[DataFrame, DataFrame]:
    panel = feature_panel(spark, folder)
    evaluated = (F.col("date") >= F.lit("2000-01-01").cast("date")) & F.col("target").isNotNull() & F.col("baseline").isNotNull()
    fit_on = bt.fit_date(F.col("date"), F.lit("2000-01-01").cast("date"), 3, 1)
    return md.backtest_linear(panel, ["series"], keys, FEATURES, "target", "baseline", LINEAR_GRID, evaluated, fit_on, EMBARGO, policy=policy)


@query("linear_backtest_pooled", "B15 B6 B13 B1")
def linear_backtest_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Eight linear configurations over all suppliers, refitted quarterly, from one pass of moments."""
    return rounded(_linear(spark, folder, [])[0])


@query("linear_backtest_series", "B15 B8")
def linear_backtest_series(spark: SparkSession, folder: str) -> DataFrame:
    """The same configurations with one model per supplier and correlation pruning per snapshot."""
    return rounded(_linear(spark, folder, ["series"], "corr_pruned")[0])


@query("feature_importance", "B19 T9")
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(md.feature_importance(_linear(spark, folder, [])[1], [], FEATURES))


cte("ols", "snap", f"SELECT as_of, regr_slope(target, y_lag1) AS b, regr_intercept(target, y_lag1) AS a, count(*) AS n FROM snap GROUP BY 1")


@query("least_squares_backtest", "B15 B5", with_ctes("ols fpanel", f"""
SELECT p.series, p.date AS as_of_date, o.n AS n_train, {r4('p.target', 'actual')}, {r4('o.a + o.b * p.y_lag1', 'prediction')}
FROM fpanel p JOIN ols o ON o.as_of = p.date WHERE p.target IS NOT NULL AND p.baseline IS NOT NULL AND p.y_lag1 IS NOT NULL"""))
def least_squares_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """One feature and no penalty: the pooled moment fit equals a plain regression on every snapshot."""
    panel = feature_panel(spark, folder)
    complete = panel.withColumn("baseline", F.when(F.forall(F.array(*FEATURES), lambda v: v.isNotNull()), F.col("baseline")))
    late = (F.col("date") >= F.lit("2000-07-01").cast("date")) & F.col("target").isNotNull() & F.col("baseline").isNotNull()
    config = [{"model_type": "ridge", "params": {"alpha": 0.0}, "mode": "raw"}]
    out, _ = md.backtest_linear(complete, ["series"], [], ["y_lag1"], "target", "baseline", config, late, F.col("date"), EMBARGO)
    return rounded(out.select("series", "as_of_date", "n_train", "actual", "prediction"))


# One feature: the penalised solutions have a closed form in covariance and deviation.
_WEIGHTS = {
    "ridge__{m}__features__alpha-1.0": "n * {c} / (n + 1)",
    "ridge__{m}__features__alpha-10.0": "n * {c} / (n + 10)",
    "lasso__{m}__features__alpha-1.0": "sign({c}) * greatest(abs({c}) - 1, 0)",
    "elastic_net__{m}__features__alpha-1.0_l1_ratio-0.5": "sign({c}) * greatest(abs({c}) - CAST(0.5 AS DOUBLE), 0) / CAST(1.5 AS DOUBLE)",
}
_SOLVED = " UNION ALL ".join(
    f"SELECT series, fit_date, '{name.format(m=m)}' AS config_id, '{m}' AS mode, n, sd, mx, {mean} AS ym, {w.format(c=c)} AS w FROM fitted"
    for name, w in _WEIGHTS.items()
    for m, c, mean in (("raw", "cy", "my"), ("residual", "cr", "mr"))
)


def _penalised_sql(pooled: bool) -> str:
    owner = "'all'" if pooled else "t.series"
    same = "true" if pooled else "f.series = p.series"
    mine = "true" if pooled else "t.series = p.series"
    return with_ctes("fpanel", f"""
, days AS (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2001-10-01', INTERVAL 3 MONTH)) AS DATE) AS fit_date),
fitted AS (SELECT *, cov_y / sd AS cy, cov_r / sd AS cr FROM (
  SELECT {owner} AS series, d.fit_date, CAST(count(*) AS DOUBLE) AS n, stddev_pop(t.y_lag1) AS sd, avg(t.y_lag1) AS mx, avg(t.target) AS my, avg(t.target - t.baseline) AS mr,
         covar_pop(t.y_lag1, t.target) AS cov_y, covar_pop(t.y_lag1, t.target - t.baseline) AS cov_r
  FROM days d JOIN fpanel t ON t.date < CAST(d.fit_date - INTERVAL 3 MONTH AS DATE) WHERE t.y_lag1 IS NOT NULL AND t.target IS NOT NULL AND t.baseline IS NOT NULL GROUP BY 1, 2) WHERE n >= 24),
solved AS ({_SOLVED})
SELECT p.series, p.date AS as_of_date, f.fit_date, f.config_id, 1 AS n_features,
  (SELECT count(*) FROM fpanel t WHERE t.date < CAST(p.date - INTERVAL 3 MONTH AS DATE) AND {mine} AND t.y_lag1 IS NOT NULL AND t.target IS NOT NULL AND t.baseline IS NOT NULL) AS n_train,
  {r4("f.ym + f.w / f.sd * (p.y_lag1 - f.mx) + CASE WHEN f.mode = 'residual' THEN p.baseline ELSE 0 END", 'prediction')}
FROM fpanel p JOIN solved f ON {same} AND f.fit_date = CAST(DATE '2000-01-01' + to_months(CAST(((year(p.date) - 2000) * 12 + month(p.date) - 1) // 3 * 3 AS INT)) AS DATE)
WHERE p.date >= DATE '2000-01-01' AND p.target IS NOT NULL AND p.baseline IS NOT NULL AND p.y_lag1 IS NOT NULL""").replace("\n\n,", "\n,")


def _penalised(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    evaluated = (F.col("date") >= F.lit("2000-01-01").cast("date")) & F.col("target").isNotNull() & F.col("baseline").isNotNull()
    fit_on = bt.fit_date(F.col("date"), F.lit("2000-01-01").cast("date"), 3, 1)
    out, _ = md.backtest_linear(feature_panel(spark, folder), ["series"], keys, ["y_lag1"], "target", "baseline", LINEAR_GRID, evaluated, fit_on, EMBARGO)
    return rounded(out.select("series", "as_of_date", "fit_date", "config_id", "n_features", "n_train", "prediction"))


@query("penalised_pooled", "B15 B6 B13 B5", _penalised_sql(True))
def penalised_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Ridge, lasso and elastic net on one feature, one model for all suppliers."""
    return _penalised(spark, folder, [])


@query("penalised_series", "B15 B6 B13 B5", _penalised_sql(False))
def penalised_series(spark: SparkSession, folder: str) -> DataFrame:
    """The same with one model per supplier."""
    return _penalised(spark, folder, ["series"])


def _trees(spark: SparkSession, folder: str, kind: str, params: dict, columns: list[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    configs = [{"model_type": kind, "params": params, "mode": m} for m in ("raw", "residual")]
    return tr.backtest_series_trees(feature_panel(spark, folder), ["series"], columns, "target", "baseline", configs, *_evaluated(), EMBARGO)


@query("forest_backtest", "B16")
def forest_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_trees(spark, folder, "random_forest", {"n_estimators": 200, "max_depth": 4})[0])


@query("extra_trees_backtest", "B16")
def extra_trees_backtest(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_trees(spark, folder, "extra_trees", {"n_estimators": 200, "max_depth": 4})[0])


@query("boosted_backtest", "B16")
def boosted_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """The size of the published champion: 500 trees of depth 3 with a feature share of 0.8."""
    return rounded(_trees(spark, folder, "xgboost", {"n_estimators": 500, "max_depth": 3, "learning_rate": 0.05, "colsample_bytree": 0.8})[0])


_STUMP = ["y_lag1", "y_lag12"]
_BOTH = " AND ".join(f"{c} IS NOT NULL" for c in [*_STUMP, "target", "baseline"])
cte("stumps", "fpanel", f"""
  SELECT series, fit_date, feature, place, threshold, below, above, n_train FROM (
    SELECT *, row_number() OVER (PARTITION BY series, fit_date ORDER BY score DESC, place, v) AS choice FROM (
      SELECT *, (v + next_v) / 2 AS threshold, gl / hl AS below, (g - gl) / (h - hl) AS above, h AS n_train,
             round(gl * gl / hl + (g - gl) * (g - gl) / (h - hl), 6) AS score
      FROM (SELECT series, fit_date, feature, place, v, lead(v) OVER (o) AS next_v, sum(n) OVER (o) AS hl, sum(s) OVER (o) AS gl,
                   sum(n) OVER (PARTITION BY series, fit_date, feature) AS h, sum(s) OVER (PARTITION BY series, fit_date, feature) AS g
            FROM (SELECT t.series, d.fit_date, u.feature, u.place, u.v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(t.target) AS DOUBLE) AS s
                  FROM (SELECT DISTINCT CAST(DATE '2000-01-01' + to_months(CAST(((year(date) - 2000) * 12 + month(date) - 1) // 3 * 3 AS INT)) AS DATE) AS fit_date
                        FROM fpanel WHERE date >= DATE '2000-01-01' AND target IS NOT NULL AND baseline IS NOT NULL) d
                  JOIN fpanel t ON t.date < CAST(d.fit_date - INTERVAL 3 MONTH AS DATE) AND {_BOTH},
                  LATERAL (SELECT 'y_lag1' AS feature, 0 AS place, CAST(t.y_lag1 AS DOUBLE) AS v UNION ALL SELECT 'y_lag12', 1, CAST(t.y_lag12 AS DOUBLE)) u
                  GROUP BY ALL)
            WINDOW o AS (PARTITION BY series, fit_date, feature ORDER BY v))
      WHERE h >= 24 AND next_v IS NOT NULL)) WHERE choice = 1""")


def _stump() -> dict:
    return {"n_estimators": 1, "max_depth": 1, "bootstrap": False}


@query("stump_backtest", "B16 B5 B6", with_ctes("stumps", f"""
SELECT p.series, p.date AS as_of_date, s.fit_date, CAST(s.n_train AS BIGINT) AS n_train, {r4('p.target', 'actual')},
  {r4("CASE WHEN CASE s.place WHEN 0 THEN p.y_lag1 ELSE p.y_lag12 END <= s.threshold THEN s.below ELSE s.above END", 'prediction')}
FROM fpanel p JOIN stumps s ON s.series = p.series AND s.fit_date = CAST(DATE '2000-01-01' + to_months(CAST(((year(p.date) - 2000) * 12 + month(p.date) - 1) // 3 * 3 AS INT)) AS DATE)
WHERE p.date >= DATE '2000-01-01' AND p.{_BOTH.replace(' AND ', ' AND p.')}"""))
def stump_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """One tree of one split, every supplier and fit date: what SQL can say of the learner."""
    config = [{"model_type": "random_forest", "params": _stump(), "mode": "raw"}]
    out, _ = tr.backtest_series_trees(feature_panel(spark, folder), ["series"], _STUMP, "target", "baseline", config, *_evaluated(), EMBARGO)
    return rounded(out.select("series", "as_of_date", "fit_date", "n_train", "actual", "prediction"))


@query("stump_importance", "B11 B19 T9", with_ctes("stumps", """
SELECT series, fit_date, feature AS feature_name, 'feature_importance' AS importance_type, 1.0::DOUBLE AS importance, 1::BIGINT AS rank FROM stumps"""))
def stump_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The feature each stump splits on has all of its importance."""
    config = [{"model_type": "random_forest", "params": _stump(), "mode": "raw"}]
    _, out = tr.backtest_series_trees(feature_panel(spark, folder), ["series"], _STUMP, "target", "baseline", config, *_evaluated(), EMBARGO)
    return rounded(out.where("rank = 1 AND importance > 0").select("series", "fit_date", "feature_name", "importance_type", "importance", "rank"))


@query("sequence_components", "B22 W25")
def sequence_components(spark: SparkSession, folder: str) -> DataFrame:
    samples = materialize(feat.sequence_samples(fx.supply(spark, folder, ("y", "v")), ["series"], ["y", "v"], 12))
    train = F.col("date") < F.lit("2000-01-01").cast("date")
    shown = md.sequence_representation(samples, train, components=None)
    return shown.select("series", "date", F.size("representation").cast("bigint").alias("components"), F.round(F.get("representation", F.lit(0)), 6).alias("first"))
