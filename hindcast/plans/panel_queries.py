"""Sources, panels and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.functions.calendar import availability_lag_days, available_at, month_name, period_end
from hindcast.operators import features as feat
from hindcast.operators import impute as imp
from hindcast.operators import reshape as rs
from hindcast.operators.panel import exact_sum, missing_months, on_spine, series_window, to_monthly, trim_leading
from hindcast.plans import fixtures as fx
from hindcast.plans.registry import cte, query, r4, rounded, table, with_ctes

WIN = "PARTITION BY series ORDER BY date"


def strict(agg: str, column: str, size: int) -> str:
    frame = f"OVER ({WIN} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({column}) {frame} = {size} THEN {agg}({column}) {frame} END"


@query("panel_features", "S1 P1 Q2 W1 W3 W5 W7 W17", with_ctes("demand", f"""
SELECT series, date, y, n, {r4(f'lag(y, 1) OVER ({WIN})', 'y_lag1', 2)}, {r4(f'lag(y, 12) OVER ({WIN})', 'y_lag12', 2)},
       {r4(strict('avg', 'y', 3), 'y_rollmean_3', 2)},
       {r4(f'lag(y, 1) OVER ({WIN}) - lag(y, 13) OVER ({WIN})', 'y_yoy_diff', 2)},
       {r4(f'lead(y, 3) OVER ({WIN})', 'y_target_h3', 2)},
       CAST(date + INTERVAL 3 MONTH AS DATE) AS target_date_h3,
       {r4(f'lag(y, 9) OVER ({WIN})', 'seasonal_naive_proxy', 2)}
FROM demand"""))
def panel_features(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly demand on a complete spine with lags, strict rolling mean, YoY, target and baseline."""
    w = series_window(["series"])
    spec = feat.LagSpec(["y"], lags=[1, 12], rolling=[3], rolling_std=False)
    built = fx.demand(spark, folder).withColumns(
        {
            **feat.lag_columns(spec, w),
            "y_target_h3": F.lead("y", 3).over(w),
            "target_date_h3": F.add_months("date", 3),
            # The target column one season back is the series nine months back at horizon 3.
            "seasonal_naive_proxy": F.lag("y", 9).over(w),
        }
    )
    return rounded(built, 2)


@query("feature_table", "W1 W2 W3 W4 W5 W7 W8 W9 W10 W11", with_ctes("supply", f"""
SELECT series, date, y,
       {', '.join(r4(f'lag(y, {k}) OVER ({WIN})', f'y_lag{k}') for k in [*range(1, 13), 18, 24])},
       {', '.join(r4(f'lag(y, {k}) OVER ({WIN}) - lag(y, {k + 1}) OVER ({WIN})', f'y_diff_lag{k}') for k in (1, 2, 3))},
       {', '.join(r4(strict(a, 'y', s), f'y_{n}_{s}') for s in (3, 6) for n, a in (('rollmean', 'avg'), ('rollstd', 'stddev_samp')))},
       {r4(f'lag(y, 1) OVER ({WIN}) - lag(y, 13) OVER ({WIN})', 'y_yoy_diff')},
       row_number() OVER ({WIN}) - 1 AS time_index_months,
       {r4('sin(2 * pi() * month(date) / 12)', 'month_sin')}, {r4('cos(2 * pi() * month(date) / 12)', 'month_cos')},
       CAST(date >= DATE '1999-01-01' AS BIGINT) AS event_observed,
       CAST(date >= DATE '1999-01-01' AND date < DATE '2000-01-01' AS BIGINT) AS event_active,
       CAST(date >= DATE '2000-01-01' AS BIGINT) AS event_post,
       CASE WHEN date >= DATE '1999-01-01' THEN (year(date) - 1999) * 12 + month(date) - 1 ELSE 0 END AS months_since_event,
       {r4(f"lag(y, 1) OVER ({WIN}) * CAST(date >= DATE '1999-01-01' AND date < DATE '2000-01-01' AS INT)", 'y_lag1_x_event_active')},
       {r4(f"lag(y, 1) OVER ({WIN}) * CAST(date >= DATE '2000-01-01' AS INT)", 'y_lag1_x_event_post')},
       {r4(f'lead(y, 3) OVER ({WIN})', 'y_target_h3')}, CAST(date + INTERVAL 3 MONTH AS DATE) AS target_date_h3,
       month(CAST(date + INTERVAL 3 MONTH AS DATE)) AS target_month_num_h3,
       {r4('sin(2 * pi() * month(date + INTERVAL 3 MONTH) / 12)', 'target_month_sin_h3')},
       {r4('cos(2 * pi() * month(date + INTERVAL 3 MONTH) / 12)', 'target_month_cos_h3')}
FROM supply"""))
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The whole history recipe per supplier: one exchange by series, one sort, all windows on it."""
    panel = fx.supply(spark, folder, ("y",))
    built = feat.build_features(panel, ["series"], "y", fx.HORIZON, regime=fx.REGIME, interaction_bases=["y_lag1"])
    return rounded(built.drop("month_num"))


@query("change_and_index", "W6 W18 W19", with_ctes("demand", f"""
SELECT series, date,
       {r4(f'(lag(y, 1) OVER ({WIN}) - lag(y, 13) OVER ({WIN})) / nullif(lag(y, 13) OVER ({WIN}), 0)', 'y_yoy_pct_lagged')},
       {r4(f'(y - lag(y, 1) OVER ({WIN})) / nullif(lag(y, 1) OVER ({WIN}), 0)', 'y_mom_pct')},
       {r4(f'(y - lag(y, 12) OVER ({WIN})) / nullif(lag(y, 12) OVER ({WIN}), 0)', 'y_yoy_pct')},
       {r4(f'y - lag(y, 1) OVER ({WIN})', 'y_mom_diff', 2)}, {r4(f'y - lag(y, 12) OVER ({WIN})', 'y_yoy_diff', 2)},
       {r4(f'y / first_value(y IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100', 'y_index')}
FROM demand"""))
def change_and_index(spark: SparkSession, folder: str) -> DataFrame:
    w = series_window(["series"])
    lagged = feat.lag_columns(feat.LagSpec(["y"], yoy_diff=False, yoy_pct=True), w)["y_yoy_pct"]
    built = fx.demand(spark, folder).select(
        "series",
        "date",
        lagged.alias("y_yoy_pct_lagged"),
        *[c.alias(n) for n, c in feat.change_columns(["y"], w).items()],
        feat.index_to_first("y", ["series"]).alias("y_index"),
    )
    return rounded(built.withColumns({c: F.round(c, 2) for c in ("y_mom_diff", "y_yoy_diff")}))


@query("pressure_ratios", "W12 X3 V5", with_ctes("supply", f"""
SELECT series, date, {r4('y_yoy * v_yoy', 'y_yoy_x_v_yoy', 2)}, {r4('v_lag1 / nullif(n, 0)', 'v_lag1_per_n', 6)},
       {', '.join(f'CAST(month(date) = {m} AS INT) + 0.0 AS month_{m}' for m in range(2, 13))}
FROM (SELECT series, date, n, lag(v, 1) OVER w AS v_lag1, lag(y, 1) OVER w - lag(y, 13) OVER w AS y_yoy,
             lag(v, 1) OVER w - lag(v, 13) OVER w AS v_yoy FROM supply WINDOW w AS ({WIN}))""").replace("+ 0.0 AS month", "* CAST(1 AS DOUBLE) AS month"))
def pressure_ratios(spark: SparkSession, folder: str) -> DataFrame:
    w = series_window(["series"])
    lags = feat.lag_columns(feat.LagSpec(["y", "v"], lags=[1]), w)
    built = fx.supply(spark, folder).withColumns(lags)
    products = feat.product_columns(built.columns, {"y_yoy_x_v_yoy": ("y_yoy_diff", "v_yoy_diff")})
    ratios = feat.ratio_columns(built.columns, {"v_lag1_per_n": ("v_lag1", "n")})
    return built.select(
        "series",
        "date",
        F.round(products["y_yoy_x_v_yoy"], 2).alias("y_yoy_x_v_yoy"),
        F.round(ratios["v_lag1_per_n"], 6).alias("v_lag1_per_n"),
        *[c.alias(n) for n, c in rs.month_dummies(F.month("date")).items()],
    )


@query("feature_transforms", "X2 X12 P15", with_ctes("supply", f"""
SELECT series, date, coalesce(d, 0) AS d, {r4('coalesce(sign(d) * ln(1 + abs(d)), 0)', 'd__log_signed')},
       coalesce(d * d, 0) AS d__pow2, coalesce(d * d * d, 0) AS d__pow3
FROM (SELECT series, date, y - lag(y, 1) OVER ({WIN}) AS d FROM supply)"""))
def feature_transforms(spark: SparkSession, folder: str) -> DataFrame:
    change = fx.supply(spark, folder, ("y",)).select(
        "series", "date", (F.col("y") - F.lag("y").over(series_window(["series"]))).alias("d")
    )
    return rounded(feat.transform_features(change, ["d"], "log_signed_quadratic_cubic"))


@query("leading_trim", "P9 W8", with_ctes("supply", f"""
SELECT series, date, y, row_number() OVER ({WIN}) - 1 AS time_index_months
FROM (SELECT *, row_number() OVER ({WIN}) AS rn FROM supply) WHERE rn > 16"""))
def leading_trim(spark: SparkSession, folder: str) -> DataFrame:
    trimmed = trim_leading(fx.supply(spark, folder, ("y",)), ["series"], 16)
    return rounded(trimmed.withColumn("time_index_months", F.row_number().over(series_window(["series"])) - 1))


WEEKLY = """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS price FROM lineitem GROUP BY 1"""
cte("weekly", "", WEEKLY)


def weekly_price(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return lines.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        (exact_sum("l_extendedprice") / F.sum("l_quantity")).alias("price")
    )


@query("weekly_to_monthly", "A1 P1 W29 X4", with_ctes("weekly", f"""
SELECT date, {r4('price_avg', 'price_avg')}, {r4('price_std', 'price_std')}, weekly_obs_count,
       last_day(date) AS period_end, CAST(last_day(date) + 7 AS DATE) AS available_at, 'wk' AS series_id, 'lines' AS source_name
FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(price) AS price_avg,
             coalesce(stddev_samp(price), 0) AS price_std, count(*) AS weekly_obs_count FROM weekly GROUP BY 1)"""))
def weekly_to_monthly(spark: SparkSession, folder: str) -> DataFrame:
    monthly = rs.weekly_to_monthly(weekly_price(spark, folder), [], "price", "price")
    return rounded(rs.stamp_source(monthly, "wk", "lines"))


def wide_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """One row per priority with a text column per month, the layout of a published sheet."""
    long = fx.demand(spark, folder).withColumn("month", F.date_format("date", "M/yyyy"))
    months = [f"{m}/{y}" for y in range(1995, 2002) for m in range(1, 13)]
    wide = long.groupBy("series").pivot("month", months).agg(F.first(F.col("n").cast("string")))
    return wide.withColumns({"Mode": F.lit(" MB "), "Status": F.lit("Active")})


@query("wide_to_long", "S4 P2 P3 P4 P5", with_ctes("demand", """
SELECT k.series, CAST(m.d AS DATE) AS date, CAST(d.n AS DOUBLE) AS n
FROM (SELECT DISTINCT series FROM demand) k,
     (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS d) m
LEFT JOIN demand d ON d.series = k.series AND d.date = CAST(m.d AS DATE)"""))
def wide_to_long(spark: SparkSession, folder: str) -> DataFrame:
    kept = rs.filter_trimmed_equal(wide_sheet(spark, folder), {"Mode": "MB", "Status": "Active"})
    return rs.wide_to_long(kept, ["series"], "n")


@query("promoted_header", "P6 P2", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS price FROM orders GROUP BY 1""")
def promoted_header(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet rows: codes, names, then data; data rows come from monthly order counts."""
    counts = to_monthly(table(spark, folder, "orders"), [], "o_orderdate", {"n": F.count(F.lit(1))})
    index = (F.months_between(F.col("date"), F.lit("1990-01-01").cast("date"))).cast("int")
    data = counts.select(index.alias("row"), F.date_format("date", "yyyy-MM-dd").alias("c0"), F.col("n").cast("string").alias("c1"))
    head = spark.createDataFrame([(0, "Sourcekey", "CODE1"), (1, "Date", "Orders")], "row int, c0 string, c1 string")
    return rs.promote_header(head.unionByName(data), "row", "Sourcekey", "CODE1", "price")


EXOG = """SELECT date, CASE WHEN (month(date) = 7 AND year(date) IN (1997, 1999)) OR date > (SELECT max(CAST(date_trunc('month', l_shipdate) AS DATE)) FROM lineitem) - INTERVAL 2 MONTH
               THEN NULL ELSE price END AS price
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS price FROM lineitem GROUP BY 1)"""
cte("exog", "", EXOG)


def exogenous(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly mean price with two interior holes and two missing months at the end."""
    lines = table(spark, folder, "lineitem")
    monthly = to_monthly(lines, [], "l_shipdate", {"price": exact_sum("l_extendedprice") / F.sum("l_quantity")})
    last = monthly.agg(F.max("date").alias("d")).scalar()
    hole = (F.month("date") == 7) & F.year("date").isin(1997, 1999)
    return monthly.withColumn("price", F.when(~hole & (F.col("date") <= F.add_months(last, -2)), F.col("price")))


@query("integrate_sources", "J1 J2 P7 X11 W26 W29", with_ctes("exog weekly", f"""
SELECT b.date, b.n_orders, {r4('b.order_value', 'order_value', 2)}, {r4('g.price_avg', 'price_avg')}, {r4('e.price', 'price')},
       CAST(last_day(b.date) + 14 AS DATE) AS data_available_at, CAST(last_day(b.date) + 14 - b.date AS BIGINT) AS lag_days
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n_orders,
             CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value FROM orders GROUP BY 1) b
LEFT JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(price) AS price_avg FROM weekly GROUP BY 1) g USING (date)
LEFT JOIN exog e USING (date)"""))
def integrate_sources(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    counts = to_monthly(orders, [], "o_orderdate", {"n_orders": F.count(F.lit(1))})
    values = to_monthly(orders, [], "o_orderdate", {"order_value": exact_sum("o_totalprice")})
    base = rs.stamp_source(rs.align_inner([counts, values], ["date"]), "base", "orders")
    weekly = rs.stamp_source(rs.weekly_to_monthly(weekly_price(spark, folder), [], "price", "price"), "wk", "lines", 10)
    exog = rs.stamp_source(exogenous(spark, folder), "ex", "lines", 14)
    joined = rs.integrate(base, {"gas": weekly, "inflation": exog}, ["date"], "base")
    kept = rs.keep_present(joined, ["date", "n_orders", "order_value", "price_avg", "price", "not_there", "data_available_at"])
    out = kept.withColumn("lag_days", availability_lag_days("data_available_at", "date"))
    return rounded(out.withColumn("order_value", F.round("order_value", 2)))


@query("outer_alignment", "J3 S3", """
SELECT date, sum(n) FILTER (WHERE src = 'orders') AS orders, sum(n) FILTER (WHERE src = 'lines') AS lines
FROM (SELECT 'orders' AS src, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2
      UNION ALL SELECT 'lines', CAST(date_trunc('month', l_shipdate) AS DATE), count(*) FROM lineitem GROUP BY 2) GROUP BY 1
""".replace("sum(n)", "max(n)"))
def outer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        to_monthly(table(spark, folder, t), [], d, {"n": F.count(F.lit(1))}).withColumn("src", F.lit(name))
        for name, t, d in (("orders", "orders", "o_orderdate"), ("lines", "lineitem", "l_shipdate"))
    ]
    return rs.align_outer(parts[0].unionByName(parts[1]), ["date"], "src", "n", ["orders", "lines"])


def _imputed(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "series")
    panel = on_spine(
        to_monthly(lines, ["series"], "l_shipdate", {"price": exact_sum("l_extendedprice") / F.sum("l_quantity")}), ["series"]
    )
    last = F.max("date").over(W.partitionBy("series"))
    hole = (F.month("date") == 7) & F.year("date").isin(1997, 1999)
    holed = panel.withColumn("_last", last).withColumn(
        "price", F.when(~hole & (F.col("date") <= F.add_months("_last", -2)), F.col("price"))
    )
    return imp.impute(holed.drop("_last"), ["series"], ["price"])


cte("gappy", "", """
  SELECT series, date, CASE WHEN (month(date) = 7 AND year(date) IN (1997, 1999)) OR date > max(date) OVER (PARTITION BY series) - INTERVAL 2 MONTH
         THEN NULL ELSE price END AS price, row_number() OVER (PARTITION BY series ORDER BY date) AS pos
  FROM (SELECT s.series, s.date, o.price
        FROM (SELECT k.series, CAST(unnest(generate_series(b.lo, b.hi, INTERVAL 1 MONTH)) AS DATE) AS date
              FROM (SELECT DISTINCT l_returnflag AS series FROM lineitem) k,
                   (SELECT date_trunc('month', min(l_shipdate)) lo, date_trunc('month', max(l_shipdate)) hi FROM lineitem) b) s
        LEFT JOIN (SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
                          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS price
                   FROM lineitem GROUP BY 1, 2) o USING (series, date))""")
cte("inside", "gappy", """
  SELECT *, CASE WHEN price IS NOT NULL THEN price
                 ELSE lv + (rv - lv) * (pos - lp) / CAST(rp - lp AS DOUBLE) END AS filled
  FROM (SELECT *, last_value(price IGNORE NULLS) OVER w1 AS lv,
               max(CASE WHEN price IS NOT NULL THEN pos END) OVER w1 AS lp,
               first_value(price IGNORE NULLS) OVER w2 AS rv,
               min(CASE WHEN price IS NOT NULL THEN pos END) OVER w2 AS rp
        FROM gappy
        WINDOW w1 AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               w2 AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
cte("ends", "inside", """
  SELECT series, max(pos) FILTER (WHERE filled IS NOT NULL) AS lastpos, min(pos) FILTER (WHERE filled IS NOT NULL) AS firstpos,
         max(pos) AS rows FROM inside GROUP BY 1""")
# The projection as a recursion over the last five values.
cte("walk", "ends inside", """
  SELECT e.series, 0 AS step, e.rows - e.lastpos AS steps,
         max(i.filled) FILTER (WHERE i.pos = e.lastpos - 4) AS a, max(i.filled) FILTER (WHERE i.pos = e.lastpos - 3) AS b,
         max(i.filled) FILTER (WHERE i.pos = e.lastpos - 2) AS c, max(i.filled) FILTER (WHERE i.pos = e.lastpos - 1) AS d,
         max(i.filled) FILTER (WHERE i.pos = e.lastpos) AS e, e.lastpos
  FROM ends e JOIN inside i USING (series) WHERE e.firstpos = 1 GROUP BY e.series, e.rows, e.lastpos""")
STEP = "CAST(-0.4 AS DOUBLE) * a - CAST(0.1 AS DOUBLE) * b + CAST(0.2 AS DOUBLE) * c + CAST(0.5 AS DOUBLE) * d + CAST(0.8 AS DOUBLE) * e"
cte("trend", "walk", f"""
  SELECT series, lastpos + 1 AS pos, {STEP} AS v FROM walk WHERE steps >= 1
  UNION ALL
  SELECT series, lastpos + 2, CAST(-0.4 AS DOUBLE) * b - CAST(0.1 AS DOUBLE) * c + CAST(0.2 AS DOUBLE) * d + CAST(0.5 AS DOUBLE) * e
         + CAST(0.8 AS DOUBLE) * ({STEP}) FROM walk WHERE steps >= 2""")
cte("imputed", "inside trend", """
  SELECT i.series, i.date, i.price AS original, coalesce(i.filled, t.v) AS price,
         CAST(i.price IS NULL AND coalesce(i.filled, t.v) IS NOT NULL AS BIGINT) AS price_was_imputed,
         CAST(i.price IS NULL AND i.filled IS NOT NULL AS BIGINT) AS price_imputed_interpolated,
         CAST(i.filled IS NULL AND t.v IS NOT NULL AS BIGINT) AS price_imputed_trailing_trend
  FROM inside i LEFT JOIN trend t USING (series, pos)""")


@query("impute", "W13 W14 W15", with_ctes("imputed", f"""
SELECT series, date, {r4('price', 'price')}, price_was_imputed, price_imputed_interpolated, price_imputed_trailing_trend FROM imputed"""))
def impute(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_imputed(spark, folder))


@query("imputation_log", "W16 A27", with_ctes("imputed", f"""
SELECT series, date, 'price' AS "column", CASE WHEN price_imputed_trailing_trend = 1 THEN 'five_month_recent_trend_projection'
       ELSE 'linear_interpolation_between_observed_months' END AS method, {r4('price', 'imputed_value')}
FROM imputed WHERE price_was_imputed = 1"""))
def imputation_log(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(imp.imputation_log(_imputed(spark, folder), ["series"], ["price"]))


def annual_value(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return joined.groupBy("series", "year").agg(exact_sum("o_totalprice").alias("income"))


cte("annual", "", """
  SELECT o_orderpriority AS series, year(o_orderdate) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS income
  FROM orders GROUP BY 1, 2""")
cte("annual_ext", "annual", """
  SELECT series, year, income, 'observed' AS reference_method FROM annual
  UNION ALL
  SELECT e.series, CAST(g.y AS BIGINT), e.v + e.step * (g.y - e.last), 'projected_5yr_dollar_trend'
  FROM (SELECT series, max(year) AS last, arg_max(income, year) AS v, avg(d) FILTER (WHERE rn <= 5) AS step
        FROM (SELECT *, income - lag(income) OVER (PARTITION BY series ORDER BY year) AS d,
                     row_number() OVER (PARTITION BY series ORDER BY year DESC) AS rn FROM annual) GROUP BY 1) e,
       (SELECT unnest(generate_series(1990, 2004)) AS y) g WHERE g.y > e.last""")


@query("annual_projection", "W24", with_ctes("annual_ext", f"""
SELECT series, CAST(year AS BIGINT) AS year, {r4('income', 'income', 2)}, reference_method FROM annual_ext"""))
def annual_projection(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(feat.project_annual(annual_value(spark, folder), ["series"], "income", 2004), 2)


@query("prior_year_context", "W23 J4", with_ctes("annual_ext", f"""
SELECT series, CAST(m.d AS DATE) AS date, CAST(year AS BIGINT) AS reference_year, reference_method,
       {r4('income', 'income_prior_year', 4)}, {r4('income / 12', 'monthly_income_prior_year', 4)},
       {r4('yoy', 'income_yoy_pct_prior_year')}, {r4('two', 'income_2yr_pct_prior_year')}
FROM (SELECT *, (income - lag(income) OVER w) / nullif(lag(income) OVER w, 0) AS yoy,
             (income - lag(income, 2) OVER w) / nullif(lag(income, 2) OVER w, 0) AS two
      FROM annual_ext WINDOW w AS (PARTITION BY series ORDER BY year)) a
JOIN (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2004-06-01', INTERVAL 1 MONTH)) AS d) m ON year(m.d) = a.year + 1"""))
def prior_year_context(spark: SparkSession, folder: str) -> DataFrame:
    extended = feat.project_annual(annual_value(spark, folder), ["series"], "income", 2004)
    built = feat.prior_year_context(extended, ["series"], "income", "1996-01-01", "2004-06-01")
    return rounded(built)


@query("target_by_date", "J5", with_ctes("demand_obs", """
SELECT a.series, a.date, a.n, b.n AS n_target_h3 FROM demand_obs a
LEFT JOIN demand_obs b ON b.series = a.series AND b.date = CAST(a.date + INTERVAL 3 MONTH AS DATE)"""))
def target_by_date(spark: SparkSession, folder: str) -> DataFrame:
    """On rows with missing months a date lookup, not a positional lead, finds the target."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "series")
    observed = to_monthly(orders, ["series"], "o_orderdate", {"n": F.count(F.lit(1))})
    return rs.target_by_date(observed, ["series"], "n", 3)


@query("sequence_windows", "W25 X10", with_ctes("demand_obs", """
SELECT series, date, len(seq) AS steps, list_sum(seq) AS total, CAST(first_date AS DATE) AS first_date
FROM (SELECT series, date, list(n) OVER w AS seq, min(date) OVER w AS first_date,
             (year(date) * 12 + month(date)) - lag(year(date) * 12 + month(date), 11) OVER (PARTITION BY series ORDER BY date) AS span
      FROM demand_obs WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
WHERE span = 11""").replace("list_sum(seq)", "CAST(list_sum(seq) AS DOUBLE)"))
def sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "series")
    observed = to_monthly(orders, ["series"], "o_orderdate", {"n": F.count(F.lit(1))})
    samples = feat.sequence_samples(observed, ["series"], ["n"], 12)
    total = F.aggregate("sequence", F.lit(0.0), lambda t, s: t + s["features"][0])
    return rounded(
        samples.select("series", "date", F.size("sequence").alias("steps"), total.alias("total"), F.get("sequence", F.lit(0))["date"].alias("first_date"))
    )


@query("month_calendar", "X4 W28 W9", """
SELECT o_orderpriority AS series, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS first_month,
       last_day(min(o_orderdate)) AS first_period_end, monthname(min(o_orderdate)) AS month_name,
       (year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)) AS span,
       ((year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate))) // 3 + 1 AS quarters
FROM orders GROUP BY 1""")
def month_calendar(spark: SparkSession, folder: str) -> DataFrame:
    from hindcast.functions.calendar import month_count, month_floor, months_apart

    low, high = F.min("o_orderdate"), F.max("o_orderdate")
    out = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(
        month_floor(low).alias("first_month"),
        period_end(low.cast("date")).alias("first_period_end"),
        month_name(low).alias("month_name"),
        months_apart(low, high).alias("span"),
        month_count(month_floor(low), month_floor(high), 3).alias("quarters"),
    )
    return rounded(out)


@query("event_compare", "A31 V3", with_ctes("supply", f"""
SELECT series, month, y1 AS year_1998, y2 AS year_2000, y2 - y1 AS difference, {r4('(y2 - y1) / nullif(y1, 0) * 100', 'pct_change')}
FROM (SELECT series, month(date) AS month, max(y) FILTER (WHERE year(date) = 1998) AS y1, max(y) FILTER (WHERE year(date) = 2000) AS y2
      FROM supply WHERE month(date) BETWEEN 9 AND 11 GROUP BY 1, 2)"""))
def event_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Autumn months of two years side by side."""
    autumn = fx.supply(spark, folder, ("y",)).where(F.month("date").between(9, 11))
    with_year = autumn.select("series", F.month("date").alias("month"), F.year("date").alias("year"), "y")
    return rounded(rs.pivot_years(with_year, ["series", "month"], "year", [1998, 2000], "y"))
