"""Regression diagnostics and tests.

Each test works on one monthly series per group, at most one row per calendar month, so a group is a
small matrix. Spark partitions the groups; numpy solves them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FRACTION_STEPS = 10_000


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    z = np.asarray(z, dtype=float)
    shift = np.zeros_like(z)
    for _ in range(10):
        low = z < 10
        shift = shift + np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1, z)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (t > 0) & (t < 1)
    safe = np.where(inside, t, 0.5)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    tiny = 1e-300
    d = 1 - (p + q) * safe / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, fraction = np.ones_like(d), d.copy()
    for m in range(1, MAX_FRACTION_STEPS):
        for term in (
            m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            fraction = fraction * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    else:
        raise ArithmeticError("the continued fraction did not converge")
    value = np.where(inside, front * fraction, np.where(t >= 1, 1.0, 0.0))
    return np.where(swap, 1 - value, value)


def f_upper_tail(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f = np.maximum(np.asarray(f, float), 0.0)
    return regularized_beta(np.asarray(df2) / 2, np.asarray(df1) / 2, df2 / (df2 + df1 * f))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return regularized_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution, a batch at a time."""
    good = f.notna() & df1.notna() & df2.notna() & (df2 > 0)
    out = f_upper_tail(f.where(good, 1.0).to_numpy(), df1.where(good, 1).to_numpy(float), df2.where(good, 1).to_numpy(float))
    return pd.Series(out).where(good.to_numpy())


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Both tails of the normal distribution, by the error function."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore").astype(float)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    good = t.notna() & df.notna() & (df > 0)
    return pd.Series(t_two_sided(t.where(good, 0.0).to_numpy(), df.where(good, 1.0).to_numpy(float))).where(good.to_numpy())


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, rest, float(rest @ rest)


# --- Granger screen (E8) ---------------------------------------------------------------------------


def granger_f_tests(df: DataFrame, keys: list[str], target: str, predictors: list[str], max_lag: int = 6, min_rows: int = 40) -> DataFrame:
    """F test per predictor and lag order: do the predictor's lags help beyond the target's own?"""
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields], "predictor string", "lag int", "f_statistic double", "df1 int", "df2 int", "n int"])

    def tests(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for predictor in predictors:
            data = frame.sort_values("date")[[target, predictor]].dropna().to_numpy(float)
            if len(data) < min_rows:
                continue
            for lag in range(1, max_lag + 1):
                y = data[lag:, 0]
                own = np.column_stack([data[lag - k : len(data) - k, 0] for k in range(1, lag + 1)])
                other = np.column_stack([data[lag - k : len(data) - k, 1] for k in range(1, lag + 1)])
                one = np.ones((len(y), 1))
                ssr_small = least_squares(np.hstack([one, own]), y)[2]
                ssr_full = least_squares(np.hstack([one, own, other]), y)[2]
                df2 = len(y) - 2 * lag - 1
                if df2 > 0 and ssr_full > 0:
                    f = (ssr_small - ssr_full) / lag / (ssr_full / df2)
                    rows.append([*[frame[k].iloc[0] for k in keys], predictor, lag, f, lag, df2, len(data)])
        return pd.DataFrame(rows, columns=[*keys, "predictor", "lag", "f_statistic", "df1", "df2", "n"])

    out = df.select(*keys, "date", target, *predictors).groupBy(*keys).applyInPandas(tests, fields)
    return out.withColumn("p_value", f_p_value("f_statistic", "df1", "df2"))


def granger_screening(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Lag with the smallest p-value per predictor."""
    return tests.groupBy(*keys, "predictor").agg(
        F.min_by("lag", F.struct("p_value", "lag")).alias("best_lag"),
        F.min("p_value").alias("min_p_value"),
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "p_value"))), lambda e: e["p_value"]).alias("pvals_by_lag"),
        F.max("n").alias("n"),
    )


# --- HAC regression (E9) ---------------------------------------------------------------------------


def newey_west(x: np.ndarray, rest: np.ndarray, lags: int) -> np.ndarray:
    """Sandwich covariance with Bartlett weights."""
    bread = np.linalg.pinv(x.T @ x)
    scores = x * rest[:, None]
    meat = scores.T @ scores
    for k in range(1, lags + 1):
        cross = scores[k:].T @ scores[:-k]
        meat = meat + (1 - k / (lags + 1)) * (cross + cross.T)
    return bread @ meat @ bread


def hac_regression(df: DataFrame, keys: list[str], target: str, terms: list[str], lags: int = 12) -> DataFrame:
    """Coefficients with autocorrelation-robust errors, normal p-values and 95 % intervals."""
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields], "term string", "coef double", "std_err_hac double", "n int", "r2 double"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        data = frame.sort_values("date")[[target, *terms]].dropna()
        names = ["const", *terms]
        if len(data) <= len(names) + lags:
            return pd.DataFrame(columns=[*keys, "term", "coef", "std_err_hac", "n", "r2"])
        y = data[target].to_numpy(float)
        x = np.column_stack([np.ones(len(data)), data[terms].to_numpy(float)])
        beta, rest, ssr = least_squares(x, y)
        errors = np.sqrt(np.clip(np.diag(newey_west(x, rest, lags)), 0, None))
        sst = float(((y - y.mean()) ** 2).sum())
        out = pd.DataFrame({"term": names, "coef": beta, "std_err_hac": errors})
        out["n"], out["r2"] = len(data), 1 - ssr / sst if sst else np.nan
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "term", "coef", "std_err_hac", "n", "r2"]]

    out = df.select(*keys, "date", target, *terms).groupBy(*keys).applyInPandas(fit, fields)
    z = F.try_divide("coef", "std_err_hac")
    half = F.col("std_err_hac") * 1.959963984540054
    return out.withColumns(
        {"p_value_hac": normal_p_value(z), "ci_low": F.col("coef") - half, "ci_high": F.col("coef") + half}
    )


# --- break tests (E10, E11) ------------------------------------------------------------------------


def chow_test(df: DataFrame, keys: list[str], target: str, terms: list[str], post: str) -> DataFrame:
    """Coefficient stability between two periods: pooled against separate regressions."""
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields], "f_statistic double", "df1 int", "df2 int", "pre_n int", "post_n int"])
    k = len(terms) + 1

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        data = frame[[target, *terms, post]].dropna()
        after = data[post].to_numpy(bool)
        y = data[target].to_numpy(float)
        x = np.column_stack([np.ones(len(data)), data[terms].to_numpy(float)])
        columns = [*keys, "f_statistic", "df1", "df2", "pre_n", "post_n"]
        n_post, n_pre = int(after.sum()), int((~after).sum())
        df2 = len(y) - 2 * k
        if n_pre <= k or n_post <= k or df2 <= 0:
            return pd.DataFrame(columns=columns)
        pooled = least_squares(x, y)[2]
        split = least_squares(x[~after], y[~after])[2] + least_squares(x[after], y[after])[2]
        f = (pooled - split) / k / (split / df2) if split > 0 else np.nan
        return pd.DataFrame([[*[frame[c].iloc[0] for c in keys], f, k, df2, n_pre, n_post]], columns=columns)

    out = df.select(*keys, target, *terms, post).groupBy(*keys).applyInPandas(test, fields)
    return out.withColumn("p_value", f_p_value("f_statistic", "df1", "df2"))


def chow_simple(df: DataFrame, keys: list[str], y: str, x: str, post: str) -> DataFrame:
    """The break test for one regressor from grouped moments alone; works on groups of any size."""

    def ssr(condition: Column) -> Column:
        a = F.when(condition, F.col(y))
        b = F.when(condition, F.col(x))
        return F.regr_syy(a, b) - F.try_divide(F.pow(F.regr_sxy(a, b), F.lit(2.0)), F.regr_sxx(a, b))

    after = F.col(post)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    sums = df.groupBy(*keys).agg(
        ssr(F.lit(True)).alias("_pooled"),
        (ssr(~after) + ssr(after)).alias("_split"),
        F.count(F.when(both & ~after, 1)).alias("pre_n"),
        F.count(F.when(both & after, 1)).alias("post_n"),
    )
    df2 = F.col("pre_n") + F.col("post_n") - 4
    statistic = F.try_divide((F.col("_pooled") - F.col("_split")) / 2, F.try_divide(F.col("_split"), df2))
    return sums.where((F.col("pre_n") > 2) & (F.col("post_n") > 2) & (df2 > 0)).select(
        *keys, statistic.alias("f_statistic"), F.lit(2).alias("df1"), df2.alias("df2"), "pre_n", "post_n"
    )


def welch_test(df: DataFrame, keys: list[str], value: str, post: str) -> DataFrame:
    """Two-sample mean comparison with unequal variances (E11), from grouped moments."""
    before, after = F.when(~F.col(post), F.col(value)), F.when(F.col(post), F.col(value))
    sums = df.groupBy(*keys).agg(
        F.avg(before).alias("pre_mean"), F.avg(after).alias("post_mean"),
        F.var_samp(before).alias("_v1"), F.var_samp(after).alias("_v2"),
        F.count(before).alias("pre_n"), F.count(after).alias("post_n"),
    )
    a, b = F.try_divide("_v1", "pre_n"), F.try_divide("_v2", "post_n")
    t = F.try_divide(F.col("pre_mean") - F.col("post_mean"), F.sqrt(a + b))
    freedom = F.try_divide(
        F.pow(a + b, F.lit(2.0)), F.try_divide(a * a, F.col("pre_n") - 1) + F.try_divide(b * b, F.col("post_n") - 1)
    )
    return sums.select(*keys, "pre_mean", "post_mean", "pre_n", "post_n", t.alias("t_statistic"), freedom.alias("df"))


def with_t_p_value(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", t_p_value("t_statistic", "df"))
