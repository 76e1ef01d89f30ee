"""Solvers and tests against brute force on small data."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast.operators import models as md
from hindcast.operators import policies as pol
from hindcast.operators import stats as st
from hindcast.plans.stats_queries import FEATURES, LINEAR_GRID, feature_panel


@pytest.fixture(scope="module")
def panel(spark, small):
    return feature_panel(spark, small)


@pytest.fixture(scope="module")
def frame(panel):
    return panel.toPandas()


def snapshot(frame, day, embargo=3):
    cut = (pd.Timestamp(day) - pd.DateOffset(months=embargo)).date()
    data = frame[frame["date"] < cut].dropna(subset=[*FEATURES, "target", "baseline"])
    x = data[FEATURES].to_numpy(float)
    spread = x.std(axis=0)
    return data, (x - x.mean(0)) / np.where(spread > 0, spread, 1)


@pytest.fixture(scope="module")
def fits(panel, small):
    evaluated = F.col("date").isin(dt.date(2000, 1, 1), dt.date(2000, 7, 1)) & F.col("target").isNotNull()
    predictions, fitted = md.backtest_linear(
        panel, ["series"], [], FEATURES, "target", "baseline", LINEAR_GRID, evaluated, F.col("date"), 3
    )
    return predictions.toPandas(), fitted.toPandas()


def test_ridge_equals_normal_equations(frame, fits):
    for _, row in fits[1][fits[1].model_type == "ridge"].iterrows():
        data, x = snapshot(frame, row["date"])
        y = data["target"] - (data["baseline"] if row["mode"] == "residual" else 0)
        alpha = LINEAR_GRID[row["config"]]["params"]["alpha"]
        weight = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()).to_numpy())
        assert row["n_train"] == len(data)
        assert np.allclose(row["standardised"], weight, rtol=1e-7, atol=1e-8)


def test_lasso_and_elastic_net_meet_optimality(frame, fits):
    for _, row in fits[1][fits[1].model_type != "ridge"].iterrows():
        data, x = snapshot(frame, row["date"])
        y = (data["target"] - (data["baseline"] if row["mode"] == "residual" else 0)).to_numpy()
        params = LINEAR_GRID[row["config"]]["params"]
        ratio = params.get("l1_ratio", 1.0)
        w = np.array(row["standardised"])
        gradient = x.T @ (y - y.mean() - x @ w) / len(y) - params["alpha"] * (1 - ratio) * w
        bound = params["alpha"] * ratio
        assert np.all(np.abs(gradient) <= bound + 1e-6)
        assert np.allclose(gradient[w != 0], bound * np.sign(w[w != 0]), atol=1e-6)


def test_predictions_use_the_fit(frame, fits):
    predictions, fitted = fits
    row = predictions[predictions["mode"] == "residual"].iloc[0]
    fit = fitted[(fitted["date"] == row["fit_date"]) & (fitted["config_id"] == row["config_id"])].iloc[0]
    x = frame[(frame["series"] == row["series"]) & (frame["date"] == row["as_of_date"])][FEATURES].to_numpy(float)[0]
    assert row["prediction"] == pytest.approx(row["seasonal_naive_prediction"] + fit["intercept"] + x @ np.array(fit["coef"]))
    as_ofs = predictions.groupby("config_id").size()
    assert as_ofs.nunique() == 1 and len(as_ofs) == len(LINEAR_GRID)


def test_masked_features_get_no_weight(panel):
    evaluated = (F.col("date") == F.lit("2000-07-01").cast("date")) & F.col("target").isNotNull()
    _, fitted = md.backtest_linear(
        panel, ["series"], ["series"], FEATURES, "target", "baseline", LINEAR_GRID[:1], evaluated, F.col("date"), 3, policy="corr_pruned"
    )
    moments = pol.prefix_moments(panel.withColumn("r", F.col("target") - F.col("baseline")), ["series"], [*FEATURES, "target", "r"], ["baseline"], 3, True)
    kept = pol.pruned_features(pol.selection_masks(moments, FEATURES, "corr_pruned"), ["series"], FEATURES, "corr_pruned")
    wanted = {(r.series, r.date): set(r.selected_features) for r in kept.collect()}
    for r in fitted.collect():
        weighted = {c for c, w in zip(FEATURES, r.standardised) if w != 0}
        assert weighted <= wanted[(r.series, r.date)]


def test_transformed_features_follow_their_base(panel):
    from hindcast.operators.features import transform_features, transformed_names

    names = transformed_names(["y_lag1", "y_lag2"], "quadratic")
    expanded = transform_features(panel.dropna(subset=["y_lag1", "y_lag2"]), ["y_lag1", "y_lag2"], "quadratic")
    evaluated = (F.col("date") == F.lit("2000-07-01").cast("date")) & F.col("target").isNotNull()
    predictions, fitted = md.backtest_linear(
        expanded, ["series"], [], names, "target", "baseline", LINEAR_GRID[:1], evaluated, F.col("date"), 3,
        policy="variance_pruned", transform="quadratic", base_features=2,
    )
    assert len(fitted.first().standardised) == 4 and predictions.count() > 0
    assert "transform-quadratic" in predictions.first().config_id


def test_importance_is_ranked_by_size(fits, panel):
    rows = md.feature_importance(
        panel.sparkSession.createDataFrame(fits[1][["date", "config_id", "standardised"]]), [], FEATURES
    ).toPandas()
    first = rows[rows["rank"] == 1].groupby(["as_of_date", "config_id"])["importance_abs"].max()
    assert np.allclose(first, rows.groupby(["as_of_date", "config_id"])["importance_abs"].max())


def test_lasso_selector_order(panel):
    moments = pol.prefix_moments(panel, [], [*FEATURES, "target", "baseline"], [], 3).where(F.col("date") == F.lit("2000-07-01").cast("date"))
    chosen = md.lasso_selection(moments, [], FEATURES, 0.5).first()
    none = md.lasso_selection(moments, [], FEATURES, 1e9).first()
    assert set(chosen.selected_features) <= set(FEATURES) and none.selected_features == [FEATURES[0]]


def test_sequence_components(spark, small):
    from hindcast.operators.features import sequence_samples
    from hindcast.plans import fixtures as fx

    samples = sequence_samples(fx.supply(spark, small, ("y",)), ["series"], ["y"], 6)
    train = F.col("date") < F.lit("2000-01-01").cast("date")
    fixed = md.sequence_representation(samples, train, components=2).first()
    assert len(fixed.representation) == 2


def test_incomplete_beta_known_values():
    assert st.regularized_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    assert st.regularized_beta(0.5, 0.5, 0.25) == pytest.approx(2 / np.pi * np.arcsin(0.5))
    assert st.f_upper_tail(np.array([4.0]), np.array([2.0]), np.array([10.0]))[0] == pytest.approx((1 + 2 * 4 / 10) ** -5)
    assert st.t_two_sided(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.5)
    assert st.t_two_sided(np.array([1.959963984540054]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-6)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    n = 90
    x = np.cumsum(rng.normal(size=n))
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + rng.normal(scale=0.3, size=n)
    rows = [("s", dt.date(2000 + i // 12, i % 12 + 1, 1), float(x[i]), float(y[i]), i >= 50) for i in range(n)]
    return spark.createDataFrame(rows, "series string, date date, x double, y double, post boolean"), x, y


def test_granger_finds_the_leading_series(regression):
    df, x, y = regression
    tests = st.granger_f_tests(df, ["series"], "y", ["x"], 3).toPandas().set_index("lag")
    full = np.column_stack([np.ones(89), y[:-1], x[:-1]])
    small = full[:, :2]
    ssr = [st.least_squares(m, y[1:])[2] for m in (small, full)]
    assert tests.loc[1, "f_statistic"] == pytest.approx((ssr[0] - ssr[1]) / (ssr[1] / (89 - 3)))
    assert tests.loc[1, "p_value"] < 1e-6
    assert st.granger_screening(st.granger_f_tests(df, ["series"], "y", ["x"], 3), ["series"]).first().n == 90


def test_chow_forms_agree(regression):
    df, _, _ = regression
    general = st.chow_test(df, ["series"], "y", ["x"], "post").first()
    simple = st.chow_simple(df, ["series"], "y", "x", "post").first()
    assert general.f_statistic == pytest.approx(simple.f_statistic) and (general.df1, general.df2) == (2, simple.df2)
    assert 0 <= general.p_value <= 1


def test_hac_matches_formula(regression):
    df, x, y = regression
    out = st.hac_regression(df, ["series"], "y", ["x"], 4).toPandas().set_index("term")
    design = np.column_stack([np.ones(len(x)), x])
    beta, rest, _ = st.least_squares(design, y)
    scores = design * rest[:, None]
    meat = scores.T @ scores
    for k in range(1, 5):
        c = scores[k:].T @ scores[:-k]
        meat += (1 - k / 5) * (c + c.T)
    inverse = np.linalg.inv(design.T @ design)
    errors = np.sqrt(np.diag(inverse @ meat @ inverse))
    assert out.loc["x", "coef"] == pytest.approx(beta[1]) and out.loc["x", "std_err_hac"] == pytest.approx(errors[1])


def test_residuals_equal_dummy_regression(spark):
    from hindcast.operators.eda import residuals

    rng = np.random.default_rng(5)
    y = rng.normal(size=40) + np.arange(40) * 0.2
    y[7] = np.nan
    rows = [("s", dt.date(2000 + i // 12, i % 12 + 1, 1), None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    out = residuals(spark.createDataFrame(rows, "series string, date date, y double"), ["series"], ["y"]).orderBy("date").toPandas()
    months = np.array([i % 12 for i in range(40)])
    design = np.column_stack([np.ones(40), np.arange(40), *[(months == m).astype(float) for m in range(1, 12)]])
    ok = ~np.isnan(y)
    _, rest, _ = st.least_squares(design[ok], y[ok])
    assert np.allclose(out["y"].to_numpy(float)[ok], rest, atol=1e-9) and np.isnan(out["y"].to_numpy(float)[7])
