"""A run of a grid against plain fits, many columns, null patterns, and pooled against separate models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hindcast.operators import experiment as ex

MONTHS = 60
FAMILIES = {"short": ["a"], "wide": ["a", "b", "c"]}
MODELS = [("naive", {}), ("ridge", {"alpha": 2.0}), ("lasso", {"alpha": 0.05}), ("elastic_net", {"alpha": 0.05, "l1_ratio": 0.5})]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(6)
    rows = []
    for s in range(4):
        for k in range(MONTHS):
            a, b = rng.standard_normal(2)
            c = a * 1.5 + rng.standard_normal() * (0.2 if s == 0 else 1.0)  # too close to a in one series
            rows.append((s, dt.date(2000 + k // 12, k % 12 + 1, 1), a, None if k % 7 == s else b, c, 3 * a - (b if b else 0) + s * 1000 + rng.standard_normal(), s * 1000.0 + rng.standard_normal()))
    rows.append((77, dt.date(2004, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0))
    return pd.DataFrame(rows, columns=["series", "date", "a", "b", "c", "target", "baseline"])


def run(spark, frame, model_keys, families=FAMILIES, models=MODELS, policies=("none", "corr_pruned", "lasso_selected"), transforms=("identity", "quadratic"), min_train=10):
    panel = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "series int, date date, " + ", ".join(f"{c} double" for c in frame.columns[2:])).repartition(6)
    evaluated = (F.col("date") >= "2003-01-01") & F.col("target").isNotNull()
    return ex.run_experiment(panel, ["series"], families, models, ["raw", "residual"], list(policies), list(transforms), "target", "baseline", evaluated, F.trunc("date", "quarter"), 3, 3, 3, min_train, model_keys)


def plain(frame, row, pooled):
    """Forecast of one row by a ridge fitted on its snapshot, and how many rows and columns that used."""
    cols = FAMILIES[row.feature_family_name]
    cut = (pd.Timestamp(row.fit_date) - pd.DateOffset(months=3)).date()
    data = frame[(frame.date < cut) & (pooled or frame.series == row.series)].dropna(subset=[*cols, "target", "baseline"])
    kept = list(cols)
    if row.feature_policy == "corr_pruned":
        r = np.abs(np.corrcoef(data[cols].to_numpy(float).T)) if len(cols) > 1 else np.ones((1, 1))
        kept = [c for j, c in enumerate(cols) if not (r[j, :j] > 0.95).any()]
    wide = lambda d: np.column_stack([d[kept].to_numpy(float)] + ([d[kept].to_numpy(float) ** 2] if row.feature_transform == "quadratic" else []))
    x, now = wide(data), wide(frame[(frame.series == row.series) & (frame.date == row.as_of_date)])
    y = (data.target - (data.baseline if row["mode"] == "residual" else 0)).to_numpy()
    mean, spread = x.mean(0), x.std(0)
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + 2.0 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    value = y.mean() + ((now - mean) / spread) @ w + (row.seasonal_naive_prediction if row["mode"] == "residual" else 0)
    return float(value[0]), len(data), x.shape[1]


@pytest.mark.parametrize("model_keys", [["series"], []])
def test_every_ridge_equals_a_plain_fit(spark, frame, model_keys):
    out = run(spark, frame, model_keys)
    facts = out.predictions.toPandas()
    assert len(facts) == facts[["config_id", "series", "as_of_date"]].drop_duplicates().shape[0]
    ridge = facts[(facts.model_type == "ridge") & (facts.feature_policy != "lasso_selected")]
    assert len(ridge) > 500 and ridge.feature_policy.nunique() == 2
    for _, row in ridge.sample(150, random_state=1).iterrows():
        value, n, width = plain(frame, row, not model_keys)
        assert (row.n_train, row.n_features) == (n, width)
        assert row.prediction == pytest.approx(value, rel=1e-7)
    if model_keys:
        assert set(ridge[(ridge.feature_policy == "corr_pruned") & (ridge.feature_family_name == "wide") & (ridge.feature_transform == "identity")].groupby("series").n_features.max()) == {2, 3}
        assert 77 not in set(facts[facts.model_type != "naive"].series), "one row is no snapshot"
    wide = facts[(facts.feature_family_name == "wide")]
    missing = frame[frame.b.isna()].set_index(["series", "date"]).index
    assert not set(zip(wide.series, wide.as_of_date)) & set(missing), "rows without a column are not forecast"


def test_tables_of_a_run_agree(spark, frame):
    out = run(spark, frame, ["series"])
    facts, runs, metrics = out.predictions.toPandas(), out.runs.toPandas(), out.metrics.toPandas()
    assert len(runs) == len(facts) and set(runs.status) == {"succeeded"} and runs.converged.all()
    assert set(facts.config_id) <= {r.config_id for r in out.grid.collect()}
    assert {r.feature_set_id for r in out.feature_sets.collect()} >= set(facts.feature_set_id) - {"baseline_naive"}
    overall = metrics[metrics.evaluation_scope == "overall"].set_index("config_id")
    assert np.allclose(overall.mae, facts.groupby("config_id").abs_error.mean()[overall.index])
    assert out.champion.collect()[0].config_id in set(overall.index)
    weights = out.importances.toPandas()
    assert (weights[weights["rank"] == 1].importance_abs.to_numpy() >= 0).all()
    kept = runs[runs.feature_policy == "lasso_selected"].selected_feature_names_json
    assert kept.str.contains('"a"').all(), "a penalty of ten leaves the first column"


def test_a_hundred_and_sixty_five_columns(spark):
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(165)]
    rows = [(s, dt.date(2000 + k // 12, k % 12 + 1, 1), *rng.standard_normal(165).tolist()) for s in range(12) for k in range(48)]
    frame = pd.DataFrame(rows, columns=["series", "date", *names])
    frame["target"] = frame.f0 * 2 - frame.f164 + rng.standard_normal(len(frame))
    frame["baseline"] = rng.standard_normal(len(frame))
    out = run(spark, frame, [], {"all": names}, [("ridge", {"alpha": 2.0})], ("none",), ("identity",))
    facts = out.predictions.toPandas()
    assert len(facts) == 12 * 12 * 2 and set(facts.n_features) == {165}
    for _, row in facts.sample(10, random_state=2).iterrows():
        FAMILIES["all"] = names
        try:
            value, n, _ = plain(frame, row, True)
        finally:
            del FAMILIES["all"]
        assert row.n_train == n and row.prediction == pytest.approx(value, rel=1e-7)


def test_trees_and_policies_of_a_grid(spark, frame):
    models = [("ridge", {"alpha": 1.0}), ("random_forest", {"n_estimators": 5, "max_depth": 2}), ("xgboost", {"n_estimators": 5, "max_depth": 2})]
    out = run(spark, frame, ["series"], models=models, policies=("none", "corr_pruned", "tree_top_1", "variance_pruned"), transforms=("identity",))
    facts = out.predictions.toPandas()
    assert set(facts[facts.model_type == "ridge"].feature_policy) == {"none", "corr_pruned", "variance_pruned"}
    assert set(facts[facts.model_type == "xgboost"].feature_policy) == {"none", "tree_top_1", "variance_pruned"}
    assert set(facts[facts.feature_policy == "tree_top_1"].n_features) == {1}
    for kind in ("random_forest", "xgboost"):
        same = facts[(facts.model_type == kind) & (facts.feature_family_name == "short") & (facts["mode"] == "raw")].pivot(index=["series", "as_of_date"], columns="feature_policy", values="prediction")
        assert np.allclose(same["none"], same["tree_top_1"]), "one column is the best of one"


def test_unknown_columns_and_models_are_refused(spark, frame):
    with pytest.raises(ValueError, match="columns"):
        run(spark, frame, [], {"odd": ["nothing"]})
    with pytest.raises(ValueError, match="without a learner"):
        run(spark, frame, [], models=[("lstm", {})])


def test_snapshots_solved_together_equal_each_alone():
    families = {"all": ["a", "b"], "one": ["a"]}
    config = {"feature_transform": "identity", "mode": "raw", "params": {"alpha": 2.0}}
    plan = ex.Plan(families, [{**config, "model_type": m, "feature_family_name": f, "feature_policy": p} for m in ("ridge", "lasso") for f in families for p in ("none", "variance_pruned")], 10)
    rng = np.random.default_rng(5)
    snapshots = []
    for rows in (30, 4, 50):  # the second one has too few rows
        z = np.concatenate([np.ones((rows, 1)), rng.standard_normal((rows, 4))], axis=1)
        snapshots.append({"11": (z.T @ z)[plan.upper]})
    shift = np.zeros(4)
    together = list(ex.solve_snapshots(plan, snapshots, shift))
    assert {place for place, _ in together} == {0, 2} and len(together) == 16
    for place in (0, 2):
        alone = {fit["config"]: fit for _, fit in ex.solve_snapshots(plan, [snapshots[place]], shift)}
        for fit in (f for p, f in together if p == place):
            assert np.allclose(fit["coef"], alone[fit["config"]]["coef"]) and fit["n_train"] == alone[fit["config"]]["n_train"]
