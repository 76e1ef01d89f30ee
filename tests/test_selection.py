"""Lasso paths against optimality and coordinate descent, neighbour information against pairwise counting."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import experiment as ex
from hindcast.operators import policies as pol
from hindcast.operators import selection as sel
from hindcast.operators.models import solve_batch, solve_each

EULER = 0.5772156649015329


def problem(seed, n, p, close=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p)) @ (np.eye(p) + (0.9 if close else 0.3) * np.triu(np.ones((p, p)), 1))
    y = x @ (rng.standard_normal(p) * (rng.random(p) < 0.5)) + rng.standard_normal(n)
    z = (x - x.mean(0)) / x.std(0)
    return z.T @ z, z.T @ (y - y.mean()), float(n)


@pytest.mark.parametrize("seed", range(6))
def test_every_knot_is_optimal(seed):
    gram, cross, n = problem(seed, 60, 9, close=seed % 2 == 1)
    path = sel.lasso_path(gram, cross, n, np.ones(9, bool))
    penalties = [knot[0] for knot in path]
    assert penalties == sorted(penalties, reverse=True) and penalties[-1] == 0.0
    for penalty in [*penalties, *np.linspace(0, penalties[0] * 1.2, 7)]:
        w = sel.weights_at(path, penalty)
        rest = (cross - gram @ w) / n
        assert np.all(np.abs(rest) <= penalty + 1e-9)
        assert np.allclose(rest[np.abs(w) > 1e-12], penalty * np.sign(w[np.abs(w) > 1e-12]), atol=1e-9)
    assert np.allclose(sel.weights_at(path, 0.0), np.linalg.solve(gram, cross))


def test_columns_leave_and_the_path_agrees_with_coordinate_descent():
    left = 0
    for seed in range(20):
        gram, cross, n = problem(seed, 40, 8, close=True)
        path = sel.lasso_path(gram, cross, n, np.ones(8, bool))
        left += sum(-9 < knot[2] < 0 for knot in path)
        for penalty in (0.5, 0.05):
            weight, settled = solve_batch(gram[None], cross[None], np.array([n]), np.ones((1, 8), bool), "lasso", penalty, 1.0)
            assert settled and np.allclose(sel.weights_at(path, penalty), weight[0], atol=1e-6)
    assert left > 0


def test_constant_and_repeated_columns():
    gram, cross, n = problem(3, 50, 3)
    twice = np.ix_([0, 1, 2, 0, 1], [0, 1, 2, 0, 1])
    varied = np.array([True, True, True, True, False])
    path = sel.lasso_path(gram[twice], cross[[0, 1, 2, 0, 1]], n, varied)
    last = path[-1][1]
    assert last[4] == 0 and min(abs(last[0]), abs(last[3])) == 0
    assert np.allclose([last[0] + last[3], last[1], last[2]], np.linalg.solve(gram, cross))
    assert sel.lasso_path(gram, cross * 0, n, np.ones(3, bool))[-1][0] == 0
    assert len(sel.lasso_path(gram, cross, n, np.ones(3, bool), 1e9)) == 1


def test_a_path_of_moments_has_its_events(spark):
    rng = np.random.default_rng(2)
    rows = [(1, dt.date(2000 + k // 12, k % 12 + 1, 1), *map(float, rng.standard_normal(4))) for k in range(40)]
    panel = spark.createDataFrame(rows, "series int, date date, a double, b double, y double, flat double").withColumn("flat", F.lit(1.0))
    moments = pol.prefix_moments(panel, ["series"], ["a", "b", "y", "flat"], [], 3, one_row_per_month=True)
    paths = sel.lasso_paths(moments, ["series"], ["a", "b"], ["y", "flat"]).toPandas()
    assert set(paths["mode"]) == {"y"} and paths.date.min() > dt.date(2000, 3, 1)
    whole = paths[paths.date == dt.date(2003, 4, 1)].sort_values("step")
    assert list(whole.step) == [0, 1, 2] and set(whole.feature[:2]) == {"a", "b"} and whole.feature.iloc[2] is None
    none = sel.lasso_paths(moments.limit(0), ["series"], ["a", "b"], ["y", "flat"])
    assert none.count() == 0


def plain_score(x, y, k):
    """By the definition, one row after another."""
    def digamma(m):
        return -EULER + sum(1.0 / i for i in range(1, m))

    n, total = len(x), 0.0
    spread = [v.std() or 1.0 for v in (x, y)]
    for i in range(n):
        gaps = [[abs(v[i] - v[j]) / s for j in range(n)] for v, s in zip((x, y), spread)]
        radius = sorted(max(gaps[0][j], gaps[1][j]) for j in range(n) if j != i)[k - 1]
        within = [sum(gap < radius or gap == 0 for gap in one) for one in gaps]
        total += sum(digamma(m) for m in within)
    return max(digamma(n) + digamma(k) - total / n, 0.0)


@pytest.mark.parametrize("kind", ["independent", "line", "ties", "constant"])
def test_neighbour_scores_follow_the_definition(kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(90)
    y = {"independent": rng.standard_normal(90), "line": 2 * x + 0.1 * rng.standard_normal(90), "ties": np.round(x + rng.standard_normal(90)), "constant": np.ones(90)}[kind]
    x = np.round(x, 1) if kind == "ties" else x
    ends = np.array([0, 3, 4, 50, 90])
    got = sel.neighbour_scores(x, y, ends, 3)
    assert np.isnan(got[:2]).all()
    assert got[2:] == pytest.approx([plain_score(x[:n], y[:n], 3) for n in ends[2:]], abs=1e-10)
    if kind == "line":
        assert got[-1] > 1.0


def test_two_thousand_rows():
    rng = np.random.default_rng(8)
    x = rng.standard_normal(2000)
    y = 0.8 * x + 0.6 * rng.standard_normal(2000)
    got = sel.neighbour_scores(x, y, np.array([2000]), 3)[0]
    assert got == pytest.approx(plain_score(x, y, 3), abs=1e-9)
    assert got == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.08), "the closed form of two normal variables"


def test_neighbour_information_needs_series_and_skips_unknown_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(s, dt.date(2000 + k // 12, k % 12 + 1, 1), float(rng.standard_normal()), None if k % 5 == s else float(rng.standard_normal()), float(rng.standard_normal())) for s in range(2) for k in range(30)]
    panel = spark.createDataFrame(rows, "series int, date date, a double, b double, y double")
    got = sel.neighbour_information(panel, ["series"], ["a", "b"], "y", F.col("date") >= "2001-01-01", 3).toPandas()
    frame = panel.toPandas()
    for r in got.itertuples():
        known = frame[(frame.series == r.series) & (frame.date < (dt.date(r.date.year - (r.date.month <= 3), (r.date.month - 4) % 12 + 1, 1)))].dropna()
        assert r.n == len(known) and r.score == pytest.approx(plain_score(known[r.feature].to_numpy(), known.y.to_numpy(), 3), abs=1e-10)
    assert len(got) == 2 * 2 * 18
    assert sel.neighbour_information(panel.limit(0), ["series"], ["a"], "y", F.lit(True), 3).count() == 0
    with pytest.raises(ValueError):
        sel.neighbour_information(panel, [], ["a"], "y", F.lit(True), 3)


def test_the_policy_in_a_run(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(3):
        for k in range(60):
            noise, a = rng.standard_normal(2)
            rows.append((s, dt.date(2000 + k // 12, k % 12 + 1, 1), float(noise), float(a), float(np.sin(3 * a)), 0.0))
    panel = spark.createDataFrame(rows, "series int, date date, noise double, a double, target double, baseline double")
    evaluated = F.col("date") >= "2003-01-01"

    def go(model_keys, models):
        return ex.run_experiment(panel, ["series"], {"all": ["noise", "a"]}, models, ["raw", "residual"], ["none", "mutual_info_top_1"], ["identity"], "target", "baseline", evaluated, F.trunc("date", "quarter"), 3, 3, 3, 10, model_keys)

    out = go(["series"], [("naive", {}), ("ridge", {"alpha": 1.0}), ("extra_trees", {"n_estimators": 5, "max_depth": 3})])
    runs = out.runs.toPandas()
    chosen = runs[runs.feature_policy == "mutual_info_top_1"]
    assert set(chosen.model_type) == {"ridge", "extra_trees"} and set(chosen.selected_feature_names_json) == {'["a"]'}
    with pytest.raises(Exception, match="one model per series"):
        go([], [("ridge", {"alpha": 1.0})]).predictions.count()


@pytest.mark.parametrize("sweeps", [4, 10_000])
@pytest.mark.parametrize("kind", ["lasso", "elastic_net", "ridge"])
def test_fits_solved_together_equal_each_alone(kind, sweeps):
    """Weights and ends are those of every problem alone, to the last bit; with few sweeps some have not settled."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 40, 4)) * [1.0, 1.0, 1.0, 0.3]
    x[:, :, 3] += x[:, :, 0] * np.linspace(0.0, 1.0, 30)[:, None]
    x = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    gram, cross = np.einsum("bri,brj->bij", x, x), np.einsum("bri,br->bi", x, 3 * x[:, :, 0] + rng.standard_normal((30, 40)))
    n, mask = np.full(30, 40.0), rng.random((30, 4)) > 0.2
    weight, settled = solve_each(gram, cross, n, mask, kind, 0.1, 0.5, sweeps)
    alone = [solve_batch(gram[i : i + 1], cross[i : i + 1], n[i : i + 1], mask[i : i + 1], kind, 0.1, 0.5, sweeps) for i in range(30)]
    assert np.array_equal(weight, np.concatenate([w for w, _ in alone])) and settled.tolist() == [c for _, c in alone]
    assert settled.all() if sweeps > 4 or kind == "ridge" else not settled.all()
