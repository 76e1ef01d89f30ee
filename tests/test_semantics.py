"""Small literal frames for the value semantics that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from hindcast.functions import scalar as sc
from hindcast.operators import backtest as bt
from hindcast.operators import eda, explore, families, features, grid, impute, leaderboard, metrics, panel, policies, quality, reshape


def month(i, year=2000):
    return dt.date(year + i // 12, i % 12 + 1, 1)


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", month(i), v) for i, v in enumerate(values)], f"series string, date date, {name} double")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("date").collect()]


def imputed(spark, values):
    return column(impute.impute(series(spark, values), ["series"], ["x"]))


def test_leading_gap_blocks_trailing_fill(spark):
    filled = imputed(spark, [None, 1.0, 2.0, 4.0, 3.0, 5.0, 6.0, None, None])
    assert filled[0] is None and filled[-2:] == [None, None]


def test_trailing_fill_is_recursive(spark):
    filled = imputed(spark, [1.0, 2.0, 4.0, 3.0, 5.0, 6.0, None, None])
    assert [round(v, 2) for v in filled[-2:]] == [6.70, 7.46]


@pytest.mark.parametrize(
    "history, expected",
    [([3.0], [3.0, 3.0]), ([1.0, 2.0], [3.0, 4.0]), ([1.0, 2.0, 3.0], [4.0, 5.0]), ([2.0, 4.0, 6.0, 8.0], [10.0, 12.0]), ([1.0, 2.0, 3.0, 4.0, 5.0], [6.0, 7.0])],
)
def test_short_histories(spark, history, expected):
    assert imputed(spark, [*history, None, None])[-2:] == pytest.approx(expected)


def test_interior_gap_by_position(spark):
    assert imputed(spark, [1.0, None, None, 4.0]) == pytest.approx([1, 2, 3, 4])
    assert imputed(spark, [None, 2.0, None])[0] is None


def test_imputation_flags_and_log(spark):
    out = impute.impute(series(spark, [1.0, None, 3.0, None]), ["series"], ["x"])
    log = {r.date: r.method for r in impute.imputation_log(out, ["series"], ["x"]).collect()}
    assert log == {month(1): impute.INTERPOLATED, month(3): impute.PROJECTED}


def test_strict_rolling_needs_every_value(spark):
    w = panel.series_window(["series"])
    rolled = series(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]).withColumn("m", features.past_rolling("x", w, 3, "mean"))
    assert column(rolled, "m") == [None, None, None, None, None, None, 5.0]


def test_spine_fills_missing_months(spark):
    raw = spark.createDataFrame([("a", month(0), 1.0), ("a", month(3), 4.0), ("b", month(1), 9.0)], "series string, date date, x double")
    rows = panel.on_spine(raw, ["series"]).collect()
    assert len(rows) == 8 and sum(r.x is None for r in rows) == 5
    assert panel.on_spine(raw, ["series"], bounds="series").count() == 5
    assert [r.date for r in panel.missing_months(raw, ["series"]).orderBy("date").collect()] == [month(1), month(2)]


def test_spine_without_keys(spark):
    raw = series(spark, [1.0, 2.0]).drop("series").where(F.col("date").isNotNull())
    assert panel.on_spine(raw, []).count() == 2


def test_safe_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(sc.safe_ratio("a", "b")).collect()] == [None, None, 2.0]
    assert [r[0] for r in df.select(sc.absolute_percentage_error("b", "a")).collect()] == [None, None, 1.0]


def test_numeric_coercion(spark):
    df = spark.createDataFrame([(".",), ("1.5",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(sc.to_number("s")).collect()] == [None, 1.5, None, None]


def test_parameters(spark):
    df = spark.createDataFrame([('{"b": 2, "a": [64, 32]}',), ("not json",), ("{}",), (None,)], "j string")
    assert [r[0] for r in df.select(sc.params_display("j")).collect()] == ["a=[64, 32], b=2", "not json", "N/A", "N/A"]
    assert [r[0] for r in df.select(sc.params_short("j")).collect()] == ["a=[64, 32], b=2", "params: none", "params: none", "params: none"]
    long = {r.name: r for r in explore.parameter_long(df.withColumn("model_config_id", F.lit("m")), column="j").collect()}
    assert (long["hp_a"].first, long["hp_a"].total, long["hp_a"].largest, long["hp_a"]["items"]) == (64.0, 96.0, 64.0, 2)


def test_short_parameters_order_and_cut(spark):
    df = spark.createDataFrame([('{"zeta": 1, "alpha": 2, "max_depth": 3, "n_estimators": 4, "beta": 5}',)], "j string")
    assert df.select(sc.params_short("j")).first()[0] == "n=4, depth=3, alpha=2, beta=5, ..."


def test_path_safe(spark):
    df = spark.createDataFrame([("a b/c",), ("__",), (None,), ("ok-1",)], "s string")
    assert [r[0] for r in df.select(sc.path_safe("s")).collect()] == ["a_b_c", "unknown", "unknown", "ok-1"]


FACT = (
    "config_id string, as_of_date date, target_date date, actual double, prediction double, seasonal_naive_prediction double, "
    "model_family string, n_features int, train_seconds double, feature_set_id string"
)


def facts(spark, rows, periods=None):
    df = spark.createDataFrame(rows, FACT)
    constant = {
        "model_build": F.lit("ridge"), "model_type": F.lit("ridge"), "ensemble_method": F.lit(""), "mode": F.lit("raw"),
        "feature_family_name": F.lit("f"), "feature_policy": F.lit("none"), "feature_transform": F.lit(None).cast("string"),
    }
    return bt.score_predictions(df.withColumns(constant), periods)


def one(config, values, family="linear", features_=1, key="fs"):
    return [(config, month(i), month(i + 3), a, p, n, family, features_, 0.5, key) for i, (a, p, n) in enumerate(values)]


def test_metrics_follow_each_series(spark):
    """One series always forecast in the right direction and without error, the other always in the wrong one."""
    right = [(float(i), float(i), 0.0) for i in range(6)]
    wrong = [(100.0 + i, 100.0 - i, 0.0) for i in range(6)]
    both = facts(spark, one("c", right)).withColumn("series", F.lit("right")).union(facts(spark, one("c", wrong)).withColumn("series", F.lit("wrong")))
    found = metrics.backtest_metrics(both, series_keys=["series"]).where("evaluation_scope = 'overall'").first()
    assert found.diracc == pytest.approx(0.5) and found.n_predictions == 12
    alone = metrics.backtest_metrics(facts(spark, one("c", wrong))).where("evaluation_scope = 'overall'").first()
    assert found.mae == pytest.approx(alone.mae / 2)
    rolled = metrics.rolling_error(both, series_keys=["series"]).where("series = 'right'").agg(F.max("rolling_3mo_mae")).first()[0]
    assert rolled == 0


def overall(spark, rows):
    out = metrics.backtest_metrics(facts(spark, rows)).where("evaluation_scope = 'overall'").collect()
    return {r.config_id: r for r in out}


def test_metrics_by_hand(spark):
    r = overall(spark, one("m", [(1.0, 2.0, 3.0), (2.0, 2.0, 2.0), (4.0, 3.0, 1.0), (3.0, 1.0, 3.0)]))["m"]
    assert r.mae == pytest.approx(1.0) and r.rmse == pytest.approx(math.sqrt(6 / 4))
    assert r.r2 == pytest.approx(1 - 6 / 5) and r.r2_adjusted == pytest.approx(1 - (6 / 5) * 3 / 2)
    assert r.diracc == pytest.approx(2 / 3)
    assert r.selection_score == pytest.approx(0.75 * 1.0 + 0.25 * math.sqrt(1.5))
    assert r.n_predictions == 4 and r.total_train_seconds == 2.0


def test_metric_edges(spark):
    rows = (
        one("perfect", [(5.0, 5.0, 5.0)] * 3) + one("off", [(5.0, 6.0, 5.0)] * 3) + one("single", [(5.0, 6.0, 5.0)])
        + one("tree", [(1.0, 1.0, 1.0), (2.0, 3.0, 2.0), (4.0, 4.0, 4.0)], family="tree")
        + one("narrow", [(1.0, 1.0, 1.0), (2.0, 3.0, 2.0)], features_=5)
    )
    out = overall(spark, rows)
    assert out["perfect"].r2 == 1.0 and out["off"].r2 == 0.0
    assert out["perfect"].diracc == 1.0
    assert out["single"].r2 is None and out["single"].diracc is None
    assert out["tree"].r2_adjusted is None and out["narrow"].r2_adjusted is None


def test_metrics_keep_precision_far_from_zero(spark):
    base = 1e9
    r = overall(spark, one("m", [(base + 1, base + 1, base), (base + 2, base + 3, base), (base + 4, base + 4, base)]))["m"]
    assert r.r2 == pytest.approx(1 - 1 / (14 / 3), rel=1e-9)


def test_null_keys_left_out_of_metrics_but_kept_in_summaries(spark):
    rows = one("a", [(1.0, 2.0, 3.0)] * 2) + one("b", [(1.0, 2.0, 3.0)] * 2, key=None)
    assert set(overall(spark, rows)) == {"a"}
    board = spark.createDataFrame([(None, "raw", 1.0), ("f", "raw", 2.0)], "feature_family_name string, mode string, mae double")
    assert metrics.family_summary(board).count() == 2


def test_equal_scores_are_ordered_by_configuration(spark):
    rows = one("b", [(1.0, 2.0, 3.0)] * 2) + one("a", [(1.0, 2.0, 3.0)] * 2)
    ranks = metrics.rank_metrics(metrics.backtest_metrics(facts(spark, rows))).where("evaluation_scope = 'overall'").collect()
    assert {r.config_id: r["rank"] for r in ranks} == {"a": 1, "b": 2}


def test_equal_errors_in_another_order_are_equal_scores(spark):
    up, down = ([(0.0, gap, 1.0) for gap in gaps] for gaps in ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1)))
    rows = one("a", up) + one("b", down)
    measured = metrics.backtest_metrics(facts(spark, rows))
    ranks = metrics.rank_metrics(measured).where("evaluation_scope = 'overall'").collect()
    assert {r.config_id: r["rank"] for r in ranks} == {"a": 1, "b": 2} and len({(r.mae, r.rmse) for r in ranks}) == 1


def test_months_added_in_order_keep_every_digit(spark):
    gaps = {"a": [0.1, 0.2, 0.3, 0.7, 0.1], "b": [0.1, 0.7, 0.3, 0.2, 0.1]}
    rows = [row for c, values in gaps.items() for row in one(c, [(0.0, gap, gap / 3) for gap in values])]
    shown = facts(spark, rows[::-1], [("first", None, str(month(5))), ("then", str(month(6)), None)])
    out = {(r.config_id, r.evaluation_scope): r for r in metrics.rank_metrics(metrics.backtest_metrics(shown, in_order=True)).collect()}
    for c, values in gaps.items():
        for scope, part in (("overall", values), ("first", values[:3]), ("then", values[3:])):
            r, total, squares, naive, seconds = out[c, scope], 0.0, 0.0, 0.0, 0.0
            for gap in part:
                total, squares, naive, seconds = total + gap, squares + gap * gap, naive + gap / 3, seconds + 0.5
            assert (r.mae, r.rmse, r.mae_naive, r.total_train_seconds) == (total / len(part), math.sqrt(squares / len(part)), naive / len(part), seconds)
    first, last = sorted(gaps, key=lambda c: (out[c, "overall"].selection_score, c))
    assert out["a", "overall"].mae != out["b", "overall"].mae and (out[first, "overall"]["rank"], out[last, "overall"]["rank"]) == (1, 2)
    with pytest.raises(ValueError):
        metrics.backtest_metrics(shown, series_keys=["feature_set_id"], in_order=True)


def test_champion_prefers_simple_within_two_percent(spark):
    schema = "model_config_id string, evaluation_scope string, model_type string, n_features int, selection_score double, mae double, rmse double"
    rows = [("best", "overall", "xgboost", 9, 100.0, 1.0, 1.0), ("near", "overall", "ridge", 5, 101.9, 1.0, 1.0), ("far", "overall", "naive", 0, 102.1, 1.0, 1.0)]
    chosen = metrics.champion(spark.createDataFrame(rows, schema)).first()
    assert chosen.model_config_id == "near" and chosen.equivalence_threshold == pytest.approx(102.0)


def test_default_periods(spark):
    dates = ["2019-12-01", "2020-03-01", "2021-06-01", "2021-07-01", "2022-12-01", "2023-01-01"]
    df = spark.createDataFrame([(d,) for d in dates], "d string").select(bt.period_label(F.col("d").cast("date")))
    assert [r[0] for r in df.collect()] == ["pre_covid", "covid_shock", "covid_shock", "recovery", "recovery", "recent"]


def test_embargo_changes_training_rows(spark):
    df = series(spark, [1.0] * 12)
    counts = [column(bt.training_rows(df, ["series"], ["x"], e), "n_train")[-1] for e in (0, 2, 3)]
    assert counts == [11, 9, 8]


@pytest.mark.parametrize("refit, step", [(k, s) for k in (1, 3, 5, 6, 12) for s in (1, 2, 3, 4)])
def test_refit_schedule_equals_loop(spark, refit, step):
    months = [i for i in range(36) if i % step == 0]
    last, expected = None, []
    for m in months:
        if last is None or m - last >= refit:
            last = m
        expected.append(month(last))
    df = spark.createDataFrame([("a", month(m)) for m in months], "series string, date date")
    got = [r.fit_date for r in bt.refit_schedule(df, ["series"], refit, step).orderBy("date").collect()]
    assert got == expected


def test_correlation_pruning_is_not_greedy(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    b = [1.3, 1.9, 3.2, 3.7, 5.6, 5.7, 7.5, 7.4]
    c = [2.0, 1.2, 3.9, 2.6, 6.8, 4.7, 8.3, 5.9]
    rows = [("a", month(i), *v, 0.0) for i, v in enumerate(zip(a, b, c))] + [("a", month(8), 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "series string, date date, a double, b double, c double, t double")
    moments = policies.prefix_moments(df, ["series"], ["a", "b", "c", "t"], [], 0, True).where(F.col("date") == F.lit(month(8)))
    r = {(x.a, x.b): x.r for x in policies.correlations(moments, ["series"], ["a", "b", "c", "t"]).collect()}
    low = (r[("a", "c")] + min(r[("a", "b")], r[("b", "c")])) / 2
    assert r[("a", "c")] < low < min(r[("a", "b")], r[("b", "c")])
    kept = policies.pruned_features(policies.selection_masks(moments, ["a", "b", "c"], "corr_pruned", low), ["series"], ["a", "b", "c"], "corr_pruned").first()
    assert kept.selected_features == ["a"] and kept.dropped_features == ["b", "c"]


def test_empty_selection_keeps_first_column(spark):
    rows = [("a", month(i), 1.0, 2.0, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "series string, date date, a double, b double, t double")
    moments = policies.prefix_moments(df, ["series"], ["a", "b", "t"], [], 0, True).where("n > 2")
    kept = policies.pruned_features(policies.selection_masks(moments, ["a", "b"], "variance_pruned"), ["series"], ["a", "b"], "variance_pruned").first()
    assert kept.selected_features == ["a"]


def test_sequences_need_contiguous_months(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).where(F.month("date") != 3)
    assert [r.date for r in features.sequence_samples(df, ["series"], ["x"], 2).orderBy("date").collect()] == [month(1), month(4)]


def test_signatures_and_duplicates(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "model_config_id string, rank bigint")
    rows = [(m, month(i), v) for m, p in {"a": [1.0, 2.0], "b": [1.00001, 2.0], "c": [3.0, 2.0], "d": [4.0, 1.0]}.items() for i, v in enumerate(p)]
    paths = spark.createDataFrame(rows, "model_config_id string, target_date date, prediction double")
    out = {r.model_config_id: (r.path_rank, r.duplicate_count) for r in explore.distinct_paths(ranked, paths, 2).collect()}
    assert out == {"a": (1, 1), "c": (2, 1)}


def test_sensitivity_merges_repeated_edges(spark):
    df = spark.createDataFrame([(0.0, float(i)) for i in range(50)] + [(float(i), 5.0) for i in range(10)], "x double, y double")
    rows = explore.sensitivity(df, "x", "y", True).collect()
    assert sum(r.configurations for r in rows) == 60 and len(rows) < 6


def test_top_rows_and_fraction(spark):
    df = spark.createDataFrame([(f"c{i}", float(i % 5)) for i in range(21)], "model_config_id string, m double")
    assert [r.model_config_id for r in explore.top_rows(df, "m", True, 3).orderBy("rank").collect()] == ["c0", "c10", "c15"]
    assert explore.top_fraction(df, "m", True, 0.1).count() == 3
    assert explore.top_fraction(df, "m", False, 0.001).count() == 1


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert explore.filter_values(df, {"k": "All", "gone": "x"}).count() == 2
    assert explore.filter_values(df, {"k": ["a"], "v": "1"}).count() == 1


def test_model_sizes(spark):
    cases = [
        ("naive", 5.0, "{}", 1.0),
        ("ridge", 7.0, "{}", 7.0),
        ("random_forest", 5.0, '{"n_estimators": 10}', 120.0),
        ("xgboost", 5.0, '{"n_estimators": 10, "max_depth": 3, "colsample_bytree": 0.5}', 15.0),
        ("sarimax", 2.0, '{"order": [1, 1, 2], "seasonal_order": [1, 0, 0, 12]}', 19.0),
        ("mlp", 3.0, '{"sequence_length": 2, "hidden_size": 4}', 2 * 3 * 4 + 4 + 4 + 1),
        ("gru", 3.0, '{"recurrent_hidden_sizes": [4, 2], "dense_head_sizes": [5]}', 3 * (12 + 16 + 4) + 3 * (8 + 4 + 2) + (10 + 5) + 5 + 1),
        ("rnn", 3.0, '{"hidden_size": 4, "num_layers": 2}', (12 + 16 + 4) + (16 + 16 + 4) + 4 + 1),
        ("ridge", None, "broken", 1.0),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "t string, n double, j string")
    got = [r[0] for r in df.select(leaderboard.model_size(F.col("t"), F.col("n"), F.col("j"))).collect()]
    assert got == pytest.approx([c[3] for c in cases])


def test_ratio_columns_cover_all_recipes():
    present = [f"{p}_{m}" for p in ("pre_covid", "covid_shock", "recovery", "recent") for m in leaderboard.RATIO_METRICS.values()]
    assert len(leaderboard.ratio_columns(present)) == 15


def test_grid_falls_back_and_removes_duplicates(spark):
    fams = spark.createDataFrame([("f",)], "feature_family_name string")
    models = [("naive", {}), ("ridge", {"alpha": 1.0}), ("xgboost", {"max_depth": 3})]
    out = grid.expand_grid(fams, models, ["raw"], ["none", "corr_pruned", "tree_top_20", "variance_pruned"], ["identity", "cubic"])
    ids = {r.config_id for r in out.collect()}
    assert ids == {
        "naive__raw__baseline_naive",
        "ridge__raw__f__alpha-1.0", "ridge__raw__f__policy-corr_pruned__alpha-1.0", "ridge__raw__f__policy-variance_pruned__alpha-1.0",
        "ridge__raw__f__transform-cubic__alpha-1.0", "ridge__raw__f__policy-corr_pruned__transform-cubic__alpha-1.0",
        "ridge__raw__f__policy-variance_pruned__transform-cubic__alpha-1.0",
        "xgboost__raw__f__max_depth-3", "xgboost__raw__f__policy-tree_top_20__max_depth-3", "xgboost__raw__f__policy-variance_pruned__max_depth-3",
    }


def test_families_compose_without_repeats():
    groups = families.base_groups("y", 3, ["p", "q"], ["i", "j"], ["s"], ["inc", "inc12", "yoy", "two"], ["pr"], ["r1", "r2"], ["r1", "r2"])
    made = families.compose_families(groups)
    assert len(made) == 21 and all(len(set(v)) == len(v) for v in made.values())
    assert made["history_only"][:2] == ["y_lag1", "y_lag2"] and len(made["history_only"]) == 11
    assert set(made["history_regime_time"]) - set(made["history_regime"]) == {"time_index_months"}
    assert "y_lag1_x_r1" in made["history_regime_linear_interactions"]
    assert families.available(made, "history_only", ["y_lag2", "month_sin"]) == ["y_lag2", "month_sin"]
    with pytest.raises(KeyError):
        families.available(made, "nope", [])


def test_default_feature_table(spark):
    df = spark.createDataFrame([(dt.date(2018 + i // 12, i % 12 + 1, 1), float(i)) for i in range(48)], "date date, y double")
    out = features.build_features(df, [], "y", 3, interaction_bases=["y_lag1"])
    row = out.where(F.col("date") == F.lit("2021-04-01").cast("date")).first()
    assert (row.pandemic_observed, row.pandemic_disruption_active, row.post_pandemic_observed, row.months_since_pandemic_observed) == (1, 0, 1, 13)
    assert row.is_post_covid == 1 and row.y_lag1_x_post_pandemic_observed == row.y_lag1 and row.y_target_h3 == row.y + 3


def test_transform_names():
    assert features.transformed_names(["a", "b"], "cubic") == ["a", "b", "a__pow2", "b__pow2", "a__pow3", "b__pow3"]
    with pytest.raises(ValueError):
        features.transformed_names(["a"], "sqrt")


def test_one_row_check_and_headers(spark):
    df = spark.createDataFrame([(" x ", 1.0, 2.0)], "`k` string, `1/2002` double, `12/2002` double")
    assert reshape.month_headers(df) == ["1/2002", "12/2002"]
    assert reshape.exactly_one(reshape.filter_trimmed_equal(df, {"k": "x"})).count() == 1
    with pytest.raises(ValueError):
        reshape.exactly_one(df.limit(0))
    assert [r.date for r in reshape.wide_to_long(df, ["k"], "v").orderBy("date").collect()] == [dt.date(2002, 1, 1), dt.date(2002, 12, 1)]


def test_single_observation_month_has_zero_deviation(spark):
    weekly = spark.createDataFrame([(dt.date(2000, 1, 3), 1.0), (dt.date(2000, 2, 7), 2.0), (dt.date(2000, 2, 14), 4.0)], "date date, p double")
    rows = {r.date: r for r in reshape.weekly_to_monthly(weekly, [], "p", "p").collect()}
    assert rows[month(0)].p_std == 0.0 and rows[month(1)].p_std == pytest.approx(math.sqrt(2))


def test_quality_failures(spark):
    bad = spark.createDataFrame([("a", month(0)), ("a", month(0)), ("a", None)], "series string, date date")
    assert {r.violation for r in quality.date_violations(bad, ["series"]).collect()} == {"null date", "duplicate date"}
    with pytest.raises(quality.QualityError):
        quality.must_be_empty(quality.date_violations(bad, ["series"]), "dates")
    with pytest.raises(quality.QualityError):
        quality.feature_table_violations(bad, ["series"], "y", 3)
    assert quality.artifact_violations({"a": bad}, {"a": ["series", "x"], "b": []}) == ["a: missing columns ['x']", "b: missing"]
    assert quality.family_violations({"f": ["x"]}, ["f", "g"], []) == ["unknown family g", "f: unavailable columns ['x']"]


def test_skew_is_bias_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 3, 9)], "x double")
    n, xs = 5, [1, 2, 2, 3, 9]
    mean = sum(xs) / n
    m2, m3 = sum((x - mean) ** 2 for x in xs) / n, sum((x - mean) ** 3 for x in xs) / n
    assert df.select(eda.sample_skew("x")).first()[0] == pytest.approx(m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2))


def test_constant_series_has_no_correlation(spark):
    df = series(spark, [1.0] * 5).withColumn("y", F.month("date").cast("double"))
    assert eda.pearson_pairs(df, ["series"], ["x", "y"]).first().pearson is None
    assert eda.spearman_pairs(df, ["series"], ["x", "y"]).first().spearman is None


def test_run_rows_carry_json(spark):
    df = facts(spark, one("m", [(1.0, 2.0, 3.0)])).withColumn("feature_transform", F.lit("cubic"))
    runs = bt.model_runs(df, F.lit('{"alpha": 1.0}'), F.array(F.lit("a"), F.lit('b"')), F.array().cast("array<string>"), F.lit("{}"), 3).first()
    assert runs.selected_feature_names_json == '["a", "b\\""]' and runs.dropped_feature_names_json == "[]"
    assert runs.representation_policy == "tabular_cubic" and runs.refit_frequency_months == 3


def test_validity_predicates(spark):
    df = spark.createDataFrame([(0, "c"), (1, "c"), (1, "n")], "d int, trend string")
    assert df.where(grid.valid_trend(F.col("d"), F.col("trend"))).count() == 2
    variants = spark.createDataFrame([("v", 5, None, 10), ("w", 50, None, 10), ("z", 5, 6, None)], "v string, width int, low int, high int")
    assert [r.v for r in grid.width_bounded(variants, "width", "low", "high").collect()] == ["v"]


def test_regime_metadata_knows_its_date(spark):
    df = spark.createDataFrame([(["y_lag1", "y_lag1_x_pandemic_disruption_active"], dt.date(2020, 3, 1)), (["y_lag1"], dt.date(2021, 1, 1)), (["is_post_covid"], dt.date(2020, 2, 1))], "f array<string>, as_of date")
    rows = df.select(*[c.alias(n) for n, c in families.regime_metadata(F.col("f"), F.col("as_of")).items()]).collect()
    assert [r.regime_policy for r in rows] == ["pandemic_observed", "none", "pandemic_observed"]
    assert [r.regime_features_available_as_of for r in rows] == [True, False, False]
    assert rows[0].regime_feature_names_json == '["y_lag1_x_pandemic_disruption_active"]'


def test_top_per_group_limits_before_the_exchange(spark):
    df = spark.createDataFrame([("hot", str(i), float(i)) for i in range(100)], "model_build string, model_config_id string, m double")
    plan = explore.top_per_group(df, ["model_build"], "m", True, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
