"""Round trips through files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from hindcast.operators import bundle
from hindcast.sources import changes, readers, sinks


def test_parquet_round_trip_and_run_layout(spark, tmp_path):
    df = spark.createDataFrame([("2001-05-17", 1.0), ("bad", 2.0)], "date string, v double")
    assert sinks.write_parquet(df, f"{tmp_path}/t") == 2
    back = readers.read_monthly(spark, f"{tmp_path}/t", ["date", "v"]).orderBy("v").collect()
    assert str(back[0].date) == "2001-05-01" and back[1].date is None
    with pytest.raises(ValueError):
        readers.read_monthly(spark, f"{tmp_path}/t", ["nope"])
    sinks.write_run(df, f"{tmp_path}/runs", "r1")
    sinks.write_run(df, f"{tmp_path}/runs", "r2")
    assert spark.read.parquet(f"{tmp_path}/runs").where("run_id = 'r2'").count() == 2


def test_observation_json(spark, tmp_path):
    body = {
        "source_name": "s", "provider": "p", "pulled_at_utc": "t",
        "series": {
            "a": {"series_id": "A", "response": {"observations": [{"date": "2000-01-01", "value": "1.5"}, {"date": "2000-02-01", "value": "."}]}},
            "b": {"series_id": "B", "response": {"observations": [{"date": "2000-02-01", "value": "3"}, {"date": "oops", "value": "4"}]}},
        },
    }
    (tmp_path / "raw.json").write_text(json.dumps(body, indent=1))
    long = readers.read_observations(spark, str(tmp_path / "raw.json"))
    wide = {str(r.date): (r.a, r.b) for r in readers.observations_wide(long, ["a", "b"]).collect()}
    assert wide == {"2000-01-01": (1.5, None), "2000-02-01": (None, 3.0)}


def test_csv_and_fallbacks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,v\n2000-01-01,2.5\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "date date, v double").first().v == 2.5
    empty = readers.read_or_empty(spark, f"{tmp_path}/absent", readers.IMPORTANCE_SCHEMA)
    assert empty.count() == 0 and len(empty.columns) == 19
    spark.range(3).write.parquet(f"{tmp_path}/flat")
    assert readers.read_first(spark, [f"{tmp_path}/full", f"{tmp_path}/flat"]).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, [f"{tmp_path}/full"])


def test_union_of_runs_tolerates_missing_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, extra string").write.parquet(f"{tmp_path}/1")
    spark.createDataFrame([(2,)], "id int").write.parquet(f"{tmp_path}/2")
    assert {r.id: r.extra for r in readers.read_union(spark, [f"{tmp_path}/1", f"{tmp_path}/2"]).collect()} == {1: "a", 2: None}


def test_partitioned_dataset_is_pruned(spark, tmp_path):
    rows = [(f"c{i}", ["ridge", "odd name"][i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "config_id string, model_build string, v double").withColumn("model_config_id", F.col("config_id"))
    manifest = {r.value: r for r in sinks.write_by_build(df, f"{tmp_path}/p", "paths").collect()}
    assert manifest["odd name"].path == "paths/model_build=odd_name" and manifest["ridge"].rows == 20
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"model_build=ridge", "model_build=odd_name"}
    ids = df.where("v < 10").select("config_id")
    picked = readers.read_partitions(spark, f"{tmp_path}/p", "model_build", ["ridge"], ids)
    assert picked.count() == 5
    plan = picked._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(model_build" in plan or "model_build IN" in plan or "(model_build" in plan


def test_documents(spark, tmp_path):
    doc = spark.createDataFrame([("e1", None, 3)], "experiment_id string, target string, horizon int")
    sinks.write_document(doc, f"{tmp_path}/d")
    assert sinks.read_document(spark, f"{tmp_path}/d").first().experiment_id == "e1"
    champion = spark.createDataFrame([("y", "m1", 4.5)], "target string, model_config_id string, selection_score double")
    run = sinks.experiment_run({"experiment": doc, "champion": champion}).first()
    assert (run.experiment_id, run.target, run.horizon, run.champion_model_config_id, run.model_count) == ("e1", "y", "3", "m1", None)
    merged = sinks.merge_missing_counts(doc, spark.createDataFrame([("e2", "z", 9)], "experiment_id string, target string, rows int")).first()
    assert (merged.experiment_id, merged.target, merged.rows) == ("e1", "z", 9)
    rows = {r.artifact_name: json.loads(r.payload_json) for r in sinks.document_rows({"champion_selection": champion}).collect()}
    assert rows["champion_selection"]["model_config_id"] == "m1"


def test_csv_sinks(spark, tmp_path):
    board = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(60)], "model_config_id string, selection_score double")
    sinks.write_top_csv(board, f"{tmp_path}/top")
    lines = next((tmp_path / "top").glob("*.csv")).read_text().splitlines()
    assert len(lines) == 26 and lines[1].startswith("c00")


def test_files_runs_and_changes(spark, tmp_path):
    import os

    for run, names, when in (("r1", ["a.json", "b.json"], 100), ("r2", ["a.json"], 200), ("r3", ["a.json", "b.json"], 300)):
        (tmp_path / "in" / run).mkdir(parents=True)
        for name in names:
            path = tmp_path / "in" / run / name
            path.write_text(f"{run}{name}")
            os.utime(path, (when, when))
    files = changes.list_files(spark, f"{tmp_path}/in")
    assert changes.latest_file(files, "/a.json").first().path.endswith("r3/a.json")
    done = [r.run_dir.rsplit("/", 1)[1] for r in changes.complete_runs(files, ["a.json", "b.json"]).orderBy(F.desc("newest")).collect()]
    assert done == ["r3", "r1"]
    current = changes.payloads(spark, f"{tmp_path}/in", "*.json")
    state = changes.next_state(spark.createDataFrame([], "source string, sha256 string"), current)
    stored = spark.createDataFrame(state.collect(), state.schema)
    assert stored.count() == 5 and changes.changed(current, stored).count() == 0
    (tmp_path / "in" / "r1" / "a.json").write_text("new")
    fresh = changes.changed(changes.payloads(spark, f"{tmp_path}/in", "*.json"), stored)
    assert [r.source.rsplit("/", 2)[1] for r in fresh.collect()] == ["r1"]


def test_step_manifest_needs_one_run(spark):
    steps = spark.createDataFrame([("b", "r", 2, "o"), ("a", "r", 1, "o")], "step string, run_id string, rows int, output_uri string")
    row = changes.step_manifest(steps).first()
    assert row.run_id == "r" and [s["step"] for s in json.loads(row.steps_json)] == ["a", "b"]
    mixed = steps.withColumn("run_id", F.col("step"))
    with pytest.raises(Exception, match="different runs"):
        changes.step_manifest(mixed).collect()


def test_task_log_keeps_newest(spark):
    log = spark.createDataFrame([("t", 1, "a"), ("t", 3, "c"), ("t", 2, "b")], "task_id string, completed_at int, s string")
    assert changes.latest_per_task(log).first().s == "c"


def test_mart_override(spark):
    facts = spark.createDataFrame([("a", "a", 1, 2.0)], "config_id string, model_config_id string, as_of_date int, abs_error double")
    measured = spark.createDataFrame(
        [("a", "overall", "naive", 0, 1.0, 1.0, 1.0, "f", "raw")],
        "model_config_id string, evaluation_scope string, model_type string, n_features int, selection_score double, mae double, rmse double, feature_family_name string, mode string",
    )
    spark.range(7).createOrReplaceTempView("source_dashboard_forecast_paths")
    made = sinks.register_mart(spark, {"predictions": facts, "metrics": measured})
    assert "performance_over_time" in made and spark.table("forecast_paths").count() == 7
    assert spark.table("champion_predictions").count() == 1 and "rolling_3mo_mae" in spark.table("performance_over_time").columns
    spark.catalog.dropTempView("source_dashboard_forecast_paths")


def test_bundle_keeps_only_selected(spark):
    board = spark.createDataFrame(
        [(f"c{i}", f"c{i}", "ridge", "linear", float(i), float(i), "f", "raw") for i in range(20)],
        "model_config_id string, config_id string, model_build string, model_family string, mae double, selection_score double, feature_family_name string, mode string",
    )
    champion = board.where("model_config_id = 'c19'")
    reasons = bundle.retention_reasons(board, champion, 0.1, per_build=0)
    tables = bundle.curate({"model_leaderboard": board, "forecast_paths": board.select("model_config_id", "mae")}, reasons)
    assert {r.model_config_id for r in tables["model_leaderboard"].collect()} == {"c0", "c1", "c19"}
    assert tables["model_leaderboard_full"].count() == 20 and tables["overview_top_models"].count() == 3
