"""Distributed order statistics against plain Python, with skewed groups, ties and NULL keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.operators import distribution as ds
from hindcast.operators import panel
from hindcast.plans import fixtures as fx


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many repeated values, some NULL groups and values."""
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"g{rng.randrange(40)}"
        value = 1.0 if rng.random() < 0.3 else None if rng.random() < 0.02 else round(rng.gauss(0, 10), 1)
        rows.append((group, i, value))
    return spark.createDataFrame(rows, "g string, id bigint, v double"), rows


def test_ordinal_equals_sorting(skewed):
    df, rows = skewed
    got = {r.id: r["rank"] for r in ds.ranked(df, ["g"], "v", True, "id").collect()}
    groups = {}
    for g, i, v in rows:
        if v is not None:
            groups.setdefault(g, []).append((v, i))
    expected = {i: n for members in groups.values() for n, (_, i) in enumerate(sorted(members), 1)}
    assert got == expected


def test_global_descending_ordinal(skewed):
    df, rows = skewed
    got = {r.id: r["rank"] for r in ds.ranked(df, [], "v", False, "id").collect()}
    expected = {i: n for n, (_, i) in enumerate(sorted((-v, i) for _, i, v in rows if v is not None), 1)}
    assert got == expected


def test_quantiles_are_exact(skewed):
    df, rows = skewed
    points = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): r.quantile for r in ds.exact_quantiles(df, ["g"], "v", points).collect()}
    groups = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    expected = {(g, p): float(np.quantile(vs, p)) for g, vs in groups.items() for p in points}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


def test_whole_table_quantile(skewed):
    df, rows = skewed
    got = ds.exact_quantiles(df, [], "v", [0.37]).first()
    values = [v for _, _, v in rows if v is not None]
    assert got.quantile == pytest.approx(np.quantile(values, 0.37)) and got.n == len(values)


def test_all_values_equal(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), F.lit(2.5).alias("v"))
    assert ds.exact_quantiles(df, ["g"], "v", [0.5]).first().quantile == 2.5


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, id bigint, v double")
    assert ds.exact_quantiles(df, ["g"], "v", [0.5]).count() == 0
    assert ds.ranked(df, ["g"], "v", True, "id").count() == 0


def test_ranges_follow_the_key(skewed):
    df, _ = skewed
    spans = ds.with_range(df.where("v IS NOT NULL AND g IS NOT NULL"), ["g", "v"]).groupBy("_range").agg(
        F.min(F.struct("g", "v")).alias("low"), F.max(F.struct("g", "v")).alias("high")
    ).orderBy("_range").collect()
    assert len(spans) > 4
    assert all(a.high <= b.low for a, b in zip(spans, spans[1:]))


def test_parts_grow_with_the_lines(spark, monkeypatch):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = "/root/testdata/sf0.001"
    assert fx.predictions(spark, folder).rdd.getNumPartitions() == parts
    monkeypatch.setattr(panel, "ROWS_A_TASK", 500)
    more = fx.predictions(spark, folder).rdd.getNumPartitions()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert more == -(-lines // 500) > parts
