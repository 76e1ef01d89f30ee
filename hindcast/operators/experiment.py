"""One run of an experiment: grid, training snapshots, selection, fits and facts.

All linear configurations share one pass over the panel. Every column that any family or transform needs is
part of one vector; the sums of products of a snapshot form one matrix, of which each configuration takes its
rows and columns. Rows that only some families can use are told apart by a pattern of usable families,
so that the matrix of a family is the sum over the patterns that hold it.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.constants import CORR_PRUNE_THRESHOLD, LASSO_SELECTOR_ALPHA, VARIANCE_PRUNE_THRESHOLD
from hindcast.functions.calendar import month_number, shift_months
from hindcast.functions.ids import feature_set_id, json_string_list
from hindcast.functions.scalar import finite_or_zero, signed_log1p
from hindcast.operators import families as fam
from hindcast.operators import metrics as mt
from hindcast.operators.backtest import model_runs, score_predictions, with_mode
from hindcast.operators.features import TRANSFORM_PARTS, transformed_names
from hindcast.operators.grid import BASELINE_FAMILY, LINEAR, TREE, expand_grid
from hindcast.operators.models import MAX_ITER, solve_each
from hindcast.operators.panel import whole_series
from hindcast.operators.reshape import with_taxonomy
from hindcast.operators.selection import INFORMATION, information_mask, lasso_path, weights_at
from hindcast.operators.trees import tree_fits
from hindcast.session import materialize

#: Numbers of a packed matrix that travel in one row.
TILE = 4096
#: Packed numbers a task holds before it hands on what it has added up.
HELD = 16_000_000
#: Numbers of the matrices of series that a task solves together, and rows of series that it reads together.
SOLVED, TOGETHER = 2_000_000, 4_096
PARTS = {"log_signed": signed_log1p, "pow2": lambda c: F.pow(F.col(c), F.lit(2.0)), "pow3": lambda c: F.pow(F.col(c), F.lit(3.0))}


@dataclass
class Plan:
    """What tasks need to know of a grid: columns, families and configurations as plain values."""

    families: dict[str, list[str]]
    configs: list[dict]
    min_train: int
    columns: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        wanted: dict[str, None] = {}
        for c in self.configs:
            if c["model_type"] in LINEAR:
                wanted |= dict.fromkeys(transformed_names(self.families[c["feature_family_name"]], c["feature_transform"]))
        self.columns = list(wanted)
        self.place = {c: i for i, c in enumerate(self.columns)}
        self.names = list(self.families)
        #: Augmented by a leading one and followed by the raw and the residual target.
        self.size = len(self.columns) + 3
        self.upper = np.triu_indices(self.size)

    def vector(self) -> Column:
        made = []
        for name in self.columns:
            base, _, part = name.rpartition("__")
            made.append(finite_or_zero(PARTS[part](base)) if base and part in PARTS else finite_or_zero(F.col(name).cast("double")))
        return F.array(*made).cast("array<double>")

    def complete(self) -> Column:
        """Per family, whether a row has all of its columns."""
        return F.array(*[F.forall(F.array(*[F.col(c).isNotNull() for c in self.families[n]]), lambda v: v) for n in self.names])


def read_grid(grid: DataFrame) -> list[dict]:
    """Configurations as plain values, by identifier. A grid is declared, so its size is the caller's choice."""
    numbers = lambda v: json.loads(v) if v.replace(".", "", 1).replace("-", "").replace("e", "").isdigit() or v in ("true", "false") else {"True": True, "False": False}.get(v, v)
    rows = [r.asDict() for r in grid.orderBy("config_id").collect()]
    return [{**r, "params": {k: numbers(v) for k, v in sorted(r["params"].items())}} for r in rows]


# --- sums of products of every snapshot --------------------------------------------------------------


def _marked(panel: DataFrame, plan: Plan, model_keys: list[str], target: str, baseline: str) -> DataFrame:
    """Rows that some family can be trained on: keys, month, pattern and the shifted vector with both targets."""
    known = F.col(target).isNotNull() & F.col(baseline).isNotNull()
    y = F.col(target).cast("double")
    vector = F.concat(plan.vector(), F.array(y, y - F.col(baseline).cast("double")))
    pattern = F.array_join(F.transform(plan.complete(), lambda v: F.when(v, "1").otherwise("0")), "")
    rows = panel.where(known).select(*model_keys, month_number("date").cast("long").alias("_month"), pattern.alias("_pattern"), vector.alias("_z"))
    return rows.where(F.col("_pattern").contains("1"))


def _shift(rows: DataFrame, size: int) -> np.ndarray:
    """The mean of every column: subtracting it changes no statistic and keeps the sums accurate."""
    found = rows.agg(F.array(*[F.avg(F.get("_z", F.lit(i))) for i in range(size)]).alias("m")).first()
    return np.array([v or 0.0 for v in found.m])


def _matrix(batch: pa.RecordBatch | pa.Table, shift: np.ndarray) -> np.ndarray:
    """Rows of a leading one and the shifted columns."""
    column = batch.column(batch.schema.get_field_index("_z"))
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    z = flat.to_numpy(zero_copy_only=False).reshape(-1, len(shift)) - shift
    return np.concatenate([np.ones((len(z), 1)), z], axis=1)


def pooled_moments(rows: DataFrame, plan: Plan, keys: list[str], shift: np.ndarray, fit_months: list[int], embargo: int) -> DataFrame:
    """Packed matrices before each fit month, in tiles: keys, month, _pattern, tile, values.

    Tasks add up whole months first, so that one small row a (month, pattern, tile) leaves them. Those are
    exchanged by key and tile and read in order of months, so that a running sum is all a task holds.
    """
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]
    fields = ", ".join([*key_fields, "_pattern string, tile int, _month long, values array<double>"])
    by = [*keys, "_pattern", "_month"]
    tiles = -(-len(plan.upper[0]) // TILE)

    def frame(records: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(records, columns=[*keys, "_pattern", "tile", "_month", "values"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds = None

        def out() -> pa.RecordBatch:
            records = []
            for key, packed in held.items():
                records += [(*key[:-1], t, key[-1], packed[t * TILE : (t + 1) * TILE]) for t in range(tiles)]
            held.clear()
            return pa.RecordBatch.from_pandas(frame(records), kinds, preserve_index=False)

        for batch in batches:
            kinds = kinds or pa.schema([*[batch.schema.field(k) for k in keys], ("_pattern", pa.string()), ("tile", pa.int32()), ("_month", pa.int64()), ("values", pa.list_(pa.float64()))])
            z = _matrix(batch, shift)
            groups = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False).indices
            for key, at in groups.items():
                a = z[at]
                packed = (a.T @ a)[plan.upper]
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held[key] + packed if key in held else packed
            if len(held) * len(plan.upper[0]) > HELD:
                yield out()
        if held:
            yield out()

    partial = rows.mapInArrow(add_up, fields)
    spread = partial.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_pattern", "tile")
    ordered = spread.sortWithinPartitions(*keys, "_pattern", "tile", "_month")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, total, asked = None, None, iter(())
        wanted = None

        def reach(month: int | None, records: list[tuple]) -> None:
            # Fit months whose last training month lies before ``month`` have seen all they may.
            nonlocal wanted
            while wanted is not None and (month is None or wanted - 1 - embargo < month):
                if total is not None:
                    records.append((*owner, wanted, total))
                wanted = next(asked, None)

        for batch in batches:
            records: list[tuple] = []
            data = batch.to_pandas()
            for row in data.itertuples(index=False):
                key = tuple(row[: len(keys) + 2])
                if key != owner:
                    reach(None, records)
                    owner, total, asked = key, None, iter(fit_months)
                    wanted = next(asked, None)
                reach(row[-2], records)
                total = row[-1].copy() if total is None else total + row[-1]
            if records:
                yield pa.RecordBatch.from_pandas(frame(records), batch.schema, preserve_index=False)
            last = batch.schema
        records = []
        if owner is not None:
            reach(None, records)
        if records:
            yield pa.RecordBatch.from_pandas(frame(records), last, preserve_index=False)

    return ordered.mapInArrow(run, fields)


# --- fits -------------------------------------------------------------------------------------------


def policy_mask(policy: str, gram: np.ndarray, cross: np.ndarray, n: float, variance: np.ndarray, varied: np.ndarray) -> np.ndarray:
    """Which base columns a policy keeps; the first one stays if none would.

    ``gram`` and ``cross`` are standardised: sums of products of the columns and with the mode's target.
    """
    size = len(variance)
    if policy == "variance_pruned":
        keep = variance * n / max(n - 1, 1) > VARIANCE_PRUNE_THRESHOLD
    elif policy == "corr_pruned":
        close = np.abs(np.triu(gram / n, 1)) > CORR_PRUNE_THRESHOLD
        keep = ~(close & varied[:, None] & varied[None, :]).any(axis=0)
    elif policy == "lasso_selected":
        keep = weights_at(lasso_path(gram, cross, n, varied, LASSO_SELECTOR_ALPHA), LASSO_SELECTOR_ALPHA) != 0
    elif policy == "none":
        keep = np.ones(size, bool)
    else:
        raise ValueError(f"not a policy of linear models: {policy}")
    return keep if keep.any() else np.arange(size) == 0


def solve_snapshots(plan: Plan, snapshots: list[dict[str, np.ndarray]], shift: np.ndarray, rows: list[Callable[[int], np.ndarray]] | None = None) -> Iterator[tuple[int, dict]]:
    """Every linear configuration on training snapshots, from the packed matrices of their patterns, with the place of the snapshot.

    ``rows`` gives for each snapshot the vectors that a family can be trained on, where a task holds them.
    """
    squares: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for position, name in enumerate(plan.names):
        found = [[v for pattern, v in packed.items() if pattern[position] == "1"] for packed in snapshots]
        # The first number of a packed matrix counts its rows.
        members = [i for i, parts in enumerate(found) if parts and sum(v[0] for v in parts) >= plan.min_train]
        if members:
            square = np.zeros((len(members), plan.size, plan.size))
            square[:, plan.upper[0], plan.upper[1]] = [np.sum(found[i], axis=0) for i in members]
            squares[name] = np.array(members), square + np.triu(square, 1).transpose(0, 2, 1)
    standard: dict[tuple, tuple] = {}
    masks: dict[tuple, np.ndarray] = {}
    for index, config in enumerate(plan.configs):
        name, mode = config["feature_family_name"], config["mode"]
        if config["model_type"] not in LINEAR or name not in squares:
            continue
        (members, square), base = squares[name], len(plan.families[name])
        n = square[:, 0, 0]
        y = plan.size - (1 if mode == "residual" else 2)
        key = (name, config["feature_transform"], mode)
        if key not in standard:
            at = np.array([plan.place[c] for c in transformed_names(plan.families[name], config["feature_transform"])]) + 1
            both = np.append(at, y)
            sums = square[:, 0, both]
            centred = square[:, both[:, None], both[None, :]] - sums[:, :, None] * sums[:, None, :] / n[:, None, None]
            variance = np.einsum("bii->bi", centred)[:, :-1] / n[:, None]
            # Rounding leaves a constant column with a tiny variance; treat it as constant.
            level = np.einsum("bii->bi", square)[:, at] / n[:, None] + (shift[at - 1] * 1e-4) ** 2
            varied = variance > 1e-12 * np.maximum(level, 1e-300)
            spread = np.where(varied, np.sqrt(np.maximum(variance, 0)), 1.0)
            standard[key] = (at, centred[:, :-1, :-1] / (spread[:, :, None] * spread[:, None, :]), centred[:, :-1, -1] / spread, variance, varied, spread, shift[both - 1] + sums / n[:, None])
        at, gram, cross, variance, varied, spread, means = standard[key]
        policy = config["feature_policy"]
        key = (name, mode, policy)
        if key not in masks and policy.startswith(INFORMATION):
            if rows is None:
                raise ValueError("neighbour information needs one model per series")
            held = [rows[i](plan.names.index(name)) for i in members]
            masks[key] = np.array([information_mask(policy, z[:, at[:base]], z[:, y]) for z in held])
        elif key not in masks:
            masks[key] = np.array([policy_mask(policy, gram[i, :base, :base], cross[i, :base], n[i], variance[i, :base], varied[i, :base]) for i in range(len(members))])
        mask = np.tile(masks[key], (1, len(at) // base))  # transforms of a dropped column go with it
        params = config["params"]
        weight, converged = solve_each(
            gram, cross, n, mask & varied, config["model_type"],
            float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5)), int(params.get("max_iter", MAX_ITER)),
        )
        coef = weight / spread
        intercept = means[:, -1] - np.einsum("bp,bp->b", coef, means[:, :-1])
        names = plan.families[name]
        for i, place in enumerate(members.tolist()):
            kept, used = masks[key][i], mask[i]
            yield place, {
                "config": index, "n_train": int(round(n[i])), "intercept": float(intercept[i]),
                "at": (at[used] - 1).tolist(), "coef": coef[i, used].tolist(), "standardised": weight[i, used].tolist(), "converged": bool(converged[i]),
                "selected": [c for c, k in zip(names, kept, strict=True) if k], "dropped": [c for c, k in zip(names, kept, strict=True) if not k],
            }


_FIT = "config int, n_train long, intercept double, at array<int>, coef array<double>, standardised array<double>, converged boolean, selected array<string>, dropped array<string>"
_FIT_ARROW = [("config", pa.int32()), ("n_train", pa.int64()), ("intercept", pa.float64()), ("at", pa.list_(pa.int32())), ("coef", pa.list_(pa.float64())), ("standardised", pa.list_(pa.float64())), ("converged", pa.bool_()), ("selected", pa.list_(pa.string())), ("dropped", pa.list_(pa.string()))]


def linear_fits(panel: DataFrame, plan: Plan, series_keys: list[str], model_keys: list[str], target: str, baseline: str, needed: DataFrame, embargo: int) -> DataFrame:
    """Fits of all linear configurations: model keys, month (of the fit), and one row a configuration.

    ``needed`` has the months to fit, by model key. With one model per series, a task walks through the months of a series;
    its history is bounded by the calendar. Models of several series add up months in tiles first.
    """
    rows = _marked(panel, plan, model_keys, target, baseline)
    shift = _shift(rows, plan.size - 1)
    fit_months = sorted(r[0] for r in needed.select("_month").distinct().collect())
    key_fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*model_keys).schema.fields)

    def schema(table: pa.Table) -> pa.Schema:
        return pa.schema([*[table.schema.field(k) for k in model_keys], ("_month", pa.int64()), *_FIT_ARROW])

    if model_keys == series_keys and model_keys:

        def snapshots(z: np.ndarray, months: np.ndarray, patterns: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], Callable[[int], np.ndarray]]]:
            """The matrices of a series before each fit month: running sums by pattern."""
            ends = np.searchsorted(months, np.array(fit_months) - 1 - embargo, side="right")
            usable = np.array([[c == "1" for c in p] for p in patterns])
            sums = {}
            for pattern in dict.fromkeys(patterns):
                mine = np.flatnonzero(patterns == pattern)
                running, upto = np.zeros(len(plan.upper[0])), np.searchsorted(mine, ends)
                sums[pattern], done = [], 0
                for end in upto.tolist():
                    if end > done:
                        running = running + (z[mine[done:end]].T @ z[mine[done:end]])[plan.upper]
                        done = end
                    sums[pattern].append(running if end else None)
            for k, end in enumerate(ends.tolist()):
                yield {p: v[k] for p, v in sums.items() if v[k] is not None}, lambda position, end=end: z[:end][usable[:end, position]]

        together = max(1, SOLVED // (plan.size**2 * max(len(plan.names), 1) * max(len(fit_months), 1)))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, ends in whole_series(batches, model_keys, TOGETHER, together):
                z, months, patterns = _matrix(table, shift), table["_month"].to_numpy(), np.array(table["_pattern"].to_pylist(), object)
                owners, packed, rows_of = [], [], []
                for start, end in zip([0, *ends[:-1]], ends, strict=True):
                    owner = {k: table[k][start].as_py() for k in model_keys}
                    for month, (matrices, mine) in zip(fit_months, snapshots(z[start:end], months[start:end], patterns[start:end]), strict=True):
                        owners.append({**owner, "_month": month})
                        packed.append(matrices)
                        rows_of.append(mine)
                out = [{**owners[place], **fit} for place, fit in solve_snapshots(plan, packed, shift, rows_of)]
                yield pa.RecordBatch.from_pylist(out, schema(table))

        spread = rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *model_keys)
        fits = spread.sortWithinPartitions(*model_keys, "_month").mapInArrow(walk, f"{key_fields}_month long, {_FIT}")
    else:
        tiled = pooled_moments(rows, plan, model_keys, shift, fit_months, embargo)

        def gather(table: pa.Table) -> pa.Table:
            packed: dict[str, np.ndarray] = {}
            for pattern, tile, values in zip(table["_pattern"].to_pylist(), table["tile"].to_pylist(), table["values"].to_pylist(), strict=True):
                packed.setdefault(pattern, np.zeros(len(plan.upper[0])))[tile * TILE : tile * TILE + len(values)] = values
            owner = {k: table[k][0].as_py() for k in model_keys}
            month = table["_month"][0].as_py()
            return pa.Table.from_pylist([{**owner, "_month": month, **fit} for _, fit in solve_snapshots(plan, [packed], shift)], schema(table))

        fits = tiled.groupBy(*model_keys, "_month").applyInArrow(gather, f"{key_fields}_month long, {_FIT}")
    return fits.join(needed, [*model_keys, "_month"], "left_semi")


# --- the run ----------------------------------------------------------------------------------------


@dataclass
class Experiment:
    """The tables of a run; all come from facts that are written once."""

    grid: DataFrame
    feature_sets: DataFrame
    predictions: DataFrame
    runs: DataFrame
    importances: DataFrame
    series_keys: list[str]

    @functools.cached_property
    def metrics(self) -> DataFrame:
        """Scores by configuration and period, written when first asked for."""
        facts = self.predictions.where("actual IS NOT NULL AND prediction IS NOT NULL")
        return materialize(mt.backtest_metrics(facts, series_keys=self.series_keys))

    @property
    def champion(self) -> DataFrame:
        return mt.champion(self.metrics)


_FACT = ["as_of_date", "fit_date", "config", "actual", "seasonal_naive_prediction", "prediction", "n_train", "converged", "selected", "dropped"]


def run_experiment(
    panel: DataFrame, series_keys: list[str], families: dict[str, list[str]], models: list[tuple[str, dict]], modes: list[str], policies: list[str], transforms: list[str],
    target: str, baseline: str, evaluated: Column, fit_on: Column, embargo: int, horizon: int, refit_months: int, min_train: int = 24,
    model_keys: list[str] | None = None, periods: list[tuple] | None = None, experiment_id: str = "experiment",
) -> Experiment:
    """Run a whole grid as one rolling as-of backtest.

    ``model_keys`` ⊆ ``series_keys`` (default: all of them, one model per series) decide which series share a linear
    model; trees are grown per series. ``evaluated`` marks as-of rows, ``fit_on`` is the month whose fit serves a
    row. A configuration forecasts the rows that have all of its columns, once its snapshot holds ``min_train``
    rows. Facts keep the series keys beside the configuration.
    """
    model_keys = series_keys if model_keys is None else model_keys
    spark = panel.sparkSession
    missing = sorted({c for cs in families.values() for c in cs} - set(panel.columns))
    if missing or any(not cs for cs in families.values()):
        raise ValueError(f"families need columns that the panel has: {missing}")
    named = fam.families_frame(spark, families)
    grid = materialize(expand_grid(named, models, modes, policies, transforms))
    plan = Plan(families, read_grid(grid), min_train)
    unknown = sorted({c["model_type"] for c in plan.configs} - {*LINEAR, *TREE, "naive"})
    if unknown:
        raise ValueError(f"model types without a learner: {unknown}")
    asked = panel.where(evaluated).select(
        *series_keys, F.col("date").alias("as_of_date"), fit_on.alias("fit_date"), month_number(fit_on).cast("long").alias("_month"),
        F.col(target).cast("double").alias("actual"), F.col(baseline).cast("double").alias("seasonal_naive_prediction"), plan.vector().alias("_x"), plan.complete().alias("_complete"),
    )
    parts = []
    if any(c["model_type"] in LINEAR for c in plan.configs):
        needed = asked.select(*model_keys, "_month").distinct()
        fits = materialize(linear_fits(panel, plan, series_keys, model_keys, target, baseline, needed, embargo))
        mode = F.array(*[F.lit(c["mode"]) for c in plan.configs])
        family = F.array(*[F.lit(plan.names.index(c["feature_family_name"]) if c["feature_family_name"] in plan.names else -1) for c in plan.configs])
        dot = F.aggregate(F.zip_with("at", "coef", lambda i, c: F.get("_x", i) * c), F.lit(0.0), lambda t, v: t + v)
        joined = asked.join(fits, [*model_keys, "_month"]).where(F.get("_complete", F.get(family, F.col("config"))))
        parts.append(joined.withColumn("prediction", with_mode(F.col("intercept") + dot, F.col("seasonal_naive_prediction"), F.get(mode, F.col("config")))).select(*series_keys, *_FACT))
        places = F.array(*[F.lit(c) for c in plan.columns])
        weights = fits.select(*model_keys, "_month", "config", F.explode(F.arrays_zip(F.transform("at", lambda i: F.get(places, i)).alias("feature_name"), F.col("standardised").alias("importance"))).alias("z"))
        importances = weights.select(*model_keys, "_month", "config", "z.feature_name", F.lit("coefficient").alias("importance_type"), "z.importance")
    else:
        importances = None
    trees = [(i, c) for i, c in enumerate(plan.configs) if c["model_type"] in TREE]
    if trees:
        columns = list(dict.fromkeys(x for _, c in trees for x in families[c["feature_family_name"]]))
        learners = [{**c, "columns": [columns.index(x) for x in families[c["feature_family_name"]]], "policy": c["feature_policy"]} for _, c in trees]
        grown = materialize(tree_fits(panel, series_keys, columns, target, baseline, learners, evaluated, fit_on, embargo, min_train))
        place = F.get(F.array(*[F.lit(i) for i, _ in trees]), F.col("config"))
        lists = F.array(*[F.array(*[F.lit(x) for x in families[c["feature_family_name"]]]) for _, c in trees])
        mode = F.get(F.array(*[F.lit(c["mode"]) for _, c in trees]), F.col("config"))
        flat = grown.select(*series_keys, "fit_date", F.col("config").alias("_c"), place.alias("config"), mode.alias("_mode"), F.get(lists, F.col("config")).alias("_names"), "n_train", "importance", "kept", "as_of_dates", "forecasts")
        served = flat.select(
            *series_keys, "fit_date", "config", "_mode", "n_train", F.filter("_names", lambda _, i: F.get("kept", i)).alias("selected"),
            F.filter("_names", lambda _, i: ~F.get("kept", i)).alias("dropped"), F.explode(F.arrays_zip("as_of_dates", "forecasts")).alias("z"),
        ).select("*", F.col("z.as_of_dates").alias("as_of_date"))
        known = asked.select(*series_keys, "as_of_date", "actual", "seasonal_naive_prediction")
        parts.append(served.join(known, [*series_keys, "as_of_date"]).withColumns({
            "prediction": with_mode(F.col("z.forecasts"), F.col("seasonal_naive_prediction"), F.col("_mode")), "converged": F.lit(True),
        }).select(*series_keys, *_FACT))
        if model_keys == series_keys:
            shown = flat.select(*series_keys, month_number("fit_date").cast("long").alias("_month"), "config", F.explode(F.arrays_zip(F.col("_names").alias("feature_name"), "importance")).alias("z"))
            shares = shown.select(*series_keys, "_month", "config", "z.feature_name", F.lit("feature_importance").alias("importance_type"), "z.importance")
            importances = shares if importances is None else importances.unionByName(shares)
    nothing = F.array().cast("array<string>")
    for index, config in enumerate(plan.configs):
        if config["model_type"] == "naive":
            parts.append(asked.where("actual IS NOT NULL AND seasonal_naive_prediction IS NOT NULL").withColumns({
                "config": F.lit(index), "prediction": F.col("seasonal_naive_prediction"), "n_train": F.lit(0).cast("long"), "converged": F.lit(True), "selected": nothing, "dropped": nothing,
            }).select(*series_keys, *_FACT))
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    return _described(materialize(facts), grid, plan, named, importances, series_keys, model_keys, modes, policies, transforms, horizon, refit_months, periods, experiment_id)


def _described(facts: DataFrame, grid: DataFrame, plan: Plan, named: DataFrame, importances: DataFrame | None, series_keys: list[str], model_keys: list[str], modes: list[str], policies: list[str], transforms: list[str], horizon: int, refit_months: int, periods: list[tuple] | None, experiment_id: str) -> Experiment:
    """Facts with the names of their configuration, scores, run metadata and everything summed up from them."""
    details = F.array(*[
        F.struct(
            *[F.lit(c[k]).alias(k) for k in ("config_id", "model_type", "mode", "feature_family_name", "feature_policy", "feature_transform")],
            F.lit(json.dumps(c["params"], sort_keys=True)).alias("hyperparameters_json"),
            F.array(*[F.lit(x) for x in plan.families.get(c["feature_family_name"], [])]).cast("array<string>").alias("_names"),
            F.lit(len(TRANSFORM_PARTS[c["feature_transform"]]) + 1).alias("_widths"),
        )
        for c in plan.configs
    ])
    wide = facts.withColumn("_d", F.get(details, F.col("config"))).select("*", "_d.*").drop("_d")
    wide = with_taxonomy(wide).withColumns({
        "experiment_id": F.lit(experiment_id),
        "target_date": shift_months("as_of_date", horizon),
        "horizon": F.lit(horizon),
        "model_refit": F.col("fit_date") == F.col("as_of_date"),
        "feature_set_id": F.when(F.col("feature_family_name") == BASELINE_FAMILY, F.lit(BASELINE_FAMILY)).otherwise(feature_set_id("feature_family_name", "mode", F.col("_names"), "feature_policy", "feature_transform")),
        "n_features_before_policy": F.size("_names").cast("long"),
        "n_features_after_policy": F.size("selected").cast("long"),
        "n_features": (F.size("selected") * F.col("_widths")).cast("long"),
        "train_seconds": F.lit(None).cast("double"),
    })
    scored = score_predictions(wide, periods)
    limits = {"corr_pruned": {"threshold": CORR_PRUNE_THRESHOLD}, "variance_pruned": {"threshold": VARIANCE_PRUNE_THRESHOLD}, "lasso_selected": {"alpha": LASSO_SELECTOR_ALPHA}}
    policy_params = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, json.dumps(v))]), F.col("feature_policy")), F.lit("{}"))
    runs = model_runs(scored, F.col("hyperparameters_json"), F.col("selected"), F.col("dropped"), policy_params, refit_months)
    runs = runs.withColumn("feature_names_json", json_string_list(F.col("_names"))).drop("_names", "_widths", "selected", "dropped", "config")
    predictions = scored.drop("_names", "_widths", "selected", "dropped", "config", "converged")
    names = F.array(*[F.lit(c["config_id"]) for c in plan.configs])
    if importances is None:
        importances = facts.select(*model_keys, F.lit(0).cast("long").alias("_month"), "config", F.lit("").alias("feature_name"), F.lit("").alias("importance_type"), F.lit(0.0).alias("importance")).limit(0)
    w = W.partitionBy(*model_keys, "_month", "config").orderBy(F.abs("importance").desc(), "feature_name")
    ranked = importances.withColumns({"config_id": F.get(names, F.col("config")), "importance_abs": F.abs("importance"), "rank": F.row_number().over(w).cast("long")})
    dated = ranked.withColumn("as_of_date", F.add_months(F.lit("1970-01-01").cast("date"), (F.col("_month") - _EPOCH).cast("int"))).drop("_month", "config")
    return Experiment(grid, fam.feature_sets(named, modes, policies, transforms, experiment_id), predictions, runs, dated, series_keys)


_EPOCH = 1970 * 12 + 1
