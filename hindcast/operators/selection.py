"""Selectors that read whole paths or rows of a snapshot: the lasso path and nearest-neighbour information.

A lasso path needs only the sums of products of a snapshot, so it is a map over the rows that
``prefix_moments`` makes. Neighbour distances need the months themselves; a series has at most one row per
month, so the calendar bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.calendar import month_number

#: Events of a path per column before it counts as cycling.
MOST_EVENTS = 20
#: Policies ranked by nearest-neighbour information, and the neighbours that count.
INFORMATION, NEIGHBOURS = "mutual_info_top_", 3


def lasso_path(gram: np.ndarray, cross: np.ndarray, n: float, varied: np.ndarray, least: float = 0.0) -> list[tuple[float, np.ndarray, int]]:
    """Knots (penalty, weights, column) of |y-Xw|²/2n + a|w|₁ for falling penalties a down to ``least``.

    Between knots the weights are linear in the penalty. ``column`` is the one that enters (j) or leaves
    (-j - 1) at the knot; the last knot, at ``least``, carries -p - 1. ``gram`` and ``cross`` are
    standardised sums of products. A column that the active ones already span never enters.
    """
    p = len(cross)
    g, c = gram / n, cross / n
    weight, sign = np.zeros(p), np.zeros(p)
    active: list[int] = []
    out: list[tuple[float, np.ndarray, int]] = []
    usable = varied & (np.diag(g) > 0)
    penalty = float(np.max(np.abs(c[usable]), initial=0.0))
    if penalty <= least:
        return [(max(penalty, least), weight, -p - 1)]
    first = int(np.argmax(np.where(usable, np.abs(c), -1.0)))
    active, sign[first] = [first], np.sign(c[first])
    out.append((penalty, weight.copy(), first))
    left, left_sign = -1, 0.0
    for _ in range(MOST_EVENTS * p):
        at = np.array(active, dtype=int)
        inner = g[np.ix_(at, at)]
        slope = np.linalg.solve(inner, sign[at]) if len(at) else np.zeros(0)
        # Along the segment the weights grow by slope per unit of falling penalty.
        lean = g[:, at] @ slope
        rest = c - g[:, at] @ weight[at]
        step, event = penalty - least, None
        for j in np.flatnonzero(usable & ~np.isin(np.arange(p), at)):
            if len(at) and g[j, j] - g[j, at] @ np.linalg.solve(inner, g[at, j]) < 1e-10:
                continue
            for s in (1.0, -1.0):
                # s * (rest - t * lean) meets penalty - t.
                slack, pace = penalty - s * rest[j], 1.0 - s * lean[j]
                if pace > 1e-14 and not (j == left and s == left_sign):
                    t = max(slack, 0.0) / pace
                    if t < step:
                        step, event = t, (int(j), s)
        for k, j in enumerate(at):
            if slope[k] * sign[j] < 0 and weight[j] * sign[j] > 0:
                t = -weight[j] / slope[k]
                if t < step:
                    step, event = t, (-int(j) - 1, 0.0)
        weight[at] += step * slope
        penalty -= step
        if event is None:
            out.append((least, weight.copy(), -p - 1))
            return out
        column, s = event
        left = -1
        if column >= 0:
            active.append(column)
            sign[column] = s
        else:
            j = -column - 1
            active.remove(j)
            left, left_sign = j, sign[j]
            weight[j] = sign[j] = 0.0
        out.append((penalty, weight.copy(), column))
    raise ArithmeticError("the lasso path cycles")


def weights_at(path: list[tuple[float, np.ndarray, int]], penalty: float) -> np.ndarray:
    """Weights at a penalty not below the last knot."""
    if penalty >= path[0][0]:
        return path[0][1]
    for (high, before, _), (low, after, _) in zip(path, path[1:]):
        if penalty >= low:
            share = (high - penalty) / (high - low) if high > low else 1.0
            return before + share * (after - before)
    raise ValueError("the path ends above this penalty")


def standardised(n: np.ndarray, sums: np.ndarray, products: np.ndarray, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per snapshot: standardised XᵀX, Xᵀ(targets), which columns vary, and the deviations of the targets."""
    size = sums.shape[1]
    upper = np.triu_indices(size)
    for count, total, packed in zip(n, sums, products):
        square = np.zeros((size, size))
        square[upper] = packed
        square += np.triu(square, 1).T
        centred = square - np.outer(total, total) / count
        variance = np.diag(centred) / count
        varied = variance > 1e-12 * np.maximum(np.diag(square) / count, 1e-300)
        spread = np.where(varied, np.sqrt(np.maximum(variance, 0)), 1.0)
        inner = spread[:features]
        yield centred[:features, :features] / np.outer(inner, inner), centred[:features, features:] / inner[:, None], varied[:features], np.sqrt(np.maximum(variance[features:], 0))


def lasso_paths(moments: DataFrame, keys: list[str], features: list[str], targets: list[str]) -> DataFrame:
    """The path of every snapshot and target, one row per knot.

    ``moments`` holds the features followed by the targets, in this order. Rows: keys, date, mode (name of
    the target), n_train, spread (deviation of the target), step, penalty, feature (null at the end of a
    path), entered, weights (standardised, of all features at this penalty). Snapshots without rows and
    targets without variance give no rows. Every path goes down to a penalty of zero.
    """
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in moments.select(*keys).schema.fields]
    fields = ", ".join([*key_fields, "date date, mode string, n_train bigint, spread double, step int, penalty double, feature string, entered boolean, weights array<double>"])
    p = len(features)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            n = pdf["n"].to_numpy(float)
            solved = standardised(n, np.stack(pdf["sums"]), np.stack(pdf["products"]), p) if len(pdf) else iter(())
            owners = zip(pdf[[*keys, "date"]].itertuples(index=False), n, solved)
            for owner, count, (gram, cross, varied, spread) in owners:
                for t, mode in enumerate(targets):
                    if spread[t] <= 0:
                        continue
                    for step, (penalty, weight, column) in enumerate(lasso_path(gram, cross[:, t], count, varied)):
                        name = None if column == -p - 1 else features[column if column >= 0 else -column - 1]
                        rows.append((*owner, mode, int(count), float(spread[t]), step, penalty, name, column >= 0, weight))
            yield pd.DataFrame(rows, columns=[*keys, "date", "mode", "n_train", "spread", "step", "penalty", "feature", "entered", "weights"])

    return moments.where("n > 0").select(*keys, "date", F.col("n"), "sums", "products").mapInPandas(walk, fields)


def path_weights(paths: DataFrame, keys: list[str], penalty: Column) -> DataFrame:
    """Weights of every path at one penalty: the knots on both sides of it, interpolated.

    ``penalty`` may use the columns of the path's first row, which is its greatest penalty.
    """
    by = [*keys, "date", "mode"]
    knots = paths.groupBy(*by).agg(
        F.max("n_train").alias("n_train"), F.max("spread").alias("spread"), F.max("penalty").alias("greatest"),
        F.array_sort(F.collect_list(F.struct("step", "penalty", "weights"))).alias("knots"),
    ).withColumn("at", penalty)
    above = F.element_at(F.filter("knots", lambda k: (k["penalty"] >= F.col("at")) | (k["step"] == 0)), -1)
    below = F.coalesce(F.try_element_at(F.filter("knots", lambda k: k["penalty"] < F.col("at")), F.lit(1)), above)
    share = F.when(F.col("at") >= F.col("greatest"), 0.0).otherwise(F.coalesce(F.try_divide(above["penalty"] - F.col("at"), above["penalty"] - below["penalty"]), F.lit(0.0)))
    return knots.select(
        *by, "n_train", "spread", "greatest", "at",
        F.zip_with(above["weights"], below["weights"], lambda a, b: a + share * (b - a)).alias("weights"),
    )


# --- nearest-neighbour mutual information -------------------------------------------------------------


def neighbour_scores(x: np.ndarray, y: np.ndarray, ends: np.ndarray, neighbours: int) -> np.ndarray:
    """Information of x and y on the first ``ends`` rows each (NaN where there are too few).

    Both are scaled to unit deviation within the rows used. The radius of a row is the greater-coordinate
    distance to its k-th neighbour; rows strictly within it, and equal values, count in each coordinate.
    """
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    harmonic = np.concatenate([[0.0, 0.0], np.cumsum(1.0 / np.arange(1, max(len(x), neighbours) + 1))])
    out = np.full(len(ends), np.nan)
    for i, n in enumerate(ends):
        if n <= neighbours:
            continue
        ax, ay = dx[:n, :n] / (np.std(x[:n]) or 1.0), dy[:n, :n] / (np.std(y[:n]) or 1.0)
        far = np.maximum(ax, ay)
        np.fill_diagonal(far, np.inf)
        radius = np.partition(far, neighbours - 1, axis=1)[:, neighbours - 1 : neighbours]
        nx, ny = ((a < radius) | (a == 0) for a in (ax, ay))
        score = harmonic[n] + harmonic[neighbours] - np.mean(harmonic[nx.sum(axis=1)] + harmonic[ny.sum(axis=1)])
        out[i] = max(score, 0.0)
    return out


def information_mask(policy: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The columns of a ``mutual_info_top_<k>`` policy on the rows of a snapshot; ties go to the first."""
    most = int(policy.rsplit("_", 1)[1])
    scores = [np.nan_to_num(neighbour_scores(column, y, np.array([len(y)]), NEIGHBOURS)[0]) for column in x.T]
    return np.isin(np.arange(len(scores)), np.argsort(-np.array(scores), kind="stable")[:most])


def neighbour_information(
    panel: DataFrame, keys: list[str], features: list[str], target: str, asked: Column, embargo: int, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """Nearest-neighbour mutual information of each feature with the target in every asked snapshot.

    Rows: keys, date, position, feature, n, score. A snapshot holds the rows more than ``embargo`` months
    before its date whose features and target are all known; it is returned where ``asked`` holds and it has
    more rows than ``neighbours``. Every model needs its own series: rows of several series in one
    snapshot would have no bound, so ``keys`` may not be empty.
    """
    if not keys:
        raise ValueError("neighbour information needs the keys of a series")
    known = F.lit(True)
    for c in [*features, target]:
        known &= F.col(c).isNotNull()
    frame = panel.select(
        *keys, "date", month_number("date").cast("long").alias("_month"), F.coalesce(asked, F.lit(False)).alias("_asked"), known.alias("_known"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("_y"),
    ).where("_asked OR _known")
    key_fields = [f"{f.name} {f.dataType.simpleString()}" for f in panel.select(*keys).schema.fields]
    fields = ", ".join([*key_fields, "date date, position int, feature string, n bigint, score double"])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_month")
        train = pdf[pdf["_known"]]
        dates = pdf[pdf["_asked"]]
        ends = np.searchsorted(train["_month"].to_numpy(), dates["_month"].to_numpy() - embargo, side="left")
        y = train["_y"].to_numpy(float)
        parts = []
        for i, c in enumerate(features):
            part = dates[[*keys, "date"]].assign(position=i, feature=c, n=ends, score=neighbour_scores(train[f"_x{i}"].to_numpy(float), y, ends, neighbours))
            parts.append(part[ends > neighbours])
        return pd.concat(parts)

    return frame.groupBy(*keys).applyInPandas(score, fields)
