"""Feature selection inside every training snapshot.

``prefix_moments`` gives the cross-product sums of every snapshot as running sums by month. Variance and
correlation pruning, the lasso selector and all linear fits read them; no snapshot is ever copied.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.constants import CORR_PRUNE_THRESHOLD, VARIANCE_PRUNE_THRESHOLD
from hindcast.functions.ids import json_string_list
from hindcast.functions.scalar import finite_or_null
from hindcast.operators.backtest import prefix_window
from hindcast.operators.panel import series_frame


def upper_pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def prefix_moments(
    panel: DataFrame, model_keys: list[str], columns: list[str], required: list[str], embargo: int, one_row_per_month: bool = False
) -> DataFrame:
    """Per (model_keys, date): n, shift, sums and cross-products over the usable rows of the snapshot.

    Rows of all series that share a model are first summed per month, which combines map-side; the
    running window then sees one row per month. ``shift`` is subtracted from each column before
    squaring: it changes no statistic and keeps the sums accurate.
    """
    usable = F.lit(True)
    for c in [*columns, *required]:
        usable &= F.col(c).isNotNull()
    values = [F.when(usable, F.col(c).cast("double")) for c in columns]
    means = F.array(*[F.coalesce(F.avg(v), F.lit(0.0)) for v in values])
    if one_row_per_month:
        # Months of one series: the mean comes from the partition the running sums use anyway.
        whole = series_frame(model_keys)
        frame = panel.withColumn("shift", F.array(*[F.coalesce(F.avg(v).over(whole), F.lit(0.0)) for v in values]))
    elif model_keys:
        shifts = panel.groupBy(*model_keys).agg(means.alias("shift"))
        frame = panel.join(shifts, model_keys)
    else:
        frame = panel.withColumn("shift", panel.agg(means.alias("shift")).scalar())
    centred = [F.when(usable, F.col(c).cast("double") - F.get("shift", F.lit(i))) for i, c in enumerate(columns)]
    frame = frame.select(*model_keys, "date", "shift", usable.cast("int").alias("_u"), *[c.alias(f"_c{i}") for i, c in enumerate(centred)])
    pairs = upper_pairs(len(columns))
    names = ["_n", *[f"_s{i}" for i in range(len(columns))], *[f"_p{i}_{j}" for i, j in pairs]]
    parts = [F.col("_u"), *[F.col(f"_c{i}") for i in range(len(columns))], *[F.col(f"_c{i}") * F.col(f"_c{j}") for i, j in pairs]]
    if one_row_per_month:
        monthly = frame.select(*model_keys, "date", "shift", *[p.alias(n) for p, n in zip(parts, names)])
    else:
        monthly = frame.groupBy(*model_keys, "date").agg(
            F.first("shift").alias("shift"), *[F.sum(p).alias(n) for p, n in zip(parts, names)]
        )
    w = prefix_window(model_keys, embargo)
    running = {n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names}
    summed = monthly.select(*model_keys, "date", "shift", *[c.alias(n) for n, c in running.items()])
    return summed.select(
        *model_keys,
        "date",
        F.col("_n").cast("bigint").alias("n"),
        "shift",
        F.array(*[F.col(f"_s{i}").cast("double") for i in range(len(columns))]).alias("sums"),
        F.array(*[F.col(f"_p{i}_{j}").cast("double") for i, j in pairs]).alias("products"),
    )


def _cross(i: int, j: int, size: int) -> Column:
    """Centred cross-product of columns i <= j."""
    place = {pair: k for k, pair in enumerate(upper_pairs(size))}[(i, j)]
    s = F.get("sums", F.lit(i)) * F.get("sums", F.lit(j))
    return F.get("products", F.lit(place)) - F.try_divide(s, F.col("n"))


def variances(moments: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sample variance of each column in each snapshot."""
    size = len(columns)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.try_divide(_cross(i, i, size), F.col("n") - 1).alias("variance"))
            for i, c in enumerate(columns)
        ]
    )
    return moments.select(*keys, "date", "n", F.explode(rows).alias("r")).select(*keys, "date", "n", "r.*")


def correlations(moments: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Correlation of each column pair in each snapshot; a constant column has none."""
    size = len(columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"),
                F.try_divide(
                    _cross(i, j, size),
                    F.sqrt(F.greatest(_cross(i, i, size), F.lit(0.0))) * F.sqrt(F.greatest(_cross(j, j, size), F.lit(0.0))),
                ).alias("r"),
            )
            for i in range(size)
            for j in range(i + 1, size)
        ]
    )
    return moments.select(*keys, "date", "n", F.explode(rows).alias("r")).select(*keys, "date", "n", "r.*")


def selection_masks(moments: DataFrame, columns: list[str], policy: str, threshold: float = CORR_PRUNE_THRESHOLD) -> DataFrame:
    """Add ``mask``: which leading ``columns`` the policy keeps in each snapshot.

    Variance pruning keeps columns above the floor. Correlation pruning drops a column that is too
    close to any earlier one, including one dropped itself. If nothing is left the first column stays.
    """
    size = len(columns)
    # The moments may hold further columns (targets) after the features.
    total = F.size("sums")

    def product(i: int, j: int) -> Column:
        # Offset of pair (i, j) in a triangle of ``total`` columns.
        place = F.lit(i) * total - F.lit(i * (i - 1) // 2) + F.lit(j - i)
        s = F.get("sums", F.lit(i)) * F.get("sums", F.lit(j))
        return F.get("products", place.cast("int")) - F.try_divide(s, F.col("n"))

    everything = F.array(*[F.lit(True)] * size)
    if policy == "none" or size <= 1:
        return moments.withColumn("mask", everything)
    if policy == "variance_pruned":
        keep = F.array(
            *[F.coalesce(F.try_divide(product(i, i), F.col("n") - 1) > VARIANCE_PRUNE_THRESHOLD, F.lit(False)) for i in range(size)]
        )
    elif policy == "corr_pruned":
        flags = []
        for j in range(size):
            close = F.lit(False)
            for i in range(j):
                spread = F.sqrt(F.greatest(product(i, i) * product(j, j), F.lit(0.0)))
                close |= F.coalesce(F.abs(F.try_divide(product(i, j), spread)) > threshold, F.lit(False))
            flags.append(~close)
        keep = F.array(*flags)
    else:
        raise ValueError(f"not a moment-based policy: {policy}")
    first_only = F.array(*[F.lit(i == 0) for i in range(size)])
    return moments.withColumn("mask", F.when(F.exists(keep, lambda k: k), keep).otherwise(first_only))


def pruned_features(masked: DataFrame, keys: list[str], columns: list[str], policy: str) -> DataFrame:
    """Policy record per snapshot (B12): kept and dropped names, counts and parameters."""
    params = {"corr_pruned": {"threshold": CORR_PRUNE_THRESHOLD}, "variance_pruned": {"threshold": VARIANCE_PRUNE_THRESHOLD}}
    names = F.array(*[F.lit(c) for c in columns])
    selected = F.filter(names, lambda c, i: F.get("mask", i))
    return masked.select(
        *keys,
        "date",
        F.col("n").alias("n_train"),
        selected.alias("selected_features"),
        F.array_except(names, selected).alias("dropped_features"),
        F.lit(len(columns)).alias("n_features_before_policy"),
        F.size(selected).alias("n_features_after_policy"),
        F.lit(json.dumps(params.get(policy, {}))).alias("policy_params"),
    ).withColumn("dropped_feature_names_json", json_string_list(F.col("dropped_features")))


def top_features(scores: DataFrame, group: list[str], k: int, score: str = "score") -> DataFrame:
    """Best ``k`` features per group; non-finite scores do not count (T9). Rows are one per feature."""
    w = W.partitionBy(*group).orderBy(F.col(score).desc(), F.col("position").asc())
    clean = scores.withColumn(score, finite_or_null(score)).where(F.col(score).isNotNull())
    return clean.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


# --- mutual information (B9) -----------------------------------------------------------------------


def mutual_information(
    panel: DataFrame, keys: list[str], features: list[str], target: str, first_as_of: str, embargo: int, bins: int = 4
) -> DataFrame:
    """Binned mutual information of each feature with the target in every snapshot.

    Bin edges are equal-frequency points of the first snapshot, so later months never influence them,
    and cell counts of later snapshots are running sums: one pass, no snapshot copies. Series are
    monthly, so the edges of a series come from at most one value per calendar month.
    """
    whole = W.partitionBy(*keys) if keys else W.partitionBy()
    cut = F.add_months(F.lit(first_as_of).cast("date"), -embargo)
    points = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    early = F.col("date") < cut
    usable = F.lit(True)
    for c in [*features, target]:
        usable &= F.col(c).isNotNull()
    edges = {f"_e_{c}": F.percentile(F.when(early & usable, F.col(c)), points).over(whole) for c in [*features, target]}
    frame = panel.withColumns(edges)
    cells = {f"_b_{c}": F.when(usable, _bin_of(c)) for c in [*features, target]}
    frame = frame.withColumns(cells)
    w = prefix_window(keys, embargo)
    counts = {
        f"_k_{c}": F.array(
            *[
                F.coalesce(F.sum(((F.col(f"_b_{c}") == x) & (F.col(f"_b_{target}") == y)).cast("double")).over(w), F.lit(0.0))
                for x in range(bins)
                for y in range(bins)
            ]
        )
        for c in features
    }
    frame = frame.select(*keys, "date", *[v.alias(n) for n, v in counts.items()])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"_k_{c}").alias("k"))
            for i, c in enumerate(features)
        ]
    )
    long = frame.where(F.col("date") >= F.lit(first_as_of).cast("date")).select(*keys, "date", F.explode(rows).alias("r"))
    long = long.select(*keys, "date", "r.*").withColumn("n", F.aggregate("k", F.lit(0.0), lambda t, v: t + v))

    def total(cells: list[int]) -> Column:
        out = F.lit(0.0)
        for cell in cells:
            out = out + F.get("k", F.lit(cell))
        return out

    score = F.lit(0.0)
    for x in range(bins):
        for y in range(bins):
            joint = F.get("k", F.lit(x * bins + y))
            row, column = total([x * bins + v for v in range(bins)]), total([v * bins + y for v in range(bins)])
            ratio = F.try_divide(joint * F.col("n"), row * column)
            score = score + F.when(joint > 0, F.try_divide(joint, F.col("n")) * F.log(ratio)).otherwise(0.0)
    return long.select(*keys, "date", "position", "feature", F.col("n").cast("bigint").alias("n"), score.alias("score"))


def _bin_of(column: str) -> Column:
    return F.size(F.filter(f"_e_{column}", lambda edge: edge < F.col(column)))
