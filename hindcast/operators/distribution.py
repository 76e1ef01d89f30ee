"""Exact order statistics over groups of any size.

A window over one hot group runs in one task, and an exact ``percentile`` keeps every distinct value
of a group in one buffer. Here the ordered space of (group, key) is cut into ranges first. The cut
points come from a bounded, hash-chosen sample and reach the plan as a scalar subquery, so the range
of a row is a pure function of the row: recomputed tasks agree. Work is then per range, and only
range totals (at most ranges + groups rows) are accumulated across ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_PER_RANGE = 20


def range_count(df: DataFrame) -> int:
    """Number of ranges: a power of two, about four per shuffle partition, at most 4096."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(12, max(4, (4 * partitions - 1).bit_length()))


def with_range(df: DataFrame, key: list[str], name: str = "_range") -> DataFrame:
    """Add the index of the range that the key tuple falls in (ascending with the key)."""
    ranges = range_count(df)
    key_struct = F.struct(*key)
    cuts = (
        df.select(key_struct.alias("k"), F.xxhash64(*key).alias("h"))
        .orderBy("h")
        .limit(ranges * SAMPLE_PER_RANGE)
        .agg(F.array_sort(F.collect_list("k")).alias("a"))
        .select(
            F.transform(
                F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("a", (i * F.size("a") / ranges).cast("int"))
            ).alias("cuts")
        )
    )
    steps = F.array(*[F.lit(1 << bit) for bit in range(ranges.bit_length() - 2, -1, -1)])

    def advance(position: Column, step: Column) -> Column:
        probe = F.get("_cuts", position + step - 1)
        return F.when(probe < key_struct, position + step).otherwise(position)

    return (
        df.withColumn("_cuts", cuts.scalar()).withColumn(name, F.aggregate(steps, F.lit(0), advance)).drop("_cuts")
    )


def _before(totals: DataFrame, group: list[str], size: str) -> DataFrame:
    """Rows preceding each range inside its group, and the group's total."""
    whole = W.partitionBy(*group) if group else W.partitionBy()
    ahead = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *group,
        "_range",
        F.coalesce(F.sum(size).over(ahead), F.lit(0)).alias("_before"),
        F.sum(size).over(whole).alias("_total"),
        F.col(size).alias("_size"),
    )


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equality join in which NULL keys match each other."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def ordinal(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Exact 1-based position of each row in its group.

    ``order`` lists ascending columns that together are unique in the group; negate a numeric column
    for descending order. Rows whose order columns are NULL sort first, so filter them beforehand.
    """
    ranged = with_range(df, [*group, *order])
    totals = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(totals, group, "_n").drop("_total", "_size")
    local = W.partitionBy(*group, "_range").orderBy(*order)
    placed = ranged.withColumn("_local", F.row_number().over(local))
    joined = join_null_safe(placed, offsets, [*group, "_range"], "inner")
    return joined.withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint")).drop(
        "_range", "_before", "_local"
    )


def ranked(
    df: DataFrame, group: list[str], metric: str, ascending: bool, tie: str, name: str = "rank"
) -> DataFrame:
    """Position by one metric with a unique tie-break column; rows without the metric are dropped."""
    keyed = df.where(F.col(metric).isNotNull()).withColumn("_key", F.col(metric) if ascending else -F.col(metric))
    return ordinal(keyed, group, ["_key", tie], name).drop("_key")


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probabilities: list[float]
) -> DataFrame:
    """Linear-interpolation quantiles per group: rows (group..., p, quantile, n).

    Equal values are counted before the shuffle, so a repeated value is one row however often it
    occurs. Only ranges that hold a wanted position are sorted.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranged = with_range(counts.where("_c > 0"), [*group, "_v"])
    totals = ranged.groupBy(*group, "_range").agg(F.sum("_c").alias("_n"))
    probability = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    position = F.col("p") * (F.col("_total") - 1)
    wanted = (
        _before(totals, group, "_n")
        .select("*", probability.alias("p"))
        .select("*", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))).alias("_at"))
        .where((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_size")))
    )
    targets = wanted.groupBy(*group, "_range", "_before", "_total").agg(
        F.collect_list(F.struct("p", "_at")).alias("_targets")
    )
    rows = join_null_safe(ranged, targets, [*group, "_range"], "inner")
    running = W.partitionBy(*group, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = (
        rows.withColumn("_end", F.col("_before") + F.sum("_c").over(running))
        .withColumn("_t", F.explode("_targets"))
        .where((F.col("_t._at") < F.col("_end")) & (F.col("_t._at") >= F.col("_end") - F.col("_c")))
    )
    ends = hits.groupBy(*group, F.col("_t.p").alias("p")).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.max("_total").alias("n")
    )
    spot = F.col("p") * (F.col("n") - 1)
    return ends.select(
        *group, "p", (F.col("_low") + (F.col("_high") - F.col("_low")) * (spot - F.floor(spot))).alias("quantile"), "n"
    )


def quantile_columns(
    df: DataFrame, group: list[str], values: list[str], probabilities: dict[str, float]
) -> DataFrame:
    """Quantiles of several columns, one row per group with ``{name}_{column}`` columns."""
    long = unpivot_numbers(df, group, values)
    stats = exact_quantiles(long, [*group, "variable"], "value", sorted(set(probabilities.values())))
    picks = [
        F.max(F.when((F.col("variable") == v) & (F.abs(F.col("p") - p) < 1e-12), F.col("quantile"))).alias(
            f"{name}_{v}"
        )
        for v in values
        for name, p in probabilities.items()
    ]
    return stats.groupBy(*group).agg(*picks)


def unpivot_numbers(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Long form (ids..., variable, value) with every value as double."""
    wide = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return wide.unpivot(ids, values, "variable", "value")
