"""Calendar-complete monthly panels.

Raw rows are pre-aggregated per (series, month) on the map side, so a hot series moves only its
months. From then on a series has at most one row per calendar month: every window partitioned by
series is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hindcast.functions.calendar import month_floor, month_sequence


def series_window(keys: list[str], date: str = "date") -> WindowSpec:
    """Rows of one series in month order; without keys the whole frame is one series."""
    return (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy(date)


def series_frame(keys: list[str]) -> WindowSpec:
    return W.partitionBy(*keys) if keys else W.partitionBy()


def exact_sum(value: Column | str, scale: int = 2) -> Column:
    """Sum of money-like doubles as decimals: the total does not depend on the order of rows."""
    c = F.col(value) if isinstance(value, str) else value
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def to_monthly(df: DataFrame, keys: list[str], date: Column | str, measures: dict[str, Column]) -> DataFrame:
    """Aggregate raw rows to one row per (keys, month)."""
    return (
        df.withColumn("date", month_floor(date)).where(F.col("date").isNotNull()).groupBy(*keys, "date")
        .agg(*[expression.alias(name) for name, expression in measures.items()])
    )


#: Raw rows behind a task's series: the months and forecasts made from them stay some hundred MB.
ROWS_A_TASK = 500_000


def tasks_for(df: DataFrame) -> int:
    """The session's shuffle partitions, more where ``df`` has more rows than so many tasks should work on.

    Counting a Parquet table reads its footers only.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK))


def by_series(df: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Hash-partition by series into ``tasks`` partitions, by default the session's shuffle partitions.

    A fixed number keeps adaptive execution from merging partitions by their size here: rows are few and
    small at this point, but the spine, features and forecasts made from them are not.
    """
    if not keys:
        return df
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def on_spine(monthly: DataFrame, keys: list[str], bounds: str = "global", fill: dict | None = None, tasks: int | None = None) -> DataFrame:
    """Give every series a row for every month; months without data get NULL measures.

    The months of a series are gathered into one map (bounded by the calendar) and read back along
    the generated month sequence. The result keeps the hash partitioning by series, so the windows
    that follow need no further exchange; ``tasks`` are its partitions. ``bounds`` is "global" (first to last month of the whole
    table) or "series" (of the series itself).
    """
    measures = [c for c in monthly.columns if c not in [*keys, "date"]]
    spread_out = by_series(monthly, keys, tasks)
    gathered = spread_out.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("date", F.struct(*measures)))).alias("_months"),
        F.min("date").alias("_low"),
        F.max("date").alias("_high"),
    )
    if bounds == "global":
        limits = monthly.agg(F.struct(F.min("date").alias("low"), F.max("date").alias("high")).alias("b"))
        gathered = gathered.withColumn("_b", limits.scalar()).withColumns({"_low": F.col("_b.low"), "_high": F.col("_b.high")})
    spread = gathered.select(
        *keys, "_months", F.explode(month_sequence(F.col("_low"), F.col("_high"))).alias("date")
    ).withColumn("_row", F.try_element_at("_months", F.col("date")))
    fill = fill or {}
    return spread.select(
        *keys,
        "date",
        *[
            (F.coalesce(F.col(f"_row.{m}"), F.lit(fill[m])) if m in fill else F.col(f"_row.{m}")).alias(m)
            for m in measures
        ],
    )


def trim_leading(df: DataFrame, keys: list[str], rows: int, date: str = "date") -> DataFrame:
    """Drop the first ``rows`` months of every series."""
    if rows < 0:
        raise ValueError("the leading trim must not be negative")
    position = F.row_number().over(series_window(keys, date))
    return df.withColumn("_position", position).where(F.col("_position") > rows).drop("_position")


def missing_months(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Months between a series' first and last row that have no row (Q2)."""
    span = monthly.groupBy(*keys).agg(
        F.min("date").alias("_low"), F.max("date").alias("_high"), F.collect_set("date").alias("_present")
    )
    expected = month_sequence(F.col("_low"), F.col("_high"))
    return span.select(*keys, F.explode(F.array_except(expected, "_present")).alias("date"))


def whole_series(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, most: int = 64) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of about ``rows`` rows (at most ``most`` series) that hold series whole, and where each series ends.

    ``batches`` come sorted by series; a series longer than ``rows`` comes alone.
    """
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, list[int]]]:
        table = pa.Table.from_batches(held)
        owner = table.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        ends = [*(np.flatnonzero(np.diff(owner)) + 1).tolist(), *([len(owner)] if last else [])]
        held[:] = [] if last else table.slice(ends[-1] if ends else 0).to_batches()
        start, part = 0, []
        for end in ends:
            if part and (end - start > rows or len(part) == most):
                yield table.slice(start, part[-1] - start), [e - start for e in part]
                start, part = part[-1], []
            part.append(end)
        if part:
            yield table.slice(start, part[-1] - start), [e - start for e in part]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from cut(False)
    if held:
        yield from cut(True)
