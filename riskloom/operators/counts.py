"""Incident counts and side features per area and hour or day."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.timing import add_calendar, floor_day
from riskloom.schema import COUNT, KEY, LABEL, label, quoted, to_double

TIME_COLUMN = {"daily": "t0", "hourly": "dt"}


def cell_time(granularity: str) -> Column:
    if granularity not in TIME_COLUMN:
        raise ValueError(f"granularity must be daily or hourly, not {granularity!r}")
    return F.col("dt") if granularity == "hourly" else floor_day(F.col("dt"))


def rule_by_name(name: str) -> str:
    """``*_count`` is added up, anything else averaged."""
    return "sum" if name.lower().endswith("_count") else "mean"


def rule_mean(name: str) -> str:
    return "mean"


def _count_expression(raw: DataFrame) -> Column:
    if COUNT in raw.columns:
        return F.coalesce(F.sum(to_double(F.col(COUNT))), F.lit(0.0)).cast("bigint").alias(COUNT)
    return F.count("*").alias(COUNT)


def _feature_expression(name: str, how: str) -> Column:
    value = to_double(quoted(name))
    total = F.coalesce(F.sum(value), F.lit(0.0)) if how == "sum" else F.avg(value)
    return total.alias(name)


def aggregate_cells(
    raw: DataFrame,
    granularity: str,
    side_cols: Iterable[str] = (),
    rule: Callable[[str], str] | None = None,
    with_count: bool = True,
) -> DataFrame:
    """One row per (area, time): incident count and side features in one pass.

    ``raw`` needs ``GEOID`` and ``dt``.  Every aggregate here has a map-side
    partial form, so an area holding most rows shrinks to one row per time
    bucket and task before anything is shuffled.
    """
    rule = rule or (rule_by_name if granularity == "daily" else rule_mean)
    time_col = TIME_COLUMN[granularity]
    cells = raw.withColumn(time_col, cell_time(granularity)).dropna(subset=[KEY, time_col])
    present = set(raw.columns)
    measures = [_count_expression(raw)] if with_count else []
    measures += [_feature_expression(c, rule(c)) for c in side_cols if c in present]
    return cells.groupBy(KEY, time_col).agg(*measures)


def count_incidents(raw: DataFrame, granularity: str, tz: str | None = None) -> DataFrame:
    """Observed cells only: count, label and calendar per (area, time)."""
    time_col = TIME_COLUMN[granularity]
    cells = aggregate_cells(raw, granularity).withColumn(LABEL, label(F.col(COUNT)))
    return add_calendar(cells, time_col, tz, hourly=granularity == "hourly")


def join_side_features(
    base: DataFrame,
    raw: DataFrame,
    cols: Iterable[str],
    granularity: str,
    rule: Callable[[str], str] | None = None,
) -> DataFrame:
    """Left join side features of another raw table onto a grid.

    The raw side is aggregated first, so both sides have at most one row per
    cell and no join key can be hot.
    """
    present = [c for c in cols if c in raw.columns]
    if not present:
        return base
    side = aggregate_cells(raw, granularity, present, rule, with_count=False)
    return base.join(side, [KEY, TIME_COLUMN[granularity]], "left")


def grid_stats(grid: DataFrame, time_col: str = "t0") -> DataFrame:
    """Rows, areas, time range and label rate of a grid."""
    return grid.agg(
        F.count("*").alias("row_count"),
        F.count_distinct(F.col(KEY)).alias("area_count"),
        F.min(time_col).alias("first_time"),
        F.max(time_col).alias("last_time"),
        F.avg(F.col(LABEL).cast("int")).alias("label_rate"),
    )


def label_stats(grid: DataFrame) -> DataFrame:
    """Count and percent of labels 1 and 0; both rows always exist."""
    y = F.col(LABEL).cast("int")
    totals = grid.agg(
        F.coalesce(F.sum((y == 1).cast("bigint")), F.lit(0)).alias("ones"),
        F.coalesce(F.sum((y == 0).cast("bigint")), F.lit(0)).alias("zeros"),
    )
    rows = totals.select(F.expr(f"stack(2, 1, ones, 0, zeros) AS ({LABEL}, Count)"), (F.col("ones") + F.col("zeros")).alias("n"))
    percent = F.coalesce(F.try_divide(F.col("Count") * F.lit(100.0), F.col("n").cast("double")), F.lit(0.0))
    return rows.select(LABEL, "Count", F.round(percent, 4).alias("Percent(%)"))


def category_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per value of a category such as ``tier`` or ``block_id``."""
    return df.groupBy(name).agg(F.count("*").alias("row_count"))


def class_balance(df: DataFrame, y: str = LABEL) -> DataFrame:
    """Positives, negatives, positive rate and the weight for positives."""
    value = F.col(y).cast("int")
    counts = df.agg(
        F.coalesce(F.sum((value == 1).cast("bigint")), F.lit(0)).alias("pos"),
        F.coalesce(F.sum((value == 0).cast("bigint")), F.lit(0)).alias("neg"),
        F.avg(value).alias("y1_rate"),
    )
    weight = F.when(F.col("pos") > 0, F.col("neg").cast("double") / F.col("pos")).otherwise(1.0)
    return counts.withColumn("scale_pos_weight", weight)
