"""Global row numbers and pages of an ordered report, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schema import KEY
from riskloom.session import materialize, shuffle_width

#: Spark's row ids hold the partition above this bit and the row's number in it below.
ROW_BITS = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Number all rows from 1 in an order, like ``row_number()`` over everything.

    Rows are dealt to ranges of the order and sorted there; the ranges are
    written once with each row's place in its range, and only their sizes (a
    row per range) are added up.  The order should be total: rows equal in all
    of it get numbers in any order.  Nulls come where the order puts them; an
    empty table gives no rows; ``name`` may not be a column yet.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name} exists already")
    row, part = "__row_id", "__range"
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn(row, F.monotonically_increasing_id()))
    of_range = F.shiftright(F.col(row), ROW_BITS)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(of_range.alias("p")).agg(F.count("*").alias("n")).collect()}
    ahead, starts = 0, []
    for range_, n in sorted(sizes.items()):
        starts.append((range_, ahead))
        ahead += n
    offsets = df.sparkSession.createDataFrame(starts, f"{part} long, __ahead long")
    in_range = F.col(row).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # One row for each range, as many as there are shuffle partitions.
    out = placed.withColumn(part, of_range).join(F.broadcast(offsets), part)
    return out.select((F.col("__ahead") + in_range + 1).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def page(report: DataFrame, first: int, size: int, name: str = "position") -> DataFrame:
    """Rows ``first`` to ``first + size - 1`` of a numbered report: a filter, so files outside it are skipped."""
    return report.filter(F.col(name).between(first, first + size - 1))


def forecast_report(ranked: DataFrame) -> DataFrame:
    """A ranked forecast in report order: by time, then falling probability, then area."""
    return numbered(ranked, F.col("t0"), F.col("prob").desc(), F.col(KEY))
