"""Dense grids: every area at every hour or day of the observed range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.timing import instant_literal
from riskloom.schema import COUNT, KEY, LABEL
from riskloom.session import shuffle_width

STEP_UNIT = {"dt": "hour", "t0": "day"}
STEP_TEXT = {"dt": "INTERVAL 1 HOUR", "t0": "INTERVAL 1 DAY"}


def time_span(df: DataFrame, time_col: str, required: bool = False) -> tuple:
    """First and last time as scalar subqueries: evaluated once, inside the same job.

    Pass the least processed frame that has the column; min and max need no
    shuffle and read only what ``time_col`` is made of.  If ``required``, the
    job fails where no row has a time.
    """
    first = F.min(time_col)
    if required:
        first = F.coalesce(first, F.raise_error(F.lit(f"column {time_col}: no time could be parsed")).cast(df.schema[time_col].dataType))
    return df.agg(first).scalar(), df.agg(F.max(time_col)).scalar()


def dense_grid(
    cells: DataFrame,
    time_col: str,
    span: tuple[datetime, datetime] | tuple | None = None,
    zero_filled: tuple[str, ...] = (COUNT, LABEL),
    partitions: int | None = None,
) -> DataFrame:
    """Fill the gaps between observed cells; one output row per area and step.

    ``cells`` must be unique per (area, time).  Each observed cell writes the
    steps from its own time up to the next observed one (the first also those
    before it), so only the sparse cells are shuffled, once, by area.  The
    dense rows are made where they stay: they need neither a join nor another
    exchange, and windows per area run on the same partitioning.  An area has
    at most one cell per step, so no partition can grow beyond the time axis
    times its share of areas.

    ``zero_filled`` columns are 0 on empty cells, all others NULL.  ``span``
    gives first and last step: two Columns that enclose all cells, or two
    datetimes, outside of which cells are left out (their areas stay).  Without it the span comes
    from ``cells``.  ``partitions`` should follow the dense size, areas times
    steps; the default is the session's shuffle width.
    """
    step = F.expr(STEP_TEXT[time_col])
    t = F.col(time_col)
    lo, hi = span if span is not None else time_span(cells, time_col)
    bounded = isinstance(lo, datetime)
    if bounded:
        lo, hi = (F.date_trunc(STEP_UNIT[time_col], instant_literal(b)) for b in (lo, hi))
    by_area = Window.partitionBy(KEY).orderBy(time_col)
    # A fixed partition count keeps AQE from merging partitions by their sparse
    # size just before they grow to the dense size.
    placed = cells.repartition(partitions or shuffle_width(cells.sparkSession), KEY)
    beside = {"__prev": F.lag(time_col).over(by_area), "__next": F.lead(time_col).over(by_area)}
    if bounded:
        # The first cell of an area without any inside stands in, emptied, so that every known area is kept.
        whole = by_area.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        inside = t.between(lo, hi)
        placed = placed.withColumns(beside | {"__n": F.count_if(inside).over(whole), "__k": F.row_number().over(by_area)})
        placed = placed.filter(inside | ((F.col("__n") == 0) & (F.col("__k") == 1)))
        emptied = [F.when(inside, F.col(f"`{c}`")).alias(c) for c in cells.columns if c not in (KEY, time_col)]
        near = [F.when(F.col(c).between(lo, hi), F.col(c)).alias(c) for c in beside]
        runs = placed.select(KEY, F.when(inside, t).otherwise(lo).alias(time_col), *emptied, *near)
    else:
        runs = placed.withColumns(beside)
    runs = runs.withColumns(
        {
            "__from": F.when(F.col("__prev").isNull(), lo).otherwise(t),
            "__to": F.when(F.col("__next").isNull(), hi).otherwise(F.col("__next") - step),
        }
    )
    steps = runs.withColumn("__slot", F.explode(F.sequence("__from", "__to", step)))
    observed = F.col("__slot") == t

    def value(name: str):
        kept = F.when(observed, F.col(f"`{name}`"))
        if name in zero_filled:
            kept = F.coalesce(kept, F.lit(0).cast(cells.schema[name].dataType))
        return kept.alias(name)

    others = [c for c in cells.columns if c not in (KEY, time_col)]
    return steps.select(KEY, F.col("__slot").alias(time_col), *[value(c) for c in others])
