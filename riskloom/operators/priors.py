"""Leak-free rolling priors per area and calendar key."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.timing import DAY, instant_literal
from riskloom.schema import COUNT, KEY, LABEL, label, number_or, quoted, require

# Window lengths in days by column suffix.
ROLLUP_WINDOWS = {"28d": 28, "180d": 180}
PANEL_WINDOWS = {"3m": 90, "12m": 365}
MICROS = 1_000_000
TURN = ("block_id",)


def add_priors(
    df: DataFrame,
    windows: dict[str, int],
    keys: Iterable[str] = ("day_of_week",),
    time_col: str = "t0",
    mode: str = "closed_left",
    unique_cells: bool = False,
    since: datetime | None = None,
) -> DataFrame:
    """Add ``prior_cnt_<suffix>`` and ``prior_p_<suffix>`` for each window in days.

    ``closed_left``: labels in ``[t - W, t)`` of the same area and keys; the
    rate divides by the rows in that frame.  Empty frames give 0.

    ``shifted_hours``: labels in ``(t' - W, t']`` at the previous row ``t'``
    of the group, first row 0; the rate divides by the hours of the window.
    Rows of one time are taken in the order of ``block_id``.

    All windows share one partitioning and order, hence one exchange and one
    Window node; no exchange when ``df`` is already laid out by area.

    ``unique_cells`` says that (area, time) is unique, as in every grid built
    here.  Otherwise rows are first added up per (area, keys, time), so that
    the frames slide over the time axis and not over a hot area's raw rows,
    and the result is joined back.

    ``since`` rebuilds only rows from that time on: input older than the
    longest window is filtered before the window, where the filter still
    reaches the scan.
    """
    require(df, [KEY, time_col], "priors")
    if LABEL not in df.columns:
        require(df, [COUNT], "priors")
        df = df.withColumn(LABEL, label(F.col(COUNT)))
    group = [KEY, *[k for k in keys if k in df.columns]]
    if mode not in ("closed_left", "shifted_hours"):
        raise ValueError(f"unknown mode {mode!r}")
    if since is not None:
        if mode != "closed_left":
            raise ValueError("look-back pruning needs mode='closed_left'")
        oldest = since - timedelta(days=max(windows.values()))
        df = df.filter(F.col(time_col) >= instant_literal(oldest))
    # A row without one of the keys belongs to no group, whatever way the groups are read.
    df = df.drop(*[f"prior_{kind}_{s}" for kind in ("cnt", "p") for s in windows]).dropna(subset=group)
    y = number_or(F.col(LABEL), 0)
    if mode == "shifted_hours":
        out = _shifted(df.withColumn("__y", y), windows, group, time_col).drop("__y")
    elif unique_cells:
        ready = df.withColumns({"__y": y, "__n": F.lit(1)})
        out = _closed_left(ready, windows, group, time_col).drop("__y", "__n")
    else:
        cells = (
            df.select(*group, time_col, y.alias("__y"))
            .groupBy(*group, time_col)
            .agg(F.sum("__y").alias("__y"), F.count("*").alias("__n"))
        )
        priors = _closed_left(cells, windows, group, time_col).drop("__y", "__n")
        added = [F.col(c) for c in priors.columns if c.startswith("prior_")]
        out = df.join(priors, [*group, time_col]).select(*[quoted(c) for c in df.columns], *added)
    return out if since is None else out.filter(F.col(time_col) >= instant_literal(since))


def _until(values, ordered, microseconds):
    """Total of all rows up to ``microseconds`` relative to the own row.

    A frame without lower bound only grows, so each row is added once.  The
    total between two times is the difference of two of these: exact for
    whole numbers, and its cost does not depend on the window's length.
    """
    frame = ordered.rangeBetween(Window.unboundedPreceding, microseconds)
    return F.coalesce(F.sum(values).over(frame), F.lit(0))


def _closed_left(df, windows, group, time_col):
    ordered = Window.partitionBy(*group).orderBy(F.unix_micros(F.col(time_col)))
    totals = {f"__{v}_now": _until(f"__{v}", ordered, -1) for v in ("y", "n")}
    results = {}
    for suffix, days in windows.items():
        older = -days * DAY * MICROS - 1
        totals |= {f"__{v}_{suffix}": _until(f"__{v}", ordered, older) for v in ("y", "n")}
        hits = F.col("__y_now") - F.col(f"__y_{suffix}")
        seen = F.col("__n_now") - F.col(f"__n_{suffix}")
        results[f"prior_cnt_{suffix}"] = hits
        results[f"prior_p_{suffix}"] = F.when(seen > 0, hits / seen).otherwise(0.0)
    return df.withColumns(totals).withColumns(results).drop(*totals)


def _shifted(df, windows, group, time_col):
    by_group, time = Window.partitionBy(*group), F.unix_micros(F.col(time_col))
    ordered = by_group.orderBy(time)
    # Rows of one time follow each other by block, so that a row sees none that come later.
    in_turn = by_group.orderBy(time, *[F.col(c) for c in TURN if c in df.columns])
    totals = {"__y_now": F.sum("__y").over(in_turn.rowsBetween(Window.unboundedPreceding, 0))}
    own, counts, rates = {}, {}, {}
    for suffix, days in windows.items():
        totals[f"__y_{suffix}"] = _until("__y", ordered, -days * DAY * MICROS)
        own[f"__own_{suffix}"] = F.col("__y_now") - F.col(f"__y_{suffix}")
        counts[f"prior_cnt_{suffix}"] = F.lag(f"__own_{suffix}", 1, 0.0).over(in_turn)
        rates[f"prior_p_{suffix}"] = F.col(f"prior_cnt_{suffix}") / F.lit(days * 24.0)
    return df.withColumns(totals).withColumns(own).withColumns(counts).withColumns(rates).drop(*totals, *own)
