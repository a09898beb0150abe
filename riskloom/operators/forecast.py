"""Future grids, persisted features, tiers and rankings."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.order_stats import exact_quantiles
from riskloom.functions.timing import add_calendar, auto_freq, future_starts, horizon_hours
from riskloom.operators.features import fill_missing, median_values
from riskloom.schema import (
    COUNT, FORECAST_FEATURES, KEY, PRIOR_FAMILIES, TIER_FALLBACK, TIER_LABELS, int_or, numeric_columns, quoted,
    require, to_double,
)
from riskloom.session import materialize, shuffle_width

GROUP_LIMIT = 1_000  # Spark prunes ranked windows before the shuffle up to this rank
SALTS = 256


def plan_requests(requests: DataFrame, horizon: str = "horizon") -> DataFrame:
    """Add ``hours`` and the automatic ``freq`` to a table of forecast requests."""
    return requests.withColumn("hours", horizon_hours(F.col(horizon))).withColumn("freq", auto_freq(F.col("hours")))


def future_index(requests: DataFrame, as_of: datetime, align_to_epoch_week: bool = False) -> DataFrame:
    """One row per request and future bucket start, from columns ``freq`` and ``hours``.

    A request whose horizon can't be read or is too short for a single start
    stays as one row without ``t0``; ``request_problem`` tells why.
    """
    starts = future_starts(F.col("freq"), F.col("hours"), as_of, align_to_epoch_week)
    return requests.withColumn("t0", F.explode_outer(starts))


def request_problem(as_of: datetime, align_to_epoch_week: bool = False) -> Column:
    """What keeps a planned request from having a future start; NULL if nothing does."""
    starts = future_starts(F.col("freq"), F.col("hours"), as_of, align_to_epoch_week)
    return F.when(F.col("hours").isNull(), "unreadable").when(F.size(starts) <= 0, "too short")


def carried_columns(columns: Iterable[str]) -> list[str]:
    """What a forecast takes over from the last known row, as far as present.

    The count, one complete family of priors (28d/180d before 3m/12m) and the
    optional side features.
    """
    have = list(columns)
    keep = [COUNT]
    for short, long in PRIOR_FAMILIES:
        family = [f"prior_{kind}_{s}" for s in (short, long) for kind in ("cnt", "p")]
        if set(family) <= set(have):
            keep += family
            break
    return keep + [c for c in FORECAST_FEATURES if c in have]


def last_snapshot(grid: DataFrame, keep: Iterable[str], time_col: str = "t0", dense: bool = False) -> DataFrame:
    """Each area's row with the latest time.

    One aggregate with a map-side part: a hot area leaves one row per task.
    ``dense`` says that every area reaches the grid's last time, as grids
    built here do: then only that time is read, and statistics skip the rest.
    """
    keep = list(keep)
    require(grid, [KEY, time_col, *keep], "snapshot")
    if dense:
        per_area = grid.dropna(subset=[KEY]).groupBy(KEY).agg(F.max(time_col).alias("last"))
        spread = per_area.agg(F.min("last").alias("lo"), F.max("last").alias("hi")).first()
        if spread["lo"] != spread["hi"]:
            raise ValueError("the grid is not dense: some areas end early")
        last_time = F.lit(spread["hi"])
        return grid.filter(F.col(time_col) == last_time).select(KEY, *[quoted(c) for c in keep])
    row = F.struct(*[quoted(c) for c in keep])
    last = grid.dropna(subset=[KEY]).groupBy(KEY).agg(F.max_by(row, F.col(time_col)).alias("__row"))
    return last.select(KEY, *[F.col("__row")[c].alias(c) for c in keep])


def one_area(df: DataFrame, area: str) -> DataFrame:
    """Rows of a single area; fails if there are none.

    Called on the grid, so the filter reaches the scan.
    """
    part = df.filter(F.col(KEY) == F.lit(str(area)))
    if part.isEmpty():
        raise ValueError(f"area {area!r} is not in the grid")
    return part


def fill_with_medians(df: DataFrame) -> DataFrame:
    """Missing numbers become their column's exact median; complete columns cost no search."""
    names = numeric_columns(df)
    if not names:
        return df
    counted = df.agg(F.count("*").alias("__n"), *[F.count(to_double(quoted(c))).alias(c) for c in names]).first()
    sizes = {c: counted[c] for c in names if counted[c] < counted["__n"]}
    return fill_missing(df, median_values(df, list(sizes), sizes))


def forecast_frame(
    grid: DataFrame,
    freq: str,
    hours: float,
    as_of: datetime,
    area: str | None = None,
    align_to_epoch_week: bool = False,
    dense: bool = False,
) -> DataFrame:
    """Model inputs for every area and future bucket.

    The snapshot (one row per area) is written once because the medians and
    the frame both read it; the future rows are then exploded from it in
    place, without a join.  Medians of the snapshot equal those of the frame,
    where every area repeats equally often.  ``dense`` as in ``last_snapshot``.
    """
    if freq != "1M" and hours <= 0:
        raise ValueError("horizon too short: no future bucket")
    if area is not None:
        grid = one_area(grid, area)
    snapshot = materialize(last_snapshot(grid, carried_columns(grid.columns), dense=dense))
    filled = fill_with_medians(snapshot)
    starts = future_starts(F.lit(freq), F.lit(float(hours)), as_of, align_to_epoch_week)
    # Spread the small snapshot before it grows, so that scoring runs wide.
    spread = filled.repartition(shuffle_width(grid.sparkSession), KEY)
    rows = spread.withColumn("t0", F.explode(starts))
    rows = add_calendar(rows, "t0", hour_start="zero")
    return rows.withColumns(
        {c: int_or(F.col(c), -1 if c == "year" else 0, t) for c, t in
         (("year", "smallint"), ("month", "tinyint"), ("day_of_week", "tinyint"), ("hour_start", "tinyint"))}
    )


def tier_rank(prob: Column, limits: list[float]) -> Column:
    """1 (highest) to 5 (lowest) by four descending limits, each inclusive."""
    rank = F.lit(len(limits) + 1)
    for i in range(len(limits), 0, -1):
        rank = F.when(prob >= F.lit(limits[i - 1]), F.lit(i)).otherwise(rank)
    return rank


def tier_limits(scored: DataFrame, prob: str = "prob") -> list[float]:
    """Quantiles .8/.6/.4/.2 of all scores, or the fixed limits below five rows."""
    n = scored.agg(F.count(prob)).first()[0]
    return list(TIER_FALLBACK) if n < 5 else exact_quantiles(scored, {prob: TIER_FALLBACK}, {prob: n})[prob]


def add_tier(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Add ``tier_rank`` and ``tier`` over all rows; rank before cutting to a top k.

    The limits are computed in passes that return single rows, then enter the
    plan as literals.
    """
    rank = tier_rank(F.col(prob), tier_limits(scored, prob))
    names = F.array(*[F.lit(name) for name in TIER_LABELS])
    return scored.withColumn("tier_rank", rank).withColumn("tier", F.element_at(names, F.col("tier_rank")))


def top_k(
    scored: DataFrame, k: int | None, per: str = "t0", by: str = "prob", tie: str = KEY
) -> DataFrame:
    """The ``k`` best rows per bucket, ties by key; all rows for ``k <= 0``.

    A bucket holds one row per area, so it must not be ranked whole in one
    task.  Up to rank 1,000 Spark keeps only ``k`` rows per task and bucket
    before the shuffle.  Beyond that the bucket is ranked in salted parts
    first, and the survivors are ranked again: the same rows, in two steps.
    """
    if not k or k <= 0:
        return scored
    order = [F.col(by).desc(), F.col(tie)]
    if k > GROUP_LIMIT:
        salted = Window.partitionBy(per, "__salt").orderBy(*order)
        scored = (
            scored.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(SALTS)))
            .withColumn("__r", F.row_number().over(salted))
            .filter(F.col("__r") <= k).drop("__salt", "__r")
        )
    ranked = scored.withColumn("__r", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.filter(F.col("__r") <= k).drop("__r")


def ranked_forecast(scored: DataFrame, k: int | None = 50, area: str | None = None) -> DataFrame:
    """Tiers over everything, then the best ``k`` per bucket, in report order."""
    tiered = add_tier(scored)
    if area is not None:
        return tiered.orderBy("t0")
    return top_k(tiered, k).orderBy("t0", F.col("prob").desc(), KEY)
