"""Feature choice, alignment, time split, sampling and imputation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.order_stats import Place, exact_quantiles, nth_smallest, nth_smallest_long
from riskloom.functions.timing import DAY, as_instant
from riskloom.schema import (
    CATEGORICAL, KEY, LABEL, LEAK_PREFIXES, LEAK_SUBSTRINGS, NEVER_FEATURES, number_or, numeric_columns,
    quoted, require, to_double,
)


def leaks(name: str) -> bool:
    """True for names that carry the target or counters behind it."""
    low = name.lower()
    return low.startswith(LEAK_PREFIXES) or any(part in low for part in LEAK_SUBSTRINGS)


@dataclass(frozen=True)
class Features:
    numeric: list[str]
    categorical: list[str]

    @property
    def all(self) -> list[str]:
        return self.categorical + self.numeric


def select_features(
    df: DataFrame,
    on_leak: str = "drop",
    never: Iterable[str] = NEVER_FEATURES,
    categorical: Iterable[str] = CATEGORICAL,
) -> Features:
    """Numeric and categorical model inputs, without leaking columns.

    ``on_leak="drop"`` removes leaking names.  ``"raise"`` removes those with
    a leak prefix and fails on any name containing a leak word.
    Only the schema is read.
    """
    chosen, offenders = _chosen(df, on_leak, never, categorical)
    if offenders:
        raise ValueError(f"possible leakage, forbidden column(s): {offenders}")
    return chosen


def _chosen(
    df: DataFrame, on_leak: str, never: Iterable[str] = NEVER_FEATURES, categorical: Iterable[str] = CATEGORICAL
) -> tuple[Features, list[str]]:
    """The features, and the names that a strict choice refuses."""
    if on_leak not in ("drop", "raise"):
        raise ValueError(f"on_leak must be drop or raise, not {on_leak!r}")
    cats = [c for c in categorical if c in df.columns]
    nums = numeric_columns(df, set(never) | set(cats))
    if on_leak == "drop":
        return Features([c for c in nums if not leaks(c)], [c for c in cats if not leaks(c)]), []
    nums = [c for c in nums if not c.lower().startswith(LEAK_PREFIXES)]
    return Features(nums, cats), sorted(c for c in cats + nums if any(part in c.lower() for part in LEAK_SUBSTRINGS))


def feature_table(df: DataFrame, on_leak: str = "drop") -> DataFrame:
    """How each column of ``df`` is used, with its count of missing values.

    With ``on_leak="raise"`` the columns that would stop a strict choice are
    ``forbidden``.  One aggregate over all columns; one row per column.
    """
    chosen, offenders = _chosen(df, on_leak)
    roles = {c: "numeric" for c in chosen.numeric} | {c: "categorical" for c in chosen.categorical} | {c: "forbidden" for c in offenders}
    lines = [(name, roles.get(name, "dropped")) for name in df.columns]
    counts = df.agg(F.count("*").alias("__n"), *[F.count(quoted(n)).alias(n) for n, _ in lines])
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.lit(role).alias("role"), (F.col("__n") - quoted(n)).alias("missing"))
            for n, role in lines
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _spread(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    measures = []
    for c in cols:
        v = quoted(c)
        if isinstance(df.schema[c].dataType, T.FractionalType):
            v = to_double(v)
        measures.append(F.coalesce(F.min(v) != F.max(v), F.lit(False)).alias(c))
    return df.agg(*measures)


def valid_columns(train: DataFrame, cols: Iterable[str]) -> list[str]:
    """Columns with at least two different values, in one pass and one row."""
    cols = list(cols)
    if not cols:
        return []
    row = _spread(train, cols).first()
    return [c for c in cols if row[c]]


def valid_column_table(train: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The same verdict as rows (column_name, is_valid)."""
    cols = list(cols)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).alias("is_valid")) for c in cols])
    return _spread(train, cols).select(F.explode(rows).alias("r")).select("r.*")


def align_features(df: DataFrame, wanted: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the ``wanted`` columns as numbers, in order: missing ones 0, extras dropped."""
    have = set(df.columns)
    inputs = [(number_or(quoted(c), 0) if c in have else F.lit(0.0)).alias(c) for c in wanted]
    return df.select(*[quoted(c) for c in keep], *inputs)


def feature_gap(df: DataFrame, wanted: Iterable[str], keep: Iterable[str] = ()) -> tuple[set[str], set[str]]:
    """Names the model wants but ``df`` lacks, and names it has to spare."""
    have, want = set(df.columns) - set(keep), set(wanted)
    return want - have, have - want


@dataclass(frozen=True)
class TimeCut:
    """End of the training part: all times before ``time``, and keys up to ``key`` at it."""

    rows: int
    time: Column | None = None
    key: object = None

    def is_train(self, time_col: str = "t0", key: str = KEY) -> Column:
        if self.rows == 0:
            return F.lit(False)
        t = F.col(time_col)
        return (t < self.time) | ((t == self.time) & (F.col(key) <= F.lit(self.key)))


def time_cut(df: DataFrame, share: float = 0.8, time_col: str = "t0", key: str = KEY) -> TimeCut:
    """Where the first ``int(share * n)`` rows by (time, key) end.

    Rows are counted per calendar day, so nothing is sorted globally; only the
    day, then the single time and its keys that straddle the cut are looked
    into.  The result is two literals: both sides of the split are plain
    filters that reach the scan.  Needs (key, time) to be unique; rows without
    a time come last.
    """
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    day = F.floor(micros / F.lit(DAY * 1_000_000))
    per_day = df.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"), F.min(micros).alias("lo"), F.max(micros).alias("hi")
    )
    # At most one row per calendar day is left for these windows.
    ends = per_day.withColumn("end", F.sum("n").over(Window.orderBy(F.asc_nulls_last("day"))))
    everything = Window.partitionBy()
    # Rows without a time count as the last ones; the cut lies among those with a time.
    timed = F.coalesce(F.sum(F.when(F.col("day").isNotNull(), F.col("n"))).over(everything), F.lit(0))
    rows = F.least(F.floor(F.sum("n").over(everything) * F.lit(float(share))), timed)
    home = (
        ends.withColumn("rows", rows)
        .filter(F.col("day").isNotNull() & (F.col("end") >= F.col("rows")) & (F.col("rows") > 0)).orderBy("day").first()
    )
    if home is None:
        return TimeCut(0)
    needed = home["rows"] - (home["end"] - home["n"])

    def instant(value: int) -> Column:
        return F.timestamp_micros(F.lit(value)).cast(df.schema[time_col].dataType)

    place = Place(home["lo"], needed, home["n"])
    if home["lo"] != home["hi"]:
        of_day = df.filter(F.col(time_col).between(instant(home["lo"]), instant(home["hi"])))
        place = nth_smallest_long(of_day, micros, needed)
    time = instant(place.value)
    bucket = df.filter(F.col(time_col) == time)
    if place.needed == place.equals:
        last = bucket.agg(F.max(key)).first()[0]
    else:
        last = nth_smallest(bucket, key, place.needed)
    return TimeCut(home["rows"], time, last)


def time_split(
    df: DataFrame, share: float = 0.8, time_col: str = "t0", key: str = KEY
) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by time position; rows without a readable time are test rows."""
    if isinstance(df.schema[time_col].dataType, T.StringType):
        df = df.withColumn(time_col, as_instant(df, time_col))
    train = time_cut(df, share, time_col, key).is_train(time_col, key)
    return df.filter(train), df.filter(~F.coalesce(train, F.lit(False)))


def undersample(
    train: DataFrame,
    ratio: float,
    y: str = LABEL,
    order_key: Column | None = None,
    seed: int = 42,
    at_least_one: bool = True,
    key: tuple[str, str] = (KEY, "t0"),
) -> DataFrame:
    """Keep all positives and exactly ``int(ratio * n)`` of the negatives.

    Negatives are kept by the smallest values of a 64-bit hash of their cell,
    so the choice depends neither on partitioning nor on retries.  The cut
    value comes from histograms, and the result is one filter over ``train``.
    """
    if not 0 < ratio < 1:
        return train
    order = order_key if order_key is not None else F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    positive, negative = F.col(y).cast("int") == 1, F.col(y).cast("int") == 0
    n = train.agg(F.count_if(negative).alias("neg"), F.count_if(positive).alias("pos")).first()
    keep = max(1, int(n["neg"] * ratio)) if at_least_one else int(n["neg"] * ratio)
    if n["neg"] == 0 or (at_least_one and n["pos"] == 0) or keep >= n["neg"]:
        return train
    if keep == 0:
        return train.filter(positive)
    # Equal hashes at the cut are told apart by further hashes, of the cell and of the row.
    orders = [
        order, F.xxhash64(*[F.col(c) for c in key], F.lit(seed + 1)),
        F.xxhash64(*[quoted(c) for c in train.columns], F.lit(seed + 2)),
    ]
    chosen, repeats = _smallest(train.filter(negative), orders, keep)
    kept = train.filter(positive | (negative & chosen))
    return kept if repeats is None else kept.unionByName(repeats)


def _smallest(rows: DataFrame, orders: list[Column], n: int) -> tuple[Column, DataFrame | None]:
    """A filter for the ``n`` rows first in lexicographic order of 64-bit keys.

    Rows equal in every key are interchangeable; if some of them are needed to
    reach ``n``, they come as a second frame.
    """
    place = nth_smallest_long(rows, orders[0], n)
    under, at = orders[0] < F.lit(place.value), orders[0] == F.lit(place.value)
    if place.needed == place.equals:
        return under | at, None
    if len(orders) == 1:
        return under, rows.filter(at).limit(place.needed)
    below, repeats = _smallest(rows.filter(at), orders[1:], place.needed)
    return under | (at & below), repeats


def median_values(df: DataFrame, cols: Iterable[str], sizes: dict[str, int] | None = None) -> dict[str, float]:
    """Exact medians (mean of the middle two) of the columns that have values."""
    found = exact_quantiles(df, {c: [0.5] for c in cols}, sizes)
    return {c: v[0] for c, v in found.items() if v[0] is not None}


def mode_values(df: DataFrame, cols: Iterable[str]) -> dict[str, float]:
    """Most frequent value per categorical column, the smallest among equals.

    Each column is counted by value with partial aggregation first; calendar
    categories have a few hundred values at most.
    """
    cols = list(cols)
    if not cols:
        return {}
    picks = F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).cast("double").alias("v")) for c in cols])
    counts = (
        df.select(F.explode(picks).alias("p")).select("p.c", "p.v").dropna()
        .groupBy("c", "v").agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("c").agg(F.max(F.struct("n", (-F.col("v")).alias("neg"))).alias("b"))
    return {r["c"]: -r["b"]["neg"] for r in best.collect()}  # one row per column


def fill_missing(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace NULL and NaN by the given value per column, keeping column types."""
    fills = {}
    for c, v in values.items():
        dtype = df.schema[c].dataType
        current = quoted(c)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            current = F.nanvl(current, F.lit(None).cast(dtype))
        # A median may be fractional where the column is whole: widen then.
        whole = isinstance(dtype, T.IntegralType) and float(v).is_integer()
        fills[c] = F.coalesce(current, F.lit(v).cast(dtype if whole or not isinstance(dtype, T.IntegralType) else "double"))
    return df.withColumns(fills) if fills else df
