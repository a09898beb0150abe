"""Column names, fixed values and schema helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "GEOID"
LABEL = "Y_label"
COUNT = "crime_count"

# Names and limits that users' files and reports rely on.
SIDE_FEATURES = [
    "neighbor_crime_24h", "neighbor_crime_72h", "neighbor_crime_7d",
    "911_geo_hr_last3d", "911_geo_hr_last7d", "311_request_count",
    "hr_cnt", "daily_cnt",
    "wx_tavg", "wx_tmin", "wx_tmax", "wx_prcp", "wx_temp_range", "wx_is_rainy", "wx_is_hot_day",
    "poi_total_count", "poi_risk_score",
    "poi_count_300m", "poi_risk_300m", "poi_count_600m", "poi_risk_600m", "poi_count_900m", "poi_risk_900m",
    "distance_to_police", "distance_to_government_building",
    "bus_stop_count", "train_stop_count", "population",
]
FORECAST_FEATURES = [
    "wx_tavg", "wx_prcp", "wx_tmin", "wx_tmax", "wx_temp_range", "wx_is_rainy", "wx_is_hot_day",
    "poi_total_count", "poi_count_300m", "poi_count_600m", "poi_count_900m",
    "poi_risk_score", "poi_risk_300m", "poi_risk_600m", "poi_risk_900m",
    "bus_stop_count", "train_stop_count", "population",
    "neighbor_crime_24h", "neighbor_crime_72h", "neighbor_crime_7d",
    "daily_cnt", "311_request_count", "911_geo_hr_last3d", "911_geo_hr_last7d",
    "distance_to_police", "distance_to_government_building",
]
PRIOR_FAMILIES = [("28d", "180d"), ("3m", "12m")]
LEAK_PREFIXES = ("risk_", "metrics_")
LEAK_SUBSTRINGS = ("y_label", "ylabel", "label", "crime_count", "hr_cnt", "daily_cnt")
NEVER_FEATURES = {"GEOID", "t0", "Y_label", "dt_local", "crime_count", "hr_cnt", "daily_cnt"}
CATEGORICAL = ["year", "month", "day_of_week", "block_id"]
DAILY_PROTECTED = {
    "GEOID", "t0", "t0_local", "Y_label", "year", "month", "day_of_week",
    "hour_start", "block_id", "crime_count",
}
HOURLY_PROTECTED = DAILY_PROTECTED | {"dt", "hour", "season"}
TIER_LABELS = ["Çok Yüksek", "Yüksek", "Orta", "Düşük", "Çok Düşük"]
TIER_FALLBACK = [0.8, 0.6, 0.4, 0.2]
RISK_TABLE_COLUMNS = ["geoid", "hour", "risk_score"]
METRIC_TABLE_COLUMNS = ["model", "metric", "value", "fold", "timestamp"]
FREQUENCIES = ["1D", "1W", "1M"]


def require(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Return ``df`` if it has all ``columns``, else raise ``ValueError``."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; found {df.columns}")
    return df


def quoted(name: str) -> Column:
    """Column by exact name; names such as ``311_request_count`` need no escape."""
    return F.col("`" + name.replace("`", "``") + "`")


def _is_number(data_type: T.DataType) -> bool:
    # A boolean side feature is averaged as 0/1, so it counts as a number here.
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric (or boolean) columns of ``df`` outside ``exclude``, in schema order."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and _is_number(f.dataType)]


def to_double(column: Column) -> Column:
    """Lenient number: anything that does not parse, and NaN, becomes NULL."""
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def number_or(column: Column, default: float) -> Column:
    """Lenient number with a default for everything that does not parse."""
    return F.coalesce(to_double(column), F.lit(float(default)))


def int_or(column: Column, default: int, dtype: str = "int") -> Column:
    """Lenient integer cast with a sentinel (-1 in grids, 0 in forecasts)."""
    return F.coalesce(to_double(column).try_cast(dtype), F.lit(default).cast(dtype))


def label(count: Column) -> Column:
    """1 where at least one incident happened, else 0."""
    return (number_or(count, 0) > 0).cast("tinyint")


def normalize_key(df: DataFrame) -> DataFrame:
    """One string key column ``GEOID`` (or its alias ``geoid``), null keys dropped.

    A whole floating point key reads like an integer (60750101.0 as
    ``60750101``); any other keeps its fraction, so 1.2 and 1.8 stay apart.
    """
    names = df.columns
    if KEY not in names and "geoid" not in names:
        raise ValueError("no GEOID/geoid column")
    if KEY in names and "geoid" in names:
        # Spark resolves names without case, so the alias has to go first.
        df = df.toDF(*["__alias" if n == "geoid" else n for n in names]).drop("__alias")
    elif KEY not in names:
        df = df.withColumnRenamed("geoid", KEY)
    key = F.col(KEY)
    if isinstance(df.schema[KEY].dataType, T.FractionalType):
        whole = key.try_cast("bigint")
        key = F.when(whole == key, whole.cast("string")).otherwise(key.cast("string"))
    return df.withColumn(KEY, key.cast("string")).dropna(subset=[KEY])
