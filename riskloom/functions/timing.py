"""Time columns: parsing, local time, calendar, buckets and horizons.

All functions build Column expressions, so they stay inside code generation
and filters on them can be combined with the scan.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import quoted

DAY = 86_400
# Accepted text layouts beside ISO-8601, tried in this order.
TIME_PATTERNS = [
    "yyyy/MM/dd hh:mm:ss a",
    "yyyy/MM/dd H:mm[:ss]",
    "M/d/yyyy h:mm[:ss] a",
    "M/d/yyyy H:mm[:ss]",
    "M/d/yyyy",
]


def as_instant(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a UTC timestamp; what does not parse becomes NULL.

    Numbers count nanoseconds since the epoch.
    """
    data_type = df.schema[name].dataType
    column = quoted(name)
    if isinstance(data_type, T.StringType):
        return parse_instant(column)
    if isinstance(data_type, T.NumericType):
        # Whole-number division: a double cannot hold today's nanoseconds.
        return F.timestamp_micros(F.expr(f"try_cast(`{name}` AS BIGINT) div 1000"))
    return column.try_cast("timestamp")


def parse_instant(text: Column) -> Column:
    """Text to UTC timestamp, row by row, ISO first and then the listed layouts."""
    return F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(p)) for p in TIME_PATTERNS]
    )


def epoch_micros(moment: datetime) -> int:
    """Microseconds since the epoch; a naive ``moment`` is UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * DAY + delta.seconds) * 1_000_000 + delta.microseconds


def instant_literal(moment: datetime) -> Column:
    return F.timestamp_micros(F.lit(epoch_micros(moment)))


def floor_hour(instant: Column) -> Column:
    return F.date_trunc("hour", instant)


def floor_day(instant: Column) -> Column:
    return F.date_trunc("day", instant)


def local_time(instant: Column, tz: str | None) -> Column:
    """Wall clock in ``tz`` (held in a UTC-session timestamp); UTC without ``tz``."""
    return F.from_utc_timestamp(instant, tz) if tz else instant


def local_day(instant: Column, tz: str | None) -> Column:
    """Start of the local calendar day, as a UTC instant."""
    midnight = floor_day(local_time(instant, tz))
    return F.to_utc_timestamp(midnight, tz) if tz else midnight


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isNotNull(), "fall")
    )


def add_calendar(
    df: DataFrame,
    time_col: str,
    tz: str | None = None,
    hourly: bool = False,
    hour_start: str | None = None,
    keep_local: bool = True,
) -> DataFrame:
    """Year, month, day of week (Monday = 0); hour and season in hourly grids.

    ``hour_start`` adds the bucket's first hour: ``"zero"`` for whole-day
    buckets, ``"clock"`` for the wall clock hour.
    """
    wall = local_time(F.col(time_col), tz)
    out = {
        "year": F.year(wall).cast("smallint"),
        "month": F.month(wall).cast("tinyint"),
        "day_of_week": F.weekday(wall).cast("tinyint"),
    }
    if hourly:
        out["hour"] = F.hour(wall).cast("tinyint")
        out["season"] = season(F.month(wall))
    if hour_start:
        out["hour_start"] = (F.lit(0) if hour_start == "zero" else F.hour(wall)).cast("tinyint")
    if tz and keep_local:
        out[f"{time_col}_local"] = wall.cast("timestamp_ntz")
    return df.withColumns(out)


def block_start(instant: Column, days: int, anchor_seconds: int = 0) -> Column:
    """Start of the ``days``-long block holding ``instant``, counted from an anchor."""
    seconds = F.unix_seconds(instant)
    width = days * DAY
    return F.timestamp_seconds(seconds - F.pmod(seconds - F.lit(anchor_seconds), F.lit(width)))


def week_start(instant: Column) -> Column:
    """Fixed 7-day blocks from the epoch, hence starting on Thursdays."""
    return block_start(instant, 7)


def month_start(instant: Column) -> Column:
    return F.date_trunc("month", instant)


def bucket(instant: Column, freq: str) -> Column:
    """UTC bucket start for ``1D``, ``1W`` or ``1M``."""
    starts = {"1D": floor_day, "1W": week_start, "1M": month_start}
    if freq not in starts:
        raise ValueError(f"unknown frequency {freq!r}")
    return starts[freq](instant)


def run_day_anchor(as_of: datetime, tz: str | None) -> int:
    """Epoch seconds of local midnight on the run day."""
    aware = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    wall = aware.astimezone(ZoneInfo(tz) if tz else timezone.utc)
    midnight = wall.replace(hour=0, minute=0, second=0, microsecond=0)
    return int(midnight.timestamp())


def anchored_bucket(instant: Column, freq: str, as_of: datetime, tz: str | None = None) -> Column:
    """Local calendar day for 1D; 7- or 30-day blocks from the run day for 1W/1M."""
    if freq == "1D":
        return local_day(instant, tz)
    widths = {"1W": 7, "1M": 30}
    if freq not in widths:
        raise ValueError(f"unknown frequency {freq!r}")
    return block_start(instant, widths[freq], run_day_anchor(as_of, tz))


# Hours per horizon suffix (a month is 30 days, bare numbers are days).
HORIZON_UNITS = {"h": 1.0, "d": 24.0, "w": 168.0, "m": 720.0, "": 24.0}
# Seconds per unit in spelled-out durations (here ``m`` is minutes).
DURATION_UNITS = {
    ("w",): 604_800.0,
    ("d", "day", "days"): 86_400.0,
    ("h", "hr", "hour", "hours"): 3_600.0,
    ("m", "min", "minute", "minutes"): 60.0,
    ("s", "sec", "second", "seconds"): 1.0,
    ("ms", "milli", "millis", "millisecond", "milliseconds"): 1e-3,
    ("us", "micro", "micros", "microsecond", "microseconds"): 1e-6,
    ("ns", "nano", "nanos", "nanosecond", "nanoseconds"): 1e-9,
}
DEFAULT_HORIZON_HOURS = 720.0


def _duration_hours(text: Column) -> Column:
    """Hours in texts such as ``1h30m``, ``2 days 03:00:00`` or ``-3d``, else NULL."""
    names = sorted((n for group in DURATION_UNITS for n in group), key=len, reverse=True)
    unit = "|".join(names)
    part = rf"([0-9]*\.?[0-9]+)\s*({unit})(?![a-z])"
    clock = r"[0-9]+:[0-9]+:[0-9]+(?:\.[0-9]+)?"
    whole = rf"^[+-]?\s*(?:{part}[\s,]*)*(?:{clock})?$"
    numbers = F.regexp_extract_all(text, F.lit(part), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(part), F.lit(2))
    pairs = F.arrays_zip(numbers.alias("n"), units.alias("u"))

    def seconds(pair: Column) -> Column:
        scale = F.lit(None).cast("double")
        for group, size in DURATION_UNITS.items():
            scale = F.when(pair["u"].isin(*group), F.lit(size)).otherwise(scale)
        return pair["n"].cast("double") * scale

    spelled = F.aggregate(pairs, F.lit(0.0), lambda total, pair: total + seconds(pair))
    fields = F.split(F.regexp_extract(text, rf"({clock})$", 1), ":")
    on_clock = F.coalesce(
        fields[0].try_cast("double") * 3600
        + F.get(fields, F.lit(1)).try_cast("double") * 60
        + F.get(fields, F.lit(2)).try_cast("double"),
        F.lit(0.0),
    )
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(text.rlike(r"^[+-][0-9]+$"), text.try_cast("double") / 3.6e12)  # bare signed: ns
        .when(text.rlike(whole) & text.rlike("[0-9]"), sign * (spelled + on_clock) / 3600)
    )


def horizon_hours(text: Column) -> Column:
    """Forecast horizon text to hours.

    A number with ``h/d/w/m`` or no suffix (days), an empty text (30 days), a
    spelled-out duration, or a plain number of hours.  Anything else is NULL.
    """
    raw = F.coalesce(text.cast("string"), F.lit(""))
    clean = F.lower(F.trim(F.replace(raw, F.lit("\u00a0"), F.lit(" "))))
    short = r"^\s*([0-9]*\.?[0-9]+)\s*([hdwm]?)\s*$"
    suffix = F.regexp_extract(clean, short, 2)
    scale = F.lit(HORIZON_UNITS[""])
    for name, hours in HORIZON_UNITS.items():
        if name:
            scale = F.when(suffix == name, F.lit(hours)).otherwise(scale)
    return (
        F.when(raw == "", F.lit(DEFAULT_HORIZON_HOURS))
        .when(clean.rlike(short), F.regexp_extract(clean, short, 1).try_cast("double") * scale)
        .otherwise(F.coalesce(_duration_hours(clean), clean.try_cast("double")))
    )


def auto_freq(hours: Column) -> Column:
    """Up to 30 days 1D, up to 90 days 1W, longer 1M."""
    return (
        F.when(hours <= 30 * 24.0, "1D").when(hours <= 90 * 24.0, "1W").when(hours.isNotNull(), "1M")
    )


def future_starts(freq: Column, hours: Column, as_of: datetime, align_to_epoch_week: bool = False) -> Column:
    """Array of future bucket starts for a request (empty if the horizon is too short).

    1D and 1W count from the start of the run day; 1M steps 30 days from the
    run moment itself and always has at least one step.  With
    ``align_to_epoch_week`` weekly starts fall on the same Thursdays as the
    weekly training grid.
    """
    now = instant_literal(as_of)
    today = floor_day(now)
    first_week = week_start(today) if align_to_epoch_week else today
    lead_in = F.unix_seconds(today) - F.unix_seconds(first_week)
    span = F.ceil(hours * 3600)

    def steps(count: Column, start: Column, width_days: int) -> Column:
        index = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
            F.array().cast("array<int>")
        )
        micros = F.unix_micros(start)
        return F.transform(index, lambda i: F.timestamp_micros(micros + i.cast("bigint") * (width_days * DAY * 1_000_000)))

    return (
        F.when(freq == "1D", steps(F.ceil(span / DAY), today, 1))
        .when(freq == "1W", steps(F.ceil((span + lead_in) / (7 * DAY)), first_week, 7))
        .when(freq == "1M", steps(F.greatest(F.lit(1), F.ceil(hours / 720.0)), now, 30))
    )
