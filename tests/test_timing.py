from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.timing import (
    add_calendar, anchored_bucket, auto_freq, bucket, future_starts, horizon_hours, local_day,
    parse_instant, week_start,
)

#: Text and its hours, worked out by hand; None: not a horizon.
HORIZONS = {
    "72h": 72, "30": 720, "2w": 336, "6m": 4320, "": 720, ".5d": 12, " 4\u00a0W ": 672, "1h30m": 1.5, "1 hour 30 minutes": 1.5,
    "36:00:00": 36, "-3d": -72, "-3": -3 / 3.6e12, "5.": 5, "1e3": 1000, "2 days 03:00:00": 51, "1w2d": 216, "1.5 days": 36,
    "90 min": 1.5, "1 day, 2 hours": 26, "02:30": None, "1h 30": None, "h": None, "3x": None, "1d-2h": None, "+3d": 72,
    "1 month": None, "1 m 2 s": 62 / 3600, "1.5h30m": 2, "1:2:3.5": 3723.5 / 3600, "12hr": 12, "12hrs": None, "7 sec": 7 / 3600,
    "1 us": 1e-6 / 3600, "2 mins": None, "2minutes": 2 / 60, "abc": None, "9 weeks": None,
}


def test_horizon_hours(spark):
    rows = spark.createDataFrame([(h,) for h in HORIZONS], "h string").select("h", horizon_hours(F.col("h")).alias("v"))
    got = {r["h"]: r["v"] for r in rows.collect()}
    for text, want in HORIZONS.items():
        assert (got[text] is None) == (want is None), text
        if want is not None:
            assert got[text] == pytest.approx(want, rel=1e-12), text


def test_auto_frequency_limits(spark):
    days = [(30.0,), (31.0,), (90.0,), (91.0,)]
    rows = spark.createDataFrame(days, "d double").select(auto_freq(F.col("d") * 24).alias("f")).collect()
    assert [r["f"] for r in rows] == ["1D", "1W", "1W", "1M"]


@pytest.mark.parametrize(
    "freq,hours,count",
    [("1D", 60.0, 3), ("1D", 24.0, 1), ("1D", 0.0, 0), ("1W", 720.0, 5), ("1M", 1080.0, 2), ("1M", 1.0, 1), ("1D", -5.0, 0)],
)
def test_future_starts(spark, freq, hours, count):
    now = datetime(2024, 2, 3, 10, 30)
    starts = spark.range(1).select(future_starts(F.lit(freq), F.lit(hours), now).cast("array<string>").alias("s")).first()["s"]
    step = {"1D": 1, "1W": 7, "1M": 30}[freq]
    first = pd.Timestamp(now if freq == "1M" else "2024-02-03")
    assert [pd.Timestamp(s) for s in starts] == [first + pd.Timedelta(days=step * i) for i in range(count)]


def test_weekly_starts_can_follow_the_training_weeks(spark):
    starts = spark.range(1).select(
        future_starts(F.lit("1W"), F.lit(336.0), datetime(2024, 2, 3), True).cast("array<string>").alias("s")
    ).first()["s"]
    assert starts == ["2024-02-01 00:00:00", "2024-02-08 00:00:00", "2024-02-15 00:00:00"]


def test_week_blocks_start_on_thursday(spark):
    rows = spark.createDataFrame([("2024-01-03 23:00:00",), ("2024-01-04 00:00:00",), ("1969-12-31 10:00:00",)], "t string")
    got = [r["w"] for r in rows.select(week_start(F.col("t").cast("timestamp")).cast("string").alias("w")).collect()]
    assert got == ["2023-12-28 00:00:00", "2024-01-04 00:00:00", "1969-12-25 00:00:00"]


def test_local_days_and_anchored_blocks_match_pandas_over_dst(spark):
    tz, now = "America/Los_Angeles", datetime(2024, 4, 2, 5, 0)
    hours = pd.date_range("2023-10-25", "2024-11-10", freq="7h", tz="UTC")
    df = spark.createDataFrame([(int(h.timestamp()),) for h in hours], "s long").withColumn("t", F.timestamp_seconds("s"))
    got = df.select(
        "s", F.unix_seconds(local_day(F.col("t"), tz)).alias("d"),
        F.unix_seconds(anchored_bucket(F.col("t"), "1W", now, tz)).alias("w"),
        F.unix_seconds(anchored_bucket(F.col("t"), "1M", now, tz)).alias("m"),
    ).toPandas().sort_values("s")
    local = hours.tz_convert(tz)
    assert list(got["d"]) == [int(x.timestamp()) for x in local.floor("D")]
    origin = pd.Timestamp(now, tz="UTC").tz_convert(tz).floor("D")
    for column, days in (("w", 7), ("m", 30)):
        width = days * 86400
        want = [int(origin.timestamp() + ((h - origin).total_seconds() // width) * width) for h in hours]
        assert list(got[column]) == want


def test_unknown_frequency_is_refused():
    with pytest.raises(ValueError):
        bucket(None, "3H")
    with pytest.raises(ValueError):
        anchored_bucket(None, "3H", datetime(2024, 1, 1))


def test_calendar_seasons_and_monday_zero(spark):
    days = spark.createDataFrame([("2024-01-01 05:00:00",), ("2024-04-07 23:00:00",), ("2024-12-31 00:00:00",)], "t string")
    out = add_calendar(days.select(F.col("t").cast("timestamp").alias("dt")), "dt", hourly=True).toPandas()
    assert list(out["day_of_week"]) == [0, 6, 1]
    assert list(out["season"]) == ["winter", "spring", "winter"]
    assert list(out["hour"]) == [5, 23, 0]


def test_time_text_is_parsed_row_by_row(spark):
    texts = ["2024/01/15 10:00:00 AM", "2024-01-15T10:00:00+02:00", "1/5/2024 3:04 PM", "1/5/2024 13:04:05", "2024-01-15", "bad", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_instant(F.col("t")).cast("string").alias("p"))
    assert [r["p"] for r in rows.collect()] == [
        "2024-01-15 10:00:00", "2024-01-15 08:00:00", "2024-01-05 15:04:00", "2024-01-05 13:04:05", "2024-01-15 00:00:00",
        None, None,
    ]
