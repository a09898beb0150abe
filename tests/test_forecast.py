from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import forecast
from riskloom.operators.forecast import (
    add_tier, carried_columns, forecast_frame, last_snapshot, plan_requests, ranked_forecast, tier_limits, top_k,
)

NOW = datetime(2024, 2, 3, 10, 30)


def grid(spark):
    rows = [
        ("a", "2024-01-01", 1, 0.1, 5.0), ("a", "2024-01-02", 2, 0.2, None), ("b", "2024-01-02", 3, 0.3, 7.0),
        ("c", "2024-01-01", 4, 0.4, 9.0),
    ]
    df = spark.createDataFrame(rows, "GEOID string, t0 string, crime_count long, prior double, wx_tavg double")
    return df.withColumn("t0", F.col("t0").cast("timestamp"))


def test_snapshot_is_the_latest_row(spark, plan_of):
    snap = last_snapshot(grid(spark), ["crime_count", "wx_tavg"])
    assert sorted(tuple(r) for r in snap.collect()) == [("a", 2, None), ("b", 3, 7.0), ("c", 4, 9.0)]
    assert "Window" not in plan_of(snap)
    with pytest.raises(ValueError):
        last_snapshot(grid(spark), ["nope"])


def test_dense_snapshot_reads_only_the_last_time(spark, plan_of, tmp_path):
    days = spark.range(300).select(
        (F.col("id") % 30).cast("string").alias("GEOID"), F.timestamp_seconds(F.floor(F.col("id") / 30) * 86400).alias("t0"),
        F.col("id").alias("crime_count"),
    )
    days.write.parquet(str(tmp_path / "dense"))
    stored = spark.read.parquet(str(tmp_path / "dense"))
    fast, slow = (last_snapshot(stored, ["crime_count"], dense=d) for d in (True, False))
    assert sorted(fast.collect()) == sorted(slow.collect()) and fast.count() == 30
    assert "Aggregate(keys=[GEOID" not in plan_of(fast)


def test_carried_columns_take_one_prior_family(spark):
    both = [f"prior_{k}_{s}" for s in ("3m", "12m", "28d", "180d") for k in ("cnt", "p")]
    assert carried_columns(both + ["wx_tavg", "other"]) == [
        "crime_count", "prior_cnt_28d", "prior_p_28d", "prior_cnt_180d", "prior_p_180d", "wx_tavg",
    ]
    assert "prior_p_3m" in carried_columns(both[:4]) and carried_columns(both[:3]) == ["crime_count"]


def test_frame_is_areas_times_starts_with_medians(spark, plan_of):
    frame = forecast_frame(grid(spark), "1D", 60.0, NOW)
    assert "CartesianProduct" not in plan_of(frame) and "NestedLoop" not in plan_of(frame)
    out = frame.toPandas()
    assert len(out) == 9 and not out.duplicated(["GEOID", "t0"]).any()
    assert out[out["GEOID"] == "a"]["wx_tavg"].unique().tolist() == [8.0]
    assert sorted(out["day_of_week"].unique()) == [0, 5, 6]
    one = forecast_frame(grid(spark), "1M", 24.0, NOW, area="b").toPandas()
    assert len(one) == 1 and one["crime_count"][0] == 3


def test_unknown_area_and_short_horizon_fail(spark):
    with pytest.raises(ValueError):
        forecast_frame(grid(spark), "1D", 24.0, NOW, area="zz")
    with pytest.raises(ValueError):
        forecast_frame(grid(spark), "1D", 0.0, NOW)


def scores(spark, values, t0="2024-01-01"):
    rows = [(f"a{i:05d}", t0, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "GEOID string, t0 string, prob double")
    return df.withColumns({"t0": F.col("t0").cast("timestamp"), "prob": F.col("prob").cast("float")})


def test_tiers(spark):
    five = add_tier(scores(spark, [0.1, 0.2, 0.3, 0.4, 0.7])).orderBy("prob").collect()
    assert [r["tier_rank"] for r in five] == [5, 4, 3, 2, 1]
    assert [r["tier"] for r in five] == ["Çok Düşük", "Düşük", "Orta", "Yüksek", "Çok Yüksek"]
    four = add_tier(scores(spark, [0.1, 0.45, 0.65, 0.95])).orderBy("prob").collect()
    assert [r["tier_rank"] for r in four] == [5, 3, 2, 1]
    assert tier_limits(scores(spark, [0.1] * 4)) == [0.8, 0.6, 0.4, 0.2]
    assert [r["tier_rank"] for r in add_tier(scores(spark, [0.5] * 6)).collect()] == [1] * 6


def test_tiers_fall_with_the_score(spark):
    values = np.random.default_rng(0).random(500)
    ranks = [r["tier_rank"] for r in add_tier(scores(spark, values)).orderBy(F.desc("prob")).collect()]
    assert ranks == sorted(ranks) and set(ranks) == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("k", [1, 7, 40])
@pytest.mark.parametrize("limit", [1000, 5])
def test_top_k_ties_and_salted_path(spark, monkeypatch, k, limit):
    monkeypatch.setattr(forecast, "GROUP_LIMIT", limit)
    values = np.random.default_rng(1).integers(0, 20, 300) / 20
    df = scores(spark, values).unionByName(scores(spark, values[::-1], "2024-01-02"))
    got = top_k(df, k).toPandas().sort_values(["t0", "GEOID"])
    frame = df.toPandas().sort_values(["t0", "prob", "GEOID"], ascending=[True, False, True])
    want = frame.groupby("t0").head(k).sort_values(["t0", "GEOID"])
    assert got["GEOID"].tolist() == want["GEOID"].tolist() and len(got) == 2 * k
    assert top_k(df, 0).count() == 600


def test_top_k_is_pruned_before_the_shuffle(spark, plan_of):
    plan = plan_of(top_k(scores(spark, [0.1, 0.2]), 5))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_ranked_forecast_order(spark):
    out = ranked_forecast(scores(spark, [0.3, 0.9, 0.9, 0.1, 0.5]), 3).collect()
    assert [r["GEOID"] for r in out] == ["a00001", "a00002", "a00004"]


def test_requests_get_hours_and_frequency(spark):
    rows = spark.createDataFrame([("45d",), ("6m",), ("oops",)], "horizon string")
    got = [(r["hours"], r["freq"]) for r in plan_requests(rows).collect()]
    assert got == [(1080.0, "1W"), (4320.0, "1M"), (None, None)]


def test_snapshot_of_a_hot_area(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")).alias("GEOID"),
        F.timestamp_seconds(F.col("id") * 60).alias("t0"), F.col("id").alias("crime_count"),
    )
    got = {r["GEOID"]: r["crime_count"] for r in last_snapshot(df, ["crime_count"]).collect()}
    want = df.toPandas().groupby("GEOID")["crime_count"].max().to_dict()
    assert got == want
