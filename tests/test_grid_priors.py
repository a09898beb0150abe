from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.timing import add_calendar, week_start
from riskloom.operators.counts import count_incidents, join_side_features, label_stats
from riskloom.operators.grid import dense_grid
from riskloom.operators.priors import add_priors
from riskloom.operators.rollup import rollup
from riskloom.plans.build import coarse_grid, frequency_grids, labelled_panel, normalize_daily, window_grid
from riskloom.schema import normalize_key


def instants(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("t0", "dt") if c in df.columns})


def random_panel(spark, areas=6, days=260, seed=3, keep=0.6):
    rng = np.random.default_rng(seed)
    rows = [
        (f"a{a}", str(pd.Timestamp("2023-01-01") + pd.Timedelta(days=int(d))), int(rng.random() < 0.3))
        for a in range(areas) for d in range(days) if rng.random() < keep
    ]
    return add_calendar(instants(spark, rows, "GEOID string, t0 string, Y_label int"), "t0")


def pandas_prior(frame, days, shifted):
    """Counted from the definition: every row looks at all rows of its group."""
    width = pd.Timedelta(days=days)
    rows = []
    for row in frame.itertuples(index=False):
        peers = frame[(frame["GEOID"] == row.GEOID) & (frame["day_of_week"] == row.day_of_week)]
        earlier = peers[peers["t0"] < row.t0]
        if shifted:
            before = earlier["t0"].max()
            seen = earlier[(earlier["t0"] > before - width) & (earlier["t0"] <= before)]
            cnt, of = float(seen["Y_label"].sum()), days * 24
        else:
            seen = earlier[earlier["t0"] >= row.t0 - width]
            cnt, of = float(seen["Y_label"].sum()), max(1, len(seen))
        rows.append((cnt, cnt / of))
    out = frame.assign(cnt=[c for c, _ in rows], p=[p for _, p in rows])
    return out.sort_values(["GEOID", "t0"]).reset_index(drop=True)


@pytest.mark.parametrize("mode", ["closed_left", "shifted_hours"])
@pytest.mark.parametrize("days", [28, 90])
def test_priors_equal_pandas_rolling(spark, mode, days):
    panel = random_panel(spark)
    got = add_priors(panel, {"x": days}, mode=mode, unique_cells=True).toPandas().sort_values(["GEOID", "t0"])
    want = pandas_prior(panel.toPandas(), days, mode == "shifted_hours")
    assert np.array_equal(got["prior_cnt_x"].to_numpy(), want["cnt"].to_numpy())
    assert np.allclose(got["prior_p_x"].to_numpy(), want["p"].to_numpy(), rtol=1e-12)


def test_window_edges_first_row_and_week_steps(spark):
    rows = [("a", f"2024-{m:02d}-{d:02d}", 1) for m, d in ((1, 4), (1, 11), (1, 18), (1, 25), (2, 1), (2, 8), (2, 15))]
    out = add_priors(instants(spark, rows, "GEOID string, t0 string, Y_label int"), {"28d": 28}, keys=())
    assert [r["prior_cnt_28d"] for r in out.orderBy("t0").collect()] == [0, 1, 2, 3, 4, 4, 4]
    assert out.orderBy("t0").first()["prior_p_28d"] == 0


def test_equal_times_do_not_see_each_other_but_both_count_later(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-01", 1), ("a", "2024-01-02", 0)]
    df = instants(spark, rows, "GEOID string, t0 string, Y_label int")
    for unique in (True, False):
        out = add_priors(df, {"28d": 28}, keys=(), unique_cells=unique).orderBy("t0").collect()
        assert [r["prior_cnt_28d"] for r in out] == [0, 0, 2]
        assert len(out) == 3


def test_shifted_prior_after_a_gap_uses_the_previous_rows_window(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-08", 1), ("a", "2024-03-08", 0)]
    df = instants(spark, rows, "GEOID string, t0 string, Y_label int")
    out = add_priors(df, {"28d": 28}, keys=(), mode="shifted_hours").orderBy("t0").collect()
    assert [r["prior_cnt_28d"] for r in out] == [0, 1, 2]
    assert out[2]["prior_p_28d"] == pytest.approx(2 / 672)


def test_label_at_t_never_changes_priors_up_to_t(spark):
    panel = random_panel(spark, areas=2, days=120)
    when = "2023-03-01"
    changed = panel.withColumn("Y_label", F.when(F.col("t0") >= when, 1 - F.col("Y_label")).otherwise(F.col("Y_label")))
    before, after = (
        add_priors(p, {"28d": 28}).filter(F.col("t0") <= when).orderBy("GEOID", "t0").drop("Y_label").collect()
        for p in (panel, changed)
    )
    assert before == after


def test_rebuilding_from_a_date_gives_the_same_rows(spark):
    panel = random_panel(spark, areas=3)
    since = datetime(2023, 7, 1)
    full = add_priors(panel, {"28d": 28, "90d": 90}).filter(F.col("t0") >= "2023-07-01").orderBy("GEOID", "t0").collect()
    part = add_priors(panel, {"28d": 28, "90d": 90}, since=since).orderBy("GEOID", "t0").collect()
    assert full == part and len(part) > 50


def test_label_is_derived_from_counts_when_missing(spark):
    rows = [("a", "2024-01-01", 3), ("a", "2024-01-08", 0)]
    out = add_priors(instants(spark, rows, "GEOID string, t0 string, crime_count int"), {"28d": 28}, keys=())
    assert [r["Y_label"] for r in out.orderBy("t0").collect()] == [1, 0]
    with pytest.raises(ValueError):
        add_priors(instants(spark, [("a", "2024-01-01")], "GEOID string, t0 string"), {"28d": 28})


def test_dense_grid_has_every_step_once(spark):
    rows = [("a", "2024-01-03", 2, 5.0), ("a", "2024-01-06", 1, None), ("b", "2024-01-01", 4, 1.0), ("c", "2024-01-08", 1, 2.0)]
    cells = instants(spark, rows, "GEOID string, t0 string, crime_count long, temp double")
    grid = dense_grid(cells, "t0", zero_filled=("crime_count",)).toPandas()
    assert len(grid) == 3 * 8 and not grid.duplicated(["GEOID", "t0"]).any()
    assert grid["crime_count"].sum() == 8
    assert grid["temp"].notna().sum() == 3
    assert grid.groupby("GEOID")["t0"].agg(["min", "max"]).nunique().tolist() == [1, 1]


def test_dense_grid_within_given_days(spark):
    rows = [("a", "2024-01-01", 2), ("a", "2024-01-05", 1), ("b", "2024-01-09", 4)]
    cells = instants(spark, rows, "GEOID string, t0 string, crime_count long")
    span = (datetime(2024, 1, 3, 15), datetime(2024, 1, 10))
    grid = dense_grid(cells, "t0", span, ("crime_count",), partitions=3)
    assert grid.count() == 2 * 8 and grid.agg(F.sum("crime_count")).first()[0] == 5
    assert grid.rdd.getNumPartitions() == 3


def test_dense_grid_of_nothing_is_empty(spark):
    cells = instants(spark, [], "GEOID string, t0 string, crime_count long")
    assert dense_grid(cells, "t0", zero_filled=("crime_count",)).count() == 0


def test_panel_plan_shuffles_only_sparse_cells(spark, plan_of):
    raw = spark.createDataFrame([("a", "2024-01-01 03:00:00", 1.0)], "geoid string, datetime string, temp double")
    panel = labelled_panel(raw, side_cols=["temp"], span=(datetime(2024, 1, 1), datetime(2024, 2, 1)))
    plan = plan_of(panel)
    assert plan.count("Exchange hashpartitioning") == 2  # by cell, then by area
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")  # dense rows above both
    assert plan.count("Window [") == 2 and "Python" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_two_windows_share_one_node(spark, plan_of):
    plan = plan_of(add_priors(random_panel(spark, 1, 5), {"28d": 28, "180d": 180}, unique_cells=True))
    assert plan.count("Window [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_hot_area_gives_the_same_counts(spark):
    """One area holds a third of all rows; results equal a plain pandas count."""
    n = 30_000
    area = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1)
    raw = spark.range(n).select(
        area.alias("geoid"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % (40 * 86400)).alias("datetime"),
        (F.col("id") % 10).cast("double").alias("temp"),
    )
    got = labelled_panel(raw, side_cols=["temp"]).toPandas().sort_values(["GEOID", "t0"]).reset_index(drop=True)
    frame = raw.toPandas()
    frame["t0"] = frame["datetime"].dt.floor("D")
    cells = frame.groupby([frame["geoid"].astype(str), "t0"]).agg(n=("temp", "size"), temp=("temp", "mean"))
    index = pd.MultiIndex.from_product([sorted(frame["geoid"].astype(str).unique()), pd.date_range(frame["t0"].min(), frame["t0"].max())])
    want = cells.reindex(index)
    assert got["crime_count"].tolist() == want["n"].fillna(0).astype(int).tolist()
    assert np.allclose(got["temp"].to_numpy(float), want["temp"].to_numpy(), equal_nan=True)


def test_hourly_panel_has_season_and_hour_keys(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-01 03:10:00"), ("a", "2024-01-08 03:50:00"), ("b", "2024-01-08 04:00:00")], "geoid string, datetime string"
    )
    out = labelled_panel(raw, "hourly", side_cols=[]).filter("GEOID = 'a' AND dt = '2024-01-08 03:00:00'").first()
    assert (out["hour"], out["season"], out["prior_cnt_3m"], out["prior_p_3m"]) == (3, "winter", 1.0, 1.0)


def test_counts_given_or_counted_and_null_keys_dropped(spark):
    raw = spark.createDataFrame(
        [(1.0, "2024-01-01 03:10:00", "2"), (1.0, "2024-01-01 03:20:00", "x"), (None, "2024-01-01 03:00:00", "5"), (2.0, None, "1")],
        "geoid double, dt string, crime_count string",
    ).withColumn("dt", F.date_trunc("hour", F.col("dt").cast("timestamp")))
    keyed = normalize_key(raw)
    assert [(r["GEOID"], r["crime_count"]) for r in count_incidents(keyed, "hourly").collect()] == [("1", 2)]
    assert count_incidents(keyed.drop("crime_count"), "daily").first()["crime_count"] == 2


def test_side_feature_rules(spark):
    rows = [("a", "2024-01-01 01:00:00", 2.0, 4.0), ("a", "2024-01-01 05:00:00", 3.0, None), ("a", "2024-01-02 05:00:00", None, None)]
    raw = instants(spark, rows, "GEOID string, dt string, bus_stop_count double, temp double")
    base = count_incidents(raw, "daily").select("GEOID", "t0")
    out = join_side_features(base, raw, ["bus_stop_count", "temp", "absent"], "daily").orderBy("t0").collect()
    assert [(r["bus_stop_count"], r["temp"]) for r in out] == [(5.0, 4.0), (0.0, None)]
    hourly = count_incidents(raw, "hourly").select("GEOID", "dt")
    first = join_side_features(hourly, raw, ["bus_stop_count"], "hourly").orderBy("dt").first()
    assert first["bus_stop_count"] == 2.0


def test_rollup_sums_counts_and_averages_the_rest(spark):
    rows = [("a", "2024-01-04", 2, 4.0, True), ("a", "2024-01-05", 0, None, False), ("a", "2024-01-11", 0, 8.0, None)]
    daily = normalize_daily(instants(spark, rows, "GEOID string, t0 string, crime_count long, temp double, rainy boolean"))
    week = coarse_grid(daily, "1W").orderBy("t0").collect()
    assert [(r["crime_count"], r["temp"], r["rainy"], r["Y_label"]) for r in week] == [(2, 4.0, 0.5, 1), (0, 8.0, None, 0)]
    assert [r["prior_cnt_28d"] for r in week] == [0, 1]


def test_weekly_counts_add_up_to_daily(spark):
    rng = np.random.default_rng(1)
    rows = [(f"a{i % 3}", str(pd.Timestamp("2024-01-01") + pd.Timedelta(days=i // 3)), int(rng.integers(0, 4))) for i in range(180)]
    grids = frequency_grids(instants(spark, rows, "GEOID string, t0 string, crime_count long"), ["1d", "1W", "1M"])
    totals = {f: g.agg(F.sum("crime_count")).first()[0] for f, g in grids.items()}
    assert len(set(totals.values())) == 1
    with pytest.raises(ValueError):
        frequency_grids(grids["1D"], ["3H"])


def test_unparsable_daily_time_fails_strictly(spark):
    df = spark.createDataFrame([("a", "nonsense", 1)], "GEOID string, t0 string, crime_count int")
    with pytest.raises(Exception, match="unparsable"):
        normalize_daily(df).collect()


def test_window_grid_keeps_block_id_and_local_calendar(spark):
    rows = [("a", "2024-01-02 07:00:00", 1, 1), ("a", "2024-01-02 09:00:00", 1, 1), ("a", "2024-01-02 09:00:00", 2, 2)]
    hourly = instants(spark, rows, "GEOID string, dt string, crime_count long, block_id int")
    out = window_grid(hourly, "1D", datetime(2024, 2, 1), "America/Los_Angeles").orderBy("t0", "block_id")
    out = out.withColumn("t0", F.col("t0").cast("string")).collect()
    assert [(r["t0"], r["block_id"], r["crime_count"], r["day_of_week"], r["hour_start"]) for r in out] == [
        ("2024-01-01 08:00:00", 1, 1, 0, 0), ("2024-01-02 08:00:00", 1, 1, 1, 0), ("2024-01-02 08:00:00", 2, 2, 1, 0),
    ]


def test_rollup_without_numbers_keeps_the_cells(spark):
    df = instants(spark, [("a", "2024-01-01", "x"), ("a", "2024-01-01", "y")], "GEOID string, t0 string, note string")
    assert rollup(df, F.col("t0")).select("GEOID", "Y_label").collect() == [("a", 0)]


def test_label_stats_always_has_both_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (1,)], "Y_label int")
    assert [tuple(r) for r in label_stats(df).orderBy(F.desc("Y_label")).collect()] == [(1, 3, 100.0), (0, 0, 0.0)]
    assert [tuple(r) for r in label_stats(df.limit(0)).orderBy(F.desc("Y_label")).collect()] == [(1, 0, 0.0), (0, 0, 0.0)]


def test_result_does_not_depend_on_partition_count(spark):
    panel = random_panel(spark, areas=4, days=90)
    one = add_priors(panel.repartition(1), {"28d": 28}).orderBy("GEOID", "t0").collect()
    many = add_priors(panel.repartition(13), {"28d": 28}).orderBy("GEOID", "t0").collect()
    assert one == many


def test_rollup_keeps_fractions_and_skips_nan(spark):
    rows = [("a", "2024-01-01", 0.4), ("a", "2024-01-02", 0.5), ("a", "2024-01-02", float("nan")), ("b", "2024-01-01", float("nan"))]
    frame = instants(spark, rows, "GEOID string, t0 string, crime_count double")
    got = {r["GEOID"]: (r["crime_count"], r["Y_label"]) for r in rollup(frame, week_start(F.col("t0"))).collect()}
    assert got == {"a": (0.9, 1), "b": (0.0, 0)}


def test_null_keys_and_repeated_times_in_priors(spark):
    rows = [("a", "2024-01-01", None, 1), ("a", "2024-01-01", 0, 1), ("a", "2024-01-08", None, 1)]
    frame = instants(spark, rows, "GEOID string, t0 string, day_of_week int, Y_label int")
    assert add_priors(frame, {"28d": 28}, unique_cells=True).count() == add_priors(frame, {"28d": 28}).count() == 1
    rows = [("a", "2024-01-01", 1, 1), ("a", "2024-01-01", 2, 1), ("a", "2024-01-02", 1, 0)]
    frame = instants(spark, rows, "GEOID string, t0 string, block_id int, Y_label int")
    out = add_priors(frame, {"28d": 28}, keys=(), mode="shifted_hours").orderBy("t0", "block_id").collect()
    assert [r["prior_cnt_28d"] for r in out] == [0, 1, 2]


def test_grid_in_a_span_keeps_all_areas(spark):
    rows = [("a", "2024-01-02", 3), ("b", "2024-02-02", 4)]
    frame = instants(spark, rows, "GEOID string, t0 string, crime_count int")
    grid = dense_grid(frame, "t0", (datetime(2024, 1, 1), datetime(2024, 1, 4))).groupBy("GEOID").agg(F.sum("crime_count").alias("n"), F.count("*").alias("k"))
    assert {tuple(r) for r in grid.collect()} == {("a", 3, 4), ("b", 0, 4)}


def test_fractional_keys_stay_apart(spark):
    frame = spark.createDataFrame([(60750101.0,), (1.2,), (1.8,), (None,)], "GEOID double")
    assert sorted(r["GEOID"] for r in normalize_key(frame).collect()) == ["1.2", "1.8", "60750101"]
