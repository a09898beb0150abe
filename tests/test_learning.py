from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.functions import order_stats
from riskloom.operators import features as ft
from riskloom.operators.counts import class_balance
from riskloom.operators.models import RiskModel, fit_single, load_best, model_paths, preparation
from riskloom.plans import build
from riskloom.sources.writers import grid_path, stored_grids, write_grid

SMALL = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}


def panel(spark, areas=12, days=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        t0 = pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)
        for a in range(areas):
            x = float(rng.random())
            noise = None if rng.random() < 0.1 else float(rng.normal())
            rows.append((f"a{a:02d}", str(t0), int(rng.random() < x), x, noise, 1.0, int(t0.year), int(t0.month), int(t0.dayofweek)))
    df = spark.createDataFrame(
        rows,
        "GEOID string, t0 string, Y_label int, prior_p_28d double, wx_tavg double, flat double, year int, month int, day_of_week int",
    )
    return df.withColumns({"t0": F.col("t0").cast("timestamp"), "crime_count": F.col("Y_label")})


LEAKY = "GEOID string, t0 timestamp, Y_label int, risk_x double, metrics_y int, my_label_z int, crime_count_lag int, HR_CNT_2 int, year int, wx double, name string, wet boolean"


def test_leaks_are_dropped_or_raised(spark):
    df = spark.createDataFrame([], LEAKY)
    chosen = ft.select_features(df)
    assert chosen.numeric == ["wx", "wet"] and chosen.categorical == ["year"]
    with pytest.raises(ValueError, match="my_label_z"):
        ft.select_features(df, on_leak="raise")
    safe = df.drop("my_label_z", "crime_count_lag", "HR_CNT_2")
    assert ft.select_features(safe, on_leak="raise").numeric == ["wx", "wet"]


def test_alignment_to_a_model(spark):
    df = spark.createDataFrame([("a", "3.5", float("nan"), 9)], "GEOID string, x string, y double, extra int")
    out = ft.align_features(df, ["y", "gone", "x"], keep=["GEOID"])
    assert out.columns == ["GEOID", "y", "gone", "x"] and tuple(out.first()) == ("a", 0.0, 0.0, 3.5)
    assert ft.feature_gap(df, ["y", "gone", "x"], keep=["GEOID"]) == ({"gone"}, {"extra"})


def test_valid_columns_ignore_missing_values(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5, float("nan")), (1.0, None, None, 2.0), (None, None, 6, 2.0)], "a double, b double, c int, d double"
    )
    assert ft.valid_columns(df, ["a", "b", "c", "d"]) == ["c"]


@pytest.mark.parametrize("gather", [200_000, 3])
@pytest.mark.parametrize("share", [0.8, 0.801, 0.5, 0.013, 0.0, 1.0])
def test_time_split_is_exact_and_disjoint(spark, monkeypatch, gather, share):
    monkeypatch.setattr(order_stats, "GATHER_LIMIT", gather)
    df = panel(spark, areas=7, days=9).select("GEOID", "t0")
    train, test = ft.time_split(df, share)
    want = df.toPandas().sort_values(["t0", "GEOID"]).reset_index(drop=True)
    cut = int(len(want) * share)
    got = train.toPandas().sort_values(["t0", "GEOID"]).reset_index(drop=True)
    assert got.equals(want.iloc[:cut].reset_index(drop=True)) and test.count() == len(want) - cut


def test_time_split_keeps_rows_without_a_time(spark):
    rows = [(f"a{i:03d}", f"2024-01-{i % 28 + 1:02d}" if i % 20 else "unknown") for i in range(1000)]
    train, test = ft.time_split(spark.createDataFrame(rows, "GEOID string, t0 string"), 0.777)
    assert (train.count(), test.count()) == (777, 223)
    assert train.filter("t0 is null").count() == 0 and test.filter("t0 is null").count() == 50
    late, rest = ft.time_split(spark.createDataFrame(rows, "GEOID string, t0 string"), 0.99)
    assert (late.count(), rest.count()) == (950, 50)


def test_time_split_inside_one_day(spark):
    df = spark.range(1000).select(
        F.format_string("a%03d", F.col("id") % 10).alias("GEOID"), F.timestamp_seconds(F.floor(F.col("id") / 10) * 60).alias("t0")
    )
    train, test = ft.time_split(df, 0.777)
    assert train.count() == 777 and test.count() == 223
    assert train.agg(F.max("t0")).first()[0] <= test.agg(F.min("t0")).first()[0]


def test_split_of_a_stored_grid_reaches_the_scan(spark, plan_of, tmp_path):
    panel(spark).write.parquet(str(tmp_path / "grid"))
    train, _ = ft.time_split(spark.read.parquet(str(tmp_path / "grid")))
    plan = plan_of(train)
    assert "LessThan(t0" in plan and "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("ratio", [0.3, 0.7, 0.001])
def test_undersample_keeps_exact_counts(spark, ratio):
    df = panel(spark)
    before = class_balance(df).first()
    kept = ft.undersample(df, ratio)
    after = class_balance(kept).first()
    assert after["pos"] == before["pos"] and after["neg"] == max(1, int(before["neg"] * ratio))
    again = ft.undersample(df.repartition(11), ratio)
    assert kept.exceptAll(again).isEmpty()
    zero = class_balance(ft.undersample(df, 0.0001, at_least_one=False)).first()
    assert zero["neg"] == 0 and zero["scale_pos_weight"] == 0.0


def test_undersample_with_equal_hashes(spark):
    df = panel(spark)
    n = class_balance(df).first()["neg"]
    kept = ft.undersample(df, 0.5, order_key=F.lit(7).cast("bigint"))
    assert class_balance(kept).first()["neg"] == int(n * 0.5)
    assert kept.select("GEOID", "t0").distinct().count() == kept.count()
    same = spark.range(100).select(F.lit("a").alias("GEOID"), F.lit("2024-01-01").alias("t0"), F.lit(0).alias("Y_label"))
    assert ft.undersample(same, 0.3, at_least_one=False).count() == 30
    assert ft.undersample(df, 0.0) is df


def test_imputation_values(spark):
    df = spark.createDataFrame(
        [(1, 5, 1.0), (2, 5, None), (None, 6, float("nan")), (None, 6, 4.0), (None, None, None)], "a int, b int, c double"
    )
    assert ft.median_values(df, ["a", "c"]) == {"a": 1.5, "c": 2.5}
    assert ft.mode_values(df, ["b"]) == {"b": 5.0}
    filled = ft.fill_missing(df, {"a": 1.5, "b": 5.0, "c": 2.5})
    assert [tuple(r) for r in filled.collect()][-1] == (1.5, 5, 2.5)
    assert filled.schema["b"].dataType.simpleString() == "int"


def test_unseen_category_is_all_zeros(spark):
    train = panel(spark)
    chosen = ft.Features(["wx_tavg"], ["month"])
    model = Pipeline(stages=preparation(chosen, train)).fit(train)
    row = train.limit(1).withColumns({"month": F.lit(99), "wx_tavg": F.lit(2.0)})
    vector = model.transform(row).select(vector_to_array("features").alias("v")).first()["v"]
    assert vector[0] == 2.0 and len(vector) == 1 + 2 and sum(vector[1:]) == 0.0
    seen = model.transform(train.limit(1)).select(vector_to_array("features").alias("v")).first()["v"]
    assert sum(seen[1:]) == 1.0


def test_train_save_load_and_forecast(spark, tmp_path):
    grid = panel(spark)
    model, metrics, scored = build.train(grid, "1D", sizes=SMALL, undersample_ratio=0.8)
    row = metrics.first()
    assert metrics.count() == 1 and row["n_test"] == scored.count() == 144
    assert "flat" not in row["features_num"] and "crime_count" not in row["features_num"]
    assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == 144
    assert 0.5 < row["pr_auc"] <= 1.0 and not row["leak_alarm"]
    root = str(tmp_path / "models")
    model.save(model_paths(root, "1D")[1])
    loaded = load_best(spark, root, "1D")
    assert loaded.inputs == model.inputs
    again = loaded.score(scored.drop("prob").join(grid.drop("Y_label", "crime_count"), ["GEOID", "t0"]))
    assert again.select("GEOID", "t0", "prob").exceptAll(scored.select("GEOID", "t0", "prob")).isEmpty()
    out = build.forecast(loaded, grid, "1D", 72.0, datetime(2024, 3, 1), k=4).toPandas()
    assert len(out) == 12 and out["prob"].between(0, 1).all()
    assert out.groupby("t0")["prob"].apply(lambda p: p.is_monotonic_decreasing).all()
    with pytest.raises(FileNotFoundError):
        load_best(spark, root, "1W")


def test_stored_run_end_to_end(spark, tmp_path):
    root = str(tmp_path)
    write_grid(panel(spark, areas=5, days=40), grid_path(root, "1D"))
    grids = stored_grids(spark, root, ["1D", "1W"])
    assert grids["1W"] is None
    models, failed = build.train_frequencies(
        grids, on_done=lambda f, m, metrics, scored: build.save_run(root, f, m, metrics, scored), sizes=SMALL
    )
    assert list(models) == ["1D"] and not failed
    assert spark.read.json(f"{root}/reports/metrics").first()["freq"] == "1D"
    assert spark.read.csv(f"{root}/reports/pr_curve_single_1d", header=True).count() > 2
    assert load_best(spark, f"{root}/models", "1D").inputs == models["1D"].inputs


def test_stacked_model(spark, tmp_path):
    grid = panel(spark, areas=8, days=40)
    sizes = {"boosted": {"maxIter": 2, "maxDepth": 2}, "boosted_long": None, "forest": {"numTrees": 3}, "linear": {"maxIter": 3}, "meta": {"maxIter": 5}}
    model, metrics, scored = build.train(grid, "1D", kind="stacked", sizes=sizes, folds=2)
    assert list(model.bases) == ["boosted", "forest", "linear"] and metrics.first()["pr_auc"] > 0.4
    stacked, single = model_paths(str(tmp_path), "1D")[:2]
    model.save(stacked)
    fit_single(grid, ft.Features(["prior_p_28d"], []), 1.0, maxIter=1, maxDepth=1).save(single)
    loaded = load_best(spark, str(tmp_path), "1D")
    assert isinstance(loaded, RiskModel) and list(loaded.bases) == ["boosted", "forest", "linear"]
    rescored = loaded.score(grid).join(scored.select("GEOID", "t0", F.col("prob").alias("old")), ["GEOID", "t0"])
    assert rescored.filter(F.abs(F.col("prob") - F.col("old")) > 1e-6).isEmpty()


def test_one_failing_frequency_can_be_skipped(spark):
    good, bad = panel(spark, areas=5, days=30), panel(spark).drop("t0")
    done = []
    models, failed = build.train_frequencies(
        {"1W": bad, "1M": None, "1D": good}, keep_going=True, on_done=lambda f, *rest: done.append(f), sizes=SMALL
    )
    assert list(models) == done == ["1D"] and list(failed) == ["1W"]
    with pytest.raises(ValueError):
        build.train_frequencies({"1W": bad})


def test_weight_before_or_after_sampling(spark):
    grid = panel(spark, areas=6, days=30)
    rows = [
        build.train(grid, "1D", undersample_ratio=0.5, weight_after_sampling=after, sizes={"maxIter": 1, "maxDepth": 1})[1].first()
        for after in (False, True)
    ]
    assert rows[0]["train_neg"] // 2 == rows[1]["train_neg"] and rows[0]["n_train"] == rows[1]["n_train"]
