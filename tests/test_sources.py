import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators.counts import category_counts, label_stats
from riskloom.operators.evaluation import class_report, pr_curve, score_counts
from riskloom.operators.priors import add_priors
from riskloom.schema import int_or, normalize_key, numeric_columns, require
from riskloom.session import checkpoint_root, materialize, release
from riskloom.sources.readers import ensure_some_time, parsed_time, read_columns, resolve_event_time, schema_report
from riskloom.sources.writers import (
    exists, write_forecast, write_grid, write_grid_table, write_metrics, write_pr_curve, write_report, write_small_csv,
)


def test_parquet_columns_are_matched_without_case_and_pruned(spark, plan_of, data):
    df = read_columns(spark, f"{data}/orders.parquet", ["O_ORDERKEY", "o_orderkey", "o_custkey", "nope"])
    assert df.columns == ["o_orderkey", "o_custkey"]
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan_of(df)
    assert len(read_columns(spark, f"{data}/orders.parquet", ["nope"]).columns) == 6
    assert len(read_columns(spark, f"{data}/orders.parquet").columns) == 6


def test_csv_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("GEOID,datetime,crime_count,other\n06075,2024-01-01 03:20:00,2,x\n06075,bad,1,y\n")
    df = resolve_event_time(normalize_key(read_columns(spark, str(path), ["GEOID", "geoid", "datetime", "crime_count"])))
    assert df.columns == ["GEOID", "datetime", "crime_count", "dt"]
    got = [(r["GEOID"], r["t"]) for r in df.select("GEOID", F.col("dt").cast("string").alias("t")).collect()]
    assert got == [("06075", "2024-01-01 03:00:00"), ("06075", None)]
    typed = read_columns(spark, str(path), ["crime_count"], schema="GEOID string, datetime string, crime_count int, other string")
    assert typed.schema["crime_count"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        read_columns(spark, str(path), fmt="avro")


def test_key_forms(spark):
    assert normalize_key(spark.createDataFrame([(60750101.0,), (None,)], "geoid double")).collect() == [("60750101",)]
    both = spark.createDataFrame([("a", "b")], "GEOID string, x string").toDF("GEOID", "geoid")
    assert normalize_key(both).collect() == [("a",)]
    assert normalize_key(spark.createDataFrame([(7,)], "geoid int")).first()["GEOID"] == "7"
    with pytest.raises(ValueError):
        normalize_key(spark.createDataFrame([(1,)], "area int"))


@pytest.mark.parametrize(
    "schema,row,want",
    [
        ("datetime string, event_hour string", ("2024-01-01 05:59:59", "2020-01-01"), "2024-01-01 05:00:00"),
        ("datetime string, event_hour string", (None, "2020-01-01"), None),
        ("date string, time string, received_time string", ("2024-01-01", "07:30", "2020-01-01"), "2024-01-01 07:00:00"),
        ("date string, event_hour string", ("2024-01-01", "2024-01-02 09:15:00"), "2024-01-02 09:00:00"),
        ("received_time string", ("2024-01-03 01:02:03+02:00",), "2024-01-02 23:00:00"),
        ("datetime timestamp_ntz", (dt.datetime(2024, 1, 1, 4, 30),), "2024-01-01 04:00:00"),
        ("datetime date", (dt.date(2024, 1, 1),), "2024-01-01 00:00:00"),
        ("datetime long", (1_704_085_199_999_999_999,), "2024-01-01 04:00:00"),
    ],
)
def test_event_time_goes_by_column_presence(spark, schema, row, want):
    df = resolve_event_time(spark.createDataFrame([row], schema))
    assert df.select(F.col("dt").cast("string")).first()[0] == want


def test_event_time_errors(spark):
    with pytest.raises(ValueError):
        resolve_event_time(spark.createDataFrame([("x",)], "other string"))
    with pytest.raises(ValueError):
        resolve_event_time(spark.createDataFrame([("x",)], "datetime string"), check=True)
    mixed = spark.createDataFrame([("x",), ("2024-01-01",)], "t0 string")
    assert ensure_some_time(parsed_time(mixed, "t0"), "t0").count() == 2
    with pytest.raises(Exception, match="unparsable"):
        parsed_time(mixed, "t0", strict=True).collect()


def test_contracts_and_casts(spark):
    df = spark.createDataFrame([("3", "x", True, 1.5)], "a string, b string, c boolean, d double")
    assert require(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="zz"):
        require(df, ["zz"])
    assert df.select(int_or(F.col("a"), -1), int_or(F.col("b"), -1)).collect() == [(3, -1)]
    assert numeric_columns(df, {"d"}) == ["c"]


def test_schema_reports(spark):
    risk = spark.createDataFrame([("a", 1, 0.5)], "GeoID string, HOUR int, risk_score double")
    assert schema_report(risk, "risk").first()["schema_ok"]
    assert not schema_report(risk.drop("HOUR"), "risk").first()["schema_ok"]
    metrics = schema_report(spark.createDataFrame([("a", 1.0)], "model string, value double"), "metrics").first()
    assert metrics["columns_found"] == "model,value" and metrics["row_count"] == 1


def grid(spark):
    df = spark.range(2000).select(
        F.format_string("a%02d", F.col("id") % 20).alias("GEOID"), F.timestamp_seconds(F.floor(F.col("id") / 20) * 86400).alias("t0"),
        (F.col("id") % 3).alias("crime_count"), (F.col("id") % 3 > 0).cast("int").alias("Y_label"),
        F.lit(0.1).alias("prior_p_28d"), F.lit(3).alias("day_of_week"),
    )
    return df


def test_grid_sink_orders_and_narrows(spark, tmp_path):
    path = str(tmp_path / "grid")
    write_grid(grid(spark), path, partitions=4)
    back = spark.read.parquet(path)
    types = {f.name: f.dataType.simpleString() for f in back.schema.fields}
    assert types["prior_p_28d"] == "float" and types["Y_label"] == "tinyint" and types["crime_count"] == "bigint"
    assert back.count() == 2000
    per_file = back.groupBy(F.input_file_name()).agg(F.min("GEOID").alias("lo"), F.max("GEOID").alias("hi")).orderBy("lo").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(per_file, per_file[1:])) and len(per_file) > 1


def test_bucketed_grid_table_needs_no_exchange(spark, plan_of, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/db'")
    write_grid_table(grid(spark), "bucketed.grid_1d", 4)
    stored = spark.table("bucketed.grid_1d")
    out = add_priors(stored, {"28d": 28}, unique_cells=True)
    assert "Exchange" not in plan_of(out) and out.count() == 2000
    spark.sql("DROP DATABASE bucketed CASCADE")


def test_forecast_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 05:00:00", 0.5, "Yüksek")], "GEOID string, t0 string, prob float, tier string")
    df = df.withColumn("t0", F.col("t0").cast("timestamp"))
    write_forecast(df, str(tmp_path / "csv"), "csv")
    write_forecast(df, str(tmp_path / "json"), "json")
    text = max((f.read_text(encoding="utf-8") for f in (tmp_path / "csv").glob("*.csv")), key=len)
    assert text == "GEOID,t0,prob,tier\na,2024-01-01T05:00:00Z,0.5,Yüksek\n"
    record = json.loads(max((f.read_text(encoding="utf-8") for f in (tmp_path / "json").glob("*.json")), key=len))
    assert record == {"GEOID": "a", "t0": "2024-01-01T05:00:00Z", "prob": 0.5, "tier": "Yüksek"}
    with pytest.raises(ValueError):
        write_forecast(df, str(tmp_path / "x"), "xml")


def test_report_sinks(spark, tmp_path):
    write_small_csv(label_stats(grid(spark)), str(tmp_path / "labels"))
    lines = next((tmp_path / "labels").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "Y_label,Count,Percent(%)" and sorted(lines[1:]) == ["0,667,33.35", "1,1333,66.65"]
    scored = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.4)], "y int, p double")
    write_pr_curve(pr_curve(score_counts(scored)), str(tmp_path / "curve"))
    curve = spark.read.csv(str(tmp_path / "curve"), header=True, schema="precision double, recall double").collect()
    assert tuple(curve[-1]) == (1.0, 0.0) and len(curve) == 3
    write_report(class_report(spark.createDataFrame([(1, 0, 1, 2)], "tn long, fp long, fn long, tp long")), str(tmp_path / "rep"))
    assert "accuracy" in "".join(f.read_text() for f in (tmp_path / "rep").glob("*.txt"))
    for run in (1, 2):
        write_metrics(spark.createDataFrame([("1D", 0.5)], "freq string, pr_auc double"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2


def test_category_counts(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "tier string")
    assert {r["tier"]: r["row_count"] for r in category_counts(df, "tier").collect()} == {"x": 2, "y": 1}


def test_materialized_tables_keep_types_and_live_in_the_shared_folder(spark):
    df = grid(spark).withColumn("n", F.col("t0").cast("timestamp_ntz"))
    back = materialize(df)
    assert [(f.name, f.dataType) for f in back.schema.fields] == [(f.name, f.dataType) for f in df.schema.fields]
    folder = checkpoint_root(spark).rstrip("/").rsplit("/", 1)[1]
    assert back.exceptAll(df).isEmpty() and f"/{folder}/" in back.inputFiles()[0]
    files = back.inputFiles()
    release(back)
    assert not exists(spark, files[0])
