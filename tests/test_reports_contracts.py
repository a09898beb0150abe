import pytest
from pyspark.sql import functions as F

from riskloom.operators import report
from riskloom.plans import build
from riskloom.plans.fixtures import day_incidents, hour_incidents, standard_daily
from riskloom.plans.queries import QUERIES
from riskloom.sources import writers
from riskloom.sources.contracts import Contract, line_kind, read_lines, watching_session


def test_positions_follow_the_order(spark, plan_of):
    rows = spark.range(5_000).select(F.col("id"), (F.col("id") * 7919 % 1009).alias("a"), F.when(F.col("id") % 11 != 0, F.col("id") % 3).alias("b"))
    got = report.numbered(rows, F.col("b").desc(), F.col("a"), F.col("id"))
    assert "Window" not in plan_of(got) and "SinglePartition" not in plan_of(got)
    found = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(1, 5_001))
    assert [r.id for r in found] == [r.id for r in sorted(found, key=lambda r: (r.b is None, -(r.b or 0), r.a, r.id))]
    assert [r.position for r in report.page(got, 101, 3).orderBy("position").collect()] == [101, 102, 103]


def test_positions_of_equal_rows_and_empty_tables(spark):
    same = spark.range(100).select(F.lit(1).alias("a"))
    assert sorted(r.position for r in report.numbered(same, "a").collect()) == list(range(1, 101))
    assert report.numbered(same.limit(0), "a").collect() == []
    with pytest.raises(ValueError):
        report.numbered(same, "a", name="A")


def test_contract_counts_and_enforces(spark):
    own = watching_session(spark)
    rows = own.createDataFrame([("a", "2024-01-01"), (None, "x"), ("b", None), ("c", "2024-01-02 03:00")], "GEOID string, t0 string")
    contract = Contract("GEOID", "t0")
    with pytest.raises(ValueError):
        contract.facts()
    contract.watch(rows).groupBy("GEOID").count().collect()
    assert contract.enforce() == {"row_count": 4, "unreadable_times": 1, "null_times": 1, "null_keys": 1}
    with pytest.raises(ValueError, match="2 of 4"):
        contract.enforce(strict=True)
    assert contract.report(spark).collect()[0].unreadable_times == 1
    useless = Contract("GEOID", "t0")
    useless.watch(rows.filter("t0 = 'x'")).collect()
    with pytest.raises(ValueError, match="no time"):
        useless.enforce()
    with pytest.raises(ValueError):
        Contract("GEOID", "absent").watch(rows)


def test_jobs_check_times_without_a_job_of_their_own(spark, data):
    bad = day_incidents(spark, data).withColumn("datetime", F.concat(F.lit("never "), F.col("o_totalprice").cast("string")))
    panel = build.labelled_panel(bad, side_cols=[])  # nothing has run yet
    with pytest.raises(Exception, match="no time could be parsed"):
        panel.collect()
    own = watching_session(spark)
    hourly = build.labelled_panel(hour_incidents(own, data), "hourly", side_cols=[]).select("GEOID", "dt", "crime_count")
    contract = Contract("GEOID", "dt")
    grid = build.window_grid(hourly, "1W", build.datetime(2024, 1, 31, 9), contract=contract)
    n = grid.count()
    assert n > 0 and contract.enforce()["row_count"] > n


def test_lines_that_do_not_fit(spark, tmp_path):
    lines = ["id,name,n", "1,a,5", "2,b", "3,c,x", "4,d,7,8", "", "5,,9"]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    rows = read_lines(spark, str(tmp_path / "x.csv"), "id int, name string, n int").cache()
    assert {(r.id, r.kind) for r in rows.select("id", line_kind(3).alias("kind")).collect()} == {
        (1, "good"), (2, "short"), (3, "damaged"), (4, "damaged"), (5, "good")
    }
    rows.unpersist()
    (tmp_path / "x.json").write_text('{"id": 1, "n": 2}\n{"id": "y"\n{"id": 3}\n')
    rows = read_lines(spark, str(tmp_path / "x.json"), "id int, n int", "json").cache()
    assert [r["count"] for r in rows.groupBy(line_kind(2).alias("k")).count().orderBy("k").collect()] in ([1, 2], [2, 1], [2, 1, 0])
    assert rows.filter("__malformed is null").count() == 2
    rows.unpersist()
    with pytest.raises(ValueError):
        read_lines(spark, "x", "id int", "xml")


def test_layout_of_a_written_grid(spark, data, tmp_path):
    grid = standard_daily(spark, data)
    path = str(tmp_path / "grid")
    writers.write_grid(grid, path, partitions=5)
    stored = spark.read.parquet(path)
    ranges = writers.file_ranges(stored).collect()
    assert len(ranges) == 5 and sum(r.row_count for r in ranges) == grid.count()
    assert writers.layout_report(stored).first().asDict() == {"row_count": grid.count(), "overlapping_files": 0}
    mixed = str(tmp_path / "mixed")
    grid.select("GEOID", "t0").repartition(4).write.parquet(mixed)
    assert writers.layout_report(spark.read.parquet(mixed)).first().overlapping_files == 3


def test_grid_is_computed_once_for_all_frequencies(spark, data, plan_of):
    grids = build.frequency_grids(standard_daily(spark, data), unique_cells=True)
    for freq in ("1D", "1W", "1M"):
        assert "orders.parquet" not in plan_of(grids[freq])


def test_history_keeps_every_run(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for k, (freq, extra) in enumerate([("1D", False), ("1D", True), ("1W", False)]):
        row = spark.createDataFrame([(freq, k, 0.5 + k)], "freq string, run_time int, f1 double")
        writers.append_metrics(row.withColumn("recall", F.lit(0.25)) if extra else row, path)
    history = writers.metrics_history(spark, path)
    assert history.count() == 3 and set(history.columns) == {"freq", "run_time", "f1", "recall"}
    assert {(r.freq, r.f1, r.recall) for r in writers.last_runs(history).collect()} == {("1D", 1.5, 0.25), ("1W", 2.5, None)}


def test_models_score_after_a_contract_was_watched(spark, data):
    QUERIES["contract_report"](spark, data).collect()
    assert [r.rows_different for r in QUERIES["saved_model_scores"](spark, data).collect()] == [0, 0]
