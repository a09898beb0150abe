"""Registered queries: each runs an operator over whole tables, with SQL to compare.

Every query takes ``(spark, folder)`` and returns a DataFrame whose types a
plain SQL engine shares: times without zone, 32-bit calendar integers, doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.timing import (
    add_calendar, anchored_bucket, auto_freq, horizon_hours, local_day, local_time, month_start, season, week_start,
)
from riskloom.operators import counts, evaluation, features, forecast, linear, priors, report
from riskloom.operators.grid import dense_grid
from riskloom.operators.models import fit_single, fit_stacked, load_best, preparation
from riskloom.operators.rollup import rollup
from riskloom.plans import build
from riskloom.plans.fixtures import (
    DAY_RUN, HOUR_RUN, TZ, count_grid, daily_grid, day_incidents, future_scores, hour_incidents, keyed,
    scored_documents, segment_panel, standard_daily, table,
)
from riskloom.plans.sql import SQL
from riskloom.schema import COUNT, KEY, LABEL, label, quoted
from riskloom.session import TABLE_PREFIX, checkpoint_root, materialize, use_utc
from riskloom.sources.contracts import Contract, line_kind, read_lines, watching_session
from riskloom.sources.readers import read_columns, resolve_event_time, schema_report
from riskloom.sources.writers import append_metrics, export_rows, last_runs, layout_report, metrics_history, narrow, write_forecast, write_grid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NUDGE = 1e-7  # keeps half-way values from rounding apart in two engines


def plain_types(df: DataFrame) -> DataFrame:
    casts = {T.TimestampType: "timestamp_ntz", T.ByteType: "int", T.ShortType: "int", T.FloatType: "double"}
    return df.select(
        *[
            quoted(f.name).cast(casts[type(f.dataType)]).alias(f.name) if type(f.dataType) in casts else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain_types(fn(use_utc(spark), folder))

        QUERIES[name] = run
        return run

    return register


def rounded(name: str, digits: int = 4):
    return F.round(quoted(name) + NUDGE, digits).alias(name)


def with_rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(quoted(n) + NUDGE, 4) for n in names})


# ---- sources

@query("scan_pruned")
def q_scan_pruned(spark, folder):
    return read_columns(spark, f"{folder}/orders.parquet", ["O_ORDERKEY", "o_custkey", "O_TotalPrice", "absent"])


@query("schema_check")
def q_schema_check(spark, folder):
    events = table(spark, folder, "events")
    risk = events.select(F.col("user_id").alias("GeoID"), F.hour("ts").alias("HOUR"), F.col("value").alias("risk_score"))
    metrics = events.select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("timestamp"))
    return schema_report(risk, "risk").unionByName(schema_report(metrics, "metrics"))


# ---- projections and time

@query("event_time")
def q_event_time(spark, folder):
    orders = table(spark, folder, "orders")
    day = F.when(F.col("o_orderkey") % 97 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    clock = F.format_string("%02d:%02d:05", F.col("o_orderkey") % 24, F.col("o_orderkey") % 60)
    raw = orders.select("o_orderkey", day.alias("date"), clock.alias("time"), F.lit("1999").alias("received_time"))
    return resolve_event_time(raw).select("o_orderkey", "dt")


@query("local_time")
def q_local_time(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", local_time(F.col("ts").cast("timestamp"), TZ).alias("local_ts"))


@query("calendar")
def q_calendar(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("dt"))
    return add_calendar(events, "dt", hourly=True).drop("dt")


@query("calendar_local")
def q_calendar_local(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t0"))
    return add_calendar(orders, "t0", TZ, hour_start="clock")


@query("stored_types")
def q_stored_types(spark, folder):
    """Calendar columns and values as a grid stores them; what the 32-bit value is shows as a double."""
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("dt"), "value")
    stored = narrow(add_calendar(events, "dt", hourly=True).withColumn(LABEL, (F.col("value") > 50).cast("int")))
    names = ["year", "month", "day_of_week", "hour", LABEL, "value"]
    types = F.concat_ws(" ", *[F.typeof(n) for n in names]).alias("types")
    return stored.select("event_id", *names[:-1], F.col("value").cast("double").alias("value"), types)


@query("season")
def q_season(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.groupBy(season(F.month("o_orderdate")).alias("season")).agg(F.count("*").alias("row_count"))


@query("label")
def q_label(spark, folder):
    text = F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.floor(F.col("value") - 10).cast("string"))
    return table(spark, folder, "events").select("event_id", label(text).alias(LABEL))


@query("local_day")
def q_local_day(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", local_day(F.col("o_orderdate").cast("timestamp"), TZ).alias("t0"))


@query("bucket_week")
def q_bucket_week(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", week_start(F.col("o_orderdate").cast("timestamp")).alias("t0"))


@query("bucket_month")
def q_bucket_month(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", month_start(F.col("o_orderdate").cast("timestamp")).alias("t0"))


@query("bucket_anchored")
def q_bucket_anchored(spark, folder):
    instant = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id",
        anchored_bucket(instant, "1W", HOUR_RUN, TZ).alias("week_start"),
        anchored_bucket(instant, "1M", HOUR_RUN, TZ).alias("month_start"),
    )


def _requests(spark, folder):
    """One forecast request per customer, its horizon written in one of many ways."""
    n = (F.col("c_custkey") % 120 + 1).cast("string")
    forms = [
        F.concat(n, F.lit("h")), F.concat(n, F.lit("d")), F.concat(F.lit("  "), n, F.lit(" W ")), F.concat(n, F.lit("m")),
        n, F.lit(""), F.concat(n, F.lit("h30m")), F.concat(n, F.lit(" days 06:30:00")), F.concat(F.lit("-"), n, F.lit("d")),
        F.concat(n, F.lit("e1")), F.concat(n, F.lit(" d")), F.concat(n, F.lit(" fortnights")),
    ]
    text = F.element_at(F.array(*forms), (F.col("c_custkey") % 12 + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", text.alias("horizon"))


@query("horizon_hours")
def q_horizon_hours(spark, folder):
    hours = horizon_hours(F.col("horizon"))
    return _requests(spark, folder).select("c_custkey", hours.alias("hours"), auto_freq(hours).alias("freq"))


@query("future_index")
def q_future_index(spark, folder):
    planned = forecast.plan_requests(_requests(spark, folder)).select("c_custkey", "freq", "hours")
    return forecast.future_index(planned, DAY_RUN).select("c_custkey", "freq", "t0")


@query("request_report")
def q_request_report(spark, folder):
    """Every request with the number of its future starts, or what is wrong with it."""
    planned = forecast.plan_requests(_requests(spark, folder))
    starts = F.count("t0").alias("starts")
    rows = forecast.future_index(planned.withColumn("problem", forecast.request_problem(DAY_RUN)), DAY_RUN)
    return rows.groupBy("c_custkey", "problem").agg(starts)


# ---- counts, side features, grids

@query("hourly_counts")
def q_hourly_counts(spark, folder):
    return counts.count_incidents(keyed(hour_incidents(spark, folder)), "hourly")


@query("hourly_sum")
def q_hourly_sum(spark, folder):
    raw = hour_incidents(spark, folder).withColumn(COUNT, F.floor("value"))
    return counts.count_incidents(keyed(raw), "hourly").select(KEY, "dt", COUNT, LABEL)


@query("daily_counts")
def q_daily_counts(spark, folder):
    return counts.count_incidents(keyed(day_incidents(spark, folder)), "daily")


@query("side_features")
def q_side_features(spark, folder):
    raw = keyed(day_incidents(spark, folder, items=True))
    base = counts.count_incidents(raw, "daily").select(KEY, "t0", COUNT)
    return with_rounded(counts.join_side_features(base, raw, ["o_totalprice", "item_count"], "daily"), "o_totalprice")


@query("side_features_hourly")
def q_side_features_hourly(spark, folder):
    raw = keyed(hour_incidents(spark, folder))
    base = counts.count_incidents(raw, "hourly").select(KEY, "dt", COUNT)
    return with_rounded(counts.join_side_features(base, raw, ["value"], "hourly"), "value")


@query("grid_daily")
def q_grid_daily(spark, folder):
    grid = daily_grid(spark, folder, ("o_totalprice", "item_count"))
    return with_rounded(grid, "o_totalprice")


@query("grid_hourly")
def q_grid_hourly(spark, folder):
    return count_grid(hour_incidents(spark, folder), "hourly")


@query("grid_stats")
def q_grid_stats(spark, folder):
    stats = counts.grid_stats(daily_grid(spark, folder, segment=True))
    return stats.withColumn("label_rate", rounded("label_rate", 6))


@query("label_stats")
def q_label_stats(spark, folder):
    return counts.label_stats(daily_grid(spark, folder, segment=True))


# ---- priors

@query("prior_28d")
def q_prior_28d(spark, folder):
    grid = standard_daily(spark, folder)
    return grid.select(KEY, "t0", "prior_cnt_28d", "prior_p_28d")


@query("prior_180d")
def q_prior_180d(spark, folder):
    grid = standard_daily(spark, folder)
    return grid.select(KEY, "t0", "prior_cnt_180d", "prior_p_180d")


def _panel(spark, folder):
    return build.labelled_panel(day_incidents(spark, folder), side_cols=[])


@query("prior_3m")
def q_prior_3m(spark, folder):
    return _panel(spark, folder).select(KEY, "t0", COUNT, LABEL, "day_of_week", "prior_cnt_3m", "prior_p_3m")


@query("prior_12m")
def q_prior_12m(spark, folder):
    return _panel(spark, folder).select(KEY, "t0", "prior_cnt_12m", "prior_p_12m")


@query("prior_hourly")
def q_prior_hourly(spark, folder):
    panel = build.labelled_panel(hour_incidents(spark, folder), "hourly", side_cols=[])
    return panel.select(KEY, "dt", "day_of_week", "hour", "season", "prior_cnt_3m", "prior_p_3m")


@query("panel_daily")
def q_panel_daily(spark, folder):
    return with_rounded(segment_panel(spark, folder), "o_totalprice")


@query("panel_daily_local")
def q_panel_daily_local(spark, folder):
    return build.labelled_panel(day_incidents(spark, folder), tz=TZ, side_cols=[])


@query("panel_hourly")
def q_panel_hourly(spark, folder):
    panel = build.labelled_panel(hour_incidents(spark, folder), "hourly", side_cols=["value"])
    return with_rounded(panel, "value")


@query("prior_shifted")
def q_prior_shifted(spark, folder):
    grid = add_calendar(daily_grid(spark, folder), "t0").select(KEY, "t0", LABEL, "day_of_week")
    out = priors.add_priors(grid, priors.ROLLUP_WINDOWS, mode="shifted_hours")
    return out.withColumns({c: F.round(c, 10) for c in ("prior_p_28d", "prior_p_180d")})


@query("prior_repeated_cells")
def q_prior_repeated_cells(spark, folder):
    """Priors straight on order rows, where one area and day may repeat."""
    rows = keyed(day_incidents(spark, folder)).select(
        KEY, F.col("dt").alias("t0"), (F.col("o_totalprice") > 250000).cast("int").alias(LABEL)
    )
    return priors.add_priors(rows, {"28d": 28}, keys=())


@query("prior_null_keys")
def q_prior_null_keys(spark, folder):
    """Priors of customers' order days, some without a calendar key."""
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("t0")
    rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").cast("string").alias(KEY), day).agg(
        F.max((F.col("o_totalprice") > 250000).cast("int")).alias(LABEL), F.max("o_orderkey").alias("k")
    )
    rows = rows.withColumn("day_of_week", F.when(F.col("k") % 5 != 0, (F.dayofweek("t0") + 5) % 7)).drop("k")
    return priors.add_priors(rows, {"28d": 28}, unique_cells=True)


@query("prior_shifted_blocks")
def q_prior_shifted_blocks(spark, folder):
    """Shifted priors where an area has several rows of one time, told apart by block."""
    rows = keyed(day_incidents(spark, folder)).groupBy(KEY, F.col("dt").alias("t0"), F.floor(F.col("o_totalprice") / 50000).alias("block_id")).agg(
        F.max((F.col("o_totalprice") % 2 < 1).cast("int")).alias(LABEL)
    )
    return priors.add_priors(rows, {"28d": 28}, keys=(), mode="shifted_hours")


@query("prior_since")
def q_prior_since(spark, folder):
    grid = add_calendar(daily_grid(spark, folder), "t0").select(KEY, "t0", LABEL, "day_of_week")
    out = priors.add_priors(grid, {"3m": 90}, unique_cells=True, since=datetime(2001, 1, 1))
    return out.select(KEY, "t0", "prior_cnt_3m", "prior_p_3m")


# ---- roll-ups

def _rolled(spark, folder, freq):
    daily = standard_daily(spark, folder, ("o_totalprice", "item_count"))
    return with_rounded(build.coarse_grid(daily, freq), "o_totalprice", "item_count")


@query("rollup_week")
def q_rollup_week(spark, folder):
    return _rolled(spark, folder, "1W")


@query("rollup_month")
def q_rollup_month(spark, folder):
    return _rolled(spark, folder, "1M")


def _windowed(spark, folder, freq, mode="closed_left"):
    hourly = count_grid(hour_incidents(spark, folder), "hourly", ("value",))
    grid = build.window_grid(hourly, freq, HOUR_RUN, TZ, mode)
    return with_rounded(grid, "value").withColumns({c: F.round(c, 10) for c in ("prior_p_28d", "prior_p_180d")})


@query("rollup_local_day")
def q_rollup_local_day(spark, folder):
    return _windowed(spark, folder, "1D")


@query("rollup_anchored")
def q_rollup_anchored(spark, folder):
    return _windowed(spark, folder, "1W")


@query("rollup_anchored_month")
def q_rollup_anchored_month(spark, folder):
    return _windowed(spark, folder, "1M", "shifted_hours")


# ---- forecasts scored by the last prior rate

@query("rollup_missing_counts")
def q_rollup_missing_counts(spark, folder):
    """Fractional counts, some of them not a number, added up by week per customer."""
    part = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).when(F.col("o_orderkey") % 11 == 0, None).otherwise(0.25)
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias(KEY), F.col("o_orderdate").cast("timestamp").alias("t0"), part.alias(COUNT)
    )
    return rollup(rows, week_start(F.col("t0"))).select(KEY, "t0", COUNT, LABEL)


@query("grid_in_span")
def q_grid_in_span(spark, folder):
    """The daily grid of a fixed month: areas without an order in it are kept."""
    raw = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias(KEY), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("t0")
    )
    cells = raw.groupBy(KEY, "t0").agg(F.count("*").alias(COUNT))
    return dense_grid(cells, "t0", (datetime(2000, 3, 1), datetime(2000, 3, 10)), (COUNT,))


@query("last_snapshot")
def q_last_snapshot(spark, folder):
    grid = standard_daily(spark, folder)
    return forecast.last_snapshot(grid, forecast.carried_columns(grid.columns))


@query("median_fill")
def q_median_fill(spark, folder):
    cells = daily_grid(spark, folder, ("o_totalprice",), segment=True)
    snapshot = materialize(forecast.last_snapshot(cells, [COUNT, "o_totalprice"]))
    return with_rounded(forecast.fill_with_medians(snapshot), "o_totalprice")


@query("forecast_grid")
def q_forecast_grid(spark, folder):
    return forecast.forecast_frame(standard_daily(spark, folder), "1D", 720.0, DAY_RUN)


@query("forecast_one")
def q_forecast_one(spark, folder):
    return forecast.forecast_frame(standard_daily(spark, folder), "1W", 1440.0, DAY_RUN, area="7")


@query("tiers")
def q_tiers(spark, folder):
    return forecast.add_tier(future_scores(spark, folder))


@query("tier_counts")
def q_tier_counts(spark, folder):
    return counts.category_counts(forecast.add_tier(future_scores(spark, folder)), "tier")


@query("topk_per_window")
def q_topk_per_window(spark, folder):
    return forecast.top_k(future_scores(spark, folder), 5)


@query("forecast_export")
def q_forecast_export(spark, folder):
    return export_rows(forecast.ranked_forecast(future_scores(spark, folder), 10).drop("tier_rank"))


# ---- features and learning

def _leaky_grid(spark, folder):
    grid = add_calendar(daily_grid(spark, folder, ("o_totalprice",)), "t0")
    return grid.select(
        KEY, "t0", COUNT, LABEL, "year", "month", "day_of_week", "o_totalprice",
        F.col("o_totalprice").alias("risk_x"), F.col(COUNT).alias("metrics_y"),
        F.col("o_totalprice").alias("my_label_z"), F.col(COUNT).alias("crime_count_lag"),
        F.col(KEY).alias("area_name"),
    )


@query("leak_filter")
def q_leak_filter(spark, folder):
    return features.feature_table(_leaky_grid(spark, folder))


@query("leak_check")
def q_leak_check(spark, folder):
    """Strict choice: columns that would stop a training are named, not dropped."""
    return features.feature_table(_leaky_grid(spark, folder), on_leak="raise")


@query("align_features")
def q_align_features(spark, folder):
    grid = daily_grid(spark, folder, ("o_totalprice",)).withColumn("area_text", F.col(KEY))
    wanted = ["o_totalprice", "absent_feature", COUNT, "area_text"]
    return with_rounded(features.align_features(grid, wanted, keep=(KEY, "t0")), "o_totalprice")


def _train_part(spark, folder):
    # Learning steps pass over the grid several times: write it once.
    grid = materialize(add_calendar(daily_grid(spark, folder, ("o_totalprice",)), "t0", hour_start="zero"))
    return features.time_split(grid)[0]


@query("valid_columns")
def q_valid_columns(spark, folder):
    train = _train_part(spark, folder).withColumn("empty", F.lit(None).cast("double"))
    return features.valid_column_table(train, ["year", "month", "hour_start", "o_totalprice", "empty", COUNT])


@query("time_split")
def q_time_split(spark, folder):
    grid = materialize(daily_grid(spark, folder).select(KEY, "t0"))
    return grid.withColumn("is_train", features.time_cut(grid, 0.8).is_train())


@query("time_split_text")
def q_time_split_text(spark, folder):
    """The split of a grid whose times are text, some of them unreadable."""
    bad = F.col("c_custkey") % 20 == 0
    text = F.when(bad, "unknown").otherwise(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("c_custkey").cast("int")), "yyyy-MM-dd"))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias(KEY), text.alias("t0"))
    train, test = features.time_split(materialize(rows))
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


@query("class_balance")
def q_class_balance(spark, folder):
    balance = counts.class_balance(_train_part(spark, folder))
    return balance.withColumns({c: rounded(c, 6) for c in ("y1_rate", "scale_pos_weight")})


@query("undersample")
def q_undersample(spark, folder):
    train = _train_part(spark, folder).select(KEY, "t0", LABEL)
    # The default order is a faster hash; MD5 is one that SQL can repeat.
    digest = F.md5(F.concat_ws("|", KEY, F.date_format("t0", "yyyy-MM-dd"), F.lit("42")))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    return features.undersample(train, 0.3, order_key=order)


@query("class_weights")
def q_class_weights(spark, folder):
    """Rows kept for training and the weight of positives, taken before and after the sampling of negatives."""
    train, out = materialize(_train_part(spark, folder).select(KEY, "t0", LABEL)), None
    for name, after in (("before", False), ("after", True)):
        sampled, balance = build.weighted_sample(train, 0.3, after)
        weight = F.round(F.lit(balance["scale_pos_weight"]) + NUDGE, 6).alias("scale_pos_weight")
        kept = sampled.agg(F.count_if(F.col(LABEL) == 1).alias("pos"), F.count_if(F.col(LABEL) == 0).alias("neg"))
        row = kept.select(F.lit(name).alias("weighted"), "pos", "neg", weight)
        out = row if out is None else out.unionByName(row)
    return out


@query("impute_median")
def q_impute_median(spark, folder):
    train = _train_part(spark, folder).select(KEY, "t0", COUNT, "o_totalprice")
    filled = features.fill_missing(train, features.median_values(train, [COUNT, "o_totalprice"]))
    return with_rounded(filled, "o_totalprice")


@query("impute_mode")
def q_impute_mode(spark, folder):
    late = F.dayofmonth("t0") > 28
    train = _train_part(spark, folder).select(
        KEY, "t0", *[F.when(~late, F.col(c)).alias(c) for c in ("year", "month", "day_of_week")]
    )
    return features.fill_missing(train, features.mode_values(train, ["year", "month", "day_of_week"]))


# ---- evaluation

def _counts(spark, folder):
    return evaluation.score_counts(scored_documents(spark, folder))


@query("pr_curve")
def q_pr_curve(spark, folder):
    return evaluation.pr_curve(_counts(spark, folder))


@query("average_precision")
def q_average_precision(spark, folder):
    return evaluation.average_precision(_counts(spark, folder)).withColumn(
        "average_precision", rounded("average_precision", 8)
    )


@query("best_f1")
def q_best_f1(spark, folder):
    return evaluation.best_f1(_counts(spark, folder))


@query("confusion")
def q_confusion(spark, folder):
    return evaluation.confusion(scored_documents(spark, folder), 0.25)


@query("class_report")
def q_class_report(spark, folder):
    cells = evaluation.confusion(scored_documents(spark, folder), 0.25)
    return evaluation.class_report(cells).withColumns(
        {c: rounded(c, 4) for c in ("precision", "recall", "f1_score")}
    )


# ---- models (no SQL counterpart)

@query("forecast")
def q_forecast(spark, folder):
    """Small boosted trees on the nation grid, then a ranked 30-day forecast."""
    grid = materialize(standard_daily(spark, folder))
    train, _, chosen = build.training_parts(grid)
    weight = counts.class_balance(train).first()["scale_pos_weight"]
    model = fit_single(train, chosen, weight, maxIter=5, maxDepth=3, stepSize=0.3)
    return build.forecast(model, grid, "1D", 720.0, DAY_RUN, k=10)


@query("model_metrics")
def q_model_metrics(spark, folder):
    """Test metrics of small boosted trees on the segment panel."""
    # An order's value exists only where there was one, so it would give the label away.
    panel = materialize(segment_panel(spark, folder).drop("o_totalprice"))
    sizes = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}
    return build.train(panel, "1D", undersample_ratio=0.5, sizes=sizes)[1]


@query("model_stacked")
def q_model_stacked(spark, folder):
    """Test metrics of a small stacked ensemble on the nation grid."""
    grid = materialize(standard_daily(spark, folder))
    sizes = {
        "boosted": {"maxIter": 2, "maxDepth": 2}, "boosted_long": {"maxIter": 2, "maxDepth": 2}, "forest": {"numTrees": 2, "maxDepth": 3},
        "linear": {"maxIter": 3}, "meta": {"maxIter": 5},
    }
    return build.train(grid, "1D", kind="stacked", sizes=sizes)[1]


# ---- reports, contracts and stored outputs

def _place(spark, name: str) -> str:
    """A folder of its own beside the checkpoints, for outputs that a query writes and reads back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{TABLE_PREFIX}{name}-{uuid.uuid4().hex}"


def _report(spark, folder):
    ranked = forecast.top_k(forecast.add_tier(future_scores(spark, folder)), 10)
    return report.forecast_report(ranked.select(KEY, "t0", "prob", "tier"))


@query("ordered_report")
def q_ordered_report(spark, folder):
    return _report(spark, folder)


@query("report_page")
def q_report_page(spark, folder):
    return report.page(_report(spark, folder), 11, 25)


@query("contract_report")
def q_contract_report(spark, folder):
    """What the orders break as incidents, counted while their cells are."""
    order = F.col("o_orderkey")
    time = F.when(order % 97 == 0, "not a date").when(order % 89 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    key = F.when(order % 83 != 0, F.col("o_custkey").cast("string"))
    raw = table(watching_session(spark), folder, "orders").select(key.alias(KEY), time.alias("datetime"))
    contract = Contract(KEY, "datetime")
    cells = materialize(counts.count_incidents(keyed(contract.watch(raw)), "daily"))
    contract.enforce()
    return contract.report(spark).withColumn("cells", F.lit(cells.count()).cast("long"))


@query("text_round_trip")
def q_text_round_trip(spark, folder):
    """Lines written as text and read by a schema: good, damaged and short ones apart; forecasts as CSV and JSON."""
    key = F.col("c_custkey")
    balance = F.when(key % 50 == 0, "n/a").otherwise(F.format_string("%.2f", "c_acctbal"))
    line = F.when(key % 70 == 35, F.concat_ws(",", "c_custkey", "c_nationkey")).otherwise(F.concat_ws(",", "c_custkey", "c_nationkey", balance))
    lines = _place(spark, "lines")
    table(spark, folder, "customer").select(line.alias("value")).write.text(lines)
    read = materialize(read_lines(spark, lines, "id long, nation int, balance double", header=False))
    facts = read.groupBy(line_kind(3).alias("kind")).agg(F.count("*").alias("row_count"), F.round(F.sum("id").cast("double"), 4).alias("total"))
    out = facts.select(F.lit("lines").alias("source"), "kind", "row_count", "total")
    ranked = materialize(forecast.top_k(forecast.add_tier(future_scores(spark, folder)), 3))
    for fmt in ("csv", "json"):
        path = _place(spark, fmt)
        write_forecast(ranked.select(KEY, "t0", "prob", "tier_rank", "tier"), path, fmt)
        back = materialize(read_lines(spark, path, f"{KEY} string, t0 timestamp, prob double, tier_rank int, tier string", fmt))
        facts = back.groupBy(line_kind(5).alias("kind")).agg(F.count("t0").alias("row_count"), F.round(F.sum("prob") + NUDGE, 4).alias("total"))
        out = out.unionByName(facts.select(F.lit(fmt).alias("source"), "kind", "row_count", "total"))
    return out


@query("grid_layout")
def q_grid_layout(spark, folder):
    path = _place(spark, "grid")
    write_grid(standard_daily(spark, folder), path)
    return layout_report(spark.read.parquet(path))


@query("metrics_history")
def q_metrics_history(spark, folder):
    """Three runs appended one by one, the last with a column more; the latest of each frequency."""
    scored = materialize(scored_documents(spark, folder))
    path = _place(spark, "metrics")
    runs = [
        ("1D", datetime(2024, 1, 1), scored, False), ("1W", datetime(2024, 1, 2), scored.filter("doc_id % 3 = 0"), False),
        ("1D", datetime(2024, 1, 3), scored.filter("doc_id % 2 = 0"), True),
    ]
    for freq, time, rows, rated in runs:
        balance = counts.class_balance(rows, "y").withColumns({"freq": F.lit(freq), "run_time": F.lit(time)})
        append_metrics(balance if rated else balance.drop("y1_rate", "scale_pos_weight"), path)
    last = last_runs(metrics_history(spark, path))
    return last.select("freq", "run_time", "pos", "neg", rounded("y1_rate", 6))


# ---- encoded features and linear learners

CATEGORIES = ["month", "day_of_week"]


def _parts(spark, folder):
    """Training part without Decembers (so that they are unseen), and test part."""
    grid = materialize(add_calendar(daily_grid(spark, folder, ("o_totalprice",)), "t0", hour_start="zero"))
    grid = grid.withColumn("day", F.dayofmonth("t0") / F.lit(31.0))
    train, test = features.time_split(grid)
    return train.filter(F.col("month") != 12), test


def _encoder(train, numeric, scale=False):
    return Pipeline(stages=preparation(features.Features(numeric, CATEGORIES), train, scale=scale)).fit(train)


@query("encoded_features")
def q_encoded_features(spark, folder):
    train, test = _parts(spark, folder)
    return with_rounded(linear.feature_rows(_encoder(train, ["day"]), test), "value")


@query("scaled_features")
def q_scaled_features(spark, folder):
    """Numbers of the test part, imputed and scaled by moments of the training part."""
    train, test = _parts(spark, folder)
    prepared = _encoder(train, ["day", "o_totalprice"], scale=True).transform(test)
    values = prepared.withColumn("v", vector_to_array("__scaled"))
    return values.select(KEY, "t0", *[F.round(F.col("v")[k] + NUDGE, 6).alias(c) for k, c in enumerate(("day", "o_totalprice"))])


@query("score_linear")
def q_score_linear(spark, folder):
    """Weights are the difference of the classes' means, slot by slot; NaN, like all scores, if the training part has one class only."""
    train, test = _parts(spark, folder)
    encoder = _encoder(train, ["day"])
    n = counts.class_balance(train).first()
    rows = linear.feature_rows(encoder, train, (KEY, "t0", LABEL))
    # An empty class has no mean: NaN, as 0.0 / 0 is in SQL, where Spark stops at a zero divisor.
    mean = lambda y, total: F.coalesce(F.sum(F.when(F.col(LABEL) == y, F.col("value"))), F.lit(0.0)) / F.lit(total or float("nan"))
    weights = materialize(rows.groupBy("slot").agg((mean(1, n["pos"]) - mean(0, n["neg"])).alias("weight")))
    scored = linear.linear_scores(linear.feature_rows(encoder, test), weights, 0.25, all_keys=test)
    return scored.select(KEY, "t0", F.round(F.col("prob").cast("double") + NUDGE, 5).alias("prob"))


@query("stack_out_of_fold")
def q_stack_out_of_fold(spark, folder):
    train, _ = _parts(spark, folder)
    digest = F.md5(F.concat_ws("|", KEY, F.date_format("t0", "yyyy-MM-dd")))
    fold = F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"), F.lit(5)).cast("int")
    inputs = ["day", "month", "o_totalprice"]
    scored = linear.out_of_fold(train, inputs, fold, 5)
    return scored.select(KEY, "t0", F.col("__fold").alias("fold"), *[rounded(f"line_{c}", 6) for c in inputs])


SMALL_STACK = {
    "boosted": {"maxIter": 2, "maxDepth": 2}, "boosted_long": None, "forest": None, "linear": {"maxIter": 3}, "meta": {"maxIter": 5},
}


@query("saved_model_scores")
def q_saved_model_scores(spark, folder):
    """Models saved and loaded again score the same: rows compared and rows that differ."""
    grid = materialize(standard_daily(spark, folder))
    train, test, chosen = build.training_parts(grid)
    weight = counts.class_balance(train).first()["scale_pos_weight"]
    models = {
        "single": fit_single(train, chosen, weight, maxIter=2, maxDepth=2, stepSize=0.3),
        "stacked": fit_stacked(train, chosen, folds=2, sizes=SMALL_STACK),
    }
    root, out = _place(spark, "models"), None
    for kind, model in models.items():
        model.save(f"{root}/{kind}_1d")
        loaded = load_best(spark, root, "1D")  # the stacked one as soon as there is one
        both = loaded.score(model.score(test, "prob"), "again").agg(
            F.count("*").alias("rows_compared"), F.count_if(~F.col("prob").eqNullSafe(F.col("again"))).alias("rows_different")
        ).select(F.lit(kind).alias("kind"), "rows_compared", "rows_different")
        out = both if out is None else out.unionByName(both)
    return out


@query("train_outcomes")
def q_train_outcomes(spark, folder):
    """One frequency trained, one without a grid, one whose grid lacks the label."""
    grid = materialize(standard_daily(spark, folder))
    sizes = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.3}
    _, rows = build.train_outcomes({"1D": grid, "1W": None, "1M": grid.drop(LABEL)}, sizes=sizes)
    return rows.withColumn("reason", F.substring_index("reason", ";", 1))


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in SQL.items() if name in QUERIES}
