"""The warehouse tables seen as incidents, requests and scored sets.

===========  =============================================  ==================
incidents    area                                           time
===========  =============================================  ==================
by nation    nation of the ordering customer                order date
by segment   nation and market segment of the customer      order date
hourly       user of an event                               event time
===========  =============================================  ==================
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.counts import aggregate_cells, cell_time
from riskloom.operators.forecast import forecast_frame
from riskloom.operators.grid import dense_grid, time_span
from riskloom.plans.build import labelled_panel, normalize_daily
from riskloom.schema import COUNT, KEY, LABEL, label, normalize_key
from riskloom.sources.readers import resolve_event_time

TZ = "America/Los_Angeles"
DAY_RUN = datetime(2001, 8, 2, 9, 30)
HOUR_RUN = datetime(2024, 1, 31, 9, 30)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day_incidents(spark: SparkSession, folder: str, segment: bool = False, items: bool = False) -> DataFrame:
    """One incident per order; optionally by market segment and with its item count."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    area = F.col("c_nationkey").cast("string")
    if segment:
        area = F.concat_ws("-", area, F.col("c_mktsegment"))
    raw = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    picked = [area.alias("geoid"), F.col("o_orderdate").alias("datetime"), F.col("o_totalprice")]
    if items:
        per_order = (
            table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("item_count"))
        )
        raw = raw.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        picked.append(F.col("item_count"))
    return raw.select(*picked)


def hour_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """One incident per event, with its value as a side feature."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("geoid"), F.col("ts").alias("datetime"), "value"
    )


def keyed(incidents: DataFrame) -> DataFrame:
    return resolve_event_time(normalize_key(incidents))


def count_grid(incidents: DataFrame, granularity: str, side_cols: tuple[str, ...] = ()) -> DataFrame:
    """Dense counts and labels, without calendar or priors."""
    raw = keyed(incidents)
    time_col = "dt" if granularity == "hourly" else "t0"
    span = time_span(raw.select(cell_time(granularity).alias(time_col)), time_col)
    cells = aggregate_cells(raw, granularity, side_cols)
    return dense_grid(cells, time_col, span, (COUNT,)).withColumn(LABEL, label(F.col(COUNT)))


def daily_grid(spark: SparkSession, folder: str, side_cols: tuple[str, ...] = (), segment: bool = False) -> DataFrame:
    incidents = day_incidents(spark, folder, segment, items="item_count" in side_cols)
    return count_grid(incidents, "daily", side_cols)


def standard_daily(spark: SparkSession, folder: str, side_cols: tuple[str, ...] = ()) -> DataFrame:
    return normalize_daily(daily_grid(spark, folder, side_cols), unique_cells=True)


def segment_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The training panel: areas by segment, order value as side feature, 90/365-day priors."""
    return labelled_panel(day_incidents(spark, folder, segment=True), side_cols=["o_totalprice"])


def future_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A 30-day forecast scored by the last prior rate, damped over the week.

    Rests on the written snapshot, so tier limits and ranking do not go back
    to the incidents.
    """
    frame = forecast_frame(standard_daily(spark, folder), "1D", 720.0, DAY_RUN)
    prob = (F.col("prior_p_180d") / (1 + F.col("day_of_week").cast("int"))).cast("float")
    return frame.select(KEY, "t0", prob.alias("prob"))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents, scored by their length."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("y"))
    score = (F.col("n_chars") / F.lit(20000.0)).cast("float")
    return labels.join(documents, "doc_id").select("doc_id", "y", score.alias("p"))
