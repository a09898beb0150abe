"""Sinks: grids, forecasts, statistics, metrics and fitted models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import KEY, quoted
from riskloom.session import materialize, release

# Column types of a stored grid; other fractions become float.
SINK_TYPES = {
    "year": "smallint", "month": "tinyint", "day_of_week": "tinyint", "hour": "tinyint",
    "hour_start": "tinyint", "block_id": "tinyint", "Y_label": "tinyint",
}
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def narrow(df: DataFrame) -> DataFrame:
    """Cast to the declared storage types (counts stay 64-bit, they may not wrap)."""
    out = []
    for field in df.schema.fields:
        c = quoted(field.name)
        if field.name in SINK_TYPES:
            c = c.cast(SINK_TYPES[field.name])
        elif isinstance(field.dataType, T.DoubleType):
            c = c.cast("float")
        out.append(c.alias(field.name))
    return df.select(*out)


def write_grid(
    df: DataFrame, path: str, time_col: str = "t0", partitions: int | None = None, mode: str = "overwrite", stored: bool = False
) -> None:
    """Parquet in (area, time) order: files hold ranges, so key and time filters skip them.

    Ranges are found by sampling keys, a pass of its own, so the grid is
    computed once into the shared folder first, unless it is ``stored``.
    """
    spread = [KEY, time_col] if partitions is None else [partitions, KEY, time_col]
    order = [KEY, time_col] + (["block_id"] if "block_id" in df.columns else [])
    rows = narrow(df) if stored else materialize(narrow(df))
    rows.repartitionByRange(*spread).sortWithinPartitions(*order).write.mode(mode).parquet(path)
    if not stored:
        release(rows)


def file_ranges(grid: DataFrame, time_col: str = "t0") -> DataFrame:
    """Each file of a stored grid with its rows and its first and last (area, time): ``file, row_count, low, high``."""
    place = F.struct(KEY, time_col)
    return grid.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("row_count"), F.min(place).alias("low"), F.max(place).alias("high")
    )


def layout_report(grid: DataFrame, time_col: str = "t0") -> DataFrame:
    """One row: ``row_count``, and ``overlapping_files``, those that begin before an earlier one ends."""
    before = F.max("high").over(Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1))
    marked = file_ranges(grid, time_col).withColumn("overlaps", F.coalesce(F.col("low") < before, F.lit(False)))
    return marked.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.count_if("overlaps").alias("overlapping_files"))


def write_grid_table(df: DataFrame, table: str, buckets: int, time_col: str = "t0", mode: str = "overwrite") -> None:
    """A table bucketed and sorted by area: priors, roll-ups and snapshots on it need no exchange."""
    (
        narrow(df).repartition(buckets, KEY).write.mode(mode)
        .bucketBy(buckets, KEY).sortBy(KEY, time_col).format("parquet").saveAsTable(table)
    )


def export_rows(forecast: DataFrame) -> DataFrame:
    """Forecast rows with ``t0`` as ISO-8601 text in UTC."""
    return forecast.withColumn("t0", F.date_format("t0", ISO_FORMAT))


def write_forecast(forecast: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> None:
    """CSV with header, or JSON lines."""
    rows = export_rows(forecast)
    if fmt == "csv":
        rows.write.mode(mode).csv(path, header=True)
    elif fmt == "json":
        rows.write.mode(mode).json(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_small_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file; only for tables of a few rows such as label statistics."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """Append run metrics (one row per run) to a JSON lines table."""
    metrics.write.mode(mode).json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metrics rows to a Parquet history; runs may have columns that others lack."""
    metrics.write.mode("append").parquet(path)


def metrics_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a history, with the columns of all of them."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def last_runs(history: DataFrame, per: str = "freq", by: str = "run_time") -> DataFrame:
    """The latest run of each frequency, ties by the larger row."""
    others = [c for c in history.columns if c not in (per, by)]
    latest = F.max(F.struct(by, *others)).alias("last")
    return history.groupBy(per).agg(latest).select(per, "last.*")


def write_pr_curve(curve: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Precision and recall by ascending threshold, the final point last."""
    (
        curve.orderBy(F.col("threshold").asc_nulls_last()).select("precision", "recall")
        .write.mode(mode).csv(path, header=True)
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The class report as text lines with four digits."""
    numbers = [F.format_number(c, 4) for c in ("precision", "recall", "f1_score")]
    cells = [F.rpad(F.col("class"), 14, " "), *[F.lpad(n, 10, " ") for n in numbers], F.lpad(F.col("support").cast("string"), 12, " ")]
    return report.select(F.concat_ws(" ", *cells).alias("value"))


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report_lines(report).coalesce(1).write.mode(mode).text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, candidates: Iterable[str]) -> str:
    tried = list(candidates)
    for path in tried:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {tried} exists")


def grid_path(root: str, freq: str) -> str:
    return f"{root}/grid_{freq.lower()}"


def stored_grids(spark: SparkSession, root: str, freqs: Iterable[str]) -> dict[str, DataFrame | None]:
    """The written grids by frequency; None where there is none."""
    paths = {f: grid_path(root, f) for f in freqs}
    return {f: spark.read.parquet(p) if exists(spark, p) else None for f, p in paths.items()}
