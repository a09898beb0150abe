"""Parquet and CSV sources, event time choice and input contracts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.timing import as_instant, floor_hour, parse_instant
from riskloom.schema import METRIC_TABLE_COLUMNS, RISK_TABLE_COLUMNS, quoted


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Those of ``columns`` that ``df`` has, ignoring case; all of ``df`` if none match.

    Only a projection: Catalyst carries it into the scan's read schema.
    """
    by_lower = {name.lower(): name for name in df.columns}
    found = [c if c in df.columns else by_lower.get(c.lower()) for c in columns]
    wanted = list(dict.fromkeys(name for name in found if name))
    return df.select(*[quoted(name) for name in wanted]) if wanted else df


def read_columns(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] | None = None,
    fmt: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Read parquet or CSV, keeping only the wanted columns that exist.

    CSV is read with its header and as text unless a ``schema`` is given: no
    inference pass over the data, and keys keep their leading zeros.
    """
    fmt = fmt or ("csv" if path.lower().endswith((".csv", ".csv.gz")) else "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        df = reader.csv(path, header=True)
    elif fmt == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return df if columns is None else select_present(df, columns)


def parsed_time(df: DataFrame, name: str, strict: bool = False, out: str | None = None) -> DataFrame:
    """Replace a time column by its UTC timestamp.

    Lenient: bad values become NULL.  Strict: the first bad value fails the
    job, checked while rows stream through rather than in an extra pass.
    """
    instant = as_instant(df, name)
    if strict:
        instant = F.when(
            instant.isNull(), F.raise_error(F.lit(f"column {name} holds an unparsable time"))
        ).otherwise(instant)
    return df.withColumn(out or name, instant)


def ensure_some_time(df: DataFrame, name: str) -> DataFrame:
    """Fail if no row has a usable time; reads only until the first good row."""
    if df.filter(F.col(name).isNotNull()).select(F.lit(1)).isEmpty():
        raise ValueError(f"column {name}: no time could be parsed")
    return df


def resolve_event_time(df: DataFrame, out: str = "dt", check: bool = False) -> DataFrame:
    """Add the event hour (UTC) from the best time column present.

    The choice is by column, not by row: ``datetime``, then ``date`` with
    ``time``, then ``event_hour``, then ``received_time``.  Times without an
    offset are UTC.
    """
    names = set(df.columns)
    if "datetime" in names:
        instant = as_instant(df, "datetime")
    elif {"date", "time"} <= names:
        instant = parse_instant(
            F.concat_ws(" ", F.col("date").cast("string"), F.col("time").cast("string"))
        )
    elif "event_hour" in names:
        instant = as_instant(df, "event_hour")
    elif "received_time" in names:
        instant = as_instant(df, "received_time")
    else:
        raise ValueError("need datetime, date+time, event_hour or received_time")
    df = df.withColumn(out, floor_hour(instant))
    return ensure_some_time(df, out) if check else df


def schema_report(df: DataFrame, kind: str) -> DataFrame:
    """One row: which expected columns a side table has, and how many rows.

    ``risk`` needs all its columns (names compared without case); ``metrics``
    only reports which ones exist (exact names).
    """
    if kind == "risk":
        have = {c.lower() for c in df.columns}
        found = [c for c in RISK_TABLE_COLUMNS if c in have]
        complete = len(found) == len(RISK_TABLE_COLUMNS)
    elif kind == "metrics":
        found = [c for c in METRIC_TABLE_COLUMNS if c in df.columns]
        complete = bool(found)
    else:
        raise ValueError(f"unknown table kind {kind!r}")
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(kind).alias("table_kind"),
        F.lit(complete).alias("schema_ok"),
        F.lit(",".join(found)).alias("columns_found"),
        "row_count",
    )
