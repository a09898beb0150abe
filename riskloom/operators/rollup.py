"""Aggregation of a grid to coarser time buckets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schema import COUNT, DAILY_PROTECTED, KEY, LABEL, label, numeric_columns, quoted


def rollup(
    df: DataFrame,
    start: Column,
    protected: Iterable[str] = DAILY_PROTECTED,
    sum_cols: Iterable[str] = (COUNT,),
    group_extra: Iterable[str] = (),
    out: str = "t0",
) -> DataFrame:
    """Per area and bucket: ``sum_cols`` added up, every other number averaged.

    ``start`` is the bucket start of a row.  Columns in ``protected`` are not
    averaged; names in ``group_extra`` join the grouping key if present.
    Missing numbers (NULL or NaN) add nothing; sums of fractional columns keep
    their fraction.
    Adds the label of the bucket.
    """
    extra = [c for c in group_extra if c in df.columns]
    numbers = set(numeric_columns(df))
    sums = [c for c in sum_cols if c in numbers]
    means = [c for c in numeric_columns(df, set(protected) | set(sums) | set(extra))]
    keyed = df.withColumn("__bucket", start).dropna(subset=[KEY, "__bucket", *extra])
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FractionalType, T.DecimalType))}
    added = lambda c: F.sum(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double"))) if c in fractional else F.sum(quoted(c))
    measures = [F.coalesce(added(c), F.lit(0)).cast("double" if c in fractional else "bigint").alias(c) for c in sums]
    measures += [F.avg(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in means]
    grouped = keyed.groupBy(KEY, F.col("__bucket").alias(out), *extra)
    # Without any number left only the distinct cells remain.
    result = grouped.agg(*measures) if measures else grouped.count().drop("count")
    total = quoted(COUNT) if COUNT in result.columns else F.lit(0)
    return result.withColumn(LABEL, label(total))
