"""Reading tables, names that cannot clash, and the constants operators share."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the line and word contracts: space, tab, LF, VT, FF, CR.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table of a folder, read by Spark from whatever store holds it."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``frame`` doesn't use yet (in any case)."""
    used = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    return f"{folder.rstrip('/')}/{name}" if folder else public_tokenizers.path(name)


def is_training_row(doc_id: Column, folds: int, held: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``, differs from ``held``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(held)) != held
