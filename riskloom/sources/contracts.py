"""Input contracts that are checked in the pass that reads the rows anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.timing import as_instant
from riskloom.schema import quoted, require

CORRUPT = "__malformed"


def watching_session(spark: SparkSession) -> SparkSession:
    """A session for frames that are watched, with the same catalog of files and time zone.

    A session that has observed once cannot score tree models any more (Spark
    ships the session with them, but not what keeps its observations), so
    watched inputs are read in one of their own.
    """
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    return own


class Contract:
    """Counts of what an input breaks, gathered by whatever job first runs over it.

    ``watch`` adds the counters to a frame, best one of a ``watching_session``;
    ``facts`` are known after the first action on anything made from it, and
    ``enforce`` then raises if the input cannot be used.  A frame should be
    watched once, and read once in that job.
    """

    def __init__(self, key: str, time_col: str) -> None:
        self.key, self.time_col = key, time_col
        self.observation = Observation()
        self.watched = False

    def watch(self, df: DataFrame) -> DataFrame:
        require(df, [self.key, self.time_col], "contract")
        instant, given = as_instant(df, self.time_col), quoted(self.time_col)
        self.watched = True
        return df.observe(
            self.observation, F.count(F.lit(1)).alias("row_count"), F.count_if(instant.isNull() & given.isNotNull()).alias("unreadable_times"),
            F.count_if(given.isNull()).alias("null_times"), F.count_if(quoted(self.key).isNull()).alias("null_keys"),
        )

    def facts(self) -> dict[str, int]:
        """Waits for the first action to end; an input whose partitions were all pruned counts as empty."""
        if not self.watched:
            raise ValueError("nothing is watched yet")
        return {name: 0 for name in ("row_count", "unreadable_times", "null_times", "null_keys")} | self.observation.get

    def enforce(self, strict: bool = False) -> dict[str, int]:
        """Raise if no time can be used, or with ``strict`` if any can't."""
        facts = self.facts()
        bad = facts["unreadable_times"] + facts["null_times"]
        if bad == facts["row_count"]:
            raise ValueError(f"column {self.time_col}: no time could be parsed")
        if strict and bad:
            raise ValueError(f"column {self.time_col}: {bad} of {facts['row_count']} times are missing or unreadable")
        return facts

    def report(self, spark: SparkSession) -> DataFrame:
        """The facts as one row."""
        return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in self.facts().items()])


def read_lines(spark: SparkSession, path: str, schema: str, fmt: str = "csv", header: bool = True) -> DataFrame:
    """CSV or JSON lines by an explicit schema; a line that doesn't fit keeps its text in ``__malformed``.

    No inference, and no job that fails on one bad line.  All columns are
    parsed, whatever is used of them later, so that the verdict on a line does
    not depend on the query: write the result before selecting from it.
    """
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "csv":
        return reader.option("enforceSchema", "true").csv(path, header=header)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unsupported format {fmt!r}")


def line_kind(fields: int, separator: str = ",") -> Column:
    """``good``, ``short`` (a CSV line with fewer fields than asked for) or ``damaged`` for rows of ``read_lines``."""
    text = F.col(CORRUPT)
    fewer = F.size(F.split(text, f"[{separator}]", -1)) < fields
    return F.when(text.isNull(), "good").when(fewer, "short").otherwise("damaged")
