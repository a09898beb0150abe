"""Exact order statistics and running totals that never gather a whole column.

``percentile``/``median`` keep every distinct value of a column in one task.
The functions here narrow the answer down with small mergeable sketches and
counts first, so the rows brought together are bounded by ``GATHER_LIMIT``
whatever the size of the input, and the result is still exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.schema import quoted, to_double
from riskloom.session import materialize

GATHER_LIMIT = 200_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Rank:
    """Search for the value at one rank: it lies strictly between low and high."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    answer: float | None = None
    slack: float = 3.0 / SKETCH_ACCURACY

    @property
    def wide(self) -> bool:
        return self.answer is None and self.inside > GATHER_LIMIT

    def shares(self) -> list[float]:
        """Shares of the current interval between which the rank must lie."""
        at = (self.rank - self.below) / self.inside
        return [max(0.0, at - self.slack), min(1.0, at + self.slack)]

    def value(self) -> Column:
        v = quoted(self.column)
        test = F.lit(True)
        if self.low > -math.inf:
            test = test & (v > self.low)
        if self.high < math.inf:
            test = test & (v < self.high)
        return F.when(test, v)


def exact_quantiles(
    df: DataFrame, probs: dict[str, list[float]], sizes: dict[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of several numeric columns.

    Returns per column one value per requested share, ``None`` if a column has
    no value.  Costs one counting pass (none if ``sizes`` gives the number of
    values per column), then for each further factor of about 1,000 in size two
    passes (sketch and recount) over ``df``; every pass returns a single row.
    Give a frame that is cheap to read again, such as a stored table.
    """
    if not probs:
        return {}
    df = df.select(*[to_double(quoted(c)).alias(c) for c in probs])
    counted = sizes or df.agg(*[F.count(quoted(c)).alias(c) for c in probs]).first().asDict()
    ranks: dict[tuple[str, int], _Rank] = {}
    for c, shares in probs.items():
        n = counted[c]
        for q in shares if n else []:
            position = (n - 1) * q
            for k in {math.floor(position), math.ceil(position)}:
                ranks[c, k] = _Rank(c, k, inside=n)
    while any(r.wide for r in ranks.values()):
        _narrow(df, [r for r in ranks.values() if r.wide])
    _resolve(df, [r for r in ranks.values() if r.answer is None])
    out: dict[str, list[float | None]] = {}
    for c, shares in probs.items():
        out[c] = []
        for q in shares:
            if not counted[c]:
                out[c].append(None)
                continue
            position = (counted[c] - 1) * q
            k = math.floor(position)
            at, after = ranks[c, k].answer, ranks[c, math.ceil(position)].answer
            out[c].append(at + (after - at) * (position - k))
    return out


def _narrow(df: DataFrame, wide: list[_Rank]) -> None:
    """Shrink every interval with a sketch, then count exactly where the rank fell.

    A value repeated in a large share of rows ends the search at once: it is
    an interval border, and borders are counted apart from what lies between.
    """
    bounds = df.agg(
        *[F.percentile_approx(r.value(), r.shares(), SKETCH_ACCURACY).alias(str(i)) for i, r in enumerate(wide)]
    ).first()
    tests = []
    for i, r in enumerate(wide):
        v, (lo, hi) = quoted(r.column), bounds[str(i)]
        tests += [
            F.count_if(v < lo).alias(f"under{i}"),
            F.count_if(v == lo).alias(f"lo{i}"),
            F.count_if((v > lo) & (v < hi)).alias(f"mid{i}"),
            F.count_if((v == hi) & (v > lo)).alias(f"hi{i}"),
        ]
    found = df.agg(*tests).first()
    for i, r in enumerate(wide):
        lo, hi = bounds[str(i)]
        at = r.rank - found[f"under{i}"]
        if at < 0 or at >= found[f"lo{i}"] + found[f"mid{i}"] + found[f"hi{i}"]:
            r.slack *= 4  # outside the sketch's promised error: look wider
        elif at < found[f"lo{i}"]:
            r.answer = lo
        elif at < found[f"lo{i}"] + found[f"mid{i}"]:
            r.low, r.high = lo, hi
            r.below, r.inside = found[f"under{i}"] + found[f"lo{i}"], found[f"mid{i}"]
        else:
            r.answer = hi


def _resolve(df: DataFrame, rest: list[_Rank]) -> None:
    """Look up the ranks among the few values left in each interval."""
    if not rest:
        return
    picks = F.array(*[F.struct(F.lit(i).alias("id"), r.value().alias("v")) for i, r in enumerate(rest)])
    values = (
        df.select(F.explode(F.filter(picks, lambda p: p["v"].isNotNull())).alias("p")).select("p.id", "p.v")
        .groupBy("id", "v").agg(F.count("*").alias("n"))
    )
    ends = values.withColumn("end", F.sum("n").over(Window.partitionBy("id").orderBy("v")))
    offset = F.create_map(*[F.lit(x) for i, r in enumerate(rest) for x in (i, r.rank - r.below)])
    rows = ends.filter(F.col("end") > F.element_at(offset, F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    for row in rows.collect():  # one row per rank
        rest[row["id"]].answer = row["v"]


def nth_smallest(df: DataFrame, column: str, n: int):
    """The ``n``-th smallest value (from 1) of a column that may be of any type.

    Values are range-partitioned and sorted, numbered per partition and written
    once; the counts per partition then tell which one holds the answer.
    """
    values = df.select(F.col(column).alias("v"))
    numbered = materialize(
        values.repartitionByRange("v").sortWithinPartitions("v")
        .withColumn("id", F.monotonically_increasing_id())
    )
    part = F.shiftright("id", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    home = sizes.withColumn("before", before).filter(
        (F.col("before") < n) & (F.col("before") + F.col("n") >= n)
    ).first()
    wanted = (home["part"] << 33) + (n - 1 - home["before"])
    return numbered.filter(F.col("id") == wanted).first()["v"]


HISTOGRAM_BITS = 16


@dataclass(frozen=True)
class Place:
    """A value, how many of its equals are needed to reach the rank, and how many exist."""

    value: int
    needed: int
    equals: int


def nth_smallest_long(df: DataFrame, key: Column, n: int) -> Place:
    """The ``n``-th smallest (from 1) of a 64-bit integer key, by radix histograms.

    Each of at most four passes counts rows by the next 16 bits inside the
    range found so far: no sort, no sample, and at most 65,536 groups.  A range
    with a single distinct value ends the search early.
    """
    values = df.select(key.alias("v"))
    low, high = -(1 << 63), (1 << 63) - 1
    for shift in range(64 - HISTOGRAM_BITS, -1, -HISTOGRAM_BITS):
        cell = F.shiftright("v", shift)
        counts = (
            values.filter(F.col("v").between(low, high))
            .groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        ends = counts.withColumn("end", F.sum("n").over(Window.orderBy("cell")))
        home = ends.filter(F.col("end") >= n).orderBy("end").first()
        n -= home["end"] - home["n"]
        low, high = home["lo"], home["hi"]
        if low == high:
            break
    return Place(low, n, home["n"])


def score_band(score: Column) -> Column:
    """A monotone integer band for a 32-bit float.

    A band holds the values sharing sign, exponent and leading eight mantissa
    bits: at most 32,768 different floats, and at most some 140,000 bands exist.
    The rule does not depend on the data, so a retried task bands alike.
    """
    size = F.abs(score.cast("double"))
    exponent = F.floor(F.log2(size))
    mantissa = F.floor(size * F.pow(F.lit(2.0), -exponent) * 256)
    band = (exponent + 150) * 512 + mantissa
    return F.when(score == 0, F.lit(0)).otherwise(F.signum(score) * band).cast("int")


def running_totals(by_score: DataFrame, score: str, measures: list[str]) -> DataFrame:
    """Add ``cum_<measure>``, totals over all scores >= the row's own, and ``all_<measure>``.

    ``by_score`` has one row per 32-bit score, none of them null.  Totals run within bands, and
    the totals of higher bands are added from a table of at most one row per
    band, which is what makes the broadcast safe.
    """
    # Never null, so the join adds no filter to one side only: both sides stay
    # the same subplan up to the exchange by score, which Spark then runs once.
    band = F.coalesce(score_band(F.col(score)), F.lit(0))
    banded = by_score.withColumn("__band", band)
    bands = banded.groupBy("__band").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    higher = Window.orderBy(F.col("__band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bands.select(
        "__band",
        *[F.coalesce(F.sum(f"__t_{m}").over(higher), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__t_{m}").over(Window.partitionBy()).alias(f"all_{m}") for m in measures],
    )
    inside = Window.partitionBy("__band").orderBy(F.col(score).desc())
    joined = banded.withColumns({f"__w_{m}": F.sum(m).over(inside) for m in measures}).join(
        F.broadcast(offsets), "__band"
    )
    cums = [(F.col(f"__w_{m}") + F.col(f"__o_{m}")).alias(f"cum_{m}") for m in measures]
    return joined.select(*[F.col(c) for c in by_score.columns], *cums, *[F.col(f"all_{m}") for m in measures])
