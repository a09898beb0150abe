import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import order_stats
from riskloom.functions.order_stats import (
    exact_quantiles, nth_smallest, nth_smallest_long, running_totals, score_band,
)

SHARES = [0.0, 0.2, 0.37, 0.5, 0.8, 1.0]


@pytest.fixture
def tiny_gather(monkeypatch):
    """Force the distributed paths on small data."""
    monkeypatch.setattr(order_stats, "GATHER_LIMIT", 50)


def columns(spark):
    rng = np.random.default_rng(11)
    n = 30_000
    frame = pd.DataFrame({
        "smooth": rng.normal(size=n), "binary": (rng.random(n) < 0.5).astype(float), "heavy": np.where(rng.random(n) < 0.7, 0.0, rng.random(n)),
        "few": rng.integers(0, 4, n).astype(float), "holes": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)),
        "flat": np.ones(n), "huge": rng.normal(size=n) * 10.0 ** rng.integers(-30, 30, n),
    })
    return frame, spark.createDataFrame(frame).repartition(8)


def test_quantiles_equal_numpy_on_every_path(spark, tiny_gather):
    frame, df = columns(spark)
    got = exact_quantiles(df, {c: SHARES for c in frame})
    for c in frame:
        v = np.sort(frame[c].dropna().to_numpy())
        for q, value in zip(SHARES, got[c]):
            at = (len(v) - 1) * q
            k = int(np.floor(at))
            want = v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k)
            assert value == want, (c, q)


def test_quantiles_of_small_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {"a": [1.5], "b": [None]}
    scores = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.7)], "p double")
    assert exact_quantiles(scores, {"p": [0.8, 0.6, 0.4, 0.2]})["p"] == pytest.approx([0.46, 0.34, 0.26, 0.18])


@pytest.mark.parametrize("n", [1, 2, 77, 1000, 4999, 5000])
def test_nth_smallest_text(spark, tiny_gather, n):
    words = [f"k{(i * 7919) % 100003:06d}" for i in range(5000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(7)
    assert nth_smallest(df, "w", n) == sorted(words)[n - 1]


def test_nth_smallest_long_with_repeats_and_extremes(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000), np.repeat(42, 1000), [-(2**63), 2**63 - 1]])
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    ordered = np.sort(values)
    for n in (1, 2, 1500, 2000, 2500, len(values)):
        place = nth_smallest_long(df, F.col("v"), n)
        assert place.value == ordered[n - 1]
        assert place.needed == n - int((ordered < place.value).sum())
        assert place.equals == int((ordered == place.value).sum())


def test_score_bands_are_monotone_and_small(spark):
    edges = [2.0**-e for e in range(0, 150)] + [0.0, -0.0, 1.0, 3.5, 1e30, -1e-30, -2.0]
    near = [float(np.nextafter(np.float32(e), np.float32(s))) for e in edges for s in (-np.inf, np.inf)]
    scores = sorted({float(np.float32(x)) for x in edges + near})
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", score_band(F.col("s").cast("float")).alias("b"))
    bands = [r["b"] for r in df.orderBy("s").collect()]
    assert bands == sorted(bands) and None not in bands
    step = np.arange(0, 200_000, dtype=np.uint32) + np.float32(0.25).view(np.uint32)
    dense = spark.createDataFrame(pd.DataFrame({"s": step.view(np.float32).astype(float)}))
    sizes = dense.groupBy(score_band(F.col("s").cast("float")).alias("b")).count().agg(F.max("count")).first()[0]
    assert sizes == 32_768


def test_running_totals_equal_a_plain_cumulative_sum(spark):
    rng = np.random.default_rng(2)
    scores = np.unique(np.concatenate([rng.random(3000), rng.random(500) * 1e-6, [0.0, 1.0]]).astype(np.float32))
    n = rng.integers(1, 9, len(scores))
    df = spark.createDataFrame(pd.DataFrame({"s": scores, "n": n})).withColumn("s", F.col("s").cast("float"))
    got = running_totals(df, "s", ["n"]).toPandas().sort_values("s", ascending=False)
    assert got["cum_n"].tolist() == np.cumsum(n[::-1]).tolist()


def test_running_totals_plan_has_no_single_partition_over_scores(spark, plan_of):
    df = spark.createDataFrame([(0.5, 1)], "s float, n long").groupBy("s").agg(F.sum("n").alias("n"))
    plan = plan_of(running_totals(df, "s", ["n"]))
    assert plan.count("Exchange SinglePartition") == 1  # the table of bands
    assert "HashAggregate(keys=[__band" in plan and "BroadcastHashJoin" in plan


def test_running_totals_shuffle_the_scores_once(spark, plan_of, tmp_path):
    spark.range(1000).select((F.col("id") / 1000).cast("float").alias("s"), F.lit(1).alias("n")).write.parquet(str(tmp_path / "s"))
    by_score = spark.read.parquet(str(tmp_path / "s")).groupBy("s").agg(F.sum("n").alias("n"))
    out = running_totals(by_score, "s", ["n"])
    out.collect()
    final = plan_of(out).split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
