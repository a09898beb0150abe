import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators.evaluation import average_precision, best_f1, class_report, confusion, pr_curve, score_counts


def sample(spark, seed=4, n=2000, levels=None):
    rng = np.random.default_rng(seed)
    p = rng.random(n).astype(np.float32)
    if levels:
        p = (np.floor(p * levels) / levels).astype(np.float32)
    y = (rng.random(n) < 0.2 + 0.6 * p).astype(int)
    frame = pd.DataFrame({"y": y, "p": p.astype(float)})
    return frame, spark.createDataFrame(frame)


def brute_curve(frame):
    """Straight from the definitions, one threshold at a time."""
    p32 = frame["p"].astype(np.float32)
    rows = []
    for th in sorted(p32.unique()):
        hit = p32 >= th
        tp = int((frame["y"][hit] == 1).sum())
        rows.append((float(th), tp / int(hit.sum()), tp / max(1, int(frame["y"].sum()))))
    return rows


@pytest.mark.parametrize("levels", [None, 10])
def test_curve_average_precision_and_best_f1(spark, levels):
    frame, df = sample(spark, levels=levels)
    counts = score_counts(df)
    want = brute_curve(frame)
    got = [tuple(r) for r in pr_curve(counts).orderBy(F.col("threshold").asc_nulls_last()).collect()]
    assert got[-1] == (None, 1.0, 0.0)
    assert np.allclose(np.array(got[:-1], float), np.array(want), rtol=1e-12)
    recalls = [0.0] + [r for _, _, r in reversed(want)]
    ap = sum((recalls[i + 1] - recalls[i]) * p for i, (_, p, _) in enumerate(reversed(want)))
    row = average_precision(counts).first()
    assert row["average_precision"] == pytest.approx(ap, rel=1e-12) and not row["leak_alarm"]
    f1 = [2 * p * r / (p + r + 1e-12) for _, p, r in want]
    best = best_f1(counts).first()
    i = int(np.argmax(f1))
    assert best["best_threshold"] == want[i][0] and best["f1_best"] == pytest.approx(f1[i], rel=1e-12)


def test_single_class_sets(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, p double")
    assert confusion(df, 0.5).first().asDict() == {"tn": 1, "fp": 1, "fn": 0, "tp": 0}
    assert average_precision(score_counts(df)).first()["average_precision"] == 0.0
    assert best_f1(score_counts(df)).first()["f1_best"] == 0.0
    ones = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")
    row = average_precision(score_counts(ones)).first()
    assert row["average_precision"] == 1.0 and row["leak_alarm"]


def test_empty_set(spark):
    df = spark.createDataFrame([], "y int, p double")
    assert confusion(df, 0.5).first().asDict() == {"tn": 0, "fp": 0, "fn": 0, "tp": 0}
    assert best_f1(score_counts(df)).first()["best_threshold"] == 0.5


def test_report_averages(spark):
    cells = spark.createDataFrame([(50, 10, 5, 35)], "tn long, fp long, fn long, tp long")
    rows = {r["class"]: r for r in class_report(cells).collect()}
    assert rows["1"]["precision"] == pytest.approx(35 / 45) and rows["1"]["recall"] == pytest.approx(35 / 40)
    assert rows["accuracy"]["f1_score"] == pytest.approx(0.85)
    f0, f1 = 100 / 115, 70 / 85
    assert rows["macro avg"]["f1_score"] == pytest.approx((f0 + f1) / 2)
    assert rows["weighted avg"]["f1_score"] == pytest.approx(0.6 * f0 + 0.4 * f1)
    assert rows["0"]["support"] == 60 and rows["weighted avg"]["support"] == 100


def test_one_score_holding_a_third_of_rows(spark):
    df = spark.range(9000).select(
        (F.col("id") % 5 == 0).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") % 997) / 997.0).alias("p"),
    )
    frame = df.toPandas()
    got = pr_curve(score_counts(df), final_point=False).orderBy("threshold").toPandas()
    assert np.allclose(got.to_numpy(float), np.array(brute_curve(frame)), rtol=1e-12)
