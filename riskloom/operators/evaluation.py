"""Quality measures of a scored test set (label ``y`` 0/1, score ``p``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.order_stats import running_totals

LEAK_ALARM = 0.95  # fixed value: a higher average precision hints at leakage
EPSILON = 1e-12  # fixed value: keeps F1 defined when precision and recall are 0


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per distinct 32-bit score: rows and positives, with running totals from the top."""
    by_score = df.groupBy(F.col(p).cast("float").alias("threshold")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col(y).cast("bigint")), F.lit(0)).alias("pos")
    )
    return running_totals(by_score.dropna(subset=["threshold"]), "threshold", ["n", "pos"])


def _measures(counts: DataFrame) -> DataFrame:
    total = F.col("all_pos")
    precision = F.col("cum_pos").cast("double") / F.col("cum_n")
    recall = F.when(total > 0, F.col("cum_pos").cast("double") / total).otherwise(1.0)
    return counts.select("threshold", "pos", precision.alias("precision"), recall.alias("recall"))


def pr_curve(counts: DataFrame, final_point: bool = True) -> DataFrame:
    """Precision and recall at every threshold, plus the final (1, 0) without one."""
    curve = _measures(counts).select("threshold", "precision", "recall")
    if not final_point:
        return curve
    end = counts.sparkSession.range(1).select(
        F.lit(None).cast("float").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return curve.unionByName(end)


def average_precision(counts: DataFrame) -> DataFrame:
    """Step-wise area: precision weighted by the recall gained at each score."""
    gained = F.sum(F.col("pos") * F.col("cum_pos").cast("double") / F.col("cum_n"))
    return counts.agg(
        F.coalesce(F.try_divide(gained, F.sum("pos").cast("double")), F.lit(0.0)).alias("average_precision")
    ).withColumn("leak_alarm", F.col("average_precision") > LEAK_ALARM)


def best_f1(counts: DataFrame) -> DataFrame:
    """Threshold with the highest F1; the lowest one among equals.

    A single aggregate over the curve: the maximum of (f1, -threshold).
    """
    curve = _measures(counts)
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * (p * r) / (p + r + EPSILON)
    best = curve.agg(
        F.max(
            F.struct(f1.alias("f1"), (-F.col("threshold")).alias("neg"), p.alias("precision"), r.alias("recall"))
        ).alias("b")
    )
    return best.select(
        F.coalesce(-F.col("b.neg"), F.lit(0.5)).cast("float").alias("best_threshold"),
        F.coalesce("b.f1", F.lit(0.0)).alias("f1_best"),
        F.coalesce("b.precision", F.lit(0.0)).alias("precision_at_best"),
        F.coalesce("b.recall", F.lit(0.0)).alias("recall_at_best"),
    )


def confusion(df: DataFrame, threshold, y: str = "y", p: str = "p") -> DataFrame:
    """All four cells at ``score >= threshold`` (a number or a Column)."""
    limit = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    hit = F.col(p).cast("float") >= limit.cast("float")
    true = F.col(y).cast("int") == 1

    def cell(test):
        return F.coalesce(F.count_if(test), F.lit(0))

    return df.agg(
        cell(~true & ~hit).alias("tn"), cell(~true & hit).alias("fp"),
        cell(true & ~hit).alias("fn"), cell(true & hit).alias("tp"),
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and both averages."""
    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.cast("bigint").alias("support"),
        )

    per_class = {
        "0": (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fp + fn), tn + fp),
        "1": (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    zero, one = per_class["0"], per_class["1"]
    accuracy = ratio(tn + tp, total)
    macro = [(zero[i] + one[i]) / 2 for i in range(3)]
    weighted = [ratio(zero[i] * zero[3] + one[i] * one[3], total) for i in range(3)]
    lines = F.array(
        line("0", *zero), line("1", *one),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )
    return cells.select(F.explode(lines).alias("r")).select("r.*")
