"""Linear learners in closed form, and scoring of encoded features as rows.

Features in long form are rows ``(key, slot, value)`` without zeros.  Lines are
fitted from moments that tasks add up on their own, so all folds are fitted in
one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schema import KEY, LABEL, quoted, to_double

def fold_lines(train: DataFrame, inputs: Iterable[str], fold: Column, folds: int, y: str = LABEL) -> dict[str, list[tuple[float, float]]]:
    """By input and fold: slope and intercept of ``y`` fitted on all *other* folds.

    One aggregate row; rows with a missing input are left out of its lines.
    An input that doesn't vary predicts the mean.
    """
    inputs = list(inputs)
    target = F.col(y).cast("double")
    marked = train.withColumn("__fold", fold)
    measures = []
    for at, name in enumerate(inputs):
        x = to_double(quoted(name))
        for k in range(folds):
            other = F.when(F.col("__fold") != k, target)
            measures += [
                F.regr_slope(other, x).alias(f"slope_{at}_{k}"), F.regr_intercept(other, x).alias(f"intercept_{at}_{k}"),
                F.avg(F.when(x.isNotNull(), other)).alias(f"mean_{at}_{k}"),
            ]
    row = marked.agg(*measures).first()
    lines = {}
    for at, name in enumerate(inputs):
        lines[name] = []
        for k in range(folds):
            slope, intercept, mean = (row[f"{what}_{at}_{k}"] for what in ("slope", "intercept", "mean"))
            lines[name].append((0.0, mean) if slope is None else (slope, intercept))
    return lines


def out_of_fold(train: DataFrame, inputs: Iterable[str], fold: Column, folds: int, y: str = LABEL, prefix: str = "line_") -> DataFrame:
    """Add ``__fold`` and, for each input, the score of the line fitted without the row's fold.

    Scores are null where the input is, or where nothing was left to fit on.
    """
    lines = fold_lines(train, inputs, fold, folds, y)
    out = train.withColumn("__fold", fold)
    scores = {}
    for name, own in lines.items():
        pick = F.lit(None).cast("double")
        for k, (slope, intercept) in enumerate(own):
            if intercept is not None:
                pick = F.when(F.col("__fold") == k, F.lit(intercept) + F.lit(slope) * to_double(quoted(name))).otherwise(pick)
        scores[f"{prefix}{name}"] = pick
    return out.withColumns(scores)


def feature_rows(prepared: PipelineModel, df: DataFrame, key: Iterable[str] = (KEY, "t0"), column: str = "features") -> DataFrame:
    """Imputed, encoded and assembled features as rows ``(*key, slot, value)``; zeros have no row.

    A category that training never saw has no slot, so it gives no row.
    """
    vectors = prepared.transform(df).select(*[quoted(c) for c in key], vector_to_array(F.col(column)).alias("__values"))
    rows = vectors.select(*[quoted(c) for c in key], F.posexplode("__values").alias("slot", "value"))
    return rows.filter(F.col("value") != 0)


def linear_scores(rows: DataFrame, weights: DataFrame, intercept: float, key: Iterable[str] = (KEY, "t0"), all_keys: DataFrame | None = None) -> DataFrame:
    """Logistic score of rows ``(*key, slot, value)`` by ``weights`` (``slot, weight``): ``(*key, prob)``.

    A sparse dot product: one join on the slot and one sum for each key, which
    is added up before rows are shuffled.  ``all_keys`` names the keys to
    report; without it a key whose features are all zero has no row to count.
    """
    key = list(key)
    margin = rows.join(weights, "slot").groupBy(*key).agg(F.sum(F.col("value") * F.col("weight")).alias("__margin"))
    if all_keys is not None:
        margin = all_keys.select(*key).join(margin, key, "left")
    total = F.coalesce("__margin", F.lit(0.0)) + F.lit(float(intercept))
    return margin.select(*key, (1 / (1 + F.exp(-total))).cast("float").alias("prob"))


def weight_table(spark, coefficients: Iterable[float]) -> DataFrame:
    """Weights of a fitted linear model by slot; as many rows as the model has inputs."""
    return spark.createDataFrame([(k, float(w)) for k, w in enumerate(coefficients) if w], "slot int, weight double")
