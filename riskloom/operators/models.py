"""Class-weighted and stacked classifiers built from ``pyspark.ml``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import Features, median_values, mode_values
from riskloom.schema import KEY, LABEL
from riskloom.session import checkpoint_root, materialize, release
from riskloom.sources.writers import first_existing

WEIGHT = "__weight"
SEED = 42
# Ensemble sizes of a full training run; pass smaller ones to try out.
BOOSTED = {"maxIter": 700, "maxDepth": 6, "stepSize": 0.06, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"}
BOOSTED_LONG = {"maxIter": 1200, "maxDepth": 6, "stepSize": 0.06, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.8"}
STACK_BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
STACK_BOOSTED_LONG = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
STACK_FOREST = {"numTrees": 400}
STACK_LINEAR = {"maxIter": 2000}
STACK_META = {"maxIter": 2000}
STACK_FOLDS = 5


def _filled_sql(features: Features, medians: dict[str, float], modes: dict[str, float]) -> str:
    """Imputation as a statement with the learned values in it, so it is saved with the model."""
    parts = ["*"]
    for c in features.numeric:
        clean = f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE))"
        parts.append(f"coalesce({clean}, {medians.get(c, 0.0)!r}D) AS `{c}__num`")
    for c in features.categorical:
        parts.append(f"CAST(coalesce(CAST(`{c}` AS DOUBLE), {modes.get(c, 0.0)!r}D) AS STRING) AS `{c}__cat`")
    return f"SELECT {', '.join(parts)} FROM __THIS__"


def preparation(features: Features, train: DataFrame, scale: bool = False) -> list:
    """Pipeline stages: impute, one-hot (unseen category = all zeros), assemble.

    ``scale`` brings numbers to unit variance without centring, which keeps
    the vectors sparse.
    """
    medians = median_values(train, features.numeric)
    modes = mode_values(train, features.categorical)
    stages: list = [SQLTransformer(statement=_filled_sql(features, medians, modes))]
    inputs = []
    if features.numeric:
        stages.append(VectorAssembler(inputCols=[f"{c}__num" for c in features.numeric], outputCol="__numbers"))
        inputs.append("__numbers")
        if scale:
            stages.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=False, withStd=True))
            inputs = ["__scaled"]
    if features.categorical:
        cats = [f"{c}__cat" for c in features.categorical]
        stages.append(
            StringIndexer(
                inputCols=cats, outputCols=[f"{c}_ix" for c in cats],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            )
        )
        # "keep" above gives unseen values the last index, and dropLast turns it into zeros.
        stages.append(
            OneHotEncoder(
                inputCols=[f"{c}_ix" for c in cats], outputCols=[f"{c}_hot" for c in cats],
                dropLast=True, handleInvalid="error",
            )
        )
        inputs += [f"{c}_hot" for c in cats]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def with_weight(train: DataFrame, positive_weight: float, y: str = LABEL) -> DataFrame:
    return train.withColumn(WEIGHT, F.when(F.col(y).cast("int") == 1, float(positive_weight)).otherwise(1.0))


def boosted_trees(y: str = LABEL, weight: str | None = WEIGHT, **size) -> GBTClassifier:
    trees = GBTClassifier(labelCol=y, featuresCol="features", seed=SEED, **{**BOOSTED, **size})
    return trees.setWeightCol(weight) if weight else trees


def probability_of_one(scored: DataFrame, out: str = "prob") -> DataFrame:
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1].cast("float"))


@dataclass
class RiskModel:
    """A fitted model with the list of columns it was trained on."""

    inputs: list[str]
    pipeline: PipelineModel
    bases: dict[str, PipelineModel] = field(default_factory=dict)

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Add P(label = 1) as a 32-bit float; other columns stay as they are."""
        names = [c for c in df.columns if c != out]
        if self.bases:
            prepared = self.pipeline.stages[0].transform(df)
            scored = self.pipeline.stages[1].transform(_with_base_scores(prepared, self.bases))
        else:
            scored = self.pipeline.transform(df)
        return probability_of_one(scored, out).select(*[F.col(f"`{c}`") for c in names], out)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        for name, model in self.bases.items():
            model.write().overwrite().save(f"{path}/base_{name}")
        listing = [(i, c, False) for i, c in enumerate(self.inputs)]
        listing += [(i, name, True) for i, name in enumerate(self.bases)]
        table = spark.createDataFrame(listing, "position int, name string, is_base boolean")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        rows = spark.read.parquet(f"{path}/columns").orderBy("is_base", "position").collect()  # one per column
        bases = {r["name"]: PipelineModel.load(f"{path}/base_{r['name']}") for r in rows if r["is_base"]}
        inputs = [r["name"] for r in rows if not r["is_base"]]
        return RiskModel(inputs, PipelineModel.load(f"{path}/pipeline"), bases)


def model_paths(root: str, freq: str) -> list[str]:
    """Where a frequency's model may be, the stacked one first."""
    return [f"{root}/{kind}_{f}" for f in (freq.lower(), freq) for kind in ("stacked", "single")]


def load_best(spark: SparkSession, root: str, freq: str) -> RiskModel:
    found = first_existing(spark, [f"{p}/columns" for p in model_paths(root, freq)])
    return RiskModel.load(spark, found.removesuffix("/columns"))


def fit_single(train: DataFrame, features: Features, positive_weight: float, y: str = LABEL, **size) -> RiskModel:
    """Boosted trees with weighted positives."""
    checkpoint_root(train.sparkSession)  # boosting cuts its lineage there every ten rounds
    weighted = with_weight(train, positive_weight, y)
    stages = preparation(features, train) + [boosted_trees(y, **size)]
    return RiskModel(features.all, Pipeline(stages=stages).fit(weighted))


def _stack_sizes(sizes: dict[str, dict | None] | None) -> dict[str, dict | None]:
    chosen = {
        "boosted": STACK_BOOSTED, "boosted_long": STACK_BOOSTED_LONG, "forest": STACK_FOREST,
        "linear": STACK_LINEAR, "meta": STACK_META,
    }
    for name, size in (sizes or {}).items():
        chosen[name] = None if size is None else {**chosen[name], **size}
    return chosen


def stack_bases(n: int, y: str = LABEL, sizes: dict[str, dict] | None = None) -> dict:
    """The base learners; ``sizes`` overrides their settings, None leaves one out."""
    chosen = {name: size for name, size in _stack_sizes(sizes).items() if name != "meta"}
    make = {
        "boosted": lambda s: boosted_trees(y, None, **s),
        "boosted_long": lambda s: boosted_trees(y, None, **s),
        "forest": lambda s: RandomForestClassifier(labelCol=y, featuresCol="features", seed=SEED, **s),
        "linear": lambda s: _ridge(n, y, "features", **s),
    }
    return {name: make[name](size) for name, size in chosen.items() if size is not None}


def _ridge(n: int, y: str, inputs: str, **size) -> LogisticRegression:
    """L2 logistic regression with unit cost: a penalty of 1/n on the mean loss."""
    return LogisticRegression(
        labelCol=y, featuresCol=inputs, regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, **size
    )


def _with_base_scores(prepared: DataFrame, bases: dict[str, PipelineModel]) -> DataFrame:
    out = prepared
    for name, model in bases.items():
        plain = [c for c in out.columns]
        out = probability_of_one(model.transform(out), f"__base_{name}").select(
            *[F.col(f"`{c}`") for c in plain], f"__base_{name}"
        )
    return out


def fit_stacked(
    train: DataFrame,
    features: Features,
    y: str = LABEL,
    folds: int = STACK_FOLDS,
    sizes: dict[str, dict] | None = None,
    key: tuple[str, str] = (KEY, "t0"),
) -> RiskModel:
    """Base learners, and a linear one on their held-out scores plus the inputs.

    A row's fold is a hash of its cell, so folds need no shuffle and stay the
    same on a retry.  Each base is fitted once per fold for the held-out
    scores and once on everything for use at scoring time.
    """
    checkpoint_root(train.sparkSession)
    prepared_by = Pipeline(stages=preparation(features, train, scale=True)).fit(train)
    fold = F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(folds)).alias("__fold")
    prepared = materialize(prepared_by.transform(train).select("features", F.col(y).cast("double").alias(y), fold))
    try:
        n = prepared.count()
        bases = stack_bases(n, y, sizes)
        held_out = None
        for i in range(folds):
            rest = prepared.filter(F.col("__fold") != i)
            fitted = {n: PipelineModel(stages=[b.fit(rest)]) for n, b in bases.items()}
            part = _with_base_scores(prepared.filter(F.col("__fold") == i), fitted)
            held_out = part if held_out is None else held_out.unionByName(part)
        # The last learner passes over these many times: score them once.
        held_out = materialize(held_out.drop("__fold"))
        full = {n: PipelineModel(stages=[b.fit(prepared)]) for n, b in bases.items()}
        join = VectorAssembler(inputCols=[*[f"__base_{n}" for n in bases], "features"], outputCol="__stacked")
        meta = Pipeline(stages=[join, _ridge(n, y, "__stacked", **_stack_sizes(sizes)["meta"])]).fit(held_out)
        release(held_out)
    finally:
        release(prepared)
    return RiskModel(features.all, PipelineModel(stages=[prepared_by, meta]), full)
