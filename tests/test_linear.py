from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from compare import difference
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskloom.operators import linear
from riskloom.operators.features import Features
from riskloom.operators.models import RiskModel, preparation
from riskloom.plans import build
from riskloom.plans.queries import QUERIES

SCHEMA = "GEOID string, t0 int, Y_label int, x double, z double, year int, month int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = [
        (f"g{k % 9}", k, int(rng.random() < 0.4), None if k % 13 == 0 else float(rng.normal(k % 3, 2)), 1.0, 2020 + k % 4, 1 + k % 12)
        for k in range(600)
    ]
    return spark.createDataFrame(made, SCHEMA)


def test_no_row_is_scored_by_a_line_that_saw_it(rows):
    folds, table = 4, rows.toPandas()
    fold = F.pmod(F.col("t0"), F.lit(folds))
    got = linear.out_of_fold(rows, ["x", "z"], fold, folds).toPandas()
    for k in range(folds):
        rest = table[table.t0 % folds != k]
        seen = rest[rest.x.notna()]
        slope, intercept = np.polyfit(seen.x, seen.Y_label, 1)
        own = got[got.t0 % folds == k]
        assert (own.__fold == k).all() if hasattr(own, "__fold") else (own["__fold"] == k).all()
        want = intercept + slope * own.x
        assert np.allclose(own.line_x, want, equal_nan=True) and own.line_x.isna().sum() == own.x.isna().sum()
        assert np.allclose(own.line_z, rest.Y_label.mean())  # an input that never varies
    # Changing a fold's own labels leaves its scores alone.
    flipped = rows.withColumn("Y_label", F.when(fold == 1, 1 - F.col("Y_label")).otherwise(F.col("Y_label")))
    again = linear.out_of_fold(flipped, ["x"], fold, folds).filter("__fold = 1").orderBy("t0").toPandas()
    assert np.allclose(again.line_x, got[got["__fold"] == 1].sort_values("t0").line_x, equal_nan=True)


def test_lines_without_anything_to_fit_on(rows):
    none = linear.out_of_fold(rows.limit(0), ["x"], F.lit(0), 2)
    assert none.collect() == []
    one = linear.out_of_fold(rows.filter("t0 = 1"), ["x"], F.lit(0), 2).collect()
    assert [r.line_x for r in one] == [None]


def test_scores_equal_the_models(spark, rows):
    train, test = rows.filter("t0 < 450 and month <> 12"), rows.filter("t0 >= 450")
    features = Features(["x", "z"], ["year", "month"])
    fitted = Pipeline(stages=[*preparation(features, train, scale=True), LogisticRegression(labelCol="Y_label", regParam=0.01)]).fit(train)
    want = {(r.GEOID, r.t0): r.prob for r in RiskModel(features.all, fitted).score(test).collect()}
    model = fitted.stages[-1]
    encoder = build_encoder(fitted)
    weights = linear.weight_table(spark, model.coefficients.toArray())
    long = linear.feature_rows(encoder, test)
    assert long.filter("value = 0").isEmpty()
    december = long.join(test.filter("month = 12"), ["GEOID", "t0"]).groupBy("GEOID", "t0").count()
    assert {r["count"] for r in december.collect()} <= {2, 3}  # two numbers and the year: an unseen month has no row
    got = {(r.GEOID, r.t0): r.prob for r in linear.linear_scores(long, weights, model.intercept, all_keys=test).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def build_encoder(fitted):
    from pyspark.ml import PipelineModel

    return PipelineModel(stages=fitted.stages[:-1])


def test_keys_without_features_get_the_intercept(spark):
    weights = spark.createDataFrame([(0, 2.0)], "slot int, weight double")
    none = spark.createDataFrame([], "GEOID string, t0 int, slot int, value double")
    keys = spark.createDataFrame([("a", 1)], "GEOID string, t0 int")
    assert linear.linear_scores(none, weights, 0.0, all_keys=keys).first().prob == 0.5
    assert linear.linear_scores(none, weights, 0.0).collect() == []


@pytest.mark.parametrize("days", [range(31, 131), [0, 120]], ids=["no negatives", "no positives"])
def test_training_part_of_one_class(spark, tmp_path, days):
    """Every nation has orders each day, or none has before the test part but in a December, which training leaves out."""
    orders = [(9 * d + n, n, 10.0, datetime(2000, 12, 1) + timedelta(days=d)) for d in days for n in range(3)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"),
        "customer": ([(n, n) for n in range(3)], "c_custkey long, c_nationkey int"),
        "lineitem": ([], "l_orderkey long, l_quantity double"),
    }
    con = duckdb.connect()
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert difference(spark, con, "score_linear", str(tmp_path)) is None
    scores = [r.prob for r in QUERIES["score_linear"](spark, str(tmp_path)).collect()]
    assert scores and all(p is not None and np.isnan(p) for p in scores)


def test_outcomes_of_all_frequencies(spark, rows):
    timed = rows.withColumn("t0", F.timestamp_seconds(F.col("t0") * 86_400))
    seen = []

    def done(freq, *_):
        seen.append(freq)
        if freq == "1M":
            raise RuntimeError("disk full\nand more")

    sizes = {"maxIter": 1, "maxDepth": 1}
    models, table = build.train_outcomes({"1D": timed, "1W": None, "1M": timed, "3H": timed.drop("Y_label")}, done, sizes=sizes)
    got = {r.freq: (r.outcome, r.reason) for r in table.collect()}
    assert got["1D"] == ("trained", None) and got["1W"] == ("skipped", "no grid")
    assert got["1M"] == ("failed", "RuntimeError: disk full") and got["3H"][0] == "failed" and "Y_label" in got["3H"][1]
    assert list(models) == ["1D"] and seen == ["1D", "1M"]
    assert table.filter("freq = '1D'").first().n_train == 480
