import zlib

import pytest

from riskloom.llm import toxicity
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, toxic int, score string"


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op8_toxicity"](spark, folder).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert len(got) == table(spark, folder, "documents").count()
    both = got[got.held_out].merge(table(spark, folder, "labels").toPandas(), on="doc_id")
    wrong = both.predicted != both.toxic
    print("held-out accuracy", 1 - wrong.mean(), "recall", both[both.toxic == 1].predicted.mean(), len(both))
    assert wrong.mean() < 0.06
    assert both[both.toxic == 1].predicted.mean() > 0.6


def test_odd_rows(spark):
    docs = [(i, f"{'vile nasty brute ' if i % 2 else 'calm quiet meadow '} {i} " * 5, 9, "s") for i in range(80)]
    odd = [(500, None, 1, ""), (501, "", 1, ""), (None, "vile", 1, ""), (503, "x" * 300_000, 0, ""), (1, docs[1][1], 9, "")]
    frame = spark.createDataFrame(docs + odd, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None), (None, 1), (500, 1), (9999, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = toxicity.score(frame, model).collect()
    assert len(got) == 85 and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    kept = toxicity.clean_documents(frame, model)
    assert kept.columns == frame.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).collect() == []


@pytest.mark.parametrize("labels", [[], [0, 0, 0, 0], [1]])
def test_one_class(labels):
    model = toxicity.fit_texts(["a text"] * len(labels), labels)
    assert model.constant == (sum(labels) / len(labels) if labels else 0.0)
