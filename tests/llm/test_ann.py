import numpy as np

from pyspark.sql import functions as F

from riskloom.llm.ann import build_index, calibrate, distinct_vectors, nearest, sound
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank string, vector string"


def brute(rows, step=20, k=20):
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    ids, base = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % step == 0:
            scores = (base * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def grouped(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    want, got = brute(rows), grouped(QUERIES["op4_nearest"](spark, folder))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    print("recall", recall)
    assert recall >= 0.9
    exact = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(exact[q, i] - s) < 1e-9 for q, v in got.items() for i, s in v if (q, i) in exact)


def clustered(spark, n, seed=3):
    """Vectors around centres whose number grows with the table, as in a corpus with ever more topics."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 100, 12))
    vectors = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, 12))
    return spark.createDataFrame([(i, v.tolist(), "", "") for i, v in enumerate(vectors)], SCHEMA)


def test_bins_and_comparisons_stay_bounded(spark):
    """With small constants: ten times the rows, bins of the same size and less than twice the comparisons of a query."""
    told = {}
    for n in (3_000, 30_000):
        groups = distinct_vectors(sound(clustered(spark, n)), 20).cache()
        index = build_index(groups, leaf_rows=50, sample_rows=400)
        askers = groups.select(F.col("ids")[0].alias("asked"), "vector").where("asked % 20 = 0")
        leaves, bins = calibrate(index, askers.orderBy("asked").limit(64), 20, 0.95)
        reached = index.reach(askers, leaves, bins, 21).join(index.bins, ["leaf", "bin"])
        assert index.lower is not None and index.bins.agg(F.sum("held")).first()[0] == n
        assert index.dealt.select(F.explode("ids").alias("i")).distinct().count() == n
        told[n] = reached.agg(F.sum("held")).first()[0] / askers.count(), index.bins.agg(F.avg("held"), F.max("held")).first()
        groups.unpersist()
    print("comparisons a query, average and largest bin", told)
    assert told[30_000][0] < 2 * told[3_000][0] and told[30_000][1][0] < 100


def test_lower_trees_keep_recall(spark):
    frame = clustered(spark, 12_000)
    want = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    got = grouped(nearest(frame, leaf_rows=50, sample_rows=400))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    print("recall", np.mean(found), min(found))
    assert np.mean(found) >= 0.9


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3 if i % 3 else 5).tolist()) for i in range(240)]
    got = grouped(nearest(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), recall=1.0))
    want = brute([r for r in rows if len(r[1]) == 3]) | brute([r for r in rows if len(r[1]) == 5])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 400)]
    odd = [(500, None), (520, [0.0, 0.0, 0.0]), (540, [1.0, None, 2.0]), (560, [float("nan"), 1.0, 1.0]), (580, [float("inf"), 1.0, 1.0])]
    odd += [(None, [1.0, 1.0, 1.0]), (600, [1.0]), (0, [1.0, 2.0, 0.5])]
    frame = spark.createDataFrame([(*r, "", "") for r in rows + odd], SCHEMA)
    want = brute(rows)
    got = grouped(nearest(frame, recall=1.0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [1.0, 1.0], "", ""), (40, [2.0, 0.0], "", "")], SCHEMA)
    assert grouped(nearest(few)) == {0: [(40, 2.0), (1, 1.0)], 40: [(0, 2.0), (1, 2.0)]}
    assert nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nearest(spark.createDataFrame([(0, [1.0], "", "")], SCHEMA)).collect() == []
