import random

import corpus_pipeline
from riskloom.llm.common import table
from riskloom.llm.simhash import drop_near_duplicates, fingerprint_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, print string, body long, _doc2 long, _body2 string"
REST = ("en", "s", 1, "", "", 5, 6, "")


def brute_kept(rows):
    """The first id of each group of fingerprints within two bits."""
    prints = [fingerprint_of((t or "").encode().lower().split(), 3) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                at[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    order = lambda x: (x is None, x or 0)
    return sorted(str(min(own, key=order)) for own in groups.values())


def test_near_duplicates(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows = []
    for group in range(14):
        base = [word() for _ in range(rng.choice([4, 12, 400, 900]))]
        for copy in range(8):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (900, None), (901, ""), (902, " \n"), (903, "x"), (904, "X"), (905, "y " * 60_000), (None, "no id at all")]
    frame = spark.createDataFrame([(i, t, *REST) for i, t in rows], SCHEMA)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == brute_kept(rows)
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stages_on_an_empty_folder_and_with_clashing_names(spark, data, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        frame = table(spark, data, name).limit(0)
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = table(spark, data, "documents").limit(60).selectExpr("*", *[f"'x' as {c}" for c in ("_doc", "_doc2", "_body", "_body2", "_kept", "print", "first")])
    odd = [(None, None), (None, ""), (5, None), (5, ""), (5, "a\nb"), (5, "a\nb")]
    added = spark.createDataFrame([(i, t, None, None, None, *"abcdefg") for i, t in odd], docs.schema)
    docs = docs.unionByName(added)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= docs.count() > 0


def test_stages_on_the_whole_table(spark, data):
    docs = table(spark, data, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data)
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.columns == docs.columns, name
        assert after.count() > 0.6 * before.count(), name
        if name == "simhash":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(str(r.doc_id) for r in after.collect()) == brute_kept(rows)
        before = after
    packed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
    assert all(r.length & (r.length - 1) == 0 for r in packed)
