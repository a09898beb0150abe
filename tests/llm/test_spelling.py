import random
from collections import Counter

import pytest
from compare import canonical, connect

from riskloom.llm import queries, sql
from riskloom.llm import spelling
from riskloom.llm.spelling import count_runs, count_words, near_words, runs, variants

SCHEMA = "word string, n long, node long, near string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(counts, ratio=5):
    rows, forms = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if near(w, v)]
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        rows[w], forms[w] = (form, n, len(found), counts[form] if form else None), form
    out = set()
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, form, root, n, n_near, form_n))
    return out


@pytest.mark.parametrize("letters, longest, size", [("ab", 7, 120), ("abc", 5, 200), ("aé\U0001f600", 4, 60), ("abcdefgh", 12, 150), ("aá!", 6, 200)])
def test_against_all_pairs(spark, letters, longest, size):
    rng = random.Random(size)
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(size)}
    for w in list(words):
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    words.discard("")
    counts = {w: 5 ** rng.randint(0, 6) * rng.randint(1, 3) for w in words}
    rows = [(w, n, 1, "clash") for w, n in counts.items()]
    assert {tuple(r) for r in variants(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(counts)


def test_long_words_and_long_chains(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdef", k=3_000))
    counts = {long: 50, long[:2_990] + long[2_991:]: 5, long[:7] + "x" + long[8:]: 5, long + "a": 5, "b" + long: 260}
    counts |= {"a" * k: 5**k for k in range(1, 11)}
    got = {tuple(r) for r in variants(spark.createDataFrame([(w, n, 1, "") for w, n in counts.items()], SCHEMA)).collect()}
    assert got == brute(counts)
    assert {r[2] for r in got if set(r[0]) == {"a"}} == {"a" * 10}


def test_odd_tables(spark):
    rows = [(None, 9, 1, ""), ("", 9, 1, ""), ("a", 1, 1, ""), ("ab", 5, 1, "")]
    got = {tuple(r) for r in variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("a", "ab", "ab", 1, 1, 5), ("ab", None, "ab", 5, 1, None)}
    assert variants(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "Été ÉTÉ x2y\nz"), (None, None), (2, ""), (3, "w" * 300_000)], "doc_id long, text string")
    assert Counter(r.run for r in runs(docs).collect() if r.doc_id == 1) == {"Été": 1, "ÉtÉ": 1, "x": 1, "y": 1, "z": 1}
    assert [r.run for r in runs(docs, min_chars=3).collect() if r.doc_id != 3] == ["Été", "ÉtÉ"]
    counted = count_words(docs.select("doc_id", docs.text.alias("word")), min_chars=2, min_count=1)
    assert counted.count() == 2


@pytest.mark.parametrize("most", [2, 100_000])
def test_counts_by_task_equal_counts_of_rows(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "FLUSH_WORDS", most)
    rows = [(i, " ".join(random.Random(i).choices(["Été", "ÉTÉ", "abc", "ABC", "a\u00d7b", "x1y", "\U0001f600q", "İab"], k=30)), "w") for i in range(40)]
    rows += [(None, "abc"), (1, None), (2, ""), (3, "w" * 300_000), (3, "w" * 300_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    wanted = {tuple(r) for r in count_words(runs(docs).withColumnRenamed("run", "word"), 2, 2).collect()}
    assert {tuple(r) for r in count_runs(docs.withColumn("word", docs.text), 2, 2).collect()} == wanted
    assert ("w" * 300_000, 2) in wanted
    assert count_runs(docs.limit(0)).collect() == []
    shouted = count_runs(docs, 2, 2, edit=lambda doc_id, found: [x + "!" for x in found if doc_id is not None])
    assert {r.word for r in shouted.collect()} <= {w + "!" for w, _ in wanted}


def test_pairs_come_both_ways(spark):
    words = spark.createDataFrame([("colour", 9), ("color", 5), ("colours", 3)], "word string, n long")
    got = {tuple(r) for r in near_words(words).collect()}
    assert got == {("colour", "color"), ("color", "colour"), ("colour", "colours"), ("colours", "colour")}


def test_query_equals_sql(spark, data):
    ours, theirs = canonical(queries.op13_spelling(spark, data).toPandas()), canonical(connect(data).sql(sql.SPELLING).df())
    assert len(ours) > 100
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        assert ((a == b) | (a.isna() & b.isna())).all()
