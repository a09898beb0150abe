import math
import random
import re
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from riskloom.llm import decontam
from riskloom.llm.common import table
from riskloom.llm.decontam import clean_documents, passages
from riskloom.llm.queries import DECONTAMINATION_SQL, QUERIES

DOCS = "doc_id long, text string, item_id string, item string, n_match string, _doc2 string, _body2 string"
ITEMS = "item_id long, text string"


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_any_single_substitution_among_fifteen_tokens_is_found(spark):
    item = words(15, 1)
    rows = [(k, " ".join(words(30, 2) + item[:k] + ["CHANGED"] + item[k + 1 :] + words(9, 3)), *[""] * 5) for k in range(15)]
    rows += [(100, " ".join(words(200, 4)), *[""] * 5), (101, " ".join(words(20, 2) + item[:6]), *[""] * 5)]
    got = passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, " ".join(item).upper())], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_match, r.n_item, r.doc_start) for r in got) == [(k, 7, 14, 15, 30) for k in range(15)]


def test_odd_rows(spark, monkeypatch):
    item, other = words(20, 1), words(14, 9)
    texts = [None, "", ".", " ".join(item), ". ".join(item[3:]) + " end", " ".join(other + item + item), "x " * 50_000 + " ".join(item)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in enumerate(texts)] + [(3, " ".join(item), *[""] * 5), (None, " ".join(item), *[""] * 5)], DOCS)
    tests = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(other))], ITEMS)
    want = [("3", 1, 20, 20, 0), ("4", 1, 17, 20, -3), ("5", 1, 20, 20, 14), ("5", 4, 14, 14, 0), ("6", 1, 20, 20, 50_000), ("None", 1, 20, 20, 0)]
    show = lambda frame: sorted((str(r.doc_id), r.item_id, r.n_match, r.n_item, r.doc_start) for r in frame.collect())
    assert show(passages(docs, tests)) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2_000)
    assert show(passages(docs, tests)) == want
    kept = clean_documents(docs, tests)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    empty = spark.createDataFrame([], DOCS)
    assert passages(empty, tests).collect() == [] and passages(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert clean_documents(docs, spark.createDataFrame([], ITEMS)).count() == docs.count()


def test_masks_cover_the_acceptance_rule():
    for size in range(11, 14):
        masks = decontam.masks_of(size)
        lost = size - math.ceil(size * decontam.SHARE)
        fits = [{at + k for k, bit in enumerate(m) if bit == "1"} for m in masks for at in range(size - len(m) + 1)]
        assert all(any(not fit & set(places) for fit in fits) for places in combinations(range(size), lost))


def test_short_items_are_found_whole(spark):
    texts = {n: " ".join(words(n, 70 + n)) for n in (1, 2, 5, 9, 10)}
    rows = [(n, " ".join(words(20, n)) + f" {t.upper()}. " + " ".join(words(20, n + 1))) for n, t in texts.items()]
    rows += [(20 + n, " ".join(words(20, n)) + " " + t.rsplit(" ", 1)[0]) for n, t in texts.items() if n > 1]
    docs = spark.createDataFrame([(*r, *[""] * 5) for r in rows], DOCS)
    got = passages(docs, spark.createDataFrame([*texts.items(), (11, "?!")], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_match, r.n_item, r.doc_start) for r in got) == [(n, n, n, n, 20) for n in texts]


def test_large_benchmark_in_blocks(spark):
    """14,000 items of 100 tokens are 4 million seeds: more than one block of what may be broadcast."""
    items = spark.range(14_000).select(
        F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.hex(F.xxhash64("id", k))), " ").alias("text")
    )
    docs = items.where("item_id % 1000 = 7").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), F.substring("text", 1, 900)).alias("text"))
    got = sorted(tuple(r) for r in passages(docs, items).collect())
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(k, k, 100, 2) for k in range(7, 14_000, 1000)] and all(r[2] >= 45 for r in got)


def test_windows_without_seeds(spark):
    """Every substitution of up to three tokens, against all windows of all alignments."""
    rng = random.Random(8)
    items = [(n, words(n, n)) for n in (11, 12, 13, 15, 16, 60)]
    rows = []
    for n, item in items:
        for count in (1, 2, 3):
            chosen = list(combinations(range(n), count))
            for places in rng.sample(chosen, min(len(chosen), 110)):
                copy = ["CHANGED" if k in places else w for k, w in enumerate(item)]
                rows.append(words(rng.randrange(4), len(rows)) + copy + words(rng.randrange(4), len(rows) + 1))
    sixty = items[-1][1]
    rows += [["CHANGED" if k % 5 == 4 else w for k, w in enumerate(sixty)], sixty[2:13], sixty[-11:], sixty[-10:], items[0][1][2:], items[0][1][3:]]
    want = set()
    for doc_id, text in enumerate(rows):
        for item_id, item in items:
            n, best, width = len(item), None, min(13, len(item))
            for d in range(1 - n, len(text)):
                same = [0 <= k + d < len(text) and text[k + d] == w for k, w in enumerate(item)]
                if max(sum(same[k : k + width]) for k in range(n - width + 1)) >= math.ceil(width * 0.8):
                    best = max(best or (0, 0), (sum(same), -d)) if best else (sum(same), -d)
            if best:
                want.add((doc_id, item_id, best[0], n, -best[1]))
    docs = spark.createDataFrame([(k, " ".join(t), *[""] * 5) for k, t in enumerate(rows)], DOCS)
    got = passages(docs, spark.createDataFrame([(n, " ".join(i)) for n, i in items], ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.n_match, r.n_item, r.doc_start) for r in got} == want and len(got) == len(want) > 800


def test_whole_table_against_sql_and_exact_windows(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    want = sorted(con.sql(DECONTAMINATION_SQL).fetchall())
    got = sorted((r.doc_id, r.item_id, r.n_match, r.n_item, r.doc_start) for r in QUERIES["op6_decontamination"](spark, data).collect())
    assert got == want and got
    token = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    grams = {}
    for item in table(spark, data, "benchmark").collect():
        w = token(item.text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(item.item_id)
    exact = set()
    for doc in table(spark, data, "documents").collect():
        w = token(doc.text)
        exact |= {(doc.doc_id, i) for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert exact <= {(r[0], r[1]) for r in got}


def test_plan_is_native(spark, data, plan_of):
    plan = plan_of(QUERIES["op6_decontamination"](spark, data))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop|SortMergeJoin", plan)
