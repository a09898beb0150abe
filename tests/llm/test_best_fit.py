import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm import queries
from riskloom.llm.best_fit import best_fit, byte_encoder, plan_bins
from riskloom.llm.common import table, vocabulary_path

SCHEMA = "doc_id long, text string, length string, part string, number long"
VOCABULARY = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_encoder_equals_the_library(library, spark, data):
    texts = [r.text for r in table(spark, data, "documents", "text").collect() if r.text]
    texts += ["", "a", " a  b\n\n\nc ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "it's we'LL", "é中\U0001f600 12345 \t\t", "  ", "\r\n a", "a" * 5_000]
    encode = byte_encoder(VOCABULARY)
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [2, 3, 7, 64, 2048])
@pytest.mark.parametrize("n", [0, 1, 30, 4_000])
def test_plan(capacity, n):
    rng = random.Random(n * capacity)
    counts = Counter(rng.randint(1, capacity - 1) for _ in range(n))
    plan = plan_bins(dict(counts), capacity)
    bins = defaultdict(list)
    for length, copies in counts.items():
        for sequence, offset in zip(*plan.find(np.full(copies, length), np.arange(copies))):
            bins[int(sequence)].append((int(offset), length))
    assert sorted(bins) == list(range(plan.bins))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in inside) <= 2
    least = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    assert plan.bins <= 1.05 * least + 2


def checked(rows, texts, library, capacity):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        own.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_whole_table(spark, data, library):
    rows = queries.op12_best_fit(spark, data).collect()
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    bins = checked(rows, texts, library, 2048)
    total, large = sum(r.length for r in rows), sum(r.length > 1024 for r in rows)
    assert bins <= 1.01 * max(-(-total // 2048), large) + 1


def test_odd_tables(spark, library):
    texts = {None: "a null id", 1: None, 2: "", 3: "a " * 3_000, 4: "b", 5: "<|endoftext|> <|endoftext|>", 6: "line\n" * 15}
    frame = spark.createDataFrame([(k, t, "x", "y", 9) for k, t in texts.items()], SCHEMA)
    rows = best_fit(frame, capacity=16, with_ids=True).collect()
    checked(rows, texts, library, 16)
    assert all(len(r.ids) == r.length for r in rows)
    twice = best_fit(frame.where("doc_id = 6").union(frame.where("doc_id = 6")), capacity=16).collect()
    assert Counter((r.piece, r.ids_crc32) for r in twice) == {(r.piece, r.ids_crc32): 2 for r in rows if r.doc_id == 6}
    assert best_fit(frame.limit(0)).collect() == []
    assert {r.length for r in best_fit(frame, capacity=1).collect()} == {1}


def test_partitions_do_not_change_the_number_of_sequences(spark, data):
    docs = table(spark, data, "documents")
    sizes = {best_fit(docs.repartition(n)).select("sequence_id").distinct().count() for n in (1, 7)}
    assert len(sizes) == 1
