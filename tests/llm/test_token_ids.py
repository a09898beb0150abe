import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskloom.llm.common import table, vocabulary_path
from riskloom.llm.packing import pack, piece_lengths, write_buckets
from riskloom.llm.token_files import read_documents, read_token_files, write_token_files
from riskloom.llm.word_ids import WordEncoder

PATH = vocabulary_path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH, memo_words=40)
SCHEMA = "doc_id long, text string, start string, bucket string, ids string"
ODD = [None, "", " \n", "a", "Don't stop. ÉTÉ Straße!?", "<|endoftext|> x<|startoftext|>y", "word " * 5000, "x" * 90_000, "日本 é"]


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def rows():
    return [(i, t, "", "", "") for i, t in enumerate(ODD)] + [(3, "a", "", "", ""), (None, "b c", "", "", "")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBz'stréÀßİΣς.,! \n\t\x0b\x0c\r\x1c\x85  <|endoftxsar>́e19日\x00ªŉ"), max_size=30), max_size=4))
def test_words_give_the_ids_of_whole_texts(texts):
    assert [list(x) for x in ENCODER.ids(texts)] == [whole(t) for t in texts]


@pytest.mark.parametrize("n, lengths", [(1, [1]), (8, [8]), (13, [8, 4, 1]), (19, [8, 8, 2, 1])])
def test_piece_lengths(n, lengths):
    assert piece_lengths(n, 8) == lengths


def test_packing(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    packed = pack(docs, window=64, with_ids=True)
    got = packed.collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 and r.ids_crc32 == crc(r.ids) for r in got)
    total = {}
    for doc_id, text, *_ in rows():
        total[doc_id] = total.get(doc_id, 0) + len(whole(text)) + 1
    seen = {}
    for r in got:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == total
    ids = [t for r in sorted((r for r in got if r.doc_id == 4), key=lambda r: r.start) for t in r.ids]
    assert ids == whole(ODD[4]) + [1]
    write_buckets(packed, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == len(got)
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packing_whole_table(spark, data):
    docs = table(spark, data, "documents", "doc_id", "text")
    want = {r.doc_id: whole(r.text) + [1] for r in docs.collect()}
    got = pack(docs).collect()
    assert all(crc(want[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(map(len, want.values()))


def read_back(spark, docs, folder):
    write_token_files(docs, folder)
    return read_token_files(spark, folder).collect()


def test_token_files_of_odd_rows(spark, tmp_path):
    got = read_back(spark, spark.createDataFrame(rows(), SCHEMA).repartition(3), str(tmp_path / "t"))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(i), len(whole(t)) + 1, crc(whole(t) + [1])) for i, t, *_ in rows()
    )
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    some = read_documents(spark, str(tmp_path / "t"), [4, 7]).collect()
    assert {r.doc_id: r.ids for r in some} == {k: whole(ODD[k]) + [1] for k in (4, 7)}


def test_token_files_whole_table_and_empty(spark, data, tmp_path):
    docs = table(spark, data, "documents", "doc_id", "text")
    want, start = [], 0
    for r in sorted(docs.collect()):
        ids = whole(r.text) + [1]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, read_back(spark, docs, str(tmp_path / "w")))) == want
    assert read_back(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "e")) == []
