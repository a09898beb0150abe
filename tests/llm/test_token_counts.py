import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from riskloom.llm.common import table, vocabulary_path
from riskloom.llm.token_counts import pre_tokens, token_counts

PATH = vocabulary_path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, n_tokens string, row string"


def counted(text):
    return sum(len(MODEL.encode("\n " + w)) - 2 for w in pre_tokens(text))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" ▁\n\tabcé.,<s>/日0́Ǆ\x00"), max_size=40))
def test_pre_tokens_add_up(text):
    assert counted(text) == len(MODEL.encode(text))


def test_counts_of_odd_texts(spark):
    texts = [None, "", " ", "  a", "a  b ", "<s> </s> <unk>", "x" * 200_000, "the " * 3000, "\n\n", "a▁b", "日本語"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(3, "  a", "", ""), (None, "b c", "", "")]
    got = token_counts(spark.createDataFrame(rows, SCHEMA), limit=100).collect()
    want = sorted((str(i), len((t or "").encode()), len(MODEL.encode(t or ""))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, data):
    docs = table(spark, data, "documents", "doc_id", "text")
    want = {r.doc_id: len(MODEL.encode(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()} == want
