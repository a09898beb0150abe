"""Stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, packing, simhash, toxicity
from riskloom.llm.common import table
from riskloom.llm.line_dedup import dedup_lines
from riskloom.session import materialize

#: Words whose ids a worker of the last stage keeps; the workers of earlier stages still hold theirs.
MEMO_WORDS = 400_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    A null text is judged as an empty one; rows of a null ``doc_id`` and
    repeated rows are judged each on their own.  Labels of null or repeated ids
    do no harm.  Without labels of both classes, or documents, all are kept.
    """
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go, but for one document each; lengths are counted anew.

    All documents stay; a null text becomes empty, like one that loses all its
    lines.  Ties of an id keep their lines together; null ids never own a line
    that a document with an id holds.
    """
    cleaned = dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints (three words, two bits) stays, the smallest id.

    Texts without a word are copies of each other.  Null ids come last, of
    repeated rows one stays.
    """
    return simhash.drop_near_duplicates(docs, size=3, threshold=2)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; with an empty benchmark none does.

    Null and empty texts stay; rows of one id and text stay or go together.
    """
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of power-of-two length; every row has one at least, that of an empty text its end id."""
    return packing.pack(docs, memo_words=MEMO_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; an empty table gives no rows.

    Columns of any name are carried through the filtering stages.
    """
    docs = table(spark, sf_dir, "documents")
    for place, (_name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = materialize(docs)
    return docs
