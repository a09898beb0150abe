"""Packing by power-of-two decomposition.

A document's ids are cut into full-length pieces and one piece for every bit
of the rest, so every piece is a whole training sequence of power-of-two
length: no sequence crosses documents and nothing is padded.  Sequences of
equal length form a bucket (the high bits of ``sequence_id``), ready for
batches of one shape.  The work is one pass without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path
from .word_ids import MEMO_WORDS, encoder

#: Bits of a sequence id: bucket, partition, number within the partition.
BUCKET_SHIFT, PARTITION_SHIFT = 57, 33
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FLUSH_PIECES = 20_000
FLUSH_BYTES = 16_000_000


def piece_lengths(n: int, window: int) -> list[int]:
    """Full windows first, then the rest's binary digits, largest first."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(path: str, window: int, end_id: int, with_ids: bool, memo_words: int):
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        made = TaskContext.get().partitionId() << PARTITION_SHIFT
        rows: list = []
        held = 0

        def flush():
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path, memo_words).ids(texts, end_id)):
                data = memoryview(ids.astype("<u4").tobytes())
                start = 0
                for length in piece_lengths(len(ids), window):
                    crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                    sequence = (length.bit_length() << BUCKET_SHIFT) | made
                    own = (ids[start : start + length],) if with_ids else ()
                    rows.append((doc_id, start, length, crc, len(ids), sequence, 0, *own))
                    made += 1
                    start += length
                    held += 4 * length * with_ids
                    if len(rows) >= FLUSH_PIECES or held >= FLUSH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    window: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    with_ids: bool = False,
    memo_words: int = MEMO_WORDS,
) -> DataFrame:
    """Cut every document into sequences of power-of-two length, at most ``window``.

    ``window`` must be a power of two.  Returns one row per piece: ``doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on
    request, ``ids``.  A null or empty text still has its end id, hence one
    piece.  Repeated rows are packed each on its own; a null ``doc_id`` stays
    null; an empty table gives no rows; other columns are ignored.
    ``sequence_id`` is unique in one result; its number within a bucket
    depends on how the input is partitioned.  A worker keeps the ids of up to
    ``memo_words`` words, some 200 bytes each; fewer cost time, not results.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _packer(path, window, end_id, with_ids, memo_words), schema
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences into one folder per length."""
    packed.write.partitionBy("length").parquet(path)
