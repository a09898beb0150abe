"""Token files: each document's ids compressed alone with one shared dictionary.

A folder holds two tables.  ``dictionary`` has one row: the zstandard
dictionary, its SHA-256 and the width of an id.  ``blocks`` has one row per
block of documents in ascending ``doc_id`` order: the document ids, the offset
index, the compressed frames, the dictionary's hash and the block's place.  A
short document is read by decompressing its own frame.  Tables are written and
read by Spark, so any store will do.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import shuffle_width

from .common import vocabulary_path
from .word_ids import encoder

DICTIONARY_BYTES = 112_640
#: The dictionary is fitted on at most so many documents and serialized bytes.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_BYTES = 16_000_000
BLOCK_DOCUMENTS = 4_096
BLOCK_BYTES = 8_000_000
LEVEL = 3
BLOCKS = (
    "bucket int, block int, first_doc long, last_doc long, n_docs long, n_tokens long, start_in_bucket long, "
    "dictionary_hash string, doc_ids binary, known binary, offsets binary, frames binary"
)


def _samples(docs: DataFrame, path: str, end_id: int) -> list[bytes]:
    """Serialized ids of a bounded number of documents, chosen by hash."""
    step = max(1, docs.count() // SAMPLE_DOCUMENTS)

    def serialize(batches):
        for batch in batches:
            data = [ids.tobytes() for ids in encoder(path).ids(batch.column(0).to_pylist(), end_id)]
            yield pa.record_batch([pa.array(data, pa.binary())], ["data"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text").limit(2 * SAMPLE_DOCUMENTS)
    out: list[bytes] = []
    size = 0
    for row in chosen.mapInArrow(serialize, "data binary").toLocalIterator():
        if size + len(row.data) > SAMPLE_BYTES:
            continue
        out.append(bytes(row.data))
        size += len(row.data)
    return out


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A shared dictionary; raw sample bytes, or nothing, where there is too little to train on."""
    samples = _samples(docs, path, end_id)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _encode(path: str, end_id: int, dictionary: bytes, cuts: list[int]):
    def run(batches):
        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        bounds = np.array(cuts, np.int64)
        for batch in batches:
            frames, sizes = [], []
            for ids in encoder(path).ids(batch.column(1).to_pylist(), end_id):
                frames.append(press.compress(ids.tobytes()))
                sizes.append(len(ids))
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            # Rows that equal a cut may lie on either side of it: equal ids are spread.
            spread = np.fromiter((zlib.crc32(f) for f in frames), np.int64, len(frames))
            bucket = (low + spread % (high - low + 1)).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), pa.array(bucket), pa.array(sizes, pa.int32()), pa.array(frames, pa.binary())],
                ["doc_id", "bucket", "n_tokens", "frame"],
            )

    return run


def _blocks(dictionary_hash: str):
    """Rows sorted by bucket and id become blocks; a bucket lies whole in one task."""

    def run(batches):
        bucket, number, start = None, 0, 0
        ids: list = []
        frames: list = []
        tokens = size = 0

        def block():
            known = np.array([i is not None for i in ids])
            values = np.array([i or 0 for i in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8")
            shown = [i for i in ids if i is not None]
            row = (
                bucket, number, min(shown, default=None), max(shown, default=None), len(ids), tokens, start, dictionary_hash,
                values.astype("<i8").tobytes(), known.tobytes(), offsets.tobytes(), b"".join(frames),
            )
            kinds = [pa.int32()] * 2 + [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 4
            names = [c.split()[0] for c in BLOCKS.split(", ")]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for doc_id, at, n, frame in zip(*columns, strict=True):
                if frames and (at != bucket or len(ids) >= BLOCK_DOCUMENTS or size + len(frame) > BLOCK_BYTES):
                    yield block()
                    number, start = number + 1, start + tokens
                    ids, frames, tokens, size = [], [], 0, 0
                if at != bucket:
                    bucket, number, start = at, 0, 0
                ids.append(doc_id)
                frames.append(frame)
                tokens += n
                size += len(frame)
        if frames:
            yield block()

    return run


def write_token_files(docs: DataFrame, folder: str, end_id: int = 1, vocabulary: str | None = None) -> None:
    """Encode whole texts and write them in ascending ``doc_id`` order (nulls first).

    A null or empty text is its end id alone.  Repeated ids are all kept, in
    any order among themselves; other columns are ignored; an empty table
    gives an empty table of blocks.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = train_dictionary(docs, path, end_id)
    digest = hashlib.sha256(data).hexdigest()
    width = encoder(path).kind.itemsize
    spark.createDataFrame([(digest, data, width)], "hash string, data binary, id_bytes int").coalesce(1).write.parquet(
        f"{folder}/dictionary"
    )
    n = shuffle_width(spark)
    cuts = docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    encoded = docs.mapInArrow(
        _encode(path, end_id, data, [int(c) for c in cuts]), "doc_id long, bucket int, n_tokens int, frame binary"
    )
    blocks = (
        encoded.repartitionById(n, "bucket").sortWithinPartitions("bucket", "doc_id")
        .mapInArrow(_blocks(digest), BLOCKS)
    )
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def _open(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.data)
    if hashlib.sha256(data).hexdigest() != row.hash:
        raise ValueError("the dictionary doesn't match its hash")
    return data, row.hash, row.id_bytes


def _decode(data: bytes, digest: str, id_bytes: int, with_ids: bool, wanted: frozenset | None = None):
    def run(batches):
        shared = _dictionary(data)
        expand = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError("a block was written with another dictionary")
                offsets, ids = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
                known = np.frombuffer(row["known"], np.bool_)
                frames, start, rows = memoryview(row["frames"]), row["start"], []
                for k in range(len(ids)):
                    if wanted is not None and (not known[k] or int(ids[k]) not in wanted):
                        continue
                    raw = expand.decompress(frames[offsets[k] : offsets[k + 1]])
                    tokens = np.frombuffer(raw, f"<u{id_bytes}").astype("<u4")
                    own = (tokens.astype(np.int32),) if with_ids else ()
                    rows.append((int(ids[k]) if known[k] else None, start, len(tokens), zlib.crc32(tokens.tobytes()), *own))
                    start += len(tokens)
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Read every document back: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids``.

    ``start`` counts the ids of all documents before.  Bucket totals (one row
    per write partition) are added up and broadcast.
    """
    data, digest, width = _open(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = [(r.bucket, r.n) for r in blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()]
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])])
    starts = spark.createDataFrame(
        [(bucket, int(at)) for (bucket, _), at in zip(totals, before)], "bucket int, bucket_start long"
    )
    placed = blocks.join(F.broadcast(starts), "bucket").withColumn("start", F.col("bucket_start") + F.col("start_in_bucket"))
    columns = ["start", "dictionary_hash", "doc_ids", "known", "offsets", "frames"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return placed.select(*columns).mapInArrow(_decode(data, digest, width, with_ids), schema)


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, ids`` of a few documents: only their blocks are read, only their frames expanded."""
    data, digest, width = _open(spark, folder)
    inside = F.lit(False)
    for i in doc_ids:
        inside |= (F.col("first_doc") <= i) & (F.col("last_doc") >= i)
    blocks = spark.read.parquet(f"{folder}/blocks").where(inside).withColumn("start", F.lit(0).cast("long"))
    columns = ["start", "dictionary_hash", "doc_ids", "known", "offsets", "frames"]
    found = blocks.select(*columns).mapInArrow(
        _decode(data, digest, width, True, frozenset(doc_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
    )
    return found.drop("start")
