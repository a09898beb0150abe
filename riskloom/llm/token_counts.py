"""Exact token counts without materialising ids.

The vocabulary's pieces hold a space mark at their start only, so no merge
crosses from a character into a following space: a text is a sequence of
independent pre-tokens, each a run of spaces and the characters after it.
Frequencies per document travel as one row for each pre-token and block of
documents, are sorted by pre-token, and meet there the count of pieces, made
once for each distinct pre-token of the corpus: a merge join in which only the
frequencies are shuffled.  A very common pre-token has one row a block; its
rows are dealt to several tasks, each of which counts its pieces once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import shuffle_width

from .common import vocabulary_path

SPACES_THEN_WORD = re.compile(r" +[^ ]*")
#: Row id: partition, batch and place in the block.  An entry of 16 bits has a place and a frequency.
PLACE_BITS, BATCH_BITS = 13, 20
BLOCK_ROWS = 1 << PLACE_BITS
MOST_OFTEN = 1 << (16 - PLACE_BITS)
FLUSH_ENTRIES = 2_000_000
#: A pre-token of so many entries in a block is dealt to one more task: a very common one to several hundred.
ENTRIES_PER_SALT = 16
PARTIAL = ["block", "sums", "head"]
_MODELS: dict = {}


def _model(path: str):
    import sentencepiece

    if path not in _MODELS:
        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def check_splittable(path: str) -> None:
    """Raise unless the model's pieces allow splitting before spaces."""
    model = _model(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces):
        raise ValueError("a piece crosses a space: this vocabulary cannot be counted by pre-token")
    if model.encode("\n", out_type=str) != ["▁", "<0x0A>"] or model.encode(" ", out_type=str) != ["▁▁"]:
        raise ValueError("the model does not keep spaces and line ends as they are")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first space (the model puts one before every text)."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [unit[1:] for unit in SPACES_THEN_WORD.findall(" " + text)]
    return text.split(" ")


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values that are consecutive slices of ``data``."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )


def _spread(block: int) -> int:
    """Blocks of all partitions, evenly over any number of salts."""
    return (block >> PLACE_BITS) * 0x9E3779B1 % (1 << 31)


def _frequencies(batches):
    """Per block of documents and pre-token: which documents hold it, and how often."""
    partition = TaskContext.get().partitionId()
    ordinal = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            if ordinal >= 1 << BATCH_BITS:
                raise ValueError("too many batches in one partition")
            block = (partition << (PLACE_BITS + BATCH_BITS)) | (ordinal << PLACE_BITS)
            ordinal += 1
            codes: dict = defaultdict(count().__next__)
            _ = codes[""]
            found, places, often = [], [], []
            for place, text in enumerate(part.column(0).to_pylist()):
                seen = Counter(pre_tokens(text))
                found.append(np.fromiter(map(codes.__getitem__, seen), np.int32, len(seen)))
                often.append(np.fromiter(seen.values(), np.int64, len(seen)))
                places.append(np.full(len(seen), place, np.uint16))
            code, place, freq = np.concatenate(found), np.concatenate(places), np.concatenate(often)
            order = np.argsort(code, kind="stable")
            code, place, freq = code[order], place[order], freq[order]
            # An entry has the place and the frequency less one; higher frequencies take several entries.
            copies = (freq + MOST_OFTEN - 1) // MOST_OFTEN
            rest = freq - MOST_OFTEN * (copies - 1)
            code, place, last = np.repeat(code, copies), np.repeat(place, copies), np.cumsum(copies) - 1
            freq = np.full(len(code), MOST_OFTEN, np.uint16)
            freq[last] = rest
            bounds = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(codes)))])
            size = len(codes)
            # One pre-token, a different one for each block, also carries the block's documents.
            carrier = (partition * 7_919 + ordinal * 104_729) % size
            known = part.column(1).is_valid().to_numpy(zero_copy_only=False)
            ids = part.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            head = np.stack([ids, known.astype(np.int64), part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)])
            heads = [None] * size
            heads[carrier] = head.tobytes()
            salts = np.maximum(1, np.diff(bounds) // ENTRIES_PER_SALT)
            yield pa.record_batch(
                [
                    pa.array(list(codes), pa.string()), pa.array((_spread(block) % salts).astype(np.int32)), pa.array(np.full(size, block), pa.int64()),
                    _slices((place | ((freq - 1) << PLACE_BITS)).astype(np.uint16), bounds), pa.array(heads, pa.binary()),
                ],
                ["word", "salt", "block", "entries", "head"],
            )


def _sums(path: str):
    """Over rows sorted by pre-token: count each pre-token's pieces once, add up pieces times frequency per document."""

    def run(batches):
        model = _model(path)
        last, last_size = None, 0
        rows, sizes, held = [], [], 0

        def flush():
            row, at = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.bincount(at, np.concatenate(sizes)).astype(np.int64)
            block, starts = np.unique(row >> PLACE_BITS, return_index=True)
            packed = np.stack([row & (BLOCK_ROWS - 1), total], axis=1)
            bounds = 2 * np.append(starts, len(row))
            none = pa.nulls(len(block), pa.binary())
            return pa.record_batch([pa.array(block << PLACE_BITS), _slices(packed.ravel(), bounds), none], PARTIAL)

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0).dictionary_encode()
            words = runs.dictionary.to_pylist()
            # "\n " + word: the space mark, the line end, then the pre-token's own pieces.
            fresh = [w for w in words if w != last]
            known = dict(zip(fresh, (len(ids) - 2 for ids in model.encode(["\n " + w for w in fresh], num_threads=1)), strict=True))
            if last is not None:
                known.setdefault(last, last_size)
            last = batch.column(0)[batch.num_rows - 1].as_py()
            last_size = known[last]
            pieces = np.array([known[w] for w in words], np.int64)[runs.indices.to_numpy()]
            block = batch.column(1).to_numpy()
            carriers = batch.filter(batch.column(3).is_valid())
            if carriers.num_rows:
                none = pa.nulls(carriers.num_rows, pa.binary())
                yield pa.record_batch([carriers.column(1), none, carriers.column(3)], PARTIAL)
            lists = batch.column(2).to_pylist()
            length = np.fromiter(map(len, lists), np.int64, len(lists)) // 2
            # Entries are widened a bounded number at a time, however many the rows of a batch have.
            part = (np.cumsum(length) - 1) // FLUSH_ENTRIES
            for own in np.split(np.arange(len(lists)), np.flatnonzero(np.diff(part)) + 1):
                entry = np.frombuffer(b"".join(lists[own[0] : own[-1] + 1]), np.uint16)
                rows.append(np.repeat(block[own], length[own]) + (entry & (BLOCK_ROWS - 1)))
                sizes.append(np.repeat(pieces[own], length[own]) * ((entry >> PLACE_BITS) + 1))
                held += len(entry)
                if held > FLUSH_ENTRIES:
                    yield flush()
                    rows, sizes, held = [], [], 0
        if rows:
            yield flush()

    return run


def _documents(limit: int):
    """Over rows sorted by block: a row for each of its documents."""

    def run(batches):
        block, total, head = None, np.zeros(BLOCK_ROWS, np.int64), b""

        def rows():
            ids, known, n_bytes = np.frombuffer(head, np.int64).reshape(3, -1)
            n = total[: len(ids)]
            columns = [pa.array(ids, mask=known == 0), pa.array(n_bytes), pa.array(n.copy()), pa.array(n > limit)]
            return pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for at, sums, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != block:
                    if block is not None:
                        yield rows()
                    block, head = at, b""
                    total[:] = 0
                if own is not None:
                    head = own
                else:
                    place, n = np.frombuffer(sums, np.int64).reshape(-1, 2).T
                    total[place] += n
        if block is not None:
            yield rows()

    return run


def token_counts(docs: DataFrame, limit: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Bytes and tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    One row per input row, repeated rows and null ids included.  A null text
    counts as empty: 0 bytes, 0 tokens.  An empty table gives an empty result.
    Other columns are ignored.  Special strings in a text are plain text.  A
    very long text is split whole, as one row; its frequencies travel.
    ``limit`` is the count above which ``over_limit`` is true.
    """
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    check_splittable(path)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    frequencies = texts.select("text", "doc_id", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        _frequencies, "word string, salt int, block long, entries binary, head binary"
    )
    width = shuffle_width(docs.sparkSession)
    partial = frequencies.repartition(width, "word", "salt").sortWithinPartitions("word").select("word", "block", "entries", "head").mapInArrow(
        _sums(path), "block long, sums binary, head binary"
    )
    return partial.repartition(width, "block").sortWithinPartitions("block").mapInArrow(
        _documents(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
