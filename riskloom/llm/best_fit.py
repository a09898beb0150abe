"""Best-fit packing with large-item matching.

Documents become pieces of at most ``capacity`` tokens; full pieces are
sequences of their own.  What fits with what depends on lengths alone, and
there are at most ``capacity`` of them, so the plan is made from the histogram
of lengths: pieces above a third of the capacity are paired at most two a bin,
greedily from the largest; smaller ones go, largest first, to the tightest gap
that takes them, all bins of one kind at a time.  Every piece then finds its
bin by its number among the pieces of its length, without being gathered.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

from .common import vocabulary_path
from .word_ids import BYTE_SIGNS

#: Fixed value: how the byte-level vocabulary cuts a text into pre-tokens.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sequence ids of full pieces have this bit, the partition and the number in it; ids of the other bins count from 0.
FULL_BIT, PARTITION_SHIFT = 1 << 62, 33
#: Length and number of a piece as one sortable key.
LENGTH_SHIFT = 42
FLUSH_PIECES, FLUSH_BYTES = 20_000, 16_000_000
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
_ENCODERS: dict = {}


def byte_encoder(path: str):
    """Ids of a text by a byte-level vocabulary file, as its own library gives them.

    The file's merges are in the order of their results' ids, so the ids serve as merge ranks.
    """
    if path not in _ENCODERS:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, steps = parts["model"], parts["pre_tokenizer"]
        if steps["type"] != "ByteLevel" or steps["add_prefix_space"] or parts.get("normalizer"):
            raise ValueError("not a plain byte-level vocabulary")
        signs = {sign: byte for byte, sign in BYTE_SIGNS.items()}
        decode = lambda token: bytes(signs.get(c, ord(c)) for c in token)
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        ranks = {decode(token): n for token, n in model["vocab"].items() if token not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"]["".join(pair)] for pair in pairs]
        if order != sorted(order):
            raise ValueError("merges are not in the order of ids")
        _ENCODERS[path] = tiktoken.Encoding("byte level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)
    encoding = _ENCODERS[path]
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


@dataclass
class Plan:
    """Where the pieces of each length go: rows sorted by length and first number.

    Piece ``number`` of a length belongs to the last row whose ``first`` is not
    larger; ``copies`` of them share a bin there, the bins count from ``base``,
    and the length's place in the bin starts at ``offset``.
    """

    key: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    bins: int

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number among the pieces of that length."""
        key = (length << LENGTH_SHIFT) + number
        at = np.searchsorted(self.key, key, "right") - 1
        step, place = np.divmod(key - self.key[at], self.copies[at])
        return self.base[at] + step, self.offset[at] + place * length


def _matched(left: dict[int, int], capacity: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Bins of large pieces as (gap, how many, contents): each with the largest partner that fits."""
    made = []
    lengths = sorted(left, reverse=True)
    for at, length in enumerate(lengths):
        for partner in lengths[at:]:
            if not left[length]:
                break
            if length + partner > capacity or not left[partner]:
                continue
            pairs = left[length] // 2 if partner == length else min(left[length], left[partner])
            if pairs:
                left[length] -= pairs
                left[partner] -= pairs
                inside = [(length, 2)] if partner == length else [(length, 1), (partner, 1)]
                made.append((capacity - length - partner, pairs, inside))
        if left[length]:
            made.append((capacity - length, left[length], [(length, 1)]))
            left[length] = 0
    return made


def plan_bins(counts: dict[int, int], capacity: int) -> Plan:
    """The bins for so many pieces of each length.

    Kinds of bins are kept, not bins: at most two for each large length and
    four more for each small one, whatever the number of documents.
    """
    gaps: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
    for gap, n, inside in _matched({k: n for k, n in counts.items() if 3 * k > capacity}, capacity):
        gaps[gap].append((n, inside))
    for length in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        left = counts[length]
        for gap in range(length, capacity + 1):
            if not left:
                break
            if not gaps[gap]:
                continue
            each, kinds = gap // length, gaps[gap]
            gaps[gap] = []
            for n, inside in kinds:
                filled = min(n, left // each)
                if filled:
                    gaps[gap - each * length].append((filled, [*inside, (length, each)]))
                    left -= filled * each
                if left and filled < n:  # too few for another bin like these
                    gaps[gap - left * length].append((1, [*inside, (length, left)]))
                    left, filled = 0, filled + 1
                if filled < n:
                    gaps[gap].append((n - filled, inside))
        each = capacity // length
        if left >= each:
            gaps[capacity - each * length].append((left // each, [(length, each)]))
        if left % each:
            gaps[capacity - left % each * length].append((1, [(length, left % each)]))
    rows, used, bins = [], dict.fromkeys(counts, 0), 0
    for kinds in gaps:
        for n, inside in kinds:
            offset = 0
            for length, copies in inside:
                rows.append(((length << LENGTH_SHIFT) + used[length], copies, bins, offset))
                used[length] += n * copies
                offset += copies * length
            bins += n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*columns, bins)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["ids"] * with_ids

    def run(batches):
        encode, part = byte_encoder(path), TaskContext.get().partitionId()
        places = [0] * (capacity + 1)
        rows: list = []
        held = 0

        def flush():
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                data = memoryview(ids.tobytes())
                start, length = 0, (len(ids) - 1) % capacity + 1  # the first piece takes what is over
                for piece in range(-(-len(ids) // capacity)):
                    crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                    own = (ids[start : start + length].astype(np.int32),) if with_ids else ()
                    rows.append((doc_id, piece, start, length, crc, part, places[length], *own))
                    places[length] += 1
                    start, length = start + length, capacity
                    held += 4 * length * with_ids
                    if len(rows) >= FLUSH_PIECES or held >= FLUSH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return run


def _placed(plan: Plan):
    def run(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = plan.find(length, number)
            yield batch.drop_columns(["number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def best_fit(
    docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """Pack every document into as few sequences of at most ``capacity`` tokens as the method can.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, on request, ``ids``.  Only documents longer than
    the capacity are cut; their first piece may be shorter than the others,
    whatever their length.  A null or empty text still has its end id, hence
    one piece.  Repeated rows are packed each on its own; a null ``doc_id``
    stays null; an empty table gives no rows; other columns are ignored.
    Which pieces of equal length share a sequence depends on the partitioning,
    the number of sequences does not.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    schema = COLUMNS + (", ids array<int>" if with_ids else "")
    pieces = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, capacity, end_id, with_ids), schema)
    )
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    whole = F.lit(FULL_BIT) + F.shiftleft(F.col("part").cast("long"), PARTITION_SHIFT) + F.col("place")
    full = pieces.where(F.col("length") == capacity).select(*shown, whole.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    per_part = rest.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    numbered = rest.join(offsets, ["length", "part"]).select(*shown, (F.col("ahead") + F.col("place")).alias("number"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "number") + ", sequence_id long, offset long"
    return full.unionByName(numbered.mapInArrow(_placed(plan_bins(counts, capacity)), out))
