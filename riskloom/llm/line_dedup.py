"""Dropping lines that many documents repeat, through sharded minimal perfect hashes.

Every distinct line key is hashed to 128 bits and counted.  Keys are dealt to
shards; each shard is one row with a minimal perfect hash and the arrays it
indexes: fingerprints, document counts, owners (the largest id that holds the
line).  Documents send packed arrays of hashes to the shards, which answer
which of them are to be dropped: lines are never joined one by one.  Keys so
frequent that their probes would crowd a shard are few by counting (at most
``HEAVY_KEYS``, whatever the input) and are answered from a broadcast table at
once; those answers travel in packs of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, fresh

#: Keys of a shard; beyond ``MOST_SHARDS`` shards grow instead, so that a pack has several probes for each.
SHARD_KEYS, MOST_SHARDS = 65_536, 131_072
#: Keys held by more than one in so many lines are answered from a broadcast table (under 10 MB).
HEAVY_KEYS = 100_000
#: Bits of each level of the perfect hash for every key left; levels before the rest is listed plainly.
GAMMA, LEVELS = 1.7, 32
PACK_ROWS = 500_000
#: Packs of answers have negative shards: partition, then number of the pack.
PACK_SHIFT = 24
COUNT_MAX = 65_535
NO_ID = np.iinfo(np.int64).min


def _mixed(first: np.ndarray, second: np.ndarray, salt: int) -> np.ndarray:
    """A well-mixed 64-bit value for each pair of hashes and level."""
    x = first.astype(np.uint64) ^ (second.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(salt * 0xD6E8FEB86659FD93 % 2**64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash over pairs of 64-bit hashes, made of levels of bits and their ranks."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest
        flags = np.unpackbits(bits, bitorder="little")
        self.flags = flags
        self.ranks = np.cumsum(flags, dtype=np.int64) - flags
        self.in_levels = int(flags.sum())

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> "PerfectHash":
        left = np.arange(len(first))
        sizes, levels = [], []
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(GAMMA * len(left)) // 8 * 8 + 8)
            place = (_mixed(first[left], second[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[place]]
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        rest = np.stack([first[left], second[left]]).astype(np.int64) if len(left) else np.zeros((2, 0), np.int64)
        return cls(sizes, np.packbits(flags, bitorder="little"), rest)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or any index for a pair that isn't a key."""
        out = np.full(len(first), -1, np.int64)
        left, base = np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            place = base + (_mixed(first[left], second[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[place] == 1
            out[left[hit]] = self.ranks[place[hit]]
            left = left[~hit]
            base += size
        for k in range(self.rest.shape[1]):
            own = left[(first[left] == self.rest[0, k]) & (second[left] == self.rest[1, k])]
            out[own] = self.in_levels + k
        return out


INDEX = "shard long, sizes array<long>, bits binary, rest binary, prints binary, counts binary, owners binary"
ANSWERS = "doc long, body long, first long"


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy() if column.null_count else column.to_numpy()


def _index(keys: pa.Table) -> pa.Table:
    """One shard's index row."""
    first, second = _numbers(keys["first"]), _numbers(keys["second"])
    perfect = PerfectHash.build(first, second)
    at = perfect.find(first, second)
    prints, counts, owners = np.empty(len(at), "<u4"), np.empty(len(at), "<u2"), np.empty(len(at), "<i8")
    prints[at] = second.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    counts[at] = np.minimum(_numbers(keys["n"]), COUNT_MAX)
    owners[at] = _numbers(keys["owner"])
    row = {
        "shard": [keys["shard"][0].as_py()], "sizes": [perfect.sizes], "bits": [perfect.bits.tobytes()],
        "rest": [perfect.rest.tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()],
    }
    kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 5
    return pa.table([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))


def _pack(batches):
    """Many probes of a task become one row for each shard; what is known already becomes a row of answers."""
    part, packs = TaskContext.get().partitionId(), 0
    asked, known, n = [], [], 0

    def flush():
        nonlocal packs
        shards, data = [], []
        if asked:
            rows = np.concatenate(asked, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            own, starts = np.unique(rows[0], return_index=True)
            shards += own.tolist()
            data += [np.ascontiguousarray(x).tobytes() for x in np.split(rows[1:], starts[1:], axis=1)]
        if known:
            shards.append(-1 - (part << PACK_SHIFT | packs))
            data.append(np.concatenate(known, axis=1).tobytes())
        packs += 1
        return pa.record_batch([pa.array(shards, pa.int64()), pa.array(data, pa.binary())], ["shard", "probes"])

    for batch in batches:
        shard, first, second, doc, body = (_numbers(batch.column(k)) for k in range(5))
        open_ = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        if open_.any():
            asked.append(np.stack([shard[open_], first[open_], second[open_], doc[open_], body[open_]]))
        if not open_.all():
            known.append(np.stack([doc[~open_], body[~open_], first[~open_]]))
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield flush()
            asked, known, n = [], [], 0
    if n:
        yield flush()


def _answer(min_docs: int):
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        out = [np.empty((3, 0), np.int64)]
        packs = probes["probes"].to_pylist()
        if packs and probes["shard"][0].as_py() < 0:
            out += [np.frombuffer(data, np.int64).reshape(3, -1) for data in packs]
        elif packs and index.num_rows:
            row = index.to_pylist()[0]
            perfect = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint8), np.frombuffer(row["rest"], np.int64).reshape(2, -1))
            prints, counts, owners = (np.frombuffer(row[c], kind) for c, kind in (("prints", "<u4"), ("counts", "<u2"), ("owners", "<i8")))
            for data in packs:
                first, second, doc, body = np.frombuffer(data, np.int64).reshape(4, -1)
                at = perfect.find(first, second)
                met = (at >= 0) & (prints[at] == (second.astype(np.uint64) & np.uint64(0xFFFFFFFF)))
                drop = met & (counts[at] >= min_docs) & (owners[at] != doc)
                out.append(np.stack([doc[drop], body[drop], first[drop]]))
        doc, body, first = np.concatenate(out, axis=1)
        return pa.table([pa.array(doc, mask=doc == NO_ID), pa.array(body), pa.array(first)], ["doc", "body", "first"])

    return run


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def distinct_keys(text: Column, min_chars: int) -> Column:
    keys = F.transform(F.split(text, "\n", -1), line_key)
    return F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))


def dropped_hashes(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``doc, body, drop``: by document id and hash of its text, the hashes of the keys it loses."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("body"), F.explode(distinct_keys(text, min_chars)).alias("key")
    ).select("doc", "body", _hash(F.col("key")).alias("first"), F.xxhash64(F.lit(7), "key").alias("second"))
    # A line of so many characters has so many bytes at least, and one more that ends it.
    most = docs.agg(F.coalesce(F.sum(F.floor((F.octet_length(text) + 1) / (min_chars + 1))), F.lit(0))).first()[0]
    shards = min(MOST_SHARDS, max(1, -(-most // SHARD_KEYS)))
    shard = F.pmod(F.col("first"), F.lit(shards)).alias("shard")
    stats = lines.groupBy("first", "second").agg(F.count("*").alias("n"), F.max("doc").alias("owner"))
    index = stats.select(shard, "first", "second", "n", "owner").groupBy("shard").applyInArrow(_index, INDEX)
    # Counts add up to the lines, so at most HEAVY_KEYS keys can exceed this.
    heavy = stats.where(F.col("n") > most // HEAVY_KEYS).select("first", "second", F.col("n").alias("heavy_n"), "owner")
    told = lines.join(F.broadcast(heavy), ["first", "second"], "left")
    goes = F.when(F.col("heavy_n").isNotNull(), (F.col("heavy_n") >= min_docs) & ~F.col("owner").eqNullSafe(F.col("doc"))).alias("goes")
    probes = told.select(shard, "first", "second", "doc", "body", goes).where("goes is null or goes").mapInArrow(_pack, "shard long, probes binary")
    answers = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_answer(min_docs), ANSWERS)
    return answers.groupBy("doc", "body").agg(F.collect_set("first").alias("drop"))


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_lines: str = "n_lines", n_dropped: str = "n_dropped"
) -> DataFrame:
    """Drop repeated lines: the input's columns with a new ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` rows
    hold lose all their lines, save in the rows with the largest ``doc_id``.
    A row counts as one document, repeated rows each on their own; a null id
    is smaller than any other and rows without an id keep a line that no other
    row holds.  A null or empty text is one empty line (its text becomes
    empty); a document may lose all lines, and stays with an empty text.  An
    empty table gives no rows.  The two new columns replace input columns of
    the same names.  A very long text is split and joined by one row's
    expression; its lines travel as hashes.
    """
    if not 1 <= min_docs <= COUNT_MAX:
        raise ValueError(f"min_docs must be from 1 to {COUNT_MAX}")
    drops = dropped_hashes(docs, min_chars, min_docs)
    doc, body, drop, lines, other_doc, other_body = fresh(docs, "_doc", "_body", "_drop", "_lines", "_doc2", "_body2")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), body: F.xxhash64(text)})
    drops = drops.select(F.col("doc").alias(other_doc), F.col("body").alias(other_body), F.col("drop").alias(drop))
    joined = keyed.join(drops, F.col(doc).eqNullSafe(F.col(other_doc)) & (F.col(body) == F.col(other_body)), "left")
    stays = lambda line: ~(
        (F.char_length(line_key(line)) >= min_chars) & F.array_contains(F.col(drop), _hash(line_key(line)))
    )
    split = F.split(text, "\n", -1)
    kept = F.when(F.col(drop).isNull(), split).otherwise(F.filter(split, stays))
    out = joined.withColumn(lines, kept)
    others = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    return out.select(
        *[F.array_join(F.col(lines), "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in others],
        F.size(split).cast("long").alias(n_lines), (F.size(split) - F.size(lines)).cast("long").alias(n_dropped),
    )
