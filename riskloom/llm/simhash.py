"""SimHash fingerprints and links by anchor-point covering.

Anchors are pairs of words of the perfect binary Golay code: every 23-bit
block of a fingerprint lies within 3 bits of exactly one code word.  Each
fingerprint has one home anchor (its two nearest code words) and is replicated
to every anchor within the covering radius plus the threshold; two linked
fingerprints then meet at the home anchor of either, and are compared there.
Where many distinct fingerprints share a home anchor, their links are found
instead through the points one bit away: two fingerprints of one such point
differ in at most two bits, so its least member is linked to all others.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize, shuffle_width

from .common import fresh
from .components import roots

#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the [23,12] Golay code, its length and radius.
GOLAY, BLOCK_BITS, CHECK_BITS, RADIUS = 0b110001110101, 23, 11, 3
SEED = 42
#: More distinct fingerprints than this at one home anchor are linked through points one bit away.
FULL_ANCHOR = 512
CHUNK = 65_536
THRESHOLD = 2


def fingerprint_of(words: list[bytes], size: int) -> int:
    """Unsigned 64-bit SimHash of all shingles, repeats included; 0 without words."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        part = hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            # Bytes split and lower-case by ASCII rules alone, as the words are defined.
            found = [fingerprint_of((t or b"").lower().split(), size) for t in batch.column("text").to_pylist()]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield batch.drop_columns(["text"]).append_column("print", prints)

    return run


def fingerprints(docs: DataFrame, size: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (and the long columns ``keep``) and ``print``: the fingerprint of every whole text as a signed 64-bit integer."""
    keep = keep or []
    schema = ", ".join(f"{c} long" for c in ["doc_id", *keep, "print"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints(size), schema
    )


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    words = words.copy()
    for bit in range(BLOCK_BITS - 1, CHECK_BITS - 1, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - CHECK_BITS), 0).astype(words.dtype)
    return words


@cache
def _cosets(threshold: int) -> list[list[np.ndarray]]:
    """By syndrome and excess over the radius: the error patterns that lead to a code word."""
    patterns, excess = [0], [0]
    for weight in range(1, RADIUS + threshold + 1):
        for bits in combinations(range(BLOCK_BITS), weight):
            patterns.append(sum(1 << b for b in bits))
            excess.append(max(0, weight - RADIUS))
    pattern, over = np.array(patterns, np.int64), np.array(excess)
    syndrome = _syndromes(pattern)
    out = [[np.empty(0, np.int64)] * (threshold + 1) for _ in range(1 << CHECK_BITS)]
    for e in range(threshold + 1):
        own = over == e
        order = np.argsort(syndrome[own], kind="stable")
        values, at = np.unique(syndrome[own][order], return_index=True)
        for s, group in zip(values, np.split(pattern[own][order], at[1:]), strict=True):
            out[s][e] = group
    return out


def _anchors(threshold: int):
    """Home anchor (``home`` true) and all anchors within radius plus threshold of each fingerprint."""

    def run(batches):
        cosets = _cosets(threshold)
        mask = (1 << BLOCK_BITS) - 1
        for batch in batches:
            prints = batch.column(0).to_numpy()
            for start in range(0, len(prints), 2_000):
                own = prints[start : start + 2_000]
                first, second = own & mask, own >> BLOCK_BITS & mask
                sides = [(w, _syndromes(w)) for w in (first, second)]
                places, sizes, homes = [], [], []
                for k in range(len(own)):
                    (a, s), (b, t) = ((w[k], int(z[k])) for w, z in sides)
                    pairs = [
                        ((a ^ cosets[s][e])[:, None] | ((b ^ cosets[t][f]) << BLOCK_BITS)[None, :]).ravel()
                        for e in range(threshold + 1)
                        for f in range(threshold + 1 - e)
                    ]
                    place = np.concatenate(pairs)
                    places.append(place)
                    sizes.append(len(place))
                    homes.append(pairs[0][0])
                n = len(own)
                anchor = np.concatenate([*places, np.array(homes, np.int64)])
                value = np.concatenate([np.repeat(own, sizes), own])
                home = np.zeros(len(anchor), bool)
                home[len(anchor) - n :] = True
                yield pa.record_batch([pa.array(anchor), pa.array(value), pa.array(home)], ["anchor", "print", "home"])

    return run


def _points(value: Column) -> Column:
    """A fingerprint and its 64 neighbours one bit away."""
    return F.array(value, *(value.bitwiseXOR(F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long")) for b in range(64)))


def link_pairs(distinct: DataFrame, threshold: int = THRESHOLD, full: int = FULL_ANCHOR) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that connect all within ``threshold`` (at most 2) bits.

    All pairs within the threshold are returned, but for anchors that hold
    over ``full`` fingerprints: there the pairs returned connect the same
    fingerprints with at most 64 pairs for each.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the covering is laid out for thresholds of at most 2 bits")
    # Each row grows some sixty-fold, so few and small input partitions are dealt out first.
    dealt = distinct.select("print").repartition(shuffle_width(distinct.sparkSession), "print")
    placed = materialize(dealt.mapInArrow(_anchors(threshold), "anchor long, print long, home boolean"))
    homes = placed.where("home").select("anchor", F.col("print").alias("a"))
    copies = placed.where("!home").select("anchor", F.col("print").alias("b"))
    crowded = homes.groupBy("anchor").count().where(F.col("count") > full).select("anchor")
    near = (
        homes.join(copies, "anchor")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold))
    )
    near = near.join(crowded, "anchor", "left_anti").select("a", "b")
    inside = copies.join(crowded, "anchor", "left_semi").select("b").distinct()
    points = inside.select("b", F.explode(_points(F.col("b"))).alias("point"))
    stars = points.groupBy("point").agg(F.collect_list("b").alias("all"), F.min("b").alias("a")).where(F.size("all") > 1)
    star = stars.select("a", F.explode("all").alias("b")).where(F.col("a") != F.col("b"))
    star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return near.union(star).distinct()


def _rooted(prints: DataFrame, threshold: int, *least) -> DataFrame:
    """Every distinct fingerprint with the least one of its component (``root``) and aggregates of its rows."""
    nodes = prints.groupBy("print").agg(*least)
    star = roots(link_pairs(nodes, threshold)).withColumnRenamed("node", "print")
    return materialize(nodes.join(star, "print", "left").withColumn("root", F.coalesce("root", "print")))


def near_components(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """Every document's fingerprint and component: ``doc_id, fingerprint, component_id``.

    Documents of equal fingerprint are linked, a null or wordless text has
    fingerprint zero like any other; ``component_id`` is the least ``doc_id``
    reachable (null ids don't count; null if there is no other).  Repeated
    rows stay, an empty table gives no rows, other columns are ignored.
    Links are sought among distinct fingerprints: copies cost nothing more.
    A very long text is hashed in parts.
    """
    prints = materialize(fingerprints(docs, size))
    rooted = _rooted(prints, threshold, F.min("doc_id").alias("least"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(component, "root").select("print", "component_id")
    return prints.join(known, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component of near copies stays; all columns kept.

    That is the row of the smallest ``doc_id`` (null last; of rows with one id
    the one whose text has the smallest hash); of equal rows one stays.  Null,
    empty and blank texts share fingerprint zero and are copies of each other.
    An empty table gives no rows.
    """
    doc, body, other_doc, other_body = fresh(docs, "_doc", "_body", "_doc2", "_body2")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = materialize(fingerprints(docs.select(F.col("doc_id"), "text", text_hash.alias("body")), size, ["body"]))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "body")).alias("least")
    kept = _rooted(prints, threshold, order).groupBy("root").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.doc_id").alias(other_doc), F.col("least.body").alias(other_body))
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), body: text_hash})
    same = F.col(doc).eqNullSafe(F.col(other_doc)) & (F.col(body) == F.col(other_body))
    return keyed.join(kept, same, "left_semi").dropDuplicates([doc, body]).select(*[F.col(f"`{c}`") for c in docs.columns])
