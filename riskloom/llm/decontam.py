"""Finding benchmark passages in documents by spaced seeds.

Fixed masks over token positions ignore some places, so one substituted token
doesn't hide the rest.  The masked hashes of the benchmark items are narrow
rows (hash, item, place), broadcast in blocks of bounded size; every document
position is looked up, and each hit fetches its item's tokens and is verified
at once along its diagonal, while the document's tokens are at hand.  Tokens
are 64-bit hashes on both sides, so two different ones agree by chance once in
2^64 comparisons.  Everything is DataFrame functions; documents are not shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

from .common import fresh

#: A passage counts if so many tokens in a row agree at this share of places.
WINDOW, SHARE = 13, 0.8
#: By window length: masks (1: the token counts; 0: it may differ) of which one hits wherever 2 tokens of a window differ.
COVERS = {
    11: ("11000101011", "1101010011", "111100101", "10011111"),
    12: ("10100001111", "11001010101", "1111011"),
    13: ("10100101111", "11111011", "11011100011"),
}
#: Items shorter than any window above must agree wholly.
WHOLE = min(COVERS)
#: Bytes of seeds and of items that are broadcast at once; a seed counts this much.
BLOCK_BYTES, SEED_BYTES, TOKEN_BYTES = 96_000_000, 48, 8


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def token_hashes(text: Column) -> Column:
    """Tokens as 64-bit hashes: narrower than texts, and compared and combined faster."""
    return F.transform(tokens(text), lambda token: F.xxhash64(token))


def masks_of(width: int) -> tuple[str, ...]:
    """The masks for windows of ``width`` tokens.

    Windows without a cover of their own (other than the default window) are
    searched by the run that stays whole wherever the others differ.
    """
    if width in COVERS:
        return COVERS[width]
    if width < WHOLE:
        return ("1" * width,)
    equal = -int(-width * SHARE // 1)
    return ("1" * -(-equal // (width - equal + 1)),)


def _seeds(words: str, at: str, masks: list[str]) -> Column:
    """One hash for each mask of the tokens at and after a position."""
    return F.array(
        *[
            F.xxhash64(F.lit(mask), *[F.get(words, F.col(at) + o) for o, bit in enumerate(mask) if bit == "1"])
            for mask in masks
        ]
    )


def _positions(words: str, masks: list[str]) -> Column:
    """Where the shortest mask fits; a longer one gives a seed of fewer tokens at the end."""
    last = F.size(words) - min(map(len, masks))
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _aligned(near: str, item: str, diagonal: str) -> Column:
    """1 where an item's token equals the document's; ``near`` has the document's tokens from the item's start on."""
    places = F.sequence(F.lit(0), F.size(item) - 1)
    shift = F.least(F.col(diagonal), F.lit(0))
    return F.transform(places, lambda i: F.when(F.get(near, i + shift) == F.get(item, i), 1).otherwise(0))


def _passes(same: Column, window: int) -> Column:
    """At least one window of an alignment has the share of equal tokens; a short item agrees wholly."""
    width = F.least(F.lit(window), F.size(same))
    starts = F.sequence(F.lit(1), F.size(same) - width + 1)
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(same, s, width), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums) >= F.when(width < WHOLE, width).otherwise(F.ceil(width * F.lit(SHARE)))


def _hits(docs: DataFrame, items: DataFrame, kinds: dict[int, tuple[str, ...]], keep: list[str], window: int) -> DataFrame:
    """Verified alignments of the documents with one block of items (``number, item_id, item``)."""
    masks = sorted({m for own in kinds.values() for m in own})
    words, place, seed, own_seed, number, own_number, at, item_id, item, diagonal, near = fresh(
        docs, "_words", "_place", "_seed", "_seed2", "_number", "_number2", "_at", "item_id", "_item", "_diagonal", "_near"
    )
    seeds = (
        docs.select(*keep, token_hashes(F.col("text")).alias(words))
        .select(*keep, words, F.explode(_positions(words, masks)).alias(place))
        .select(*keep, words, place, F.explode(_seeds(words, place, masks)).alias(seed))
    )
    parts = [
        items.where(F.least(F.size("item"), F.lit(window)) == width)
        .select("number", "item", F.explode(_positions("item", kind)).alias("item_place"))
        .select(F.explode(_seeds("item", "item_place", kind)).alias("item_seed"), "number", "item_place")
        for width, kind in kinds.items()
    ]
    own = reduce(DataFrame.unionAll, parts).select(F.col("item_seed").alias(own_seed), F.col("number").alias(number), F.col("item_place").alias(at))
    hits = seeds.join(F.broadcast(own), F.col(seed) == F.col(own_seed))
    # The few tokens beside the item are cut out before rows leave the generated loop over positions.
    texts = items.select(F.col("number").alias(own_number), F.col("item_id").alias(item_id), F.col("item").alias(item))
    met = hits.join(F.broadcast(texts), F.col(number) == F.col(own_number)).withColumn(diagonal, F.col(place) - F.col(at))
    start = F.greatest(F.col(diagonal), F.lit(0)) + 1
    beside = met.select(*keep, item_id, item, diagonal, F.slice(words, start, F.size(item)).alias(near))
    same = _aligned(near, item, diagonal)
    shown = F.struct(
        F.aggregate(same, F.lit(0), lambda a, x: a + x).cast("long").alias("n_match"),
        F.size(item).cast("long").alias("n_item"), F.col(diagonal).cast("long").alias("doc_start"),
    )
    # A generator, unlike a filter, is not moved into the join, where it would end code generation.
    none = F.array().cast("array<struct<n_match:long,n_item:long,doc_start:long>>")
    passed = F.explode(F.when(_passes(same, window), F.array(shown)).otherwise(none))
    return beside.select(*keep, F.col(item_id).alias("item_id"), passed.alias("found")).select(*keep, "item_id", "found.*").distinct()


def passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Verified overlaps: ``doc_id, item_id, n_match, n_item, doc_start``, one row per pair.

    ``n_match`` of the item's ``n_item`` tokens equal the document's, aligned
    at token ``doc_start`` (negative if the item's head is cut off), for the
    alignment with most matches, the first of them on ties.  An item of fewer
    than 11 tokens must agree wholly, longer ones in 80 % of a window of
    ``window`` tokens (or of their own, if they have fewer).  Null texts and
    texts without a token take no part on either side.  Rows of one ``doc_id``
    (null too) are reported together, so are repeated items; empty tables give
    no rows; other columns are ignored.  ``keep`` names columns that identify
    a row instead of ``doc_id``.  A very long text is one row's array of
    tokens.  A benchmark too large for one broadcast is searched for in
    blocks, one pass over the documents each.
    """
    keep = keep or ["doc_id"]
    items = materialize(
        benchmark.select("item_id", token_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
        .distinct().withColumn("number", F.monotonically_increasing_id())
    )
    width = F.least(F.size("item"), F.lit(window)).alias("width")
    lengths = {r.width: (r.tokens, r.rows) for r in items.groupBy(width).agg(F.sum(F.size("item")).alias("tokens"), F.count("*").alias("rows")).collect()}
    kinds = {w: masks_of(w) for w in lengths} or {window: masks_of(window)}
    size = sum(n * (len(kinds[w]) * SEED_BYTES + TOKEN_BYTES) for w, (n, _) in lengths.items())
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks == 1:
        checked = _hits(docs, items, kinds, keep, window)
    else:
        # One block after the other, so that only one is broadcast at a time.
        block = F.pmod(F.xxhash64("number"), F.lit(blocks))
        checked = reduce(DataFrame.unionByName, [materialize(_hits(docs, items.where(block == k), kinds, keep, window)) for k in range(blocks)])
    best = F.max(F.struct("n_match", "n_item", (-F.col("doc_start")).alias("back"))).alias("best")
    return checked.groupBy(*keep, "item_id").agg(best).select(
        *keep, "item_id", "best.n_match", "best.n_item", (-F.col("best.back")).alias("doc_start")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, all columns kept.

    Null and empty texts are clean; a null ``doc_id`` is treated like any
    other; repeated rows stay or go together; an empty benchmark leaves all.
    """
    body, doc, other_body, other_doc = fresh(docs, "_body", "_doc", "_body2", "_doc2")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").alias(doc), F.xxhash64(text).alias(body), "text")
    dirty = passages(keyed, benchmark, keep=[doc, body]).select(F.col(doc).alias(other_doc), F.col(body).alias(other_body)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(other_doc)) & (F.xxhash64(text) == F.col(other_body))
    return docs.join(dirty, same, "left_anti")
