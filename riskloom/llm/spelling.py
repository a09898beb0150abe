"""Grouping spelling variants by a relational trie frontier.

The distinct words form a trie whose edges are rows ``(node, label, child)``;
chains without a branch are one edge.  States ``(word, position, node, edits)``
are joined with the edges level by level: a state without an edit yet may
spend it where word and label part for the first time, one with its edit spent
must agree to the end.  A word that ends with one edit spent, at a node where
another word ends, has found a neighbour.

A word and its neighbour agree on the first half of the word or on the second,
so there are two tries, of words and of reversed words, and each state starts
in the middle, at the node of its own half, where few branches are left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

from .common import ascii_lower

LETTERS = "[A-Za-zÀ-ÿ]"
#: Words up to this length start at the root.
SHORT = 3
STATE = ["word", "reversed", "position", "node", "edits"]
STEP = "word string, reversed boolean, position int, node long, edits int, near string"
#: A task's counts are passed on when they hold so many words, or characters of runs longer than the last number.
FLUSH_WORDS, FLUSH_CHARS, LONG_RUN = 100_000, 4_000_000, 64


def runs(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``doc_id, run``: every maximal run of at least so many letters of whole texts, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))


def count_words(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """``word, n`` of the words of at least so many code points and occurrences."""
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _tally(min_chars: int, edit: Callable[[str | None, list[str]], list[str]] | None):
    letters = re.compile(f"{LETTERS}{{{min_chars},}}")

    def run(batches):
        counts: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Of the bytes of UTF-8 lower() changes A-Z alone.
                found = letters.findall((text.as_py() or "").encode().lower().decode())
                counts.update(edit(doc_id, found) if edit else found)
                held += sum(len(x) for x in found if len(x) > LONG_RUN)
                if len(counts) >= FLUSH_WORDS or held >= FLUSH_CHARS:
                    yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts.clear()
                    held = 0
        if counts:
            yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return run


def count_runs(
    docs: DataFrame, min_chars: int = 6, min_count: int = 5, edit: Callable[[str | None, list[str]], list[str]] | None = None
) -> DataFrame:
    """``word, n`` of the lower-cased runs of whole texts, of at least so many code points and occurrences.

    ``edit`` may change the runs of a document (its id as text, its runs of at
    least ``min_chars``) before they are counted; it must be a pure function.
    Null texts have no run, repeated rows count each; a word is counted in each
    task before it is shuffled.
    """
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _tally(min_chars, edit), "word string, n long"
    )
    totals = counts.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n"))
    return totals.where(F.col("n") >= min_count)


def _node(text: Column, depth: Column, reversed_: Column) -> Column:
    """The trie node of a prefix.  Equal hashes of different prefixes only add candidates, which are checked."""
    return F.xxhash64(reversed_, F.substring(text, F.lit(1), depth))


def _oriented(words: DataFrame) -> DataFrame:
    """Each word as it is and reversed: ``word, reversed, start, least`` (depths of its state and of its first edge)."""
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    forward = words.select(
        "word", F.lit(False).alias("reversed"), F.when(size > SHORT, half).otherwise(0).alias("start"),
        F.when(size > SHORT + 1, F.floor((size - 1) / 2).cast("int")).otherwise(0).alias("least"),
    )
    backward = words.select(
        F.reverse("word").alias("word"), F.lit(True).alias("reversed"), F.when(size > SHORT, size - half).otherwise(0).alias("start"),
        F.when(size > SHORT + 1, half).otherwise(0).alias("least"),
    )
    return forward.unionByName(backward)


def _bit(character: Column) -> Column:
    """One of 64 bits for a character; characters that share a bit only add candidates."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(character) % 64).cast("int"))


def trie_edges(words: DataFrame) -> DataFrame:
    """``node, label, child, final, least, most, below``: edges between branches, starts and ends.

    ``final`` is the word that ends at the child; words below it are ``least``
    to ``most`` characters longer than the child's prefix and go on with one of
    the characters in ``below``.
    """
    oriented = _oriented(words)
    size = F.char_length("word")
    prefixes = oriented.select("*", F.explode(F.sequence("least", size)).alias("depth")).withColumn(
        "node", _node(F.col("word"), F.col("depth"), F.col("reversed"))
    )
    following = F.when(F.col("depth") < size, F.substring("word", F.col("depth") + 1, F.lit(1)))
    stays = prefixes.groupBy("node").agg(
        F.min(following).alias("low"), F.max(following).alias("high"),
        F.max((F.col("depth") == size) | (F.col("depth") == F.col("start"))).alias("marked"),
        F.coalesce(F.bit_or(_bit(following)), F.lit(0).cast("long")).alias("below"),
    ).where(F.col("marked") | (F.col("low") != F.col("high"))).select("node", "below")
    stops = F.sort_array(F.collect_set(F.struct("depth", "below"))).alias("stops")
    depths = prefixes.join(stays, "node").groupBy("word", "reversed").agg(stops)
    steps = depths.select("word", "reversed", "stops", F.explode(F.sequence(F.lit(1), F.size("stops"))).alias("at")).where(
        F.col("at") < F.size("stops")
    )
    reached = F.get("stops", F.col("at"))
    begin, end = F.get("stops", F.col("at") - 1)["depth"], reached["depth"]
    edges = steps.select(
        _node(F.col("word"), begin, F.col("reversed")).alias("node"), F.substring("word", begin + 1, end - begin).alias("label"),
        _node(F.col("word"), end, F.col("reversed")).alias("child"),
        F.when(end == size, F.when(F.col("reversed"), F.reverse("word")).otherwise(F.col("word"))).alias("final"), (size - end).alias("left"),
        reached["below"].alias("below"),
    )
    return edges.groupBy("node", "label", "child").agg(
        F.max("final").alias("final"), F.min("left").alias("least"), F.max("left").alias("most"), F.max("below").alias("below")
    )


def _may_follow() -> Column:
    """Whether a state (``word, position, edits``) can go along an edge: looks one character beyond the label.

    Holds wherever word and label share their first character and no edit is
    spent; ``_moves`` tells the rest.
    """
    at, n = F.col("position"), F.char_length("label")
    part = lambda start, length: F.substring("word", start + 1, length)
    open_ = lambda place: (place >= F.char_length("word")) | (F.col("below").bitwiseAND(_bit(part(place, F.lit(1)))) != 0)
    rest = F.substring("label", F.lit(2), n)
    agrees = (part(at, n) == F.col("label")) & open_(at + n)
    longer_label = (part(at, n - 1) == rest) & open_(at + n - 1)
    replaced = (part(at + 1, n - 1) == rest) & open_(at + n)
    longer_word = (part(at + 1, n) == F.col("label")) & open_(at + n + 1)
    same_first = F.substring("label", 1, 1) == part(at, F.lit(1))
    return F.when(F.col("edits") == 1, agrees).otherwise(same_first | longer_label | replaced | longer_word)


def _moves(word: str, at: int, edits: int, label: str) -> list[tuple[int, int]]:
    """Positions and edits behind a label; an edit is spent where word and label first part."""
    n = len(label)
    if edits:
        return [(at + n, 1)] if word.startswith(label, at) else []
    if word.startswith(label, at):
        return [(at + n, 0)]
    k = 0
    while at + k < len(word) and word[at + k] == label[k]:
        k += 1
    out = []
    if word.startswith(label[k + 1 :], at + k):
        out.append((at + n - 1, 1))  # the label has one character more
    if at + k < len(word):
        if word.startswith(label[k + 1 :], at + k + 1):
            out.append((at + n, 1))
        if word.startswith(label[k:], at + k + 1):
            out.append((at + n + 1, 1))  # the word has one more
    return out


def _advance(batches):
    kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in STEP.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for word, reversed_, at, edits, label, child, final, least, most, below in zip(*(c.to_pylist() for c in batch.columns)):
            for position, spent in _moves(word, at, edits, label):
                left, open_ = len(word) - position, 1 - spent
                if final is not None and left == open_:
                    out.append((word, reversed_, position, child, spent, final))
                # On to where longer words lie, if one of them is of a length that can be reached.
                if not (most and least - open_ <= left <= most + open_):
                    continue
                if open_ or (left and below >> ord(word[position]) % 64 & 1):
                    out.append((word, reversed_, position, child, spent, None))
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: all ordered pairs of distinct words one inserted, deleted or replaced code point apart.

    Each level of the frontier is written to the shared folder; there are at
    most as many as branches behind the middle of any word.
    """
    edges = materialize(trie_edges(words))
    oriented = _oriented(words)
    frontier = oriented.select(
        "word", "reversed", F.col("start").alias("position"), _node(F.col("word"), F.col("start"), F.col("reversed")).alias("node"),
        F.lit(0).alias("edits"),
    )
    found: list[DataFrame] = []
    while True:
        left = F.char_length("word") - F.col("position") - F.char_length("label")
        reach = left.between(F.col("least") - 1 + F.col("edits"), F.col("most") + 1 - F.col("edits"))
        met = frontier.join(edges, "node").where(reach & _may_follow()).select(
            "word", "reversed", "position", "edits", "label", "child", "final", "least", "most", "below"
        )
        level = materialize(met.mapInArrow(_advance, STEP))
        found.append(level.where("near is not null"))
        frontier = level.where("near is null").select(*STATE)
        if frontier.isEmpty():
            break
    own = F.when(F.col("reversed"), F.reverse("word")).otherwise(F.col("word")).alias("word")
    pairs = reduce(DataFrame.unionByName, [f.select(own, "near") for f in found]).distinct()
    return pairs.where(F.levenshtein("word", "near", 1) == 1)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of forms; a round doubles the steps taken."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = materialize(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Group words with their commoner spelling: ``word, form, root, n, n_near, form_n``.

    ``words`` has each ``word`` once with its count ``n``.  Two words are near
    if one code point inserted, deleted or replaced makes one the other.  The
    form is the near word of largest count (of equal ones the smallest), if
    that is at least ``ratio`` times the word's own; forms are followed to the
    root.  Null and empty words take no part; an empty table gives no rows;
    other columns are ignored.  Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms never lead in a circle")
    words = materialize(words.where("word != ''").select("word", "n"))
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    form_n = -F.col("best.less")
    chosen = form_n >= F.lit(ratio) * F.col("n")
    told = materialize(words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, form_n).alias("form_n"),
    ))
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
