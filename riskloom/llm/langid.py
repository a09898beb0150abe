"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text tells, for any text, the
longest match from each place on.  Cutting a text greedily into such matches
gives phrases; the language that needs the fewest phrases for the characters
wins.  Every character of the samples counts, in whatever script.  Texts are
parsed in short windows side by side, one step a character and language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_training_row

FOLDS, HELD = 3, 1
#: The automata are fitted on about so many excerpts of so many characters for each language.
EXCERPTS, EXCERPT_CHARS = 120, 200
#: All automata together stay below this many characters of text.
ALL_CHARS = 1_500_000
WINDOW = 512
PART_CHARS = 3_000_000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
CODE_POINTS = 0x110000


def simplified(text: str) -> str:
    """Lower case; digits are alike, and so are runs of white space."""
    return re.sub(r"\d", "0", " ".join(text.lower().split()))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = new
            at = link[at]
        if at >= 0:
            to = moves[at][code]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(code) == to:
                    moves[at][code] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


@dataclass
class Transitions:
    """An automaton as a double array: state ``s`` has a move by code ``c`` where ``owner[base[s] + c]`` is ``s``.

    ``move`` holds four times the next state plus the phrases that end there;
    ``restart`` by code what happens where a state has no move.
    """

    base: np.ndarray
    owner: np.ndarray
    move: np.ndarray
    restart: np.ndarray

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = self.base[state] + code
        return np.where(self.owner[at] == state, self.move[at], self.restart[code])


def transitions(codes: list[int], symbols: int) -> Transitions:
    """Moves of the suffix automaton of ``codes``; codes run from 1 to ``symbols``, 0 is never learned.

    A character of another language or none ends two phrases: the one it
    breaks off and itself, as nothing learned stands for it.
    """
    moves = suffix_automaton(codes)
    restart = np.full(symbols + 1, 2, np.int32)
    for code, to in moves[0].items():
        restart[code] = 4 * to + 1
    taken = np.zeros(sum(map(len, moves)) + 4 * symbols + 64, bool)
    base, at = np.zeros(len(moves), np.int64), 0
    # States with several moves first, most moves first: each at the next offset where all its places are free.
    for state in sorted((k for k, own in enumerate(moves) if len(own) > 1), key=lambda k: -len(moves[k])):
        own = np.fromiter(moves[state], np.int64, len(moves[state]))
        while taken[at + own].any():
            at += 1
            if at + symbols >= len(taken):
                taken = np.append(taken, np.zeros(len(taken), bool))
        base[state] = at
        taken[at + own] = True
    # A single move goes to any free place whose offset isn't negative.
    single = [(k, next(iter(own))) for k, own in enumerate(moves) if len(own) == 1]
    taken = np.append(taken, np.zeros(symbols + len(single), bool))
    places = np.flatnonzero(~taken[symbols:])[: len(single)] + symbols
    for (state, code), place in zip(single, places.tolist()):
        base[state] = place - code
    taken[places] = True
    size = int(np.flatnonzero(taken).max(initial=0)) + symbols + 2
    owner, move = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for state, own in enumerate(moves):
        for code, to in own.items():
            owner[base[state] + code], move[base[state] + code] = state, 4 * to
    return Transitions(base, owner, move, restart)


@dataclass
class LanguageModel:
    """Languages, the code of every character (all that occur in any sample), and an automaton for each language."""

    languages: list[str]
    alphabet: np.ndarray
    automata: list[Transitions]


def fit_texts(samples: dict[str, list[str]]) -> LanguageModel:
    languages = sorted(lang for lang, texts in samples.items() if any(map(simplified, texts)))
    room = ALL_CHARS // max(1, len(languages))
    joined = {lang: " ".join(map(simplified, samples[lang]))[:room] for lang in languages}
    known = np.unique(np.concatenate([_code_points(t) for t in joined.values()] or [np.empty(0, "<u4")]))
    alphabet = np.zeros(CODE_POINTS, np.uint16 if len(known) < 65_535 else np.int32)  # 0: never seen
    alphabet[known] = np.arange(1, len(known) + 1)
    return LanguageModel(languages, alphabet, [transitions(alphabet[_code_points(joined[lang])].tolist(), len(known)) for lang in languages])


def fit(docs: DataFrame) -> LanguageModel:
    """Fit on a bounded number of excerpts, chosen by hash, of rows outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & is_training_row(F.col("doc_id"), FOLDS, HELD) & (F.char_length("text") > 0))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    places = 1 << 30
    cut = F.lit(0)
    for lang, n in sizes.items():
        cut = F.when(F.col("lang") == lang, min(places, places * EXCERPTS // n)).otherwise(cut)
    mixed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(places))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.char_length("text") - EXCERPT_CHARS, F.lit(0)) + 1) + 1
    rows = known.where(mixed < cut).select("lang", F.substring("text", start.cast("int"), F.lit(EXCERPT_CHARS)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for lang, text in sorted(map(tuple, rows)):
        samples.setdefault(lang, []).append(text)
    return fit_texts(samples)


def phrases(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Phrases needed for each text (rows) by each language (columns)."""
    points = [_code_points(t) for t in texts]
    codes = model.alphabet[np.concatenate(points)] if points else np.empty(0, np.uint16)
    ends = np.cumsum([len(p) for p in points])
    starts, owner, lengths = [], [], []
    for k, end in enumerate(ends):
        begin = end - len(points[k])
        own = np.arange(begin, end, WINDOW)
        starts.append(own)
        lengths.append(np.minimum(WINDOW, end - own))
        owner.append(np.full(len(own), k))
    start, length, owner = np.concatenate(starts), np.concatenate(lengths), np.concatenate(owner)
    order = np.argsort(-length, kind="stable")
    start, length, owner = start[order], length[order], owner[order]
    active = np.searchsorted(-length, -np.arange(WINDOW), "left")  # windows longer than each place
    counts = np.empty((len(model.automata), len(start)), np.int64)
    for at, automaton in enumerate(model.automata):
        state, made = np.zeros(len(start), np.int32), np.ones(len(start), np.int32)
        for place in range(int(length.max(initial=0))):
            n = active[place]
            value = automaton.step(state[:n], codes[start[:n] + place])
            made[:n] += value & 3
            np.right_shift(value, 2, out=state[:n])
        counts[at] = made
    return np.stack([np.bincount(owner, row, minlength=len(texts)) for row in counts], axis=1)


def _predict(model: LanguageModel):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            start = size = 0
            for end, text in enumerate(texts, 1):
                size += len(text or "")
                if size < PART_CHARS and end < len(texts):
                    continue
                lettered = [k for k in range(start, end) if LETTER.search(texts[k] or "")]
                if lettered and model.languages:
                    needed = phrases([simplified(texts[k]) for k in lettered], model)
                    lead = np.exp(np.maximum(needed.min(axis=1, keepdims=True) - needed, -700.0))
                    for k, best, share in zip(lettered, needed.argmin(axis=1), 1 / lead.sum(axis=1)):
                        names[k], scores[k] = model.languages[best], float(share)
                start, size = end, 0
            yield pa.record_batch([ids, pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    ``score`` is 1 over the sum of exp(fewest phrases - phrases) over all
    languages; ties go to the first name.  A null text or one without a letter
    is ``und`` with score 0, and so is every text if nothing was learned.
    ``held_out`` is true for rows that can't have been learned from (a null id
    too).  Repeated rows stay; an empty table gives no rows; other columns are
    ignored.  A very long text is parsed whole, in windows like any other.
    """
    shared = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _predict(model), "doc_id long, lang_pred string, score double"
    )
    return shared.select("doc_id", (~is_training_row(F.col("doc_id"), FOLDS, HELD)).alias("held_out"), "lang_pred", "score")
