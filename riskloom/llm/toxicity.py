"""Toxicity by compression distance.

Two zstandard dictionaries stand for ordinary and for toxic text.  The
ordinary one is trained on windows of ordinary documents.  The toxic one is
the same material and, behind it, what is toxic alone: words found in far more
distinct contexts of toxic than of ordinary text (contexts, not documents, so
that copies don't count twice).  A window that compresses better with the
second than with the first holds toxic material; how many windows save how
many bytes, against thresholds calibrated on rows the dictionaries haven't
seen, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_training_row

#: At most about so many labelled ids of each class are used to fit; a longer text with a chance that falls with its
#: length.  Ids that repeat with several texts give so many rows at most.
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS, FIT_ROWS = 2_000, 4_000, 32_768, 12_000
FOLDS, HELD = 5, 0
WINDOW, STEP, LEVEL = 48, 24, 9
DICTIONARY_BYTES, TOXIC_BYTES, DICTIONARY_ROWS = 65_536, 32_768, 1_000
#: A word is toxic from this many distinct contexts, this likelihood ratio and this ratio of rates.
LEAST_CONTEXTS, LEAST_RATIO, LEAST_RATE = 3, 18.0, 3.0
SAVED = (2, 3, 4, 5, 6, 8)
MARKS = b".,;:!?\"'()[]"


def windows(text: str) -> list[bytes]:
    data = text.encode().lower()
    return [data[k : k + WINDOW] for k in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
    )


@dataclass
class ToxicityModel:
    """The two dictionaries and the calibration; plain values, so it can be sent to tasks."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def compressors(self) -> tuple:
        return _compressor(self.ordinary), _compressor(self.toxic)


def features(text: str, pair: tuple) -> list[float]:
    ordinary, toxic = (c.compress for c in pair)
    saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
    top = np.sort(saved)[::-1]
    n = len(saved)
    raw = [top[0], top[:2].mean(), top[:4].mean(), saved.mean(), *((saved >= t).sum() for t in SAVED), *((saved >= t).mean() for t in SAVED)]
    return [*(math.copysign(math.log1p(abs(x)), x) for x in raw), math.log1p(n)]


def _contexts(texts: list[str]) -> Counter:
    """In how many distinct surroundings each word is found."""
    codes: dict = defaultdict(count().__next__)
    codes[b""]
    keys = []
    for text in texts:
        words = [b"", *(w.strip(MARKS) for w in text.encode().lower().split()), b""]
        code = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
        around = code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ code[2:] * np.uint64(0xD6E8FEB86659FD93)
        around ^= around >> np.uint64(29)
        # 40 mixed bits for the neighbours, 24 for the word: words beyond 2^24 can't occur in a bounded sample.
        keys.append(np.unique(around << np.uint64(24) | code[1:-1]))
    found = np.unique(np.concatenate(keys)) & np.uint64((1 << 24) - 1) if keys else np.empty(0, np.uint64)
    value, times = np.unique(found, return_counts=True)
    names = list(codes)
    return Counter({names[int(v)]: int(n) for v, n in zip(value, times)})


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words typical of toxic text, the most frequent last."""
    found, other = _contexts(toxic), _contexts(ordinary)
    n, m = sum(found.values()), sum(other.values())
    out = []
    for word, k in found.items():
        j, share = other[word], n / max(1, n + m)
        if not word or k < LEAST_CONTEXTS or k / n < LEAST_RATE * j / max(1, m):
            continue
        ratio = 2 * (k * math.log(k / ((k + j) * share)) + (j * math.log(j / ((k + j) * (1 - share))) if j else 0))
        if ratio >= LEAST_RATIO:
            out.append((k, word))
    return [word for _, word in sorted(out)]


def _train(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (p - y) + penalty * weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _dictionaries(rows: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    ordinary = [t for t, y in rows if not y]
    # Rows come by id; every so many-th is taken, so that no end of the ids is preferred.
    spread = ordinary[:: max(1, -(-len(ordinary) // DICTIONARY_ROWS))]
    base = _train([w for t in spread for w in windows(t)]) or b" " * 8
    words = toxic_words([t for t, y in rows if y], ordinary)
    return base, base + b" " + b" ".join(words)[-TOXIC_BYTES:] + b" "


def fit_texts(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Dictionaries from all rows; calibration on rows scored by dictionaries from the other half."""
    halves: list[list] = [[], []]
    turn = [0, 0]
    for text, y in zip(texts, labels):
        halves[turn[y] % 2].append((text, y))
        turn[y] += 1
    none = np.zeros(1)
    if min(turn) < 2:
        return ToxicityModel(b"", b"", none, none, none, constant=float(sum(labels) / len(labels)) if labels else 0.0)
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        pair = tuple(map(_compressor, _dictionaries(other)))
        x += [features(t, pair) for t, _ in own]
        y += [label for _, label in own]
    table = np.array(x)
    mean, scale = table.mean(axis=0), table.std(axis=0) + 1e-9
    weights = _logistic(np.c_[(table - mean) / scale, np.ones(len(table))], np.array(y, float))
    return ToxicityModel(*_dictionaries(halves[0] + halves[1]), mean, scale, weights)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample, chosen by hash, of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.where(is_training_row(F.col("label_id"), FOLDS, HELD)).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    places = 1 << 20
    cut = {y: min(places, int(places * most / max(1, sizes.get(y, 0)))) for y, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY))}
    chosen = known.where(
        F.pmod(F.xxhash64("label_id"), F.lit(places)) < F.when(F.col("toxic") == 1, cut[1]).otherwise(cut[0])
    )
    # Texts beyond FIT_CHARS are taken with a chance that falls with their length: the sample's characters stay bounded.
    fits = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(places)) * F.char_length("text") < FIT_CHARS * places
    rows = (
        # The sample's bound holds for the broadcast too, so texts are not shuffled.
        docs.where(fits).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "text", "toxic").distinct().orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(FIT_ROWS).toPandas()
        .sort_values(["doc_id", "text"], kind="stable")
    )
    return fit_texts(list(rows["text"]), [int(y) for y in rows["toxic"]])


def _scores(model: ToxicityModel, texts: list[str | None], pair: tuple | None) -> np.ndarray:
    if pair is None:
        return np.full(len(texts), model.constant)
    x = np.array([features(t or "", pair) for t in texts])
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scorer(model: ToxicityModel):
    def run(batches):
        pair = None if model.constant is not None else model.compressors()
        for batch in batches:
            if batch.num_rows:
                scores = _scores(model, batch.column(1).to_pylist(), pair)
                yield pa.record_batch([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    A null text is scored as an empty one.  ``held_out`` is true for rows that
    can't have been learned from (a null id too).  Repeated rows stay; an
    empty table gives no rows; other columns are ignored.  A model fitted
    without both classes gives every text the share of toxic rows.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    scored = docs.select(ids, "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id", (~is_training_row(F.col("doc_id"), FOLDS, HELD)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _keeper(model: ToxicityModel, place: int):
    def run(batches):
        pair = None if model.constant is not None else model.compressors()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(model, batch.column(place).to_pylist(), pair) < 0.5))

    return run


def clean_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents not predicted toxic, all columns kept."""
    return docs.mapInArrow(_keeper(model, docs.columns.index("text")), docs.schema)
