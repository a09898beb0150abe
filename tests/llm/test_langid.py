import random
import zlib

import numpy as np

from riskloom.llm import langid
from riskloom.llm.common import table
from riskloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score string"


def brute_phrases(text, trained):
    """Greedy longest matches; a phrase ends before the first character that doesn't continue it, and an unknown one is a phrase more."""
    n, k = 0, 0
    for w in range(0, len(text), langid.WINDOW):
        part, k, n = text[w : w + langid.WINDOW], 0, n + 1
        current = ""
        for c in part:
            if current + c in trained:
                current += c
            else:
                n += 1 + (c not in trained)
                current = c if c in trained else ""
    return n


def test_phrases_equal_brute_force():
    random.seed(3)
    trained = {k: "".join(random.choices(k, k=300)) for k in ("aab ", "abbc", "zyx")}
    model = langid.fit_texts({k: [t] for k, t in trained.items()})
    texts = ["".join(random.choices("abcxyz ñ", k=n)).strip() for n in (1, 5, 40, 700, 1300)]
    texts = [langid.simplified(t) for t in texts]
    want = [[brute_phrases(t, langid.simplified(trained[lang])) for lang in model.languages] for t in texts]
    assert langid.phrases(texts, model).astype(int).tolist() == want


def test_large_and_small_scripts(spark):
    """Two languages of 3,000 and 2,000 signs, all about equally frequent, beside three of about thirty."""
    rng = random.Random(5)
    scripts = {"han": [chr(0x4E00 + k) for k in range(3_000)], "syl": [chr(0xAC00 + k) for k in range(2_000)]}
    scripts |= {"lat": [chr(97 + k) for k in range(26)], "cyr": [chr(0x430 + k) for k in range(32)], "gre": [chr(0x3B1 + k) for k in range(24)]}
    pairs = {lang: [rng.choice(signs) + rng.choice(signs) for _ in range(1_500)] for lang, signs in scripts.items()}
    rows = []
    for k in range(1_500):
        lang = list(scripts)[k % 5]
        words = [rng.choice(pairs[lang]) if rng.random() < 0.5 else "".join(rng.choices(scripts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60))]
        rows.append((k, " ".join(words), lang, ""))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(frame, langid.fit(frame)).join(frame.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.97 * len(got) > 400
    for lang in scripts:
        own = [r for r in got if r.lang == lang]
        assert sum(r.lang_pred == lang for r in own) > 0.95 * len(own)


def test_double_array_has_every_move():
    rng = random.Random(2)
    codes = [rng.randint(1, 400) for _ in range(4_000)] + [rng.randint(1, 3) for _ in range(500)]
    moves, made = langid.suffix_automaton(codes), langid.transitions(codes, 400)
    for state, own in enumerate(moves):
        for code in (*own, *rng.choices(range(401), k=20)):
            value = made.step(np.array([state]), np.array([code]))[0]
            want = 4 * own[code] if code in own else 4 * moves[0][code] + 1 if code in moves[0] else 2
            assert value == want


def test_odd_rows(spark):
    rows = [(i, "uno dos tres cuatro" if i % 2 else "one two three four", "es" if i % 2 else "en", "") for i in range(60)]
    rows += [(100, None, "en", ""), (101, "", None, ""), (102, "123 ...", "es", ""), (None, "three four", None, ""), (1, "uno dos", "es", "")]
    rows += [(103, "tres cuatro " * 30_000, None, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(frame)
    assert model.languages == ["en", "es"]
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(frame, model).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "es"), (1, "es"), (2, "en")} <= got
    assert langid.predict(spark.createDataFrame([], SCHEMA), model).collect() == []
    nothing = langid.fit(spark.createDataFrame([], SCHEMA))
    assert {r.lang_pred for r in langid.predict(frame, nothing).collect()} == {"und"}


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op9_language"](spark, folder).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    both = got.merge(table(spark, folder, "documents").toPandas(), on="doc_id")
    both = both[both.held_out]
    right = (both.lang_pred == both.lang).mean()
    print("held-out accuracy", right, len(both))
    assert right > 0.97 and np.isfinite(both.score).all() and both.score.between(0, 1).all()
