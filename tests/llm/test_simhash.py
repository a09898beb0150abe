import random

import numpy as np
import xxhash

from riskloom.llm.common import table
from riskloom.llm.components import roots
from riskloom.llm.simhash import _cosets, _syndromes, link_pairs, near_components

SCHEMA = "doc_id long, text string, print string, component_id string"
SPACES = " \t\n\x0b\x0c\r"


def brute_print(text):
    words = [w for w in "".join(" " if c in SPACES else c for c in text or "").split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                at[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(least.get(find(i), row[0]), row[0])
    return sorted((str(r[0]), f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints)))


def result(docs):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in near_components(docs).collect())


def test_code_is_perfect():
    cosets = _cosets(2)
    assert all(len(c[0]) == 1 for c in cosets)
    assert sum(len(g) for c in cosets for g in c) == sum([1, 23, 253, 1771, 8855, 33649])
    assert not _syndromes(np.array([0b110001110101], np.int64)).any()


def test_links_equal_brute_force(spark):
    random.seed(5)
    prints = {random.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ sum(1 << b for b in random.sample(range(64), random.choice([1, 2, 2, 3]))))
    signed = sorted(p - (1 << 64) * (p >> 63) for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert {tuple(r) for r in link_pairs(frame).collect()} == want
    # Every anchor counted as crowded: other pairs, the same components.
    crowded = {tuple(r) for r in link_pairs(frame, full=0).collect()}
    assert crowded <= want
    component = lambda pairs: {tuple(r) for r in roots(spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    assert component(crowded) == component(want)


def test_roots_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = dict(map(tuple, roots(spark.createDataFrame(edges, "x long, y long")).collect()))
    assert got == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1400)}


def test_odd_rows(spark):
    rows = [(i, t, "", "") for i, t in enumerate([None, "", " \n", "a", "A", "a b", "a b c", "x " * 70_000, "é b \x1c c d"])]
    rows += [(3, "a", "", ""), (None, "lonely text here now", "", ""), (None, "a", "", "")]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_whole_table(spark, data):
    docs = table(spark, data, "documents", "doc_id", "text")
    assert result(docs) == brute([tuple(r) for r in docs.collect()])
