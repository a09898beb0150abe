import hashlib

import duckdb
import numpy as np

from riskloom.llm import line_dedup
from riskloom.llm.line_dedup import PerfectHash, dedup_lines
from riskloom.llm.queries import LINE_DEDUP_SQL, QUERIES

SCHEMA = "doc_id long, text string, n_lines string, _drop string, doc string, _doc string, _doc2 string, _body2 string"
LONG = "a line that is long enough"


def brute(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(space))
    held = {}
    for doc_id, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            held.setdefault(k, []).append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            owner = max((i for i in held[k] if i is not None), default=None)
            if len(k) < 20 or len(held[k]) < 3 or doc_id == owner:
                kept.append(line)
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def result(docs):
    return sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs).collect())


def test_perfect_hash():
    rng = np.random.default_rng(1)
    first, second = rng.integers(-(2**63), 2**63, (2, 50_000))
    first[:40] = first[0]  # keys that differ in the second hash alone
    perfect = PerfectHash.build(first, second)
    assert sorted(perfect.find(first, second)) == list(range(50_000))
    twins = PerfectHash.build(np.array([5, 5]), np.array([6, 6]))
    assert twins.rest.shape == (2, 2)


def test_odd_rows(spark, monkeypatch):
    texts = [
        None, "", LONG, f" {LONG.upper()}\t\nown", f"{LONG}\n{LONG}\nx", f"own 1\n\n{LONG}", "é" * 20 + "\nshort", "é" * 20, " " + "é" * 20,
        "short\nshort", "short", "short", "\n".join(f"line number {k} of a long text" for k in range(20_000)), "É" * 20,
    ]
    rows = list(enumerate(texts)) + [(3, "twice the same long line here"), (3, "twice the same long line here"), (None, LONG)]
    rows += [(None, "a line without any document id")] * 3
    frame = spark.createDataFrame([(*r, "x", "y", "z", "a", "b", "c") for r in rows], SCHEMA)
    assert result(frame) == brute(rows)
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", 1)  # all through the shards
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 500)
    assert result(frame.repartition(5)) == brute(rows)
    monkeypatch.setattr(line_dedup, "MOST_SHARDS", 3)
    monkeypatch.setattr(line_dedup, "PACK_ROWS", 2)
    assert result(frame) == brute(rows)
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", 10**9)  # all through the broadcast table
    assert result(frame) == brute(rows)
    got = dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "_drop", "doc", "_doc", "_doc2", "_body2", "n_lines", "n_dropped"]
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_whole_table_against_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({LINE_DEDUP_SQL})").fetchall()}
    got = QUERIES["op2_line_dedup"](spark, data).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want
    assert sum(v[1] for v in want.values()) > 0
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
