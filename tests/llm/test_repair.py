import hashlib
import random
import re

import pytest
from compare import canonical, connect

from riskloom.llm import queries, sql
from riskloom.llm.repair import FINAL, Row, lightest, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, place long, first string"


def enumerated(rows):
    """The least (cost, audit) over all edit sequences with at most three inserts in a row."""
    best = None

    def go(at, roles, cost, audit):
        nonlocal best
        if (best and cost > best[0]) or not re.fullmatch("s?(ua)*u?", roles):
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if not audit.endswith("III"):
            for initial in "ua":
                go(at, roles + initial, cost + 5, audit + "I")
        if at < len(rows):
            row = rows[at]
            go(at + 1, roles, cost + 2, audit + "D")
            if not row.goes:
                extra = 5 if row.fault == "truncated" else 0
                go(at + 1, roles + (row.role[:1] or "?"), cost + extra, audit + "K")
                for initial in "ua":
                    go(at + 1, roles + initial, cost + extra + 1, audit + "R")

    go(0, "", 0, "")
    return best


def test_agenda_against_enumeration():
    rng = random.Random(3)
    for _ in range(800):
        rows = [
            Row(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), "x.", rng.choice(["", "", "", "blank", "truncated", "duplicate"]))
            for _ in range(rng.randint(0, 6))
        ]
        (best,) = lightest(rows, "-", FINAL).values()
        assert best == enumerated(rows)


def conversations(spark, seed=5, convs=60, most=25):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No!", "cut off", " \t", "", None, "what?", "né. ", "x" * rng.randint(1, 40) + rng.choice([".", ""])])
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""])
            rows += [(conv, rng.choice([turn, turn, turn // 2, None]), role, text, 7, "clash")] * rng.choice([1, 1, 1, 2, 3])
    rows += [(1_000, k, ("user", "assistant")[k % 2], f"turn {k}.", 7, "") for k in range(2_500) if k % 17]
    rows += [(1_001, 3, "user", "again and again.", 7, "")] * 900 + [(1_001, 4, "assistant", "yes.", 7, "")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def ordered(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_blocks_give_the_same_as_one_agenda(spark):
    rows = conversations(spark)
    short = ordered(repair(rows, most_rows=10**9, most_bytes=10**12))
    assert ordered(repair(rows, most_rows=0)) == short
    assert ordered(repair(rows, most_rows=20)) == short
    assert len(short) == 63
    wide = {r[0]: r for r in short}[1_001]
    assert wide[3] == 899 and wide[7] == "K" + "D" * 899 + "K"


def test_counts_and_order(spark):
    rows = [
        (1, None, "user", "a.", 0, ""), (1, 5, "assistant", "b", 0, ""), (1, 9, "user", "c?", 0, ""), (1, 9, "user", "c?", 0, ""),
        (2, None, "assistant", None, 0, ""), (3, 4, "system", "s.", 0, ""), (3, 2, "user", "u.", 0, ""),
    ]
    found = {r.conv_id: r for r in repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (found[1].gaps, found[1].blank, found[1].duplicate, found[1].truncated, found[1].illegal) == (3, 0, 1, 1, 1)
    assert (found[1].cost, found[1].audit) == (5, "KDRD")
    assert (found[2].gaps, found[2].blank, found[2].audit, found[2].repaired_sha256) == (0, 1, "D", hashlib.sha256(b"").hexdigest())
    assert (found[3].audit, found[3].illegal, found[3].cost) == ("KR", 1, 1)
    assert found[3].repaired_sha256 == hashlib.sha256(b"user:u.\nassistant:s.").hexdigest()


def test_repaired_turns_are_what_the_digest_covers(spark):
    rows = conversations(spark, seed=8)
    report = repair(rows)
    lines = {}
    for r in sorted(repaired_turns(rows, report).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        lines.setdefault(r.conv_id, []).append(r)
    for r in report.collect():
        own = lines.get(r.conv_id, [])
        assert [x.place for x in own] == list(range(len(own)))
        assert "".join(x.edit for x in own) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256


def test_empty_table_and_long_text(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repaired_turns(spark.createDataFrame([], SCHEMA)).collect() == []
    long = spark.createDataFrame([(1, 0, "user", "y " * 400_000 + ".", 0, ""), (1, 1, "assistant", "z.", 0, "")], SCHEMA)
    assert repair(long).first().audit == repair(long, most_rows=0).first().audit == "KK"


@pytest.mark.parametrize("name, text", [("op11_conversations", sql.REPAIR)])
def test_query_equals_sql(spark, data, name, text):
    ours, theirs = canonical(queries.QUERIES[name](spark, data).toPandas()), canonical(connect(data).sql(text).df())
    assert ours.equals(theirs)
