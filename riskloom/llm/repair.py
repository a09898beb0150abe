"""Repairing the structure of conversations by Knuth's lightest derivation.

A derivation item says: the first rows of a conversation are edited, and the
roles written so far leave the grammar ``(s?(ua)+)?`` in some state.  Each edit
is a deduction from one item to another whose value, a cost and the audit of
edits that led there, is a superior function of its premise: it only grows,
and keeps the order of premises.  So items popped from the agenda in order of
value are final, and the first goal item popped is the lightest repair.

Conversations of ordinary size are sorted and repaired as they stream by.
Longer ones are cut into blocks that tasks share: an agenda for each state
before a block yields its items ``state -> state``, whose values compose along
the conversation; then every block knows the states it leads between.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize, shuffle_width

from .common import ASCII_SPACE

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: By state (nothing written, after system, user, assistant) and initial written: the next state.
NEXT = {"-": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FINAL = "-a"
ROLES = {"u": "user", "a": "assistant"}
FOLLOWS = {"su", "ua", "au"}
#: Conversations beyond these are repaired in blocks of so many rows.
MOST_ROWS, MOST_BYTES, BLOCK_ROWS = 4_000, 32_000_000, 1_000
BLOCK_SHIFT = 33
#: Characters of a text that take part in dealing a long conversation to tasks.
DEALT_CHARS = 32
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
TURNS = "conv_id long, place long, edit string, role string, text string"


@dataclass
class Row:
    """One row in order: its fault, and how many copies right behind it must go."""

    role: str
    text: str
    fault: str  # blank, duplicate, truncated or nothing
    copies: int = 0

    @property
    def goes(self) -> bool:
        return self.fault in ("blank", "duplicate")


def fault_of(text: str, seen: bool) -> str:
    end = text.rstrip(ASCII_SPACE)
    if not end:
        return "blank"
    return "duplicate" if seen else "" if end[-1] in ".!?" else "truncated"


def _edits(row: Row, state: str) -> Iterator[tuple[int, str, str]]:
    """Cost, audit and next state of each way to treat a row and its copies."""
    copies = "D" * row.copies
    yield DELETE * (1 + row.copies), "D" + copies, state
    if not row.goes:
        extra = DELETE * row.copies + (TRUNCATED if row.fault == "truncated" else 0)
        kept = NEXT[state].get(row.role[:1])
        if kept:
            yield extra, "K" + copies, kept
        for initial, to in NEXT[state].items():
            if initial in ROLES:
                yield REROLE + extra, "R" + copies, to


def lightest(rows: list[Row], start: str, goals: str) -> dict[str, tuple[int, str]]:
    """Least (cost, audit) by goal state after all rows, from ``start`` before them.

    Deductions leave an item one by one as it is popped; with a single pair of
    goals that both accept, the caller stops at the first.
    """
    agenda = [(0, "", 0, start)]
    final: set[tuple[int, str]] = set()
    found: dict[str, tuple[int, str]] = {}
    first_only = goals == FINAL
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows) and state in goals:
            found[state] = (cost, audit)
            if first_only or len(found) == len(goals):
                break
        for initial, to in NEXT[state].items():
            if initial in ROLES and (at, to) not in final:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", at, to))
        if at < len(rows):
            for extra, letters, to in _edits(rows[at], state):
                if (at + 1, to) not in final:
                    heapq.heappush(agenda, (cost + extra, audit + letters, at + 1, to))
    return found


def written(rows: list[Row], audit: str, state: str) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row that an audit leaves, from a state on."""
    at, copies = 0, 0
    for edit in audit:
        if edit == "D":
            if copies:
                copies -= 1
            else:
                copies, at = rows[at].copies, at + 1
            continue
        if edit == "K":
            role, text = rows[at].role, rows[at].text
            state = NEXT[state][role[0]]
        else:
            state = next(to for initial, to in NEXT[state].items() if initial in ROLES)
            role, text = ROLES[state], rows[at].text if edit == "R" else ""
        if edit != "I":
            copies, at = rows[at].copies, at + 1
        yield edit, role, text


def _conversations(batches, names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal leading ``names``, across batches; other columns as tuples."""
    key, held = None, []
    for batch in batches:
        columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
        others = [columns[n] for n in columns if n not in names]
        for own, row in zip(zip(*(columns[n] for n in names)), zip(*others)):
            if own != key:
                if held:
                    yield key, held
                key, held = own, []
            held.append(row)
    if held:
        yield key, held


def _short(batches):
    """Repair conversations whose rows follow one another in order."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    out: list[tuple] = []
    for (conv_id,), own in _conversations(batches, ["conv_id"]):
        seen: set = set()
        rows = []
        for turn, role, text in own:
            rows.append(Row(role, text, fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        turns = {turn for turn, _, _ in own if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = [sum(r.fault == f for r in rows) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a.role[:1] + b.role[:1] not in FOLLOWS for a, b in zip(rows, rows[1:]))
        (cost, audit), = lightest(rows, "-", FINAL).values()
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in written(rows, audit, "-")).encode()).hexdigest()
        out.append((conv_id, gaps, *faults, illegal, cost, audit, digest))
        if len(out) >= 2_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)


# ---- conversations too long for one agenda

KEYS = ["conv_id", "turn", "role", "text"]
ITEMS = "conv_id long, block long, before string, after string, cost long, audit string, rows long, faults array<long>, illegal long, first string, last string"


def _numbered(batches):
    """Number the sorted rows of a task in blocks; a block never holds two conversations."""
    part = TaskContext.get().partitionId()
    key, block, place = None, (part << BLOCK_SHIFT) - 1, 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        blocks, places = [], []
        for k, own in enumerate(ids):
            if (own,) != key or place == BLOCK_ROWS:
                key, block, place = (own,), block + 1, 0
            blocks.append(block)
            places.append(place)
            place += 1
        yield batch.append_column("block", pa.array(blocks, pa.int64())).append_column("place", pa.array(places, pa.int32()))


def _block_rows(frame: pd.DataFrame) -> list[Row]:
    """Rows of a block in order; a row's copies stand right behind it and are blank or duplicates."""
    out = []
    for role, text, n, first in zip(*(frame[c] for c in ("role", "text", "n", "first"))):
        out.append(Row(role, text, fault_of(text, not first), int(n) - 1))
    return out


def _items(frame: pd.DataFrame) -> pd.DataFrame:
    """All items ``before -> after`` of one block, with what can be counted inside it."""
    frame = frame.sort_values("place")
    rows = _block_rows(frame)
    initials = [r.role[:1] for r in rows]
    faults = [0, 0, 0]
    for row in rows:
        if row.fault:
            faults[("blank", "duplicate", "truncated").index(row.fault)] += 1
        faults[0 if row.fault == "blank" else 1] += row.copies
    # A row and its copy never alternate.
    illegal = sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:])) + sum(r.copies for r in rows if r.role[:1] * 2 not in FOLLOWS)
    id_, block = frame["conv_id"].iloc[0], frame["block"].iloc[0]
    made = [
        (id_, block, before, after, cost, audit, len(rows), faults, illegal, initials[0], initials[-1])
        for before in NEXT
        for after, (cost, audit) in lightest(rows, before, "".join(NEXT)).items()
    ]
    names = [c.split()[0] for c in ITEMS.split(", ")]
    return pd.DataFrame(made, columns=names).astype({"conv_id": "Int64"})


CHAIN = "conv_id long, block long, before string, audit string, cost long, blank long, duplicate long, truncated long, illegal long"


def _chained(batches):
    """Compose the items of each conversation's blocks in order; a row for each block of the lightest chain."""
    names = [c.split()[0] for c in CHAIN.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.int64()] * 5
    for (conv_id,), own in _conversations(batches, ["conv_id"]):
        best: dict[str, tuple[int, str]] = {"-": (0, "")}
        back: list[dict[str, tuple[str, str]]] = []
        blocks: list[int] = []
        totals, illegal, last = [0, 0, 0], 0, None
        by_block: dict[int, list] = {}
        for block, *item in own:
            by_block.setdefault(block, []).append(item)
        for block, items in by_block.items():
            new: dict[str, tuple[int, str]] = {}
            came: dict[str, tuple[str, str]] = {}
            for before, after, cost, audit, *_ in items:
                if before in best:
                    value = (best[before][0] + cost, best[before][1] + audit)
                    if after not in new or value < new[after]:
                        new[after], came[after] = value, (before, audit)
            _, _, _, _, _, faults, inside, first, end = items[0]
            totals = [a + b for a, b in zip(totals, faults)]
            illegal += inside + (last is not None and last + first not in FOLLOWS)
            best, last = new, end
            back.append(came)
            blocks.append(block)
        state = min((best[s], s) for s in FINAL if s in best)[1]
        cost, path = best[state][0], []
        for block, came in zip(reversed(blocks), reversed(back)):
            before, audit = came[state]
            path.append((conv_id, block, before, audit, cost, *totals, illegal))
            state = before
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*reversed(path)), kinds, strict=True)], names)


def _spelled(batches):
    """Over sorted rows of blocks whose audits are known: audit and digest, holding one block at a time."""
    names = ["conv_id", "audit", "repaired_sha256"]
    key, digest, audits, lines = None, None, [], 0
    flush = lambda: pa.record_batch(
        [pa.array([key[0]], pa.int64()), pa.array(["".join(audits)]), pa.array([digest.hexdigest()])], names
    )
    for (conv_id, _, before, audit), own in _conversations(batches, ["conv_id", "block", "before", "audit"]):
        if (conv_id,) != key:
            if key is not None:
                yield flush()
            key, digest, audits, lines = (conv_id,), hashlib.sha256(), [], 0
        rows = [Row(role, text, "", n - 1) for _, role, text, n in own]
        for _, role, text in written(rows, audit, before):
            digest.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
            lines += 1
        audits.append(audit)
    if key is not None:
        yield flush()


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[f"{name}_"])
    return out


def _suffixed(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.withColumnsRenamed({n: f"{n}_" for n in names})


def _long(rows: DataFrame) -> DataFrame:
    """The report of conversations of any length; copies of a row travel once."""
    width = shuffle_width(rows.sparkSession)
    packed = rows.groupBy(*KEYS).agg(F.count("*").alias("n"))
    dealt = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, DEALT_CHARS)]
    schema = "conv_id long, turn long, role string, text string, n long, block long, place int"
    numbered = materialize(packed.repartitionByRange(width, *dealt).sortWithinPartitions(*KEYS).mapInArrow(_numbered, schema))
    # Equal role and text: the first of them in order is no duplicate.
    same = ["conv_id", "role", "text"]
    firsts = numbered.groupBy(*same).agg(F.min(F.struct("block", "place")).alias("at"))
    firsts = _suffixed(firsts, same)
    told = numbered.join(firsts, _same(numbered, firsts, same)).select(
        "conv_id", "block", "place", "role", "text", "n", (F.struct("block", "place") == F.col("at")).alias("first")
    )
    items = told.groupBy("conv_id", "block").applyInPandas(_items, ITEMS)
    chain = materialize(items.repartition(width, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chained, CHAIN))
    known = _suffixed(chain.select("conv_id", "block", "before", "audit"), ["block", "conv_id"])
    # Blocks are of one conversation each; a block is enough to join on.
    joined = numbered.join(known, numbered["block"] == known["block_"]).select("conv_id", "block", "before", "audit", "place", "role", "text", "n")
    spelled = joined.repartition(width, "conv_id").sortWithinPartitions("conv_id", "block", "place").mapInArrow(
        _spelled, "conv_id long, audit string, repaired_sha256 string"
    )
    turns = numbered.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    counts = chain.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    turns, counts = _suffixed(turns, ["conv_id"]), counts.withColumnRenamed("conv_id", "conv_id__")
    out = spelled.join(turns, spelled["conv_id"].eqNullSafe(turns["conv_id_"])).join(counts, spelled["conv_id"].eqNullSafe(counts["conv_id__"]))
    return out.select(*[c.split()[0] for c in REPORT.split(", ")])


def _plain(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )


def repair(conversations: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Faults and the lightest repair of each conversation; one row for each ``conv_id`` (null is one too).

    Rows are ordered by ``turn`` (nulls first), role and text, so ties have one
    order and repeated rows stand together (all but the first are duplicates).
    ``blank``, ``duplicate`` and ``truncated`` count each row's first fault,
    ``illegal`` the neighbours whose role initials are not su, ua or au, and
    ``gaps`` the turns missing between least and largest.  ``cost`` and
    ``audit`` (Keep, Rerole, Delete, Insert) describe the cheapest edits, of
    equally cheap ones the ASCII-least; ``repaired_sha256`` is the digest of
    the repaired ``role:text`` lines.  A null role or text is one space.  An
    empty table gives no rows; other columns are ignored.  Very long texts are
    only hashed; a conversation beyond ``most_rows`` or ``most_bytes`` is
    repaired in blocks, with the same result.  (Its digest alone has to be
    taken in one task, which reads it block by block.)
    """
    rows = _plain(conversations)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    long = materialize(sizes.where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select(F.col("conv_id").alias("conv_id_")))
    width = shuffle_width(rows.sparkSession)
    is_long = rows["conv_id"].eqNullSafe(long["conv_id_"])
    short = rows.join(long, is_long, "left_anti").repartition(width, "conv_id").sortWithinPartitions(*KEYS).mapInArrow(_short, REPORT)
    if long.isEmpty():
        return short
    return short.unionByName(_long(rows.join(long, is_long, "left_semi")))


def repaired_turns(conversations: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """The repaired rows: ``conv_id, place, edit, role, text``, from the audits of ``repair``.

    Null and tied rows are treated as there.  Rows of one conversation stream
    through a task in order; only its audit is held.
    """
    rows = _plain(conversations)
    audits = (report if report is not None else repair(conversations)).select(F.col("conv_id").alias("conv_id_"), "audit")
    joined = rows.join(audits, rows["conv_id"].eqNullSafe(audits["conv_id_"])).select(*KEYS, "audit")

    def run(batches):
        names = [c.split()[0] for c in TURNS.split(", ")]
        kinds = [pa.int64(), pa.int64()] + [pa.string()] * 3
        key, at, state, place = None, 0, "-", 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, _, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv_id,) != key:
                    key, at, state, place = (conv_id,), 0, "-", 0
                # Inserted rows stand before the row whose edit follows them, or behind the last one.
                left = True
                while at < len(audit) and (left or audit[at] == "I"):
                    edit, at = audit[at], at + 1
                    if edit != "I":
                        if not left:
                            at -= 1
                            break
                        left = False
                    if edit != "D":
                        state = NEXT[state][role[0]] if edit == "K" else next(to for x, to in NEXT[state].items() if x in ROLES)
                        out.append((conv_id, place, edit, role if edit == "K" else ROLES[state], "" if edit == "I" else text))
                        place += 1
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    width = shuffle_width(rows.sparkSession)
    return joined.repartition(width, "conv_id").sortWithinPartitions(*KEYS).mapInArrow(run, TURNS)
