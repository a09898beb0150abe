"""Format-preserving pseudonyms for personal data in texts.

Card numbers (Luhn), phone numbers, IBANs (mod 97), social security numbers,
IPv4 addresses, dates and mail addresses are found, validated, numbered within
the set of all valid values of their format, permuted there by a keyed Feistel
network with cycle walking, and written back in the form they had.  The same
value becomes the same pseudonym in every document, whatever its punctuation;
with the key the permutation can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Dates in this range are permuted, among those that are written alike.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("mail", "iban", "ip", "card", "ssn", "date", "phone")
FOUND = re.compile(
    r"""
    (?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})
  | (?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
  | (?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))
  | (?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]))
  | (?P<card>(?<![\d])(?:\d{13,19}|\d{4}(?P<gap>[\ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}(?P<space>[\ -])\d{6}(?P=space)\d{5})(?!\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
  | (?P<phone>(?<![\d(])(?:\+?1[\ .-]?)?(?:\(\d{3}\)\ ?|\d{3}[\ .-])\d{3}[\ .-]\d{4}(?!\d))
    """,
    re.X | re.A,
)
WORD_END = re.compile(r"(?<=\w)(?!\w)", re.A)
#: Characters of an IBAN by country; of other countries any length that passes the check is taken.
IBAN_SIZES = {
    country: int(size)
    for size, countries in (part.split(":") for part in (
        "15:NO 16:BE 18:DK,FO,FI,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,PL "
        "29:BR,PS,QA,UA 30:JO,KW,MU 31:MT"
    ).split())
    for country in countries.split(",")
}
HINT = re.compile(r"[0-9@]")


def _half(key: bytes, tweak: bytes, turn: int, value: int, bits: int) -> int:
    data = b"%d|" % turn + tweak + b"|" + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    digest = hashlib.shake_256(len(key).to_bytes(2, "big") + key + data).digest(bits // 8 + 1)
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, kind: str, undo: bool = False) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network, walked until it lands inside."""
    bits = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    tweak = f"{kind}:{size}".encode()
    mask = (1 << bits) - 1
    while True:
        left, right = value >> bits, value & mask
        for turn in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if undo:
                left, right = right ^ _half(key, tweak, turn, left, bits), left
            else:
                left, right = right, left ^ _half(key, tweak, turn, right, bits)
        value = left << bits | right
        if value < size:
            return value


def luhn_digit(body: str) -> str:
    """The check digit behind ``body``."""
    total = 0
    for place, digit in enumerate(reversed(body)):
        value = int(digit) * (2 - place % 2)
        total += value - 9 if value > 9 else value
    return str(-total % 10)


def _refill(form: str, characters: str) -> str:
    """Put characters in the places of a form's letters and digits."""
    fresh = iter(characters)
    return "".join(next(fresh) if c.isalnum() else c for c in form)


def _card(text: str, number) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or not digits.strip("0"):
        return None
    body = str(number(int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    return _refill(text, body + luhn_digit(body))


def _phone(text: str, number) -> str | None:
    digits = re.sub(r"\D", "", text)
    prefix, local = digits[:-10], digits[-10:]
    area, exchange, line = int(local[:3]), int(local[3:6]), int(local[6:])
    if area < 200 or exchange < 200:
        return None
    value = number(((area - 200) * 800 + exchange - 200) * 10_000 + line, 800 * 800 * 10_000)
    rest, line = divmod(value, 10_000)
    return _refill(text, f"{prefix}{rest // 800 + 200}{rest % 800 + 200}{line:04d}")


def _ssn(text: str, number) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    areas = area - 1 - (area > 666)
    value = number((areas * 99 + group - 1) * 9_999 + serial - 1, 898 * 99 * 9_999)
    rest, serial = divmod(value, 9_999)
    areas, group = divmod(rest, 99)
    return f"{areas + 1 + (areas >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, number) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    value = number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, value.to_bytes(4, "big")))


@cache
def _date_classes() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Days alike in how they can be written: the days of each class, and every day's class and place in it.

    A class fixes whether day and month have one digit or two, and whether the
    day can be read as a month; so a pseudonym reads in the same order and has
    fields of the same width, in whatever style the date was written.
    """
    days = np.arange(FIRST_DAY, LAST_DAY + 1)
    found = [datetime.date.fromordinal(int(d)) for d in days]
    group = np.array([2 * ((d.day > 9) + (d.day > 12)) + (d.month > 9) for d in found])
    members = [days[group == g] for g in range(6)]
    place = np.empty(len(days), np.int64)
    for own in members:
        place[own - FIRST_DAY] = np.arange(len(own))
    return members, group, place


def _date(text: str, number) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    orders = {"-": ["ymd"], ".": ["dmy"], "/": ["mdy", "dmy"]}[mark]
    for order in orders:
        values = dict(zip(order, map(int, parts)))
        try:
            day = datetime.date(values["y"], values["m"], values["d"]).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            members, group, place = _date_classes()
            own = members[group[day - FIRST_DAY]]
            new = datetime.date.fromordinal(int(own[number(int(place[day - FIRST_DAY]), len(own))]))
            shown = {"y": new.year, "m": new.month, "d": new.day}
            return mark.join(str(shown[c]).zfill(len(part)) for c, part in zip(order, parts))
    return None


def _mixed(text: str, number) -> str:
    """Letters and digits permuted within their kinds, everything else as it was."""
    value, size = 0, 1
    sets = [("0", 10) if c.isdigit() else ("A", 26) if c.isupper() else ("a", 26) for c in text if c.isalnum()]
    for c, (first, radix) in zip((c for c in text if c.isalnum()), sets):
        value, size = value * radix + ord(c) - ord(first), size * radix
    value = number(value, size) if size > 1 else value
    out = []
    for first, radix in reversed(sets):
        value, digit = divmod(value, radix)
        out.append(chr(ord(first) + digit))
    return _refill(text, "".join(reversed(out)))


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(text: str, number) -> str | None:
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or f"{_iban_check(country, rest):02d}" != check:
        return None
    new = _mixed(rest, number)
    return _refill(text, f"{country}{_iban_check(country, new):02d}{new}")


def _iban_ends(match: re.Match) -> list[int]:
    """Where the IBAN may end: at its country's length, else the longest first; the pattern may have taken in the next word."""
    ends = [m.start() for m in WORD_END.finditer(match.string, match.start() + 1, match.end())]
    size = lambda end: sum(c != " " for c in match.string[match.start() : end])
    return sorted(ends, key=lambda end: (size(end) != IBAN_SIZES.get(match[0][:2]), -end))


def _mail(text: str, number) -> str | None:
    name, domain = text.rsplit("@", 1)
    return f"{_mixed(name, lambda v, size: number(v, size))}@{domain}"


RULES = {"mail": _mail, "iban": _iban, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone}


def pseudonymise(text: str, key: bytes, undo: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind there were."""
    counts: dict[str, int] = {}
    if not HINT.search(text):
        return text, counts
    out, done, place = [], 0, 0
    while match := FOUND.search(text, place):
        kind = next(k for k in KINDS if match[k] is not None)
        number = lambda value, size, kind=kind: permute(value, size, key, kind, undo)
        for end in _iban_ends(match) if kind == "iban" else (match.end(),):
            new = RULES[kind](text[match.start() : end], number)
            if new is not None:
                break
        if new is None:
            place = match.start() + 1
            continue
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[done : match.start()], new]
        done = place = end
    return "".join(out) + text[done:], counts


def _replace(key: bytes):
    def run(batches):
        for batch in batches:
            texts, found = [], {k: [] for k in KINDS}
            for text in batch.column(1).to_pylist():
                new, counts = (None, {}) if text is None else pseudonymise(text, key)
                texts.append(new)
                for k in KINDS:
                    found[k].append(counts.get(k, 0))
            columns = [pa.array(found[k], pa.int64()) for k in KINDS]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), *columns], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return run


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text`` and a count per kind (``n_mail`` ... ``n_phone``) of every document.

    A null text stays null and an empty one empty, with counts of zero; a null
    ``doc_id`` and repeated rows stay; an empty table gives no rows; other
    columns are ignored.  Values that fail their format's check are left alone.
    Very long texts are searched whole, in one pass.
    Keep ``key`` secret: who has it can undo the pseudonyms.
    """
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_replace(key.encode()), schema)
