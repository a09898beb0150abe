import datetime
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from riskloom.llm.common import table
from riskloom.llm.pii import FIRST_DAY, KINDS, LAST_DAY, _date, _iban_check, luhn_digit, permute, pseudonymise, pseudonyms

KEY = b"test key"
VALUES = [
    ("card", "4041894974608795"), ("card", "4041-8949-7460-8795"), ("card", "3782 822463 10005"), ("phone", "+1 (988) 555-2485"),
    ("phone", "988-555-2485"), ("ip", "10.12.0.255"), ("date", "2023-02-28"), ("date", "31.12.1999"), ("date", "02/28/2023"),
    ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("mail", "bosbt.42@mail8.example.com"),
]
LEFT = [
    "4041894974608796", "+1 (088) 555-2485", "10.12.0.256", "2023-02-30", "000-45-6789", "DE88 3704 0044 0532 0130 00", "a@b", "1.2.3",
    "12345678901234567890", "Version 2.0.", "1 2 3", "@", "password=7602ad27cf5550de1c", "0000000000000000",
]


@pytest.mark.parametrize("size", [1, 2, 10, 1000])
def test_permutation(size):
    images = [permute(v, size, KEY, "x") for v in range(size)]
    assert sorted(images) == list(range(size))
    assert [permute(v, size, KEY, "x", undo=True) for v in images] == list(range(size))


@pytest.mark.parametrize("kind, value", VALUES)
def test_values_change_within_their_format(kind, value):
    text = f"before {value}, after"
    new, counts = pseudonymise(text, KEY)
    assert counts == {kind: 1} and new != text and value not in new
    again, counted = pseudonymise(new, KEY, undo=True)
    assert again == text and counted == counts
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    if kind != "ip":
        assert shape(new) == shape(text)


@pytest.mark.parametrize("text", LEFT)
def test_invalid_values_stay(text):
    assert pseudonymise(text, KEY) == (text, {})


def test_dates_are_permuted_within_their_shape():
    """Every day of the range in every order and style: undone, of the same widths, and linked as the days are."""
    day, last, seen = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31), set()
    while day <= last:
        y, m, d = day.year, day.month, day.day
        iso, _ = pseudonymise(f"{y}-{m:02d}-{d:02d}", KEY)
        assert iso not in seen
        seen.add(iso)
        ny, nm, nd = map(int, iso.split("-"))
        forms = {f"{d}.{m}.{y}": f"{nd}.{nm}.{ny}", f"{m}/{d}/{y}": f"{nm}/{nd}/{ny}", f"{m:02d}/{d:02d}/{y}": f"{nm:02d}/{nd:02d}/{ny}"}
        if d > 12:
            forms |= {f"{d}/{m}/{y}": f"{nd}/{nm}/{ny}", f"{d:02d}/{m:02d}/{y}": f"{nd:02d}/{nm:02d}/{ny}"}
        text, new = " ".join(forms), " ".join(forms.values())
        assert pseudonymise(text, KEY) == (new, {"date": len(forms)})
        assert pseudonymise(new, KEY, undo=True)[0] == text
        assert [len(x) for x in forms] == [len(x) for x in forms.values()]
        day += datetime.timedelta(1 if y in (1900, 2000, 2024, 2099) else 7)


def test_all_days_have_pseudonyms_of_their_own():
    days = [datetime.date.fromordinal(k) for k in range(FIRST_DAY, LAST_DAY + 1)]
    for style in ("{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}"):
        texts = [style.format(d=x.day, m=x.month, y=x.year) for x in days if style[1] == "m" or x.day > 12]
        assert len({_date(t, lambda v, size: permute(v, size, KEY, "date")) for t in texts}) == len(texts)


def test_links_and_neighbours():
    new, counts = pseudonymise("4041894974608795 10.0.0.1 +1 (988) 555-2485 4041-8949-7460-8795 a.b@c.de", KEY)
    first, *_, last, _mail = new.split(" ")
    assert first == last.replace("-", "") and luhn_digit(first[:-1]) == first[-1]
    assert counts == {"card": 2, "ip": 1, "phone": 1, "mail": 1}


@pytest.mark.parametrize("country, size", [("NO", 15), ("BE", 16), ("AT", 20), ("LU", 20), ("DE", 22), ("ES", 24), ("SE", 24), ("PL", 28)])
@pytest.mark.parametrize("behind", ["", " BIC", " 2024", " A", " AB 12", " ABCD EFGH IJ", " BE68 5390 0754 7034", ", BIC", "\n2024"])
def test_iban_before_a_short_word(country, size, behind):
    for k in range(40):
        rest = str(7**30 + k)[: size - 4].zfill(size - 4)
        plain = f"{country}{_iban_check(country, rest):02d}{rest}"
        for value in (plain, " ".join(plain[i : i + 4] for i in range(0, size, 4))):
            new, counts = pseudonymise(f"to {value}{behind}", KEY)
            want, _ = pseudonymise(f"to {value}", KEY)
            assert counts == {"iban": 1 + behind.startswith(" BE68")} and value not in new and new.startswith(want)
            assert pseudonymise(new, KEY, undo=True)[0] == f"to {value}{behind}"


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("0123456789 -./@()+abDEé\n"), max_size=60))
def test_any_text(text):
    new, counts = pseudonymise(text, KEY)
    if not counts:
        assert new == text


def planted(rng):
    """A value of some kind, valid by a rule of its own or just not, and its kind."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    kind, valid = rng.choice([k for k in KINDS if k != "mail"]), rng.random() < 0.6
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        fits = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        last = [d for d in "0123456789" if fits(body + d) == valid]
        value = body + rng.choice(last)
        value = value if rng.random() < 0.5 else "-".join(value[k : k + 4] for k in range(0, 16, 4))
    elif kind == "iban":
        rest = digits(18)
        good = [k for k in range(2, 99) if int(rest + "1314" + f"{k:02d}") % 97 == 1]
        value = f"DE{rng.choice(good if valid else [k for k in range(2, 99) if k not in good]):02d}{rest}"
    elif kind == "ip":
        value = ".".join(str(rng.randint(0, 255)) for _ in range(3)) + f".{rng.randint(0, 255) if valid else rng.randint(256, 999)}"
    elif kind == "ssn":
        value = f"{rng.randint(1, 665) if valid else rng.choice([0, 666, 900]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    elif kind == "date":
        value = f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28) if valid else rng.randint(32, 99):02d}"
    else:
        value = f"({rng.randint(200, 999) if valid else rng.randint(0, 199):03d}) {rng.randint(200, 999)}-{digits(4)}"
    return kind, value, valid


def test_planted_values_and_no_others_are_found():
    """Valid and invalid values among words: the valid ones change, all else stays, and each value has one pseudonym."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    told = {}
    for _ in range(400):
        parts, want = [word()], {}
        for _ in range(rng.randint(0, 6)):
            kind, value, valid = planted(rng)
            parts += [(kind, value, valid), word()]
            if valid:
                want[kind] = want.get(kind, 0) + 1
        text = " ".join(p if isinstance(p, str) else p[1] for p in parts)
        new, counts = pseudonymise(text, KEY)
        assert counts == want, text
        pattern = " ".join(re.escape(p if isinstance(p, str) else p[1]) if isinstance(p, str) or not p[2] else "(.+?)" for p in parts)
        found = re.fullmatch(pattern, new)
        assert found, (text, new)
        for (kind, value, _), image in zip([p for p in parts if not isinstance(p, str) and p[2]], found.groups()):
            assert told.setdefault((kind, value), image) == image and image != value
    assert {kind for kind, _ in told} == set(KINDS) - {"mail"} and len(set(told.values())) == len(told)


def test_rows(spark, data):
    schema = "doc_id long, text string, n_card string"
    rows = [(1, None, ""), (1, None, ""), (None, "", ""), (2, "x " * 100_000 + "4041894974608795", "")]
    got = pseudonyms(spark.createDataFrame(rows, schema), "k").collect()
    assert sorted((str(r.doc_id), r.text is None, r.n_card) for r in got) == [("1", True, 0)] * 2 + [("2", False, 1), ("None", False, 0)]
    assert pseudonyms(spark.createDataFrame([], schema), "k").collect() == []
    docs = table(spark, data, "documents", "doc_id", "text")
    want = {r.doc_id: pseudonymise(r.text, b"k") for r in docs.collect()}
    got = {r.doc_id: (r.text, {k: r[f"n_{k}"] for k in KINDS if r[f"n_{k}"]}) for r in pseudonyms(docs, "k").collect()}
    assert got == want and sum(len(c) for _, c in want.values()) > 5
