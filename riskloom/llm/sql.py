"""SQL of corpus queries, by methods of their own."""

from __future__ import annotations

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ALL_BITS = 0xFFFFFFFF
CRC_TABLE = f"""crc_table as (
    select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, {POLYNOMIAL} * (c & 1)))) as t
)"""


def crc32(text: str) -> str:
    """CRC-32 of a text of characters below U+0800, with ``crc_table`` at hand."""
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [192 + ord(x) // 64, 128 + ord(x) % 64] end))"
    return f"xor(list_reduce(list_prepend({ALL_BITS}, {utf8}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), {ALL_BITS})"


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""
with recursive {CRC_TABLE}, found as (
    select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as raw from documents
), runs as (
    select doc_id, {LOWER.format('raw')} as run, count(*) as k from found group by all
), marked as (
    select run, k, {crc32("coalesce(doc_id::varchar, '') || ':' || run")} as mark from runs, crc_table
), words as (
    select case when mark % 199 = 0 then left(run, mark % length(run)) || substr(run, mark % length(run) + 2) else run end as word, sum(k)::bigint as n
    from marked group by 1 having length(word) >= 6 and sum(k) >= 5
), holes as (
    select word, unnest(range(length(word))) as i, left(word, i) || substr(word, i + 2) as rest from words
), near as (
    select h.word, w.word as near from holes h join words w on h.rest = w.word
    union select w.word, h.word from holes h join words w on h.rest = w.word
    union select a.word, b.word from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word <> b.word
), ranked as (
    select p.word, p.near, w.n as near_n, count(*) over (partition by p.word) as n_near,
        row_number() over (partition by p.word order by w.n desc, p.near) as r
    from near p join words w on w.word = p.near
), told as (
    select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.near_n >= 5 * w.n then r.near end as form,
        case when r.near_n >= 5 * w.n then r.near_n end as form_n
    from words w left join ranked r on r.word = w.word and r.r = 1
), walk as (
    select word, word as at, form as further from told
    union all select w.word, t.word, t.form from walk w join told t on t.word = w.further
)
select t.word, t.form, w.at as root, t.n, t.n_near, t.form_n from told t join walk w on w.word = t.word and w.further is null
"""


def _plus(value: str, cost: str, letter: str) -> str:
    """A value is ten digits of cost and the audit, so that text order is the order of values."""
    return f"(lpad((left({value}, 10)::bigint + {cost})::varchar, 10, '0') || substr({value}, 11) || '{letter}')"


def _least(*values: str) -> str:
    return f"least({', '.join(values)})"


def _when(condition: str, value: str) -> str:
    return f"case when {condition} then {value} end"


_STAY = {
    "z": _plus("z", "2", "D"),
    "s": _least(_plus("s", "2", "D"), _when("not goes and x = 's'", _plus("z", "extra", "K"))),
    "u": _least(
        _plus("u1", "2", "D"), *[_when("not goes and x = 'u'", _plus(v, "extra", "K")) for v in ("z", "s", "a1")],
        *[_when("not goes", _plus(v, "extra + 1", "R")) for v in ("z", "s", "a1")],
    ),
    "a": _least(_plus("a1", "2", "D"), _when("not goes and x = 'a'", _plus("u1", "extra", "K")), _when("not goes", _plus("u1", "extra + 1", "R"))),
}
_INSERTED = f"select *, {_least('u', _plus('z', '5', 'I'), _plus('s', '5', 'I'), _plus('a', '5', 'I'))} as u1, {_least('a', _plus('u1', '5', 'I'))} as a1"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPAIR = f"""
with recursive {CRC_TABLE}, keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
    from conversations, crc_table
), damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
        case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when kind = 3 then [1, 2] else [1] end) as copy
    from keyed where kind <> 0
), ordered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, {_SPACES}) as core from damaged
), faulty as (
    select *, case when core = '' then 'b' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
        when right(core, 1) not in ('.', '!', '?') then 't' else '' end as fault,
        left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair
    from ordered
), steps as (
    select conv_id, i, left(role, 1) as x, fault in ('b', 'd') as goes, case when fault = 't' then 5 else 0 end as extra from faulty
), walk as (
    select distinct conv_id, 0::bigint as i, '0000000000' as z, null::varchar as s, null::varchar as u, null::varchar as a from steps
    union all
    select conv_id, n, {', '.join(f'{e} as {c}' for c, e in _STAY.items())}
    from ({_INSERTED} from (
        select w.*, f.i as n, f.x, f.goes, f.extra from walk w join steps f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
    ))
), ended as (
    select conv_id, {_least('z', 'a1')} as best from ({_INSERTED} from walk qualify row_number() over (partition by conv_id order by i desc) = 1)
), letters as (
    select conv_id, unnest(string_split(substr(best, 11), '')) as letter, unnest(range(length(best) - 10)) as j from ended where length(best) > 10
), placed as (
    select *, count(*) filter (letter <> 'I') over (partition by conv_id order by j) as i,
        count(*) filter (letter <> 'D') over (partition by conv_id order by j) as k
    from letters
), kept as (
    select p.*, f.role, f.text, bool_or(p.k = 1 and p.letter = 'K' and left(f.role, 1) = 's') over (partition by p.conv_id) as led
    from placed p left join faulty f on f.conv_id is not distinct from p.conv_id and f.i = p.i and p.letter <> 'I'
    where p.letter <> 'D'
), spelled as (
    select conv_id, sha256(string_agg(
        case when letter = 'K' then role when (k - case when led then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end
        || ':' || case when letter = 'I' then '' else text end, chr(10) order by j)) as digest
    from kept group by conv_id
), counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
        count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
        count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal
    from faulty group by conv_id
)
select o.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate,
    coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal, coalesce(left(e.best, 10)::bigint, 0) as cost,
    coalesce(substr(e.best, 11), '') as audit, coalesce(s.digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join ended e on e.conv_id is not distinct from o.conv_id
left join spelled s on s.conv_id is not distinct from o.conv_id
"""
