"""DuckDB SQL for the operators that SQL can express on whole tables.

The statements share nothing with the operators: the checksum is worked out bit by bit, the repair is a recursive query
over all cheapest edit strings, and near words are found by deleting letters instead of by comparing prefixes.
"""

from __future__ import annotations


def _crc32(bytes_: str) -> str:
    """The unsigned crc32 of a list of byte values: eight steps a byte, the first of which takes the byte in."""
    step = "xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform({bytes_}, lambda x: "
            f"[x::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: {step}), 4294967295::bigint)")


def _plus(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', " \
           f"'r': {state}.r || {line}}} end"


def _least(*states: str) -> str:
    return f"list_sort(list_filter([{', '.join(states)}], lambda x: x is not null))[1]"


USER, ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_OWN = "chr(10) || role || ':' || text"

OP12 = f"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           {_crc32("list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || "
                   "coalesce(turn::varchar, ' '), ''), lambda x: ascii(x))")} % 20 as code
    from conversations),
damaged as (
    select conv_id, turn, case when code = 4 then 'user' else role end as role,
           case when code = 1 then '' when code = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from keyed, unnest(case when code = 0 then []::int[] when code = 3 then [1, 2] else [1] end) as copies(copy)),
ordered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
judged as (
    select *, left(role, 1) as ini,
           case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b'
                when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
                when regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then '' else 't' end as kind,
           lag(left(role, 1)) over (partition by conv_id order by i) as before
    from ordered),
stats as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
           count(*) filter (where kind = 'b') as blank, count(*) filter (where kind = 'd') as duplicate,
           count(*) filter (where kind = 't') as truncated,
           count(*) filter (where before is not null and before || ini not in ('su', 'ua', 'au')) as illegal,
           count(*) as n
    from judged group by conv_id),
walk as (
    select conv_id, n, 0::bigint as i, {{'c': 0::bigint, 'a': '', 'r': ''}} as s0,
           null::struct(c bigint, a varchar, r varchar) as s1, null::struct(c bigint, a varchar, r varchar) as s2,
           null::struct(c bigint, a varchar, r varchar) as s3
    from stats
    union all
    select conv_id, n, i, {_least(_plus('t0', '3', 'D'))} as s0,
           {_least(_plus('t1', '3', 'D'), f"case when free and ini = 's' then {_plus('t0', 'more', 'K', _OWN)} end")} as s1,
           {_least(_plus('t2', '3', 'D'), *(f"case when free and ini = 'u' then {_plus(s, 'more', 'K', _OWN)} end"
                                            for s in ('t0', 't1', 't3')),
                   *(f"case when free then {_plus(s, '2 + more', 'R', f'{USER} || text')} end"
                     for s in ('t0', 't1', 't3')))} as s2,
           {_least(_plus('t3', '3', 'D'), f"case when free and ini = 'a' then {_plus('t2', 'more', 'K', _OWN)} end",
                   f"case when free then {_plus('t2', '2 + more', 'R', f'{ASSISTANT} || text')} end")} as s3
    from (select x.conv_id, x.n, j.i, x.s0 as t0, x.s1 as t1, x.t2,
                 {_least('x.s3', _plus('x.t2', '2', 'I', ASSISTANT))} as t3, j.role, j.text, j.ini,
                 j.kind not in ('b', 'd') as free, case when j.kind = 't' then 1 else 0 end as more
          from (select *, {_least('s2', *(_plus(s, '2', 'I', USER) for s in ('s0', 's1', 's3')))} as t2 from walk) x
          join judged j on j.conv_id is not distinct from x.conv_id and j.i = x.i + 1)),
done as (
    select conv_id, {_least('s0', 's3', _plus('t2', '2', 'I', ASSISTANT))} as best
    from (select *, {_least('s2', *(_plus(s, '2', 'I', USER) for s in ('s0', 's1', 's3')))} as t2
          from walk where i = n))
select o.conv_id, coalesce(s.gaps, 0)::bigint as gaps, coalesce(s.blank, 0)::bigint as blank,
       coalesce(s.duplicate, 0)::bigint as duplicate, coalesce(s.truncated, 0)::bigint as truncated,
       coalesce(s.illegal, 0)::bigint as illegal, coalesce(d.best.c, 0)::bigint as cost,
       coalesce(d.best.a, '') as audit, sha256(coalesce(substr(d.best.r, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join stats s on s.conv_id is not distinct from o.conv_id
left join done d on d.conv_id is not distinct from o.conv_id
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP13 = f"""
with runs as (
    select coalesce(doc_id::varchar, '') as id,
           translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_UPPER.lower()}') as run
    from documents),
counted as (select id, run, count(*) as n from runs where length(run) >= 7 group by all),
hashed as (
    select run, n, {_crc32("flatten(list_transform(string_split(id || ':' || run, ''), lambda x: "
                           "case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end))")} as h
    from counted),
lost as (
    select n, case when h % 31 = 0
                   then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word
    from hashed),
words as (select word, sum(n)::bigint as n from lost where length(word) >= 7 group by word having sum(n) >= 2),
cuts as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest
         from words, unnest(range(1, length(word) + 1)) as t(i)),
pairs as (
    select a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union
    select a.word, b.word, b.n from cuts a join words b on a.rest = b.word
    union
    select b.word, a.word, a.n from cuts a join words b on a.rest = b.word),
best as (
    select word, count(*) as n_near, list_sort(list({{'k': -n, 'w': other}}))[1] as top from pairs group by word),
linked as (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when -b.top.k >= 10 * w.n then b.top.w end as form,
           case when -b.top.k >= 10 * w.n then -b.top.k end as form_n
    from words w left join best b using (word)),
hops as (
    select word, word as root, form, 0 as k from linked
    union all
    select h.word, l.word, l.form, h.k + 1 from hops h join linked l on h.form = l.word)
select l.word, l.form, h.root, l.n, l.n_near::bigint as n_near, l.form_n::bigint as form_n
from linked l join hops h on h.word = l.word and h.form is null
""".replace("with runs", "with recursive runs", 1)

ORACLE_SQL: dict[str, str] = {"op12_conversation_repair": OP12, "op13_spelling_variants": OP13}
