"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from maskwright.schema import KEYWORDS, RECOGNIZERS, STRUCTURED, TYPES, DATE_PATTERN, DetectionConfig
from maskwright.operators.vault import DOMAINS, POOLS

CONFIG = DetectionConfig()
DERIVED = """
    derived as (select c_custkey as doc_id, case c_custkey % 4
        when 0 then 'ssn ' || lpad(cast(c_custkey * 7919 % 1000 as varchar), 3, '0') || '-' || lpad(cast(c_custkey * 104729 % 100 as varchar), 2, '0') || '-' || lpad(cast(c_custkey * 1299709 % 10000 as varchar), 4, '0') || ' of client ' || c_name
        when 1 then 'Zahlung an DE' || lpad(cast(98 - (cast(c_custkey as hugeint) * 1000000 + 131400) % 97 + c_custkey % 3 as varchar), 2, '0') || lpad(cast(c_custkey as varchar), 18, '0') || ' per bank transfer'
        when 2 then 'card 4' || lpad(cast(c_custkey * 7919 % 1000 as varchar), 3, '0') || ' ' || lpad(cast(c_custkey * 104729 % 10000 as varchar), 4, '0') || ' ' || lpad(cast(c_custkey * 611953 % 10000 as varchar), 4, '0') || ' ' || lpad(cast(c_custkey * 1299709 % 10000 as varchar), 4, '0') || ', phone ' || '+1-212-555-' || lpad(cast(c_custkey % 10000 as varchar), 4, '0')
        else 'Größe: reach me at user' || c_custkey || '@mail.example.org or ' || '+1-212-555-' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') || ' since March ' || (1 + c_custkey % 28) || ', 2021' end as text from customer)"""


def _list(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def raw(table: str = "documents", name: str = "raw") -> str:
    """CTEs of all recognizers' spans of a table (doc_id, text): bytes, characters and order."""
    parts = []
    for seq, (kind, pattern, score) in enumerate(RECOGNIZERS):
        parts.append(f"select doc_id, {seq} as seq, i, '{kind}' as entity_type, cast({score} as double) as score, m, g, body from (select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{pattern}') as m, string_split_regex(coalesce(text, ''), '{pattern}') as g from {table}) t, unnest(range(1, len(m) + 1)) as u(i)")
    at = lambda f: f"coalesce(list_sum(list_transform(g[1:i], lambda x: {f}(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: {f}(x))), 0)"
    return f"""
    {name}_all as ({' union all '.join(parts)}),
    {name} as (select doc_id, seq, i, entity_type, score, m[i] as text, cast({at('strlen')} as integer) as start, cast({at('strlen')} + strlen(m[i]) as integer) as "end",
        cast({at('length')} as bigint) as cs, body from {name}_all where not (entity_type = 'PHONE' and regexp_extract(m[i], '{DATE_PATTERN}') = m[i]))"""


IBAN = "list_reduce(list_prepend(0, list_transform(string_split(substr(t, 5) || substr(t, 1, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)), lambda a, v: case when v > 9 then (a * 100 + v) % 97 else (a * 10 + v) % 97 end) = 1".replace("(t", "(regexp_replace(text, '\\s', '', 'g')").replace("substr(t,", "substr(regexp_replace(text, '\\s', '', 'g'),")
LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda p: case when (length(d) - p) % 2 = 1 then (cast(substr(d, p, 1) as integer) * 2) % 10 + (cast(substr(d, p, 1) as integer) * 2) // 10 else cast(substr(d, p, 1) as integer) end)) % 10 = 0".replace("(d)", "(regexp_replace(text, '[^0-9]', '', 'g'))").replace("substr(d,", "substr(regexp_replace(text, '[^0-9]', '', 'g'),")
CHECK = f"""case entity_type when 'CREDIT_CARD' then {LUHN} when 'IBAN' then {IBAN}
    when 'SSN' then cast(string_split(text, '-')[1] as integer) not in (0, 666) and cast(string_split(text, '-')[1] as integer) < 900 and cast(string_split(text, '-')[2] as integer) != 0 and cast(string_split(text, '-')[3] as integer) != 0
    else true end"""


def detected(table: str = "documents") -> str:
    """CTEs ending in det: the detected spans (doc_id, span_idx, start, end, entity_type, score, text, source)."""
    n, tok = CONFIG.context_window + 1, r"[\pL\pN''-]"
    words = " ".join(f"when '{k}' then {_list(v)}" for k, v in KEYWORDS.items())
    prec = f"case when entity_type in ({', '.join(repr(x) for x in STRUCTURED)}) then 2 else 1 end"
    return f"""{raw(table)},
    ok as (select * from raw where {CHECK}),
    tok as (select *, regexp_extract_all(substr(body, 1, cs), '{tok}+') as b, regexp_extract_all(substr(body, cs + length(text) + 1), '{tok}+') as a,
        regexp_matches(substr(body, 1, cs), '{tok}$') and regexp_matches(text, '^{tok}') as bx, regexp_matches(substr(body, cs + length(text) + 1), '^{tok}') and regexp_matches(text, '{tok}$') as ax,
        case entity_type {words} else [] end as kw from ok),
    near as (select *, list_concat((case when bx then b[1:len(b)-1] else b end)[-{n}:], (case when ax then a[2:] else a end)[1:{n}]) as near from tok),
    boost as (select doc_id, seq, i, start, "end", entity_type, text, case when list_has_any(kw, list_transform(near, lambda x: lower(x))) then least(score + {CONFIG.context_boost}, 1.0) else score end as score from near),
    ordered as (select *, {prec} as prec, row_number() over (partition by doc_id order by start, score desc, seq, i) as rn from boost),
    fold as (select doc_id, rn, rn as win, 1 as grp from ordered where rn = 1
        union all select f.doc_id, o.rn, case when o.start < w."end" and w.start < o."end" and not (o.prec > w.prec or o.prec = w.prec and o.score > w.score) then f.win else o.rn end,
            case when o.start < w."end" and w.start < o."end" then f.grp else f.grp + 1 end
        from fold f join ordered o on o.doc_id = f.doc_id and o.rn = f.rn + 1 join ordered w on w.doc_id = f.doc_id and w.rn = f.win),
    winners as (select doc_id, grp, arg_max(win, rn) as win from fold group by doc_id, grp),
    det as (select o.doc_id, cast(row_number() over (partition by o.doc_id order by o.start) - 1 as integer) as span_idx, o.start, o."end", o.entity_type, o.score, o.text, 'regex' as source
        from winners w join ordered o on o.doc_id = w.doc_id and o.rn = w.win where o.score >= {CONFIG.min_confidence})"""


def key(column: str) -> str:
    return f"lower(regexp_replace(regexp_replace({column}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def _pool(values: tuple[str, ...], index: str) -> str:
    base = f"{_list(values)}[cast({index} % {len(values)} as bigint) + 1]"
    return f"case when {index} < {len(values)} then {base} else {base} || case when regexp_matches({base}, '^[0-9\\s+()-]+$') then '-' else ' ' end || cast({index} // {len(values)} + 1 as varchar) end"


def synthetic(kind: str, index: str) -> str:
    local = f"regexp_replace(regexp_replace(lower({_pool(POOLS['PERSON'], index)}), '[^a-z0-9]+', '.', 'g'), '^[.]+|[.]+$', '', 'g')"
    cases = " ".join(f"when '{k}' then {_pool(v, index)}" for k, v in POOLS.items())
    return f"coalesce(case {kind} when 'EMAIL' then {local} || '@' || {_list(DOMAINS)}[cast({index} % {len(DOMAINS)} as bigint) + 1] {cases} end, '')"


VAULT = f"""
    ident as (select entity_type, {key('text')} as normalized_key, arg_min(text, doc_id * 10000000 + start) as original_text, min(doc_id * 10000000 + start) as w, count(*) as usage_count from det group by all),
    vault as (select entity_type, normalized_key, original_text, w // 10000000 as first_doc, cast(w % 10000000 as integer) as first_start, usage_count, n,
        '[' || entity_type || '_' || n || ']' as placeholder, {synthetic('entity_type', '(n - 1)')} as synthetic_value
        from (select *, row_number() over (partition by entity_type order by w) as n from ident))"""


def replaced(value: str) -> str:
    """CTE anon: documents with their spans replaced by an expression over a vault row."""
    return f"""
    pieces as (select d.doc_id, d.span_idx, d.start, d."end", coalesce(lag(d."end") over (partition by d.doc_id order by d.start), 0) as before, {value} as value, x.text as body
        from det d join vault v on v.entity_type = d.entity_type and v.normalized_key = {key('d.text')} join documents x on x.doc_id = d.doc_id),
    joined as (select doc_id, any_value(body) as body, max("end") as last, count(*) as n, string_agg(decode(encode(body)[before + 1:start]) || value, '' order by start) as head from pieces group by doc_id),
    anon as (select d.doc_id, coalesce(j.head || decode(encode(j.body)[j.last + 1:]), d.text, '') as anonymized, cast(coalesce(j.n, 0) as integer) as n_spans from documents d left join joined j using (doc_id))"""


def groups_on() -> str:
    return ", ".join(f"'{t[0]}'" for t in TYPES if t[1] != "Low-signal")
