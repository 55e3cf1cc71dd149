"""Span arrays: regular-expression matches with offsets, checksums, context, overlap merge."""

from __future__ import annotations

from collections.abc import Callable

from maskwright.functions.text import before, islands, let, quoted, upto
from maskwright.schema import DATE_PATTERN, INNER, KEYWORDS, RECOGNIZERS, STRUCTURED, TYPES, DetectionConfig

EMPTY = f"cast(array() as array<{INNER}>)"


def matches(text: str, pattern: str, entity_type: str, score: float, source: str, seq: int) -> str:
    """Spans of all matches of a pattern that never matches the empty string."""
    return matches_of(text, quoted(pattern), quoted(entity_type), f"{score}D", quoted(source), str(seq))


def matches_of(text: str, p: str, entity_type: str, score: str, source: str, seq: str) -> str:
    """The same with SQL expressions for all arguments; the pattern may be a column.

    Matches and the gaps between them come from the same scan, so the lengths of gaps and matches
    before a match, in bytes and in characters, add up to its place.
    """
    length = lambda f: f"transform(z.m, (x, i) -> {f}(z.g[i]) + {f}(x))"
    place = lambda u, s, f: f"{upto(u, s, 'a + x')} + {f}(z.g[i])"
    at = f"named_struct('b', {place('lb', 'sb', 'octet_length')}, 'c', {place('lc', 'sc', 'char_length')}, 'x', q)"
    span = f"named_struct('start', w.b, 'end', w.b + octet_length(w.x), 'entity_type', {entity_type}, 'score', {score}, 'text', w.x, 'source', {source}, 'cs', w.c, 'ce', w.c + char_length(w.x), 'seq', {seq})"
    each = lambda places: f"transform({places}, w -> {span})"
    spans = each(f"transform(z.m, (q, i) -> {at})")
    for name, value in (("sc", before("lc", "a + x")), ("sb", before("lb", "a + x")), ("lc", length("char_length")), ("lb", length("octet_length"))):
        spans = let(value, name, spans)
    # one match needs no sums
    lone = each("array(named_struct('b', octet_length(z.g[0]), 'c', char_length(z.g[0]), 'x', z.m[0]))")
    # split compiles its pattern for every row, so only texts with matches are split
    found = let(f"named_struct('m', zm, 'g', split({text}, {p}, -1))", "z", f"if(size(zm) = 1, {lone}, {spans})")
    return let(f"regexp_extract_all({text}, {p}, 0)", "zm", f"if(size(zm) = 0, {EMPTY}, {found})")


#: By type: what the text holds wherever the type's pattern matches, and what every match begins with, both cheaper to test.
_GATES = {"EMAIL": "contains({0}, '@')", "SSN": "contains({0}, '-')", "IP_ADDRESS": "contains({0}, '.')"}
_FIRST = {"PHONE": r"(?=[+(\d])", "SSN": r"(?=\d{3}-)", "CREDIT_CARD": r"(?=\d{4})", "IP_ADDRESS": r"(?=\d)", "IBAN": r"(?=[A-Z]{2}\d{2})", "DATE": r"(?=[\dADFJMNOS])"}


def recognized(text: str, kinds: tuple[str, ...] | None = None) -> str:
    """Spans of all recognizers, or of those of some types, in their order; a phone number that is a date is none."""
    parts = []
    for i, (kind, pattern, score) in enumerate(RECOGNIZERS):
        if kinds is not None and kind not in kinds:
            continue
        part = matches(text, f"(?U){_FIRST.get(kind, '')}{pattern}", kind, score, "regex", i)
        if kind == "PHONE":
            part = f"filter({part}, s -> regexp_extract(s.text, {quoted('(?U)' + DATE_PATTERN)}, 0) != s.text)"
        gates = [_GATES[kind].format(text)] if kind in _GATES else []
        gates += ["dg"] if kind != "EMAIL" else []
        parts.append(f"if({' and '.join(gates)}, {part}, {EMPTY})")
    out = f"concat({', '.join(parts)})"
    return out if kinds == ("EMAIL",) else let(f"rlike({text}, '(?U)\\\\d')", "dg", out)


def luhn(text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9]', '')"
    return f"(length({digits}) between 13 and 19 and luhn_check({digits}))"


def iban(text: str) -> str:
    """Mod-97 with letters as 10 to 35, the first four characters moved to the end."""
    value = "if(c between '0' and '9', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    body = f"octet_length(t) between 5 and 34 and rlike(t, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]*$') and aggregate(split(concat(substring(t, 5), substring(t, 1, 4)), ''), 0L, (a, c) -> if(c = '', a, cast({value} as bigint))) = 1"
    return let(f"regexp_replace({text}, '(?U)\\\\s', '')", "t", body)


def ssn(text: str) -> str:
    """Area neither 0, 666 nor 900 and above; group and serial not 0."""
    n = [f"cast(split({text}, '-')[{i}] as int)" for i in range(3)]
    return f"(size(split({text}, '-')) = 3 and {n[0]} not in (0, 666) and {n[0]} < 900 and {n[1]} != 0 and {n[2]} != 0)"


def checked(spans: str) -> str:
    """Spans of recognizers whose checksum holds; other types and sources pass."""
    rule = f"case when s.source != 'regex' then true when s.entity_type = 'CREDIT_CARD' then {luhn('s.text')} when s.entity_type = 'IBAN' then {iban('s.text')} when s.entity_type = 'SSN' then coalesce({ssn('s.text')}, false) else true end"
    return f"filter({spans}, s -> {rule})"


#: Bytes beside a span in which its nearest tokens are looked for first.
_WINDOWS = (512, 16_384)
_TOKEN = r"(?U)[\\p{Alpha}\\p{N}\'-]"


def boosted(spans: str, text: str, config: DetectionConfig) -> str:
    """Scores raised once where a type's keyword is among the nearest tokens on either side."""
    words = "map(" + ", ".join(f"{quoted(k)}, array({', '.join(map(quoted, v))})" for k, v in KEYWORDS.items()) + ")"
    n = config.context_window + 1
    # windows in bytes on both sides of a span; the larger ones only where the smaller holds too few tokens
    head = lambda size: f"cast(substring(eb, greatest(s.start - {size} + 1, 1), least(s.start, {size})) as string)"
    tail = lambda size: f"cast(substring(eb, s.end + 1, {size}) as string)"

    def tokens(side: Callable[[str], str], left: str) -> str:
        """The side's text in the smallest window that surely holds its ``n`` nearest tokens and one more, and its tokens."""
        out = f"named_struct('x', {side(left)}, 't', regexp_extract_all({side(left)}, '{_TOKEN}+', 0))"
        for size in reversed(_WINDOWS):
            part = f"named_struct('x', {side(str(size))}, 't', regexp_extract_all({side(str(size))}, '{_TOKEN}+', 0))"
            out = let(part, f"p{size}", f"if(size(p{size}.t) > {n + 2} or {left} <= {size}, p{size}, {out})")
        return out

    # a token that crosses an edge of the span is on neither side
    # only the last character is looked at: $ would also hold before a line end, which parts tokens
    last = lambda x: f"rlike(right({x}, 1), '{_TOKEN}')"
    cut = lambda outer, inner: f"({last(outer)} and rlike(s.text, '^{_TOKEN}'))" if inner else f"({last('s.text')} and rlike({outer}, '^{_TOKEN}'))"
    before = let(tokens(head, "s.start"), "y", let(f"if({cut('y.x', True)}, slice(y.t, 1, greatest(size(y.t) - 1, 0)), y.t)", "u", f"slice(u, greatest(size(u) - {n - 1}, 1), {n})"))
    after = let(tokens(tail, "(octet_length(eb) - s.end)"), "y", f"slice(y.t, if({cut('y.x', False)}, 2, 1), {n})")
    near = " or ".join(f"exists({side}, t -> array_contains(k, lower(t)))" for side in (before, after))
    raised = f"named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'score', least(s.score + {config.context_boost}D, 1D), 'text', s.text, 'source', s.source, 'cs', s.cs, 'ce', s.ce, 'seq', s.seq)"
    each = f"transform({spans}, s -> {let(f'{words}[s.entity_type]', 'k', f'if(k is not null and ({near}), {raised}, s)')})"
    return let(f"cast({text} as binary)", "eb", each)


def precedence(span: str) -> str:
    kinds = ", ".join(map(quoted, STRUCTURED))
    return f"case when {span}.source = 'manual' then 3 when {span}.source = 'regex' and {span}.entity_type in ({kinds}) then 2 else 1 end"


#: Spans up to which a merge needs no islands.
_FEW = 8


def merged(spans: str) -> str:
    """Overlaps resolved by a fold over spans by start, then score descending.

    Each span is held against the last accepted one only, and takes its place if its precedence is
    higher or, at equal precedence, its score.
    """
    order = "case when a.start != b.start then a.start - b.start when a.score != b.score then if(a.score > b.score, -1, 1) else a.seq - b.seq end"
    better = f"({precedence('s')} > {precedence('l')} or {precedence('s')} = {precedence('l')} and s.score > l.score)"
    step = let("element_at(acc, -1)", "l", f"if(s.start < l.end and l.start < s.end, if({better}, concat(slice(acc, 1, size(acc) - 1), array(s)), acc), concat(acc, array(s)))")
    fold = lambda part: f"aggregate({part}, {EMPTY}, (acc, s) -> if(size(acc) = 0, array(s), {step}))"
    # few spans are folded at once, as islands cost more than they save
    return let(f"array_sort({spans}, (a, b) -> {order})", "m0", f"if(size(m0) <= {_FEW}, if(size(m0) < 2, m0, {fold('m0')}), {islands('m0', fold)})")


def confident(spans: str, config: DetectionConfig) -> str:
    """Spans at their source's least score: NER spans also need their type's."""
    least = "map(" + ", ".join(f"{quoted(t[0])}, {t[4]}D" for t in TYPES) + ")"
    return f"filter({spans}, s -> s.score >= if(s.source = 'ner', greatest({config.min_confidence}D, {least}[s.entity_type]), {config.min_confidence}D))"


def external(spans: str, text: str) -> str:
    """Valid NER spans of a column of ``SPAN``: whole characters inside the text, scores from 0 to 1; re-sliced."""
    b = f"encode({text}, 'utf-8')"
    edge = lambda o: f"(s.{o} = octet_length({text}) or substring(hex(substring({b}, s.{o} + 1, 1)), 1, 1) not in ('8', '9', 'A', 'B'))"
    good = f"s.source = 'ner' and s.start >= 0 and s.start < s.end and s.end <= octet_length({text}) and {edge('start')} and {edge('end')} and not isnan(s.score) and s.score between 0 and 1"
    slice_ = f"decode(substring({b}, s.start + 1, s.end - s.start), 'utf-8')"
    cs = f"char_length(decode(substring({b}, 1, s.start), 'utf-8'))"
    span = f"named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'score', s.score, 'text', {slice_}, 'source', s.source, 'cs', {cs}, 'ce', {cs} + char_length({slice_}), 'seq', 100 + i)"
    return f"transform(filter({spans}, s -> {good}), (s, i) -> {span})"
