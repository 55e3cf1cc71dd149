"""Text and offset expressions (SQL strings over a column expression)."""

from __future__ import annotations

from collections.abc import Callable

#: White space as scripts see it: the Unicode blanks, NBSP and the byte order mark.
BLANK = r"[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Items of an array that are added up, or compared, at once.
BLOCK = 64


def before(items: str, step: str) -> str:
    """SQL of an array: for each block of ``items``, whole numbers, what ``step`` makes of all in the blocks before it.

    ``step`` takes ``a``, 0 at first, and an item ``x``. Spark copies a fold's state at every step, so
    states stay small and results come from ``transform``.
    """
    of = f"transform(sequence(0, (size({items}) - 1) div {BLOCK}), k -> aggregate(slice({items}, k * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> {step}))"
    return let(of, "t", f"transform(t, (y, k) -> aggregate(slice(t, 1, k), 0, (a, x) -> {step}))")


def upto(items: str, sums: str, step: str) -> str:
    """SQL: what ``step`` makes of all items before the one at ``i``; ``sums`` come from ``before``."""
    return f"aggregate(slice({items}, i - i % {BLOCK} + 1, i % {BLOCK}), {sums}[i div {BLOCK}], (a, x) -> {step})"


def islands(spans: str, fold: Callable[[str], str], apart: int = 0) -> str:
    """SQL: a fold done island by island over spans by start; nothing in an island overlaps what lies outside.

    An island begins where no span before reaches, or with ``apart`` where all before end further away
    than that; the furthest end so far is kept by blocks.
    """
    most = "greatest(a, x)"
    far = f"m[i].start > {upto('e', 'f', most)} + {apart}" if apart else f"m[i].start >= {upto('e', 'f', most)}"
    starts = f"filter(sequence(0, size(m) - 1), i -> i = 0 or {far})"
    each = f"flatten(transform(h, (p, k) -> {fold('slice(m, p + 1, coalesce(get(h, k + 1), size(m)) - p)')}))"
    return let(spans, "m", f"if(size(m) < 2, m, {let('transform(m, s -> s.end)', 'e', let(before('e', most), 'f', let(starts, 'h', each)))})")


def edited(body: str, edits: str) -> str:
    """SQL: a text with edits (start and end in bytes, value), which are in order and do not overlap.

    The pieces between edits are cut out of the bytes, where a place is found without counting.
    """
    bytes_ = f"cast({body} as binary)"
    before = "if(i = 0, 0, e[i - 1].end)"
    # each edit gives the piece before it and its value
    parts = f"transform(e, (x, i) -> concat(cast(substring(b, {before} + 1, x.start - {before}) as string), x.value))"
    last = "cast(substring(b, element_at(e, -1).end + 1, octet_length(b)) as string)"
    return let(edits, "e", f"if(coalesce(size(e), 0) <= 0, {body}, {let(bytes_, 'b', f'concat(array_join({parts}, {quoted(str())}), {last})')})")


def char_to_byte(text: str, index: str) -> str:
    return f"octet_length(substring({text}, 1, {index}))"


def byte_to_char(text: str, offset: str) -> str:
    """Character index of a byte offset; an offset inside a character rounds up."""
    head = f"substring(encode({text}, 'utf-8'), 1, {offset})"
    # continuation bytes do not start a character
    return f"cast(length(regexp_replace(hex({head}), '([0-7C-F][0-9A-F])|([89AB][0-9A-F])', '$1')) / 2 as int)"


def byte_slice(text: str, start: str, end: str) -> str:
    return f"decode(substring(encode({text}, 'utf-8'), {start} + 1, {end} - {start}), 'utf-8')"


def normalized_key(text: str) -> str:
    """Trimmed, white space collapsed, lower case."""
    return f"lower(regexp_replace(regexp_replace({text}, '^{BLANK}+|{BLANK}+$', ''), '{BLANK}+', ' '))"


def utf16_length(text: str) -> str:
    return f"cast(octet_length(encode({text}, 'UTF-16BE')) / 2 as int)"


def length_bucket(text: str) -> str:
    return f"case when {utf16_length(text)} <= 120 then 'short' when {utf16_length(text)} <= 260 then 'medium' else 'long' end"


def conversation_url(url: str) -> str:
    """The URL without query and fragment."""
    return f"substring_index(substring_index({url}, '#', 1), '?', 1)"


def ner_label(label: str) -> str:
    """A model's label without its B-/I- mark, camel case split, upper snake case."""
    bare = f"regexp_replace({label}, '^[BI]-', '')"
    return f"upper(regexp_replace(regexp_replace({bare}, '([a-z0-9])([A-Z])', '$1_$2'), '[\\\\s-]+', '_'))"


def tidy(text: str) -> str:
    """Blanks before line ends dropped, three or more line ends made two, trimmed."""
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '[ \\\\t]+\\n', '\\n'), '\\n{{3,}}', '\\n\\n'), '^{BLANK}+|{BLANK}+$', '')"
