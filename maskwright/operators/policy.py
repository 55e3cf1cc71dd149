"""Review policy over detected spans: groups, sensitivity, allow and block lists, code regions.

Lists and settings are small and belong to the plan as literals; spans stay arrays in their row,
so a whole policy is one narrow stage.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import EMPTY, matches
from maskwright.functions.text import let, quoted
from maskwright.schema import GROUP_OF, GROUPS_ON, TYPES, Sensitivity


def group_filter(spans: str, enabled: dict[str, bool] | None = None) -> str:
    """Spans whose type's group is on; a type without a group goes."""
    on = GROUPS_ON | (enabled or {})
    kinds = ", ".join(quoted(t) for t, g in GROUP_OF.items() if on[g])
    return f"filter({spans}, s -> s.entity_type in ({kinds}))" if kinds else EMPTY


def threshold_filter(spans: str, sensitivity: Sensitivity = Sensitivity(), adaptive: dict[str, float] | None = None) -> str:
    """Spans at their type's least score: the adaptive one if there is one, else the slider's."""
    least = {t[0]: (adaptive or {}).get(t[0], sensitivity.threshold(t[0])) for t in TYPES}
    table = "map(" + ", ".join(f"{quoted(k)}, {v!r}D" for k, v in least.items()) + ")"
    return f"filter({spans}, s -> s.score >= {table}[s.entity_type])"


def slider_filter(spans: str, slider: str) -> str:
    """Spans at their type's least score for a slider position that is a column: high - position * (high - low)."""
    edge = lambda f: "map(" + ", ".join(f"{quoted(t[0])}, {f(t)!r}D" for t in TYPES) + ")"
    low, high = edge(lambda t: max(0.0, t[2] - t[3])), edge(lambda t: min(1.0, t[2] + t[3]))
    return f"filter({spans}, s -> s.score >= {high}[s.entity_type] - {slider} * ({high}[s.entity_type] - {low}[s.entity_type]))"


def _word(pattern: str) -> str:
    """A list pattern as an expression: ``*`` is a run of ASCII word characters."""
    return "(?iu:" + "[A-Za-z0-9_]+".join(re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", p) for p in pattern.split("*")) + ")"


#: Letters outside ASCII that match ASCII ones where case is apart.
_ALSO = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def _gate(text: str, pattern: str) -> str:
    """SQL: a cheap test that holds wherever a list pattern matches: its longest ASCII piece is there."""
    piece = max(re.findall(r"[!-)+-~ ]+", pattern.lower()) or [""], key=len)
    if not piece:
        return "true"
    also = sorted({c for x in piece for c in _ALSO.get(x, "")})
    return f"({' or '.join([f'contains(lower({text}), {quoted(piece)})', *(f'contains({text}, {quoted(c)})' for c in also)])})"


def pattern_spans(text: str, pattern: str, entity_type: str = "MISC", seq: int = 0) -> str:
    """Whole-word matches of a list pattern as manual spans of score 1."""
    word = _word(pattern)
    if re.match(r"[A-Za-z0-9_*]", pattern):
        # the character before is never part of the match before, as a character of a word cannot follow that
        out = matches(text, rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", entity_type, 1.0, "manual", seq)
    else:
        found = matches(text, rf"(?:^|[^A-Za-z0-9_]){word}(?=\z|[^A-Za-z0-9_])", entity_type, 1.0, "manual", seq)
        # the character before the word belongs to the match, save at the start of the text
        lead = f"if(s.cs = 0 and rlike(s.text, {quoted('^' + word + chr(92) + 'z')}), 0, 1)"
        cut = f"named_struct('start', s.start + octet_length(substring(s.text, 1, l)), 'end', s.end, 'entity_type', s.entity_type, 'score', s.score, 'text', substring(s.text, l + 1), 'source', s.source, 'cs', s.cs + l, 'ce', s.ce, 'seq', s.seq)"
        out = f"transform({found}, s -> {let(lead, 'l', cut)})"
    return f"if({_gate(text, pattern)}, {out}, {EMPTY})"


def allow(spans: str, text: str, allowlist: list[str]) -> str:
    """Spans that are no allowlisted text themselves and lie in no allowlisted stretch of the text."""
    if not allowlist:
        return spans
    own = " or ".join(f"rlike(s.text, {quoted('^' + _word(p) + chr(92) + 'z')})" for p in allowlist)
    ranges = f"concat({', '.join(pattern_spans(text, p) for p in allowlist)})"
    kept = let(ranges, "r", f"filter(s0, s -> not ({own}) and not exists(r, x -> x.start <= s.start and x.end >= s.end))")
    return let(spans, "s0", f"if(size(s0) = 0, s0, {kept})")


def block(spans: str, text: str, blocklist: list[tuple[str, str]]) -> str:
    """Spans and, for each (pattern, scope), a manual span per match that has no span of its bounds yet."""
    for i, (pattern, scope) in enumerate(blocklist):
        new = pattern_spans(text, pattern, "MISC" if scope == "any" else scope, 1000 + i)
        spans = let(spans, f"b{i}", f"concat(b{i}, filter({new}, n -> not exists(b{i}, x -> x.start = n.start and x.end = n.end)))")
    return spans


def code_regions(text: str) -> str:
    """Fenced blocks, an unclosed one to the end, then HTML code and pre elements: array of (start, end) characters."""
    region = "array<struct<start:int,end:int>>"
    n = "char_length(regexp_extract(l, '^(`{3,})', 1))"
    bare = f"trim(regexp_replace(l, '^`+', '')) = ''"
    here = "named_struct('at', a.at + char_length(l) + 1, 'open', {0}, 'ticks', {1}, 'out', {2})"
    opened = here.format("a.at", "n", "a.out")
    closed = here.format("-1", "0", "concat(a.out, array(named_struct('start', a.open, 'end', a.at + char_length(l))))")
    same = here.format("a.open", "a.ticks", "a.out")
    step = let(n, "n", f"if(n = 0, {same}, if(a.open = -1, {opened}, if(n >= a.ticks and {bare}, {closed}, {same})))")
    end = f"if(a.open = -1, a.out, concat(a.out, array(named_struct('start', a.open, 'end', char_length({text})))))"
    fences = f"aggregate(split({text}, '\\n', -1), named_struct('at', 0, 'open', -1, 'ticks', 0, 'out', cast(array() as {region})), (a, l) -> {step}, a -> {end})"
    html = matches(text, r"(?is)<(code|pre)(?:\s[^>]*)?>.*?</\1>", "MISC", 1.0, "regex", 0)
    return f"concat({fences}, transform({html}, s -> named_struct('start', s.cs, 'end', s.ce)))"


def review(df: DataFrame, text: str = "text", spans: str = "spans", enabled: dict[str, bool] | None = None, sensitivity: Sensitivity = Sensitivity(), adaptive: dict[str, float] | None = None, allowlist: list[str] | None = None, blocklist: list[tuple[str, str]] | None = None, code: bool = False) -> DataFrame:
    """Groups, allowlist, thresholds, then blocklist; with ``code`` spans that start in code are marked.

    The blocklist comes last, so its spans survive a group that is off.
    """
    body = f"coalesce({text}, '')"
    kept = threshold_filter(allow(group_filter(spans, enabled), body, allowlist or []), sensitivity, adaptive)
    df = df.withColumn(spans, F.expr(block(kept, body, blocklist or [])))
    if code:
        df = df.withColumn("in_code", F.expr(let(code_regions(body), "r", f"transform({spans}, s -> exists(r, x -> x.start <= s.cs and s.cs < x.end))")))
    return df
