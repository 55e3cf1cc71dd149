"""Restoring originals: placeholders in any of their mangled forms, and synthetic values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import edited, let, quoted
from maskwright.operators.vault import first_of
from maskwright.schema import TYPES
from maskwright.scratch import materialise

_KINDS = "|".join(sorted((t[0] for t in TYPES), key=len, reverse=True))
#: A placeholder with or without brackets and separator; open sides need a word's edge.
VARIANT = rf"(?iu)(?:\[|(?<![\p{{L}}\p{{N}}_]))({_KINDS})[_ ]?([1-9][0-9]*)(?![0-9])(?:\]|(?![\p{{L}}\p{{N}}_]))"
CANONICAL = rf"\[({_KINDS})_([1-9][0-9]*)\]"


def observed(text: str) -> str:
    """SQL: the distinct canonical placeholders in a text."""
    return f"array_distinct(regexp_extract_all({text}, {quoted(CANONICAL)}, 0))"


def might_hold(text: str) -> str:
    """SQL: a cheap test that a text could hold a placeholder."""
    return f"rlike({text}, '[A-Z]{{2,}}[A-Z_]*[_ ]?[0-9]|(?i){_KINDS.lower()}')"


def canonical(match: str) -> str:
    """SQL: the canonical form of a matched variant."""
    v = quoted(VARIANT)
    return f"concat('[', upper(regexp_extract({match}, {v}, 1)), '_', regexp_extract({match}, {v}, 2), ']')"


def resolved(text: str, scope: str) -> str:
    """SQL: the text with every placeholder that the scope (map of token to original) knows restored."""
    v = quoted(VARIANT)
    parts = f"named_struct('m', regexp_extract_all({text}, {v}, 0), 'g', split({text}, {v}, -1))"
    pieces = f"transform(z.g, (g, i) -> concat(g, if(i < size(z.m), {let('z.m[i]', 'm', f'coalesce({scope}[{canonical(chr(109))}], m)')}, '')))"
    return f"if({might_hold(text)} and {scope} is not null, {let(parts, 'z', f'array_join({pieces}, {quoted(str())})')}, {text})"


def _one(scope: DataFrame, key: str) -> DataFrame:
    return scope.groupBy(key, "token").agg(F.min("original").alias("original"))


def restore(responses: DataFrame, scope: DataFrame, key: str, text: str = "text", out: str = "restored") -> DataFrame:
    """Restore texts by their key's tokens (``scope``: key, token, original); a key's tokens fit a row.

    Of several originals of a token the first in code-point order counts.
    """
    tokens = _one(scope, key).groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "original"))).alias("_scope"))
    return responses.join(tokens, key, "left").withColumn(out, F.expr(resolved(f"coalesce({text}, '')", "_scope"))).drop("_scope")


def _joined(text: str, at: int) -> bool:
    """Whether the characters on both sides of a place belong to one word."""
    word = lambda c: c == "_" or c.isalnum()
    return 0 < at < len(text) and word(text[at - 1]) and word(text[at])


def resolve_text(text: str, scope: dict[str, str], strict: frozenset[str] = frozenset()) -> str:
    """Placeholders first, tolerant of mangling; then other keys literally, longest first, as whole words.

    Keys in ``strict`` are taken literally too; a literal that overlaps an earlier match is dropped,
    and restored text is not searched again.
    """
    found = []
    tolerant = {k for k in scope if re.fullmatch(CANONICAL, k) and k not in strict}
    for m in re.finditer(rf"(\[)?({_KINDS})[_ ]?([1-9][0-9]*)(?![0-9])(\])?", text, re.I):
        key = f"[{m[2].upper()}_{m[3]}]"
        if key in tolerant and (m[1] or not _joined(text, m.start())) and (m[4] or not _joined(text, m.end())):
            found.append((m.start(), m.end(), scope[key]))
    for key in sorted((k for k in scope if k and k not in tolerant), key=len, reverse=True):
        for m in re.finditer(re.escape(key), text):
            if not (_joined(text, m.start()) or _joined(text, m.end())) and not any(m.start() < e and m.end() > s for s, e, _ in found):
                found.append((*m.span(), scope[key]))
    at, out = 0, []
    for s, e, value in sorted(found):
        out += [text[at:s], value]
        at = e
    return "".join([*out, text[at:]])


def restore_any(responses: DataFrame, scope: DataFrame, key: str, text: str = "text", out: str = "restored") -> DataFrame:
    """As ``restore``, for scopes that also hold synthetic values; in Arrow batches."""
    tokens = _one(scope, key).groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "original"))).alias("_scope"))

    @F.pandas_udf("string")
    def resolve(texts: pd.Series, scopes: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else resolve_text(t, dict(s)) for t, s in zip(texts, scopes, strict=True)])

    return responses.join(tokens, key, "left").withColumn(out, resolve(F.col(text), F.col("_scope"))).drop("_scope")


def by_map(docs: DataFrame, doc: str = "doc_id", text: str = "text", spans: str = "spans", given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts anonymized by a map of each document's own (doc, anonymized), and the maps (doc, token, original).

    The map is keyed by the exact text whatever its type: a text keeps the placeholder of the type
    that it had first. ``given`` holds maps already in use; a type's numbers go on after its largest.
    """
    flat = docs.select(doc, F.explode(spans).alias("s")).select(doc, F.col("s.text").alias("original"), F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"))
    known = given if given is not None else docs.sparkSession.createDataFrame([], f"{doc} {docs.schema[doc].dataType.simpleString()}, token string, original string")
    largest = known.select(doc, F.regexp_extract("token", CANONICAL, 1).alias("entity_type"), F.regexp_extract("token", CANONICAL, 2).cast("long").alias("n")).filter("entity_type != ''").groupBy(doc, "entity_type").agg(F.max("n").alias("given"))
    new = flat.groupBy(doc, "original").agg(F.min_by("entity_type", "start").alias("entity_type"), F.min("start").alias("start")).join(known.select(doc, "original"), [doc, "original"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(doc, "entity_type").orderBy("start"))
    token = F.concat(F.lit("["), "entity_type", F.lit("_"), (F.coalesce("given", F.lit(0)) + rank).cast("string"), F.lit("]"))
    made = new.join(largest, [doc, "entity_type"], "left").select(doc, token.alias("token"), "original")
    maps = materialise(known.select(doc, "token", "original").unionByName(made), "maps")
    # of several tokens of a text the first in code-point order
    table = maps.groupBy(doc, "original").agg(F.min("token").alias("token")).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("original", "token"))).alias("_map"))
    tokens = f"transform(array_sort({spans}, (x, y) -> x.start - y.start), s -> named_struct('start', s.start, 'end', s.end, 'value', _map[s.text]))"
    out = docs.withColumn("_body", F.coalesce(F.col(text), F.lit(""))).join(table, doc, "left")
    out = out.withColumn("_edits", F.expr(first_of(tokens, "start int, end int, value string"))).withColumn("anonymized", F.expr(edited("_body", "_edits")))
    return out.select(doc, "anonymized"), maps


def mirrored(maps: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Maps (key, token, original) with replacements chosen elsewhere: an original's former token goes."""
    return maps.join(chosen.select(key, "original"), [key, "original"], "left_anti").unionByName(chosen.select(key, "token", "original"))


def restore_twice(responses: DataFrame, maps: DataFrame, key: str, text: str = "text", out: str = "restored") -> DataFrame:
    """Canonical placeholders first, then mangled ones in what the first pass gave."""
    tokens = _one(maps, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("_scope"))
    c = quoted(CANONICAL)
    parts = f"named_struct('m', regexp_extract_all(_body, {c}, 0), 'g', split(_body, {c}, -1))"
    strict = let(parts, "z", "array_join(transform(z.g, (g, i) -> concat(g, if(i < size(z.m), coalesce(_scope[z.m[i]], z.m[i]), ''))), '')")
    df = responses.withColumn("_body", F.coalesce(F.col(text), F.lit(""))).join(tokens, key, "left")
    df = df.withColumn("_once", F.expr(f"if(_scope is null, _body, {strict})"))
    return df.withColumn(out, F.expr(resolved("_once", "_scope"))).drop("_body", "_scope", "_once")


def restore_vault(responses: DataFrame, vault: DataFrame, key: str, text: str = "text", out: str = "restored") -> DataFrame:
    """Placeholders, mangled ones, then synthetic values by their length, each pass over what the last gave.

    ``vault`` (key, placeholder, synthetic_value, original_text) holds each key's records.
    """
    maps = vault.select(key, F.col("placeholder").alias("token"), F.col("original_text").alias("original"))
    fakes = vault.filter("synthetic_value != ''").groupBy(key, "synthetic_value").agg(F.min("original_text").alias("original"))
    order = "case when char_length(a.synthetic_value) != char_length(b.synthetic_value) then char_length(b.synthetic_value) - char_length(a.synthetic_value) when a.synthetic_value < b.synthetic_value then -1 else 1 end"
    fakes = fakes.groupBy(key).agg(F.collect_list(F.struct("synthetic_value", "original")).alias("_x")).select(key, F.expr(f"array_sort(_x, (a, b) -> {order})").alias("_fakes"))
    word = "[\\\\p{L}\\\\p{N}_]"
    inner = lambda at: f"rlike(substring(f.synthetic_value, {at}, 1), '{word}')"
    # split at the value; a cut is a whole word if not both sides of an edge are word characters
    left = "if(z[i - 1] != '', substring(z[i - 1], -1, 1), if(i > 1, substring(f.synthetic_value, -1, 1), ''))"
    right = "if(g != '', substring(g, 1, 1), if(i < size(z) - 1, substring(f.synthetic_value, 1, 1), ''))"
    joined = f"(rlike({left}, '{word}') and {inner('1')} or rlike({right}, '{word}') and {inner('-1')})"
    step = let("split(t, concat('\\\\Q', f.synthetic_value, '\\\\E'), -1)", "z", f"array_join(transform(z, (g, i) -> if(i = 0, g, concat(if({joined}, f.synthetic_value, f.original), g))), '')")
    df = restore_twice(responses, maps, key, text, out).join(fakes, key, "left")
    return df.withColumn(out, F.expr(f"if(_fakes is null, {out}, aggregate(_fakes, {out}, (t, f) -> if(contains(t, f.synthetic_value), {step}, t)))")).drop("_fakes")


def reversible(text: str, scope: str, fakes: str) -> str:
    """SQL: whether a text holds a known placeholder in any form or one of an array of synthetic values."""
    v = quoted(VARIANT)
    return f"(exists(regexp_extract_all({text}, {v}, 0), m -> {scope}[{canonical('m')}] is not null) or exists({fakes}, f -> f != '' and contains({text}, f)))"


def visible(text: str, tokens: str) -> str:
    """SQL: the tokens of an array that stand in a text literally."""
    return f"filter({tokens}, t -> t != '' and contains({text}, t))"
