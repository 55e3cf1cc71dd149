"""NER candidates: chunking, a dictionary provider, placing chunk spans, merging by type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import EMPTY, matches
from maskwright.functions.text import BLANK, islands, let, quoted
from maskwright.schema import SPAN

# The dictionary provider's entities with type and score.
ENTITIES = (
    ("Ada Lovelace", "PERSON", 0.92),
    ("David Smith", "PERSON", 0.92),
    ("Anna Müller", "PERSON", 0.92),
    ("Acme Corp", "ORGANIZATION", 0.90),
    ("Beispiel GmbH", "ORGANIZATION", 0.90),
    ("Berlin", "LOCATION", 0.88),
    ("München", "LOCATION", 0.88),
    ("42 Cedar St", "ADDRESS", 0.91),
    ("https://portal.example/private", "URL", 0.94),
    ("alice_admin", "USERNAME", 0.89),
    ("correct-horse", "PASSWORD", 0.87),
    ("1234567890", "BANK_ACCOUNT", 0.86),
)


def dictionary_spans(text: str) -> str:
    """SQL: spans of the dictionary's entities, by start."""
    parts = []
    for i, (t, kind, score) in enumerate(ENTITIES):
        found = matches(text, rf"\Q{t}\E", kind, score, "ner", 100 + i)
        parts.append(f"if(contains({text}, {quoted(t)}), {found}, {EMPTY})")
    return f"array_sort(concat({', '.join(parts)}), (a, b) -> if(a.start != b.start, a.start - b.start, a.seq - b.seq))"


def outer(spans: str) -> str:
    """SQL: spans without the fields that only operators use."""
    return f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'score', s.score, 'text', s.text, 'source', s.source))"


def bounds(text: str, size: int = 5000, overlap: int = 256) -> str:
    """SQL: (start, end) of chunks of at most ``size`` characters.

    A chunk ends behind the last white space of its last 40 %, or at its full length where there is
    none; the next begins ``overlap`` characters before that end.
    """
    overlap, least = min(overlap, max(0, size - 1)), max(1, int(size * 0.6))
    kind = "array<struct<start:int,end:int>>"
    # up to the last white space of the part where a chunk may end
    inside = f"char_length(regexp_extract(substring({text}, x.at + {least} + 1, {size - least}), '(?s)^.*{BLANK}', 0))"
    end = f"if(x.at + {size} >= n, n, {let(inside, 'w', f'x.at + if(w > 0, {least} + w, {size})')})"
    step = let(end, "z", f"named_struct('at', if(z >= n, -1, greatest(x.at + 1, z - {overlap})), 'out', concat(x.out, array(named_struct('start', x.at, 'end', z))))")
    turns = f"sequence(0, n div {max(1, least - overlap)})"
    fold = f"aggregate({turns}, named_struct('at', if(n = 0, -1, 0), 'out', cast(array() as {kind})), (x, turn_) -> if(x.at < 0, x, {step}), x -> x.out)"
    return let(f"char_length({text})", "n", fold)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5000, overlap: int = 256) -> DataFrame:
    """key, chunk, text, and its start and end in characters and bytes: a row per chunk, for parallel inference."""
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = body.select(key, "_t", F.posexplode(F.expr(bounds("_t", size, overlap))).alias("chunk", "b"))
    part = rows.select(key, "chunk", F.expr("substring(_t, b.start + 1, b.end - b.start)").alias("text"), F.col("b.start").alias("start_char"), F.col("b.end").alias("end_char"), F.expr("octet_length(substring(_t, 1, b.start))").alias("start_byte"))
    return part.withColumn("end_byte", F.col("start_byte") + F.octet_length("text"))


def merged_by_type(spans: str) -> str:
    """SQL: of overlapping spans of a type the better one, by a sweep over starts and ends.

    Better is the higher score, then the longer, the earlier start, the earlier end.
    """
    order = "case when a.start != b.start then a.start - b.start else a.end - b.end end"
    better = "case when s.score != l.score then s.score > l.score when s.end - s.start != l.end - l.start then s.end - s.start > l.end - l.start when s.start != l.start then s.start < l.start else s.end < l.end end"
    none = f"cast(array() as array<{SPAN}>)"
    step = let("element_at(acc, -1)", "l", f"if(s.start < l.end and l.start < s.end, concat(slice(acc, 1, size(acc) - 1), array(if({better}, s, l))), concat(acc, array(s)))")
    one = islands("filter(o, s -> s.entity_type = ty)", lambda part: f"aggregate({part}, {none}, (acc, s) -> if(size(acc) = 0, array(s), {step}))")
    fold = let(f"array_sort({spans}, (a, b) -> {order})", "o", f"flatten(transform(array_distinct(transform(o, s -> s.entity_type)), ty -> {one}))")
    return f"array_sort({fold}, (a, b) -> if(a.start != b.start, a.start - b.start, a.end - b.end))"


def provide(docs: DataFrame, spans_of: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", size: int = 5000) -> DataFrame:
    """Add ``ner``: a provider's spans of every chunk, at their place in the document, merged by type.

    ``spans_of`` adds a column ``found`` (array of spans in bytes of the chunk) to rows with a text. Texts
    of one chunk are given to it as they are; only the spans of longer ones are brought together by key.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    long = f"char_length(coalesce({text}, '')) > {size}"
    short = docs.filter(f"not ({long})")
    one = spans_of(short.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    out = one.withColumn("ner", F.when(F.size("found") > 0, F.expr(merged_by_type("found"))).otherwise(none)).select("_row.*", "ner")
    docs = docs.filter(long)
    part = spans_of(chunks(docs, key, text, size))
    moved = "transform(found, s -> named_struct('start', s.start + start_byte, 'end', s.end + start_byte, 'entity_type', s.entity_type, 'score', s.score, 'text', s.text, 'source', s.source))"
    whole = part.filter("size(found) > 0").groupBy(F.col(key).alias("_key")).agg(F.flatten(F.collect_list(F.expr(moved))).alias("ner"))
    whole = whole.withColumn("ner", F.expr(merged_by_type("ner")))
    return out.unionByName(docs.join(whole, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("ner", F.coalesce("ner", none)))


def dictionary(docs: DataFrame) -> DataFrame:
    """The dictionary provider, for ``provide``."""
    return docs.withColumn("found", F.expr(outer(dictionary_spans("text"))))


_INNER_CHAR = r"[\\p{L}\\p{N}_]"


def token_spans(text: str, predictions: str) -> str:
    """SQL: spans of token predictions, an array of (start, end, entity_type, score) in characters.

    Neighbours of a type join over at most three characters of blanks or ``._@:/+-``; a span grows
    to whole words; its score is the mean of the scores that open its words.
    """
    order = "if(a.start != b.start, a.start - b.start, a.end - b.end)"
    kind = "array<struct<start:int,end:int,entity_type:string,scores:array<double>>>"
    new = "named_struct('start', p.start, 'end', p.end, 'entity_type', p.entity_type, 'scores', array(p.score))"
    gap = f"if(p.start >= l.end, substring({text}, l.end + 1, p.start - l.end), '')"
    grown = "named_struct('start', l.start, 'end', greatest(l.end, p.end), 'entity_type', l.entity_type, 'scores', if(rlike(g, '\\\\s'), concat(l.scores, array(p.score)), l.scores))"
    join = f"if(l.entity_type = p.entity_type and p.start >= l.start and length(g) <= 3 and rlike(g, '^[ \\\\t._@:/+-]*$'), concat(slice(m, 1, size(m) - 1), array({grown})), concat(m, array({new})))"
    step = let("element_at(m, -1)", "l", let(gap, "g", join))
    groups = f"aggregate(array_sort(filter({predictions}, p -> p.start < p.end), (a, b) -> {order}), cast(array() as {kind}), (m, p) -> if(size(m) = 0, array({new}), {step}))"
    left = f"if(rlike(substring({text}, x.start + 1, 1), '{_INNER_CHAR}'), x.start - length(regexp_extract(substring({text}, 1, x.start), '{_INNER_CHAR}*$', 0)), x.start)"
    right = f"if(rlike(substring({text}, x.end, 1), '{_INNER_CHAR}'), x.end + length(regexp_extract(substring({text}, x.end + 1), '^{_INNER_CHAR}*', 0)), x.end)"
    mean = "aggregate(x.scores, 0D, (a, v) -> a + v) / size(x.scores)"
    span = f"named_struct('start', octet_length(substring({text}, 1, w.a)), 'end', octet_length(substring({text}, 1, w.b)), 'entity_type', w.k, 'score', w.v, 'text', substring({text}, w.a + 1, w.b - w.a), 'source', 'ner')"
    return f"transform(transform({groups}, x -> named_struct('a', {left}, 'b', {right}, 'k', x.entity_type, 'v', {mean})), w -> {span})"


def gated(spans: str, least: dict[str, float]) -> str:
    """SQL: spans at their type's least score of a model; types without one pass."""
    if not least:
        return spans
    table = "map(" + ", ".join(f"'{k}', {v}D" for k, v in least.items()) + ")"
    return f"filter({spans}, s -> s.score >= coalesce({table}[s.entity_type], 0D))"
