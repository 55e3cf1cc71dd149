"""Allow and block lists of any length, as tables: an inverted index of words in place of a scan per pattern.

A pattern's words (runs of ASCII word characters that touch no ``*``) stand in any text that it matches
as whole words. A plain pattern is joined on the places of two neighbouring words of it with what lies
between them, the pair that texts hold least often, or of its only word; one that is such a pair needs no
further look at the text. One with ``*`` is matched against the texts that hold its rarest word. Places
are found in Arrow batches, which drop what a filter of the list's hashes does not hold, so that little
but hits is moved; lists of up to ``WHOLE`` rows are sent to the texts, longer ones are dealt out with the
hits. Candidates that must be compared come back as one list a text, so texts are moved once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import places
from maskwright.functions.spans import matches_of
from maskwright.functions.text import let, quoted
from maskwright.operators.policy import pattern_spans
from maskwright.operators.vault import first_of
from maskwright.scratch import materialise

#: Patterns without a word of their own, such as ``*``, go into the plan; this many at most.
WORDLESS = 200
#: Rows of a list that are sent to every executor.
WHOLE = 100_000
#: Rows of a longer list for which a task keeps a table in memory; with more of them both sides are sorted.
HELD = 1_000_000

_RUN = "[A-Za-z0-9_]+"


def words(column: str) -> str:
    """SQL: the distinct lower-case ASCII words of a text."""
    return f"array_distinct(regexp_extract_all(lower({column}), '[a-z0-9_]+', 0))"


def anchors(pattern: str) -> str:
    """SQL: a pattern's words that touch no ``*``."""
    return f"array_distinct(regexp_extract_all(lower({pattern}), '(?<![a-z0-9_*])[a-z0-9_]+(?![a-z0-9_*])', 0))"


def expression(pattern: str) -> str:
    """SQL: the regular expression of a pattern; ``*`` is a run of ASCII word characters."""
    plain = f"regexp_replace({pattern}, '([.+?^${{}}()|\\\\[\\\\]\\\\\\\\])', '\\\\\\\\$1')"
    return f"concat('(?iu:', replace({plain}, '*', {quoted(_RUN)}), ')')"


def listed(rows: DataFrame, asked: DataFrame, on: str, n: int, how: str = "inner") -> DataFrame:
    """Rows of texts joined with a list of ``n`` rows, which goes to them where it is not too long."""
    if n <= WHOLE:
        return rows.join(F.broadcast(asked), on, how)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(asked.hint("shuffle_hash" if n <= HELD * tasks else "merge"), on, how)


def rarest(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``wanted`` (_pattern, _word, ...) each pattern's row whose word the fewest rows of ``held`` have; patterns with a word that none has go."""
    seen, row = F.coalesce("count", F.lit(0)), F.struct(*wanted.columns)
    known = wanted.join(held.groupBy("_word").count(), "_word", "left").groupBy("_pattern").agg(F.min_by(row, F.struct(seen, row)).alias("r"), F.min(seen).alias("_least"))
    return known.filter("_least > 0").select("r.*")


def matched(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """A row per whole-word match of a pattern of the table: key, pattern, start, end (bytes) and text, case apart.

    ``key`` tells rows apart. Matches of one pattern do not overlap. Patterns are distinct texts;
    empty and null ones match nothing.
    """
    plain, more = _all(docs, patterns, key, text, pattern)
    for df in plain:
        more.append(df.select("_key", "_pattern", F.struct(F.col("_at").alias("start"), F.expr("_at + octet_length(_cut)").alias("end"), F.col("_cut").alias("text")).alias("s")))
    out = reduce(DataFrame.unionByName, more)
    return out.select(F.col("_key").alias(key), F.col("_pattern").alias(pattern), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def counted(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "pattern") -> DataFrame:
    """The matches of ``matched`` by key and pattern: their number ``n`` and the least start, ``first``.

    Of a long list the hits are dealt out by their words, and counted where they meet the list.
    """
    plain, more = _all(docs, patterns, key, text, pattern)
    many = lambda df, at, *keys: df.groupBy("_key", "_pattern", *keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).select("_key", "_pattern", "n", "first")
    # a pattern is of one kind, so its counts come from one of these
    out = [many(df, "_at", "_word") for df in plain] + [many(df, "s.start") for df in more]
    return reduce(DataFrame.unionByName, out).select(F.col("_key").alias(key), F.col("_pattern").alias(pattern), "n", "first")


def _all(docs: DataFrame, patterns: DataFrame, key: str, text: str, pattern: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Matches that no other of their pattern can overlap, as _key, _pattern, _word, _at, _cut, and all others, as _key, _pattern, s."""
    every = patterns.select(F.col(pattern).alias("_pattern")).filter(F.trim("_pattern") != "").distinct()
    starred = F.contains("_pattern", F.lit("*"))
    every = materialise(every.select("_pattern", (F.size(F.expr(anchors("_pattern"))) > 0).alias("_worded"), starred.alias("_starred")), "patterns")
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    wordless = [r[0] for r in every.filter("not _worded").limit(WORDLESS + 1).collect()]
    if len(wordless) > WORDLESS:
        raise ValueError(f"more than {WORDLESS} patterns have no word of their own")
    plain, out = _placed(body, every.filter("_worded and not _starred").select("_pattern"))
    if every.filter("_worded and _starred").limit(1).count():
        out.append(_scanned(body, every.filter("_worded and _starred").select("_pattern")))
    for p in wordless:
        out.append(body.select("_key", F.lit(p).alias("_pattern"), F.explode(F.expr(f"transform({pattern_spans('_body', p)}, s -> named_struct('start', s.start, 'end', s.end, 'text', s.text))")).alias("s")))
    return plain, out


def _placed(body: DataFrame, patterns: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Matches of patterns without ``*``, looked for at the places of their rarest pair of neighbouring words; in two parts as ``_all``."""
    own = places.places(patterns.select("_pattern", F.col("_pattern").alias("_text")), "least").withColumnRenamed("_key", "_pattern")
    # a pattern that is all one word or pair is found with it, and overlaps itself if the pair's words are alike
    kind = F.when(F.col("_cut") != F.col("_pattern"), "part").when(F.col("_same"), "twin").otherwise("whole")
    known = materialise(own.select("_pattern", F.lower("_cut").alias("_word"), F.col("_at").alias("_off"), "_pair", kind.alias("_kind"), "_hash"), "pattern-words")
    n, pairs, whole, twin, wide = known.agg(F.count(F.lit(1)), F.count_if("_pair"), *(F.count_if(F.col("_kind") == x) for x in ("whole", "twin", "part"))).first()
    held = places.places(body, "both" if 0 < pairs < n else "words" if n and not pairs else "pairs", places.asked(known.select("_hash"), n))
    held = held.select("_key", F.lower("_cut").alias("_word"), "_at", "_cut")
    hits = lambda of: listed(held, known.filter(F.col("_kind") == of).select("_word", "_pattern"), "_word", n).select("_key", "_pattern", "_word", "_at", "_cut")
    plain, found = [hits("whole")] if whole or not n else [], []
    if twin:
        found.append(hits("twin").select("_key", "_pattern", F.struct(F.col("_at").alias("start"), F.expr("_at + octet_length(_cut)").alias("end"), F.col("_cut").alias("text")).alias("h")))
    if wide:
        asked = known.filter("_kind = 'part'").select("_pattern", "_word", "_off")
        least = rarest(listed(held.select("_word"), asked.select("_word").distinct(), "_word", n, "left_semi"), asked)
        at = listed(held, least, "_word", n).select("_key", "_pattern", (F.col("_at") - F.col("_off")).alias("_at")).filter("_at >= 0")
        lists = at.groupBy("_key").agg(F.collect_set(F.struct("_pattern", "_at")).alias("_hits"))
        both = body.join(lists, "_key").withColumn("b", F.expr("cast(_body as binary)"))
        byte = lambda at: f"rlike(cast(substring(b, {at}, 1) as string), '^[A-Za-z0-9_]')"
        here = "cast(substring(b, h._at + 1, octet_length(h._pattern)) as string)"
        whole = f"lower({here}) = lower(h._pattern) and not (h._at > 0 and {byte('h._at')}) and not {byte('h._at + 1 + octet_length(h._pattern)')}"
        good = f"transform(filter(_hits, h -> {whole}), h -> named_struct('p', h._pattern, 'h', named_struct('start', h._at, 'end', h._at + octet_length(h._pattern), 'text', {here})))"
        found.append(both.select("_key", F.explode(F.expr(good)).alias("x")).select("_key", F.col("x.p").alias("_pattern"), F.col("x.h").alias("h")))
    if not found:
        return plain, []
    apart = reduce(DataFrame.unionByName, found).groupBy("_key", "_pattern").agg(F.expr("array_sort(collect_list(h))").alias("m"))
    return plain, [apart.select("_key", "_pattern", F.explode(F.expr(first_of("m", "start int, end int, text string"))).alias("s"))]


def _scanned(body: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches of patterns with ``*``, each looked for in the texts that hold its rarest word."""
    asked = materialise(patterns.select("_pattern", F.explode(F.expr(anchors("_pattern"))).alias("_word")), "pattern-words")
    n = asked.count()
    held = listed(body.select("_key", F.explode(F.expr(words("_body"))).alias("_word")), asked.select("_word").distinct(), "_word", n, "left_semi")
    lists = listed(held, rarest(held, asked), "_word", n).groupBy("_key").agg(F.collect_list("_pattern").alias("_patterns"))
    rows = body.join(lists, "_key").select("_key", "_body", F.explode("_patterns").alias("_pattern")).withColumn("_e", F.expr(expression("_pattern")))
    # the character before the word belongs to the match, save at the start of the text
    found = matches_of("_body", "concat('(?:^|[^A-Za-z0-9_])', _e, '(?=\\\\z|[^A-Za-z0-9_])')", "'MISC'", "1.0D", "'manual'", "0")
    lead = "if(s.cs = 0 and rlike(s.text, concat('^', _e, '\\\\z')), 0, 1)"
    cut = "named_struct('start', s.start + octet_length(substring(s.text, 1, l)), 'end', s.end, 'text', substring(s.text, l + 1))"
    return rows.select("_key", "_pattern", F.explode(F.expr(f"transform({found}, s -> {let(lead, 'l', cut)})")).alias("s"))
