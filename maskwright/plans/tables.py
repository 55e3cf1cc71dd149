"""Queries where spans, lists and state are tables: interval joins, large lists, stored versions, exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import intervals, phrases, score, store
from maskwright.plans import oracle as O
from maskwright.plans.registry import _GOLD, documents, found, query, read
from maskwright.scratch import materialise, scratch_path

_OF = f"with recursive {O.detected()}"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected spans of all documents as rows of one huge document; each document has a stretch of its own."""
    rows = found(spark, sf_dir).withColumn("base", F.col("doc_id") * 100_000_000)
    return rows.select(F.lit("all").alias("doc"), "doc_id", "span_idx", "entity_type", "base", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"))


@query(
    f"""{_OF}, {_GOLD}, g as (select d.doc_id, d.span_idx, d.start - gold.shift as start, d."end", gold.gold_type from det d join gold using (doc_id, span_idx) where is_gold)
    select g.doc_id, g.span_idx as gold_idx, d.span_idx as found_idx, least(g."end", d."end") - greatest(g.start, d.start) as overlap, round((least(g."end", d."end") - greatest(g.start, d.start)) / (g."end" - g.start), 6) as gold_cover
    from g join det d on d.doc_id = g.doc_id and g.start < d."end" and d.start < g."end" """
)
def gold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans and detections that overlap, all in one huge document."""
    rows = materialise(_rows(spark, sf_dir), "span-rows")
    gold = rows.filter("(doc_id + span_idx) % 5 != 0").withColumn("start", F.col("start") - F.col("doc_id") % 4)
    pairs = intervals.overlapping(gold, rows, ["doc"], width=256)
    overlap = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    return pairs.select(F.col("l.doc_id").alias("doc_id"), F.col("l.span_idx").alias("gold_idx"), F.col("r.span_idx").alias("found_idx"), overlap.alias("overlap"), F.round(overlap / (F.col("l.end") - F.col("l.start")), 6).alias("gold_cover"))


@query(
    f"""{_OF}, r as (select doc_id, strlen(coalesce(text, '')) as n from documents), s as (select d.doc_id, d.span_idx, d.start, d."end", r.n from det d join r using (doc_id))
    select doc_id, span_idx, "end" <= n // 2 or (start >= n // 4 and "end" <= n * 3 // 4) as allowed, start < n // 3 as in_region from s"""
)
def spans_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in one of two overlapping allowed ranges of their document, and those that begin in its first third."""
    rows = materialise(_rows(spark, sf_dir), "span-rows")
    docs = documents(spark, sf_dir).select(F.lit("all").alias("doc"), (F.col("doc_id") * 100_000_000).alias("base"), F.expr("cast(octet_length(coalesce(text, '')) as long)").alias("n"))
    cut = lambda a, b: docs.select("doc", F.expr(f"base + {a}").alias("start"), F.expr(f"base + {b}").alias("end"))
    ranges, region = cut("0", "n div 2").unionAll(cut("n div 4", "n * 3 div 4")), cut("0", "n div 3")
    keys = ["doc_id", "span_idx"]
    inside = intervals.contained(rows, ranges, ["doc"]).select(*keys, F.lit(True).alias("_in"))
    outside = intervals.outside(rows, ranges, ["doc"]).select(*keys, F.lit(False).alias("_in"))
    begun = intervals.beginning_in(rows, region, ["doc"]).select(*keys, F.lit(True).alias("_begun"))
    out = inside.unionAll(outside).join(begun, keys, "left")
    return out.select(*keys, F.col("_in").alias("allowed"), F.coalesce("_begun", F.lit(False)).alias("in_region"))


_TOKEN = "[A-Za-z0-9_]+"


def _pairs(name: str, key: str, table: str) -> str:
    """CTE: neighbouring words (lower case, place, byte start) of a table's texts that one blank parts."""
    return f"""{name}_l as (select {key}, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') as w, string_split_regex(coalesce(text, ''), '{_TOKEN}') as g from {table}),
    {name}_w as (select {key}, unnest(w) as a, generate_subscripts(w, 1) as k from {name}_l), {name}_g as (select {key}, unnest(g) as g, generate_subscripts(g, 1) as k from {name}_l),
    {name}_j as (select w.{key}, w.k, w.a, g.g from {name}_w w join {name}_g g on g.{key} = w.{key} and g.k = w.k),
    {name} as (select {key}, lower(a) as a, lower(lead(a) over o) as b, lead(g) over o as gap, sum(strlen(g) + strlen(a)) over o - strlen(a) as start from {name}_j window o as (partition by {key} order by k))"""


@query(
    f"""with c as (select conv_id * 1000 + turn as id, text from conversations), {_pairs('q', 'id', 'c')}, {_pairs('d', 'doc_id', 'documents')},
    p as (select distinct a, b from q where gap = ' ' and a != b and id % 3 = 0)
    select doc_id, d.a || ' ' || d.b as pattern, count(*) as n, cast(min(start) as integer) as first from d join p on p.a = d.a and p.b = d.b where gap = ' ' group by all"""
)
def listed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words from every third turn of the conversations, as a list of patterns, in all documents."""
    turns = read(spark, sf_dir, "conversations").filter("(conv_id * 1000 + turn) % 3 = 0").select(F.expr(f"regexp_extract_all(coalesce(text, ''), '{_TOKEN}', 0)").alias("w"), F.expr(f"split(coalesce(text, ''), '{_TOKEN}', -1)").alias("g"))
    pair = "transform(filter(sequence(1, size(w) - 1), i -> size(w) > 1 and i < size(w) and g[i] = ' ' and lower(w[i - 1]) != lower(w[i])), i -> lower(concat(w[i - 1], ' ', w[i])))"
    patterns = turns.filter("size(w) > 1").select(F.explode(F.expr(pair)).alias("pattern")).distinct()
    return phrases.counted(documents(spark, sf_dir), patterns)


@query(
    """with l as (select user_id, event_id % 2 as odd, arg_max(event_type, event_id) as kind, max(event_id) as at, count(*) as n from events group by all)
    select user_id, coalesce(b.kind, a.kind) as kind, coalesce(b.at, a.at) as at, coalesce(b.n, a.n) as n from (select * from l where odd = 0) a full join (select * from l where odd = 1) b using (user_id) where user_id % 7 != 0"""
)
def stored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' latest events in a stored table: the even ones, the odd ones over them, then some users deleted."""
    table = store.Table(spark, scratch_path(spark, "state"), "user_id long, kind string, at long, n long", ["user_id"])
    events = read(spark, sf_dir, "events")
    for odd in (0, 1):
        table.merge(events.filter(F.col("event_id") % 2 == odd).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("at"), F.count(F.lit(1)).alias("n")))
    table.merge(table.read().filter("user_id % 7 = 0").withColumn("gone", F.lit(True)), deleted="gone")
    return table.read()


@query(
    """select l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.01) as p01, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.999) as p999 from lineitem group by all"""
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank prices per flag and status, found by refined histograms."""
    return score.ranked_values(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], {"p01": 0.01, "p50": 0.5, "p999": 0.999})
