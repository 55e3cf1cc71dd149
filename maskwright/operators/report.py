"""Benchmark reports: outcomes by example, samples with context, grouped metrics and a text summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import BLANK, let
from maskwright.operators import score


def compact(text: str) -> str:
    """SQL: the text trimmed, white space made single blanks."""
    return f"regexp_replace(regexp_replace({text}, '^{BLANK}+|{BLANK}+$', ''), '{BLANK}+', ' ')"


def context(text: str, span: str, radius: int = 48) -> str:
    """SQL: a span's first place in the compacted text with ``radius`` characters on both sides, cuts marked by dots."""
    dots = "'...'"
    around = f"concat(if(i - 1 > {radius}, {dots}, ''), substring(t, greatest(i - {radius}, 1), i - greatest(i - {radius}, 1) + char_length(s) + {radius}), if(i - 1 + char_length(s) + {radius} < char_length(t), {dots}, ''))"
    short = f"if(char_length(t) <= {2 * radius}, t, concat(substring(t, 1, {2 * radius - 3}), {dots}))"
    return let(compact(text), "t", let(compact(span), "s", let("if(s = '', 0, instr(t, s))", "i", f"if(i > 0, {around}, {short})")))


def by_example(examples: DataFrame, key: str = "id", gold: str = "gold", found: str = "found") -> DataFrame:
    """Every example with its matches (positions of gold and found), false negatives and false positives as arrays; empty ones where it has none."""
    rows = examples.withColumn("matches", F.expr(score.matched(gold, found)))
    rest = lambda spans, at: f"filter({spans}, (x, i) -> not exists(matches, z -> z.{at} = i))"
    return rows.withColumn("false_negatives", F.expr(rest(gold, "g"))).withColumn("false_positives", F.expr(rest(found, "d")))


def samples(report: DataFrame, column: str, n: int = 5, text: str = "text", order: str = "id") -> DataFrame:
    """The first ``n`` spans of a report's column by example and position, with their context (``n`` is a report's size)."""
    rows = report.select(F.col(order).alias("example"), text, F.posexplode(column).alias("position", "s")).orderBy("example", "position").limit(n)
    return rows.select("example", "position", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("span"), F.expr(context(text, "s.text")).alias("context"))


def metrics(outcomes: DataFrame, *dimensions: str) -> DataFrame:
    """Counts, precision, recall and F1 of headline outcomes as a whole and by each dimension, in one pass.

    Columns: dimension ('' for the whole), value and the metrics.
    """
    rows = outcomes.filter("segment = 'headline'")
    named = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    whole = F.struct(F.lit("").alias("dimension"), F.lit("").alias("value"))
    rows = rows.select("outcome", F.explode(F.array(whole, *named)).alias("d"))
    return score.with_metrics(rows.groupBy("d.dimension", "d.value").agg(*score.counts()))


def write_report(report: DataFrame, path: str) -> None:
    """The per-example report as JSON lines."""
    report.write.json(path)


def text_summary(figures: DataFrame, negatives: DataFrame, latency: DataFrame, title: str) -> str:
    """A short text of ``metrics``, of negative examples (examples, passed) and of a latency distribution: a few rows each."""
    percent = lambda x: f"{100 * x:.1f}%"
    lines, table = [title, ""], sorted(figures.collect(), key=lambda r: (r["dimension"], r["value"] or ""))
    for r in table:
        name = f"{r['dimension']} {r['value']}".strip() or "all"
        lines.append(f"{name}: P/R/F1 {percent(r['precision'])} / {percent(r['recall'])} / {percent(r['f1'])} ({r['tp']} TP, {r['fp']} FP, {r['fn']} FN)")
    n = negatives.first()
    lines += ["", f"negative examples: {n['passed']}/{n['examples']} passed"]
    lines += [f"latency: average {r['average']:.1f} ms, p50 {r['p50']:.1f} ms, p95 {r['p95']:.1f} ms, most {r['largest']:.1f} ms" for r in latency.collect()]
    return "\n".join(lines)


def latest(found: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The ``n`` latest rows of a log (a report's size), newest first."""
    return found.orderBy(F.desc(by), *map(F.desc, ties)).limit(n)


def findings(spans: DataFrame, *by: str, most: int = 3) -> DataFrame:
    """Per file and type: number of spans, the first ``most`` different trimmed texts, and the type's place by number, then first appearance."""
    text = F.trim("text")
    rows = spans.select(*by, "entity_type", "span_idx", text.alias("t"))
    each = rows.groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("span_idx").alias("first"), F.expr(f"slice(array_distinct(transform(array_sort(filter(collect_list(struct(span_idx, t)), x -> x.t != '')), x -> x.t)), 1, {most})").alias("examples"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))).drop("first")
