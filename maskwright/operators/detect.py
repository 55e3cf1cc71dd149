"""Detection: recognizers and NER spans, checksums, context, merge and threshold in one narrow stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.schema import SPAN, DetectionConfig


def raw_spans(df: DataFrame, text: str = "text", out: str = "spans", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Add the spans of all recognizers, or of those of some types, before any check."""
    return df.withColumn(out, F.expr(S.recognized(f"coalesce({text}, '')", kinds)))


def detect(df: DataFrame, text: str = "text", config: DetectionConfig = DetectionConfig(), ner: str | None = None, out: str = "spans") -> DataFrame:
    """Add the detected spans of a text, in order and without overlaps.

    ``ner`` names a column of external spans. The least score applies after the merge, so a span
    that is dropped by it still suppresses what it overlapped.
    """
    body = f"coalesce({text}, '')"
    df = df.withColumn(out, F.expr(S.checked(S.recognized(body))))
    if ner:
        df = df.withColumn(out, F.expr(f"concat({out}, {S.external(ner, body)})"))
    df = df.withColumn(out, F.expr(S.boosted(out, body, config)))
    return df.withColumn(out, F.expr(S.confident(S.merged(out), config)))


def exploded(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """A row per span: keys, span_idx (from 0) and the span's fields."""
    # an outer generator: for a plain one Spark pushes size(spans) > 0, and with it all of detection, below itself
    rows = df.select(*keys, F.posexplode_outer(spans).alias("span_idx", "s")).filter("span_idx is not null")
    return rows.select(*keys, "span_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.entity_type").alias("entity_type"), F.col("s.score").alias("score"), F.col("s.text").alias("text"), F.col("s.source").alias("source"))


def register(spark: SparkSession, config: DetectionConfig = DetectionConfig()) -> None:
    """SQL functions of the session: ``detect_pii(text)``, an array of spans, and the table function ``pii_spans(text)``."""
    found = S.confident(S.merged(S.boosted(S.checked(S.recognized("coalesce(body, '')")), "coalesce(body, '')", config)), config)
    bare = f"transform({found}, s -> named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, 'score', s.score, 'text', s.text, 'source', s.source))"
    spark.sql(f"create or replace temporary function detect_pii(body string) returns array<{SPAN}> return {bare}")
    spark.sql(f"create or replace temporary function pii_spans(body string) returns table(span_idx int, start int, end int, entity_type string, score double, text string, source string) return select x.i, x.s.start, x.s.end, x.s.entity_type, x.s.score, x.s.text, x.s.source from lateral posexplode({bare}) as x(i, s)")
