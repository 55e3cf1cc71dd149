"""A reviewer's decisions on detected spans: switches, new types, the slider, spans added by hand.

Decisions are rows (doc, span_idx, enabled, new_type), null where nothing was decided; spans are
exploded rows with character offsets (cs, ce).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import let, quoted
from maskwright.schema import TYPES, Sensitivity


def floor(sensitivity: Sensitivity, adaptive: dict[str, float] | None = None) -> str:
    """SQL: the least score of a type: the adaptive one where there is one, else the slider's."""
    least = {t[0]: (adaptive or {}).get(t[0], sensitivity.threshold(t[0])) for t in TYPES}
    return "map(" + ", ".join(f"{quoted(k)}, {v!r}D" for k, v in least.items()) + ")"


def decided(spans: DataFrame, decisions: DataFrame, slider: float, sensitivity: Sensitivity = Sensitivity(), adaptive: dict[str, float] | None = None, doc: str = "doc_id") -> DataFrame:
    """Spans with ``enabled`` and ``entity_type`` as decided.

    A switch set by hand sticks; the others are on outside of code at a score that reaches both the
    slider and the type's own threshold.
    """
    last = decisions.groupBy(doc, "span_idx").agg(F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("seq"))).alias("_on"), F.max_by("new_type", F.when(F.col("new_type").isNotNull(), F.col("seq"))).alias("_type"))
    least = F.greatest(F.lit(slider), F.expr(f"{floor(sensitivity, adaptive)}[entity_type]"))
    code = F.col("in_code") if "in_code" in spans.columns else F.lit(False)
    out = spans.join(last, [doc, "span_idx"], "left").withColumn("enabled", F.coalesce("_on", ~code & (F.col("score") >= least)))
    return out.withColumn("entity_type", F.coalesce("_type", "entity_type")).drop("_on", "_type")


def by_hand(text: str, wanted: str, entity_type: str) -> str:
    """SQL: the span of a text's first occurrence as manual, or null."""
    span = f"named_struct('start', octet_length(substring({text}, 1, i - 1)), 'end', octet_length(substring({text}, 1, i - 1)) + octet_length({wanted}), 'entity_type', {entity_type}, 'score', 1.0D, 'text', {wanted}, 'source', 'manual')"
    return let(f"if({wanted} = '', 0, instr({text}, {wanted}))", "i", f"if(i > 0, {span}, null)")


def confirmed(decided_: DataFrame, manual: DataFrame, doc: str = "doc_id") -> DataFrame:
    """What a reviewer confirms: enabled spans with their types, then manual ones (doc, start, end, entity_type, text)."""
    columns = [doc, "start", "end", "entity_type", "text"]
    return decided_.filter("enabled").select(*columns, F.lit("detected").alias("origin")).unionByName(manual.select(*columns, F.lit("manual").alias("origin")))


def feedback_context(text: str, start: str, end: str, radius: int = 20) -> str:
    """SQL: a span (in characters) with ``radius`` characters on both sides."""
    return f"substring({text}, greatest({start} - {radius}, 0) + 1, {end} + {radius} - greatest({start} - {radius}, 0))"


def feedback(spans: DataFrame, decisions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Log entries of decisions on spans (with cs, ce and the document's text as ``body``): dismissals as NOT_PII, new types as such."""
    rows = decisions.join(spans, [doc, "span_idx"])
    kind = F.when(F.col("new_type").isNotNull() & (F.col("new_type") != F.col("entity_type")), F.col("new_type")).when(F.col("enabled") == False, F.lit("NOT_PII"))  # noqa: E712
    return rows.withColumn("corrected_type", kind).filter("corrected_type is not null").select(doc, "span_idx", "seq", "text", F.col("entity_type").alias("detected_type"), "corrected_type", F.expr(feedback_context("body", "cs", "ce")).alias("context"))


def preview_rows(confirmed_: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Confirmed spans that a preview shows: of overlapping ones the first by start, numbered by type in their document."""
    every = Window.partitionBy(doc).orderBy("start", "end", "origin")
    # the furthest end among the spans before
    rows = confirmed_.withColumn("_before", F.max("end").over(every.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.filter(F.col("_before").isNull() | (F.col("start") >= F.col("_before"))).drop("_before")
    n = F.row_number().over(Window.partitionBy(doc, "entity_type").orderBy("start"))
    return rows.withColumn("placeholder", F.concat(F.lit("["), "entity_type", F.lit("_"), n.cast("string"), F.lit("]")))
