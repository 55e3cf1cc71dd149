"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key; within a source documents stand in key order, and prefix
sums of their word counts say which fall inside the source's budget. The prefix sums are
distributed: keys are cut into equal hash ranges, each range is summed, the sums are accumulated
per source, and a window inside each range adds the rest. A hot source is spread over all of its
ranges, at most ``MAX_RANGES`` of them, so neither the windows over ranges nor those inside a
range grow into one task.

Defined results: a null text has size 0; a null source is one source, ordered last; a null key
is hashed as the empty text; repeated rows are mixed as rows of their own; with no words at all
every target is 0; extra columns pass through ``mixed_documents`` and are ignored by ``mix``.
The table of sources (one row each) is the only thing ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import WORD, materialise

#: Hash keys are this many bits; a range is a quotient of the key.
KEY_BITS = 60
MAX_RANGES = 65_536
ROWS_PER_RANGE = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Per source (``src_null``, ``src``, ``source_size``) its target in words.

    Sources in code-point order take the weights in turn. Filling by weight with caps has a closed
    form: in ascending order of cap over weight, a source is capped if its cap is at most its
    share of what is left after those before it; the rest share the remainder by weight.
    """
    order = Window.orderBy("src_null", "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * max_epochs
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", cap)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select("*", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("words_left"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"))
    left = left.withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    level = F.max(F.when(~F.col("capped"), F.col("words_left").cast("double") / F.col("weight_left"))).over(every)
    return left.select("src_null", "src", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", row: str | None = None) -> DataFrame:
    """Per document: key, size, source_size, target, taken (words) and copies (whole documents).

    A source whose target is above its size repeats its epoch; the last, partial epoch is cut at
    the exact word, so ``taken`` of a source sums to its target rounded down. ``copies`` counts a
    document that the cut falls into as whole. ``row`` names a column of distinct row ids, which is
    carried along and decides last between equal rows. Hash keys take in the key and the text.
    """
    # rows with null or equal keys are spread by their texts
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    hashed = F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long")
    own = [F.col(row).alias("row")] if row else []
    sized = materialise(docs.select(*own, F.col(key).alias("key"), F.col(source).isNull().alias("src_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hashed.alias("h")), "mix-sizes")
    ranges = max(1, min(MAX_RANGES, sized.count() // ROWS_PER_RANGE))
    sized = sized.withColumn("range", F.floor(F.col("h") / (2**KEY_BITS // ranges)).cast("long"))

    sums = sized.groupBy("src_null", "src", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(sums.groupBy("src_null", "src").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    below = Window.partitionBy("src_null", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(goal, ["src_null", "src"]).select("src_null", "src", "range", "source_size", "target", F.coalesce(F.sum("range_size").over(below), F.lit(0)).alias("below"))

    inside = Window.partitionBy("src_null", "src", "range").orderBy("h", "key", "size", *(["row"] if row else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(sums, ["src_null", "src", "range"]).withColumn("start", F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("cut", F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("start"))
    part = F.greatest(F.lit(0), F.least("size", "cut"))
    return placed.select(*([F.col("row").alias(row)] if row else []), F.col("key").alias(key), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), (F.col("epochs") + (F.col("cut") > 0).cast("int")).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """The documents as often as the mix takes them, whole, with all their columns.

    Copies come back by an id written with the rows, so null and repeated keys take their own only; a
    document without words goes if its place is past the cut.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    copies = mix(numbered, key, row="_row", **options).select("_row", F.col("copies").alias("_copies")).filter("_copies > 0")
    return numbered.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
