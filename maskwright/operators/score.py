"""Scoring detected spans against gold spans, and grouped metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import BLOCK, let
from maskwright.scratch import materialise


def matched(gold: str, found: str, drift: int = 2, gold_cover: float = 0.8, found_cover: float = 0.5) -> str:
    """SQL: greedy one-to-one matches (g, d: positions) of two span arrays.

    Candidates overlap, start or end at most ``drift`` bytes inside the gold span and cover enough
    of both; they are taken by gold coverage, detection coverage, drift, length difference and
    position, each gold and each detected span once.
    """
    cand = "named_struct('gc', o / (x.end - x.start), 'dc', o / (y.end - y.start), 'dr', greatest(0, y.start - x.start, x.end - y.end), 'ld', abs((y.end - y.start) - (x.end - x.start)), 'g', g, 'd', cast(b.k + d as int))"
    overlap = "greatest(0, least(x.end, y.end) - greatest(x.start, y.start))"
    # a gold span meets the blocks of detections that reach it
    part = f"slice({found}, k * {BLOCK} + 1, {BLOCK})"
    blocks = f"transform(sequence(0, (size({found}) - 1) div {BLOCK}), k -> named_struct('k', k * {BLOCK}, 'y', {part}, 's', array_min(transform({part}, y -> y.start)), 'e', array_max(transform({part}, y -> y.end))))"
    good = f"c.gc > 0 and c.dr <= {drift} and c.gc >= {gold_cover} and c.dc >= {found_cover}"
    near = f"flatten(transform(filter(blocks, b -> b.s < x.end and x.start < b.e), b -> filter(transform(b.y, (y, d) -> {let(overlap, 'o', cand)}), c -> {good})))"
    every = let(blocks, "blocks", f"flatten(transform({gold}, (x, g) -> {near}))")
    order = "case when a.gc != b.gc then if(a.gc > b.gc, -1, 1) when a.dc != b.dc then if(a.dc > b.dc, -1, 1) when a.dr != b.dr then a.dr - b.dr when a.ld != b.ld then a.ld - b.ld when a.g != b.g then a.g - b.g else a.d - b.d end"
    kind = "array<struct<g:int,d:int>>"
    # only candidates that share a gold or a detected span with another one can lose it
    twice = lambda f: let(f"array_sort(transform(cs, c -> c.{f}))", "q", "array_distinct(filter(q, (v, i) -> i > 0 and q[greatest(i - 1, 0)] = v))")
    clash = "(array_contains(tg, c.g) or array_contains(td, c.d))"
    fold = f"aggregate(filter(cs, c -> {clash}), cast(array() as {kind}), (m, c) -> if(exists(m, z -> z.g = c.g or z.d = c.d), m, concat(m, array(named_struct('g', c.g, 'd', c.d)))))"
    kept = f"transform(filter(cs, c -> not {clash} or exists(won, z -> z.g = c.g and z.d = c.d)), c -> named_struct('g', c.g, 'd', c.d))"
    return let(f"array_sort({every}, (a, b) -> {order})", "cs", let(twice("g"), "tg", let(twice("d"), "td", let(fold, "won", kept))))


def outcomes(examples: DataFrame, key: str, gold: str = "gold", found: str = "found", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per match (TP), unmatched gold (FN) and unmatched detection (FP), with its example's segment.

    Segment: negative without gold spans, misc if a gold span is MISC, else headline. Examples
    without any outcome give a row with outcome null, so that they still count.
    """
    rows = examples.select(key, *keep, F.col(gold).alias("gold"), F.col(found).alias("found")).withColumn("m", F.expr(matched("gold", "found")))
    segment = F.expr("case when size(gold) = 0 then 'negative' when exists(gold, x -> x.entity_type = 'MISC') then 'misc' else 'headline' end")
    tp = "transform(m, z -> named_struct('outcome', 'TP', 'gold_type', gold[z.g].entity_type, 'found_type', found[z.d].entity_type))"
    left = lambda side, f: f"if(size({side}) = 0, cast(array() as array<int>), array_except(sequence(0, size({side}) - 1), transform(m, z -> z.{f})))"
    fn = f"transform({left('gold', 'g')}, i -> named_struct('outcome', 'FN', 'gold_type', gold[i].entity_type, 'found_type', cast(null as string)))"
    fp = f"transform({left('found', 'd')}, i -> named_struct('outcome', 'FP', 'gold_type', cast(null as string), 'found_type', found[i].entity_type))"
    return rows.select(key, *keep, segment.alias("segment"), F.explode_outer(F.expr(f"concat({tp}, {fn}, {fp})")).alias("o")).select(key, *keep, "segment", "o.*")


def counts() -> list:
    c = lambda x: F.count_if(F.col("outcome") == x).alias(x.lower())
    return [c("TP"), c("FP"), c("FN")]


def with_metrics(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, fp and fn; 0 where a denominator is."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def adaptive_thresholds(feedback: DataFrame, base: float = 0.5) -> DataFrame:
    """Per type: dismissed, added and the shifted threshold; retypes count nothing.

    ``feedback``: detected_type (null: added by hand) and corrected_type (NOT_PII: dismissed).
    """
    kind = F.when(F.col("detected_type").isNotNull() & (F.col("corrected_type") == "NOT_PII"), F.col("detected_type")).when(F.col("detected_type").isNull() & (F.col("corrected_type") != "NOT_PII"), F.col("corrected_type"))
    rows = feedback.select(kind.alias("entity_type"), F.col("detected_type").isNotNull().alias("dismissed")).filter("entity_type is not null")
    out = rows.groupBy("entity_type").agg(F.count_if("dismissed").alias("dismissed"), F.count_if(~F.col("dismissed")).alias("added"))
    rate = F.col("dismissed") / (F.col("dismissed") + F.col("added"))
    return out.withColumn("threshold", F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.lit(base) + (rate - 0.5) * 0.4)))


#: Bins that a range of values is cut into at each step of the search for a rank.
_BINS = 1024


def ranked_values(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group the nearest-rank value at each share: ``by`` and a column for each name in ``shares``.

    The value at rank ``ceil(n * share)`` is found by histograms: of the range that holds it, a count
    for each of 1024 bins tells the bin, whose own least and largest value are the next range, until
    they are equal. Only counts are shuffled, so a group of any size is spread over all tasks. Nulls
    do not count; values are doubles, with minus infinity first and NaN last.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    same = lambda a, b: reduce(lambda x, k: x & a[k].eqNullSafe(b[k]), keys, F.lit(True))
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v")).filter("v is not null")
    endless = F.col("v").isin(float("inf"), float("-inf")) | F.isnan("v")
    finite = rows.filter(~endless)
    of = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == float("-inf")).alias("neg"), F.count_if(endless).alias("odd"), F.count_if(F.isnan("v")).alias("nan"), F.min(F.when(~endless, F.col("v"))).alias("lo"), F.max(F.when(~endless, F.col("v"))).alias("hi"))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()))
    state = of.withColumn("s", F.explode(names)).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("s.p"))) - F.col("neg"))
    # ranks outside the finite values are known at once
    edge = F.when(F.col("k") <= 0, float("-inf")).when(F.col("k") > F.col("n") - F.col("odd"), F.when(F.col("k") + F.col("neg") > F.col("n") - F.col("nan"), float("nan")).otherwise(float("inf")))
    state = materialise(state.select(*keys, F.col("s.name").alias("name"), "k", F.coalesce(edge, "lo").alias("lo"), F.coalesce(edge, "hi").alias("hi")), "ranks")
    while not (open_ := state.filter("lo < hi")).isEmpty():
        a, b = finite.alias("a"), open_.alias("b")
        inside = a.join(b, same(finite, open_) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(*(finite[k] for k in keys), "name", "k", "v", F.least(F.lit(_BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * _BINS)).alias("bin"))
        counts = inside.groupBy(*keys, "name", "k", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("below", before).filter("below < k and k <= below + c").select(*keys, "name", (F.col("k") - F.col("below")).alias("k"), "lo", "hi")
        state = materialise(state.filter("not lo < hi").unionByName(found), "ranks")
    out = state.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("lo"))).alias(n) for n in shares))
    return out.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, total, average, nearest-rank median and 95th percentile, maximum."""
    ranks = ranked_values(df, value, list(by), {"p50": 0.5, "p95": 0.95})
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"), F.max(value).alias("largest"))
    at = [f"_g{i}" for i in range(len(by))]
    ranks = ranks.withColumnsRenamed(dict(zip(by, at, strict=True)))
    on = reduce(lambda x, c: x & sums[c[0]].eqNullSafe(ranks[c[1]]), zip(by, at, strict=True), F.lit(True))
    return sums.join(ranks, on, "left").select(*by, "n", "total", "average", "p50", "p95", "largest")
