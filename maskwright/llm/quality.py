"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is compressed whole, in stretches of ``STRETCH`` bytes so that length does not matter, with a
dictionary trained on good and one trained on bad labelled text; the difference of the two sizes
over the text's size is the only feature. A rising curve fitted on labelled texts that neither
dictionary saw turns it into a probability of label 1: isotonic regression, with a small part of a
logistic curve to keep scores apart; a short text, which tells little, is drawn to the share of
label 1. The classifier is fitted on a bounded sample of rows: at most ``per_class`` labelled rows
of each class, the first by a hash of the id, with their whole texts. Dictionaries learn from
stretches drawn by a hash from all stretches of these texts, every text's first draw before any
text's second; the curve is fitted on features of whole texts, computed on Spark. Scoring is a map
over the documents with no shuffle.

Defined results: a null text scores as the empty one; rows whose label is null or neither 0 nor 1
teach nothing; with no usable label of a class every score is the share of label 1 among the
sample (0.5 with none); a document with several labels counts once for each; a null key is kept;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialise
from maskwright.llm.tokencount import runs

LEVEL = 3
STRETCH = 4096
#: Bytes of stretches that one dictionary is trained on; of more, dictionaries are trained on dictionaries.
TRAIN = 16_000_000
#: The logistic curve's part in a score.
APART = 0.05
#: Bytes of text at which its own evidence weighs as much as the share of label 1.
SHORT = 64


@dataclass(frozen=True)
class Model:
    """Dictionaries as bytes (good, bad), the logistic curve and the isotonic one's points."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    at: tuple[float, ...] = ()
    level: tuple[float, ...] = ()
    share: float = 0.5


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of at most ``size`` bytes; samples too few to train are cut shorter, then taken as they are."""
    for length in (STRETCH, STRETCH // 16):
        try:
            return zstandard.train_dictionary(size, [t[i : i + length] for t in samples for i in range(0, len(t), length)]).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-size:]


def stretches(text: bytes) -> list[bytes]:
    return [text[i : i + STRETCH] for i in range(0, len(text), STRETCH)]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) if d else None for d in (self._dict(model.good), self._dict(model.bad))]

    @staticmethod
    def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
        if len(data) < 8:
            return None
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return d

    def feature(self, text: bytes) -> float:
        """(size by the bad - size by the good dictionary) / size of the text."""
        if not text or None in self.by:
            return 0.0
        good, bad = (sum(len(c.compress(x)) for x in stretches(text)) for c in self.by)
        return (bad - good) / len(text)

    def score(self, text: bytes) -> float:
        x = self.feature(text)
        z = self.model.slope * x + self.model.intercept
        smooth = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
        if not self.model.at:
            return smooth
        own = APART * smooth + (1 - APART) * float(np.interp(x, self.model.at, self.model.level))
        return self.model.share + (own - self.model.share) * len(text) / (len(text) + SHORT)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton steps on the weighted, lightly penalised likelihood."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - ridge * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Places and levels of the rising step curve nearest to y, by pooling neighbours that fall."""
    pools: list[list[float]] = []  # weight, weighted x, weighted y
    for i in np.argsort(x, kind="stable"):
        pools.append([weight[i], weight[i] * x[i], weight[i] * y[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return tuple(float(p[1] / p[0]) for p in pools), tuple(float(p[2] / p[0]) for p in pools)


def _trained(sample: DataFrame, size: int) -> dict[int, bytes]:
    """A dictionary for each class from all stretches of its texts (y, t, o).

    Stretches are dealt by a hash to groups of about ``TRAIN`` bytes, each trained in a task; a class
    with several groups is trained once more on what they gave.
    """
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.sum(F.length("t")).alias("n")).collect()}
    groups = {y: max(1, -(-n // TRAIN)) for y, n in total.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, 4_000_000):
                for y, t, o in zip(*(c.to_pylist() for c in run.columns), strict=True):
                    parts = stretches(t)
                    drawn = [xxhash.xxh3_64_intdigest(f"{o}:{i}") for i in range(len(parts))]
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(parts), pa.int32()), pa.array([d % groups[y] for d in drawn], pa.int64()), pa.array([d >> 1 for d in drawn], pa.int64()), pa.array(parts, pa.binary())], ["y", "part", "draw", "t"])

    def train(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("draw").to_pylist(), group.column("t").to_pylist(), strict=True))
        return pa.table({"y": group.column("y")[:1], "part": group.column("part")[:1], "t": pa.array([_dictionary([t for _, t in rows], size)], pa.binary())})

    made = sample.mapInArrow(cut, "y int, part long, draw long, t binary").groupBy("y", "part").applyInArrow(train, "y int, part long, t binary")
    if max(groups.values(), default=1) > 1:
        made = made.select("y", F.lit(0).cast("long").alias("part"), F.col("part").alias("draw"), "t").groupBy("y", "part").applyInArrow(train, "y int, part long, t binary")
    return {r["y"]: bytes(r["t"]) for r in made.collect()}  # two rows


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 2000, dictionary_bytes: int = 110_000) -> Model:
    """Fit on labelled documents for which ``learnable``, an expression over ``key``, holds."""
    order = F.xxhash64(F.col(key), F.lit("quality"))
    told = labels.filter(learnable & F.col(key).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in told.filter("y in (0, 1)").groupBy("y").count().collect()}
    picked = [told.filter(F.col("y") == y).orderBy(order, key).limit(per_class) for y in (0, 1)]
    sample = docs.select(F.col(key), F.col(text).cast("binary").alias("t")).filter("length(t) > 0").join(F.broadcast(picked[0].unionAll(picked[1])), key)
    sample = materialise(sample.select("y", "t", order.alias("o"), F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("id")), "quality-sample")
    # every fourth text calibrates, the others make the dictionaries
    turn = F.row_number().over(Window.partitionBy("y").orderBy("o", "h", "id"))
    few = [sample.filter(F.col("y") == y).select("y", "o", "h", "id").orderBy("o", "h", "id").limit(per_class) for y in (0, 1)]  # an id may stand in many documents
    sample = sample.join(F.broadcast(few[0].unionAll(few[1]).select("id", (turn % 4 == 1).alias("held"))), "id")

    train = _trained(sample.filter("not held").select("y", "t", "o"), dictionary_bytes)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    none = Model(b"", b"", 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not train.get(0) or not train.get(1):
        return none
    good, bad = train[1], train[0]

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(good, bad, 1.0, 0.0))
        for batch in batches:
            for run in runs(batch, 4_000_000):
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array([scorer.feature(t) for t in run.column(1).to_pylist()], pa.float64())], ["y", "x"])

    held = sorted((r["y"], r["x"]) for r in sample.filter("held").select("y", "t").mapInArrow(feature, "y int, x double").collect())
    if len({y for y, _ in held}) < 2:
        return none
    x, y = np.array([x for _, x in held]), np.array([y for y, _ in held], float)
    # the sample is balanced, the labels are not
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return Model(good, bad, *_logistic(x, y, weight), *_isotonic(x, y, weight), share)


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (probability of label 1) and predicted of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for run in runs(batch, 4_000_000):
                s = [scorer.score(t or b"") for t in run.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["key", "score", "predicted"])

    scored = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).mapInArrow(score, f"key {kind}, score double, predicted int")
    return scored.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for run in runs(batch, 4_000_000):
                yield run.filter(pa.array([scorer.score((t or "").encode()) >= least for t in run.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
