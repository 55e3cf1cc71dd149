"""Joins of spans that are rows: overlap, containment and points, by bins.

A span stands in every bin of ``width`` places that it covers, and spans meet on their keys and a bin, so
one document with very many spans is spread over many tasks and only spans of one neighbourhood are
compared. A pair that shares several bins is counted in the first of them. A span costs a row for each
bin that it covers; choose ``width`` at least as large as most spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1024


def _bin(place: Column | str, width: int) -> Column:
    return F.floor((F.col(place) if isinstance(place, str) else place) / width).cast("long")


def _binned(spans: DataFrame, width: int) -> DataFrame:
    """A row per span and bin that it covers; an empty span stands in the bin of its start."""
    return spans.withColumn("_bin", F.explode(F.sequence(_bin("start", width), F.greatest(_bin("start", width), _bin(F.col("end") - 1, width)))))


def overlapping(left: DataFrame, right: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """Pairs of spans (columns start and end, half open) of equal keys that overlap: the keys and the structs ``l`` and ``r``.

    Rows with a null key or bound meet nothing; equal spans are pairs of their own.
    """
    a = _binned(left, width).select(*on, "_bin", F.struct(*left.columns).alias("l"))
    b = _binned(right, width).select(*on, "_bin", F.struct(*right.columns).alias("r"))
    first = F.greatest(_bin("l.start", width), _bin("r.start", width))
    meet = (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end")) & (F.col("_bin") == first)
    return a.join(b, [*on, "_bin"]).filter(meet).drop("_bin")


def _within(left: DataFrame, right: DataFrame, on: list[str], width: int, how: str, inside: Column) -> DataFrame:
    """Rows of ``left`` with or without a span of ``right`` over their start for which ``inside`` holds."""
    a = left.withColumn("_bin", _bin("start", width))
    b = _binned(right.select(*on, "start", "end").distinct(), width).select(*(F.col(k).alias(f"_{k}") for k in on), F.col("_bin").alias("_b"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = F.col("_bin") == F.col("_b")
    for k in on:
        same &= F.col(k) == F.col(f"_{k}")
    return a.join(b, same & (F.col("_start") <= F.col("start")) & inside, how).drop("_bin")


def contained(left: DataFrame, right: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """Spans of ``left`` that lie in one span of ``right``, each once."""
    return _within(left, right, on, width, "left_semi", F.col("_end") >= F.col("end"))


def outside(left: DataFrame, right: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """Spans of ``left`` that lie in no span of ``right``."""
    return _within(left, right, on, width, "left_anti", F.col("_end") >= F.col("end"))


def beginning_in(left: DataFrame, right: DataFrame, on: list[str], width: int = WIDTH) -> DataFrame:
    """Spans of ``left`` whose start lies in a span of ``right``, each once."""
    return _within(left, right, on, width, "left_semi", F.col("_end") > F.col("start"))
