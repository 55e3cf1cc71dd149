"""What the training-data operators share: the word rule, folds and tables; scratch tables come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.scratch import materialise, release, scratch_path

__all__ = ["WORD", "crc_fold", "materialise", "release", "scratch_path", "table"]

#: A word: a run without blank, tab, LF, VT, FF or CR. ``bytes.split()`` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
