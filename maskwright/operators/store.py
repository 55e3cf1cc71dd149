"""A versioned table: what settings, vaults and records are kept in between jobs.

Rows lie in buckets by a hash of their key. A version is a small manifest that names the folder of each
bucket's rows; a merge writes the buckets that its changes touch, anew and elsewhere, and then a manifest
that takes the other buckets over. Manifests are numbered, and a number is taken by creating its claim,
which one writer alone can do: the other merges again onto what the first has written. Readers see whole
versions, old ones too.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Table:
    """The versions below ``path``, a folder that all executors share; ``schema`` is the rows' DDL, ``keys`` tell rows apart."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _fs(self, path: str) -> tuple[object, object]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The latest version's number; 0 before the first."""
        fs, where = self._fs(f"{self.path}/manifests")
        if not fs.exists(where):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).collect()))

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default; ``only`` names buckets."""
        held = self._manifest(self.version() if version is None else version)
        paths = [f"{where}/_bucket={b}" for b, where in held.items() if only is None or int(b) in only]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, version: int, held: dict[str, str]) -> bool:
        """Whether this writer got the version: its claim can be created once."""
        fs, claim = self._fs(f"{self.path}/manifests/.{version}.claim")
        try:
            fs.create(claim, False).close()
        except Exception as e:  # noqa: BLE001  of whatever file system
            if "xist" not in str(e):
                raise
            return False
        _, part = self._fs(f"{self.path}/manifests/.{version}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        _, done = self._fs(f"{self.path}/manifests/{version}.json")
        fs.rename(part, done)
        return True

    def merge(self, changes: DataFrame, deleted: str | None = None, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, wait: float = 60) -> int:
        """Rows of ``changes``, one a key, in place of those with their keys; the new version.

        Where the column ``deleted`` holds, the row goes. ``combine`` (old rows, changes) makes the
        new rows of the buckets touched in another way. A writer that comes second merges again.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most the number of buckets
        end = time.monotonic() + wait
        while True:
            base = self.version()
            held, old = self._manifest(base), self.read(base, touched)
            if combine is not None:
                rows = combine(old, changes)
            else:
                kept = changes if deleted is None else changes.filter(~F.coalesce(F.col(deleted), F.lit(False)))
                same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
                rows = old.alias("o").join(changes.select(*self.keys).alias("c"), same, "left_anti").unionByName(kept.select(*old.columns))
            where = f"{self.path}/rows-{uuid.uuid4().hex}"
            rows.select(*old.columns).withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(where)
            fs, folder = self._fs(where)
            names = [f.getPath().getName() for f in fs.listStatus(folder)]
            new = {n.removeprefix("_bucket="): where for n in names if n.startswith("_bucket=")}
            if self._write(base + 1, {b: w for b, w in held.items() if int(b) not in touched} | new):
                return base + 1
            while self.version() == base:  # the other writer has its claim, but is not done
                if time.monotonic() > end:
                    raise TimeoutError(f"version {base + 1} of {self.path} was claimed and never written")
                time.sleep(0.05)
