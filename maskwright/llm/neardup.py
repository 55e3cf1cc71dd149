"""MinHash near-duplicates: one-permutation hashing, bands, star-shaped candidates, exact links.

A document is the set of its distinct word shingles, as 64-bit hashes. One pass computes each
set's one-permutation signature (the smallest hash in each of its bins; an empty bin
borrows from the bin that its own probe sequence reaches first, the optimal densification) and
one hash per band. Equal sets collapse to the document with the smallest key. In each bucket of a
band star edges become candidates, from one hub to the members that are not yet in its component,
and they are confirmed on the full sets; after two rounds of stars, buckets that still hold several
components are compared block by block, without emitting pairs (see ``_rounds``). The rows of a
band follow the threshold (8 at 0.85, 6 at 0.8), so that a pair at the threshold shares no bucket with
a probability below ``MISS``.

Hubs are found by pre-aggregated minima and joined back by sort-merge joins, which Spark splits where
a bucket is large, so a bucket with a third of all rows is never gathered in one task.

Defined results: a null or wordless text has no shingles, links with nothing and is kept; a text
with fewer words than a shingle is one shingle; rows that share a key are one document for
linking; a null key links with nothing (component null, kept); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise, release
from maskwright.llm.tokencount import runs

BANDS = 48
#: The chance at most that a pair at the threshold shares no bucket.
MISS = 1e-6
#: Hashes in a block of a bucket.
BLOCK = 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Ascending distinct hashes of the text's shingles (A-Z lower-cased, words between ASCII blanks)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed(out * _M2 + h[i : i + n])
    return np.unique(out)


@cache
def rows_of(percent: int) -> int:
    """Rows of a band: the most at which pairs at ``percent`` % are missed with chance ``MISS`` at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** BANDS <= MISS)


@cache
def _probes(bins: int, tries: int) -> np.ndarray:
    """For each bin the bins that it borrows from, in order; the same for every document."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, tries + 1, dtype=np.uint64)[None, :]
    return (mixed(at * _M1) % np.uint64(bins)).astype(np.int64)


@cache
def _factors(rows: int) -> np.ndarray:
    return mixed(np.arange(1, BANDS * rows + 1, dtype=np.uint64)).reshape(BANDS, rows) | np.uint64(1)


def bands(hashes: np.ndarray, rows: int) -> np.ndarray:
    """One bucket hash per band of an ascending, non-empty set; a bucket names its band too."""
    n = BANDS * rows
    bins = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    own, first = np.unique(bins, return_index=True)
    full = np.zeros(n, bool)
    full[own.astype(np.int64)] = True
    value = np.zeros(n, np.uint64)
    value[full] = mixed(hashes[first])
    empty = np.flatnonzero(~full)
    for tries in (24, 4096):
        if not len(empty):
            break
        probes = _probes(n, tries)[empty]
        hit = full[probes]
        found = hit.any(axis=1)
        at = hit.argmax(axis=1)
        value[empty[found]] = value[probes[found, at[found]]]
        empty = empty[~found]
    value[empty] = value[np.flatnonzero(full)[0]]
    return mixed((value.reshape(BANDS, rows) * _factors(rows)).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, key: str, text: str, size: int, rows: int) -> DataFrame:
    """key, n_shingles, digest of the set (null if empty) and bands of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, 4_000_000):
                n, digest, band = [], [], []
                for t in run.column(1):
                    s = shingle_set(t.as_py() or b"", size)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    band.append(bands(s, rows).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["key", "n", "digest", "bands"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).mapInArrow(sign, f"key {kind}, n long, digest binary, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) for every end of ``links`` (a, b).

    Each round takes the smallest label among neighbours and then the label's own label; the
    number of rounds follows the logarithm of the longest chain. Only counts reach the driver.
    """
    both = materialise(links.select("a", "b").unionAll(links.select("b", "a")).distinct(), "links")
    last = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        labels = last.select("node", "comp")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialise(step.join(up, "comp", "left").select("node", "old", F.least("comp", "up").alias("comp")), "labels")
        release(last)
        if new.filter("comp < old").isEmpty():
            release(both)
            return new.select("node", "comp")
        last = new


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left, right = (sets.select(F.col("key").alias(x), F.col("hashes").alias(f"h{x}")) for x in ("a", "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, hb = batch.column("ha"), batch.column("hb")
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (ha, hb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "hb")
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept of every row; linked at ``percent`` % Jaccard."""
    rows = materialise(signatures(docs, key, text, shingle, rows_of(percent)), "neardup-rows")
    named = rows.filter("digest is not null and key is not null")
    reps = named.groupBy("digest").agg(F.min("key").alias("rep"))
    own = materialise(named.join(reps, "digest").select("key", "rep", "n", F.when(F.col("key") == F.col("rep"), F.col("bands")).alias("bands")), "neardup-reps")

    placed = own.filter("bands is not null").select("rep", "n", F.explode("bands").alias("bucket")).distinct()
    crowded = placed.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("bucket")
    placed = materialise(placed.join(crowded.hint("merge"), "bucket"), "neardup-buckets")
    kind = docs.schema[key].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, 4_000_000):
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in run.column(1)], pa.binary())], ["key", "hashes"])

    wanted = placed.select(F.col("rep").alias("key")).distinct()
    sets = materialise(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).filter("t is not null").join(wanted, "key").mapInArrow(build, f"key {kind}, hashes binary"), "neardup-sets")
    links = _rounds(placed, sets, percent)
    release(sets)  # links are written; the sets are the largest table
    release(placed)
    comps = components(links)
    found = own.select("key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").groupBy("key").agg(F.min(F.coalesce("comp", "rep")).alias("component_id"))
    out = rows.select("key", "n").join(found, "key", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True))).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component.

    Rows link as rows, by an id written with them, so rows that share a key but have different
    texts all take part; a component keeps the row with the smallest key, ties broken by text. Of
    rows without a shingle only equal ones (key and text) collapse. Rows with a null key link with
    nothing and stay.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "neardup-docs")
    named = numbered.filter(F.col(key).isNotNull())
    found = near_duplicates(named, "_row", text, shingle, percent).select("_row", "n_shingles", "component_id")
    ties = named.select("_row", F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.xxhash64(*docs.columns).alias("_all"))
    rows = found.join(ties, "_row").withColumn("_blank", F.col("n_shingles") == 0)
    group = [F.when(~F.col("_blank"), F.col("component_id")).alias("_comp"), F.when(F.col("_blank"), F.struct("_key", "_text")).alias("_same")]
    kept = rows.groupBy(*group).agg(F.min(F.struct("_key", "_text", "_all", "_row")).alias("_least")).select("_least._row")
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns).unionByName(numbered.filter(F.col(key).isNull()).select(*docs.columns))


def _rounds(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect everything that links within buckets connect.

    Two rounds of stars: in each bucket one hub, the smallest key and then a hashed choice, meets
    the members of other components. Buckets whose members are all in one component are then
    done. In the others every two members of different components are compared in blocks, so no
    link is lost; only links leave a block.
    """
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent  # sizes that can reach it
    left, links = placed.withColumn("comp", F.col("rep")), None
    for order in (F.col("rep"), F.xxhash64("rep")):
        hubs = left.groupBy("bucket").agg(F.min_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("comp").alias("hub_comp")), order).alias("h")).select("bucket", "h.*")
        met = left.join(hubs.hint("merge"), "bucket").filter((F.col("comp") != F.col("hub_comp")) & fits)
        pairs = met.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
        new = materialise(_confirm(pairs, sets, percent), "neardup-links")
        links = new if links is None else links.unionAll(new)
        comps = components(links).withColumnRenamed("node", "rep")
        left = left.drop("comp").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        open_ = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
        left = materialise(left.join(open_.hint("merge"), "bucket").select(*placed.columns, "comp"), "neardup-left")
    return links.unionAll(materialise(_blocks(left, sets, percent), "neardup-links"))


def _blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that are in different components.

    A bucket is cut into blocks of about ``BLOCK`` hashes, and a group holds two blocks. A pair is
    compared in the first band that it shares.
    """
    kind = left.schema["rep"].dataType.simpleString()
    cut = left.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    rows = left.join(cut.hint("merge"), "bucket").join(sets.withColumnRenamed("key", "rep"), "rep")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "n", "hashes")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        rep, comp, n, own = (data.column(c).to_numpy() for c in ("rep", "comp", "n", "own"))
        i, j, bucket = (data.column(c)[0].as_py() for c in ("i", "j", "bucket"))
        x, y = (np.flatnonzero(own == b) for b in (i, j))
        if not len(x) or not len(y) or len(np.unique(comp)) < 2:
            return schema.empty_table()
        sets_ = [np.frombuffer(h.as_buffer(), np.uint64) for h in data.column("hashes").combine_chunks()]
        least, most = np.minimum(n[x][:, None], n[y]), np.maximum(n[x][:, None], n[y])
        test = (comp[x][:, None] != comp[y]) & (100 * least >= percent * most)
        if i == j:
            test = np.triu(test, 1)
        if test.any():
            band = np.array([bands(h, rows_of(percent)) for h in sets_]).view(np.int64)
            here = int(np.flatnonzero(band[0] == bucket)[0])
            for t in range(here):
                test &= band[x, t][:, None] != band[y, t]
        both = _shared(sets_, x, y, test)
        good = test & (100 * both >= percent * (n[x][:, None] + n[y] - both))
        p, q = np.nonzero(good)
        a, b = rep[x[p]], rep[y[q]]
        return pa.table([np.minimum(a, b), np.maximum(a, b)], schema=schema)

    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))


def _shared(sets_: list[np.ndarray], x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y, at least where ``test`` holds."""
    out = np.zeros(test.shape, np.int64)
    p, q = np.nonzero(test)
    if len(p) < 0.02 * test.size or len(p) < 200:
        for r, c in zip(p, q, strict=True):
            out[r, c] = len(np.intersect1d(sets_[x[r]], sets_[y[c]], assume_unique=True))
        return out
    row = np.repeat(np.arange(len(sets_)), [len(h) for h in sets_])
    _, col, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    # a hash in a single set is shared by none
    keep = times[col] > 1
    row, (ids, col) = row[keep], np.unique(col[keep], return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, len(ids), 2048):
        at = slice(*np.searchsorted(col, [lo, lo + 2048]))
        dense = np.zeros((len(sets_), min(2048, len(ids) - lo)), np.float32)
        dense[row[at], col[at] - lo] = 1
        out += (dense[x] @ dense[y].T).astype(np.int64)
    return out
