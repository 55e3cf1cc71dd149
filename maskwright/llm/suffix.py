"""Exact substring dedup: suffix arrays per shard, common prefixes, and merging across shards.

Equal texts are taken together first; what is left is written once, bucketed by digest, so that later
passes join narrow rows to the texts without moving them. Tasks take texts in shards of about a megabyte
(a longer text in pieces that overlap by a window less one byte) and build each shard's suffix array by
Larsson-Sadakane refinement and its common prefixes by Kasai's rule; a window of ``length`` bytes whose
suffix shares that many with a neighbour repeats inside the shard.

Across shards, binary search of every shard's suffixes in every other's array would cost the square of
the number of shards. Merging goes by anchors instead: a window's anchor is its smallest ``GRAM``-byte
string by hash, the leftmost of equal ones, so equal windows have equal anchors at equal places, and the
windows that share an anchor are one run of starts. Shards send one narrow row for each different run:
digests of the anchor and of the whole stretch that the run's windows cover. (1) An anchor that no other
row has repeats nowhere. (2) Equal stretches repeat in all their windows. (3) What is left, anchors that
stand in different stretches, is searched by halving: one row of each stretch sends its windows in
blocks by their distance from the anchor, with digests of what all windows of the block have in common
and of all that they cover. Blocks whose common part no other row has repeat nowhere, blocks that cover
the same repeat in all their windows, others are cut into smaller blocks, down to single windows. Returned rows find their place in a text by binary search over its starts.
Digests have 64 bits each and count only together with the anchor's, so two different strings are taken
as equal only if two independent 64-bit digests agree.

Defined cases: a null text is empty; texts shorter than a window lose nothing; equal texts of at least a
window lose all; rows with null or equal ids are rows of their own; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise, scratch_path

#: Bytes of a repeated string, of a shard (less than 2^23) and of an anchor; windows of a block, round by round.
LENGTH, SHARD, GRAM, BLOCKS = 200, 1 << 20, 32, (32, 8, 1)
_U = np.uint64


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of an odd number and of its inverse modulo 2^64."""
    rng = np.random.default_rng(0x5EED)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = 0x9E3779B97F4A7C15
    up, down = np.ones(1 << bits, _U), np.ones(1 << bits, _U)
    up[1:], down[1:] = _U(base), _U(pow(base, -1, 1 << 64))
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Windows:
    """Digests of all substrings of one buffer from running sums."""

    def __init__(self, s: np.ndarray):
        values, self.up, down = _powers(max(16, int(len(s)).bit_length()))
        self.sums = np.zeros(len(s) + 1, _U)
        np.cumsum(values[s] * down[: len(s)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of the substrings of one length at all places."""
        n = max(0, len(self.sums) - length)
        return self._mixed((self.sums[length:] - self.sums[:n]) * self.up[:n])

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(29)
        return x

    def digest(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self._mixed((self.sums[start + length] - self.sums[start]) * self.up[start])


def words(s: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number, zero behind the end of the place's text."""
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    out = np.ndarray((len(s),), ">u8", padded.tobytes(), strides=(1,)).astype(_U)
    near = np.flatnonzero(ends - np.arange(len(s), dtype=np.int32) < 8)
    out[near] &= ~_U(0) << (_U(8) * (_U(8) - (ends[near] - near).astype(_U)))
    return out


def suffix_array(first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of all texts of a buffer in order, each text ending in a mark of its own.

    ``first`` holds the first 8 bytes of each suffix. Groups of equal prefixes are split by the group of
    the suffix behind the prefix, which doubles its length; a group of one is never touched again.
    """
    n = len(first)
    order = np.argsort(first).astype(np.int32)
    key, slots, p, depth = first[order], np.arange(n, dtype=np.int32), order.copy(), 8
    rank, count = np.empty(n, np.int32), np.arange(n, dtype=np.int32)
    while len(p):
        head = np.empty(len(p), bool)
        head[:1] = True
        np.not_equal(key[1:], key[:-1], out=head[1:])
        start = slots[np.maximum.accumulate(np.where(head, count[: len(p)], 0))]
        rank[p] = start
        head[:-1] &= head[1:]  # now: groups of one
        left = np.flatnonzero(~head)
        slots, p, start = slots[left], p[left], start[left]
        size = ends[p] - p
        # an end comes before all bytes; the first words have zeros behind it, so shorter ones come first
        key = start.astype(np.int64) << 32
        key += np.where(size > depth, rank[np.minimum(p + depth, n - 1)] + 9 * n, np.minimum(size, 8) * n + p)
        by = np.argsort(key)
        key, p = key[by], p[by]
        order[slots] = p
        depth *= 2
    return order


def common_prefixes(s: np.ndarray, first: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the suffix before it in the order (-1: none) and the length that both share.

    Kasai's rule: the next place shares at least one byte less. Where the bytes before both are equal
    it shares exactly that, so only the other places are compared, eight bytes at a time.
    """
    n = len(s)
    places = np.arange(n, dtype=np.int32)
    before = np.empty(n, np.int32)
    before[order[:1]], before[order[1:]] = -1, order[:-1]
    mark = np.zeros(n + 1, np.int16)  # the byte before each place, or one of a kind where a text begins
    mark[1:n] = s[:-1]
    begins = np.concatenate([[0], np.flatnonzero(ends[1:] != ends[:-1]) + 1])
    mark[begins] = -1
    other = mark[before]
    a = np.flatnonzero((mark[:n] != other) | (other < 0))
    a = a[before[a] >= 0].astype(np.int32)
    own = a
    b, at = before[a], np.zeros(len(a), np.int32)
    most = np.minimum(ends[a] - a, ends[b] - b)
    shared = np.zeros(n, np.int32)
    while len(a):
        x = first[a + at] ^ first[b + at]
        bits = np.frexp((x & ~(x >> _U(1))).astype(np.float64))[1]  # of a number without ones below its first that would round up
        at = np.minimum(at + ((64 - bits) >> 3).astype(np.int32), most)
        done = (bits > 0) | (at >= most)
        shared[a[done]] = at[done]
        go = np.flatnonzero(~done)
        a, b, at, most = a[go], b[go], at[go], most[go]
    reach = np.zeros(n, np.int32)
    reach[own] = shared[own] + own
    reach[order[:1]] = order[:1]
    return before, np.maximum.accumulate(reach) - places


def runs(s: np.ndarray, ends: np.ndarray, hashes: Windows, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first start, number of starts less one, anchor's place behind the first start, digests of anchor and stretch."""
    n, width = len(s), length - GRAM + 1
    starts = np.flatnonzero(np.arange(n, dtype=np.int32) + length <= ends)
    grams = hashes.every(GRAM)
    blocks = -(-(n + width) // width)
    value = np.full(blocks * width, ~_U(0))
    value[: len(grams)] = (grams & ~_U((1 << 23) - 1)) | np.arange(len(grams), dtype=_U)
    table = value.reshape(blocks, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(right[starts], left[starts + width - 1]) & _U((1 << 23) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    lo, hi, anchor = starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts[:0], anchor[at]
    stretch = hashes.digest(lo, hi - lo + length) ^ (((anchor - lo).astype(_U) << _U(32)) + (hi - lo).astype(_U)) * _U(0x9FB21C651E98DF25)
    return lo, hi - lo, anchor - lo, grams[anchor], stretch


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def shard_rows(ids: list[int], offsets: list[int], copies: list[bool], parts: list[bytes], length: int) -> pa.RecordBatch:
    """Of one shard's pieces of texts: repeated starts (no anchor) and the different runs (anchor, stretch, weight)."""
    s = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    bounds = np.cumsum(sizes)
    ends, piece = np.repeat(bounds.astype(np.int32), sizes), np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    first = words(s, ends)
    before, shared = common_prefixes(s, first, ends, suffix_array(first, ends))
    hit = np.flatnonzero(shared >= length)
    repeated = np.zeros(len(s), bool)
    repeated[hit] = repeated[before[hit]] = True
    tid, shift, twice = np.array(ids), np.array(offsets) - (bounds - sizes), np.array(copies)
    out = []
    # a run of repeated starts never crosses a text's end, where fewer bytes than a window are left
    a, b = intervals(repeated)
    keep = ~twice[piece[a]]
    a, b = a[keep], b[keep]
    out.append((tid[piece[a]], a + shift[piece[a]], b - a, *[np.zeros(len(a), np.int64)] * 4))
    lo, span, off, anchor, stretch = runs(s, ends, Windows(s), length)
    by = np.lexsort((lo, stretch, anchor))
    lo, span, off, anchor, stretch = lo[by], span[by], off[by], anchor[by], stretch[by]
    new = np.ones(len(lo), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(lo)))
    held = np.maximum.reduceat(twice[piece[lo]], at) if len(at) else np.zeros(0, bool)
    lo, span, off, anchor, stretch = lo[at], span[at], off[at], anchor[at], stretch[at]
    out.append((tid[piece[lo]], lo + shift[piece[lo]], span, off, anchor.view(np.int64), stretch.view(np.int64), np.where((count > 1) | held, 2, 1)))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
    none = cols[6] == 0
    return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4], mask=none), pa.array(cols[5]), pa.array(cols[6].astype(np.int32))], names=["tid", "lo", "span", "off", "anchor", "stretch", "weight"])


def _sharded(texts: DataFrame, length: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, copies, parts, held = [], [], [], [], 0
        for batch in batches:
            for tid, many, body in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                body = body.as_buffer()
                step = SHARD - length
                for at in range(0, max(1, body.size - length + 1), step):
                    part = body[at : at + step + length - 1]
                    ids.append(tid.as_py())
                    offsets.append(at)
                    copies.append(many.as_py())
                    parts.append(part)
                    held += len(part)
                    if held >= SHARD:
                        yield shard_rows(ids, offsets, copies, parts, length)
                        ids, offsets, copies, parts, held = [], [], [], [], 0
        if parts:
            yield shard_rows(ids, offsets, copies, parts, length)

    rows = texts.select("tid", (F.col("n_rows") > 1).alias("many"), "body")
    return rows.mapInArrow(build, "tid long, lo long, span int, off int, anchor long, stretch long, weight int")


def _blocks(asked: DataFrame, length: int, size: int) -> DataFrame:
    """The asked runs (array of lo, span, off, anchor, weight) of each text in blocks of ``size`` windows by their distance from the anchor.

    Columns: tid, lo, span, off, anchor, block, common (digest of what all windows of the whole block
    have in common), covered (of what the run's windows in the block cover) and weight.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, body, run in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                hashes = Windows(np.frombuffer(body.as_buffer(), np.uint8))
                lo, span, off, anchor, weight = (x.to_numpy().astype(np.int64) for x in run.values.flatten())
                near, far = (off - span) // size, off // size  # blocks by distance
                count = far - near + 1
                k = np.repeat(np.arange(len(lo)), count)
                block = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[k]
                at = lo[k] + off[k]  # the anchor
                first = np.maximum(at - (block + 1) * size + 1, lo[k])
                last = np.minimum(at - block * size, lo[k] + span[k])
                common = hashes.digest(at - block * size, length - size + 1)
                covered = hashes.digest(first, last - first + length) ^ ((at - first).astype(_U) << _U(32)) ^ (last - first).astype(_U)
                out = [np.full(len(k), tid.as_py()), first, (last - first).astype(np.int32), (at - first).astype(np.int32), anchor[k], block.astype(np.int32), common.view(np.int64), covered.view(np.int64), weight[k].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["tid", "lo", "span", "off", "anchor", "block", "common", "covered", "weight"])

    return asked.select("tid", "body", "runs").mapInArrow(emit, "tid long, lo long, span int, off int, anchor long, block int, common long, covered long, weight int")


def _cut(marked: DataFrame, length: int) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256) of texts with their repeated starts (array of lo, span)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for body, run in zip(batch.column(1), batch.column(2), strict=True):
                s = np.frombuffer(body.as_buffer(), np.uint8)
                lo, span = (x.to_numpy() for x in run.values.flatten())
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + span + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(len(intervals(gone)[0]))
                kept.append(hashlib.sha256(s[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["digest", "n_removed", "n_spans", "kept_sha256"])

    return marked.select("digest", "body", "runs").mapInArrow(cut, "digest binary, n_removed long, n_spans long, kept_sha256 string")


def repeated_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document what is left without the bytes of strings of ``length`` bytes that start anywhere else too.

    Columns: key, n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept_sha256.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), body.alias("body")).withColumn("sha", F.sha2("body", 256)).withColumn("digest", F.unhex("sha"))
    long = rows.filter(F.octet_length("body") >= length)
    texts = long.groupBy("digest").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n_rows")).withColumn("tid", F.monotonically_increasing_id())
    name, buckets = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one file a bucket: the texts lie by digest already
    texts.write.bucketBy(buckets, "digest").format("parquet").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    found = materialise(_sharded(texts, length), "runs")
    sent = found.filter("anchor is not null")
    # (1) anchors of at least two rows; different stretches go on to single windows
    shared = sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("stretch") != F.max("stretch")).alias("mixed")).filter("n > 1").drop("n")
    met = materialise(sent.join(shared, "anchor"), "shared-runs")
    # texts stream past a hash table of a bucket's narrow rows, so they are not sorted either
    place = texts.select("tid", "digest")
    whole, rows_of = lambda rows, keys, same: rows.join(same.filter("n > 1").select(*keys), keys).select("tid", "lo", "span"), F.struct("tid", "lo", "span", "off")
    # (2) equal stretches
    groups = materialise(met.groupBy("anchor", "stretch", "mixed").agg(F.sum("weight").alias("n"), F.min(rows_of).alias("of")), "stretches")
    same = whole(met, ["anchor", "stretch"], groups)
    # (3) one row of each different stretch, in smaller and smaller blocks
    left = groups.filter("mixed")
    for size in BLOCKS:
        runs_of = F.collect_list(F.struct(F.col("of.lo").alias("lo"), F.col("of.span").alias("span"), F.col("of.off").alias("off"), "anchor", F.least(F.col("n"), F.lit(2)).cast("int").alias("weight")))
        asked = left.groupBy(F.col("of.tid").alias("tid")).agg(runs_of.alias("runs")).join(place, "tid")
        blocks = materialise(_blocks(texts.select("digest", "body").join(asked.hint("shuffle_hash"), "digest"), length, size), f"blocks-{size}")
        keys = ["anchor", "block", "common", "covered"]
        groups = blocks.groupBy(*keys).agg(F.sum("weight").alias("n"), F.min(rows_of).alias("of"))
        both = groups.groupBy(*keys[:3]).agg(F.sum("n").alias("all"), (F.min("covered") != F.max("covered")).alias("mixed")).filter("all > 1").drop("all")
        groups = materialise(groups.join(both, keys[:3]), f"groups-{size}")
        same = same.unionAll(whole(blocks, keys, groups))
        left = groups.filter("mixed")
    marks = found.filter("anchor is null").select("tid", "lo", "span").unionAll(same)
    marks = marks.groupBy("tid").agg(F.collect_list(F.struct("lo", "span")).alias("runs"))
    marks = marks.join(place, "tid")
    alone = texts.filter("n_rows = 1").select("digest", "body").join(marks.hint("shuffle_hash"), "digest")
    nothing = hashlib.sha256(b"").hexdigest()
    copies = texts.filter("n_rows > 1").select("digest", F.octet_length("body").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"))
    cut = materialise(_cut(alone, length).unionAll(copies), "cut")
    spark.sql(f"drop table {name}")
    rows = rows.select("key", F.octet_length("body").cast("long").alias("n_bytes"), "sha", F.col("digest").alias("d"))
    out = rows.join(cut, rows["d"] == cut["digest"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("key").alias(key), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
