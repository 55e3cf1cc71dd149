"""Packing documents into windows of equal capacity by Karmarkar-Karp multiway differencing.

Documents are encoded inside tasks and cut: full windows first, the rest into pieces of at most
``max_piece`` tokens. The pieces, narrow rows without ids, are dealt by their place in the table into
shards of a bounded expected size, so equal rows are dealt apart; a shard is packed by differencing. Each piece starts as a partition of k
windows of which one holds it; the two partitions with the largest imbalance merge, the fullest
window of one with the emptiest of the other, until one is left with near-equal windows. If a
window exceeds the capacity, k rises by what the measured excess asks for and the shard is packed
again; at one window a piece it always fits. Padding is then less than about two windows a shard.

Ids are those of the tokenizers file. They are computed by tiktoken over the same vocabulary's
ranks, which gives equal ids about four times as fast; texts that hold a special token's string or
a run of more than ``BLANKS`` blanks, which exhausts that library's stack, go through the tokenizers
library itself.

Defined results: a null text is empty, and an empty document is its end id alone; a null key is
kept; repeated rows are packed each; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise
from maskwright.llm.tokencount import runs

PIECES_PER_SHARD = 2048
BLANKS = 1000
_loaded: dict[str, Callable[[str], list[int]]] = {}


def encoder(vocabulary: str, ranks: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers file gives them with add_special_tokens=False."""
    if vocabulary not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        special = [x["content"] for x in json.loads(Path(vocabulary).read_text())["added_tokens"]]
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        blanks = re.compile(rf"\s{{{BLANKS},}}")

        def encode(text: str) -> list[int]:
            if any(x in text for x in special) or blanks.search(text):
                return whole.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _loaded[vocabulary] = encode
    return _loaded[vocabulary]


def cuts(total: int, capacity: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then near-equal short pieces."""
    full, rest = divmod(total, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    n = -(-rest // max_piece)
    edges = [full * capacity + rest * i // n for i in range(n + 1)] if n else []
    return out + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each piece, by multiway differencing into k windows."""
    n = len(sizes)
    nodes: list[tuple] = [()] * n
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        heap.append((-int(s), i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i, a), (_, j, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), len(nodes), sums))
        nodes.append((i, j, order))
    window = np.zeros(n, np.int64)
    stack = [(heap[0][1], np.arange(k))] if n else []
    while stack:  # place[p]: the final window of a partition's p-th window, from emptiest to fullest
        i, place = stack.pop()
        if i < n:
            window[i] = place[-1]
        else:
            left, right, order = nodes[i]
            back = np.empty(k, np.int64)
            back[order] = place
            stack += [(left, back), (right, back[::-1])]
    return window


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; the number of windows rises while one exceeds the capacity."""
    total = int(sizes.sum())
    k = -(-total // capacity)
    while k:
        found = difference(sizes, k)
        most = int(np.bincount(found, sizes, k).max())
        if most <= capacity:
            return found
        excess = most - total / k
        k = min(len(sizes), max(k + 1, -(-total // max(1, int(capacity - excess)))))
    return np.zeros(0, np.int64)


def pack(docs: DataFrame, vocabulary: str, ranks: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1, max_piece: int = 512) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            for run in runs(batch, 4_000_000):
                row, out = [], []
                for n, t in enumerate(run.column(1)):
                    ids = np.array([*encode(t.as_py() or ""), end_id], "<u4")
                    for start, length in cuts(len(ids), capacity, max_piece):
                        row.append(n)
                        out.append((start, length, zlib.crc32(ids[start : start + length]), len(ids)))
                cols = zip(*out, strict=True) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([run.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, pa.int64()) for c in cols)], ["key", "start", "length", "crc", "total"])

    pieces = materialise(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, f"key {kind}, start long, length long, crc long, total long").withColumn("place", F.monotonically_increasing_id()), "pack-pieces")
    shards = -(-pieces.count() // PIECES_PER_SHARD)

    def fill(data: pa.Table) -> pa.Table:
        data = data.combine_chunks().sort_by([("key", "ascending"), ("start", "ascending"), ("crc", "ascending"), ("place", "ascending")])
        sizes, shard = data.column("length").to_numpy(), data.column("shard")[0].as_py()
        window = np.empty(len(sizes), np.int64)
        full = sizes == capacity
        window[full] = np.arange(full.sum())
        window[~full] = windows(sizes[~full], capacity) + full.sum()
        order = np.argsort(window, kind="stable")
        placed, size = window[order], sizes[order]
        ends = np.cumsum(size) - size
        first = np.r_[True, placed[1:] != placed[:-1]]
        offset = ends - np.maximum.accumulate(np.where(first, ends, 0))
        return data.take(pa.array(order)).drop_columns(["shard", "place"]).append_column("sequence_id", pa.array((shard << 32) + placed)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(max(1, shards))))
    packed = dealt.groupBy("shard").applyInArrow(fill, f"key {kind}, start long, length long, crc long, total long, sequence_id long, offset long")
    return packed.select(F.col("key").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset")
