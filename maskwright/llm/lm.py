"""Language-model scores by deleted interpolation of bigram and unigram estimates.

P(w | v) = l * c(v w) / c(v) + (1 - l) * P(w): the maximum-likelihood bigram and the smoothed
unigram estimate, with a weight l for each bucket of context frequencies, floor(log2 c(v)). The
weights come from expectation-maximisation on held-out counts: each training document is scored
with its own occurrences deleted from all counts.

Counting moves sorted key lists, not tokens. Documents are written once in blocks of about
``BLOCK_BYTES``. A block sends each of its distinct n-grams (64-bit hashes) and its training count
once to the task for the hash range, which sums over blocks and answers with the counts in the
block's order; so a frequent word or pair costs one entry a block, and a block names only the ranges that it has
n-grams in, so lists never outnumber the n-grams of all blocks. Blocks are then read twice:
for the statistics of the weights, summed to one small table, and for the scores. A unigram or
bigram is thus counted over all training documents, and no list of the corpus's n-grams meets in
one place.

A training text is scored with its own counts in the model, as any text that the model knows: texts
that occur twice in training differ little from texts that occur once. Ratios of the estimates are
binned by an eighth of an octave for the weights, so a ratio is off by a sixteenth of an octave (4.4 %)
at most; ratios beyond 40 octaves count as 40.

Defined results: a null text is empty, one end token; a null key is kept; with nothing to learn
from, N = V = 0 and every token has base probability 1; a context that training never saw leaves
the unigram estimate; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from maskwright.llm.common import materialise
from maskwright.llm.neardup import _M1, _M2, _words, mixed

BLOCK_BYTES = 4_000_000
#: Bytes of text for each hash range of n-grams.
RANGE_BYTES = 8_000_000
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
BUCKETS, STEPS, REACH = 40, 8, 40  # of contexts; ratio bins per octave; octaves either way
UNIGRAM, BIGRAM = 0, 1


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of an integer array, by byte planes and compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _expand(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the text's words, A-Z lower-cased, and of one end."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


class Block:
    """Tokens of a block's documents with their distinct unigrams and bigrams."""

    def __init__(self, data: bytes, lengths: list[int], train: list[bool]) -> None:
        text, ends = zstandard.ZstdDecompressor().decompress(data) if data else b"", np.cumsum([0, *lengths])
        docs = [tokens(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        sizes = np.array([len(x) for x in docs])
        self.starts = np.cumsum(sizes) - sizes
        token = np.concatenate(docs)
        context = np.r_[START, token[:-1]]
        context[self.starts] = START
        self.train = np.repeat(np.array(train, bool), sizes)
        self.grams = [np.unique(x, return_inverse=True) for x in (mixed(token), mixed(mixed(context) * _M2 + token * _M1))]

    def own(self, kind: int) -> np.ndarray:
        """How often each token's n-gram occurs in the token's own document."""
        keys, at = self.grams[kind]
        doc = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(at)]))
        _, pair, times = np.unique(doc * len(keys) + at, return_inverse=True, return_counts=True)
        return times[pair]

    def counts(self, kind: int) -> np.ndarray:
        keys, at = self.grams[kind]
        return np.bincount(at[self.train], minlength=len(keys)).astype(np.uint32)


def _blocks(docs: DataFrame, learnable: Column, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            keys, train, texts = zip(*held, strict=True)
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            cols = [pa.array([base + n]), pa.array([keys], pa.list_(kinds)), pa.array([train], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([data], pa.binary()), pa.array([size])]
            return pa.RecordBatch.from_arrays(cols, ["block", "keys", "train", "lengths", "data", "bytes"])

        for batch in batches:
            kinds = batch.column(0).type
            for k, t, x in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                held.append((k.as_py(), bool(t.as_py()), x.as_py() or b""))
                size += len(held[-1][2]) + 64
                if size >= BLOCK_BYTES:
                    yield block()
                    n, held, size = n + 1, [], 0
        if held:
            yield block()

    rows = docs.select(F.col(key).alias("key"), learnable.alias("train"), F.col(text).cast("binary").alias("t"))
    return materialise(rows.mapInArrow(gather, f"block long, keys array<{kind}>, train array<boolean>, lengths array<int>, data binary, bytes long"), "lm-blocks")


def _counts(blocks: DataFrame, ranges: int) -> DataFrame:
    """block, kind, part and the training counts of the block's n-grams in that hash range.

    Rows with block -1 hold, in two numbers, the distinct n-grams in training and their sum.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, out = Block(row["data"], row["lengths"], row["train"]), []
                for kind in (UNIGRAM, BIGRAM):
                    keys, counts = b.grams[kind][0], b.counts(kind)
                    # only the ranges that the block has keys in
                    parts, first = np.unique(((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), return_index=True)
                    for p, lo, hi in zip(parts.tolist(), first, [*first[1:], len(keys)], strict=True):
                        out.append((row["block"], kind, p, _squeeze(np.diff(keys[lo:hi], prepend=np.uint64(0))), _squeeze(counts[lo:hi])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "kind", "part", "grams", "counts"])

    def total(data: pa.Table) -> pa.Table:
        kind, part = (data.column(c)[0].as_py() for c in ("kind", "part"))
        keys = [np.cumsum(_expand(x.as_py(), "<u8"), dtype=np.uint64) for x in data.column("grams")]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        counts = np.concatenate([_expand(x.as_py(), "<u4") for x in data.column("counts")])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, counts).astype(np.uint64)
        parts = np.split(sums[at], cuts)
        blocks_ = [*data.column("block").to_pylist(), -1]
        told = np.array([np.count_nonzero(sums), sums.sum()], np.uint64)
        return pa.table([pa.array(blocks_, pa.int64()), pa.array([kind] * len(blocks_), pa.int64()), pa.array([part] * len(blocks_), pa.int64()), pa.array([_squeeze(x) for x in [*parts, told]], pa.binary())], ["block", "kind", "part", "counts"])

    sent = blocks.select("block", "train", "lengths", "data").mapInArrow(send, "block long, kind long, part long, grams binary, counts binary")
    return materialise(sent.groupBy("kind", "part").applyInArrow(total, "block long, kind long, part long, counts binary"), "lm-counts")


def _read(batches: Iterator[pa.RecordBatch], n: int, v: int, n_docs: int) -> Iterator[tuple]:
    """Per block: row, block, counts of token, bigram and context, and the unigram estimate."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            b = Block(row["data"], row["lengths"], row["train"])
            c1, c2 = (np.concatenate([_expand(x["counts"], "<u8") for x in row["counts"] if x["kind"] == kind])[b.grams[kind][1]].astype(np.float64) for kind in (UNIGRAM, BIGRAM))
            context = np.r_[0.0, c1[:-1]]
            context[b.starts] = n_docs
            yield row, b, c1, c2, context, (c1 + 0.5) / (n + 0.5 * (v + 1))


def weights(table: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weight of the bigram estimate per bucket, by EM on counts per bucket and ratio bin.

    Column 0 counts tokens whose deleted bigram estimate is 0; the others hold the ratio of the
    bigram to the unigram estimate in steps of 1 / ``STEPS`` octave.
    """
    ratio = np.r_[0.0, 2.0 ** ((np.arange(table.shape[1] - 1) + 0.5) / STEPS - REACH)]
    out = np.zeros(len(table))
    for b, row in enumerate(table):
        if row.sum():
            w = 0.5
            for _ in range(rounds):
                w = float((row * (w * ratio / (w * ratio + 1 - w))).sum() / row.sum())
                w = min(max(w, 1e-6), 1 - 1e-6)
            out[b] = w
    return out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1)


def score(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(docs, learnable, key, text)
    told = blocks.agg(F.sum("bytes").alias("bytes"), F.sum(F.size(F.filter("train", lambda x: x))).alias("docs")).first()
    counts = _counts(blocks, max(1, -(-(told["bytes"] or 0) // RANGE_BYTES)))
    v = n = 0
    for r in counts.filter(f"block = -1 and kind = {UNIGRAM}").select("counts").toLocalIterator():  # two numbers a range
        v, n = (int(x + y) for x, y in zip((v, n), _expand(bytes(r["counts"]), "<u8"), strict=True))
    n_docs = int(told["docs"] or 0)
    answers = counts.filter("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "part", "counts"))).alias("counts"))
    full = blocks.join(answers, "block").select("keys", "train", "lengths", "data", "counts")

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, c1, c2, context, _p in _read(batches, n, v, n_docs):
            own1, own2 = b.own(UNIGRAM), b.own(BIGRAM)
            mine = np.r_[1, own1[:-1]]
            mine[b.starts] = 1
            size = np.repeat(np.diff(np.r_[b.starts, len(c1)]), np.diff(np.r_[b.starts, len(c1)]))
            use = b.train & (context > mine)
            rest = (context - mine)[use]
            p2 = (c2 - own2)[use] / rest
            p1 = (c1 - own1 + 0.5)[use] / (n - size[use] + 0.5 * (v + 1))
            with np.errstate(divide="ignore"):
                at = np.where(p2 > 0, 1 + np.clip((np.log2(p2 / p1) + REACH) * STEPS, 0, 2 * REACH * STEPS - 1), 0).astype(np.int64)
            found = np.bincount(_bucket(rest) * (2 * REACH * STEPS + 1) + at)
            cell = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(found[cell], pa.int64())], ["cell", "n"])

    width = 2 * REACH * STEPS + 1
    table = np.zeros(BUCKETS * width)
    for r in full.mapInArrow(statistics, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS * width rows
        table[r["cell"]] = r["n"]
    mix = weights(table.reshape(BUCKETS, width))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b, c1, c2, context, p1 in _read(batches, n, v, n_docs):
            seen = context > 0
            w = np.where(seen, mix[_bucket(context)], 0.0)
            p = w * c2 / np.where(seen, context, 1.0) + (1 - w) * p1
            add = lambda x, b=b: np.add.reduceat(x, b.starts)
            cols = [pa.array(row["keys"], types["key"]), pa.array(row["train"]), pa.array(add(np.ones(len(p), np.int64))), pa.array(add((c1 > 0).astype(np.int64))), pa.array(add(np.log10(p1))), pa.array(add(np.log10(p)))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "train", "n_tokens", "n_known", "base_score", "score"])

    types = {"key": to_arrow_type(docs.schema[key].dataType)}
    found = full.mapInArrow(scored, f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")

