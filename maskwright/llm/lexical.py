"""Ranked lexical search with per-term geometric blocking and exact summary bounds.

Queries come in blocks of a bounded number of (item, term) entries; each block meets all documents. A
first pass turns whole texts into term frequencies over the block's vocabulary and each text's length;
from these come the corpus statistics. Then tasks take their documents in shards whose matrix has a
bounded number of cells. A shard's index holds, for each term, its posting list cut into blocks of
similar documents: as many pivots as blocks are wanted, every posting with its nearest pivot by the
angle between projections of their vectors. Each block stores the coordinatewise maximum of its
documents' impacts, over the coordinates that queries with this term can ask for. A query's bound for
a block is the product of its weights with that summary, in the same 64-bit integers as scores, so a
block is skipped only if no document in it can reach the query's 20th score so far; all others are
scored in full. A task keeps the best of all its shards, and these few rows a task and query are ranked
at the end.

Defined cases: a null text, or one without a term, is no document (it counts nowhere); items without
terms, and all items where no document has a term, have no rows; documents with a null id are ranked
after others of their score; rows with equal ids are documents of their own; items with a null id or
equal ids are ranked each on its own rows, told apart by text; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialise

#: Entries (item, term) of a block of queries, cells of a shard's matrix and documents of a shard at most.
ENTRIES, CELLS, SHARD = 1 << 14, 1 << 23, 8192
#: Postings that a block should have, and dimensions of the projections that tell similar documents.
BLOCK, DIMENSIONS = 32, 16

# a term is a run of ASCII letters, digits and bytes of other characters; only A-Z are lower-cased
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TERMS).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, n, term, tf) of every document with a term: its length in terms and its terms of the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            lengths, ids, tfs = [], [], []
            for value in batch.column(1):
                words = terms(value.as_py())
                own = {known[w]: c for w, c in Counter(words).items() if w in known}
                lengths.append(len(words))
                ids.append(sorted(own))
                tfs.append([own[t] for t in ids[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "term", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("body")).mapInArrow(count, f"id {kind}, n long, term array<int>, tf array<bigint>").filter("n > 0")


class Shard:
    """The blocked index of some documents, given in the order in which ties are broken.

    ``impacts`` is the documents' matrix over the vocabulary, ``asked`` the coordinates that queries
    with a term can ask for.
    """

    def __init__(self, impacts: np.ndarray, asked: list[np.ndarray]):
        self.impacts, self.asked = impacts, asked
        angles = impacts.astype(np.float32) @ np.random.default_rng(impacts.shape[1]).standard_normal((impacts.shape[1], DIMENSIONS), dtype=np.float32)
        self.angles = angles / np.maximum(np.linalg.norm(angles, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for t in np.flatnonzero(impacts.any(axis=0)):
            self.lists[int(t)] = self.blocked(int(t))

    def blocked(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings by block, where blocks begin, and the blocks' summaries over ``asked[t]``."""
        postings = np.flatnonzero(self.impacts[:, t])
        pivots = postings[:: max(BLOCK, -(-len(postings) // 256))]  # at most 256 of them
        near = np.argmax(self.angles[postings] @ self.angles[pivots].T, axis=1)
        order = np.argsort(near, kind="stable")
        begins = np.flatnonzero(np.diff(near[order], prepend=-1))
        postings = postings[order]
        return postings, begins, np.maximum.reduceat(self.impacts[np.ix_(postings, self.asked[t])], begins, axis=0)

    def search(self, ids: np.ndarray, weights: np.ndarray, best: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that can be among the ``k`` best, given the scores of the best so far."""
        parts = [(t, *self.lists[t]) for t in ids.tolist() if t in self.lists]
        none = np.empty(0, np.int64)
        if not parts:
            return none, none
        bounds = np.concatenate([summary[:, np.searchsorted(self.asked[t], ids)].astype(np.int64) @ weights for t, _, _, summary in parts])
        starts = np.concatenate([b for _, _, b, _ in parts])
        ends = np.concatenate([np.append(b[1:], len(p)) for _, p, b, _ in parts])
        lists = np.repeat(np.arange(len(parts)), [len(b) for _, _, b, _ in parts])
        order = np.argsort(-bounds, kind="stable")
        seen, docs, scores = np.zeros(len(self.impacts), bool), none, none
        kth = min(best) if len(best) >= k else 0
        i = 0
        while i < len(order):
            take = order[i : i + max(4, i)]  # twice as many blocks each time
            take = take[bounds[take] >= max(kth, 1)]
            i += max(4, i)
            if not len(take):
                break  # bounds fall, so no later block can hold a document of the best
            new = np.unique(np.concatenate([parts[lists[b]][1][starts[b] : ends[b]] for b in take.tolist()]))
            new = new[~seen[new]]
            seen[new] = True
            got = self.impacts[np.ix_(new, ids)].astype(np.int64) @ weights
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, got])
            keep = np.lexsort((docs, -scores))[:k]
            keep = keep[scores[keep] > 0]
            docs, scores = docs[keep], scores[keep]
            every = np.sort(np.concatenate([np.array(best, np.int64), scores]))[::-1]
            kth = int(every[k - 1]) if len(every) >= k else 0
        return docs, scores


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows in tables of at most ``rows``."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _ranked(found: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, docs_n: int, words_n: int, k: int) -> DataFrame:
    """(query, id, score): the best ``k`` of each task and query, where query is the place in ``queries``."""
    asked: list[set[int]] = [set() for _ in weights]
    for ids, _ in queries:
        for t in ids.tolist():
            asked[t].update(ids.tolist())
    plan = ([np.array(sorted(a), np.int64) for a in asked], [(ids, weights[ids] * counts) for ids, counts in queries])
    held = found.sparkSession.sparkContext.broadcast(plan)
    width = max(1, len(weights))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, wanted = held.value
        best: list[list[tuple]] = [[] for _ in wanted]  # (minus score, null id, id)
        kind = None
        for table in _shards(batches, max(1, min(SHARD, CELLS // width))):
            kind = table.schema.field("id").type
            table = table.take(pc.sort_indices(table.column("id"), null_placement="at_end"))  # a row's place breaks ties
            names = table.column("id")
            n = table.column("n").to_numpy()
            rows = np.repeat(np.arange(len(n)), pc.list_value_length(table.column("term")).to_numpy())
            term, tf = pc.list_flatten(table.column("term")).to_numpy(), pc.list_flatten(table.column("tf")).to_numpy()
            m = 100 - 25 + (25 * n * docs_n) // words_n
            impacts = np.zeros((len(n), width), np.int32)
            impacts[rows, term] = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows])
            shard = Shard(impacts, reach)
            for q, (ids, w) in enumerate(wanted):
                docs, scores = shard.search(ids, w, [-b[0] for b in best[q]], k)
                if len(docs):
                    new = [(-s, x is None, x) for s, x in zip(scores.tolist(), names.take(pa.array(docs)).to_pylist(), strict=True)]
                    best[q] = sorted([*best[q], *new], key=lambda b: (b[0], b[1], 0 if b[1] else b[2]))[:k]
        if kind is not None:
            flat = [(q, *b) for q, each in enumerate(best) for b in each]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[3] for f in flat], kind), pa.array([-f[1] for f in flat], pa.int64())], names=["query", "id", "score"])

    return found.select("id", "n", "term", "tf").mapInArrow(rank, f"query int, id {found.schema['id'].dataType.simpleString()}, score long")


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms in blocks of at most ``ENTRIES`` entries, or one item with more; one block is held at a time."""
    block, entries = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        own = Counter(terms(row["t"]))
        if block and entries + len(own) > ENTRIES:
            yield block
            block, entries = [], 0
        if own:
            block.append((row["k"], own))
            entries += len(own)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", k: int = 20) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item, rank (from 1), key, score.

    N documents have a term, L terms altogether, n terms in a document; a term that df documents hold
    weighs ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and tf occurrences give it the impact
    ``1e9 tf div (1000 tf + 12 m)`` with ``m = 75 + 25 n N div L``. Equal scores go by the key.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"{item} {items.schema[item].dataType.simpleString()}, rank int, {key} {docs.schema[key].dataType.simpleString()}, score long")
    for b, block in enumerate(_blocks(items, item, query)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        queries = []
        for _, own in block:
            ids = np.array(sorted(vocabulary[t] for t in own), np.int64)
            counts = {vocabulary[t]: c for t, c in own.items()}
            queries.append((ids, np.array([counts[i] for i in ids.tolist()], np.int64)))
        found = materialise(vectors(docs, vocabulary, key, text), f"vectors-{b}")
        docs_n, words_n = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not docs_n:
            return out
        df = dict(found.select(F.explode("term").alias("t")).groupBy("t").count().collect())  # at most the block's vocabulary
        weights = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        near = _ranked(found, queries, weights, docs_n, words_n, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"query int, name {items.schema[item].dataType.simpleString()}")
        out = out.unionAll(top.join(F.broadcast(names), "query").select(F.col("name").alias(item), "rank", F.col("id").alias(key), "score"))  # a block's items
    return out
