"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks of bounded size, and every query block meets every
candidate block: blocks are dealt to the rows and columns of a grid, a query block is sent once to
each column and a candidate block once to each row, and they meet inside the cells of the grid, which
tasks work off. Blocks hold whole numbers in as few bytes as they need, and all that is joined is dealt
out between tasks, never gathered by the driver. A pass scores all pairs and keeps, of each query's score histogram in a block,
only the bins from the top that could still hold the k-th score (at most k of them); summed over
blocks they locate the bin of the k-th score, and the next pass refines that bin until it is one
value wide. The last pass filters by the located score; a block hands on at most k rows a query,
ties by smallest id, which is exact since no more of a block can be among the k first.

Defined results: rows with a null id, a null vector or a null or non-finite component take no
part; vectors of different length do not score each other; a query with fewer than k candidates
gets them all; candidates that share a query's id are left out; repeated query rows get a result
each; scores are exact 64-bit integers, and one outside their range counts as the range's end; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialise

BINS = 256
CANDIDATES_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024
#: Rows (of query blocks) of the grid at most; its columns (of candidate blocks), unless a cell would hold more than ``HELD`` of these.
GRID = (64, 256)
HELD = 16
#: Cells and tasks a core, so that none waits long for the last.
CELLS, TASKS = 16, 4
LOW, HIGH = -(2**63), 2**63 - 1
_SUB = 128  # queries scored at once inside a block


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows (id, v) as blocks: dim, block, ids and integer components (of numpy's ``kind``) as binary, ids ascending."""
    n = max(1, -(-rows.count() // size))

    def pack(data: pa.Table) -> pa.Table:
        data = data.combine_chunks().sort_by("id")
        flat = data.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = data.column("id").to_numpy()
        whole = np.floor(scale * flat)
        norm = float(np.sqrt((whole.reshape(len(ids), -1) ** 2).sum(axis=1).max(initial=0)))
        most = np.abs(whole).max(initial=0)
        kind = next((x for x, end in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if most < end), "<f8")
        return pa.table({"dim": [data.column("dim")[0].as_py()], "block": [data.column("block")[0].as_py()], "ids": [ids.astype("<i8").tobytes()], "m": [whole.astype(kind).tobytes()], "kind": [kind], "norm": [norm]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("m", pa.binary()), ("kind", pa.string()), ("norm", pa.float64())]))

    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("block"))
    return materialise(dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, ids binary, m binary, kind string, norm double"), "topk-blocks")


def _scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products: in floats, which are single ones up to 2**24, up to 2**53, then in integers."""
    if bound < 2**53:
        return (q @ c.T).astype(np.int32 if bound < 2**24 else np.int64)
    exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in c], dtype=object).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[tuple]:
    """Per pair of blocks and run of queries: dim, query block, first position, query ids, candidate ids, scores, flat places of scores of an own id, state."""
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            qid, cid = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8")
            q, c = (np.frombuffer(row[m], row[kind]).reshape(len(ids), dim).astype(np.float32 if bound < 2**24 else np.float64) for m, kind, ids in (("qm", "qkind", qid), ("m", "kind", cid)))
            state = row["state"]
            for i in range(0, len(qid), _SUB):
                ids = qid[i : i + _SUB]
                begin, end = (np.searchsorted(cid, ids, side) for side in ("left", "right"))
                own = np.array([j for r in np.flatnonzero(begin < end) for j in range(r * len(cid) + begin[r], r * len(cid) + end[r])], np.int64)
                yield dim, row["qb"], i, ids, cid, _scores(q[i : i + _SUB], c, bound), own, None if state is None else state[i : i + _SUB]


def _reached(s: np.ndarray, least: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that are no less than their row's least and not of an own id."""
    use = (s >= least[:, None]).ravel()
    use[own] = False
    return np.divmod(np.flatnonzero(use), s.shape[1])


def _steps(s: np.ndarray, low: np.ndarray, shift: int) -> np.ndarray:
    """How many whole steps of 2**shift scores lie above ``low``, which none is below; exact for all 64-bit integers."""
    far = s - low if s.dtype == np.int32 else s.view(np.uint64) - low.view(np.uint64)
    return far >> far.dtype.type(shift)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), key and score of each query's k highest integer inner products.

    ``is_query`` marks the query rows of ``vectors``; components count as floor(scale * x).
    """
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(good)
    name = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    cand, query = _blocks(name(rows), CANDIDATES_PER_BLOCK, scale), _blocks(name(rows.filter(is_query)), QUERIES_PER_BLOCK, scale)
    most, last = zip(*(df.agg(F.max("norm"), F.max("block")).first() for df in (query, cand)), strict=True)
    bound = int(min((most[0] or 0.0) * (most[1] or 0.0) * (1 + 1e-9), 2.0**65)) + 1  # norms are rounded
    blocks = [(n or 0) + 1 for n in last]
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    columns = min(blocks[1], max(GRID[1], -(-blocks[1] // HELD)))
    lines = min(blocks[0], GRID[0], -(-CELLS * cores // columns))
    cell, tasks = ["dim", "line", "col"], min(lines * columns, TASKS * cores)
    place = lambda n: F.pmod("block", F.lit(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = cand.select("dim", place(columns).alias("col"), to(lines).alias("line"), "ids", "m", "kind").repartition(tasks, *cell)
    asked = query.select("dim", place(lines).alias("line"), F.col("block").alias("qb"), F.col("ids").alias("qids"), F.col("m").alias("qm"), F.col("kind").alias("qkind"))

    # Spark would take what is sent to many cells for as small as its blocks' files and gather it in the driver
    def meet(state: DataFrame | None) -> DataFrame:
        side = asked.withColumn("state", F.lit(None).cast("array<struct<pos:int,lo:long,need:long>>")) if state is None else asked.join(state.hint("merge"), ["dim", "qb"])
        return side.withColumn("col", to(columns)).repartition(tasks, *cell).join(held.hint("merge"), cell).select("dim", "qb", "qids", "qm", "qkind", "ids", "m", "kind", "state")

    def histogram(lo: int, shift: int, span: int, first: bool) -> object:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, qb, at, ids, _cid, s, own, state in _cells(batches, bound):
                n = len(ids)
                need = np.full(n, k) if first else np.array([x["need"] for x in state])
                if first:
                    bins = (_steps(s, np.full((n, 1), lo, s.dtype), shift).astype(np.int64) + np.arange(n)[:, None] * BINS).ravel()
                    found = np.bincount(bins, minlength=n * BINS) - np.bincount(bins[own], minlength=n * BINS)
                else:
                    low = np.array([x["lo"] for x in state], s.dtype)
                    pos, col = _reached(s, low, own)
                    bins = _steps(s[pos, col], low[pos], shift)
                    inside = bins < bins.dtype.type(span >> shift)  # above that: counted by the pass before
                    found = np.bincount(pos[inside] * BINS + bins[inside].astype(np.int64), minlength=n * BINS)
                found = found.reshape(n, BINS)
                above = np.cumsum(found[:, ::-1], axis=1)[:, ::-1] - found
                pos, bins = np.nonzero((found > 0) & (above < need[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), dim), pa.int32()), pa.array(np.full(len(pos), qb), pa.int64()), pa.array(pos + at, pa.int32()), pa.array(bins, pa.int32()), pa.array(found[pos, bins], pa.int64())], ["dim", "qb", "pos", "bin", "n"])

        return count

    # every query starts with the whole range of scores
    each = query.select("dim", F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), (F.octet_length("ids") / 8).cast("int") - 1)).alias("pos"))
    lo, span, state, flat = max(LOW, -bound), min(HIGH, bound) - max(LOW, -bound) + 1, None, None
    while True:
        shift = max(0, (span - 1).bit_length() - (BINS.bit_length() - 1))
        width = 1 << shift
        counts = meet(state).mapInArrow(histogram(lo, shift, span, state is None), "dim int, qb long, pos int, bin int, n long")
        sums = counts.groupBy("dim", "qb", "pos", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("dim", "qb", "pos").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        was = each.select("dim", "qb", "pos", F.lit(lo).cast("long").alias("lo"), F.lit(k).cast("long").alias("need")) if flat is None else flat
        kth = sums.withColumn("above", above).join(was.hint("merge"), ["dim", "qb", "pos"]).filter("above < need and above + n >= need")
        new = kth.select("dim", "qb", "pos", (F.col("lo").cast("decimal(20,0)") + F.col("bin").cast("decimal(20,0)") * F.lit(width).cast("decimal(20,0)")).cast("long").alias("lo"), (F.col("need") - F.col("above")).alias("need"))
        # with too few candidates the lowest score is the bound, and stays so
        flat = materialise(each.join(new.hint("merge"), ["dim", "qb", "pos"], "left").select("dim", "qb", "pos", F.coalesce("lo", F.lit(lo).cast("long")).alias("lo"), F.coalesce("need", F.lit(2**62)).alias("need")), "topk-state")
        state = flat.groupBy("dim", "qb").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "need"))).alias("state"))
        if width == 1:
            break
        span = width

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, qb, at, ids, cid, s, own, state in _cells(batches, bound):
            pos, col = _reached(s, np.array([x["lo"] for x in state], s.dtype), own)
            score = s[pos, col]
            order = np.lexsort((cid[col], ~score, pos))
            pos, col, score = pos[order], col[order], score[order]
            keep = np.arange(len(pos)) - np.searchsorted(pos, pos) < k
            pos, col, score = pos[keep], col[keep], score[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), dim), pa.int32()), pa.array(np.full(len(pos), qb), pa.int64()), pa.array(pos + at, pa.int32()), pa.array(ids[pos], pa.int64()), pa.array(cid[col], pa.int64()), pa.array(score.astype(np.int64), pa.int64())], ["dim", "qb", "pos", "query_id", "id", "score"])

    best = meet(state).mapInArrow(select, "dim int, qb long, pos int, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("dim", "qb", "pos").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
