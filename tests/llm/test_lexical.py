"""Ranked lexical search against a plain version, and the exactness of its skipped blocks."""

import math
import re
from collections import Counter

import numpy as np

from maskwright.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    own = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(LOW))), []
        for d, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // words
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(times * w(t) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, **names):
    return sorted(map(tuple, lexical.search(docs, items, **names).collect()), key=str)


ITEMS = [(1, "The quick FOX jumps"), (2, "word3 of line7 tail word3"), (3, None), (4, "??"), (5, "héllo wörld 😀"), (None, "two words"), (5, "no id at all"), (6, "absent-term")]


def test_edges(spark, edges, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(none, items) == [] and got(edges, items.limit(0)) == []
    assert got(edges, items) == brute([(r.doc_id, r.text) for r in edges.collect()], ITEMS)


def test_string_ids_and_names(spark):
    rows = [(f"d{i}", f"alpha beta{i % 7} gamma{i % 3} " * (1 + i % 5)) for i in range(400)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "name string, body string, rank int").repartition(5)
    items = spark.createDataFrame([("q1", "beta3 gamma1"), ("q2", "alpha")], "name string, ask string")
    assert [(a, r, d, s) for a, r, d, s in got(docs, items.withColumnRenamed("name", "item"), key="name", text="body", item="item", query="ask")] == brute(rows, [("q1", "beta3 gamma1"), ("q2", "alpha")])


def test_long_text_and_blocks_of_queries(spark, monkeypatch):
    """A text of over a million characters, many copies with one score, and queries in several blocks."""
    monkeypatch.setattr(lexical, "ENTRIES", 6)
    rows = [(0, " ".join(f"w{i % 5003}" for i in range(250_000)))] + [(i, "same words here") for i in range(1, 90)] + [(i, f"w{i} w{i + 1} here") for i in range(90, 300)]
    items = [(i, f"w{i * 31} w{i * 31 + 1} same here") for i in range(9)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    assert len(rows[0][1]) > 1_000_000
    assert got(docs, asked) == brute(rows, items)


def test_bounds_skip_nothing_that_counts():
    """Every shard's search equals scoring all its documents; some blocks are skipped."""
    rng = np.random.default_rng(5)
    impacts = np.where(rng.random((3000, 60)) < 0.15, rng.integers(1, 900_000, (3000, 60)), 0).astype(np.int32)
    impacts[:, 30:] *= rng.random((3000, 1)) < 0.1
    shard = lexical.Shard(impacts, [np.arange(60)] * 60)
    for q in range(20):
        ids = np.sort(rng.choice(60, 5, replace=False))
        w = rng.integers(1, 9000, 5)
        scores = impacts[:, ids].astype(np.int64) @ w
        want = np.lexsort((np.arange(3000), -scores))[:20]
        docs, found = shard.search(ids, w, [], 20)
        assert docs.tolist() == want[scores[want] > 0].tolist() and found.tolist() == scores[docs].tolist()
        theta = sorted(scores.tolist())[-5:] * 4
        docs, _ = shard.search(ids, w, theta, 20)
        assert set(np.flatnonzero(scores > min(theta)).tolist()) <= set(docs.tolist())
