"""Suffix arrays, common prefixes and exact substring dedup against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import suffix


def brute(rows, length):
    """Windows counted over all texts, at their starts."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((key, len(t), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, **more):
    out = suffix.repeated_removed(docs, **more)
    assert out.columns[1:] == ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_arrays():
    """Order, prefixes with the neighbour, and that a neighbour shares the most, over texts of few letters."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        parts = [bytes(rng.choice([97, 98, 0], rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        s, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        first = suffix.words(s, ends)
        order = suffix.suffix_array(first, ends)
        before, shared = suffix.common_prefixes(s, first, ends, order)
        own = lambda i: s[i : ends[i]].tobytes()  # noqa: B023, E731
        same = lambda i, j: next((k for k, (a, b) in enumerate(zip(own(i), own(j), strict=False)) if a != b), min(len(own(i)), len(own(j))))  # noqa: B023, E731
        assert [own(i) for i in order] == sorted(own(i) for i in range(len(s)))
        assert all(before[b] == a and shared[b] == same(a, b) for a, b in zip(order[:-1], order[1:], strict=True))
        for r, i in enumerate(order):
            near = [same(i, order[q]) for q in (r - 1, r + 1) if 0 <= q < len(s)]
            assert max(near, default=0) == max((same(i, j) for j in order if j != i), default=0)


def test_edges(spark, edges, none):
    assert got(none) == []
    assert got(edges) == brute([(r.doc_id, r.text) for r in edges.collect()], 200)


@pytest.mark.parametrize(("shard", "length"), [(1 << 22, 200), (1500, 200), (700, 64)])
def test_copies_edits_and_shared_passages(spark, monkeypatch, shard, length):
    """Exact and edited copies, a passage in many texts, repeats inside a text, runs of one letter; shards of every size."""
    monkeypatch.setattr(suffix, "SHARD", shard)
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, base = prose(60), prose(300)
    rows = []
    for i in range(40):
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append(" ".join(words))
    rows += [prose(rng.randint(0, 40)) + " " + passage[rng.randint(0, 60) :] + " " + prose(rng.randint(0, 60)) for _ in range(60)]
    rows += [rows[0], rows[50], rows[50], "z" * 900, "z" * 150 + prose(90), "zz" + "y" * 230, "q" * 199, "q" * 199, "r" * 200, "r" * 200, prose(50) * 3, None, ""]
    rows = list(enumerate(rows)) + [(None, passage), (3, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(docs, length=length) == brute(rows, length)


def test_long_text(spark):
    """A text of more than a shard with a passage far apart, and string ids."""
    rng = random.Random(5)
    piece = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = piece(500)
    big = piece(2_600_000) + shared + piece(2_600_000) + shared[100:] + piece(100)
    docs = spark.createDataFrame([("a", big), ("b", "short " + shared[:150]), ("c", piece(300) + shared[:250])], "name string, text string")
    out = {r[0]: r for r in got(docs, key="name")}
    assert out["a"][1:4] == (len(big), 500 + 400, 2) and out["b"][2] == 0 and out["c"][2:4] == (250, 1)
    at = big.index(shared)
    kept = big[:at] + big[at + 500 : at + 500 + 2_600_000] + big[-100:]
    assert out["a"][4] == hashlib.sha256(kept.encode()).hexdigest()
