"""Merkle manifest against a plain version over one list of rows."""

import hashlib
import zlib

from pyspark.sql import functions as F

from maskwright.llm import merkle, queries
from maskwright.llm.common import crc_fold

h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
low = str.maketrans(queries.UPPER, queries.UPPER.lower())


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def rise(nodes):
    """All levels of a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def walk(levels, i):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
        i //= 16


def brute(rows):
    by = {}
    for r in rows:
        leaf = h(*(field(r[f]) for f in merkle.FIELDS))
        changed = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0
        now = h(*(field(r[f].translate(low) if f == "text" and r[f] is not None else r[f]) for f in merkle.FIELDS)) if changed else leaf
        by.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"]), leaf, now))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [rise([x[1] for x in sorted(by[s], key=lambda x: (x[0][0], x[0][1] or 0, x[1]))]) for s in order]
    top = rise([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (key, leaf, now) in enumerate(sorted(by[s], key=lambda x: (x[0][0], x[0][1] or 0, x[1]))):
            steps = [*walk(trees[k], i), *walk(top, k)]
            folded = now
            for a, b in steps:
                folded = h(a, folded, b)
            out.append((key[1], leaf, trees[k][-1][0], top[-1][0], h(*(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def got(docs):
    out = merkle.manifest(docs, crc_fold(F.col("doc_id"), 5) == 0, F.translate("text", queries.UPPER, queries.UPPER.lower()))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


def test_edges_and_one_row(edges, none):
    assert got(none) == []
    assert got(edges) == brute(edges.collect())
    one = edges.limit(1)
    assert got(one) == brute(one.collect())


def test_runs_of_every_size(spark):
    """Trees of 1 to 300 leaves, a hot source, more sources than one run holds, one null."""
    rows = [(i, f"Text {i}", "en", None if i % 97 == 0 else f"s{i % 19}" if i % 3 else "hot", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert got(docs) == brute(docs.collect())
    assert {r[-1] for r in got(docs)} == {True, False}
