"""Interval joins, large lists, stored versions and percentiles against plain versions."""

import math
import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from maskwright.functions import places
from maskwright.operators import intervals, phrases, score, store


def test_intervals_by_bins(spark):
    """Spans of all lengths, hot bins and keys, empty ones; each pair once."""
    rng = random.Random(1)
    make = lambda n: [(rng.choice("ab"), s := rng.randrange(300), s + rng.choice([0, 1, 5, 40, 250]), i) for i in range(n)]
    left, right = make(120), make(90)
    schema = "k string, start long, end long, id int"
    a, b = spark.createDataFrame([*left, (None, 1, 5, 999)], schema), spark.createDataFrame([*right, (None, 1, 5, 999)], schema)
    for width in (8, 1024):
        got = sorted((r["l"]["id"], r["r"]["id"]) for r in intervals.overlapping(a, b, ["k"], width).collect())
        assert got == sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
        inside = {x[3] for x in left if any(x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2] for y in right)}
        assert sorted(r["id"] for r in intervals.contained(a, b, ["k"], width).collect()) == sorted(inside)
        assert sorted(r["id"] for r in intervals.outside(a, b, ["k"], width).collect()) == sorted({x[3] for x in left} - inside | {999})
        begun = {x[3] for x in left if any(x[0] == y[0] and y[1] <= x[1] < y[2] for y in right)}
        assert sorted(r["id"] for r in intervals.beginning_in(a, b, ["k"], width).collect()) == sorted(begun)


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_of_patterns(spark, seed):
    """Plain and starred patterns over texts of few words, at edges, beside letters outside ASCII, overlapping themselves."""
    rng = random.Random(seed)
    words = ["a", "ab", "Abc", "b.c", "x_1", "é", "(a)", "a*", "*b", "B"]
    texts = [(i, "".join(rng.choice(words[:7]) + rng.choice([" ", "  ", ".", "é", ""]) for _ in range(rng.randrange(12)))) for i in range(60)] + [(60, None), (61, "")]
    patterns = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(40)} | {"*", "a a", "A  b"})
    out = []
    for key, text in texts:
        for p in patterns:
            inner = "[A-Za-z0-9_]+".join(map(re.escape, p.split("*")))
            for m in re.finditer(rf"(?:^|[^A-Za-z0-9_])((?i:{inner}))(?=\Z|[^A-Za-z0-9_])", text or ""):
                at = len(text[: m.start(1)].encode())
                out.append((key, p, at, at + len(m[1].encode()), m[1]))
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = phrases.matched(docs, spark.createDataFrame([(p,) for p in [*patterns, None, " "]], "pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted(out)


def test_lists_refuse_too_many_wordless(spark):
    rows = spark.range(300).select(F.concat(F.lit("*"), F.repeat(F.lit("."), F.col("id").cast("int"))).alias("pattern"))
    with pytest.raises(ValueError, match="no word"):
        phrases.matched(spark.createDataFrame([(1, "a")], "doc_id int, text string"), rows)


def test_percentiles_are_nearest_ranks(spark):
    """Groups of one and many values, ties, null keys and values, values without an end, far outliers."""
    rng = random.Random(3)
    inf, nan = math.inf, math.nan
    groups = {"one": [4.0], "ties": [1.0] * 50 + [2.0], "wide": [rng.gauss(0, 1) for _ in range(500)] + [1e300, -1.7e308, 1.7e308, 5e-324], None: [3.0, None, 1.0], "odd": [-inf, 1.0, inf, inf, nan], "none": [None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = {r["k"]: r for r in score.ranked_values(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], {"a": 0.0, "b": 0.5, "c": 0.8, "d": 1.0}).collect()}
    assert "none" not in got and len(got) == 5
    for k, vs in groups.items():
        told = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v))
        for name, p in (("a", 0.0), ("b", 0.5), ("c", 0.8), ("d", 1.0)):
            if told:
                want = told[max(1, math.ceil(len(told) * p)) - 1]
                assert got[k][name] == want or got[k][name] != got[k][name] and want != want


def test_store_keeps_what_concurrent_writers_merge(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert table.version() == 0 and table.read().isEmpty()
    assert table.merge(frame([(i, "old") for i in range(10)] + [(None, "null")])) == 1
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda w: table.merge(frame([(w, f"new{w}"), (100 + w, f"new{w}")])), range(4)))
    assert sorted(versions) == [2, 3, 4, 5]
    now = {r["k"]: r["v"] for r in table.read().collect()}
    assert now == {i: f"new{i}" if i < 4 else "old" for i in range(10)} | {100 + i: f"new{i}" for i in range(4)} | {None: "null"}
    table.merge(table.read().filter("k < 5 or k is null").selectExpr("k", "v", "true as gone"), deleted="gone")
    assert sorted(r["k"] for r in table.read().collect()) == [*range(5, 10), *range(100, 104)]
    assert table.read(version=1).count() == 11
    # buckets that no change touches stay where they are
    before, at = table._manifest(table.version()), table.merge(frame([(7, "seven")]))
    assert sum(before.get(b) != w for b, w in table._manifest(at).items()) == 1


def test_phrases_move_only_hits(spark):
    """Plain patterns meet texts by pairs of words: a frequent word alone makes no candidate (F1)."""
    docs = spark.createDataFrame([(i, "the cat the dog the, end The  Cat a a a" if i else "re: the mayor of X, the mayor of Y; the  mayor of X") for i in range(3)], "doc_id int, text string")
    lists = spark.createDataFrame([(p,) for p in ("the cat", "THE DOG", "the end", "a a", "the mayor of x", "mayor", "(the cat", "of x, the")], "pattern string")
    out = phrases.matched(docs, lists)
    rows = sorted((r.doc_id, r.pattern, r.start, r.end, r.text) for r in out.filter("doc_id < 2").collect())
    assert rows == [(0, "mayor", 8, 13, "mayor"), (0, "mayor", 24, 29, "mayor"), (0, "mayor", 41, 46, "mayor"), (0, "of x, the", 14, 23, "of X, the"), (0, "the mayor of x", 4, 18, "the mayor of X"), (1, "THE DOG", 8, 15, "the dog"), (1, "a a", 34, 37, "a a"), (1, "the cat", 0, 7, "the cat")]
    # the list goes to the texts: the words of the texts are never dealt out to meet it
    listed = phrases.listed(docs.select(F.explode(F.split("text", " ")).alias("_word")), lists.select(F.col("pattern").alias("_word")), "_word", 8)
    assert "BroadcastHashJoin" in listed._jdf.queryExecution().executedPlan().toString()


def test_places_are_those_of_a_plain_scan(spark):
    """Words and pairs of odd texts, long ones and long words too; a filter drops nothing that was asked for, whatever its case (F2)."""
    rng = random.Random(5)
    some = ["a", "B_1", "Ab", "b" * 9, "C" * 300, "c" * 1000 + "d", "é", "\u212a", "\u0130", "😀", " ", "  ", ", ", ".\n", "\u00a0", "-" * 20]
    texts = ["", "a", " ", "é", "a b", "a\u212ab", "\u0130a", "x " * 3000, "Tail", "head a"] + ["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(80)]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    want, lone = [], []
    for i, t in enumerate(texts):
        w, b = [*re.finditer(rb"[A-Za-z0-9_]+", t.encode())], t.encode()
        pairs = [(i or -1, x.start(), b[x.start() : y.end()].decode(), True, x[0].lower() == y[0].lower()) for x, y in zip(w, w[1:])]
        ones = [(i or -1, x.start(), x[0].decode(), False, False) for x in w]
        want += pairs + ones
        lone += pairs or ones
    plain = lambda df: sorted((-1 if r._key is None else r._key, r._at, r._cut, r._pair, r._same) for r in df.collect())
    found = places.places(docs, "both")
    assert plain(found) == sorted(want) and plain(places.places(docs, "least")) == sorted(lone)
    assert plain(places.places(docs, "pairs").unionAll(places.places(docs, "words"))) == sorted(want)
    by = {}
    for r in found.collect():
        by.setdefault(r._cut.lower(), set()).add(r._hash)
    assert max(map(len, by.values())) == 1 and len(set.union(*by.values())) > 0.5 * len(by)
    few = found.filter("pmod(hash(lower(_cut)), 5) = 0").selectExpr("lower(_cut) as w", "_hash").distinct()
    kept, told = places.places(docs, "both", places.asked(few.select("_hash"), few.count())), {r.w for r in few.collect()}
    assert [x for x in plain(kept) if x[2].lower() in told] == sorted(x for x in want if x[2].lower() in told)
    assert kept.count() < 0.6 * len(want)


@pytest.mark.parametrize("whole", [0, 1000])
def test_counts_of_listed_phrases(spark, monkeypatch, whole):
    """Counts are those of the matches; of a long list the hits are dealt out once, by their words (F2)."""
    monkeypatch.setattr(phrases, "WHOLE", whole)
    rng = random.Random(6)
    words = ["a", "Ab", "x_1", "the", "The", "of"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "é"]) for _ in range(rng.randrange(60)))) for i in range(50)] + [(50, None)], "doc_id int, text string")
    pairs = [f"{x} {y}" for x in ("a", "ab", "the", "of") for y in ("a", "AB", "x_1", "the")]
    for more in ([], ["a a a", "the", "of x_1 the", "a*", "*"]):
        lists = spark.createDataFrame([(p,) for p in pairs + more], "pattern string")
        want = {}
        for r in phrases.matched(docs, lists).collect():
            n, first = want.get((r.doc_id, r.pattern), (0, r.start))
            want[r.doc_id, r.pattern] = n + 1, min(first, r.start)
        out = phrases.counted(docs, lists)
        assert sorted(map(tuple, out.collect())) == sorted((*k, *v) for k, v in want.items())
    # pairs of unlike words alone: no list of hits is made for a text, and a long list is met and counted after one shuffle of the hits
    out = phrases.counted(docs, spark.createDataFrame([(p,) for p in ("a ab", "the of")], "pattern string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "transform(" not in plan and plan.count("Exchange") == 2
    assert ("ShuffledHashJoin" if whole == 0 else "BroadcastHashJoin") in plan
