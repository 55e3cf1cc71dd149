"""Whole texts, repeated rows and brute-force versions of what the first tests leave out."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as P
from maskwright.llm import fingerprint, langid, lm, packing, quality, tokencount, topk
from maskwright.llm.common import crc_fold, scratch_path
from test_operators import WORD, _text, rows

DIR = "/root/testdata/sf0.001"


# Fingerprints ----------------------------------------------------------------------------------


def _evaluate(spark, expression, **columns):
    kinds = ", ".join(f"{k} array<bigint>" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], kinds).select(F.expr(expression).alias("x")).first()["x"]


def test_peeling_counts_what_differs(spark):
    """A difference of sketches gives back exactly the digests that one side has alone, at the first size that holds them."""
    rng = random.Random(2)
    new = lambda n: [rng.getrandbits(63) * 2 - 2**63 for _ in range(n)]
    for same, plus, minus in ((5, 0, 0), (200, 1, 2), (3, 4, 3), (0, 9, 7), (40, 30, 45)):
        both, a, b = new(same), new(plus), new(minus)
        entries = [*both, *a, *(d | 1 for d in both), *(d | 1 for d in b)]
        got = _evaluate(spark, fingerprint._decoded("v"), v=entries)
        assert got.asDict() == {"plus": plus, "minus": minus, "done": True}
    # twelve cells cannot hold sixty digests, and say so
    small = _evaluate(spark, fingerprint._peel(fingerprint._sketch("v", "2"), "2"), v=new(60))
    assert not small["done"]


def test_fingerprint_of_many_paragraphs(spark):
    """Every sentence of long texts that share a part is told by peeling."""
    rng = random.Random(4)
    base = [f"Sentence {i} {rng.random()}." for i in range(3000)]
    data = [(1, " ".join(base)), (2, " ".join(base[1000:] + [f"Other {i}." for i in range(500)])), (3, "x" * 1_100_000)]
    got = {r["doc_id"]: r for r in rows(fingerprint.fingerprints(spark.createDataFrame(data, "doc_id long, text string")))}
    sets = {k: set(re.findall(r"[^\n.!?]{1,200}[\n.!?]*|[\n.!?]+", t)) for k, t in data}
    assert math.isclose(got[2]["near_next"], len(sets[2] & sets[1]) / len(sets[2] | sets[1])) and got[2]["near_next"] > 0.5


# Packing -----------------------------------------------------------------------------------------


def _packed(spark, vocab, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return rows(packing.pack(df, vocab("byte_bpe_50k.json"), vocab("byte_bpe_50k.tiktoken")))


def test_packing_of_runs(spark, vocab):
    """Very long runs of blanks, letters, digits and marks have the ids of the tokenizers library."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    texts = [" " * 1_000_000, "a" + " \n" * 300_000 + "b", "ab" * 50_000, "7" * 100_000, "!?" * 50_000, "x y" + " " * 999 + "z"]
    got = defaultdict(list)
    for r in _packed(spark, vocab, list(enumerate(texts))):
        got[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(got[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)


def test_packing_of_equal_rows(spark, vocab, monkeypatch):
    """Equal rows are dealt to all shards and packed each."""
    monkeypatch.setattr(packing, "PIECES_PER_SHARD", 50)
    got = _packed(spark, vocab, [(None, "the same words " * 9)] * 500 + [(5, "")] * 500)
    assert len(got) == 1000 and Counter(r["doc_id"] for r in got) == {None: 500, 5: 500}
    shards = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(shards) == 20 and max(shards.values()) < 100
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert (packing.windows(np.array([60] * 7), 100) >= 0).all() and len(set(packing.windows(np.array([60] * 7), 100))) == 7


# Token counts --------------------------------------------------------------------------------------


def test_cache_with_repeated_entries(spark, edges, vocab):
    """Two runs that append the same digests leave one count a row; a later run finds all of them."""
    cache, model = scratch_path(spark, "cache"), vocab("piece_bpe_32k.model")
    first = sorted(map(str, rows(tokencount.count_tokens(edges, model, cache))))
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    stored = spark.read.parquet(cache).count()
    assert sorted(map(str, rows(tokencount.count_tokens(edges, model, cache)))) == first and spark.read.parquet(cache).count() == stored


def test_many_rows_without_ids(spark, vocab, monkeypatch):
    monkeypatch.setattr(tokencount, "BROADCAST", 10)
    df = spark.createDataFrame([(None, f"text {i % 30}") for i in range(300)], "doc_id long, text string")
    cache = scratch_path(spark, "cache")
    assert len(rows(tokencount.count_tokens(df, vocab("piece_bpe_32k.model"), cache))) == 300 and spark.read.parquet(cache).count() == 30


def test_normalised_content_has_equal_counts(spark, vocab):
    rng = random.Random(3)
    model = vocab("piece_bpe_32k.model")
    texts = ["".join(rng.choice("ab  ▁\t\né😀ﬁ ") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    changed = [r[0] for r in df.select(tokencount.normalised(F.col("t"), model)).collect()]
    assert tokencount.token_lengths(changed, model) == tokencount.token_lengths(texts, model) and changed != texts
    assert [r[0] for r in df.select(tokencount.normalised(F.col("t"), vocab("byte_bpe_50k.json"))).collect()] == texts


# Language ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces(vocab):
    return langid.Pieces(vocab("piece_bpe_32k.model"))


def _segmentations(word, known, outside):
    """All ways to cut a word into pieces."""
    if not word:
        return [[]]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in known:
            out += [[known[word[:k]], *rest] for rest in _segmentations(word[k:], known, outside)]
    if word[0] not in known:
        out += [[*outside(word[0]), *rest] for rest in _segmentations(word[1:], known, outside)]
    return out


def test_expected_counts(pieces, vocab):
    """Forward-backward against the sum over an enumeration of all segmentations."""
    sp = langid._processor(vocab("piece_bpe_32k.model"))
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    p = np.random.default_rng(1).random(pieces.size)
    p /= p.sum()
    for words in (["▁the", "▁and", "▁ß😀x"], ["▁international"]):
        want = np.zeros(pieces.size)
        for w, times in zip(words, (1, 3, 2)):
            cuts = _segmentations(w, known, lambda c: [sp.piece_to_id(f"<0x{b:02X}>") for b in c.encode()])
            prob = np.array([np.prod(p[c]) for c in cuts])
            for c, q in zip(cuts, prob / prob.sum()):
                np.add.at(want, c, q * times)
        assert np.allclose(langid.expected(pieces, words, np.array((1.0, 3.0, 2.0)[: len(words)]), p), want)


def test_long_words_are_summed_across_runs(pieces, vocab):
    rng = np.random.default_rng(2)
    p = rng.random((pieces.size, 3))
    model = langid.Model(vocab("piece_bpe_32k.model"), ("a", "b", "c"), np.log(p / p.sum(axis=0)))
    forward = langid.Forward(model)
    for word in ("▁" + "international" * 12, "▁" + "x" * 500 + "😀é", "▁" + "ß" * (langid.LONGEST - 1)):
        assert np.allclose(forward._long(word), forward._words([word])[0])
    assert np.isfinite(forward.texts(["a" * 20_000 + " b"])).all()


# Quality ---------------------------------------------------------------------------------------------


def test_quality_scores(spark):
    """Scores against a plain version of the feature, both curves and the draw to the prior."""
    model = quality.Model(b"good words and more " * 20, b"| *** | bad $$$ " * 20, 3.0, -0.2, (-0.5, 0.0, 0.5), (0.1, 0.4, 0.95), 0.7)
    texts = ["good words and more " * 30, "| *** |" * 2000, "", None, "é" * 5000]
    got = {r["doc_id"]: r for r in rows(quality.classify(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), model))}
    for i, t in enumerate(texts):
        data, sizes = (t or "").encode(), []
        for words in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[k : k + 4096])) for k in range(0, len(data), 4096)))
        x = (sizes[1] - sizes[0]) / len(data) if data else 0.0
        own = 0.05 / (1 + math.exp(-(3.0 * x - 0.2))) + 0.95 * np.interp(x, model.at, model.level)
        want = 0.7 + (own - 0.7) * len(data) / (len(data) + 64)
        assert math.isclose(got[i]["score"], want) and got[i]["predicted"] == int(want >= 0.5)


def test_shared_label_ids_are_bounded(spark):
    """An id that many documents share brings at most ``per_class`` rows."""
    rng = random.Random(1)
    data = [(1, f"{_text(rng, 'en', 20)} {i}") for i in range(300)] + [(2, f"*** | {i} $$" * 20) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), per_class=40, dictionary_bytes=4000)
    assert all((r["predicted"] == 1) == (r["doc_id"] == 1) for r in rows(quality.classify(docs, model)))


# Top-k -----------------------------------------------------------------------------------------------


def test_large_integers_are_exact(spark, monkeypatch):
    """Scores beyond 2**53 that differ by 1 keep their order; ones outside the range count as its end."""
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 7)
    big = 2.0**22
    vecs = {i: [big * (1 + i % 3), float(i % 5) / 64, -big / 64] for i in range(60)}
    df = spark.createDataFrame([*vecs.items()], "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vecs.items()}
    got = defaultdict(list)
    for r in sorted(rows(topk.top_k(df, F.col("vec_id") % 20 == 0, k=9)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:9]
        assert got[q] == [(i, -s) for s, i in best] and got[q][0][1] > 2**53
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in rows(topk.top_k(huge, F.col("vec_id") == 0))] == [(1, 2**63 - 1), (2, -(2**63))]


# Language model --------------------------------------------------------------------------------------


def test_interpolated_scores(spark, monkeypatch):
    """Scores against counting in plain dictionaries, with weights from every training text's deleted counts."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 3000)
    rng = random.Random(11)
    docs = {i: _text(rng, rng.choice(["en", "de"]), rng.randrange(0, 50)) for i in range(120)}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    toks = {i: [w.lower() for w in WORD.findall(t)] + ["</s>"] for i, t in docs.items()}
    pairs = {i: list(zip(["<s>", *t], t)) for i, t in toks.items()}
    one, two = Counter(w for i in train for w in toks[i]), Counter(p for i in train for p in pairs[i])
    n, v, starts = sum(one.values()), len(one), len(train)
    context = lambda c: starts if c == "<s>" else one[c]
    width = 2 * lm.REACH * lm.STEPS + 1
    table = np.zeros((lm.BUCKETS, width))
    for i in train:
        mine1, mine2 = Counter(toks[i]), Counter(pairs[i])
        for c, w in pairs[i]:
            own = 1 if c == "<s>" else mine1[c]
            rest = context(c) - own
            if rest > 0:
                p2 = (two[c, w] - mine2[c, w]) / rest
                p1 = (one[w] - mine1[w] + 0.5) / (n - len(toks[i]) + 0.5 * (v + 1))
                at = 1 + int(min(max((math.log2(p2 / p1) + lm.REACH) * lm.STEPS, 0), width - 2)) if p2 else 0
                table[min(int(math.log2(rest)), lm.BUCKETS - 1), at] += 1
    weight = lm.weights(table)
    got = {r["doc_id"]: r for r in rows(lm.score(spark.createDataFrame([*docs.items()], "doc_id long, text string"), crc_fold(F.col("doc_id"), 5) != 1))}
    for i in docs:
        want = 0.0
        for c, w in pairs[i]:
            p, seen = (one[w] + 0.5) / (n + 0.5 * (v + 1)), context(c)
            m = weight[min(int(math.log2(seen)), lm.BUCKETS - 1)] if seen else 0.0
            want += math.log10(m * two[c, w] / seen + (1 - m) * p if seen else p)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9)


def test_keys_of_any_type(spark):
    df = spark.createDataFrame([("2024-01-01", "a b"), (None, None)], "doc_id string, text string").withColumn("doc_id", F.to_date("doc_id"))
    assert len(rows(lm.score(df, F.lit(True)))) == 2


# Pipeline --------------------------------------------------------------------------------------------


def test_all_stages_on_edge_rows(spark, edges):
    """Every stage, on null and repeated ids and equal rows; rows that a stage keeps are rows that it was given."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    run = [(None, "r" * 200_000, "en", "a", 1)] * 2
    many = spark.createDataFrame([(None, f"no id {i % 50}", "en", "a", 1) for i in range(100)] + [(9, "equal rows here", "en", "b", 1)] * 100 + run, edges.select(columns).schema)
    for docs in (edges.select(columns).unionAll(many).coalesce(2),):
        given = Counter(map(json.dumps, (r.asDict() for r in docs.collect())))
        for name, stage in P.STAGES[:-1]:
            kept = Counter(map(json.dumps, (r.asDict() for r in stage(spark, docs, DIR).select(columns).collect())))
            assert set(kept) <= set(given), name
            if name != "mixing to target weights":
                assert all(kept[k] <= given[k] for k in kept), name
            else:
                assert all(kept[k] <= 3 * given[k] for k in kept)
        pieces_ = rows(P.packing_stage(spark, docs, DIR))
        assert Counter(r["doc_id"] for r in pieces_ if r["start"] == 0) == Counter(r["doc_id"] for r in docs.collect())
