"""Each operator against a brute-force version, on edge rows and on an empty table."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import fingerprint, langid, lm, mixing, neardup, packing, quality, tokencount, topk, warc
from maskwright.llm.common import crc_fold, scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# WARC ------------------------------------------------------------------------------------------


def _pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, k int, first string")


def test_warc_round_trip(spark):
    data = [(1, "http://a/x y", "x" * 30_000, 1, "z"), (2, None, None, 1, "z"), (3, "u", "", 1, "z"), (4, "u\r\nInjected: 1", "grüße\r\n\r\nWARC/1.1\r\n", 1, "z"), (5, "u", "x" * 30_000, 1, "z"), (None, "u", "solo", 1, "z"), (7, "u", "x" * 30_000, 1, "z"), (7, "u", "x" * 30_000, 1, "z")]
    path = scratch_path(spark, "t")
    warc.write_archive(_pages(spark, data), path, segment_bytes=1000, chunk_bytes=77)
    got = sorted(rows(warc.read_archive(spark, path)), key=lambda r: (r["page"] or "", r["record_type"]))
    assert len(got) == len(data) and {r["status"] for r in got} == {"ok"}
    want = {(None if i is None else str(i)): (h or "").encode() for i, _, h, *_ in data}
    for r in got:
        body = want[r["page"]]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == ("revisit" if r["page"] in ("3", "5", "7") else "response")
        assert r["refers_to"] == {"3": "2", "5": "1", "7": "1"}.get(r["page"])
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == body
    assert max(r["segments"] for r in got) > 30


def test_warc_faults(spark, tmp_path):
    good = warc.page_records("1", "1", None, b"abc" * 500, None, 300, 100)
    (tmp_path / "lost.warc").write_bytes(b"\r\n\r\n".join([*good[:-2], good[-1]]) + b"\r\n\r\n")
    bad = warc.page_records("2", "2", None, b"abcabc", None, 10_000, 100)[0].replace(b"abcabc", b"abcabd")
    (tmp_path / "bad.warc").write_bytes(bad + b"\r\n\r\n")
    got = {r["page"]: r["status"] for r in rows(warc.read_archive(spark, str(tmp_path)))}
    assert got == {"1": "incomplete", "2": "digest_mismatch"}


def test_warc_empty_and_small(spark):
    path = scratch_path(spark, "t")
    warc.write_archive(_pages(spark, []), path)
    assert warc.read_archive(spark, path).count() == 0
    path = scratch_path(spark, "t")
    warc.write_archive(_pages(spark, [(1, "u", "ab", 1, ""), (2, "u", "ab", 1, "")]), path, min_revisit_bytes=3)
    assert {r["record_type"] for r in rows(warc.read_archive(spark, path))} == {"response"}


def test_chunked_framing():
    for n in (0, 1, 76, 77, 78, 1000):
        body = bytes(range(256)) * 4
        assert warc.unchunked(warc.chunked(body[:n], 77)) == body[:n]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# Mixing ----------------------------------------------------------------------------------------


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Share and reshare until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over


def test_mixing(spark, edges):
    rng = random.Random(1)
    data = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice([None, "a", "b", "c", "ü", "z"] + ["hot"] * 6)) for i in range(3000)]
    got = rows(mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")))
    sizes, taken, target = Counter(), Counter(), {}
    by = {r["doc_id"]: r for r in got}
    for i, t, s in data:
        n = len(WORD.findall(t))
        assert by[i]["size"] == n and 0 <= by[i]["taken"] <= 3 * n
        sizes[s] += n
        taken[s] += by[i]["taken"]
        target[s] = by[i]["target"]
    for s, t in _targets(sizes).items():
        assert math.isclose(target[s], t) and taken[s] == math.floor(target[s])
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(spark.createDataFrame(data[::-1], "doc_id long, text string, source string")))))
    assert len(rows(mixing.mix(edges))) == edges.count()
    mixed = mixing.mixed_documents(edges)
    assert mixed.columns == edges.columns and mixed.count() > 0


def test_mixing_empty(none, spark):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in rows(mixing.mix(blank))} == {(0.0, 0)}


def test_mixed_documents_multiplicity(spark):
    """Rows with null and with repeated ids come exactly as often as the mix takes them."""
    rng = random.Random(4)
    ids = [None] * 40 + [7] * 30 + list(range(100, 180))
    data = [(d, f"t{i} " + "w " * rng.randrange(0, 9), rng.choice(["a", "b", "c", None])) for i, d in enumerate(ids)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    took = rows(mixing.mix(docs.withColumn("n", F.monotonically_increasing_id()), row="n"))
    want = Counter()
    for r, d in zip(sorted(took, key=lambda r: r["n"]), rows(docs), strict=True):
        want[tuple(d.values())] += r["copies"]
    got = Counter(tuple(r.values()) for r in rows(mixing.mixed_documents(docs)))
    assert got == +want and max(got.values()) <= 3
    words = Counter()
    for (_, t, s), n in got.items():
        words[s] += n * len(WORD.findall(t))
    targets = {s: t for s, t in _targets(Counter({s: sum(len(WORD.findall(t)) for _, t, x in data if x == s) for s in ("a", "b", "c", None)})).items()}
    assert all(words[s] < t + 10 for s, t in targets.items())


# Quality and language --------------------------------------------------------------------------

SYLLABLES = {"en": "the and ing er tion st re on ed ha".split(), "de": "der und sch ein ung ich en ü te zu".split(), "fr": "le et ment eau oi que é ai tion re".split()}


def _text(rng, lang, n=120):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        good = i % 4 != 0
        text = _text(rng, lang) if good else " ".join(f"{w} | ***" for w in _text(rng, lang, 60).split())
        data.append((i, text, lang, int(good)))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, quality int").cache()


def test_quality(corpus, edges, none):
    fold = crc_fold(F.col("doc_id"), 3)
    model = quality.fit(corpus, corpus.select("doc_id", "quality"), fold != 1, dictionary_bytes=8000)
    held = rows(quality.classify(corpus, model).join(corpus, "doc_id").filter(fold == 1))
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in held)
    got = quality.classify(edges, model)
    assert got.count() == edges.count() and got.filter("score is null").isEmpty()
    assert quality.classify(none, model).count() == 0
    assert quality.keep_good(edges, model).columns == edges.columns


def test_quality_without_labels(corpus, none, edges):
    model = quality.fit(corpus, none.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    assert {r["score"] for r in rows(quality.classify(edges, model))} == {0.5}


def test_language(corpus, edges, none, vocab):
    fold = crc_fold(F.col("doc_id"), 3)
    model = langid.fit(corpus, fold != 1, vocab("piece_bpe_32k.model"))
    held = rows(langid.identify(corpus, model).join(corpus, "doc_id").filter(fold == 1))
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    got = rows(langid.identify(edges, model))
    assert len(got) == edges.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 10)} == {"und"}
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none, F.lit(True), vocab("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in rows(langid.identify(edges, empty))} == {"und"}
    assert langid.keep_known(edges, model).columns == edges.columns


def test_quality_learns_from_whole_texts(spark):
    """Bad texts differ from good ones only behind their first stretch."""
    rng = random.Random(8)
    data = []
    for i in range(240):
        head, tail = (" ".join(_text(rng, "en", 30) for _ in range(30))[: quality.STRETCH].ljust(quality.STRETCH, "x") for _ in range(2))
        if i % 2:
            tail = (" | *** ".join(rng.choice(["$$$", "@@", "##", "%%%%"]) + str(rng.randrange(99)) for _ in range(1500)))[: 3 * quality.STRETCH]
        data.append((i, head + tail, 1 - i % 2))
    docs = spark.createDataFrame(data, "doc_id long, text string, quality int")
    fold = crc_fold(F.col("doc_id"), 3)
    model = quality.fit(docs, docs.select("doc_id", "quality"), fold != 1, dictionary_bytes=8000)
    assert b"***" in model.bad and b"***" not in model.good
    held = rows(quality.classify(docs, model).join(docs, "doc_id").filter(fold == 1))
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97


def test_language_learns_from_whole_texts(spark, vocab):
    """Texts of all languages share a long head; their own words stand behind it."""
    rng = random.Random(9)
    head = _text(rng, "en", 1500)
    docs = spark.createDataFrame([(i, head + " " + _text(rng, lang, 200), lang) for i, lang in enumerate(["en", "de", "fr"] * 8)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), vocab("piece_bpe_32k.model"))
    alone = spark.createDataFrame([(i, _text(rng, lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 10)], "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in rows(langid.identify(alone, model).join(alone, "doc_id")))
    sp = langid._processor(vocab("piece_bpe_32k.model"))
    text = "\n\n".join(_text(rng, lang, 400) + ".  5 %" for lang in ("en", "fr", "de") * 4) + "x" * 500
    parts = list(langid.stretches(text, 700))
    assert len(parts) > 5 and " ".join(parts) == text
    assert [i for p in parts for i in sp.encode(p)] == sp.encode(text)


def test_forward_sums_segmentations(vocab):
    """The forward algorithm against an enumeration of all segmentations."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    p = rng.random((sp.get_piece_size(), 2))
    model = langid.Model(vocab("piece_bpe_32k.model"), ("a", "b"), np.log(p / p.sum(axis=0)))
    known = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in known:
                out += np.exp(model.log_p[known[word[:k]]]) * total(word[k:])
        if word[0] not in known:
            out += np.exp(sum(model.log_p[sp.piece_to_id(f"<0x{b:02X}>")] for b in word[0].encode())) * total(word[1:])
        return out

    for text in ("the", "straße", "a😀b", "international"):
        assert np.allclose(langid.Forward(model).texts([text])[0], np.log(total("▁" + text)))
    assert langid.pieces_of("x" * 100) == ["▁" + "x" * 47, "x" * 48, "x" * 5]


# Fingerprints ----------------------------------------------------------------------------------


def _paragraphs(text):
    return set(re.findall(r"[^\n.!?]{1,200}[\n.!?]*|[\n.!?]+", text))


def _like(a, b):
    a, b = _paragraphs(a), _paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rng = random.Random(3)
    base = [_text(rng, "en", 12) for _ in range(60)]
    docs = {}
    for i in range(700):
        docs[i * 7 % 5003] = "\n".join(rng.choice(base) for _ in range(rng.choice([0, 1, 3, 9, 40])))
    data = [*docs.items()]
    got = {r["doc_id"]: r for r in rows(fingerprint.fingerprints(spark.createDataFrame(data, "doc_id long, text string")))}
    order = sorted(docs, reverse=True)
    for i, d in enumerate(order):
        text, nxt = docs[d], docs[order[(i + 1) % len(order)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r["near_edited"], _like(text, edited)) and math.isclose(r["near_next"], _like(text, nxt))
    by = defaultdict(set)
    for d in docs:
        by[docs[d]].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) > 0.9 * len(by)


def test_fingerprint_edges(edges, none, spark):
    got = rows(fingerprint.fingerprints(edges))
    assert len(got) == edges.count() and fingerprint.fingerprints(none).count() == 0
    assert all((r["near_next"] is None) == (r["doc_id"] is None) for r in got)
    one = rows(fingerprint.fingerprints(spark.createDataFrame([(5, "abc\ndef")], "doc_id long, text string")))[0]
    assert one["near_next"] == 1.0


# Packing and token counts ------------------------------------------------------------------------


def test_packing(edges, none, vocab):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    pack = lambda df: packing.pack(df, vocab("byte_bpe_50k.json"), vocab("byte_bpe_50k.tiktoken"))
    got = rows(pack(edges.filter("doc_id is null or doc_id != 2")))
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for r in edges.filter("doc_id != 2").collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(none).count() == 0


def test_differencing():
    rng = np.random.default_rng(0)
    for n, cap in ((0, 100), (1, 100), (7, 100), (400, 2048), (2000, 2048)):
        sizes = rng.integers(1, min(cap, 512) + 1, n)
        w = packing.windows(sizes, cap)
        fill = np.bincount(w, sizes) if n else np.zeros(0)
        assert len(w) == n and (fill <= cap).all()
        if n > 300:
            assert sizes.sum() / (len(fill) * cap) > 0.97 and fill.max() - fill.min() < 100


def test_token_cache(spark, edges, none, vocab):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))
    cache = scratch_path(spark, "cache")
    count = lambda df, **k: rows(tokencount.count_tokens(df, vocab("piece_bpe_32k.model"), cache, **k))
    got = count(edges, limit=15)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 15) for r in edges.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    stored = spark.read.parquet(cache).count()
    assert stored == edges.select(F.coalesce("text", F.lit(""))).distinct().count()
    count(edges)
    assert spark.read.parquet(cache).count() == stored
    assert count(none) == []


# Near-duplicates --------------------------------------------------------------------------------


def _shingles(text, n):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _components(docs, n, percent):
    sets = {i: _shingles(t, n) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in docs}, sets


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rng = random.Random(n)
    docs = {}
    for _ in range(25):
        words = _text(rng, "en", rng.choice([2, 4, 9, 60, 300])).split()
        for _ in range(rng.choice([1, 2, 3, 40])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = _text(rng, "fr", 1)
            docs[len(docs) * 3] = " ".join(copy)
    docs |= {9001: "", 9002: None, 9003: " \n"}
    want, sets = _components(docs, n, percent)
    got = rows(neardup.near_duplicates(spark.createDataFrame([*docs.items()], "doc_id long, text string"), shingle=n, percent=percent))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in docs}


def test_near_duplicate_edges(edges, none):
    got = rows(neardup.near_duplicates(edges))
    assert len(got) == edges.count() and neardup.near_duplicates(none).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1} and all(r["kept"] for r in got if r["doc_id"] is None)
    kept = neardup.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] or 0 for r in rows(kept)) == [0, 0, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12]


def test_one_of_each_with_repeated_ids(spark):
    """Of rows that share an id only equal or linked texts collapse."""
    rng = random.Random(6)
    x, y, z = (_text(rng, "en", 50) for _ in range(3))
    data = [(5, x, "a"), (5, y, "a"), (5, y, "a"), (6, x + " tail", "a"), (4, z, "b"), (7, z, "b"), (8, None, "c"), (8, None, "c"), (8, "", "c"), (None, x, "d")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = sorted([(5, x, "a"), (5, y, "a"), (4, z, "b"), (8, None, "c"), (8, "", "c"), (None, x, "d")], key=str)
    for d in (docs, spark.createDataFrame(data[::-1], docs.schema).repartition(3)):
        assert sorted((tuple(r.values()) for r in rows(neardup.one_of_each(d))), key=str) == want


# Top-k --------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vecs = {i: rng.normal(0, 0.2, 16).astype(np.float32) for i in range(900)}
    vecs |= {i: vecs[3] for i in range(300, 500)}
    data = [(i, [float(x) for x in v], 1) for i, v in vecs.items()] + [(2000, None, 1), (2020, [float("nan")] * 16, 1), (2040, [1.0, None], 1), (None, [1.0] * 16, 1), (2060, [1.0, 2.0], 1), (2080, [], 1)]
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 200)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 16)
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = defaultdict(list)
    for r in sorted(rows(topk.top_k(df, F.col("vec_id") % 20 == 0)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * v.astype(np.float64)).astype(int) for i, v in vecs.items()}
    for q in range(0, 900, 20):
        best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:20]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(got) == set(range(0, 900, 20))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_large_values(spark):
    df = spark.createDataFrame([(i, [float(10**6 * (i + 1)), -3.5]) for i in range(45)], "vec_id long, embedding array<float>")
    got = rows(topk.top_k(df, F.col("vec_id") == 20, k=50))
    assert len(got) == 44 and got[0]["score"] == 64 * 64 * 10**12 * 21 * 45 + 224 * 224


def test_top_k_gathers_no_blocks_in_the_driver(spark, monkeypatch):
    """Blocks sent to many cells meet by a shuffle, in as few bytes as their numbers need (F1)."""
    rng = np.random.default_rng(4)
    vecs = {i: rng.integers(-90, 90, 8) / 64 for i in range(400)}
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(topk, "GRID", (2, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vecs.items()], "vec_id long, embedding array<double>")
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=7)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(out))
    whole = {i: np.floor(64 * v).astype(int) for i, v in vecs.items()}
    want = [(q, n, i, -s) for q in range(0, 400, 20) for n, (s, i) in enumerate(sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:7], 1)]
    assert got == want
    for most, kind in ((1.9, "<i1"), (-500.0, "<i2"), (1e6, "<i4"), (1e9, "<f8")):
        block = topk._blocks(spark.createDataFrame([(1, [1.0, most])], "id long, v array<double>"), 5, 64).first()
        assert (block["kind"], np.frombuffer(block["m"], kind).tolist()) == (kind, [64, math.floor(64 * most)])


# Language model ---------------------------------------------------------------------------------


def test_language_model(spark, edges, none, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm, "RANGE_BYTES", 9000)
    rng = random.Random(9)
    docs = {i: _text(rng, "en", rng.randrange(0, 60)) for i in range(150)} | {150: None, 151: "", 152: "ONLY here"}
    train = {i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1}
    toks = {i: [w.lower() for w in WORD.findall(t or "")] + [None] for i, t in docs.items()}
    c1 = Counter(w for i in train for w in toks[i])
    n, v = sum(c1.values()), len(c1)
    got = {r["doc_id"]: r for r in rows(lm.score(spark.createDataFrame([*docs.items()], "doc_id long, text string"), crc_fold(F.col("doc_id"), 5) != 1))}
    for i, t in toks.items():
        r = got[i]
        assert (r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in train, len(t), sum(c1[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] <= 0
    held = [r for r in got.values() if not r["train"]]
    assert sum(r["score"] for r in held) > 1.02 * sum(r["base_score"] for r in held)
    assert lm.score(edges, F.col("doc_id") % 2 == 0).count() == edges.count()
    assert lm.score(none, F.lit(True)).count() == 0
    nothing = rows(lm.score(edges, F.lit(False)))
    assert {(r["base_score"], r["score"], r["n_known"]) for r in nothing} == {(0.0, 0.0, 0)}


def test_mixture_weights():
    """EM finds the weight that maximises the likelihood of the ratios."""
    table = np.zeros((2, 2 * lm.REACH * lm.STEPS + 1))
    table[0, 0], table[0, 1 + (lm.REACH + 3) * lm.STEPS] = 400, 600
    ratio = 2 ** (3 + 0.5 / lm.STEPS)
    best = max(np.linspace(0.001, 0.999, 999), key=lambda w: 400 * math.log(1 - w) + 600 * math.log(w * ratio + 1 - w))
    got = lm.weights(table)
    assert abs(got[0] - best) < 0.002 and got[1] == 0
