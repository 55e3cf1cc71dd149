"""Corpora, reports, decisions, maps, settings and model tokens against plain versions."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators import decide, detect, report, restore, settings, tokens, vault
from maskwright.schema import DetectionConfig
from maskwright.sources import dataset, files


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Tokens ----------------------------------------------------------------------------------------


def test_align_metaspace_and_continuations():
    assert tokens.align("Café  au lait", ["<s>", "▁cafe", "▁▁au", "▁", "▁la", "it", "</s>"]) == [None, (0, 4), (6, 8), None, (9, 11), (11, 13), None]
    assert tokens.align("MÜLLER-Straße", ["[CLS]", "muller", "-", "stra", "##ße", "[SEP]"]) == [None, (0, 6), (6, 7), (7, 11), (11, 13), None]


def test_align_finds_its_place_again():
    text = "abc ??? def"
    assert tokens.align(text, ["▁abc", "<unk>", "▁def"]) == [(0, 3), None, (8, 11)]
    assert tokens.align("x" * 100 + "end", ["▁end"]) == [None]
    # a literal control token is stepped over
    assert tokens.align("<s> name", ["<s>", "▁name"], framed=False) == [None, (4, 8)]
    assert tokens.coverage(["▁a", "▁", "</s>"], [(0, 1), None, None]) == 1.0 and tokens.coverage([], []) == 1.0
    assert tokens.coverage(["▁a", "▁b"], [(0, 1), None]) == 0.5


def test_token_chunks_cover_texts(spark):
    _pieces = lambda text: [f"▁{w}" for w in text.split()]
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(n)) for n in (0, 1, 7, 10, 11, 57)] + [None, "  lead"]
    for t in texts:
        bounds = tokens.token_bounds(t, _pieces, 10, 3) if t else []
        if t:
            assert bounds[0][0] == 0 and bounds[-1][1] == len(t)
            assert all(len(_pieces(t[a:b])) <= 10 for a, b in bounds)
            assert all(c <= b and c > a for (a, b), (c, _) in zip(bounds, bounds[1:]))
    got = rows(tokens.token_chunks(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), _pieces, most=10, overlap=3))
    for r in got:
        t = texts[r["doc_id"]]
        assert r["text"] == t[r["start_char"] : r["end_char"]] == t.encode()[r["start_byte"] : r["end_byte"]].decode()
    # nothing can be placed: halves
    assert tokens.token_bounds("abc def", lambda t: ["▁zzz"] * 5) is None
    parts = list(tokens.fitted("x" * 40, lambda t: list(t), 16))
    assert parts[0][0] == 0 and parts[-1][1] == 40 and all(b - a <= 16 for a, b in parts) and all(c <= b for (_, b), (c, _) in zip(parts, parts[1:]))


def test_placed_predictions(spark):
    text = "Mail Anna Müller now"
    df = spark.createDataFrame([(1, text, ["<s>", "▁mail", "▁anna", "▁mul", "ler", "▁now", "</s>"])], "doc_id int, text string, pieces array<string>")
    items = "array(named_struct('index', 2, 'label', 'B-FIRSTNAME', 'score', 0.9D), named_struct('index', 3, 'label', 'I-LASTNAME', 'score', 0.7D), named_struct('index', 4, 'label', 'I-LASTNAME', 'score', 0.1D), named_struct('index', 5, 'label', 'O', 'score', 0.9D))"
    from maskwright.operators.ner import token_spans

    out = tokens.aligned(df).withColumn("p", F.expr(tokens.predictions(items, "places"))).withColumn("ner", F.expr(token_spans("text", "p")))
    (r,) = rows(out)
    assert r["placed"] == 1.0 and [(s["text"], s["entity_type"], round(s["score"], 3), s["start"], s["end"]) for s in r["ner"]] == [("Anna Müller", "PERSON", 0.8, 5, 17)]


SPANS = "array<struct<start:int,end:int,entity_type:string,score:double,text:string,source:string>>"


def _repair(spark, text, spans, least):
    return rows(tokens.repaired(spark.createDataFrame([(text, spans)], f"text string, ner {SPANS}"), "ner", least=least))[0]["ner"]


def _span(text, part, kind, score):
    at = text.index(part)
    a = len(text[:at].encode())
    return {"start": a, "end": a + len(part.encode()), "entity_type": kind, "score": score, "text": part, "source": "ner"}


LEAST = {"EMAIL": 0.8, "PERSON": 0.55, "LOCATION": 0.55, "ORGANIZATION": 0.5}


def test_repair_joins_halves(spark):
    t = "to t.tester@mail.invalid, ok"
    weak = [_span(t, "t.", "EMAIL", 0.9), _span(t, "tester", "PERSON", 0.3), _span(t, "@mail.invalid", "EMAIL", 0.4)]
    assert [(s["text"], s["entity_type"], s["score"]) for s in _repair(spark, t, weak, LEAST)] == [("t.tester@mail.invalid", "EMAIL", 0.9)]
    strong = [weak[0], weak[1] | {"score": 0.9}, weak[2]]
    assert len(_repair(spark, t, strong, LEAST)) == 3
    t = "Anna, Bert"
    assert len(_repair(spark, t, [_span(t, "Anna", "PERSON", 0.9), _span(t, "Bert", "PERSON", 0.9)], LEAST)) == 2


def test_repair_gives_addresses_their_domain(spark):
    t = "mail ann@müller.example Berlin now"
    got = _repair(spark, t, [_span(t, "ann@", "EMAIL", 0.9), _span(t, "müller.example Berlin", "ORGANIZATION", 0.6)], LEAST)
    assert [(s["text"], s["entity_type"]) for s in got] == [("ann@müller.example", "EMAIL"), ("Berlin", "ORGANIZATION")]
    df = spark.createDataFrame([(t, [_span(t, "ann@", "EMAIL", 0.9), _span(t, "müller.example", "URL", 0.6)]), (None, [])], "text string, ner array<struct<start:int,end:int,entity_type:string,score:double,text:string,source:string>>")
    assert [[s["text"] for s in r["ner"]] for r in rows(tokens.repaired(df, "ner"))] == [["ann@müller.example"], []]


def test_search_placement(spark):
    t = "Call O'Neil & sons, anna_b at Main Street 5"
    df = spark.createDataFrame([(t, [("o'neil", "PERSON", 0.8), ("##anna _ b", "USERNAME", 0.7), ("main", "ADDRESS", 0.6), ("street", "ADDRESS", 0.9), ("gone", "PERSON", 1.0)])], "text string, items array<struct<word:string,entity_type:string,score:double>>")
    got = rows(df.select(F.expr(tokens.searched("items", "text")).alias("s")))[0]["s"]
    assert [(t[a:b], k, s) for a, b, k, s in (x.values() for x in got)] == [("O'Neil", "PERSON", 0.8), ("anna_b", "USERNAME", 0.7), ("Main Street", "ADDRESS", 0.9)]


def test_raw_labels(spark):
    spans = spark.createDataFrame([(1, 0, 4, "PERSON"), (1, 5, 9, "PERSON")], "doc_id int, start int, end int, entity_type string")
    raw = spark.createDataFrame([(1, 0, 4, "PERSON", "B-NAME", 0), (1, 0, 4, "PERSON", "I-NAME", 1)], "doc_id int, start int, end int, entity_type string, raw_label string, seq int")
    assert {r["start"]: r["raw_label"] for r in rows(tokens.labelled(spans, raw))} == {0: "I-NAME", 5: None}


# Detection on long texts -------------------------------------------------------------------------


def test_offsets_of_many_matches(spark):
    text = "é" + "".join(f"x{'ü' * (i % 3)} a{i}@mail{i % 7}.example.org " for i in range(300))
    (r,) = rows(spark.createDataFrame([(text,)], "text string").select(F.expr(S.matches("text", r"[a-z0-9]+@[a-z0-9.]+", "EMAIL", 0.9, "regex", 0)).alias("s")))
    assert len(r["s"]) == 300
    for s in r["s"]:
        assert text[s["cs"] : s["ce"]] == s["text"] == text.encode()[s["start"] : s["end"]].decode()


def test_context_reaches_over_long_gaps(spark):
    far = "phone" + " " * 3000 + "212-555-0100" + "." * 40_000 + " dial"
    (r,) = rows(detect.detect(spark.createDataFrame([("phone 212-555-0100",), (far,)], "text string").coalesce(1).filter("length(text) > 100")).select("spans"))
    assert [round(s["score"], 2) for s in r["spans"]] == [0.85]
    none = "phone " + "w " * 600 + "212-555-0100 " + "w " * 600
    (r,) = rows(detect.detect(spark.createDataFrame([(none,)], "text string")).select("spans"))
    assert [round(s["score"], 2) for s in r["spans"]] == [0.7]


# Corpora -----------------------------------------------------------------------------------------


def test_records_are_repaired(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "one\ntwo", "lang": "en"}\n\n{"id": 2, "text": "x", "lang": "de-AT", "privacy_mask": [{"start": 0, "end": 1, "label": "first name", "value": "x"}]}\n')
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"uid": "u", "source_text": "é Bob", "locale": "English", "span_labels": [[2, 5, "GIVENNAME"], [2, 5, "NAME", "Bob"]]}]}))
    got = {r["id"]: r for r in rows(dataset.examples(dataset.read_records(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "b.json"))))}
    assert set(got) == {"openpii-en-1", "openpii-de-2", "openpii-en-u"}
    assert got["openpii-en-1"]["text"] == "one\ntwo" and got["openpii-en-1"]["source"]["sourceRow"] == 1
    assert got["openpii-de-2"]["goldSpans"] == [{"start": 0, "end": 1, "entity_type": "PERSON", "text": "x"}] and got["openpii-de-2"]["source"]["sourceRow"] == 4
    assert got["openpii-en-u"]["goldSpans"] == [{"start": 3, "end": 6, "entity_type": "PERSON", "text": "Bob"}]
    (tmp_path / "m.json").write_text(json.dumps({"files": ["a.jsonl", {"path": "b.json"}]}))
    assert dataset.read_manifest(spark, str(tmp_path / "m.json")).count() == 3
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "text": x}\n')
    with pytest.raises(Exception, match="line 1"):
        dataset.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def _sample(data, limit, negative, misc):
    """The sample by its rule, one example at a time: places by quota first, then the earliest of those left out."""
    n, m = min(negative, limit), min(misc, limit - min(negative, limit))
    target = {"n": n, "m": m, "s": limit - n - m}
    cells = [(a, b) for a in dataset.LANGUAGES for b in dataset.BUCKETS]
    room = {}
    for c, keys in (("n", cells), ("m", cells), ("s", [(a, t, b) for a in dataset.LANGUAGES for t in dataset.SUPPORTED for b in dataset.BUCKETS])):
        for at, k in enumerate(keys):
            room[c, k] = int(target[c] > 0) if target[c] < len(keys) else target[c] // len(keys) + (at < target[c] % len(keys))
    quota, used, count, placed, other = dict(room), dict.fromkeys(room, 0), dict.fromkeys("nms", 0), [], []
    for x, lang, bucket, types, *_ in sorted(data, key=lambda r: (r[4], r[5], r[0])):
        c = "n" if not types else "m" if "MISC" in types else "s"
        keys = [(lang, t, bucket) for t in set(types) & set(dataset.SUPPORTED)] if c == "s" else [(lang, bucket)]
        free = [k for k in keys if used[c, k] < quota[c, k]] if count[c] < target[c] else []
        if free:
            best = min(free, key=lambda k: (used[c, k], quota[c, k], ":".join(k)))  # noqa: B023
            used[c, best] += 1
            count[c] += 1
            placed.append(x)
        else:
            other.append(x)
    return set((placed + other[: 4 * limit])[:limit])


@pytest.mark.parametrize("limit", [7, 40, 120])
def test_coverage_sample(spark, limit):
    rng = random.Random(limit)
    kinds = ["EMAIL", "PHONE", "PERSON", "MISC", "DATE", "URL"]
    data = [(f"id{i:05d}", rng.choice("en en de".split()), rng.choice(dataset.BUCKETS), [rng.choice(kinds) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))], rng.choice("ab"), i) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame([(i, lang, b, [(0, 1, k, "x") for k in ks], (f, n)) for i, lang, b, ks, f, n in data], f"id string, language string, lengthBucket string, goldSpans {dataset.GOLD}, source struct<sourceFile:string,sourceRow:int>")
    got = {r["id"] for r in rows(dataset.coverage(df, limit, 5, 9))}
    assert got == _sample(data, limit, 5, 9) and len(got) == limit
    assert [r["id"] for r in rows(dataset.first_examples(df, 3))] == [r[0] for r in sorted(data, key=lambda r: (r[4], r[5]))[:3]]
    order = [r["id"] for r in rows(dataset.in_order(df))]
    assert order == [r[0] for r in sorted(data, key=lambda r: (r[1], r[4], r[5], r[0]))]


def test_quotas():
    c = dataset.Coverage(100, 7, 3)
    assert c.target == {"negative": 7, "misc": 3, "supported": 90}
    assert list(c.quota["negative"].values()) == [2, 1, 1, 1, 1, 1] and set(c.quota["misc"].values()) == {1} and sum(c.quota["supported"].values()) == 90


# Reports -----------------------------------------------------------------------------------------


def test_report_parts(spark, tmp_path):
    text = "  a\n\nb " + "c" * 100 + " NAME here " + "d" * 100
    (r,) = rows(spark.createDataFrame([(text,)], "t string").selectExpr(f"{report.context('t', chr(39) + ' NAME' + chr(39))} as c", f"{report.context('t', chr(39) + 'gone' + chr(39))} as g"))
    flat = " ".join(text.split())
    at = flat.index("NAME")
    assert r["c"] == "..." + flat[at - 48 : at + 4 + 48] + "..." and r["g"] == flat[:93] + "..."
    span = lambda a, b, k: {"start": a, "end": b, "entity_type": k, "text": "x"}
    df = spark.createDataFrame([(1, "abcdefghij", [span(0, 4, "EMAIL"), span(5, 8, "PHONE")], [span(0, 4, "EMAIL"), span(9, 10, "DATE")]), (2, "x", [], [])], f"id int, text string, gold {dataset.GOLD}, found {dataset.GOLD}")
    out = report.by_example(df)
    first = next(r for r in rows(out) if r["id"] == 1)
    assert [s["start"] for s in first["false_negatives"]] == [5] and [s["start"] for s in first["false_positives"]] == [9] and first["matches"] == [{"g": 0, "d": 0}]
    assert [r["entity_type"] for r in rows(report.samples(out, "false_negatives"))] == ["PHONE"]
    report.write_report(out, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    figures = spark.createDataFrame([("", "", 1, 1, 1, 0.5, 0.5, 0.5)], "dimension string, value string, tp int, fp int, fn int, precision double, recall double, f1 double")
    said = report.text_summary(figures, spark.createDataFrame([(2, 1)], "examples int, passed int"), spark.createDataFrame([(1.0, 1.0, 2.0, 3.0)], "average double, p50 double, p95 double, largest double"), "T")
    assert "all: P/R/F1 50.0%" in said and "1/2 passed" in said


# Decisions, maps and settings ----------------------------------------------------------------------


def test_switches_stick(spark):
    spans = spark.createDataFrame([(1, i, "PHONE", s, c) for i, (s, c) in enumerate([(0.9, False), (0.5, False), (0.9, True), (0.5, False)])], "doc_id int, span_idx int, entity_type string, score double, in_code boolean")
    decisions = spark.createDataFrame([(1, 3, True, None, 1), (1, 0, None, "DATE", 2), (1, 0, True, None, 3), (1, 0, False, None, 4)], "doc_id int, span_idx int, enabled boolean, new_type string, seq int")
    got = {r["span_idx"]: (r["enabled"], r["entity_type"]) for r in rows(decide.decided(spans, decisions, 0.6))}
    assert got == {0: (False, "DATE"), 1: (False, "PHONE"), 2: (False, "PHONE"), 3: (True, "PHONE")}
    parts = spark.createDataFrame([(1, 0, 9, "A", "x", "detected"), (1, 5, 12, "A", "y", "manual"), (1, 12, 14, "A", "z", "manual")], "doc_id int, start int, end int, entity_type string, text string, origin string")
    assert sorted((r["start"], r["placeholder"]) for r in rows(decide.preview_rows(parts))) == [(0, "[A_1]"), (12, "[A_2]")]


def test_vault_restoring(spark):
    records = spark.createDataFrame([("k", "[PERSON_1]", "Robin Vale", "Ada Löwe"), ("k", "[PERSON_2]", "Robin", "Bo"), ("k", "[URL_1]", "", "u")], "key string, placeholder string, synthetic_value string, original_text string")
    texts = ["[PERSON_1] and person 2", "Robin Vale met Robin, not Robins or _Robin", "RobinRobin", "[PERSON_9] [URL_1]", None]
    df = spark.createDataFrame([(i, "k" if i != 3 else "k", t) for i, t in enumerate(texts)], "i int, key string, text string")
    got = {r["i"]: r["restored"] for r in rows(restore.restore_vault(df, records, "key"))}
    assert got == {0: "Ada Löwe and Bo", 1: "Ada Löwe met Bo, not Robins or _Robin", 2: "RobinRobin", 3: "[PERSON_9] u", 4: ""}


def test_maps_go_on(spark):
    docs = spark.createDataFrame([(1, "a@x.org b@x.org a@x.org"), (2, None)], "doc_id long, text string")
    given = spark.createDataFrame([(1, "[EMAIL_4]", "b@x.org")], "doc_id long, token string, original string")
    out, maps = restore.by_map(detect.detect(docs), given=given)
    assert {r["doc_id"]: r["anonymized"] for r in rows(out)} == {1: "[EMAIL_5] [EMAIL_4] [EMAIL_5]", 2: ""}
    assert maps.count() == 2
    new = restore.mirrored(maps, spark.createDataFrame([(1, "Fake", "a@x.org")], "doc_id long, token string, original string"), "doc_id")
    assert {(r["token"], r["original"]) for r in rows(new)} == {("Fake", "a@x.org"), ("[EMAIL_4]", "b@x.org")}


def test_unknown_and_overlapping_spans_are_masked(spark):
    span = lambda a, b, k, t: {"start": a, "end": b, "entity_type": k, "score": 1.0, "text": t, "source": "manual", "cs": a, "ce": b, "seq": 0}
    from maskwright.schema import INNER

    docs = spark.createDataFrame([(1, "abcdef", [span(0, 3, "PERSON", "abc"), span(2, 5, "MISC", "cde")])], f"doc_id long, text string, spans array<{INNER}>")
    known = vault.identities(detect.exploded(docs, "doc_id")).filter("entity_type = 'MISC'")
    (r,) = rows(vault.anonymize(docs, known))
    assert r["anonymized"] == "[PERSON]def" and r["n_spans"] == 1


def test_vault_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"mail u{i % 3}@x.org and 212-555-010{i}") for i in range(6)], "doc_id long, text string")
    known = vault.identities(detect.exploded(detect.detect(docs), "doc_id"))
    assert {r["n"] for r in rows(known) if r["entity_type"] == "EMAIL"} == {1, 2, 3}
    vault.export_json(known, str(tmp_path / "v"))
    half = known.filter("n % 2 = 0")
    merged, given = vault.import_json(half, str(tmp_path / "v"))
    assert merged.count() == known.count() and {r["entity_type"]: r["n"] for r in rows(given)} == {"EMAIL": 3, "PHONE": 6}
    pinned = known.withColumn("pinned", F.col("n") == 1)
    assert vault.cleared(pinned).count() == 2


def test_settings():
    raw = {"minConfidence": 7, "nerModel": "x", "sensitivityMode": "individual", "sensitivity": 1.0, "groupsEnabled": {"Contact": False, "Identity": "no"}, "groupThresholds": {"Contact": 0.2, "Network": 3}, "allowlist": [{"pattern": "a", "scope": "any", "addedAt": 1, "source": "manual"}, {"pattern": 3}, None], "blocklist": [{"pattern": "b", "scope": "EMAIL", "addedAt": 1, "source": "detection"}, {"pattern": "b", "scope": "NOPE", "addedAt": 1, "source": "manual"}], "curatedUrls": ["https://a"], "own": 1}
    got = settings.checked(raw, ("https://a", "https://b"))
    assert got["minConfidence"] == 0.5 and got["nerModel"] == "ai4privacy" and got["own"] == 1 and got["curatedUrls"] == ["https://a", "https://b"]
    assert got["groupsEnabled"]["Contact"] is False and got["groupsEnabled"]["Identity"] is True and got["groupThresholds"] == {"Contact": 0.2}
    assert len(got["allowlist"]) == len(got["blocklist"]) == 1
    config = settings.options(got)
    assert config.min_confidence == min(settings.sensitivity(got).threshold(t[0]) for t in settings.TYPES)
    assert settings.checked(None)["nerProvider"] == "off"
    assert settings.config_from_json('{"context_window": 2, "ner_enabled": true}') == DetectionConfig(context_window=2)
    assert settings.config_from_json("{") == settings.config_from_json('{"context_window": "x"}') == settings.config_from_json("") == DetectionConfig()
    assert settings.config_from_json(settings.config_json()) == DetectionConfig()


def test_reversible_and_pools(spark):
    df = spark.createDataFrame([("[PERSON_1]",), ("person_1 here",), ("Robin Vale",), ("[PERSON_2]",)], "t string")
    scope, fakes = "map('[PERSON_1]', 'x')", "array('Robin', '')"
    assert [r["r"] for r in rows(df.select(F.expr(restore.reversible("t", scope, fakes)).alias("r")))] == [True, True, True, False]
    kinds = spark.createDataFrame([("PERSON",), ("EMAIL",), ("URL",)], "k string")
    assert [r["n"] for r in rows(kinds.select(settings.pool_size(F.col("k")).alias("n")))] == [24, 24, 0]


def test_formats_and_main_parts(spark, tmp_path):
    kind = files.format_of(F.col("n"), F.col("m"))
    df = spark.createDataFrame([("a.PDF", None), ("b", "Application/PDF"), ("c.docx", "application/pdf"), ("d.txt", "text/plain")], "n string, m string")
    assert [r["k"] for r in rows(df.select(kind.alias("k")))] == ["pdf", "pdf", "docx", None]
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("other.xml", "<a/>")
    assert files.office_text((tmp_path / "x.docx").read_bytes(), "docx") == ("corrupt", None)
