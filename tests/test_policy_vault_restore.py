"""Policy, vault, replacement, restoring and scoring on known cases."""

import random

from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators import detect as D
from maskwright.operators import ner, policy, restore, scope, score, vault
from maskwright.schema import SPAN, Sensitivity


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(F.expr(expr)).first()[0]


def test_sensitivity():
    assert Sensitivity(0.5).threshold("EMAIL") == 0.4 and Sensitivity(0.0).threshold("URL") == 0.8
    assert Sensitivity(0.5, True, (("Contact", 1.0),)).threshold("PHONE") == 0.2
    assert Sensitivity(0.5).lowest() == 0.4


def test_patterns(spark):
    got = lambda text, p: [(s["start"], s["end"], s["text"]) for s in one(spark, text, policy.pattern_spans("text", p))]
    assert got("Project X and project x.", "project x") == [(0, 9, "Project X"), (14, 23, "project x")]
    assert got("ünit-42 unit-7", "*-*") == [(2, 8, "nit-42"), (9, 15, "unit-7")]
    assert got("foo foo foobar", "foo") == [(0, 3, "foo"), (4, 7, "foo")]
    assert got("a.c abc", "a.c") == [(0, 3, "a.c")]


def test_allow_and_block(spark):
    df = D.detect(spark.createDataFrame([("mail bob@corp.example and eve@corp.example on 2020-01-02",)], "text string"))
    out = policy.review(df, allowlist=["bob@corp.example"], blocklist=[("on", "any"), ("eve@corp.example", "PERSON")]).first()["spans"]
    assert [(s["entity_type"], s["text"]) for s in out] == [("EMAIL", "eve@corp.example"), ("MISC", "on")]


def test_code_regions(spark):
    text = "a\n```py\nx\n```\nb <code class='z'>y</code> ````\n```\nopen"
    got = [(r["start"], r["end"]) for r in one(spark, text, policy.code_regions("text"))]
    assert [text[a:b] for a, b in got] == ["```py\nx\n```", "```\nopen", "<code class='z'>y</code>"]
    marks = policy.review(D.detect(spark.createDataFrame([("```\nmail a@b.com\n``` c@d.com",)], "text string")), code=True).first()
    assert marks["in_code"] == [True, True]


def test_vault_numbers(spark):
    rows = [(9, 5, "EMAIL", "B@x.org"), (2, 7, "EMAIL", "a@x.org"), (2, 3, "EMAIL", "b@X.org"), (70_000, 1, "EMAIL", "c@x.org"), (5, 1, "PERSON", "Ann"), (6, 1, "DATE", "d")]
    df = spark.createDataFrame([(d, s, s + 1, k, t) for d, s, k, t in rows], "doc_id long, start int, end int, entity_type string, text string")
    counters = spark.createDataFrame([("PERSON", 24)], "entity_type string, n long")
    got = {r["placeholder"]: (r["original_text"], r["usage_count"], r["synthetic_value"]) for r in vault.identities(df, counters=counters).collect()}
    assert got["[EMAIL_1]"][:2] == ("b@X.org", 2) and got["[EMAIL_2]"][0] == "a@x.org" and got["[EMAIL_3]"][0] == "c@x.org"
    assert got["[PERSON_25]"][2] == vault.POOLS["PERSON"][0] + " 2" and got["[DATE_1]"][2] == ""


def test_round_trip(spark):
    texts = ["Mail a@b.com, A@B.com or c@d.org; call 212-555-1234. Grüße 😀", "nothing", "", None, "c@d.org"]
    docs = D.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    known = vault.identities(D.exploded(docs, "doc_id"))
    anon = vault.anonymize(docs, known)
    shown = {r["doc_id"]: r["anonymized"] for r in anon.collect()}
    assert shown[0] == "Mail [EMAIL_1], [EMAIL_1] or [EMAIL_2]; call [PHONE_1]. Grüße 😀" and shown[4] == "[EMAIL_2]"
    scope = anon.select("doc_id", F.explode(F.expr(restore.observed("anonymized"))).alias("token")).join(known.select(F.col("placeholder").alias("token"), F.col("original_text").alias("original")), "token")
    back = {r["doc_id"]: r["restored"] for r in restore.restore(anon, scope, "doc_id", "anonymized").collect()}
    assert back[0].lower() == texts[0].lower() and back[1] == "nothing" and back[3] == ""


def test_variants(spark):
    scope = {"[PERSON_1]": "Ann", "[PERSON_12]": "Bob", "[BANK_ACCOUNT_1]": "000"}
    cases = {"[PERSON_1] x": "Ann x", "person 12, PERSON1": "Bob, Ann", "[person_1": "Ann", "XPERSON_1 PERSON_1A PERSON_13": "XPERSON_1 PERSON_1A PERSON_13", "bank_account_1]!": "000!", "éPERSON_1": "éPERSON_1"}
    df = spark.createDataFrame([(1, t) for t in cases], "k int, text string")
    tokens = spark.createDataFrame([(1, a, b) for a, b in scope.items()], "k int, token string, original string")
    for out in (restore.restore(df, tokens, "k"), restore.restore_any(df, tokens, "k")):
        assert {r["text"]: r["restored"] for r in out.collect()} == cases


def test_literals():
    scope = {"Robin Vale": "Ann", "Robin": "Bob", "[EMAIL_1]": "a@b.com"}
    assert restore.resolve_text("Robin Vale, Robin, Robins email 1", scope) == "Ann, Bob, Robins a@b.com"
    assert restore.resolve_text("email 1 [EMAIL_1]", scope, frozenset(["[EMAIL_1]"])) == "email 1 a@b.com"


def _greedy(gold, found):
    cand = []
    for g, (a, b) in enumerate(gold):
        for d, (x, y) in enumerate(found):
            o = min(b, y) - max(a, x)
            dr = max(0, x - a, b - y)
            if o > 0 and dr <= 2 and o / (b - a) >= 0.8 and o / (y - x) >= 0.5:
                cand.append((-o / (b - a), -o / (y - x), dr, abs((y - x) - (b - a)), g, d))
    out = []
    for *_, g, d in sorted(cand):
        if all(g != p and d != q for p, q in out):
            out.append((g, d))
    return out


def test_matching(spark):
    rng = random.Random(8)
    span = lambda: (a := rng.randrange(0, 25), a + rng.randrange(1, 12))
    data = [(i, [span() for _ in range(rng.randrange(0, 5))], [span() for _ in range(rng.randrange(0, 5))]) for i in range(300)]
    full = [(i, [(*s, "X", 1.0, "", "") for s in g], [(*s, "X", 1.0, "", "") for s in f]) for i, g, f in data]
    df = spark.createDataFrame(full, f"i int, gold array<{SPAN}>, found array<{SPAN}>").withColumn("m", F.expr(score.matched("gold", "found")))
    for r in df.collect():
        assert [(z["g"], z["d"]) for z in r["m"]] == _greedy(*data[r["i"]][1:])


def test_feedback(spark):
    rows = [("EMAIL", "NOT_PII")] * 3 + [(None, "EMAIL")] + [("PHONE", "EMAIL")] + [(None, "NOT_PII")]
    got = score.adaptive_thresholds(spark.createDataFrame(rows, "detected_type string, corrected_type string")).collect()
    assert [(r["entity_type"], r["dismissed"], r["added"], round(r["threshold"], 6)) for r in got] == [("EMAIL", 3, 1, 0.6)]


def test_ner(spark):
    text = "Anna Müller aus München " + "wort " * 400 + "traf David Smith in Berlin"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["entity_type"], s["text"], s["start"]) for s in r["ner"]] for r in ner.provide(df, ner.dictionary).collect()}
    assert [(k, t) for k, t, _ in got[1]] == [("PERSON", "Anna Müller"), ("LOCATION", "München"), ("PERSON", "David Smith"), ("LOCATION", "Berlin")]
    assert all(text.encode()[s : s + len(t.encode())].decode() == t for _, t, s in got[1]) and got[2] == got[3] == []
    bounds = [tuple(b) for b in spark.createDataFrame([("ab " * 50,)], "t string").select(F.expr(ner.bounds("t", 20, 5))).first()[0]]
    assert bounds[0] == (0, 18) and bounds[-1][1] == 150 and all(b[0] < a[1] for a, b in zip(bounds, bounds[1:], strict=False))
    assert one(spark, "x", f"size({S.EMPTY})") == 0


def test_scope(spark):
    known = spark.createDataFrame([("[PERSON_1]", "Sam Fox", "Ann"), ("[DATE_1]", "", "1 May"), ("[EMAIL_1]", "s@x.org", "a@b.com")], "placeholder string, synthetic_value string, original_text string")
    frame = lambda rows: spark.createDataFrame(rows, "conv string, token string, original string")
    record = scope.records(frame([("c", "[DATE_1]", None), ("c", "[OLD_1]", "old")]), frame([("c", "[OLD_1]", "new"), ("c", "[GONE_9]", None)]))
    got = {(r["conv"], r["token"]): (r["original"], r["tolerant"]) for r in scope.build_scope(record, frame([("c", "Sam Fox", "Ann!")]), frame([("c", "[EMAIL_1]", None), ("d", "[DATE_1]", None)]), known).collect()}
    assert got == {
        ("c", "[DATE_1]"): ("1 May", True), ("c", "[OLD_1]"): ("new", True), ("c", "Sam Fox"): ("Ann!", True), ("c", "[PERSON_1]"): ("Ann", True),
        ("c", "[EMAIL_1]"): ("a@b.com", False), ("c", "s@x.org"): ("a@b.com", False), ("d", "[DATE_1]"): ("1 May", False),
    }
    off = scope.build_scope(record, frame([]), frame([("c", "[EMAIL_1]", None)]), None)
    assert [(r["token"], r["original"]) for r in off.collect()] == [("[OLD_1]", "new")]
    assert [r["token"] for r in scope.unresolved(frame([("c", "[OLD_1]", None), ("c", "[X_1]", None)]), off).collect()] == ["[X_1]"]


def test_token_predictions(spark):
    text = "Mr José García met Ada, Bob in Köln"
    p = [(3, 5, "PERSON", 0.9), (5, 7, "PERSON", 0.1), (8, 11, "PERSON", 0.7), (19, 22, "PERSON", 0.8), (24, 27, "PERSON", 0.6), (32, 33, "LOCATION", 0.5), (0, 0, "MISC", 1.0)]
    df = spark.createDataFrame([(text, p)], "text string, p array<struct<start:int,end:int,entity_type:string,score:double>>")
    got = df.select(F.expr(ner.token_spans("text", "p")).alias("s")).first()["s"]
    assert [(s["text"], s["entity_type"], round(s["score"], 6)) for s in got] == [("José García", "PERSON", 0.8), ("Ada", "PERSON", 0.8), ("Bob", "PERSON", 0.6), ("Köln", "LOCATION", 0.5)]
    assert all(text.encode()[s["start"] : s["end"]].decode() == s["text"] for s in got)
    assert len(df.select(F.expr(ner.gated(ner.token_spans("text", "p"), {"PERSON": 0.7})).alias("s")).first()["s"]) == 3
