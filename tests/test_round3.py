"""Work that grows no faster than the input: lists, pieces, dictionaries and tables of one row group."""

import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.operators import detect as D
from maskwright.operators import ner, policy, tokens
from maskwright.plans import registry, streams
from maskwright.schema import INNER, RECOGNIZERS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_list_patterns_are_gated(spark):
    """a text without a pattern's longest piece is not searched; letters that match only case apart still count."""
    texts = ["an Idiot, idiot;idiots", "İdıot and ſick", "nothing", None, "_idiot idiot-", "say a@Example.com.", "!x!x !x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    found = lambda p: {(r.id, r.s.start, r.s.text) for r in df.select("id", F.explode(F.expr(policy.pattern_spans("coalesce(t, '')", p))).alias("s")).collect()}
    assert found("idiot") == {(0, 3, "Idiot"), (0, 10, "idiot"), (1, 0, "İdıot"), (4, 7, "idiot")}
    assert found("sick") == {(1, 12, "ſick")}
    assert found("*@example.com") == {(5, 4, "a@Example.com")}
    assert found("!x") == {(6, 0, "!x"), (6, 5, "!x")}
    assert "contains" in policy.pattern_spans("t", "idiot") and policy._gate("t", "*") == "true"


def test_chunks_of_many_pieces(spark):
    """F8: chunks cost the pieces, not their square; bounds are those of the fold in SQL."""
    rows = lambda n: spark.createDataFrame([(1, "ab " * n)], "key int, text string").withColumn("pieces", F.expr("transform(regexp_extract_all(text, '[^ ]+', 0), w -> concat('▁', w))"))
    began = time.time()
    got = tokens.chunked(tokens.aligned(rows(60_000), framed=False)).agg(F.count(F.lit(1)), F.max("end_char")).first()
    assert tuple(got) == (145, 180_000) and time.time() - began < 30
    small = tokens.aligned(rows(50), framed=False)
    fold = [(b.start, b.end) for b in small.select(F.expr(tokens.bounds("places", "text", 7, 2))).first()[0]]
    assert fold == [(r.start_char, r.end_char) for r in tokens.chunked(small, 7, 2).orderBy("chunk").collect()]


@pytest.mark.parametrize("pieces", [["▁ab", "cd", "▁ef"], ["ab", "##cd", "⁇", "ef"], ["ab", "", "cdef"]])
def test_pieces_folded_at_once(pieces):
    """pieces without control tokens are folded in one go and stand where they did one by one."""
    text = "ÄBcd éf"
    wants = tokens._folded_all(["▁Äb", *pieces[1:]], any(p.startswith("##") for p in pieces))
    assert wants is not None and tokens._folded_all(["<s>", *pieces], False) is None
    places = tokens.align(text, pieces)
    assert places[0] == (0, 2) and places[-1] == ((5, 7) if pieces[-1] != "cdef" else None)


def test_short_texts_stay_in_their_row(spark):
    """texts of one chunk get the provider's spans without a shuffle; longer ones as before."""
    rows = [(1, "Berlin, Anna Müller"), (2, None), (3, "x " * 40 + "Berlin " + "y " * 40)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = lambda size: {r.doc_id: [(s.text, s.start) for s in r.ner] for r in ner.provide(df, ner.dictionary, size=size).collect()}
    assert got(5000) == got(30) == {1: [("Berlin", 0), ("Anna Müller", 8)], 2: [], 3: [("Berlin", 80)]}
    short = ner.provide(df, ner.dictionary).filter("false or char_length(coalesce(text, '')) <= 5000")
    assert "contains" in ner.dictionary_spans("text") and "Union" in _plan(ner.provide(df, ner.dictionary)) and short.count() == 3


def test_one_row_group_meets_all_cores(spark, tmp_path):
    """A table whose rows lie in one row group is dealt out before it is searched."""
    spark.range(3000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = registry.derived(spark, str(tmp_path))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 4 and rows.count() == 3000
    spark.range(40_000).repartition(8).write.parquet(f"{tmp_path}/even.parquet")
    even = spark.read.parquet(f"{tmp_path}/even.parquet")
    assert registry.dealt(even, "id") is even


def test_one_recognizer_alone(spark):
    """a query of one type runs that type's recognizer only."""
    df = spark.createDataFrame([(1, "card 4539 1488 0343 6467, a@b.org, 212-555-0100")], "doc_id int, text string")
    one = D.exploded(D.raw_spans(df, kinds=("CREDIT_CARD",)), "doc_id")
    every = D.exploded(D.raw_spans(df), "doc_id").filter("entity_type = 'CREDIT_CARD'")
    keep = ["start", "end", "entity_type", "score", "text"]
    assert one.select(*keep).collect() == every.select(*keep).collect() and len(one.collect()) == 1


def test_first_event_is_not_late(spark, tmp_path):
    """the event with number 0 is taken, though watermarks begin with 1970."""
    rows = [(n, 5, "error") for n in (0, 7)] + [(n, 6, "view") for n in (1, 4)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00'"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = streams.stream_moves(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(5, 7, "error", "p0", "p1")]


@pytest.mark.parametrize("name", ["restore_roundtrip", "restore_mangled"])
def test_restored_to_the_first_spelling(spark, tmp_path, name):
    """the SQL restores what the vault keeps, the first spelling of an identity, not each document's own."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["write to Bob@corp.example now", "write to bob@corp.example now", "from BOB@corp.example, then eve@corp.example", None, "nothing"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.sql(registry.SQL[name]).fetchall())
    assert want == {r.doc_id: r.digest for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert want[0] == want[1]


def test_line_end_parts_tokens_from_spans(spark):
    """a keyword on the line before counts; it was taken for a token that crosses into the span."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["ssn\n123-45-6789", "ssn\n\n123-45-6789\nx", "ssn-123-45-6789", "x 123-45-6789\nssn", "x 123-45-6789-ssn"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in D.exploded(D.detect(df), "doc_id").select("doc_id", "start", "end", F.round("score", 6)).orderBy("doc_id", "start").collect()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = con.sql(f'select doc_id, start, "end", score from ({registry.SQL["detect_documents"]}) order by 1, 2').fetchall()
    assert got == want and [r[3] for r in got] == [0.95, 0.95, 0.8, 0.95, 0.8]


def test_few_spans_are_folded_at_once(spark):
    """up to a few spans need no islands; beyond them the merge is the same."""
    one = lambda n: [(i * 3, i * 3 + (7 if i % 3 else 2), "DATE" if i % 2 else "PERSON", 0.5 + i % 5 / 10, "x", "regex", 0, 0, i) for i in range(n)]
    df = spark.createDataFrame([(n, one(n)) for n in range(20)], f"n int, spans array<{INNER}>")
    merged = {r.n: [s.seq for s in r.m] for r in df.select("n", F.expr(S.merged("spans")).alias("m")).collect()}
    few, S._FEW = S._FEW, 0
    try:
        assert merged == {r.n: [s.seq for s in r.m] for r in df.select("n", F.expr(S.merged("spans")).alias("m")).collect()}
    finally:
        S._FEW = few


def test_texts_without_matches_are_not_split(spark):
    """a text is split only where the pattern matches, and tests before a match change none."""
    plain = S.matches("t", "a+", "MISC", 1.0, "regex", 0)
    assert plain.index("size(zm) = 0") < plain.index("split(")
    pieces = ["4539 1488 0343 6467", "x4539-1488-0343-6467", "٤٥٣٩ ١٤٨٨ ٠٣٤٣ ٦٤٦٧", "1.2.3.4", "301.2.3.4.5", "DE89 3704 0044 0532 0130 00", "(030) 123 456", "+49 30 12345678", "May 5, 2021", "May 5 2021 1/2/2021", "2021-03-04", "123-45-6789", "é123-45-6789", "a.b@c.org", "", "no"]
    df = spark.createDataFrame([(a + " " + b,) for a in pieces for b in pieces], "t string")
    for kind, pattern, _ in RECOGNIZERS:
        plainly = f"regexp_extract_all(t, {S.quoted('(?U)' + pattern)}, 0)"
        rows = df.select(F.expr(plainly).alias("want"), F.expr(f"transform({S.matches('t', '(?U)' + S._FIRST.get(kind, '') + pattern, kind, 1.0, 'regex', 0)}, s -> s.text)").alias("got"), F.expr(S._GATES.get(kind, "true").format("t")).alias("gate"))
        rows = rows.collect()
        assert [r.want for r in rows] == [r.got for r in rows] and any(r.want for r in rows)
        assert all(r.gate for r in rows if r.want)


def test_narrow_rows_are_dealt_sooner(spark, tmp_path):
    """five tasks for four cores take two rounds; customers are dealt out, wider tables stay as they are."""
    spark.range(5000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name")).repartition(5).write.parquet(f"{tmp_path}/customer.parquet")
    # one file a task
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "32k")
    try:
        rows, kept = registry.derived(spark, str(tmp_path)), registry.read(spark, str(tmp_path), "customer")
        assert rows.rdd.getNumPartitions() >= 16 and rows.count() == 5000
        assert kept.rdd.getNumPartitions() == 5 and registry.dealt(kept, "c_custkey") is kept
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
