"""Pages, office files, corpora, streams, and the registry."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from maskwright.sources import corpus, files, pages
from maskwright.streaming import jobs


def test_page_text():
    html = "<html><head><title>T</title><style>p{}</style><script>var a='</p>'</script></head><body><p>One <b>two</b><br>three &amp; four</p><div contenteditable>mine</div><template>no</template></body>"
    assert pages.text_of(html) == "T\nOne \ntwo\nthree & four" and pages.text_of(None) == ""


def _zip(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files(spark, tmp_path):
    _zip(tmp_path / "a.docx", {"word/document.xml": "<w:p><w:r><w:t>Hi &amp; &#x41;</w:t><w:tab/><w:t>x</w:t></w:r></w:p>", "word/header1.xml": "<w:p><w:t>Head</w:t></w:p>", "docProps/core.xml": "<dc:creator>Ann</dc:creator>"})
    _zip(tmp_path / "b.PPTX", {f"ppt/slides/slide{n}.xml": f"<a:p><a:t>S{n}</a:t></a:p>" for n in (10, 2)})
    _zip(tmp_path / "c.xlsx", {"xl/sharedStrings.xml": "<sst><si><t>k</t><rPh><t>no</t></rPh></si></sst>", "xl/worksheets/sheet1.xml": '<row r="1"><c t="s"><v>0</v></c><c><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row>'})
    (tmp_path / "d.docx").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest")
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["status"], r["text"]) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("docx", "scanned", "Hi & A\tx\n\nHead\n\nAnn")
    assert got["b.PPTX"] == ("pptx", "scanned", "S2\n\nS10")
    assert got["c.xlsx"] == ("xlsx", "scanned", "k\t5\tin")
    assert [got[n][1] for n in ("d.docx", "e.docx", "f.pdf", "g.txt")] == ["encrypted", "corrupt", "unreadable", "unreadable"]
    assert files.entities("&#xZZ; &nope; &#65;") == "&#xZZ; &nope; A"


def test_office_comments_charts_and_empty_cells(tmp_path):
    def text(name, parts):
        _zip(tmp_path / name, parts)
        return files.office_text((tmp_path / name).read_bytes(), name[-4:])[1].split("\n")

    shared = '<sst><si/><si a="1"><t>one</t></si><si><t>two</t><rPh><t>no</t></rPh></si></sst>'
    sheet = '<row r="1"><c r="A1" s="1"/><c r="B1" t="s"><v>1</v></c><c r="C1" s="1"/><c r="D1" t="s"><v>2</v></c><c t="s"><v>9</v></c></row>'
    more = {"xl/comments1.xml": "<comment><text><r><t>note</t></r></text></comment>", "xl/threadedComments/threadedComment1.xml": "<threadedComment><text>said &amp; done</text></threadedComment>", "xl/charts/chart2.xml": "<a:p><a:r><a:t>Chart</a:t></a:r></a:p>"}
    assert [x for x in text("a.xlsx", {"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet, **more}) if x] == ["one\ttwo", "Chart", "note", "said & done"]
    pptx = text("a.pptx", {"ppt/slides/slide1.xml": "<a:p><a:t>S</a:t></a:p>", "ppt/comments/comment1.xml": "<p:cm><p:text>old</p:text></p:cm>", "ppt/comments/modernComment_1_A.xml": "<a:p><a:t>new</a:t></a:p>"})
    assert [x for x in pptx if x] == ["S", "old", "new"]
    assert text("a.docx", {"word/document.xml": '<w:p><w:t/><w:t>in</w:t><w:del><w:r><w:delText xml:space="preserve"> out</w:delText></w:r></w:del></w:p>'}) == ["in out"]


def test_corpus(spark, tmp_path):
    lines = [{"recordType": "metadata", "schemaVersion": 1}, {"recordType": "example", "id": "1", "text": "aü b", "goldSpans": [{"start": 4, "end": 5, "entity_type": "X", "text": "b"}]}, {"recordType": "example", "id": "2", "text": "aü", "goldSpans": [{"start": 0, "end": 2, "entity_type": "X", "text": "a"}]}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    df = corpus.read_corpus(spark, str(tmp_path / "c.jsonl"))
    assert {r["id"]: r["bad"] for r in df.select("id", corpus.faulty_gold().alias("bad")).collect()} == {"1": False, "2": True}
    corpus.write_corpus(df, "c", str(tmp_path / "out"))
    assert corpus.read_corpus(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "d.jsonl").write_text("{broken")
    with pytest.raises(ValueError, match="1 broken"):
        corpus.read_corpus(spark, str(tmp_path / "d.jsonl"))
    assert corpus.stratified(df, 1, "recordId" if "recordId" in df.columns else "language").count() == 1


def _stream(spark, tmp_path, rows, f):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, at + dt.timedelta(milliseconds=ms), t) for k, ms, t in rows], "k string, ts timestamp, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    f(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_accepted(spark, tmp_path):
    """A repeat within 250 ms of the acceptance goes; it does not renew the time."""
    rows = [("a", 0, "x"), ("a", 200, "x"), ("a", 300, "x"), ("a", 310, "y"), ("a", 320, "x"), ("b", 0, "x")]
    got = _stream(spark, tmp_path, rows, lambda s: jobs.accepted(s, "k"))
    assert sorted((r["k"], r["ts"].microsecond // 1000, r["text"]) for r in got) == [("a", 0, "x"), ("a", 300, "x"), ("a", 310, "y"), ("a", 320, "x"), ("b", 0, "x")]


def test_changed(spark, tmp_path):
    got = _stream(spark, tmp_path, [("a", 0, "x"), ("a", 1, "x"), ("a", 2, "y"), ("b", 3, "y")], lambda s: jobs.changed(s, "k"))
    assert sorted((r["k"], r["text"]) for r in got) == [("a", "x"), ("a", "y"), ("b", "y")]


def test_debounced(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 300, "y"), ("a", 2000, "z"), ("a", 400_000, "end")]
    got = _stream(spark, tmp_path, rows, lambda s: jobs.debounced(s, "k", late="1 second"))
    assert sorted((r["text"], r["changes"]) for r in got)[:2] == [("y", 2), ("z", 1)]


def test_registry(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert names["detect_documents"](spark, "/root/testdata/sf0.001").filter(F.col("start") >= F.col("end")).isEmpty()


def _same(spark, tmp_path, name, tables):
    """The query's rows are those of its SQL over the given tables; the rows."""
    import duckdb

    db = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(str(tmp_path / f"{table}.parquet"))
        db.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)
    return got


def test_turn_keys_take_whole_texts(spark, tmp_path):
    long = "Word  and\u00a0Blank " * 50
    turns = spark.createDataFrame([(1, 1, long + "x"), (1, 2, long + "y"), (1, 3, " " + long.upper() + "X\n"), (1, 4, None)], "conv_id long, turn int, text string")
    key = {r[1]: r[2] for r in _same(spark, tmp_path, "turn_keys", {"conversations": turns})}
    assert key[1] != key[2] and key[1] == key[3]


def test_text_offsets_reach_the_end(spark, tmp_path):
    text = "ñ" * 150 + "a😀" * 201
    docs = spark.createDataFrame([(1, text), (2, None), (3, "é")], "doc_id long, text string")
    got = {r[:2]: r[2:4] for r in _same(spark, tmp_path, "text_offsets", {"documents": docs})}
    assert got[1, 4] == (len(text.encode()), len(text)) and got[2, 4] == (0, 0) and got[3, 4] == (2, 1)
