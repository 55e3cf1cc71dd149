"""The pipeline's stages, each against what it says, on the smallest tables and on edge rows."""

import corpus_pipeline as P
from maskwright.llm.common import materialise

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(spark, docs, DIR), "t")
        assert out.columns == docs.columns, name
        docs = out
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    # enough labels to learn from
    large = DIR.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in P.quality_stage(spark, spark.read.parquet(f"{large}/documents.parquet"), large).select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.95
    pieces = P.STAGES[-1][1](spark, docs, DIR).toPandas()
    ends = pieces.groupby("sequence_id")["length"].sum()
    assert ends.max() <= 2048 and pieces["length"].min() > 0


def test_pipeline_edges(spark, edges, none):
    for docs in (edges.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in P.STAGES[1:-1]:
            out = stage(spark, docs, DIR)
            assert out.columns == docs.columns
            out.count()
