"""Benchmark corpora in JSON lines, with strict checks, and their sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "recordType string, id string, language string, lengthBucket string, text string, goldSpans array<struct<start:int,end:int,entity_type:string,text:string>>, source struct<dataset:string,recordId:string,split:string,uid:string,region:string,script:string,sourceFile:string,sourceRow:int>, schemaVersion int, corpusId string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a corpus; fails on a broken line, without exactly one metadata record, or without examples."""
    lines = spark.read.text(path).filter("trim(value) != ''").select("value", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    told = lines.agg(F.count_if(F.col("r.recordType").isNull() | ~F.col("r.recordType").isin("metadata", "example")).alias("broken"), F.count_if(F.col("r.recordType") == "metadata").alias("metadata"), F.count_if(F.col("r.recordType") == "example").alias("examples")).first()
    if told["broken"] or told["metadata"] != 1 or not told["examples"]:
        raise ValueError(f"{told['broken']} broken lines, {told['metadata']} metadata records and {told['examples']} examples")
    return lines.filter("r.recordType = 'example'").select("r.*").drop("recordType", "schemaVersion", "corpusId")


def faulty_gold() -> Column:
    """Whether a gold span is out of bounds, cuts a character or differs from its slice of the text."""
    slice_ = "substring(encode(text, 'utf-8'), g.start + 1, g.end - g.start)"
    return F.expr(f"exists(goldSpans, g -> g.start < 0 or g.start >= g.end or g.end > octet_length(text) or not ({slice_} <=> encode(g.text, 'utf-8')))")


def write_corpus(examples: DataFrame, corpus_id: str, path: str, validate: bool = False) -> None:
    """A metadata record and the examples as JSON lines; with ``validate`` fails before it writes if an id is repeated or a gold span faulty.

    Spark's commit puts the files in place as its last step, so a failed write leaves no corpus.
    """
    spark = examples.sparkSession
    faulty = examples.filter(faulty_gold()).count() if validate else 0
    repeated = examples.groupBy("id").count().filter("count > 1").count() if validate else 0
    if faulty or repeated:
        raise ValueError(f"{faulty} examples with faulty gold spans, {repeated} repeated ids")
    meta = spark.createDataFrame([("metadata", 1, corpus_id, "utf8-bytes")], "recordType string, schemaVersion int, corpusId string, spanOffsetUnit string")
    meta.unionByName(examples.withColumn("recordType", F.lit("example")), allowMissingColumns=True).write.json(path)


def stratified(examples: DataFrame, limit: int, *strata: str, order: str = "id") -> DataFrame:
    """The first ``limit`` examples of each stratum; ties in ``order`` by id."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order, "id"))
    return examples.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
