"""Token counts through a cache keyed by content digest and tokenizer digest.

Content is normalised first, as far as that provably leaves the count unchanged: a piece model whose
rule is the identity reads a blank and its mark alike, so blanks become marks; all other texts stay
as they are. Texts are reduced to (key, digest, bytes), and digests that the cache lacks are the
misses. Texts are pre-aggregated to one for each digest before and after the only shuffle that holds
texts, so equal texts are encoded once and a group of copies of any size stays distributed. Counts
are appended to the cache, and every row then takes its count from there.

The cache is a Parquet table that grows by whole appends. A digest that two runs append at once is
stored twice, with the same count, and read once. Spark commits an append's files one by one as its
last step: what a failed run may leave are complete, correct entries.

Defined results: a null text counts as the empty one (0 tokens); a null key is kept; repeated
rows each get their count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import materialise

#: Misses (32 bytes each) up to which they are sent to all tasks.
BROADCAST = 100_000
CACHE = "tokenizer string, digest binary, n_tokens long"
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: SHA-256 of its file and the rule it is run by."""
    return hashlib.sha256(Path(path).read_bytes() + b"|normalised").hexdigest()


def _processor(path: str) -> object:
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def normalised(text: Column, path: str) -> Column:
    """The text as the tokenizer's own normalisation leaves it, where that is known, else as it is."""
    probe = " A\u0301  \ufb01\u00a0x\u2581\t "
    if path.endswith(".model") and _processor(path).normalize(probe) == "\u2581" + probe.replace(" ", "\u2581"):
        return F.translate(text, " ", "\u2581")
    return text


def token_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the library for ``path`` (.json or .model) gives them, none added."""
    if path.endswith(".model"):
        return [len(x) for x in _processor(path).encode(texts, num_threads=1)]
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return [len(x.ids) for x in _loaded[path].encode_batch(texts, add_special_tokens=False)]


def runs(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``most`` bytes; then unused memory goes back."""
    step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
    pa.default_memory_pool().release_unused()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row; misses are appended to ``cache``."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    content = normalised(body, tokenizer)
    digest = F.unhex(F.sha2(content, 256))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # so that it exists
    known = lambda: spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    rows = materialise(docs.select(F.col(key).alias("key"), digest.alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")), "token-digests")
    misses = materialise(rows.select("digest").distinct().join(known(), "digest", "left_anti"), "token-misses")
    few = misses.count() <= BROADCAST
    texts = docs.select(digest.alias("digest"), content.alias("content"))
    if few:
        texts = texts.join(F.broadcast(misses), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
    if not few:
        texts = texts.join(misses, "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, 4_000_000):
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array(token_lengths(run.column(1).to_pylist(), tokenizer), pa.int64())], ["digest", "n_tokens"])

    counted = texts.mapInArrow(encode, "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return rows.join(known(), "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
