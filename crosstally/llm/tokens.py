"""Token counts through a digest cache.

A text's key is the SHA-256 of its content and the SHA-256 of the tokenizer file. Counts live in a Parquet folder
of (content, version, n_bytes, n_tokens). A run joins its texts' digests to that folder, encodes each distinct text that
has no entry once, appends those entries, and joins again. The text itself is shuffled once, by its row's id, so
copies of one text don't meet in a task.

Content is normalised only where the count can't change: a null text is an empty one.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_evenly, saved, small_batches

_SCHEMA = "content binary, version string, n_bytes long, n_tokens long"
_ENCODE_BYTES = 1 << 20  # texts of about this many bytes are encoded in one call


def version_of(path: str) -> str:
    """Digest of the tokenizer file: counts by another file are never taken from the cache."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        return lambda texts: [len(e) for e in known.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]


def encoded(texts: DataFrame, path: str, version: str) -> DataFrame:
    """Cache entries of a frame (content, text) by the library that reads the file at ``path`` (on every executor)."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            texts, sizes, counts, block, held = batch.column(1), [], [], [], 0
            for text in texts:
                block.append(text.as_py())
                sizes.append(len(block[-1].encode("utf-8", "surrogatepass")))
                held += sizes[-1]
                if held >= _ENCODE_BYTES:
                    counts += count(block)
                    block, held = [], 0
            counts += count(block) if block else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.binary()), pa.array([version] * len(sizes), pa.string()),
                 pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["content", "version", "n_bytes", "n_tokens"],
            )

    return texts.select("content", "text").mapInArrow(run, _SCHEMA)


def cache(spark, folder: str, version: str) -> DataFrame:
    """Entries of one tokenizer version; none while the folder doesn't exist. Entries written twice count once."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(folder).where(F.col("version") == version).dropDuplicates(["content"])


def counts(docs: DataFrame, path: str, folder: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text; new texts' entries are appended to ``folder``.

    Null texts count as empty ones; repeated rows give a row each (and may be encoded more than once); a null id keeps its row; extra columns are
    ignored; an empty table gives no rows and appends nothing.
    """
    spark, version = docs.sparkSession, version_of(path)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"), "text")
    rows = saved(keyed.select("doc_id", "content"), "digests")
    contents = saved(rows.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "contents")
    missing = contents.select("content", "first").join(
        cache(spark, folder, version).select("content"), "content", "left_anti")
    # One row for each missing text, found by its row's id and digest: equal texts have different ids.
    once = keyed.join(
        missing.hint("shuffle_hash").select(F.col("content").alias("wanted"), "first"),
        (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("first")),
    ).select("content", "text")
    encoded(once, path, version).write.mode("append").parquet(folder)
    known = saved(cache(spark, folder, version).select("content", "n_bytes", "n_tokens").join(contents.drop("first"), "content"), "known")
    return joined_evenly(rows, known, "content", "rows").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
