"""The registered queries of the operators and the SQL they can be checked against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, centroids, codes, decontam, exact_dedup, hmm, html_template, lines, pieces, quality, simhash, tokens, warc
from .common import new_folder, table

MIN_SITES = 5


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.boilerplate_removed(table(spark, folder, "documents"), MIN_SITES)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.main_texts(table(spark, folder, "pages"))


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.scores(table(spark, folder, "documents"))


def op6_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"))


def op7_sentencepiece(spark: SparkSession, folder: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path(model))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_token_counts(spark: SparkSession, folder: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Starts with an empty cache of its own, so that every distinct text is encoded."""
    return tokens.counts(table(spark, folder, "documents"), public_tokenizers.path(tokenizer), new_folder(spark, "counts"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(table(spark, folder, "embeddings"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.codes(table(spark, folder, "embeddings"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_line_dedup, op3_decontamination, op4_html_extraction, op5_lm_scoring, op6_nearest_neighbours,
    op7_sentencepiece, op8_quality, op9_token_counts, op10_warc, op11_centroid_clustering, op12_vector_codes, op13_exact_dedup)}

ORACLES = {
    "op2_line_dedup": lines.oracle(MIN_SITES),
    "op11_centroid_clustering": centroids.oracle(),
    "op12_vector_codes": codes.oracle(),
    "op13_exact_dedup": exact_dedup.ORACLE,
}
