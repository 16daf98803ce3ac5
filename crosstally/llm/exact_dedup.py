"""Exact deduplication with frequent texts split off, by DataFrame functions only.

Texts are known by the SHA-256 of their whitespace-normalised form. A Misra-Gries summary (Spark's frequent-items sketch, a
bounded set of counters that is decremented when full) is built over digests in every partition and merged in two steps. It
holds every digest with more than 3.5 / ``TRACKED`` of all rows. Its digests are counted exactly and their winners found by
an aggregation that folds before it shuffles; this table of at most ``TRACKED`` rows is broadcast, and the
rows it covers are decided where they are read. All other digests have a small share of rows each and meet by an ordinary
shuffle of (digest, id) rows. Texts themselves are never shuffled to be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Counters of a summary: the most digests that are split off.
TRACKED = 4096
#: Summaries of the first merging step.
MERGED = 64


def digest(text):
    """Hex SHA-256 of a text in which every run of ASCII white space is one space; a null text is empty."""
    normal = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(normal.cast("binary"), 256)


def _numbered(docs: DataFrame, *columns) -> DataFrame:
    """The columns with each row's number, to be written before it is used; its upper bits are the task's number."""
    return docs.select(*columns, F.monotonically_increasing_id().alias("_row"))


def frequent(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """digest, group_size, keep_id and keep_row of digests that are frequent in (doc_id, digest, _row): all with more than
    3.5 / ``tracked`` of the rows, others possibly, ``tracked`` at most."""
    sketches = rows.groupBy(F.pmod(F.shiftright("_row", 33), F.lit(MERGED)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    # Grouped by a constant: combining nothing at all is an error.
    found = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {tracked})").alias("found"))
    candidates = found.select(F.explode("found.item").alias("digest"))
    sizes = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"))
    first = rows.withColumnRenamed("digest", "of").join(
        F.broadcast(sizes), (F.col("of") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return first.groupBy("digest", "group_size", "keep_id").agg(F.min("_row").alias("keep_row"))


def _rare(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Decisions on the rows whose digest isn't in ``heavy``."""
    group = Window.partitionBy("digest")
    turn = group.orderBy(F.col("doc_id").asc_nulls_last(), "_row")
    return rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "doc_id", F.first("doc_id").over(turn).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(turn) == 1).alias("kept"), "digest", "_row")


def groups(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Whole texts are equal if they are identical after every run of ASCII white space became one space; ends are not trimmed, a
    null text is empty. The row with the smallest doc_id stays (an id before a null one; of rows that repeat an id one).
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = saved(_numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    heavy = saved(frequent(rows, tracked), "frequent")
    covered = rows.join(F.broadcast(heavy), "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "digest", "_row")
    return covered.unionByName(_rare(rows, heavy)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The rows that stay, with all their columns; see ``groups`` for which. The documents are written once, numbered."""
    rows = saved(_numbered(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_doc"),
                           docs["doc_id"].cast("long").alias("doc_id"), digest(docs["text"]).alias("digest")), "documents")
    keys = rows.select("doc_id", "digest", "_row")
    heavy = saved(frequent(keys, tracked), "frequent")
    winners = rows.join(F.broadcast(heavy.select("digest", "keep_row")), "digest").where(F.col("_row") == F.col("keep_row"))
    stays = _rare(keys, heavy).where("kept").select("_row")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(stays, "_row", "left_semi")
    return winners.select("_doc").unionByName(rest.select("_doc")).select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL for the rows of ``groups`` over table documents.
ORACLE = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM digests
"""
