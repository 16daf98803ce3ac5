"""Removal of boilerplate lines by their spread over sites, with DataFrame functions only.

Each line is known by a hash. A HyperLogLog sketch of the sites it appears on is built for every line hash, merged
by aggregation. Lines whose estimate is clearly at or above ``min_sites`` are boilerplate, lines clearly below are not;
the few whose estimate is near the threshold get an exact count of distinct sites. A boilerplate line stays in
the document with the smallest id that has it and goes from all others.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_evenly, saved

#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(2 ** LOG_K).
LOG_K = 10
_BLANKS = r" \t\r"


def _trimmed(line):
    return F.btrim(line, F.lit(" \t\r"))


def _split(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    """96 bits of the line's trimmed text."""
    return F.struct(F.xxhash64(_trimmed(line)).alias("h"), F.hash(_trimmed(line)).alias("g"))


def spread(docs: DataFrame, min_sites: int) -> DataFrame:
    """key, sites (exact near the threshold, else estimated), keeper (smallest doc_id) and rows (documents) of all lines on
    ``min_sites`` or more sites. A null source is a site of its own; blank lines don't count."""
    lines = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"),
                    F.explode(F.array_distinct(F.transform(_split(F.col("text")), _trimmed))).alias("line"))
        .where("line <> ''")
        .select(_key(F.col("line")).alias("key"), "doc_id", "site")
    )
    sketched = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("sites"), F.min("doc_id").alias("keeper"),
        F.count("*").alias("rows"),
    )
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(2**LOG_K) * min_sites))
    wide = saved(sketched.where(F.col("sites") >= min_sites - band), "sketched")
    near = wide.where(F.col("sites") <= min_sites + band)
    exact = joined_evenly(lines, near.select("key", "rows"), "key", "rows").groupBy("key").agg(F.countDistinct("site").alias("exact"))
    return (
        wide.join(exact, "key", "left")
        .select("key", F.coalesce("exact", "sites").alias("sites"), "keeper", "rows").where(F.col("sites") >= min_sites)
    )


def _with_hits(docs: DataFrame, min_sites: int) -> DataFrame:
    """doc_id and text with the keys of the lines to remove, ``hits`` (null: none)."""
    boilerplate = saved(spread(docs, min_sites).select("key", "keeper", "rows"), "boilerplate")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_split(F.col("text"))).alias("line")).select(
        "doc_id", _key(F.col("line")).alias("key"))
    hits = (
        joined_evenly(lines, boilerplate, "key", "rows").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id").agg(F.collect_set("key").alias("hits"))
        .select(F.col("doc_id").alias("hit_id"), "hits")
    )
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return row.join(hits, F.col("row.doc_id").cast("long").eqNullSafe(F.col("hit_id")), "left")


def _kept(text, hits):
    lines = _split(text)
    left = F.when(hits.isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(hits, _key(x))))
    return lines, left


def boilerplate_removed(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """doc_id, text without boilerplate lines, n_lines, n_removed of every row.

    Lines are compared without spaces, tabs and carriage returns at their ends. Remaining lines are joined by a
    newline unchanged; a null text counts as empty, which is one blank line. A null id is never a keeper unless no
    row with an id has the line. Rows that repeat an id are one document. Extra columns are ignored; an empty
    table gives no rows.
    """
    lines, left = _kept(F.col("row.text"), F.col("hits"))
    return (
        _with_hits(docs, min_sites)
        .select(F.col("row.doc_id").alias("doc_id"), lines.alias("lines"), left.alias("left"))
        .select("doc_id", F.array_join("left", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"),
                (F.size("lines") - F.size("left")).cast("long").alias("n_removed"))
    )


def without_boilerplate(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """The rows with all their columns and cleaned texts; n_chars, where there, follows the text.

    A document of which only blank lines are left goes; one that was blank before stays.
    """
    lines, left = _kept(F.col("row.text"), F.col("hits"))
    blank = lambda xs: F.forall(xs, lambda x: _trimmed(x) == "")
    out = _with_hits(docs, min_sites).select("row", "hits", lines.alias("lines"), left.alias("left")).where(
        F.col("hits").isNull() | ~blank(F.col("left"))
    )
    text = F.when(F.col("hits").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        size = F.when(F.col("hits").isNull(), F.col("row.n_chars")).otherwise(F.length(text))
        new["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def oracle(min_sites: int) -> str:
    """DuckDB SQL for the rows of ``boilerplate_removed`` over table documents."""
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
spread AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {min_sites}),
flagged AS (
  SELECT k.doc_id, k.n, k.line, s.key IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN spread s ON k.key = s.key)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
       count(*) FILTER (gone) AS n_removed
FROM flagged GROUP BY doc_id
"""
