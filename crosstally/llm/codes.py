"""Vector codes: each vector is cut into parts and each part replaced by the number of its nearest codebook entry.

Parts are sorted along a Hilbert curve and laid into flat blocks, which also keep the smallest box around their parts
and the parts' sum. In a round a block first compares its box with the codebook: an entry that is farther from the box's
nearest point than some other entry from its farthest can't be nearest to any part. What is left is the block's
shortlist. If that is one entry, the stored sum is all a round needs; otherwise a small integer kernel compares the block's
parts with the shortlist. All arithmetic is on integers, so ties are real and go to the lower index.

Blocks are built once by a range shuffle and written; equal parts are spread by their row's number, so a block never outgrows
``BLOCK`` and a task never gets all copies of one vector. Rounds read blocks and hand on one sum per entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, finite, floors, joined_evenly, lists, matrix, saved, small_batches, widened

#: Parts of a block.
BLOCK = 256
_BLOCKS = "part int, ids array<long>, x array<long>, low array<long>, high array<long>, total array<long>"
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell numbers (``bits`` bits a dimension) along a Hilbert curve; at most 62 bits in all.

    Goes from the cell to the curve's transposed position: from the highest bit down, each dimension either reflects
    the lower bits of the first or swaps them with it, then the bits are Gray-decoded across dimensions.
    """
    x = grid.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(len(x)):
            reflect = (x[d] >> bit & 1).astype(bool)
            swap = (x[0] ^ x[d]) & low
            x[0] = np.where(reflect, x[0] ^ low, x[0] ^ swap)
            x[d] = np.where(reflect, x[d], x[d] ^ swap)
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    odd = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        odd ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= odd
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | (row >> bit & 1)
    return out


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries, ascending, that can be nearest to a point of the box, ties included."""
    near = (np.maximum(np.maximum(low - entries, entries - high), 0) ** 2).sum(1)
    far = (np.maximum(abs(entries - low), abs(high - entries)) ** 2).sum(1)
    return np.flatnonzero((near <= far.min()).astype(bool))


def nearest(x: np.ndarray, entries: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of the shortlisted entries to each part, and the squared distance."""
    distance = ((x[:, None] - entries[short]) ** 2).sum(2)
    at = distance.argmin(1)
    return short[at], distance[np.arange(len(x)), at]


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of sorted (part, key, row, x)."""

    def block(part: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), lists(ids[None]), lists(x.reshape(1, -1)), lists(x.min(0)[None]), lists(x.max(0)[None]),
             lists(x.sum(0)[None])], names=["part", "ids", "x", "low", "high", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, x = None, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            parts, row = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = matrix(batch.column(3)) if batch.num_rows else x[:0]
            for p in np.unique(parts):  # sorted by part
                if p != part and len(ids):
                    yield block(part, ids, x)
                    ids, x = ids[:0], x[:0]
                part, of = p, parts == p
                ids, x = np.concatenate([ids, row[of]]), np.concatenate([x, values[of]])
                while len(ids) >= BLOCK:
                    yield block(part, ids[:BLOCK], x[:BLOCK])
                    ids, x = ids[BLOCK:], x[BLOCK:]
        if len(ids):
            yield block(part, ids, x)

    return rows.mapInArrow(run, _BLOCKS)


def _read(batch: pa.RecordBatch, width: int, books: np.ndarray) -> Iterator[tuple]:
    """part, ids, parts, box and sum of each block, with the part's entries, all wide enough for exact distances."""
    for i in range(batch.num_rows):
        part, ids, x, low, high, total = (c[i].values.to_numpy() if k else c[i].as_py() for k, c in enumerate(batch.columns))
        entries, low, high = widened(width, books[part], low, high)
        yield part, ids, x.reshape(-1, width).astype(entries.dtype), low, high, total, entries


def _sums(blocks: DataFrame, books: np.ndarray) -> dict[tuple[int, int, int], int]:
    """(part, entry, component): the sum over the entry's parts, and at component -1 their number."""
    shared, width = blocks.sparkSession.sparkContext.broadcast(books), books.shape[2]  # parts x entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, sizes = np.zeros(books.shape, dtype=object), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for part, ids, x, low, high, total, entries in _read(batch, width, books):
                short = shortlist(low, high, entries)
                if len(short) == 1:
                    sums[part, short[0]] += total
                    sizes[part, short[0]] += len(ids)
                    continue
                at, _ = nearest(x, entries, short)
                for e in np.unique(at):
                    sums[part, e] += x[at == e].sum(0)
                    sizes[part, e] += (at == e).sum()
        for part, e in zip(*np.nonzero(sizes)):
            values = [str(int(v)) for v in (sizes[part, e], *sums[part, e])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part)] * len(values), pa.int32()), pa.array([int(e)] * len(values), pa.int32()),
                 pa.array(range(-1, width), pa.int32()), pa.array(values)], names=["part", "entry", "place", "total"])

    added = blocks.mapInArrow(run, "part int, entry int, place int, total string").groupBy("part", "entry", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {(r.part, r.entry, r.place): int(r.total) for r in added.collect()}  # parts x entries x (components + 1) rows


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """row, code and error of every vector."""
    shared, (parts, _, width) = blocks.sparkSession.sparkContext.broadcast(books), books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, x, low, high, _, entries in _read(batch, width, shared.value):
                at, error = nearest(x, entries, shortlist(low, high, entries))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(at.astype(np.int64) << 4 * (parts - 1 - part)), pa.array(error.tolist(), pa.int64())],
                    names=["row", "digit", "error"])

    found = blocks.mapInArrow(run, "row long, digit long, error long").groupBy("row").agg(
        F.sum("digit").alias("digits"), F.sum("error").alias("error"))
    # One hex digit an index, each written as two.
    return found.select("row", F.regexp_replace(F.lower(F.lpad(F.hex("digits"), parts, "0")), "(.)", "0$1").alias("code"), "error")


def codes(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    Components become floor(scale * x). A part's codebook starts as that part of the ``entries`` (16 at most) rows with the
    smallest ids, null ids last, equal ids by their components; fewer rows give fewer entries. Every row counts, repeated
    ones too. Vectors have the length that most have (the smaller of two such), others and empty ones belong to another
    table and take no part; a length that ``parts`` (15 at most) doesn't divide is filled up with zeros. A component of 2**55 / scale or
    more, or an error beyond a long, is an ArithmeticError or OverflowError. Extra columns are ignored; an empty table gives
    no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = F.col("embedding").cast("array<double>")
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("v")).where(
        finite(F.col("v")) & (F.size("v") > 0))
    common = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], _RESULT)
    scratch = Scratch(spark, "codes")
    kept = scratch.saved(usable.where(F.size("v") == common.d).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"))
    width = -(-common.d // parts)

    def whole(column) -> np.ndarray:
        x = floors(column, scale)
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))

    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = whole(np.array([r.v for r in start])).reshape(len(start), parts, width).transpose(1, 0, 2)
    span = kept.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    bits = max(1, min(16, 62 // width))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(matrix(batch.column(1))).reshape(-1, width)
            share = (x / scale - span.low) / max(span.high - span.low, 1e-300)
            grid = np.clip(share * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)[:, : 62 // bits]
            part = np.tile(np.arange(parts), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(hilbert(grid, bits)), pa.array(np.repeat(batch.column(0).to_numpy(), parts)),
                 lists(x)], names=["part", "key", "row", "x"])

    sorted_parts = kept.select("row", "v").mapInArrow(cut, "part int, key long, row long, x array<long>").repartitionByRange(
        "part", "key", F.xxhash64("row")).sortWithinPartitions("part", "key")
    blocks = scratch.saved(_blocks(sorted_parts, width))
    for _ in range(rounds):
        totals, moved = _sums(blocks, books), books.copy()
        for (part, e, place), total in totals.items():
            if place >= 0:
                moved[part, e, place] = total // totals[part, e, -1]
        books = moved
    found = saved(_coded(blocks, books).join(kept.select("row", "vec_id", "label"), "row").select("vec_id", "label", "code", "error"), "codes")
    scratch.remove()
    sums = saved(found.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows")), "labels")
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined_evenly(found, sums, "label", "_rows").select(
        "vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for the rows of ``codes`` over table embeddings, whose vectors have one length."""
    nearest = """
  SELECT vec_id, part, entry, error FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS error
    FROM components x JOIN {b} b USING (part, place) GROUP BY x.vec_id, x.part, b.entry)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY error, entry) = 1"""
    steps = []
    for r in range(rounds):
        steps.append(f"""
a{r} AS MATERIALIZED ({nearest.format(b=f'b{r}')}),
m{r} AS (SELECT part, a.entry, x.place, sum(x.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN components x USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN m.n IS NULL THEN b.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM b{r} b LEFT JOIN m{r} m USING (part, entry, place)),""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
flat AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {parts} AS width,
         floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
components AS MATERIALIZED (SELECT vec_id, i // width AS part, i % width AS place, x FROM flat),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT part, entry, place, x FROM start JOIN components USING (vec_id)),{''.join(steps)}
last AS MATERIALIZED ({nearest.format(b=f'b{rounds}')}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM last GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
FROM coded c JOIN kept k USING (vec_id)
"""
