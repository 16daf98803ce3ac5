"""Quality by compression: zstandard dictionaries of good and of bad labelled texts.

A text is cut into blocks; every block is compressed once with each dictionary. What a text costs a byte with the
bad dictionary minus what it costs with the good one is its normalised difference; a logistic curve, fitted on
labelled texts that are not in the dictionaries, turns it and the mean cost into a calibrated score. Blocks keep
long texts from being their own dictionary, and memory small.

The fit takes at most ``per_class`` labelled rows a class (those whose ids hash lowest); dictionaries hold at most
``dictionary_bytes`` of whole texts each. Both bounds are parameters. Everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out, small_batches

LEVEL, BLOCK = 3, 2048


@dataclass(frozen=True)
class Model:
    """The two dictionaries' contents and the weights of the logistic curve."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 8:  # too little for a dictionary
        return zstandard.ZstdCompressor(**plain)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, **plain)


class Sizes:
    """Features of texts: normalised difference, mean cost a byte, and both damped for short texts."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: str | None) -> tuple[float, ...]:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return (0.0, 0.0, 0.0, 0.0)
        good = bad = blocks = 0
        for i in range(0, len(data), BLOCK):
            part = data[i : i + BLOCK]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
            blocks += 1
        spare = 9 * blocks  # what a frame costs without content
        n = len(data)
        difference, mean = (bad - good) / n, (bad + good - 2 * spare) / (2 * n)
        weight = n / (n + 100.0)
        return (difference * weight, mean * weight, difference * mean * weight, weight)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (constant last) on standardised columns by Newton's method, given back for the raw columns."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / scale
    return np.append(raw, w[-1] - raw @ centre)


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, per_class: int = 3000,
    dictionary_bytes: int = 1_000_000,
) -> Model:
    """Learn from labelled rows that are not held out; without both classes the model gives 0.5 for every text.

    Rows without a label, id or text teach nothing. An id with labels of both kinds teaches nothing either; an id with several
    texts teaches the smallest. The driver gets the dictionaries and four numbers for each other text, however long texts are.
    A text that is longer than a fiftieth of a dictionary goes to the fit of the curve, not into a dictionary.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
        .where(~held_out(F.col("doc_id"), folds, fold))
        .select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.xxhash64("doc_id").alias("turn"))
    )
    chosen = known.where("quality = 1").orderBy("turn", "doc_id").limit(per_class).unionByName(
        known.where("quality = 0").orderBy("turn", "doc_id").limit(per_class)
    )
    scratch = Scratch(docs.sparkSession, "quality")
    # One text an id, the smallest: at most 2 * per_class rows, which stay on storage.
    rows = scratch.saved(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "turn", "quality").agg(F.min("text").alias("text"))
    )
    into_dictionary, turns, held = set(), {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in rows.select("doc_id", "quality", F.octet_length("text").alias("n")).orderBy("turn", "doc_id").collect():
        turns[r.quality] += 1
        if turns[r.quality] % 2 and r.n <= dictionary_bytes // 50 and held[r.quality] + r.n <= dictionary_bytes:
            into_dictionary.add(r.doc_id)
            held[r.quality] += r.n
    mine = F.col("doc_id").isin(sorted(into_dictionary))
    # At most dictionary_bytes of text a class reach the driver.
    texts = rows.where(mine).orderBy("turn", "doc_id").select("quality", "text").collect()
    good, bad = (b"\n".join(r.text.encode("utf-8", "surrogatepass") for r in texts if r.quality == q) for q in (1, 0))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            x = np.array([sizes(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i].copy()) for i in range(4))], names=["quality", *"abcd"])

    curve = rows.where(~mine).orderBy("turn", "doc_id").select("quality", "text").mapInArrow(
        features, "quality int, a double, b double, c double, d double").collect()  # numbers, a row an id
    scratch.remove()
    y = np.array([r.quality for r in curve], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(good, bad, (0.0, 0.0, 0.0, 0.0, 0.0))
    return Model(good, bad, tuple(_logistic(np.array([tuple(r)[1:] for r in curve]), y)))


def _scorer(df: DataFrame, model: Model):
    """Function from an Arrow column of texts to their scores, built once a task."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by dictionary_bytes

    def build():
        m = shared.value
        sizes, weights = Sizes(m.good, m.bad), np.array(m.weights)

        def score(texts: pa.Array) -> np.ndarray:
            x = np.array([(*sizes(t.as_py()), 1.0) for t in texts]).reshape(-1, len(weights))
            return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))

        return score

    return build


def scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from a half on) of every row's whole text.

    Null and empty texts get one same score; repeated rows give a row each; extra columns are ignored; a null id is
    not held out; an empty table gives no rows.
    """
    build = _scorer(docs, fit(docs, labels, folds, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = build()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """The rows whose score is at least a half, with all their columns. Defined for odd rows as ``scores`` is."""
    build, at = _scorer(docs, fit(docs, labels, folds, fold)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = build()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
