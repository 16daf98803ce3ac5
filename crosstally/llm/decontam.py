"""Benchmark decontamination by random-walk embedding, bit sampling and an exact edit check.

A document holds an item if some run of its words is within an edit distance (over words) of ``1 - similarity`` of
the item's words. Candidates come from locality-sensitive hashing: the CGK embedding walks over a window's words in three
times as many steps, gives out the word under the cursor at every step and moves on if a random bit of (step, word) says so;
behind the window's end it gives out padding. An edit disturbs the walk only until it meets the unedited walk again, so edit
distance turns into Hamming distance. A key samples places of the whole embedding, one in each of ``SAMPLES`` equal
stretches; ``WALKS`` independent walks with ``KEYS`` keys each reach the recall that the tests hold every size to. Every
candidate is then checked exactly by bit-parallel dynamic programming.

Items are put into classes by their number of words. A class has a window of two thirds to three quarters of its smallest
size, growing with the square root for long items: the embedding's Hamming distance grows with the square of a window's edits,
so at a given share of edits a longer window would lose every place. Items are cut at every word, documents at a
fifth of the window, so a copy holds windows of the document whatever its alignment.

A window inside a copy has at most as many words that aren't the class's items' as edits are allowed; others are not walked over.

Items are a query set: they are read in blocks of at most ``BLOCK_WORDS`` words, one bounded broadcast at a time, and all
documents pass every block. Between blocks, rows are written. Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, words

#: Walks over a window, keys of each, places that a key samples.
WALKS, KEYS, SAMPLES = 3, 4, 4
BLOCK_WORDS = 500_000
#: Words of documents that are walked over at once.
BATCH_WORDS = 200_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint32(0x5BD1E995)


def class_of(n: int) -> tuple[int, int, int, int]:
    """(smallest size, largest size, stride, window) of the class of items of ``n`` words."""
    low = 1
    while (up := max(low + 1, low * 8 // 5)) <= n:
        low = up
    window = max(1, min(low - max(1, low // (3 if low < 9 else 4)), int(4 * math.sqrt(low))))
    return low, up - 1, max(1, window // 5), window


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, tokens), dtype=np.uint32, count=len(tokens))


class Walk:
    """One walk's random bits and the sampled places of its keys, for a window size."""

    def __init__(self, window: int, number: int):
        random = np.random.default_rng([window, number])
        self.window, steps = window, 3 * window
        places = [(np.arange(SAMPLES) + random.random(SAMPLES)) * steps / SAMPLES for _ in range(KEYS)]
        self.places = [set(p.astype(int).tolist()) for p in places]
        self.bits = (random.integers(0, 1 << 31, steps, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """64-bit keys of the window at each start; a window has to lie inside ``symbols``, which end with one more."""
        at, end = starts.copy(), starts + self.window
        keys = [np.zeros(len(starts), dtype=np.uint64) for _ in self.places]
        for step in range(max(map(max, self.places)) + 1):
            seen = symbols.take(at)
            if step >= self.window:
                seen[at == end] = _PAD
            for i, places in enumerate(self.places):
                if step in places:
                    key = (keys[i] + seen + np.uint64(1)) * _MULTIPLIER
                    keys[i] = key ^ (key >> np.uint64(29))
            at += (seen * self.bits[step]) >> np.uint32(31)
            if step >= self.window:
                np.minimum(at, end, out=at)
        return keys


def within(masks: dict[bytes, int], n: int, text: list[bytes], most: int) -> bool:
    """Whether some run of ``text`` is at most ``most`` word edits from the pattern of ``n`` words.

    ``masks`` has for each word the bits of its places in the pattern. Bit-parallel columns of the edit matrix.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    if score <= most:
        return True
    for word in text:
        same = masks.get(word, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        score += bool(plus & top) - bool(minus & top)
        if score <= most:
            return True
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return False


class Flags:
    """Which upper bits occur among numbers: about 32 flags for each, so most others are told apart at a glance."""

    def __init__(self, numbers: np.ndarray, width: int):
        self.shift = numbers.dtype.type(width - min(22, max(12, len(numbers).bit_length() + 5)))
        self.flags = np.zeros(1 << (width - int(self.shift)), dtype=bool)
        self.flags[(numbers >> self.shift).astype(np.int64)] = True

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.flags.take((numbers >> self.shift).astype(np.int64))


class Index:
    """Keys of a block of items: (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float):
        self.items, symbols = [], []  # (item, words, masks of its words, most edits)
        classes: dict[tuple[int, int, int, int], list[int]] = defaultdict(list)
        for item, tokens in items:
            if tokens:
                masks: dict[bytes, int] = defaultdict(int)
                for i, token in enumerate(tokens):
                    masks[token] |= 1 << i
                classes[class_of(len(tokens))].append(len(self.items))
                self.items.append((item, len(tokens), dict(masks), edits(len(tokens), similarity)))
                symbols.append(hashed(tokens))
        self.classes = []  # (stride, window, words of the class, fewest of them in a window, tables)
        for (_, high, stride, window), members in classes.items():
            whole = np.concatenate([*(symbols[i] for i in members), np.zeros(1, np.uint32)])
            first = np.cumsum([0, *(len(symbols[i]) for i in members)])
            starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(first, first[1:])])
            owner = np.searchsorted(first, starts, side="right") - 1
            known = Flags(whole[:-1], 32)
            tables = []  # (walk, for each of its keys: flags, sorted keys, items and offsets of each)
            for number in range(WALKS):
                walk, sides = Walk(window, number), []
                for keys in walk.keys(whole, starts):
                    order = np.argsort(keys, kind="stable")
                    sides.append((Flags(keys, 64), keys[order], np.array(members)[owner[order]], (starts - first[owner])[order]))
                tables.append((walk, sides))
            self.classes.append((stride, window, known, window - edits(high, similarity), tables))

    def candidates(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item's place, word where the item would begin) that share a key; ``first`` are the documents' first words."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for stride, window, known, fewest, tables in self.classes:
            starts = np.concatenate([np.arange(a, b - window + 1, stride, dtype=np.int64) for a, b in zip(first, first[1:])] or [first[:0]])
            if fewest > 0:
                held = np.concatenate([[0], np.cumsum(known.of(symbols))])
                starts = starts[held.take(starts + window) - held.take(starts) >= fewest]
            if not len(starts):
                continue
            for walk, sides in tables:
                for seen, (flags, keys, owners, offsets) in zip(walk.keys(symbols, starts), sides):
                    near = np.flatnonzero(flags.of(seen))
                    low, high = np.searchsorted(keys, seen[near], "left"), np.searchsorted(keys, seen[near], "right")
                    count = high - low
                    at = np.repeat(starts[near], count)
                    hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    doc = np.searchsorted(first, at, side="right") - 1
                    found.append(np.column_stack([doc, owners[hit], at - first[doc] - offsets[hit]]))
        return np.unique(np.concatenate(found), axis=0)

    def found(self, docs: list[list[bytes]]) -> list[set[int]]:
        """The item ids each document holds."""
        out: list[set[int]] = [set() for _ in docs]
        first = np.cumsum([0, *map(len, docs)])
        symbols = hashed([w for d in docs for w in d])
        last, have, possible = None, set(), False
        for doc, owner, begin in self.candidates(np.append(symbols, np.uint32(0)), first).tolist():
            item, n, masks, most = self.items[owner]
            if item in out[doc]:
                continue
            if last is None or last[0] != doc:
                have = set(docs[doc])
            if last != (doc, owner):
                # An edit loses at most one of the item's different words.
                last, possible = (doc, owner), len(masks.keys() & have) >= len(masks) - most
            if possible:
                run = docs[doc][max(0, begin - most) : max(0, begin + n + most)]
                if len(masks.keys() & set(run)) >= len(masks) - most and within(masks, n, run, most):
                    out[doc].add(item)
        return out


def edits(n: int, similarity: float) -> int:
    """The most edits of an item of ``n`` words."""
    return math.floor((1 - similarity) * n + 1e-9)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items (item_id, text), read block by block of about ``BLOCK_WORDS`` words at most.

    Items without id or words match nothing; rows that repeat an id are several texts of one item.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, math.ceil(2 * size / BLOCK_WORDS))
    for i in range(count):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i).collect()]


def _passes(docs: DataFrame, benchmark: DataFrame, similarity: float, at: int, schema, made) -> DataFrame:
    """One pass a block; ``made`` makes a batch of rows and what each row's text holds into the batch that goes on.

    Rows are written between passes, so a task holds one block's index at a time.
    """
    spark, written = docs.sparkSession, []
    small_batches(spark)
    for n, block in enumerate(blocks(benchmark)):
        if n:
            written.append(Scratch(spark, "decontamination"))
            docs = written[-1].saved(docs)
            for old in written[:-1]:
                old.remove()
            del written[:-1]
        shared = spark.sparkContext.broadcast([(item, words(text)) for item, text in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, similarity)
            for batch in batches:
                hits, group, held = [], [], 0
                for text in batch.column(at):
                    group.append(words(text.as_py()))
                    held += len(group[-1])
                    if held >= BATCH_WORDS:
                        hits += index.found(group)
                        group, held = [], 0
                yield made(batch, hits + index.found(group))

        docs = docs.mapInArrow(run, schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_ids (sorted array of the items the whole text holds), n_items of every row.

    Words are runs of non-blank characters, A-Z in lower case. Null and empty texts hold nothing; repeated rows give a
    row each; a null id keeps its row; extra columns are ignored; an empty benchmark is held by no document.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("item_ids", T.ArrayType(T.LongType()))])

    def made(batch, hits):
        ids = [sorted(found.union(old or ())) for found, old in zip(hits, batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))],
                                          names=schema.names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.array().cast("array<long>").alias("item_ids"))
    return _passes(rows, benchmark, similarity, 1, schema, made).select(
        "doc_id", "item_ids", F.size("item_ids").cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows whose text holds no item, with all their columns. Defined for odd rows as ``contaminated`` is."""
    return _passes(docs, benchmark, similarity, docs.columns.index("text"), docs.schema,
                   lambda batch, hits: batch.filter(pa.array([not found for found in hits], pa.bool_())))
