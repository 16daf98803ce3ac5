"""Hidden Markov language model over words, trained by Baum-Welch across partitions.

Symbols of the model: the ``OWN`` most frequent training words each stand for themselves, all other words share
``CLASSES`` classes by their last bytes, and a text ends with an end symbol. A word of a class is then chosen by its corpus
count within the class, so the model gives every text a probability over all words, seen or not (unseen words are one
unknown word a class, as in the base score).

What is broadcast is bounded: at most ``LISTED`` words (those with at least 1 / LISTED of all tokens; there can't be more),
and the model's matrices. Counts of all other words meet their documents in a shuffle join. Every E step runs over all
training tokens; its counts are summed by symbol. Long texts are worked on in pieces side by side, each with ``LEAD`` tokens
before and behind it whose counts are left to the pieces they belong to: there the recursions forget where they were cut, so every
move between tokens counts once, and starts are those of texts. The score of a text is the exact likelihood of its whole
symbol sequence by the scaled forward recursion.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved, small_batches, words

STATES, ITERATIONS = 8, 5
#: Tokens of a piece of a text, and of the lead on either side of it.
PIECE, LEAD = 160, 16
OWN, CLASSES, LISTED = 8192, 1024, 400_000
END = b"\n"  # no word holds a newline
_FLUSH = 200_000  # words a counting task keeps before it gives them out
_TOKENS = 400_000  # tokens an E step works on at once
_LONG = 1_500_000  # tokens of the texts that are scored side by side


def class_of(word: bytes) -> int:
    return crc32(word[-4:]) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """word, class, c of all words and the end of the rows' texts."""
    small_batches(docs.sparkSession)

    def out(seen: Counter) -> pa.RecordBatch:
        names = list(seen)
        return pa.RecordBatch.from_arrays(
            [pa.array([n.decode("utf-8", "replace") for n in names], pa.string()),
             pa.array([-1 if n == END else class_of(n) for n in names], pa.int32()),
             pa.array(seen.values(), pa.int64())], names=["word", "class", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                seen[END] += 1
                if len(seen) >= _FLUSH:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, class int, c long").groupBy(
        "word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Totals, listed words with their counts, and denominators of the classes."""

    tokens: int
    distinct: int
    words: list[bytes]  # most frequent first
    counts: np.ndarray
    classes: np.ndarray  # log10 of each class's denominator
    symbols: np.ndarray  # training count of each symbol

    @property
    def own(self) -> int:
        return min(OWN, len(self.words))


def lexicon(counts: DataFrame) -> Lexicon:
    """From word counts (word, class, c)."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    listed = counts.where((F.col("c") * LISTED >= n) | (F.col("class") == -1)).collect()  # at most LISTED rows and the end
    ends = next((r.c for r in listed if r["class"] == -1), 0)
    listed = sorted((r for r in listed if r["class"] != -1), key=lambda r: (-r.c, r.word))
    sizes, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where("class >= 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sizes[r["class"]], kinds[r["class"]] = r.n, r.v
    for r in listed[:OWN]:
        sizes[r["class"]] -= r.c
        kinds[r["class"]] -= 1
    own = listed[:OWN]
    symbols = np.concatenate([[r.c for r in own], sizes, [ends]]).astype(float)
    return Lexicon(n, v, [r.word.encode() for r in listed], np.array([r.c for r in listed], dtype=np.int64),
                   np.log10(sizes + kinds + 1), symbols)


_CODED = ("row long, doc_id long, held_out boolean, n_tokens long, listed_known long, listed_log double, in_class double, "
          "symbols binary, rare array<struct<word:string,n:int>>")


def coded(docs: DataFrame, lex: Lexicon, folds: int, fold: int) -> DataFrame:
    """A row a text: its symbols, the sums its listed words give, and its other words with their numbers."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lex)  # bounded by LISTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Lexicon = shared.value
        own, place = known.own, {w: i for i, w in enumerate(known.words)}
        of_class = np.array([class_of(w) for w in known.words], dtype=np.int32) + own
        symbol = np.where(np.arange(len(known.words)) < own, np.arange(len(known.words)), of_class).astype(np.uint16)
        logs = np.log10(known.counts + 1.0)
        ends = known.symbols[-1]
        end = np.array([own + CLASSES], dtype=np.uint16)
        for batch in batches:
            made = [[] for _ in range(6)]
            for text in batch.column(3):
                tokens = words(text.as_py())
                at = np.fromiter((place.get(w, -1) for w in tokens), dtype=np.int64, count=len(tokens))
                seen = at >= 0
                codes = np.zeros(len(tokens), dtype=np.uint16)
                codes[seen] = symbol[at[seen]]
                other = [tokens[i] for i in np.flatnonzero(~seen)]
                codes[~seen] = np.fromiter((own + class_of(w) for w in other), dtype=np.uint16, count=len(other))
                shares = codes >= own
                in_class = logs[at[seen & shares]].sum() - known.classes[codes[shares].astype(np.int64) - own].sum()
                made[0].append(len(tokens) + 1)
                made[1].append(int(seen.sum()) + (ends > 0))
                made[2].append(float(logs[at[seen]].sum() + math.log10(ends + 1)))
                made[3].append(float(in_class))
                made[4].append(np.concatenate([codes, end]).tobytes())
                made[5].append([{"word": w.decode("utf-8", "replace"), "n": n} for w, n in Counter(other).items()])
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(),
                     pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(m, k) for m, k in zip(made, kinds))],
                names=[c.split()[0] for c in _CODED.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(run, _CODED), "coded")


@dataclass
class Model:
    start: np.ndarray  # STATES
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # symbols x STATES


def first_model(symbols: np.ndarray) -> Model:
    """Every state near the corpus's symbol frequencies, told apart by fixed noise; states tend to stay."""
    noise = np.exp(np.random.default_rng(11).normal(0, 1.0, (len(symbols), STATES)))
    emit = (symbols[:, None] + 1) * noise
    stay = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
    np.fill_diagonal(stay, 0.9)
    return Model(np.full(STATES, 1 / STATES), stay, emit / emit.sum(0))


def _by_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first, their symbols step by step: (order, symbols, where each step begins).

    A step has one symbol of each sequence that is long enough, so what a step works on lies side by side.
    """
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    steps = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # sequences longer than the step
    whole = np.concatenate(sequences)
    symbols = np.empty_like(whole)
    at = np.concatenate([[0], np.cumsum(steps)])
    for t, n in enumerate(steps):
        np.take(whole, starts[:n] + t, out=symbols[at[t] : at[t + 1]])
    return order, symbols, at


def pieces_of(text: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of a sequence of symbols with their leads: twice the symbol, plus one where the token counts."""
    for i in range(0, len(text), PIECE):
        low, high = max(0, i - LEAD), min(len(text), i + PIECE + LEAD)
        piece = text[low:high] * 2
        piece[i - low : i - low + PIECE] += 1
        yield piece


def expected(model: Model, pieces: list[np.ndarray]):
    """Expected starts, moves and emissions of the tokens that count in pieces (``pieces_of``), and their log-likelihood (one
    E step). A piece whose first token counts begins a text; others begin as states are spread in the long run."""
    _, marked, at = _by_step(pieces)
    symbols, counts = marked >> 1, (marked & 1).astype(np.float32)
    emit, move = np.ascontiguousarray(model.emit.T, dtype=np.float32), model.move.astype(np.float32)
    forth, usual = np.ascontiguousarray(move.T), np.linalg.matrix_power(model.move, 64)[0]
    begins = counts[: at[1]]
    start = (model.start[:, None] * begins + usual[:, None] * (1 - begins)).astype(np.float32)
    given = np.empty((STATES, len(symbols)), dtype=np.float32)
    for k in range(STATES):
        np.take(emit[k], symbols, out=given[k])
    state = np.empty_like(given)
    scale = np.empty(len(symbols), dtype=np.float32)
    last = len(at) - 2
    for t in range(last + 1):
        a, b = at[t], at[t + 1]
        now = given[:, a:b] * (forth @ state[:, at[t - 1] : at[t - 1] + b - a] if t else start)
        total = now.sum(0)
        scale[a:b] = total
        np.divide(now, total, out=state[:, a:b])
    moves = np.zeros((STATES, STATES))
    given /= scale
    # Backwards, ``state`` becomes the states' probabilities; sequences that end with a step are sure of it already.
    back = np.ones((STATES, at[1]), dtype=np.float32)
    for t in range(last - 1, -1, -1):
        a, b = at[t + 1], at[t + 2]
        n = b - a
        ahead = given[:, a:b] * back[:, :n]
        before = state[:, at[t] : at[t] + n]
        moves += before @ (ahead * counts[a:b]).T  # a move counts with the token it leads to
        back[:, :n] = move @ ahead
        before *= back[:, :n]
    moves *= model.move
    emissions = np.column_stack([np.bincount(symbols, row * counts, len(model.emit)) for row in state])
    starts = (state[:, : at[1]] * begins).sum(1, dtype=float)
    return starts, moves, emissions, float((np.log(scale, dtype=np.float64) * counts).sum())


def likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole sequence."""
    order, symbols, at = _by_step(texts)
    out, now = np.zeros(len(texts)), None
    emit, forth = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    for t in range(len(at) - 1):
        given = emit[:, symbols[at[t] : at[t + 1]]]
        n = given.shape[1]
        now = (forth @ now[:, :n] if t else model.start[:, None]) * given
        total = now.sum(0)
        out[:n] += np.log(total)
        now /= total
    back = np.empty(len(texts))
    back[order] = out
    return back


def _groups(batches, column, most):
    """Symbol arrays of rows in groups of about ``most`` tokens."""
    group, held = [], 0
    for batch in batches:
        for value in batch.column(column):
            group.append(np.frombuffer(value.as_py(), dtype=np.uint16).astype(np.int64))
            held += len(group[-1])
            if held >= most:
                yield group
                group, held = [], 0
    if group:
        yield group


def trained(texts: DataFrame, symbols: np.ndarray, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over the ``symbols`` column of all rows; without rows the first model."""
    spark, model = texts.sparkSession, first_model(symbols)
    share = (symbols + 1) / (symbols + 1).sum()
    names = [f"c{k}" for k in range(STATES)]
    schema = "symbol int, " + ", ".join(f"{c} double" for c in names)
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            starts, moves, emissions = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros(known.emit.shape)
            for group in _groups(batches, 0, _TOKENS):
                a, b, c, _ = expected(known, [piece for text in group for piece in pieces_of(text)])
                starts, moves, emissions = starts + a, moves + b, emissions + c
            used = np.flatnonzero(emissions.any(1))
            rows = np.concatenate([starts[None], moves, emissions[used]])
            keys = np.concatenate([[-1], -2 - np.arange(STATES), used]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(STATES))],
                                             names=["symbol", *names])

        sums = texts.select("symbols").mapInArrow(run, schema).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in names))
        starts, moves, emissions = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(symbols), STATES))
        for r in sums.collect():  # a row a symbol
            if r.symbol >= 0:
                emissions[r.symbol] = r[1:]
            elif r.symbol == -1:
                starts[:] = r[1:]
            else:
                moves[-2 - r.symbol] = r[1:]
        if not starts.sum():
            break
        start, move = starts + 0.1, moves + 0.1
        emit = emissions + 2000.0 * share[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def scores(docs: DataFrame, folds: int = 7, fold: int = 2, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row's whole text.

    Learns from the rows that are not held out. base_score is the add-one unigram score, score the model's log10
    probability. Null and empty texts hold the end only; repeated rows give a row each and are learnt from as
    often; a null id is not held out; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    training = docs.where(~held_out(F.col("doc_id"), folds, fold))
    counts = saved(word_counts(training), "counts")
    lex = lexicon(counts)
    texts = coded(docs, lex, folds, fold)
    model = spark.sparkContext.broadcast(trained(texts.where("NOT held_out"), lex.symbols, iterations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []

        def kept():
            for batch in batches:
                rows.extend(batch.column(0).to_pylist())
                yield batch

        for group in _groups(kept(), 1, _LONG):
            found = likelihood(model.value, group) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(rows[: len(group)], pa.int64()), pa.array(found)], names=["row", "path"])
            del rows[: len(group)]

    paths = texts.select("row", "symbols").mapInArrow(run, "row long, path double")
    listed_from = lex.tokens / LISTED
    rare = (
        texts.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n")
        .join(counts.where((F.col("class") >= 0) & (F.col("c") < listed_from)).select("word", "c"), "word", "left")
        .groupBy("row").agg(F.sum(F.when(F.col("c").isNull(), 0).otherwise(F.col("n"))).alias("known"),
                            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log"))
    )
    floor = math.log10(lex.tokens + lex.distinct + 1)
    log = F.coalesce("log", F.lit(0.0))
    return (
        texts.drop("symbols", "rare").join(paths, "row").join(rare, "row", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("listed_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                F.lit(lex.tokens).cast("long").alias("train_tokens"),
                (F.col("listed_log") + log - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
                (F.col("path") + F.col("in_class") + log).alias("score"))
    )
