"""Bloom filters by aggregation: which rows can have their hash in a given set, decided where they are read.

A set of 64-bit hashes becomes an array of words, built by an aggregation that folds bits before it shuffles: two places
a hash, ``BITS`` to twice as many bits for each (at most ``MOST`` bits in all, 64 MB; a larger set makes the filter let more rows pass, never
the wrong ones stay behind). The words travel with the tasks of the scan, as the value of a subquery.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each member at least, and log2 of the most bits of a filter.
BITS, MOST = 32, 29
#: log2 of the words in a piece: the words are an array of such arrays, each put in order by a task of its own.
_PIECE = 12


@dataclass(frozen=True)
class Membership:
    """log2 of the number of bits, and the words as the single value of a frame (None: nothing is a member)."""

    size: int
    words: DataFrame | None

    def rows_of(self, df: DataFrame, hashed: str) -> DataFrame:
        """The rows whose hash (an SQL expression) can be a member."""
        if self.words is None:
            return df.limit(0)
        marked = df.select("*", F.expr(hashed).alias("_hash"), self.words.scalar().alias("_words"))
        return marked.filter(" AND ".join(self._set(place) for place in self._places("_hash"))).drop("_hash", "_words")

    def _places(self, hashed: str) -> list[str]:
        mask = (1 << self.size) - 1
        return [f"({hashed} & {mask}L)", f"(shiftrightunsigned({hashed}, 32) & {mask}L)"]

    def _set(self, place: str) -> str:
        piece = f"CAST(shiftright({place}, {6 + _PIECE}) AS INT)"
        word = f"CAST(shiftright({place}, 6) & {(1 << _PIECE) - 1}L AS INT)"
        return f"bit_get(get(get(_words, {piece}), {word}), CAST({place} & 63L AS INT)) = 1"


def membership(hashes: DataFrame) -> Membership:
    """A filter of the hashes in column ``h``; the frame is read twice (counted first)."""
    spark, count = hashes.sparkSession, hashes.count()
    if not count:
        return Membership(0, None)
    size = min(MOST, max(6 + _PIECE, (count * BITS - 1).bit_length()))
    one = Membership(size, hashes)
    places = hashes.selectExpr(f"explode(array({', '.join(one._places('h'))})) AS place")
    bits = places.selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63L AS INT)) AS bits")
    # Words without any bit are there too, so that a word's place in its piece is its number.
    words = bits.unionAll(spark.range(1 << (size - 6)).selectExpr("id AS word", "0L AS bits")).groupBy("word").agg(
        F.expr("bit_or(bits) AS bits"))
    ordered = lambda key, value: F.expr(f"transform(array_sort(collect_list(named_struct('at', {key}, 'value', {value}))), x -> x.value)")
    pieces = words.groupBy(F.expr(f"shiftright(word, {_PIECE}) AS piece")).agg(ordered("word", "bits").alias("words"))
    return Membership(size, pieces.agg(ordered("piece", "words").alias("words")))
