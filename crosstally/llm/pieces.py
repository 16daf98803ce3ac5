"""SentencePiece BPE by a prefix table, one word at a time.

In byte-pair encoding every prefix of a text has one encoding, and the encodings of all prefixes are known once each
prefix's *last* token is. A token that ends at a prefix's end is its last token exactly if it may follow the last token
of the prefix before it: if merging the two tokens' characters on their own gives these two tokens back. An Aho-Corasick
automaton gives the tokens that end at each character, the pair test picks the one that fits, and the ids are read
from the end of the table backwards.

The vocabularies meant here have no token with a blank mark after another character, so no merge crosses the start of
a word, and a text is encoded word by word. Encoded words are remembered up to a bound. Characters outside the
vocabulary are given by their bytes, and nothing merges across them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"  # stands for a blank
#: A word is marks and what follows them up to the next mark or newline; a newline stands alone.
_WORD = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Between a letter and punctuation, where a vocabulary has no token that spans the two.
_CUT = re.compile(r"(?<=[A-Za-zÀ-ɏ])(?=[.,;:!?])")
#: So many words up to this long are remembered by a worker.
WORD_CHARS, WORDS = 48, 800_000
PAIRS = 500_000


class Pieces:
    """The vocabulary of one model file, its automaton, and memories of words and token pairs."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        library, size = self.library, self.library.get_piece_size()
        self.bytes_at = library.piece_to_id("<0x00>")
        self.ids, self.rank = {}, {}
        for i in range(size):
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)):
                piece = library.id_to_piece(i)
                self.ids[piece], self.rank[piece] = i, -library.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("The vocabulary has tokens that go on after a word's start")
        if any("\n" in p for p in self.ids):
            raise ValueError("The vocabulary has tokens with newlines")
        self.chars = {c for p in self.ids for c in p if c in self.ids}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self._merged(piece) == [piece]:  # others can't come out of merging
                self.automaton.add_word(piece, (piece, len(piece), self.ids[piece]))
        self.automaton.make_automaton()
        self.fits = lru_cache(PAIRS)(lambda a, b: self._merged(a + b) == [a, b])
        self.words: dict[str, tuple[int, ...]] = {}
        self.cuts = not any(_CUT.search(p) for p in self.ids)

    def _merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until no pair is a token. For short texts."""
        parts, rank, never = list(text), self.rank.get, float("inf")
        order = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while order and (best := min(order)) < never:
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(order):
                order[at] = rank(parts[at] + parts[at + 1], never)
        return parts

    def _span(self, text: str) -> list[int]:
        """Ids of characters that are all in the vocabulary."""
        last: list = [None] * (len(text) + 1)  # of each prefix: its last token, with length and id
        fits = self.fits
        for end, entry in self.automaton.iter(text):  # the tokens that end at each character
            if last[end + 1] is None:
                start = end + 1 - entry[1]
                if not start or ((before := last[start]) is not None and fits(before[0], entry[0])):
                    last[end + 1] = entry
        out, end = [], len(text)
        while end:
            _, length, token = last[end]
            out.append(token)
            end -= length
        out.reverse()
        return out

    def _word(self, word: str) -> list[int]:
        if self.chars.issuperset(word):
            return self._span(word)
        out, start = [], 0
        for i, c in enumerate(word):
            if c not in self.chars:
                out += self._span(word[start:i]) if i > start else []
                out += [self.bytes_at + b for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        return out + (self._span(word[start:]) if start < len(word) else [])

    def _new(self, word: str) -> tuple[int, ...]:
        """Ids of a word that isn't remembered; its letters and the punctuation after them are looked up apart."""
        parts = _CUT.split(word) if self.cuts else [word]
        if len(parts) > 1:
            ids: tuple[int, ...] = ()
            for part in parts:
                ids += self.words.get(part) or self._new(part)
        else:
            ids = tuple(self._word(word))
        if len(word) <= WORD_CHARS and len(self.words) < WORDS:  # frequent words come early
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; an empty text has none."""
        if not text:
            return []
        known, new, out = self.words.get, self._new, []
        for word in _WORD.findall(MARK + text.replace(" ", MARK)):
            out += known(word) or new(word)
        return out


@lru_cache(2)
def load(path: str) -> Pieces:
    """One vocabulary a worker process."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row's whole text; null and empty texts have no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            ids = [pieces.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids), by the library's ``decode``."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load(path).library
        for batch in batches:
            texts = [library.decode(ids.as_py() or []) or "" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text, encoded and decoded in one pass.

    Null texts count as empty ones; repeated rows give a row each; a null id keeps its row; extra columns are
    ignored; an empty table gives no rows. ``path`` is the model file's place on every executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        decimal = [str(i) for i in range(pieces.library.get_piece_size())].__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = pieces.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                back = pieces.library.decode(ids) if ids else ""
                of_text.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
