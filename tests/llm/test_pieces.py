import hashlib
import random

import public_tokenizers
import pytest

from crosstally.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    return pieces.Pieces(PATH)


def test_equals_the_library(known):
    rng = random.Random(3)
    parts = ["a", "b", "t", "h", "e", " ", "  ", "\n", "\t", "é", "梦", "💥", "▁", "<s>", "<unk>", "</s>", "\x00", "▁the", "ing", "́",
             "1", "2", "the", " the", "qu", "ü", "<0x0A>", "​", "ﬁ", "中", "\r\n", "." * 9, "   ", "aaaaaaaa"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert known.encode(text) == known.library.encode(text), repr(text)


def test_long_word_without_blanks(known):
    rng = random.Random(5)
    text = "".join(rng.choice("theandoring,.é梦💥") for _ in range(50_000))
    assert known.encode(text) == known.library.encode(text)


def test_full_memory_gives_the_same(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 3)
    small = pieces.Pieces(PATH)
    text = "the quick brown fox jumps over the lazy dog " * 3
    assert small.encode(text) == small.library.encode(text) and len(small.words) == 3


def test_digests_of_all_documents(known, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in pieces.digests(docs, PATH).collect()}
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs, PATH), PATH).collect()}
    assert set(got) == set(rows) == set(back)
    for d, text in rows.items():
        ids = known.library.encode(text or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert back[d] == known.library.decode(ids)
        assert got[d].decoded_sha256 == hashlib.sha256(back[d].encode()).hexdigest()


def test_odd_rows(known, odd_docs, no_docs):
    got = [(r.doc_id, r.n_tokens) for r in pieces.digests(odd_docs, PATH).collect()]
    want = [(r.doc_id, len(known.library.encode(r.text or ""))) for r in odd_docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.digests(no_docs, PATH).collect() == []
