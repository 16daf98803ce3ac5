import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from crosstally.llm import hmm
from crosstally.llm.common import words


@pytest.fixture(scope="module")
def scored(docs):
    return hmm.scores(docs).collect()


def test_base_score_and_counts(scored, docs):
    rows = {r.doc_id: words(r.text) + [hmm.END] for r in docs.collect()}
    held = {d: crc32(str(d).encode()) % 7 == 2 for d in rows}
    c = Counter(w for d, ws in rows.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(scored) == len(rows)
    for r in scored:
        ws = rows[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(c[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


def test_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)  # both negative
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_few_listed_words_give_the_same_base(docs, scored, monkeypatch):
    monkeypatch.setattr(hmm, "LISTED", 50)
    few = {r.doc_id: r for r in hmm.scores(docs, iterations=1).collect()}
    for r in scored:
        assert few[r.doc_id].base_score == pytest.approx(r.base_score, rel=1e-9) and few[r.doc_id].n_known == r.n_known


def small_model():
    rng = np.random.default_rng(0)
    emit = rng.random((5, hmm.STATES))
    move = rng.random((hmm.STATES, hmm.STATES))
    start = rng.random(hmm.STATES)
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def paths(model, seq):
    for states in itertools.product(range(hmm.STATES), repeat=len(seq)):
        p = model.start[states[0]] * model.emit[seq[0], states[0]]
        for a, b, s in zip(states, states[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield states, p


def test_likelihood_and_expected_counts_equal_all_paths():
    model = small_model()
    seqs = [np.array(s) for s in ([0, 3, 1, 4], [2], [1, 1, 0], [4, 2])]
    starts, moves, emissions = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((5, hmm.STATES))
    logs = []
    for seq in seqs:
        every = list(paths(model, seq))
        total = sum(p for _, p in every)
        logs.append(math.log(total))
        for states, p in every:
            p /= total
            starts[states[0]] += p
            for a, b in zip(states, states[1:]):
                moves[a, b] += p
            for s, k in zip(seq, states):
                emissions[s, k] += p
    a, b, c, log = hmm.expected(model, [p for seq in seqs for p in hmm.pieces_of(seq)])
    assert np.allclose(a, starts, atol=1e-4) and np.allclose(b, moves, atol=1e-4) and np.allclose(c, emissions, atol=1e-4)
    assert log == pytest.approx(sum(logs), rel=1e-5)
    assert np.allclose(hmm.likelihood(model, seqs), logs, rtol=1e-12)


def test_pieces_count_what_whole_texts_do(monkeypatch):
    """Every token and move counts once, and the leads make up for the cuts."""
    rng = np.random.default_rng(3)
    stay = np.full((hmm.STATES, hmm.STATES), 0.1 / (hmm.STATES - 1))
    np.fill_diagonal(stay, 0.9)
    emit = rng.random((40, hmm.STATES)) ** 4
    model = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), stay, emit / emit.sum(0))
    seqs = [rng.integers(0, 40, n) for n in (1, 159, 160, 161, 5000, 333)]
    cut = hmm.expected(model, [p for s in seqs for p in hmm.pieces_of(s)])
    assert cut[0].sum() == pytest.approx(6, rel=1e-4)
    assert cut[1].sum() == pytest.approx(sum(map(len, seqs)) - 6, rel=1e-4) and cut[2].sum() == pytest.approx(sum(map(len, seqs)), rel=1e-4)
    monkeypatch.setattr(hmm, "PIECE", 10**6)
    whole = hmm.expected(model, [p for s in seqs for p in hmm.pieces_of(s)])
    for a, b in zip(cut[:3], whole[:3]):
        assert np.abs(a - b).max() <= 0.002 * np.abs(b).max()
    assert cut[3] == pytest.approx(whole[3], rel=1e-3)


def test_score_is_a_plain_forward_pass_over_words(docs, monkeypatch):
    """Word by word: the state's next symbol, times the word's share of its class."""
    kept = {}
    real = hmm.trained
    monkeypatch.setattr(hmm, "trained", lambda texts, symbols, n: kept.setdefault("model", real(texts, symbols, n)))
    scored = {r.doc_id: r.score for r in hmm.scores(docs, iterations=2).collect()}
    model = kept["model"]
    train = [words(r.text) for r in docs.collect() if crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    own = {w: i for i, w in enumerate(sorted(c, key=lambda w: (-c[w], w.decode()))[: hmm.OWN])}
    size = Counter()
    for w, n in c.items():
        if w not in own:
            size[hmm.class_of(w)] += n + 1
    for r in docs.collect()[:60]:
        state, total = model.start, 0.0
        for i, w in enumerate([*words(r.text), hmm.END]):
            if i:
                state = state @ model.move
            if w == hmm.END:
                symbol, share = len(own) + hmm.CLASSES, 1.0
            elif w in own:
                symbol, share = own[w], 1.0
            else:
                symbol, share = len(own) + hmm.class_of(w), (c[w] + 1) / (size[hmm.class_of(w)] + 1)
            state = state * model.emit[symbol]
            total += math.log10(state.sum()) + math.log10(share)
            state = state / state.sum()
        assert scored[r.doc_id] == pytest.approx(total, rel=1e-9)


def test_held_out_likelihood_by_round(docs):
    """Each round gives held-out texts a higher likelihood."""
    fold = lambda d: crc32(str(d).encode()) % 7 == 2
    by = [sum(r.score for r in hmm.scores(docs, iterations=n).collect() if fold(r.doc_id)) for n in (0, 1, 3, 5)]
    assert by[0] < by[1] < by[2] and by[3] > by[1]


def test_training_raises_the_likelihood(docs):
    counts = hmm.word_counts(docs)
    lex = hmm.lexicon(counts)
    texts = hmm.coded(docs, lex, 7, 2)
    seqs = [np.frombuffer(r.symbols, dtype=np.uint16).astype(int) for r in texts.select("symbols").collect()]
    by = [hmm.likelihood(hmm.trained(texts, lex.symbols, n), seqs).sum() for n in (0, 1, 4)]
    assert by[0] < by[1] < by[2]


def test_model_is_a_distribution_over_words(docs):
    counts = hmm.word_counts(docs)
    lex = hmm.lexicon(counts)
    model = hmm.trained(hmm.coded(docs, lex, 7, 2), lex.symbols, 1)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
    sizes = Counter()
    own = set(lex.words[: lex.own])
    for r in counts.collect():
        if r["class"] >= 0 and r.word.encode() not in own:
            sizes[r["class"]] += r.c + 1
    for c, n in sizes.items():  # all words of a class and one unknown word share its probability
        assert 10 ** lex.classes[c] == pytest.approx(n + 1)


def test_odd_rows(odd_docs, no_docs):
    rows = hmm.scores(odd_docs).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    empty = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert {r.n_tokens for r in empty} == {1} and len({r.score for r in empty}) == 1
    assert hmm.scores(no_docs).collect() == []
    only_held = odd_docs.where("doc_id = 1").selectExpr("CAST(16 AS LONG) AS doc_id", "text")
    held = [d for d in range(100) if crc32(str(d).encode()) % 7 == 2][0]
    r = hmm.scores(only_held.selectExpr(f"CAST({held} AS LONG) AS doc_id", "text")).first()
    assert r.held_out and r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score)
