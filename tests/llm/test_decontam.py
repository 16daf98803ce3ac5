import random

import numpy as np
import pytest

from crosstally.llm import decontam
from crosstally.llm.common import words

from .conftest import FOLDER


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")


def distance(pattern, text):
    """Least edits between the pattern and any run of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_check_equals_plain_table():
    rng = random.Random(0)
    for _ in range(300):
        pattern = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))]
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 20))]
        masks = {}
        for i, p in enumerate(pattern):
            masks[p] = masks.get(p, 0) | 1 << i
        least = distance(pattern, text)
        for most in range(len(pattern) + 1):
            assert decontam.within(masks, len(pattern), text, most) == (least <= most)


def test_finds_what_brute_force_finds(docs, benchmark):
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    got = {r.doc_id: set(r.item_ids) for r in decontam.contaminated(docs, benchmark).collect()}
    want = {}
    for r in docs.collect():
        text = words(r.text)
        here = set(text)
        # An edit loses at most one of the item's different words.
        likely = [(i, w) for i, w in items if len(here & set(w)) >= len(set(w)) - len(w) // 5]
        want[r.doc_id] = {i for i, w in likely if distance(w, text) <= len(w) // 5}
    assert got == want and any(want.values())


def test_recall_of_edited_items(spark, docs, benchmark):
    rng = random.Random(3)
    some = [r.text.split() for r in docs.limit(40).collect()]
    rows, want = [], []
    for n, r in enumerate(benchmark.collect() * 3):
        copy = r.text.split()
        for _ in range(len(copy) * 15 // 100):
            at, what = rng.randrange(len(copy)), rng.random()
            if what < 0.4:
                copy[at] = "other"
            elif what < 0.7:
                del copy[at]
            else:
                copy.insert(at, "more")
        host = rng.choice(some)
        at = rng.randrange(len(host) + 1)
        rows.append((n, " ".join(host[:at] + copy + host[at:])))
        want.append(r.item_id)
    found = {r.doc_id: r.item_ids for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert sum(item in found[n] for n, item in enumerate(want)) >= 0.93 * len(want)


@pytest.mark.parametrize("n", [5, 8, 9, 13, 14, 21, 33, 56, 89, 142, 227, 500])
@pytest.mark.parametrize("kinds", [("replace",), ("replace", "delete", "insert")])
def test_recall_at_the_bound_for_each_size(n, kinds):
    rng = random.Random(n)
    word = lambda c: b"%c%d" % (c, rng.randrange(3000))
    items, texts = [(i, [word(119) for _ in range(n)]) for i in range(100)], []
    for _, tokens in items:
        copy = list(tokens)
        for _ in range(n // 5):
            at, kind = rng.randrange(len(copy)), rng.choice(kinds)
            copy[at : at + (kind != "insert")] = [] if kind == "delete" else [word(120)]
        around = [word(121) for _ in range(rng.randrange(40, 80))]
        texts.append(around + copy + around)
    found = decontam.Index(items, 0.8).found(texts)
    assert sum(i in held for i, held in enumerate(found)) >= 97


def test_walks_read_whole_windows_and_no_bucket_is_large(spark):
    """Windows are scaled to their items, walks get to their ends, and keys tell items apart."""
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    for n in (5, 9, 20, 40, 100, 400):
        low, high, stride, window = decontam.class_of(n)
        assert low <= n <= high and stride <= max(1, window // 4) and window >= min(0.55 * low, 4 * low**0.5 - 1)
    symbols = np.random.default_rng(0).integers(0, 1 << 32, 5000, dtype=np.uint32)
    for window in (8, 20, 40):
        walk = decontam.Walk(window, 0)
        starts = np.arange(0, 4000, 7)
        at, end = starts.copy(), starts + window
        for step in range(3 * window):
            seen = symbols[at]
            seen[at == end] = decontam._PAD
            at = np.minimum(at + ((seen * walk.bits[step]) >> np.uint32(31)), end)
        assert (at - starts).mean() > 0.95 * window and (at == end).mean() > 0.9
        assert all(max(p) >= 2 * window and min(p) < window for p in walk.places)
    index = decontam.Index(items, 0.8)
    for _, _, _, _, tables in index.classes:
        for _, sides in tables:
            for _, keys, owners, _ in sides:
                most = max(len(set(owners[keys == key].tolist())) for key in np.unique(keys))
                assert most <= 4


def test_windows_that_are_not_walked_over_hold_no_copy():
    """Even where all other words are unknown, copies at the bound keep enough of the item's words in every window."""
    rng = random.Random(5)
    for n in (14, 21, 34, 55, 88):
        _, high, _, window = decontam.class_of(n)
        tokens = [b"w%d" % i for i in range(n)]
        for _ in range(200):
            copy = list(tokens)
            for at in rng.sample(range(n), n // 5):
                copy[at] = b"x"
            least = min(sum(w != b"x" for w in copy[i : i + window]) for i in range(n - window + 1))
            assert least >= window - decontam.edits(high, 0.8)


def test_blocks_of_items_give_the_same(docs, benchmark, monkeypatch):
    whole = {r.doc_id: r.item_ids for r in decontam.contaminated(docs, benchmark).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 800)
    assert len(list(decontam.blocks(benchmark))) > 1
    assert {r.doc_id: r.item_ids for r in decontam.contaminated(docs, benchmark).collect()} == whole
    kept = {r.doc_id for r in decontam.clean(docs, benchmark).collect()}
    assert kept == {d for d, ids in whole.items() if not ids}


def test_odd_rows(spark, odd_docs, no_docs, benchmark):
    items = spark.createDataFrame([(1, "alpha BETA gamma"), (1, "<s> <|endoftext|>"), (2, ""), (3, None), (None, "alpha"), (4, "💥"),
                                   (4, "💥")], "item_id long, text string")
    got = [(r.doc_id, r.item_ids) for r in decontam.contaminated(odd_docs, items).collect()]
    assert len(got) == 10
    assert dict(got) == {1: [1], 2: [1], 3: [], 4: [], 5: [], None: [1], 6: [], 7: [], 8: [1, 4]}
    cleaned = decontam.clean(odd_docs, items)
    assert cleaned.columns == odd_docs.columns and {r.doc_id for r in cleaned.collect()} == {3, 4, 5, 6, 7}
    assert decontam.contaminated(no_docs, benchmark).collect() == []
    assert all(not r.item_ids for r in decontam.contaminated(odd_docs, benchmark.where("false")).collect())
