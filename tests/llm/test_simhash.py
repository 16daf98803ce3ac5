import random

import xxhash
from pyspark.sql import functions as F

from crosstally.llm import simhash
from crosstally.llm.common import components, words


def plain_fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):  # groups of close variants, some of them long, and one of exact copies
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 400, 900]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 12 + ["", None, "  "]
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {i * 3: plain_fingerprint(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = plain_components(prints, pairs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert len(set(want.values())) < len(prints)


def test_pairs_at_each_distance_share_a_variant(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        f = rng.getrandbits(64)
        for bits in range(6):
            g = f
            for b in rng.sample(range(64), bits):
                g ^= 1 << b
            rows.append((i * 10 + bits, f, g))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = {}
    for n, f, g in rows:
        nodes[g] = min(n, nodes.get(g, n))
    frame = spark.createDataFrame([(n, signed(f)) for f, n in nodes.items()], "node long, f0 long")
    got = {r.node: r.component for r in simhash.links(frame, 1, 3, 4).collect()}
    pairs = [(a, b) for f, a in nodes.items() for g, b in nodes.items() if a < b and (f ^ g).bit_count() <= 4]
    want = plain_components(list(nodes.values()), pairs)
    assert {n: got.get(n, n) for n in want} == want


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()]
    assert len(rows) == 10
    of = {d: c for d, _, c in rows}
    assert of[2] == of[1] == 1 and of[3] == of[4] == of[5] == 3 and of[7] == of[6] == 6
    assert of[None] is None and [d for d, _, _ in rows].count(1) == 2
    assert {f for d, f, _ in rows if d in (3, 4, 5)} == {"0" * 16}
    assert simhash.near_duplicates(no_docs).collect() == []


def test_repeated_id_ties_its_texts_together(spark):
    frame = spark.createDataFrame([(5, "one two three four five"), (5, "six seven eight nine ten"), (7, "six seven eight nine ten"),
                                   (9, "one two three four five")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(frame).collect()} == {5}


def jaccard(a, b):
    x, y = (set(zip(*(words(t)[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def test_one_of_each_group_stays(spark, docs):
    rng = random.Random(4)
    rows = {r.doc_id: r.text for r in docs.collect()}
    near, top = {}, max(rows)
    for i, text in list(rows.items())[:120]:
        copy = text.split(" ")
        if len(copy) < 60:
            continue
        for _ in range(max(1, len(copy) // 80)):
            copy[rng.randrange(len(copy))] = "changed"
        top += 1
        if jaccard(text, " ".join(copy)) >= 0.8:
            near[top] = i, " ".join(copy)
    frame = spark.createDataFrame([*rows.items(), *((k, t) for k, (_, t) in near.items())], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    caught = sum(k not in kept or i not in kept for k, (i, _) in near.items())
    assert len(near) > 50 and caught >= 0.95 * len(near)
    # What goes has a near copy of a smaller id, by its own words.
    everything = {**rows, **{k: t for k, (_, t) in near.items()}}
    for gone in set(everything) - kept:
        a = everything[gone]
        assert any(words(a) == words(b) or (len(words(a)) >= 5 and len(words(b)) >= 5 and jaccard(a, b) >= 0.8)
                   for i, b in everything.items() if i != gone), gone


def near_copy(rng, base, kind, new):
    """The text with one kind of edit, at a Jaccard similarity of about 0.82."""
    n, copy = len(base), list(base)
    if kind == "appended":
        copy += [new() for _ in range(round((n - 4) * 0.22))]
    elif kind == "trimmed":
        copy = copy[round((n - 4) * 0.18) :]
    elif kind == "inserted":
        at = rng.randrange(5, n - 5)
        copy[at:at] = [new() for _ in range(round((n - 8) / 0.82 - n))]
    else:
        for i in range(edits := max(1, round((n - 4) * 0.0198))):
            copy[(i * n + n // 2) // edits] = new()
    return copy


def test_one_of_each_finds_copies_of_every_kind(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 3) for i in range(4000)]
    new = lambda: rng.choices(vocabulary, weights)[0]
    rows, pairs = [], {}
    for kind in ("appended", "trimmed", "inserted", "replaced"):
        for n in (20, 50, 100, 300, 1000):
            for _ in range(150 if n < 100 else 100):
                base = rng.choices(vocabulary, weights, k=n)
                a, b = " ".join(base), " ".join(near_copy(rng, base, kind, new))
                if 0.8 <= jaccard(a, b) < 0.85:
                    pairs.setdefault((kind, n), []).append(len(rows) + 1)
                    rows += [(len(rows), a), (len(rows) + 1, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    found = {k: sum(i not in kept for i in ids) / len(ids) for k, ids in pairs.items()}
    # In 20 or 50 words a replaced word changes five shingles, too many for this similarity or just few enough.
    assert len(found) >= 18 and min(len(p) for (_, n), p in pairs.items() if n >= 100) >= 50
    assert min(found.values()) >= 0.98, found


def test_both_kinds_of_candidates_count(spark, monkeypatch):
    """Deletion variants alone find copies with few changes, bands alone find those with many."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, light, heavy = [], [], []
    for n, group in [(600, light)] * 60 + [(100, heavy)] * 60:
        base = rng.choices(vocabulary, k=n)
        copy = list(base)
        if group is light:
            copy[rng.randrange(n)] = "other"
        else:
            copy += rng.choices(vocabulary, k=20)
        group.append(len(rows) + 1)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "SKETCH_BITS", -1)
    kept = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    assert sum(i not in kept for i in light) >= 40 and sum(i not in kept for i in heavy) <= 10
    monkeypatch.setattr(simhash, "SKETCH_BITS", 32)
    monkeypatch.setattr(simhash, "variants", lambda *_: F.expr("array(named_struct('key', CAST(NULL AS LONG), 'own', 2))"))
    kept = {r.doc_id for r in simhash.one_of_each(frame).collect()}
    assert not set(light) & kept and not set(heavy) & kept


def test_fingerprints_that_no_lead_links_are_paired(spark, monkeypatch):
    """3 shares all of its buckets with 1, which is like nothing; its link to 2 comes from fingerprints alone."""
    prints = [(1, 1, 0b11, 0, 0, [1]), (2, 2, 0b01, 0, 0, [2]), (3, 3, 0b11, 0, 0, [3])]
    monkeypatch.setattr(simhash, "with_bands", lambda *_: spark.createDataFrame(
        prints, "doc_id long, same long, f0 long, m0 long, m1 long, bands array<long>"))
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *_: pairs.where("a > 1 AND b > 1"))
    frame = spark.createDataFrame([(n, f"t{n}") for n, *_ in prints], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(frame).collect()) == [1, 2]


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB_PAIRS", 7)
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    copies = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = f"own{i}"
        copies.append(" ".join(copy))
    frame = spark.createDataFrame([(0, " ".join(base)), *((i + 1, t) for i, t in enumerate(copies)), (999, "one two three four five six")],
                                  "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(frame).collect()) == [0, 999]


def test_one_of_each_on_odd_rows(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3, 6, 8]
    assert simhash.one_of_each(no_docs).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 900)]
    frame = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 900)}}
