import math
import zlib

import numpy as np
import zstandard

from crosstally.llm import quality

from .conftest import FOLDER


def test_held_out_accuracy(spark):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in quality.scores(docs, labels).where("held_out").collect() if r.doc_id in truth]
    good = [p for p, q in held if q == 1]
    bad = [p for p, q in held if q == 0]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_learns_only_from_rows_not_held_out(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    flipped = labels.rdd.map(lambda r: (r.doc_id, 1 - r.quality if held(r.doc_id) else r.quality)).toDF("doc_id long, quality int")
    assert quality.fit(docs, flipped) == quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())


def test_odd_rows(spark, odd_docs, no_docs, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model_docs = docs.unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    assert len(quality.scores(model_docs, labels).collect()) == docs.count() + 10
    for broken in (labels.where("false"), labels.where("quality = 1"), labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality")):
        assert {r.score for r in quality.scores(odd_docs, broken).collect()} == {0.5}
    kept = quality.keep_good(odd_docs, labels.where("false"))
    assert kept.columns == odd_docs.columns and kept.count() == 10
    assert quality.scores(no_docs, labels).collect() == [] and quality.keep_good(no_docs, labels).collect() == []


def test_label_conflicts_and_repeats_teach_once(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    assert quality.fit(docs, labels.union(labels)) == quality.fit(docs, labels)
    one = labels.where("quality = 1").first().doc_id
    both = labels.union(spark.createDataFrame([(one, 0), (None, 1)], "doc_id long, quality int"))
    assert quality.fit(docs, both) == quality.fit(docs, labels.where(f"doc_id <> {one}"))


def test_equals_brute_force(spark, docs):
    """Sizes block by block with compressors of their own, the curve by plain gradient steps from the model's own start."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts}
    turn = {r.doc_id: r.turn for r in labels.selectExpr("doc_id", "xxhash64(doc_id) AS turn").collect()}
    dictionaries, turns, curve = {0: [], 1: []}, {0: 0, 1: 0}, []
    for d in sorted(known, key=lambda d: (turn[d], d)):
        data, q = texts[d].encode(), known[d]
        turns[q] += 1
        if turns[q] % 2 and len(data) <= 20_000 and sum(map(len, dictionaries[q])) + len(data) <= 1_000_000:
            dictionaries[q].append(data)
        else:
            curve.append(d)
    model = quality.fit(docs, labels)
    assert (model.good, model.bad) == (b"\n".join(dictionaries[1]), b"\n".join(dictionaries[0]))

    def size(content, block):
        made = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, write_dict_id=False,
                                        dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        return len(made.compress(block))

    def features(text):
        data = text.encode()
        if not data:
            return (0.0, 0.0, 0.0, 0.0)
        blocks = [data[i : i + 2048] for i in range(0, len(data), 2048)]
        good, bad = (sum(size(c, b) for b in blocks) for c in (model.good, model.bad))
        d, m, w = (bad - good) / len(data), (good + bad - 18 * len(blocks)) / 2 / len(data), len(data) / (len(data) + 100)
        return (d * w, m * w, d * m * w, w)

    some = sorted(texts)[:60]
    got = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    for d in some:
        z = np.dot((*features(texts[d]), 1.0), model.weights)
        assert math.isclose(got[d], 1 / (1 + math.exp(-min(30, max(-30, z)))), rel_tol=1e-9)
    # The curve's weights: no small step in any direction lowers the penalised loss.
    x, y = np.array([features(texts[d]) for d in curve]), np.array([known[d] for d in curve])
    scale = x.std(0) + 1e-9

    def loss(w):
        z = x @ w[:-1] + w[-1]
        inner = np.append(w[:-1] * scale, w[-1] + w[:-1] @ x.mean(0))
        return np.logaddexp(0, -z)[y == 1].sum() + np.logaddexp(0, z)[y == 0].sum() + 0.5e-3 * (inner**2).sum()

    w = np.array(model.weights)
    for i in range(5):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            moved[i] += step * max(1, abs(w[i]))
            assert loss(moved) >= loss(w) - 1e-6


def test_repeated_ids_and_long_texts_stay_off_the_driver(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.fit(docs.union(docs).union(docs), labels) == model
    long = docs.selectExpr("doc_id", "IF(doc_id % 7 = 0, repeat(text, 60), text) AS text")
    other = quality.fit(long, labels)
    assert max(len(other.good), len(other.bad)) <= 1_000_000 + 3000
