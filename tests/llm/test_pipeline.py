import pytest

import corpus_pipeline as P
from crosstally.llm import decontam, lines, pieces, quality, simhash
from crosstally.llm.queries import QUERIES

from .conftest import FOLDER


def test_stages_and_queries():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "sentencepiece"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_decisions_take_effect(spark, docs):
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("labels", "benchmark"))
    good = {r.doc_id for r in quality.scores(docs, labels).where("predicted = 1").collect()}
    first = P.STAGES[0][1](spark, docs, FOLDER).cache()
    assert {r.doc_id for r in first.collect()} == good and first.columns == docs.columns
    second = P.STAGES[1][1](spark, first, FOLDER).cache()
    cleaned = {r.doc_id: r.text for r in lines.boilerplate_removed(first, P.MIN_SITES).collect()}
    assert all(cleaned[r.doc_id] == r.text and len(r.text) == r.n_chars for r in second.collect())
    third = P.STAGES[2][1](spark, second, FOLDER).cache()
    assert 0 < third.count() < second.count()
    assert simhash.one_of_each(third).count() == third.count()
    fourth = P.STAGES[3][1](spark, third, FOLDER).cache()
    held = {r.doc_id for r in decontam.contaminated(third, benchmark).where("n_items > 0").collect()}
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()} - held
    assert fourth.dtypes == docs.dtypes
    last = P.STAGES[4][1](spark, fourth, FOLDER)
    whole = P.run(spark, FOLDER)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_and_on_no_rows(spark, odd_docs, no_docs, at):
    out = P.STAGES[at][1](spark, odd_docs, FOLDER)
    assert at == 4 or out.dtypes == odd_docs.dtypes
    out.collect()
    assert P.STAGES[at][1](spark, no_docs, FOLDER).collect() == []


def test_columns_keep_their_names_in_last_stage(spark, docs):
    assert pieces.digests(docs, __import__("public_tokenizers").path("piece_bpe_32k.model")).columns == [
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
