import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crosstally.llm import tokens
from crosstally.llm.common import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library(spark, docs):
    known = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in tokens.counts(docs, PATH, new_folder(spark, "counts")).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(known.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 1024)


def test_only_distinct_misses_are_encoded(spark, odd_docs, monkeypatch):
    folder = new_folder(spark, "counts")
    odd_docs = odd_docs.dropDuplicates(["doc_id", "text"])  # rows that repeat both may be encoded more than once
    first = sorted(map(str, tokens.counts(odd_docs, PATH, folder).collect()))
    entries = spark.read.parquet(folder).cache()
    assert entries.count() == entries.select("content").distinct().count() == odd_docs.na.fill({"text": ""}).select("text").distinct().count()
    more = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(50, "new text"), (51, "new text")], "doc_id long, text string"))
    assert tokens.counts(more, PATH, folder).count() == 11
    after = spark.read.schema("content binary, version string, n_bytes long, n_tokens long").parquet(folder)
    assert after.count() == odd_docs.na.fill({"text": ""}).select("text").distinct().count() + 1

    def never(*_):
        raise AssertionError("encoded again")

    monkeypatch.setattr(tokens, "_encoder", never)
    assert sorted(map(str, tokens.counts(odd_docs, PATH, folder).collect())) == first


def test_another_version_has_entries_of_its_own(spark, docs):
    folder, pieces = new_folder(spark, "counts"), public_tokenizers.path("piece_bpe_32k.model")
    a = {r.doc_id: r.n_tokens for r in tokens.counts(docs, PATH, folder).collect()}
    b = {r.doc_id: r.n_tokens for r in tokens.counts(docs, pieces, folder).collect()}
    assert a != b and {r.doc_id: r.n_tokens for r in tokens.counts(docs, PATH, folder).collect()} == a
    assert spark.read.parquet(folder).select("version").distinct().count() == 2


def test_odd_rows(spark, odd_docs, no_docs):
    known = Tokenizer.from_file(PATH)
    got = sorted((str(r.doc_id), r.n_tokens) for r in tokens.counts(odd_docs, PATH, new_folder(spark, "counts")).collect())
    want = sorted((str(r.doc_id), len(known.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert got == want
    assert tokens.counts(no_docs, PATH, new_folder(spark, "counts")).collect() == []
    one = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")
    assert tokens.counts(one, PATH, new_folder(spark, "counts")).first().n_tokens == 1
