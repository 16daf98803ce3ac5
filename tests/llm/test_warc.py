import base64
import gzip
import hashlib

import pyarrow.fs as pafs

from crosstally.llm import warc
from crosstally.llm.common import new_folder

from .conftest import FOLDER


def want(rows):
    data = [(r.page_id, (r.html or "").encode()) for r in rows]
    lead = {}
    for page, body in data:
        lead[body] = max(page, lead.get(body, page))
    return sorted((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                   "response" if lead[body] == page else "revisit", None if lead[body] == page else lead[body]) for page, body in data)


def test_round_trip_of_all_pages(spark):
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    copies = table.selectExpr("page_id + 100000 AS page_id", "url", "html").where("page_id % 3 = 0")
    pages = table.union(copies).union(table.selectExpr("page_id + 500000", "url", "CASE WHEN page_id % 2 = 0 THEN '' END").limit(9))
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == want(pages.collect())


def test_archives_are_plain_warc_and_chunks_make_up_payloads(spark, monkeypatch):
    big = "é<p>" * 150_000
    pages = spark.createDataFrame([(1, "http://a/ b", big), (2, "http://a/2", "small"), (3, None, big), (4, "http://a/4", None)],
                                  "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    archives = warc.written(warc.planned(pages), folder)
    texts = b""
    for r in archives.collect():
        system, _ = pafs.FileSystem.from_uri(folder)
        texts += gzip.decompress(system.open_input_stream(r.path, compression=None).read())
    assert texts.count(b"WARC/1.1\r\n") == 4 and texts.count(b"WARC-Type: revisit") == 1
    assert texts.count(big.encode()) == 1 and b"WARC-Target-URI: http://a/%20b\r\n" in texts
    for part in texts.split(b"WARC/1.1\r\n")[1:]:
        head, block = part.split(b"\r\n\r\n", 1)
        length = int(next(h for h in head.split(b"\r\n") if h.startswith(b"Content-Length")).split()[1])
        assert block[length:] == b"\r\n\r\n"
    rows = warc.read(archives, folder).orderBy("record_id", "chunk").collect()
    assert max(len(r.data) for r in rows) <= warc.CHUNK
    three = [r for r in rows if r.page_id == 3]
    assert len(three) > 5 and b"".join(bytes(r.data) for r in three) == big.encode()
    assert [r.payload_digest is None for r in three] == [True] * (len(three) - 1) + [False]
    assert three[-1].payload_digest == three[-1].stated


def test_many_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    assert sorted(map(tuple, warc.round_trip(table).collect())) == want(table.collect())


def test_odd_rows(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (2, None, None), (3, "u\r\nWARC/1.1", ""), (4, "u", "WARC/1.1\r\n\r\n"), (4, "u", "other")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS sha1", "3 AS chunk", "4 AS copy")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()), key=str)
    assert got == sorted([(1, 1, "response", None), (1, 1, "revisit", 1), (None, 1, "revisit", 1), (2, 0, "revisit", 3),
                          (3, 0, "response", None), (4, 12, "response", None), (4, 5, "response", None)], key=str)
    assert warc.round_trip(frame.where("false")).collect() == []
    alone = warc.round_trip(frame.where("page_id IS NULL")).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in alone] == [(None, "response", None)]


def test_payloads_are_cut_before_they_are_shuffled(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 500_000), (2, "u", "x" * 500_000), (3, "u", "y")], "page_id long, url string, html string")
    plan = warc.planned(pages)
    rows = plan.collect()
    assert max(len(r.data) for r in rows) == warc.CHUNK
    assert sum(len(r.data) for r in rows) == 500_001 and sum(r.key == 1 for r in rows) == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in text and "Window" not in text
