"""The registered queries over a whole small folder: columns, types and rows; SQL where there is some."""

import duckdb
import pytest

from crosstally.llm.queries import ORACLES, QUERIES

from .conftest import FOLDER

SHAPES = {
    "op1": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op2": ("documents", {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_removed": "bigint"}),
    "op3": ("documents", {"doc_id": "bigint", "item_ids": "array<bigint>", "n_items": "bigint"}),
    "op4": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op5": ("documents", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint",
                          "train_tokens": "bigint", "base_score": "double", "score": "double"}),
    "op6": (None, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
    "op7": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op8": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op9": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op10": ("pages", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string",
                       "refers_to": "bigint"}),
    "op11": ("embeddings", {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint",
                            "inertia": "bigint", "centroid_sha256": "string"}),
    "op12": ("embeddings", {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint",
                            "codebooks_sha256": "string"}),
    "op13": ("documents", {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean",
                           "text_sha256": "string"}),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_shape(spark, name):
    table, types = SHAPES[name.split("_")[0]]
    got = QUERIES[name](spark, FOLDER)
    assert dict(got.dtypes) == types
    rows = got.collect()
    if table is not None:
        key = got.columns[0]
        want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()
        assert sorted(r[key] for r in rows) == sorted(r[key] for r in want)
    if name in ORACLES:
        con = duckdb.connect()
        for view in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
        sql = con.execute(f"SELECT {', '.join(types)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(sql)
