import duckdb
import pytest

from crosstally.llm import lines

from .conftest import FOLDER


def sql(con, n):
    return sorted(con.execute(lines.oracle(n)).fetchall(), key=str)


@pytest.mark.parametrize("n", [2, 3, 5, 12])
def test_equals_sql(spark, docs, n):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = sorted((tuple(r) for r in lines.boilerplate_removed(docs, n).collect()), key=str)
    assert got == sql(con, n)
    assert any(r[3] for r in got)


def test_many_sites_near_the_threshold(spark):
    rows = [(i, f"line {k}\nown {i} {k}", f"site{i}") for k, sites in enumerate(range(180, 221)) for i in range(k * 1000, k * 1000 + sites)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lines.spread(frame, 200).select("sites").collect()
    assert len(found) == 21  # 200 to 220, as the exact counts say


def test_odd_rows(odd_docs, no_docs):
    got = lines.boilerplate_removed(odd_docs, 2).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[3].text == by[4].text == "" and by[5].text == " \n\t " and by[3].n_removed == 0
    assert by[1].n_removed == 0 and by[None].n_removed == 1 and by[None].text == ""
    assert by[7].text == "" and by[6].n_removed == 0
    cleaned = lines.without_boilerplate(odd_docs, 2)
    assert cleaned.columns == odd_docs.columns and cleaned.dtypes == odd_docs.dtypes
    assert sorted(r.doc_id or 0 for r in cleaned.collect()) == [1, 1, 2, 3, 4, 5, 6, 8]
    assert lines.boilerplate_removed(no_docs).collect() == [] and lines.without_boilerplate(no_docs).collect() == []


def test_plan_has_no_python(docs):
    plan = lines.without_boilerplate(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
