"""The commit log, records in key order with their file lists, and baselines in buckets."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import crosstally as ct
from crosstally.functions import KEY
from crosstally.operators import Ledger, delta_by_digest
from crosstally.operators.commits import CommitLog, Folder
from crosstally.operators.incremental import latest_digests
from crosstally.operators.layout import SortedFile, files_of_page

SIX = ct.COUNTS
RECORD = f"{KEY} string, source_hash string, target_hash string, status string, field_diffs string, source_payload string, target_payload string"


def records(spark, rows):
    """(key, status, payload) rows as records."""
    return spark.createDataFrame([(k, None, None, s, None, p, None) for k, s, p in rows], RECORD)


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"), buckets=8, file_rows=50)


# -- commit log ---------------------------------------------------------------------------------


def test_entries_are_numbered_and_states_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("crosstally.operators.commits.STATE_EVERY", 4)
    log, want = CommitLog(spark, str(tmp_path)), {}
    assert log.state() == (0, {})
    rng = random.Random(1)
    for n in range(1, 15):
        gone = rng.sample(sorted(want), min(len(want), rng.randrange(3)))
        new = Folder(f"x/{n}", "odd" if n % 2 else "even", {"n": n})
        assert log.commit([new], gone) == n
        want = {p: f for p, f in want.items() if p not in gone} | {new.path: new}
        assert CommitLog(spark, str(tmp_path)).state() == (n, want)
    assert {f.path for f in log.folders("odd")} == {p for p, f in want.items() if f.kind == "odd"}
    assert sum(p.name.endswith(".state.json") for p in (tmp_path / "_log").iterdir()) == 3
    assert log.commit([], ["x/14"], needs=["x/none"]) is None and log.state()[0] == 14


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    def write(w):
        log = CommitLog(spark, str(tmp_path))
        return [log.commit([Folder(f"{w}/{i}", "k", {})]) for i in range(6)]

    with ThreadPoolExecutor(4) as pool:
        numbers = sorted(n for own in pool.map(write, range(4)) for n in own)
    assert numbers == list(range(1, 25))
    assert set(CommitLog(spark, str(tmp_path)).state()[1]) == {f"{w}/{i}" for w in range(4) for i in range(6)}


def test_a_reader_between_all_file_operations(spark, ledger, monkeypatch):
    """Before and after each write, rename and delete, a reader sees each run once, and records with their run's end only."""
    seen, busy = [], []

    def look():
        if busy:
            return
        busy.append(True)
        try:
            other = Ledger(spark, ledger.path)
            runs = {r.run_id: r.status for r in other.runs().collect()}
            events = other.events().groupBy("run_id", "status").count().collect()
            assert all(r["count"] == 1 for r in events)
            held = {r.run_id: r["count"] for r in other.records().groupBy("run_id").count().collect()}
            assert held == {run: 3 for run, status in runs.items() if status == "COMPLETED"}
            seen.append(len(runs))
        finally:
            busy.pop()

    def around(owner, name):
        real = getattr(owner, name)

        def wrapped(*args, **more):
            look()
            try:
                return real(*args, **more)
            finally:
                look()

        monkeypatch.setattr(owner, name, wrapped)

    from pyspark.sql.readwriter import DataFrameWriter

    for owner, name in ((CommitLog, "_put"), (CommitLog, "_delete"), (DataFrameWriter, "parquet"), (DataFrameWriter, "saveAsTable")):
        around(owner, name)
    three = records(spark, [("a", "MISMATCHED", "1"), ("b", "SOURCE_ONLY", "2"), ("c", "TARGET_ONLY", None)])
    for n in range(2):
        run = ledger.start("d", "p")
        ledger.complete(run, dict.fromkeys(SIX, n), ledger.stage_records(run, three))
    failed = ledger.start("d", "p")
    ledger.stage_records(failed, three)  # a run that fails after it wrote records shows none
    ledger.fail(failed, ValueError("x"))
    before = ledger.runs()
    assert ledger.compact("d", "p") == 6 and ledger.compact("d", "p") == 0
    assert before.count() == 3  # a reader that began before still finds its files
    assert ledger.vacuum(3600) == 0 and before.count() == 3
    assert ledger.vacuum(0) == 6 and ledger.runs().count() == 3
    assert seen[-1] == 3 and len(seen) > 40


def test_a_retry_replaces_its_records(spark, ledger):
    run = ledger.start("d", "p")
    ledger.write_records(run, records(spark, [("a", "MISMATCHED", "1"), ("b", "MISMATCHED", "1")]))
    ledger.complete(run, dict.fromkeys(SIX, 1), ledger.stage_records(run, records(spark, [("a", "MISMATCHED", "2")])))
    assert [(r[KEY], r.source_payload, r.run_id) for r in ledger.records().collect()] == [("a", "2", run["run_id"])]
    assert ledger.page(run["run_id"])["total"] == 1 and ledger.baseline([run["run_id"]]).count() == 1
    ledger.release()


def test_two_compactions_at_once_replace_only_once(spark, ledger):
    for _ in range(3):
        ledger.complete(ledger.start("d", "p"), dict.fromkeys(SIX, 1))
    with ThreadPoolExecutor(2) as pool:
        done = sorted(pool.map(lambda _: Ledger(spark, ledger.path).compact("d", "p"), range(2)))
    assert done == [0, 6] and ledger.runs().count() == 3
    assert len(ledger.log.folders("runs")) == 1


# -- pages --------------------------------------------------------------------------------------


def test_files_of_a_page_equal_the_ranks():
    rng = random.Random(3)
    for _ in range(400):
        rows = sorted((f"{rng.randrange(500):04d}{i:03d}", rng.choice("AAB")) for i in range(rng.randrange(1, 120)))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(6))})
        files, held = [], {}
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = rows[a:b]
            files.append(SortedFile(str(n), part[0][0], part[-1][0], {s: sum(x[1] == s for x in part) for s in {x[1] for x in part}}))
            held[str(n)] = part
        rng.shuffle(files)
        status, limit, offset = rng.choice([None, "A", "B", "C"]), rng.randrange(1, 40), rng.randrange(0, 100)
        after = rng.choice([None, None, rng.choice(rows)[0], "0000", "9999"])
        offset = offset if after is None else 0
        own = [r for r in rows if status in (None, r[1]) and (after is None or r[0] > after)]
        chosen, skip = files_of_page(files, status, limit, offset, after)
        got = [r for f in chosen for r in held[f.file] if status in (None, r[1]) and (after is None or r[0] > after)]
        assert got[skip : skip + limit] == own[offset : offset + limit]
        if after is None and own[offset : offset + limit]:
            needless = [f for f in chosen if not set(held[f.file]) & set(own[offset : offset + limit])]
            assert not needless


def test_pages_read_few_files(spark, ledger):
    found = spark.range(3000).selectExpr(f"lpad(CAST(id AS STRING), 6, '0') AS {KEY}", "CAST(NULL AS STRING) AS source_hash",
                                         "CAST(NULL AS STRING) AS target_hash", "IF(id % 3 = 0, 'SOURCE_ONLY', 'MISMATCHED') AS status",
                                         "CAST(NULL AS STRING) AS field_diffs", "CAST(id AS STRING) AS source_payload",
                                         "CAST(NULL AS STRING) AS target_payload").repartition(7)
    ledger.write_records({"run_id": 9}, found)
    _, files = ledger._sorted_files(9)
    assert len(files) >= 60 and max(f.rows(None) for f in files) <= 50
    assert all(a.last_key < b.first_key for a, b in zip(sorted(files, key=lambda f: f.first_key), sorted(files, key=lambda f: f.first_key)[1:]))
    for status, step in ((None, 1), ("source", 3)):
        page = ledger.page_frame(9, status, limit=15, offset=900)
        assert [r[KEY] for r in page.collect()] == [f"{i * step:06d}" for i in range(900, 915)]
        assert len(page.inputFiles()) <= 2
    assert len(ledger.page_frame(9, limit=40, after_key="002500").inputFiles()) <= 3
    assert ledger.page(9, "mismatched", limit=10)["total"] == 2000
    assert ledger.page(9, offset=2995)["page_size"] == 5 and ledger.page(9, offset=5000)["page_size"] == 0
    assert ledger.page(77) == {"run_id": 77, "status": None, "limit": 1000, "offset": 0, "next_key": None, "total": 0, "page_size": 0, "records": []}


# -- baselines ----------------------------------------------------------------------------------


def _exchanges(df):
    """Shuffles of a plan whose baseline is scanned by bucket."""
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet, so not there twice
    assert "Bucketed: true" in plan
    return plan.count("Exchange ")


@pytest.mark.parametrize("shuffle", [4, 8])
def test_baselines_are_not_shuffled(spark, ledger, shuffle):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(f"k{i}", "MISMATCHED", str(i)) for i in range(300)]
        ledger.write_records({"run_id": 1}, records(spark, rows))
        later = [(k, s, p if i % 10 else "new") for i, (k, s, p) in enumerate(rows)] + [("z", "SOURCE_ONLY", "1")]
        current = records(spark, later)
        changed = delta_by_digest(current, ledger.baseline([1]))
        assert sorted(changed.collect()) == sorted(ct.delta(current, ledger.records([1])).collect()) and changed.count() == 31
        assert _exchanges(changed) == 1  # of the current records
        ledger.write_records({"run_id": 2}, changed)
        chained = latest_digests(ledger.baseline([1, 2]))
        assert chained.groupBy("run_id").count().orderBy("run_id").collect() == [(1, 270), (2, 31)]
        assert _exchanges(chained) == 0
        assert delta_by_digest(current, ledger.baseline([1, 2])).count() == 0
        assert delta_by_digest(current, ledger.baseline([])).count() == 301
    finally:
        ledger.release()
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("crosstally_")]


def test_baselines_of_other_bucket_numbers_are_read_as_they_lie(spark, ledger):
    ledger.write_records({"run_id": 1}, records(spark, [("a", "MISMATCHED", "1"), ("b", "MISMATCHED", "1")]))
    other = Ledger(spark, ledger.path, buckets=3)
    other.write_records({"run_id": 2}, records(spark, [("a", "MISMATCHED", "2")]))
    with other.baseline_of([1, 2]) as both:
        assert sorted((r[KEY], r.run_id) for r in latest_digests(both).collect()) == [("a", 2), ("b", 1)]


def test_every_watched_column_counts(spark):
    from crosstally.operators.layout import WATCHED, record_digest

    base = dict.fromkeys(WATCHED, "x")
    rows = [base, *[{**base, c: v} for c in WATCHED for v in (None, "y", "")]]
    found = spark.createDataFrame([tuple(r[c] for c in WATCHED) for r in rows], ", ".join(f"{c} string" for c in WATCHED))
    assert found.select(F.expr(record_digest())).distinct().count() == len(rows)
