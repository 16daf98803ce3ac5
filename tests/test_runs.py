import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import crosstally as ct
from crosstally import Catalog, CompareMode, CompareSettings, ConfigurationError, Datasource, Defaults, Domain, Profile, SideSpec
from crosstally.operators import Ledger, Runner, normalize_status
from crosstally.operators.ledger import failure_text

SIX = ct.COUNTS


def side(view, *fields, **more):
    return SideSpec(table=view, key="id", fields=fields or ("name", "status"), **more)


def view(spark, name, rows, schema="id string, name string, status string"):
    spark.createDataFrame(rows, schema).createOrReplaceTempView(name)


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def runner(spark, ledger, profiles=None, **more):
    profiles = profiles or {"p": Profile(side("src"), side("tgt"))}
    return Runner(spark, Catalog(domains=[Domain("d", profiles)]), ledger, **more)


def counts(run):
    return tuple(run[c] for c in SIX)


def keys(ledger, run):
    return {r["migration_key"]: r["status"] for r in ledger.page(run["run_id"])["records"]}


SRC = [("1", "a", "A"), ("2", "b", "A"), ("3", "c", "A")]
TGT = [("1", "a", "A"), ("2", "x", "A"), ("4", "d", "A")]


def test_full_then_incremental(spark, ledger):
    view(spark, "src", SRC)
    view(spark, "tgt", TGT)
    run = runner(spark, ledger)
    first = run.run_profile("p")
    assert (first["status"], first["run_scope"], first["recon_mode"]) == ("COMPLETED", "FULL", "MISMATCH_DETAILS")
    assert counts(first) == (3, 3, 1, 1, 1, 1)
    assert keys(ledger, first) == {"2": "MISMATCHED", "3": "SOURCE_ONLY", "4": "TARGET_ONLY"}
    assert 'AS "MigrationKey", name, status FROM src' in first["source_query"]

    # Nothing new: the incremental run stores nothing but counts everything.
    second = run.run_profile("d.p")
    assert (second["run_scope"], second["baseline_run_id"]) == ("INCREMENTAL", first["run_id"])
    assert counts(second) == counts(first) and keys(ledger, second) == {}

    # One key changes. Against the previous run alone all differences are new again, as it stored none.
    view(spark, "tgt", [("1", "a", "A"), ("2", "y", "A"), ("4", "d", "A")])
    chained = runner(spark, ledger, baseline="chained").run_profile("p")
    assert keys(ledger, chained) == {"2": "MISMATCHED"}
    forced = run.run_profile("p", force_full=True)
    assert forced["run_scope"] == "FULL" and len(keys(ledger, forced)) == 3
    assert ledger.active("d", "p")["run_id"] == forced["run_id"]
    active = ct.list_runs(ledger.runs(), domain="d", profile="p", active=True).collect()
    assert [r.run_id for r in active] == [forced["run_id"]]
    listed = [r.run_id for r in ct.list_runs(ledger.runs(), dataset="d.p").collect()]
    assert listed == sorted(listed, reverse=True) and len(listed) == 4


def test_modes_and_conditions(spark, ledger):
    view(spark, "src", [("k", "Acme", "ACTIVE")])
    view(spark, "tgt", [("k", "Acme", "CLOSED")])
    run = runner(spark, ledger)
    counted = run.run_profile("p", mode="COUNTS")
    assert counts(counted) == (1, 1, 0, 1, 0, 0) and ledger.page(counted["run_id"])["total"] == 0
    # A counting run is a baseline without records, so the next run stores everything.
    detailed = run.run_profile("p", mode=CompareMode.FIELD_DETAILS)
    record = ledger.page(detailed["run_id"], "mismatched")["records"][0]
    assert record["field_diffs"] == '{"name":"MATCHED","status":"MISMATCHED"}'
    filtered = run.run_profile("p", condition_fields=["name"], force_full=True)
    assert counts(filtered) == (1, 1, 0, 1, 0, 0) and keys(ledger, filtered) == {} and filtered["condition_fields"] == "name"


def test_windows_follow_each_other(spark, ledger):
    spark.sql("SELECT 1 AS id, 'a' AS name, now() AS changed").createOrReplaceTempView("timed")
    query = 'SELECT id AS "MigrationKey", name FROM timed WHERE changed > :since AND changed <= :until + INTERVAL 1 DAY'
    both = {"p": Profile(SideSpec(query=query, fields=("name",)), SideSpec(query=query, fields=("name",)))}
    run = runner(spark, ledger, both)
    first, second = run.run_profile("p"), run.run_profile("p")
    assert first["source_count"] == 1 and second["run_scope"] == "INCREMENTAL"
    assert second["window_until"] > first["window_until"] and first["source_query"] == query


def test_failures_are_recorded_and_never_become_active(spark, ledger):
    view(spark, "src", SRC)
    view(spark, "tgt", TGT)
    good = runner(spark, ledger).run_profile("p")
    view(spark, "src", [(None, "a", "A")])
    failed = runner(spark, ledger).run_profile("p")
    assert failed["status"] == "FAILED" and "null value" in failed["error_message"]
    assert ledger.run(failed["run_id"])["status"] == "FAILED" and ledger.active("d", "p")["run_id"] == good["run_id"]
    missing = runner(spark, ledger, {"p": Profile(side("no_such_view"), side("tgt"))}).run_profile("p")
    assert missing["status"] == "FAILED"
    unknown = runner(spark, ledger, {"p": Profile(side("src", datasource="x", kind="postgres"), side("tgt"))})
    with pytest.raises(ConfigurationError, match="Unknown datasource"):
        unknown.run_profile("p")


def test_domain_run(spark, ledger):
    view(spark, "src", SRC)
    view(spark, "tgt", TGT)
    view(spark, "bad", [(None, "a", "A")])
    ok = {"one": Profile(side("src"), side("tgt")), "two": Profile(side("src"), side("src"))}
    done = runner(spark, ledger, ok).run_domain("d")
    assert done["run"]["status"] == "COMPLETED" and counts(done["run"]) == (6, 6, 4, 1, 1, 1)
    rolled = ct.domain_rollup(ledger.runs()).first()
    assert tuple(rolled[c] for c in SIX) == counts(done["run"]) and rolled.profiles == 2
    mixed = runner(spark, ledger, {**ok, "three": Profile(side("bad"), side("tgt"))}).run_domain("d", force_full=True)
    assert mixed["run"]["status"] == "FAILED" and "One or more profiles failed" in mixed["run"]["error_message"]
    assert [mixed["profiles"][p]["status"] for p in ("one", "two", "three")] == ["COMPLETED", "COMPLETED", "FAILED"]
    parts = ct.list_runs(ledger.runs(), domain_run=mixed["run"]["run_id"]).count()
    assert parts == 4
    text = ct.domain_digest(ledger.runs()).filter(F.col("run_id") == done["run"]["run_id"]).first().digest
    assert "profile=one" in text and "matched=4" in text
    empty = Runner(spark, Catalog(domains=[Domain("e")]), ledger).run_domain("e")
    assert empty["run"]["status"] == "COMPLETED" and counts(empty["run"]) == (0,) * 6


def test_digest_names_keys_but_no_values(spark, ledger):
    view(spark, "src", [("1", "secret", "A"), ("2", "b", "A")])
    view(spark, "tgt", [("1", "hidden", "A"), ("2", "b", "A")])
    run = runner(spark, ledger).run_profile("p", mode="FIELD_DETAILS")
    text = ct.run_digest(ct.with_active(ledger.runs()), ledger.records()).first().digest
    assert f"domain=d profile=p runId={run['run_id']} status=COMPLETED mode=FIELD_DETAILS active=true" in text
    assert 'detailRows=1 sampledNonMatches=1\n- key=1 status=MISMATCHED fieldDiffs={"name":"MISMATCHED","status":"MATCHED"}\n' in text
    assert "secret" not in text and "key=2" not in text


def test_pages(spark):
    records = spark.range(2500).selectExpr(
        "1L AS run_id", "lpad(CAST(id AS STRING), 5, '0') AS migration_key", "IF(id < 5, 'SOURCE_ONLY', 'MISMATCHED') AS status"
    )
    page = [r.migration_key for r in ct.records_page(records, 1, limit=3, offset=4).collect()]
    assert page == ["00004", "00005", "00006"]
    for odd in (dict(limit=9999), dict(limit=0), dict(offset=-1)):
        with pytest.raises(ConfigurationError):
            ct.records_page(records, 1, **odd)
    after = [r.migration_key for r in ct.records_page(records, 1, limit=3, after_key="00006").collect()]
    assert after == ["00007", "00008", "00009"]
    assert ct.records_page(records, 1, limit=2000, most=5000).count() == 2000
    assert ct.records_total(records, 1, "source").first().total == 5


def test_status_names():
    assert normalize_status(" source ") == "SOURCE_ONLY" and normalize_status("Target") == "TARGET_ONLY"
    assert normalize_status("matched") == "MATCHED" and normalize_status(" ") is None and normalize_status(None) is None
    with pytest.raises(ConfigurationError, match="Unknown status"):
        normalize_status("odd")


def test_failure_text_names_the_root():
    try:
        try:
            raise OSError("disk")
        except OSError as inner:
            raise RuntimeError("outer") from inner
    except RuntimeError as error:
        assert failure_text(error) == "outer, rootCause=[disk]"
    assert failure_text(ValueError()) == "ValueError"


# -- catalog ------------------------------------------------------------------------------------


def catalog():
    sources = [Datasource("landing", "postgres", schema="raw"), Datasource("master", "postgres"), Datasource("csv", "file", tags=[" A ", "a"])]
    plain = Profile(SideSpec(table="t", fields=("a",)), SideSpec(table="t", fields=("a",)), key="id")
    own = Profile(
        SideSpec(datasource="raw", table="t", fields=("a",), key="own"),
        SideSpec(table="t", fields=("a",), schema="mine"),
        settings=CompareSettings("COUNTS", ["z"]),
        strategy="TypeLenient",
        target_datasource="csv",
        identifiers=("i",),
    )
    party = Domain(
        "party", {"plain": plain, "own": own}, CompareSettings("FIELD_DETAILS", ["x"]), "TypeStrict", "landing", "master", batch_size=7
    )
    return Catalog(sources, [party, Domain("other", {"plain": plain})], Defaults(batch_size=9))


def test_settings_are_inherited():
    c = catalog()
    plain = c.profile("party", "plain")
    assert (plain.source.datasource, plain.source.schema, plain.target.datasource) == ("landing", "raw", "master")
    assert plain.settings == CompareSettings("FIELD_DETAILS", ("x",)) and plain.strategy.value == "TypeStrict"
    assert plain.source.key.columns == ("id",) and plain.batch_size == 7 and plain.qualified_id == "party.plain"
    own = c.profile("party", "own")
    assert (own.source.datasource, own.target.datasource, own.target.schema) == ("landing", "csv", "mine")
    assert own.settings == CompareSettings("COUNTS", ("z",)) and own.strategy.value == "TypeLenient"
    assert own.target.key.columns == ("own",) and own.target.comparable_fields == ("i", "a")
    default = c.profile("other", "plain")
    assert default.settings.mode is CompareMode.MISMATCH_DETAILS and default.strategy.value == "TypeLenient" and default.batch_size == 9


def test_profiles_are_found_by_reference():
    c = catalog()
    assert c.resolve_profile("party.own").profile_id == "own" == c.resolve_profile("OWN").profile_id
    assert c.resolve_profile("plain", "other").domain_id == "other"
    for ref, domain, message in (
        ("plain", None, "found in one domain"),
        ("nope", None, "no domain"),
        ("party.own", "other", "another domain"),
        (" ", None, "Name the profile"),
        ("x.y", None, "Unknown domain"),
    ):
        with pytest.raises(ConfigurationError, match=message):
            c.resolve_profile(ref, domain)


def test_datasources_are_checked():
    c = catalog()
    assert c.datasource("raw").name == "landing" and c.datasources["csv"].tags == ("a",)
    for bad, message in (
        (lambda: c.add_datasource(Datasource("csv", "mongo")), "already registered"),
        (lambda: c.add_datasource(Datasource("new", "postgres", schema="raw")), "already bound"),
        (lambda: c.datasource("zzz"), "Unknown datasource"),
        (lambda: Datasource("bad name", "file"), "must match"),
        (lambda: CompareMode.of("ALL"), "Unknown mode"),
    ):
        with pytest.raises(ConfigurationError, match=message):
            bad()
    base = CompareSettings("COUNTS", ["a"])
    assert base.overlay() == base and base.overlay("FIELD_DETAILS", []) == CompareSettings("FIELD_DETAILS", ())


# -- versioned tables ---------------------------------------------------------------------------

HISTORY = "id string, config string, version int, active boolean, created_at timestamp, created_by string, updated_at timestamp, updated_by string"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def day(n):
    return T0 + timedelta(days=n)


def test_upsert_closes_and_counts_on(spark):
    history = spark.createDataFrame(
        [("a", "1", 3, True, T0, "x", T0, "x"), ("b", "1", 5, False, T0, "x", T0, "x"), ("c", "1", 1, True, T0, "x", T0, "x")], HISTORY
    )
    changes = spark.createDataFrame([("a", "2", day(1)), ("a", "3", day(5)), ("b", "2", day(2))], "id string, config string, changed_at timestamp")
    got = {(r.id, r.version, r.config): r for r in ct.upsert(history, changes, "id", "me").collect()}
    assert len(got) == 6
    closed = got[("a", 3, "1")]
    assert not closed.active and closed.updated_by == "me"
    assert not got[("a", 4, "2")].active and got[("a", 5, "3")].active and got[("a", 5, "3")].created_by == "x"
    # Deleted before: the entity starts again.
    assert got[("b", 1, "2")].active and got[("b", 1, "2")].created_by == "me" and not got[("b", 5, "1")].active
    assert got[("c", 1, "1")].active
    live = ct.active_snapshot(ct.upsert(history, changes, "id", "me"), "id").collect()
    assert [(r.id, r.version) for r in live] == [("a", 5), ("b", 1), ("c", 1)]


@pytest.mark.parametrize("most", [100_000, 30])
def test_one_entity_with_most_changes(spark, most):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"e{rng.randrange(5)}", i, rng.choice([None, i]), rng.choice([None, f"m{i}"])) for i in range(400)]
    patches = spark.createDataFrame(rows, "id string, no bigint, a bigint, b string")
    state, expected = {}, set()
    for entity, no, a, b in rows:
        old = state.get(entity, (None, None))
        state[entity] = (old[0] if a is None else a, old[1] if b is None else b)
        expected.add((entity, no, *state[entity]))
    assert {tuple(r) for r in ct.patch_merge(patches, "id", "no", rows_per_segment=most).collect()} == expected
    last = {tuple(r)[0]: tuple(r)[2:] for r in ct.latest_patch(patches, "id", "no").collect()}
    assert last == state
    changes = patches.selectExpr("id", "b AS config", "timestamp_seconds(no) AS changed_at")
    versions = ct.upsert(spark.createDataFrame([], HISTORY), changes, "id", "me", rows_per_segment=most)
    hot = [r for r in versions.filter("id = 'hot'").orderBy("version").collect()]
    assert [r.version for r in hot] == list(range(1, len(hot) + 1)) and [r.active for r in hot] == [False] * (len(hot) - 1) + [True]
    assert [r.config for r in hot] == [r[3] for r in rows if r[0] == "hot"]


def test_delete_reaches_children(spark):
    parents = spark.createDataFrame([("p", "1", 1, True, T0, "x", T0, "x"), ("q", "1", 1, True, T0, "x", T0, "x")], HISTORY)
    children = parents.unionAll(parents.filter("id = 'p'").withColumn("active", F.lit(False)))
    gone = spark.createDataFrame([("p",), ("p",)], "id string")
    after = ct.delete_cascade(parents, children, gone, "id", "me", F.lit(day(1)))
    assert {(r.id, r.active, r.updated_by) for r in after[0].collect()} == {("p", False, "me"), ("q", True, "x")}
    assert sorted((r.id, r.active, r.updated_by) for r in after[1].collect()) == [("p", False, "me"), ("p", False, "x"), ("q", True, "x")]


def test_defaults_fill_in(spark):
    profiles = spark.createDataFrame([("p1", "d1", None, " "), ("p2", "d1", "X", "own"), ("p3", "d2", None, None)], "p string, domain_id string, mode string, source string")
    domains = spark.createDataFrame([("d1", "M", "dom"), ("d2", None, None)], "domain_id string, mode string, source string")
    got = {r.p: (r.mode, r.source) for r in ct.fill_defaults(profiles, domains, {"mode": "Z"}).collect()}
    assert got == {"p1": ("M", "dom"), "p2": ("X", "own"), "p3": ("Z", None)}


def test_one_moment_is_cut_by_the_tie_break(spark):
    from crosstally.plans.segments import with_segment

    rows = spark.range(5000).selectExpr("'hot' AS id", "timestamp_seconds(IF(id < 1000, id, 1000000)) AS at", "id AS no")
    cut = with_segment(rows, ["id"], "at", "no", rows=100)
    sizes = [r["count"] for r in cut.groupBy("segment").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 5000
    spans = cut.groupBy("segment").agg(F.min("no").alias("low"), F.max("no").alias("high")).orderBy("segment").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))


def test_finished_runs_are_compacted(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ended = [ledger.complete(ledger.start("d", "p"), dict.fromkeys(SIX, i)) for i in range(3)]
    failed, open_run = ledger.fail(ledger.start("d", "p"), ValueError("x")), ledger.start("d", "p")
    other = ledger.complete(ledger.start("d", "q"), dict.fromkeys(SIX, 9))
    before = sorted(map(str, ledger.runs().collect()))
    assert ledger.compact("d", "p") == 8 and ledger.compact("d", "p") == 0 and ledger.compact("d", "none") == 0
    assert sorted(map(str, ledger.runs().collect())) == before
    assert ledger.active("d", "p")["run_id"] == ended[-1]["run_id"] and ledger.active("d", "q")["run_id"] == other["run_id"]
    again = ledger.complete(open_run, dict.fromkeys(SIX, 5))
    assert ledger.active("d", "p")["run_id"] == again["run_id"] and ledger.run(failed["run_id"])["status"] == "FAILED"
    assert ledger.compact("d", "p") == 3
    plan = ledger.runs_of("d", "p")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner" in plan


def test_run_path_sorts_only_what_differs(spark):
    from crosstally.operators.compare import numbers_and_leftovers

    rows = spark.createDataFrame([("1", "a")], "migration_key string, v string")
    numbers, differing = (d._jdf.queryExecution().executedPlan().toString() for d in numbers_and_leftovers(rows, rows))
    assert "SortAggregate" not in numbers and "Sort" not in numbers.replace("SortMergeJoin", "")
    assert "Filter" in differing


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_decimal_texts_do_not_depend_on_the_mode(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = spark.sql("SELECT CAST(x AS DECIMAL(18,10)) AS d FROM VALUES ('0'), ('0.0000001'), ('-0.00000125'), ('12.5'), ('100') AS t(x)")
        assert [r.d for r in ct.normalize(rows).collect()] == ["0", "0.0000001", "-0.00000125", "12.5", "100"]
        strict = [r.d for r in ct.normalize(rows, strategy="TypeStrict").collect()]
        assert strict[:2] == ["java.math.BigDecimal:0.0000000000", "java.math.BigDecimal:0.0000001000"]
        keys = ct.keyed(rows.selectExpr("d AS MigrationKey", "1 AS v")).collect()
        assert [r[0] for r in keys][:3] == ["0.0000000000", "0.0000001000", "-0.0000012500"]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
