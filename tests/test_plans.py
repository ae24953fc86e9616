"""Declarative operators on small frames, and the registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtide.operators import feed, gates, reconcile, selection
from jobtide.operators.ranks import numbered
from jobtide.plans import dialect, inventory  # noqa: F401
from jobtide.streaming import jobs

import __spark_entry__ as entry

T0 = dt.datetime(2027, 1, 1)
COLUMNS = "posting_key string, identity string, source string, source_id string, source_mode string, company string, title string, category string, apply_url string, canonical_apply_url string, family_key string, season string, year int, target_match string, locations array<string>, posted_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, active boolean, removed_at timestamp_ntz"


def posting(key, identity="a", source="greenhouse:1", mode="direct", match="exact", posted=T0, active=True, title="Intern", removed=None, seen=T0):
    return (key, identity, source, key, mode, "Acme", title, "software", f"u{identity}", f"u{identity}", "fam", "summer", 2027, match, ["Rome"], posted, T0, seen, active, removed)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_copies_fold_into_one_application(spark):
    rows = frame(spark, posting("1"), posting("2", mode="registry", source="registry:x"), posting("3", identity="b", mode="verification-lead"))
    got = dialect.apply("fold_applications", spark, postings=rows).collect()
    assert [(r.identity, r.posting_key, r.variants) for r in got] == [("a", "1", 2)]
    families = dialect.apply("build_families", spark, fold_applications=dialect.apply("fold_applications", spark, postings=rows)).collect()
    assert [(f.opening_count, f.direct_openings, f.backstop_openings) for f in families] == [(1, 1, 0)]


def test_an_omission_is_pending_then_removed(spark):
    as_of = "timestamp '2027-01-02 00:00:00'"
    stored = frame(spark, posting("1"), posting("2", removed=dt.datetime(2027, 1, 1, 23, 50)), posting("3", removed=T0), posting("4"))
    targets = spark.createDataFrame([("greenhouse:1", 900)], "source string, interval_seconds int")
    got = dialect.apply("pending_removal", spark, as_of, stored=stored, incoming=frame(spark, posting("4")), fx_targets=targets).collect()
    assert {r.posting_key: r.active for r in got} == {"1": True, "2": True, "3": False}


AS_OF = "timestamp '2027-02-01 00:00:00'"


def now():
    return F.expr(AS_OF).cast("timestamp_ntz")


def dated(rows, precision, confidence, text="d", updated=None):
    return rows.withColumns({"posted_precision": F.lit(precision), "posted_confidence": F.lit(confidence), "description": F.lit(text), "updated_at": F.lit(updated).cast("timestamp_ntz")})


def test_a_sighting_cancels_removal_and_keeps_first_seen(spark):
    held = dated(frame(spark, posting("1", active=False, removed=T0), posting("2"), posting("3", match="unknown")), "day", "official", "old")
    snap = dated(frame(spark, posting("1", posted=None), posting("3", match="unknown", posted=dt.datetime(2027, 1, 3)), posting("4", posted=None)), "timestamp", "structured", "new")
    got = {r.posting_key: r for r in reconcile.upsert(held, snap, now()).collect()}
    assert (got["1"].active, got["1"].removed_at, got["1"].first_seen_at, got["1"].posted_at) == (True, None, T0, T0)
    # A date that is not listed again keeps its precision and confidence; a listed one brings its own.
    assert (got["1"].posted_precision, got["1"].posted_confidence, got["1"].description) == ("day", "official", "new")
    assert (got["3"].posted_precision, got["3"].posted_confidence, got["3"].description) == ("timestamp", "structured", "")
    assert got["2"].description == "old" and got["2"].last_seen_at == T0 and got["4"].first_seen_at == dt.datetime(2027, 2, 1) and got["4"].posted_precision == "timestamp"


def test_rows_of_old_disappearances_are_restored_within_hours(spark):
    seen = lambda hours: dt.datetime(2027, 2, 1) - dt.timedelta(hours=hours)
    rows = frame(spark, posting("1", active=False, seen=seen(2)), posting("2", active=False, seen=seen(7)), posting("3", active=False, seen=seen(2), removed=T0), posting("4", active=False, seen=seen(2), mode="registry"), posting("5", active=False, seen=seen(2), source="lever:2"))
    got = {r.posting_key: (r.active, r.removed_at) for r in reconcile.restore_removed(rows, spark.createDataFrame([("greenhouse:1",)], "source string"), now()).collect()}
    assert got == {"1": (True, dt.datetime(2027, 2, 1)), "2": (False, None), "3": (False, T0), "4": (False, None), "5": (False, None)}


def test_third_failure_in_a_row_quarantines_and_a_success_clears(spark):
    health = spark.createDataFrame([(s, True, 5, 1, T0, T0, "ok", "current", life, n) for s, life, n in (("a", "candidate", 2), ("b", "productive", 1), ("c", "quarantined", 4), ("d", "quarantined", 3))], "source string, complete boolean, rows_scanned int, target_rows int, last_attempt_at timestamp_ntz, last_success_at timestamp_ntz, status string, scope string, lifecycle string, consecutive_failures int")
    runs = spark.createDataFrame([("a", dt.datetime(2027, 1, 2), False, "broken", "x", 0, 0, "current"), ("b", dt.datetime(2027, 1, 2), False, "broken", "x", 0, 0, "current"), ("c", dt.datetime(2027, 1, 2), True, "ok", None, 9, 0, "historical"), ("e", dt.datetime(2027, 1, 2), False, "broken", "x", 0, 0, "current"), ("f", dt.datetime(2027, 1, 2), True, "ok", None, 9, 3, "historical")], "source string, finished_at timestamp_ntz, complete boolean, status string, error string, rows_scanned int, target_rows int, scope string")
    got = {r.source: (r.lifecycle, r.consecutive_failures, r.scope) for r in reconcile.merged_health(health, runs).collect()}
    assert got == {"a": ("quarantined", 3, "historical"), "b": ("productive", 2, "current"), "c": ("candidate", 0, "historical"), "d": ("quarantined", 3, "current"), "e": ("candidate", 1, "current"), "f": ("productive", 0, "current")}


def test_a_complete_board_closes_what_it_no_longer_lists(spark):
    rows = frame(spark, posting("1", mode="registry"), posting("2", identity="b", mode="registry"), posting("3", identity="c"), posting("4", identity="b", mode="registry", active=False))
    boards = spark.createDataFrame([("greenhouse:acme", True, "ok"), ("greenhouse:other", True, "ok"), ("lever:acme", True, "ok")], "source string, complete boolean, status string")
    snap = spark.createDataFrame([("greenhouse:acme", "a", "exact"), ("greenhouse:acme", "b", "unknown")], "source string, identity string, target_match string")
    assert [r.posting_key for r in reconcile.provider_stale(rows, boards, snap).collect()] == ["2"]
    assert reconcile.provider_stale(rows, boards.withColumn("complete", F.lit(False)), snap).count() == 0


def test_feed_filters_take_arguments(spark):
    columns = "family_key string, company string, title string, category string, season string, year int, target_match string, places array<string>, direct_openings int, backstop_openings int, latest_posted_at timestamp_ntz, first_detected_at timestamp_ntz, last_verified_at timestamp_ntz, posted_precision string"
    row = lambda k, company, places, **more: (k, company, "Software Intern", more.get("category", "software"), more.get("season", "summer"), more.get("year", 2027), more.get("match", "exact"), places, more.get("direct", 1), more.get("back", 0), more.get("posted", T0), T0, T0, "day")
    rows = spark.createDataFrame([row("1", "Acme", ["Austin, TX"]), row("2", "Acme 100%", ["Texarkana", "Remote"], season=None), row("3", "Other", ["TX"], direct=0, back=2, category="other"), row("4", "other", ["Rome"], year=2026, match="wrong_year", posted=None)], columns)
    keys = lambda df: sorted(r.family_key for r in df.collect())
    assert keys(feed.by_target(rows, "exact")) == ["1", "3"] and keys(feed.by_target(rows, "default")) == ["1", "2", "3"] and keys(feed.by_target(rows, "wrong_year")) == ["4"] and keys(feed.by_target(rows, "")) == ["1", "2", "3", "4"]
    assert keys(feed.by_location(rows, "tx")) == ["1", "3"] and keys(feed.by_location(rows, "tex")) == ["2"] and keys(feed.remote_only(rows)) == ["2"]
    assert keys(feed.by_search(rows, "acme 100%")) == ["2"] and keys(feed.by_search(rows, "a_me")) == [] and keys(feed.by_company(rows, "OTHER")) == ["3", "4"]
    assert keys(feed.by_trust(rows, "leads")) == ["3"] and keys(feed.by_track(rows)) == ["1", "2", "4"] and keys(feed.posted_within(rows, 40, AS_OF)) == ["1", "2", "3"]
    placed = {r.family_key: r.place for r in feed.ordered(rows, "company").collect()}
    assert placed == {"1": 1, "2": 2, "3": 3, "4": 4}
    page = feed.page_of(rows, feed.order_of("company"), 2, 3).collect()
    assert [(r.family_key, r.total) for r in page] == [("4", 4)]


def test_postings_without_places_stay_in_their_fold(spark):
    rows = frame(spark, posting("1"), posting("2", identity="b")).withColumn("locations", F.when(F.col("posting_key") == "2", F.array().cast("array<string>")).otherwise(F.col("locations")))
    got = {r.identity: (r.locations, r.variants) for r in dialect.apply("fold_applications", spark, postings=rows).collect()}
    assert got == {"a": ("Rome", 1), "b": ("", 1)}


def test_gates_name_the_rules_that_fail(spark):
    index = spark.createDataFrame([(f"k{i % 150}", "Acme", 1, T0, T0, "t", "Rome") for i in range(200)], "family_key string, company string, direct_openings int, first_detected_at timestamp_ntz, last_verified_at timestamp_ntz, title string, locations string")
    got = gates.snapshot_usable(index, index, now()).first()
    assert (got.passed, got.failed, got.distinct_keys) == (False, "old,keys", 150)
    assert gates.snapshot_sanity(index, index, now(), F.lit(200)).first().passed
    assert gates.snapshot_sanity(index.limit(90), index, now(), F.lit(200)).first().failed == "minimum,complete,collapse"
    assert gates.snapshot_sanity(index.limit(0), index.limit(0), now(), F.lit(1)).first().failed == "minimum,complete"


def test_places_over_all_rows_without_one_task(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k")).repartition(5)
    got = {r.id: r.place for r in numbered(rows, F.col("k").desc(), F.col("id")).collect()}
    want = sorted(range(1000), key=lambda i: (-(i * 7919 % 13), i))
    assert got == {i: n + 1 for n, i in enumerate(want)}
    assert sorted(r.id for r in selection.rotated(rows.select(F.col("id").cast("string").alias("id")), "id", 400, 2).collect()) != [] and selection.rotated(rows.select(F.col("id").cast("string").alias("id")), "id", 400, 2).count() == 400


def test_changed_tables_are_stored_anew(spark, tmp_path):
    import shutil

    import pyarrow.parquet as pq

    for name in ("lineitem", "orders", "part", "supplier", "nation", "region"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    before = dialect.frame(spark, str(tmp_path), "postings").count()
    orders = pq.read_table("/root/testdata/sf0.001/orders.parquet")
    pq.write_table(orders.slice(0, len(orders) // 2), f"{tmp_path}/orders.parquet")
    assert 0 < dialect.frame(spark, str(tmp_path), "postings").count() < before


def test_no_row_order_changes_a_fold(spark):
    rows = [posting(str(i), identity=str(i % 4), mode=("direct", "registry", "verification")[i % 3], title=f"Intern {i % 5}") for i in range(40)]
    a, b = (sorted(map(str, dialect.apply("fold_applications", spark, postings=frame(spark, *r).repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 7)))
    assert a == b


def test_every_query_has_a_name_and_sql_names_are_queries():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries)


@pytest.mark.parametrize("name", ["feed_page", "provider_health", "ingest_lever", "health_upsert", "gate_coverage", "fuse_openings", "verification_plan"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == sorted(str(list(r)) for r in want.select(*cols).fetchall())


def test_lifecycle_stream(spark, tmp_path):
    hour = lambda n: T0 + dt.timedelta(hours=n)
    listed = [(0, True, "ab"), (1, True, "a"), (2, False, ""), (3, True, ""), (4, True, "b")]
    rows = spark.createDataFrame([("s", hour(h), whole, k) for h, whole, keys in listed for k in [*keys, None]], "source string, finished_at timestamp, complete boolean, posting_key string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = jobs.drained(spark, jobs.posting_lifecycle(stream), "l", "append", f"file:{tmp_path}").collect()
    assert sorted((r["at"].hour, r.posting_key, r.change) for r in got) == [(0, "a", "seen"), (0, "b", "seen"), (1, "b", "pending"), (3, "a", "pending"), (3, "b", "removed"), (4, "a", "removed"), (4, "b", "seen")]


def test_judging_distinct_values_changes_no_row(spark):
    from jobtide.operators import postings as ops
    from jobtide.sources.fixtures import view

    rows = view(spark, "/root/testdata/sf0.001", "fx_postings").limit(500).select("source", "source_id", "source_mode", "company", "title", F.array("loc1", "loc2").alias("locations"), "apply_url", (F.col("source_mode") == "registry").alias("source_confirms"))
    empty = rows.limit(3).withColumns({k: F.lit(None).cast("string") for k in ("title", "company", "apply_url")})
    rows = spark.createDataFrame(rows.unionByName(empty).collect(), rows.schema)
    a, b = ops.normalize_postings(rows), ops.normalize_by_value(rows)
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_few_values_are_met_without_a_shuffle_of_the_rows(spark):
    from jobtide.operators import postings as ops

    rows = spark.range(50).selectExpr("'greenhouse:1' as source", "string(id) as source_id", "'direct' as source_mode", "'Acme' as company", "concat('Intern ', id % 3) as title", "array('Rome') as locations", "concat('https://acme.com/', id) as apply_url", "false as source_confirms")
    got = ops.normalize_by_value(rows)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 50 and {r.title for r in got.collect()} == {"Intern 0", "Intern 1", "Intern 2"}


def test_stored_families_carry_no_list_of_openings(spark):
    rows = frame(spark, posting("1"), posting("2", mode="registry", source="registry:x"), posting("3", identity="b", mode="verification", posted=None, title="An Intern"), posting("4", identity="c", mode="verification-lead"))
    whole = dialect.apply("build_families", spark, fold_applications=dialect.apply("fold_applications", spark, postings=rows)).drop("openings")
    brief = dialect.apply("families", spark, brief_applications=dialect.apply("brief_applications", spark, postings=rows))
    assert brief.columns == whole.columns and brief.collect() == whole.collect() and brief.count() == 1


def test_a_table_is_stored_once(spark):
    first, again = (dialect.frame(spark, "/root/testdata/sf0.001", "postings").inputFiles() for _ in range(2))
    assert sorted(first) == sorted(again)
