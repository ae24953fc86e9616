"""Due lists, stored pages, chunks, providers and dates on small rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from jobtide.functions import text as tx
from jobtide.operators import dates, feed, providers, ranks, schedule
from jobtide.plans import schedule as plans
from jobtide.sources import ingest, publish


def test_due_lists_respect_clocks_and_leases(spark):
    at = lambda h: dt.datetime(2026, 1, 2, h)
    rows = [("never", None, None, at(1), None), ("old", at(1), at(3), at(2), None), ("older start", at(1), at(2), at(9), None), ("leased", None, None, at(1), at(13)), ("lease over", at(2), None, at(1), at(11)), ("not yet", None, None, at(13), None)]
    frame = spark.createDataFrame([(*r, True, True, 1) for r in rows], "source string, last_complete_at timestamp_ntz, last_started_at timestamp_ntz, next_run_at timestamp_ntz, lease_expires_at timestamp_ntz, scheduled boolean, enabled boolean, priority int")
    got = schedule.due_sources(frame, F.lit("2026-01-02 12:00:00").cast("timestamp_ntz"), 10).collect()
    assert [r.source for r in got] == ["never", "older start", "old", "lease over"]


def test_links_never_checked_come_first(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [("a", at, True, "direct", "exact"), ("a", None, True, "direct", "exact"), ("b", None, True, "direct", "exact"), ("c", at - dt.timedelta(1), True, "direct", "exact"), ("d", None, False, "direct", "exact"), ("e", None, True, "registry", "exact"), ("f", None, True, "direct", "unknown")]
    frame = spark.createDataFrame(rows, "canonical_apply_url string, link_checked_at timestamp, active boolean, source_mode string, target_match string")
    assert [(r.canonical_apply_url, r.last_checked) for r in schedule.links_to_check(frame, 3).collect()] == [("b", None), ("c", at - dt.timedelta(1)), ("a", at)]


def test_a_page_reads_the_ranges_behind_its_key(spark, tmp_path):
    root = f"file:{tmp_path}/index"
    keys = [f"{i:05}" for i in range(1000)]
    frame = spark.createDataFrame([(k, f"c{k}") for k in keys], "family_key string, company string").repartition(5)
    assert feed.store_index(frame, root, 10)
    for last, size in (("", 30), ("00499", 30), ("00990", 30), ("zz", 30), ("00098", 250)):
        page = feed.stored_page_after(spark, root, last, size)
        assert [r.family_key for r in page.collect()] == [k for k in keys if k > last][:size]
        assert len(page.inputFiles()) <= 2 + size // 90 if last < "zz" else not page.inputFiles()
    assert publish.newest(spark, root).note["ranges"][0][1] == "00000"


def test_only_chosen_chunks_are_read(spark, tmp_path):
    row = '[{"i":"%s","c":"A","ti":"T","u":"https://a.io/%s","p":"2001-07-0%dT00:00:00Z"}]'
    for name in "abcde":
        (tmp_path / f"{name}.json").write_text(row % (name, name, 5 if name != "b" else 1))
    chunks = [{"file": "a.json", "posted_max": "2001-07-09T00:00:00Z"}, {"file": ""}, {"file": "b.json"}, {"posted_max": "1990-01-01T00:00:00Z"}, {"file": "c.json", "posted_max": "2001-07-05T00:00:00Z"}, {"file": "d.json", "posted_max": "2001-06-01T00:00:00Z"}, {"file": "e.json", "posted_max": "2001-07-09T00:00:00Z"}]
    manifest = spark.createDataFrame([(json.dumps({"slim_index_chunks": chunks}),)], "value string")
    cutoff = F.lit("2001-07-03 00:00:00").cast("timestamp")
    found = ingest.chunk_postings(spark, f"file:{tmp_path}", manifest, cutoff, 9)
    assert sorted(r.source_id for r in found.collect()) == ["a", "c"]
    assert sorted(f[-6:] for f in found.inputFiles()) == ["a.json", "b.json", "c.json"]
    assert [r.file for r in ingest.chosen_chunks(manifest, cutoff, 2).collect()] == ["a.json", "b.json"]
    assert ingest.chunk_postings(spark, f"file:{tmp_path}", spark.createDataFrame([("none",)], "value string"), cutoff, 9).count() == 0


def test_providers_are_rows(spark):
    urls = ["https://boards.greenhouse.io/a", "https://x.y.example.com/j", "https://notexample.com/", "https://career5.successfactors.eu/c", "https://mysuccessfactors.com/", "https://successfactors/", "nothing", None, "https://example.com:8080/"]
    known = providers.registry(spark).unionByName(spark.createDataFrame([("example.com", "own", 99), ("y.example.com", "late", 100)], "fragment string, kind string, place int"))
    got = providers.with_kinds(spark.createDataFrame([(u,) for u in urls], "url string"), "url", known)
    assert {r.url: r.provider for r in got.collect()} == dict(zip(urls, ["greenhouse", "own", None, "successfactors", "successfactors", None, None, None, "own"]))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_dates_of_any_spelling(spark):
    texts = ["4 July 2001 10:05", "Wed, 04 Jul 2001 22:30:00 +0200", "July 4, 2001", "2001-07-04", "1000000000", "Friday the 99th", "", None, "10:30"]
    got = dates.with_dates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string"), "raw", dt.datetime(2001, 8, 1))
    utc = lambda *a: dt.datetime(*a)
    found = {r.id: r.at for r in got.selectExpr("id", "cast(read_at as timestamp_ntz) as at").collect()}
    assert [found[i] for i in range(len(texts))] == [utc(2001, 7, 4, 10, 5), utc(2001, 7, 4, 20, 30), utc(2001, 7, 4), utc(2001, 7, 4), utc(2001, 9, 9, 1, 46, 40), None, None, None, utc(2001, 8, 1, 10, 30)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")


def test_source_labels(spark):
    said = {"greenhouse:acme": "Greenhouse", "Registry: big_tech-list2go": "Registry · Big Tech List2Go", "verification-lead:usa": "Verification lead · USA", "external-index:": "External index", "odd:x": "odd:x", "": "unknown", "registry:" + "word " * 60: "Registry · " + ("Word " * 60)[:168].rstrip() + "…"}
    got = spark.createDataFrame([(k,) for k in said], "s string").select("s", tx.source_label(F.col("s")).alias("l")).collect()
    for r in got[:-1]:
        assert r.l == said[r.s]
    assert len(got[-1].l) <= 180 and got[-1].l.endswith("…")


def test_places_within_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1), (None, 2), (None, 1)], "k string, i int").repartition(3)
    got = ranks.numbered_within(rows, ["k"], F.col("i").desc()).collect()
    assert sorted((r.k or "", r.i, r.place) for r in got) == sorted([("hot", i, 500 - i) for i in range(500)] + [("b", 1, 1), ("", 2, 1), ("", 1, 2)])


def test_stable_shard_takes_eight_bytes(spark):
    assert spark.createDataFrame([("greenhouse:1",)], "s string").select(tx.stable_shard(F.col("s"), 7)).first()[0] == 0


def test_promotion_keeps_every_opening_of_a_family(spark):
    kind = "family_key string, openings array<struct<identity string, source_mode string, verification_mode string>>"
    rows = [("f", [("a", "verification", None), ("b", "registry", None), ("c", "direct", None), ("d", "direct", "employer-page")]), ("g", []), ("h", None)]
    got = {r.family_key: (list(map(tuple, r.openings)), r.direct_openings, r.backstop_openings) for r in schedule.promoted(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"f": ([("a", "direct", "employer-page"), ("b", "registry", None), ("c", "direct", None), ("d", "direct", "employer-page")], 3, 1), "g": ([], 0, 0), "h": ([], 0, 0)}


def test_the_query_of_promotions_gives_a_row_for_each_opening(spark):
    postings = [("1", "a", "f", "verification"), ("2", "a", "f", "registry"), ("3", "b", "f", "direct"), ("4", "c", "g", "registry")]
    frames = {"postings": spark.createDataFrame(postings, "posting_key string, identity string, family_key string, source_mode string")}
    frames["fold_applications"] = frames["postings"].filter("posting_key <> '2'")
    got = {(r.part, r.posting_key): tuple(r)[4:] for r in plans.RUNS["promote_verified_openings"](frames.get).collect()}
    feed = {"1": ("direct", "employer-page", 2, 0, 1), "3": ("direct", None, 2, 0, 1), "4": ("registry", None, 0, 1, 0)}
    whole = {"1": ("direct", "employer-page", 2, 1, 1), "2": ("registry", None, 2, 1, 1), "3": ("direct", None, 2, 1, 1), "4": ("registry", None, 0, 1, 0)}
    assert got == {("feed", k): v for k, v in feed.items()} | {("inventory", k): v for k, v in whole.items()}
