"""Column functions on values that matter."""

import pytest
from pyspark.sql import functions as F

from jobtide.functions import rules, text, urls
from jobtide.operators import postings as ops


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("raw", "want"), [
    ("HTTPS://Jobs.Example.com/a/?utm_source=x&b=1&Ref=q#f", "https://jobs.example.com/a?b=1"), ("https://a.com", "https://a.com/"), ("https://a.com/?b=&c=%7E+x", "https://a.com/?b=&c=~+x"),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, urls.canonical_url) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("https://x.com/role?gh_jid=77", "greenhouse:77"), ("https://boards.greenhouse.io/a/jobs/12", "greenhouse:12"), ("https://jobs.lever.co/a/01234567-89AB-cdef-0123-456789abcdef/apply", "lever:01234567-89ab-cdef-0123-456789abcdef"),
    ("https://a.wd1.myworkdayjobs.com/x/job/NYC/Role_JR12-1", "workday:a.wd1.myworkdayjobs.com:jr12-1"), ("https://a.com/role/apply", "https://a.com/role"), ("junk", "s:1"),
])
def test_identity(spark, raw, want):
    assert one(spark, raw, lambda c: urls.application_identity(c, F.lit("s"), F.lit("1"))) == want


@pytest.mark.parametrize(("raw", "want"), [("<b>A</b> &amp; B<br/>C", "A & B | C"), ("[Acme](https://x.y)", "Acme"), ("🔥 Role 🇺🇸 ", "Role"), (None, ""), ("plain name", "plain name")])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


@pytest.mark.parametrize(("raw", "want"), [("Google LLC", "Google"), ("D. E. Shaw", "D. E. Shaw"), ("", "Unknown company"), ("Acme, Inc.", "Acme, Inc.")])
def test_company(spark, raw, want):
    assert one(spark, raw, text.canonical_company) == want


@pytest.mark.parametrize(("raw", "want"), [
    (["Austin, TX", "austin, tx", "—", "2026-01-02"], ["Austin, TX"]), (["(Multiple US)"], ["United States"]), (["NYC / Remote-Friendly"], ["NYC", "Remote"]), (["3 locations **Austin, TXBoston, MA"], ["Austin, TX", "Boston, MA"]), (["Paris", "paris", "Rome"], ["Paris", "Rome"]), ([], []),
])
def test_locations(spark, raw, want):
    assert one(spark, raw, text.normalize_locations, "array<string>") == want


def test_title(spark):
    assert one(spark, "Software Engineer Intern II (Summer 2027)", text.normalize_title) == "software engineer intern"
    assert one(spark, "Data Analyst - Austin, TX", text.normalize_title) == "data analyst"


CASES = [
    ("Software Intern - Summer 2027", "direct", False, "exact", 2027), ("Intern - Summer 2026", "direct", False, "wrong_year", 2026), ("Intern - Fall 2027", "direct", False, "wrong_season", 2027), ("Intern 2027", "direct", False, "year_confirmed", 2027),
    ("Intern - Summer", "registry", True, "source_confirmed", 2027), ("Intern 2026 / 2027", "direct", False, "unknown", 2027), ("Senior Accountant 2027", "direct", False, "not_internship", 2027), ("Intern", "direct", False, "unknown", None),
]


def test_target_match(spark):
    rows = spark.createDataFrame([(i, t, m, c, "Acme", ["Rome"]) for i, (t, m, c, _, _) in enumerate(CASES)], "i int, title string, source_mode string, source_confirms boolean, company string, locations array<string>")
    got = {r.i: (r.target_match, r.year) for r in ops.classify_postings(rows).collect()}
    assert got == {i: (want, year) for i, (_, _, _, want, year) in enumerate(CASES)}


def test_description_counts_only_for_direct_modes(spark):
    rows = spark.createDataFrame([("Engineer", "direct", "A summer 2027 internship", "A", ["x"]), ("Engineer", "registry", "A summer 2027 internship", "A", ["x"])], "title string, source_mode string, description string, company string, locations array<string>")
    assert [r.target_match for r in ops.classify_postings(rows).collect()] == ["exact", "not_internship"]


def test_sensor_time(spark):
    as_of = F.expr("timestamp '2027-01-10 12:00:00'")
    for raw, precision, shown in (("3h", "relative", "2027-01-10 09:00:00"), ("2 days ago", "day", "2027-01-08 12:00:00"), ("yesterday", "day", "2027-01-09 12:00:00"), ("1700000000", "timestamp", "2023-11-14 22:13:20"), ("n/a", "unknown", None)):
        r = one(spark, raw, lambda c: rules.parse_sensor_time(c, as_of))
        assert (r.precision, str(r.ts) if r.ts else None) == (precision, shown)


def test_verdict(spark):
    got = spark.range(1).select(rules.page_verdict(F.lit(0), F.lit(2), F.lit(0), F.lit(0), F.lit(0)).alias("v")).first().v
    assert (got.status, got.note) == ("stale", "2 stale/closed pages")
