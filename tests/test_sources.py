"""Text sources on small documents."""

import datetime as dt
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import functions as F

from jobtide.constants import CAREER_MARKERS, DATA_ATTRIBUTES, DETAIL_MARKERS, EMBEDDED_ATTRIBUTES, JOB_ID, PROVIDERS, STRUCTURED_KEYS
from jobtide.sources import ingest, pages, publish


def test_lists_repeat_the_company_above_and_take_the_best_link(spark):
    body = "| Company | Internship | Link |\n|---|---|---|\n| **Acme** | Software Intern | Rome | [a](https://github.com/x) [b](https://jobs.lever.co/acme/1) |\n| ↳ | Data intern | | [c](https://acme.com/jobs/2) |\n| ↳ | DATA INTERN | | [c](https://acme.com/jobs/2) |\n| Beta | Analyst | | [d](https://beta.io/apply) |\n| Gamma | Intern, no link | |"
    body += '\n<table><tr><td>Delta</td><td>Web Intern</td><td>Oslo</td><td><a href="https://delta.io/jobs/9">x</a></td></tr><tr><td>-</td><td>App Intern</td><td></td><td><a href="https://delta.io/jobs/10">x</a></td></tr></table>'
    got = pages.registry_rows(spark.createDataFrame([("d", body), ("e", None)], "doc string, body string")).orderBy("line").collect()
    assert [(r.company, r.title, r.location, r.apply_url) for r in got] == [("Acme", "Software Intern", "Rome", "https://jobs.lever.co/acme/1"), ("Acme", "Data intern", "", "https://acme.com/jobs/2"), ("Delta", "Web Intern", "Oslo", "https://delta.io/jobs/9"), ("Delta", "App Intern", "", "https://delta.io/jobs/10")]


def test_trackers_tables_go_by_their_headers(spark):
    body = "| a | b |\n| Position | Employer | Office | Link | Age |\n|---|---|---|---|---|\n| Dev | Acme | Rome | [x](https://a.com/jobs/1) | 2d |\n| Ops | ↳ | | [x](https://a.com/jobs/2) | |\n| Shut | Acme | | 🔒 [x](https://a.com/jobs/3) | |\n| Bare | Acme | | | |\n\n## Beta\n\n| Role | Link |\n|---|---|\n| QA | [x](https://b.com/jobs/1) |\n### notes\n| PM | [x](https://b.com/jobs/2) |\n## Gamma\n| stray | [x](https://c.com/jobs/1) |\n"
    body += '<table><tr><th>Company</th><th>Title</th><th>Date</th></tr><tr><td>Delta</td><td><a href="https://d.com/jobs/1">SRE</a></td><td>May</td></tr><tr><td><a href="https://d.com/jobs/2">Net</a></td><td>June</td></tr></table><table><tr><td>no</td></tr><tr><td><a href="https://e.com/jobs/1">head</a></td></tr></table>'
    got = pages.sensor_tables(spark.createDataFrame([("d", body), ("e", "")], "doc string, body string")).orderBy("line").collect()
    assert [(r.company, r.title, r.location, r.timing, r.apply_url[-6:]) for r in got] == [("Acme", "Dev", "Rome", "2d", "jobs/1"), ("Acme", "Ops", "", "", "jobs/2"), ("Beta", "QA", "", "", "jobs/1"), ("Beta", "PM", "", "", "jobs/2"), ("Delta", "SRE", "", "May", "jobs/1"), ("Delta", "Net", "", "June", "jobs/2")]


def test_sensors_json_as_list_map_or_wrapped_list(spark):
    row = '{"employer":"Acme","position":"Intern","job_url":"https://a.com/%s","terms":["%s"],"is_open":%s}'
    raw = [("l", "json", "summer-2027", f"[{row % (1, 'Fall 2027', 'true')},{row % (2, '', 'false')}]"), ("m", "json-map", "mixed", '{"x":' + row % (3, "Summer 2027", "true") + ',"y":' + row % (4, "Fall 2027", "true") + "}"), ("w", "json", "mixed", '{"items":[{"company":"B","title":"2027 Intern","url":"https://b.com/5","is_visible":false},{"company":"B","title":"2027 Intern","url":"https://b.com/6","id":"six"},{"company":"B","title":"2027 Fall Intern","url":"https://b.com/7"}]}'), ("n", "json", "mixed", "none"), ("z", "json", "mixed", None)]
    got = ingest.sensor_rows(spark.createDataFrame(raw, "source string, kind string, cycle string, body string")).collect()
    assert sorted((r.source, r.company, r.title, r.source_id) for r in got) == [("l", "Acme", "Intern", "https://a.com/1"), ("m", "Acme", "Intern", "https://a.com/3"), ("w", "B", "2027 Intern", "six")]


def test_board_payloads(spark):
    raw = spark.createDataFrame([
        ("greenhouse:a", "A", '{"jobs":[{"id":1,"title":"T","absolute_url":"u","location":{"name":"Rome"}},{"id":1,"title":"again","absolute_url":"u"},{"id":2,"title":" ","absolute_url":"u"}]}'), ("greenhouse:b", "B", "not json"), ("greenhouse:c", "C", None),
    ], "source string, company string, body string")
    got = ingest.ingest("ingest_greenhouse", raw).collect()
    assert [(r.source_id, r.title, r.locations) for r in got] == [("1", "T", ["Rome"])]


def test_stale_rows_and_landings(spark):
    raw = spark.createDataFrame([("sensor:o", "x", '[{"i":"1","c":"A","ti":"T","u":"https://jobs.lever.co/a"},{"i":"2","c":"A","ti":"T","u":"https://jobs.lever.co/a/b","r":1},{"i":"3","c":"A","ti":"T","u":"https://jobs.lever.co/a/c"}]')], "source string, company string, body string")
    kept, leads = ingest.split_landings(ingest.ingest("ingest_openroles", raw))
    assert ([r.source_id for r in kept.collect()], [r.source_id for r in leads.collect()]) == (["3"], ["1"])


def test_completeness(spark):
    got = ingest.completeness(spark.createDataFrame([("a", 100, 150), ("a", 50, 150), ("b", 100, 150)], "source string, rows int, total int")).collect()
    assert {r.source: r.status for r in got} == {"a": "ok", "b": "truncated"}


class Found(HTMLParser):
    """The nine kinds of links of a page, by a parser that reads it tag by tag."""

    def __init__(self, base):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.anchor, self.script = base, [], None, None

    def add(self, kind, raw, label, hint=None):
        link = urljoin(self.base, raw.strip().replace("\\/", "/"))
        parts = urlsplit(link)
        if parts.scheme not in ("http", "https") or not parts.netloc or not (raw or kind == 0):
            return
        link = urlunsplit((parts.scheme, parts.netloc, parts.path or "/", parts.query, ""))
        text = f"{parts.path} {parts.query} {hint if hint is not None else label}".lower()
        career = any(m in text for m in CAREER_MARKERS)
        provider = any(parts.netloc == f or parts.netloc.endswith("." + f) for f in PROVIDERS)
        detail = any(m in parts.path for m in DETAIL_MARKERS) and (re.search(JOB_ID, link) or len([x for x in parts.path.split("/") if x]) >= 3)
        if kind in (0, 2) or kind == 1 and (career or re.search("alternate|rss|atom", label.lower())) or kind > 2 and (career or provider or kind in (3, 5, 8) and detail):
            self.found.append((kind, link, label))

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "a" and "href" in at:
            self.anchor = [at["href"], ""]
        if tag == "link" and "href" in at:
            self.add(1, at["href"], " ".join(x for x in (at.get("rel", ""), at.get("type", ""), at.get("title", "")) if x))
        if tag == "meta" and at.get("http-equiv", "").lower() == "refresh" and "url=" in at.get("content", "").lower():
            self.add(4, at["content"][at["content"].lower().find("url=") + 4 :].strip(" \"'"), "meta:refresh", "meta refresh careers")
        if at.get("itemprop", "").lower() in ("url", "applicationurl", "applyurl"):
            self.add(5, at.get("href") or at.get("content") or at.get("value") or "", f"microdata:{at['itemprop'].lower()}", "schema jobposting")
        for name, where in EMBEDDED_ATTRIBUTES:
            if tag == name and at.get(where):
                self.add(6, at[where], f"{tag}:{where}", f"{tag} {where}")
        for where in DATA_ATTRIBUTES:
            if at.get(where):
                self.add(7, at[where], where)
        if tag == "script":
            self.script = [at, ""]

    def handle_data(self, data):
        if self.anchor:
            self.anchor[1] += data
        if self.script:
            self.script[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.anchor:
            self.add(0, self.anchor[0], " ".join(self.anchor[1].split()))
            self.anchor = None
        if tag == "script" and self.script:
            at, body = self.script
            self.script = None
            if "ld+json" in at.get("type", ""):
                for key in STRUCTURED_KEYS:
                    for u in re.findall(f'"{key}"\\s*:\\s*"([^"]+)"', body):
                        if "jobposting" in body.lower() or "job" in u.lower() or "career" in u.lower():
                            self.add(3, u, "json-ld:JobPosting", "json-ld jobposting")
            elif "src" not in at:
                for u in re.findall(r"""(?i)(?:https?:)?(?:\\/\\/|//)[^\s"'<>]+|/[A-Za-z0-9._~!$&()*+,;=:@%/-]*(?:job|career|intern|position|vacanc)[A-Za-z0-9._~!$&()*+,;=:@%/?#-]*""", body):
                    self.add(8, re.sub(r"[),;\]}]+$", "", u), "script:inline-config", "inline script config")


def every_link(base, html):
    reader = Found(base)
    reader.feed(html)
    for u in re.findall(r"""(?i)https?(?::|%3A)(?:\\?/|%2F){2}[^\s"'<>\\]+""", html):
        reader.add(2, re.sub(r"[),.;]+$", "", u.replace("&amp;", "&")), "")
    out = {}
    for kind, link, label in sorted(reader.found, key=lambda f: f[0]):
        out[link] = out.get(link) or label
    return out


def test_page_links_of_nine_kinds(spark):
    html = """<html><head><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="stylesheet" href="/a.css"><link rel="x" href="/careers.css"><meta http-equiv="refresh" content="0; url=/careers/now">
      <script type="application/ld+json">{"@type":"JobPosting","url":"https://a.com/role/9","sameAs":"/x/jobs"}</script><script src="/careers/app.js"></script><script>var u="\\/\\/boards.greenhouse.io\\/acme", v="/open-positions/list", w="/other/thing";</script></head>
      <body><a href="/jobs/1"><img/></a><a class="x" href="/jobs/1">Role &amp; more</a><a href="https://b.c/d#top">B</a><a href="?p=2">next</a><a href="sub/page">rel</a><a href="mailto:x@y">m</a><a name="n">none</a><iframe src="https://jobs.lever.co/acme"></iframe><iframe src="/ad"></iframe><form action="/apply/job"></form><embed src="/careers.swf"><object data="/jobs.pdf"></object>
      <div data-url="/careers/d" data-src="/img.png"></div><span itemprop="applyUrl" content="/apply/77"></span><p>see https://plain.example/text, and HTTPS://PLAIN.example/two.</p></body></html>"""
    got = {r.link: r.label for r in pages.page_links(spark.createDataFrame([(1, "https://a.com/x/y?q=1", html), (2, "https://a.com", None)], "page_id long, url string, html string")).collect()}
    want = every_link("https://a.com/x/y?q=1", html)
    assert {k.lower(): v for k, v in got.items()} == {k.lower(): v for k, v in want.items()} and len({v for v in want.values() if v}) >= 12
    assert got["https://a.com/jobs/1"] == "Role & more" and got["https://boards.greenhouse.io/acme"] == "script:inline-config" and "https://a.com/ad" not in got


def test_page_links_of_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {}
    for r in pages.page_links(rows).collect():
        got.setdefault(r.page_id, set()).add(r.link)
    for r in rows.collect():
        assert got.get(r.page_id, set()) == set(every_link(r.url, r.html or "")), r.page_id


def test_details_pages(spark):
    rows = [(1, "https://a.com/job/R-7?x", '<h1 class="t">Data <b>Engineer</b></h1><time datetime="2027-01-02">'), (2, "https://a.com/p?career_job_req_id=55", '<meta property="og:title" content="Chef"><span itemprop="datePosted" content="2027-03-04">'), (3, "https://a.com/z", None)]
    title, date, own = pages.detail_page(F.col("html"), F.col("url"))
    got = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", title.alias("t"), date.alias("d"), own.alias("i")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, "Data Engineer", "2027-01-02", "R-7"), (2, "Chef", "2027-03-04", "55"), (3, None, None, "https://a.com/z")]


def test_career_seeds_guess_nothing_on_shared_hosts(spark):
    got = pages.career_seeds(spark.createDataFrame([("acme.com",), ("jobs.lever.co",), ("acme.com",)], "host string")).collect()
    assert {r.host for r in got} == {"acme.com"} and len(got) == len(pages.CAREER_PATHS)


def test_feeds_keep_links_of_jobs(spark):
    body = '{"Next_Page":"?page=2","items":[{"title":"T","id":1,"meta":{"url":"/a"}},{"url":"/shop"},{"url":"/careers/x"}],"openings":[{"deep":[{"apply_url":"/b"}]}]}'
    got = pages.json_links(spark.createDataFrame([("https://a.com/api", body), ("https://a.com/bad", "{"), ("https://a.com/none", None)], "url string, body string")).collect()
    assert sorted(r.link for r in got) == ["https://a.com/a", "https://a.com/api?page=2", "https://a.com/b", "https://a.com/careers/x"]


def test_legacy_rows_and_snapshots(spark):
    columns = ", ".join(f"{x} string" for x in pages.LEGACY_IDS) + ", target_match string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, posted_at timestamp_ntz, updated_at timestamp_ntz, year string, rank string, description string"
    at = dt.datetime(2027, 1, 1)
    row = lambda key, **more: (key, "f", more.get("company", "Acme"), "T", more.get("url", "u"), "u", "s", "i", more.get("match"), None, more.get("seen"), more.get("posted"), None, more.get("year", "2027"), more.get("rank", "-3"), " text ")
    good, bad = pages.import_legacy(spark.createDataFrame([row("1", seen=at, match="exact"), row("2", posted=at, year="99999", rank="x"), row("3", company=" ", url=None, seen=at), row("4")], columns))
    assert sorted((r.posting_key, r.first_seen_at, r.last_seen_at, r.year, r.rank, r.description, r.target_match) for r in good.collect()) == [("1", at, at, 2027, 0, "text", "exact"), ("2", at, at, None, 0, "", "unknown")]
    assert sorted(map(tuple, bad.collect())) == [("3", "missing company, apply_url"), ("4", "missing first_seen_at/last_seen_at")]
    old = spark.createDataFrame([("a", True, None, 0, [("greenhouse:x", ""), ("registry:y", ""), ("z", "registry")]), ("b", False, "Direct", None, []), ("c", False, "lead", 0, [])], "family_key string, verified boolean, quality string, direct_openings int, openings array<struct<source string, source_mode string>>")
    got = {r.family_key: [o.source_mode for o in r.openings] for r in pages.sanitized_snapshot(old, 3).collect()}
    assert got == {"a": ["direct", "market-sensor", "registry"], "b": []} and pages.sanitized_snapshot(old, 4).count() == 3


def test_recovered_postings_meet_leads_by_link_or_shared_words(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "key string, company string, title string, url string")
    recovered = rows(("r1", "Acme", "Data Engineer Paris", "https://a.com/1"), ("r2", "Acme", "Night Nurse", "https://a.com/2"), ("r3", "Beta", "Data Engineer", "https://b.com/1"))
    leads = rows(("l1", "Acme", "Data Engineer", "https://a.com/1"), ("l2", "Acme", "Data Engineer Paris", "https://a.com/9"), ("l3", "Acme", "Night Porter Shift", "https://a.com/8"), ("l4", "Beta", "Data Engineer", "https://c.com/1"))
    assert [(r.key, r.lead, r.same_url) for r in pages.recovered_matches(recovered, leads).collect()] == [("r1", "l1", True)]


def test_versions(spark, tmp_path):
    root, there = f"file:{tmp_path}/t", F.count("*") > 0
    assert publish.publish(spark.range(5), root, there)
    assert not publish.publish(spark.range(0), root, there) and not publish.publish(spark.range(9).filter("id < 0"), root, F.max("id") > 0)
    assert publish.current(spark, root).count() == 5
    base = publish.newest(spark, root)
    assert publish.publish(spark.range(6), root, there, base=base)
    # Another writer that began from the same version loses, and leaves nothing.
    assert not publish.publish(spark.range(7), root, there, base=base)
    assert publish.current(spark, root).count() == 6
    for n in (7, 8, 9):
        assert publish.publish(spark.range(n), root, there)
    assert publish.current(spark, root).count() == 9
    assert len(list((tmp_path / "t/manifests").glob("0*"))) == 3 and len(list((tmp_path / "t/data").glob("*"))) == 3


def test_result_pages_hold_jobs_whose_ids_begin_alike(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    parts = spark.range(999_980, 1_000_060).selectExpr("id as p_partkey", "'hot bolt' as p_name", "'SMALL' as p_type", "cast(id % 50 as int) as p_size")
    parts.toPandas().to_parquet(tmp_path / "part.parquet")
    got = entry.queries()["ingest_search_results_html"](spark, str(tmp_path)).collect()
    base = duckdb.connect()
    base.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    wanted = base.execute(entry.oracle_sql()["ingest_search_results_html"]).fetchall()
    assert len(got) == 80 and sorted(map(tuple, got)) == sorted(wanted)
