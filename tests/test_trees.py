"""XML, JSON-LD and titles of pages on small documents."""

import json

import pytest

from jobtide.sources import trees

FEEDS = {
    "https://acme.example/jobs.xml": """
    <jobs>
      <job id="7"><job-title>Software Engineering Intern</job-title><job-id>123</job-id>
        <job-url>/careers/positions/123</job-url><apply-url>https://jobs.lever.co/acme/123</apply-url>
        <description><![CDATA[Apply at https://boards.greenhouse.io/acme/jobs/9. See https://acme.example/about too.]]></description></job>
      <job><url>/x</url></job>
    </jobs>""",
    "https://acme.example/careers/feed": """<?xml version="1.0"?>
    <rss><channel><link>https://acme.example/home</link><item>
      <title>Machine Learning Intern</title><guid>ml-intern-42</guid><link>https://acme.example/openings/ml-intern-42</link>
    </item></channel></rss>""",
    "https://acme.example/careers/feed?page=1": """
    <feed xmlns="http://www.w3.org/2005/Atom" xmlns:own="urn:own">
      <entry><title>Research Intern</title><id>r-9</id><link own:application-url="/careers/jobs/r-9" /></entry>
      <entry><title>Second</title><link rel="alternate" href="https://acme.example/second?a=1&amp;b=2" /></entry>
      <link rel="next" href="?page=2" />
    </feed>""",
    "https://acme.example/rdf": """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">
      <item rdf:about="https://acme.example/a"><title>One</title><link>https://acme.example/a</link></item></rdf:RDF>""",
    "https://acme.example/catalog.xml": "<catalog><item><name>Office chair</name><link>https://shop.example/products/chair</link></item><item><link>https://jobs.lever.co/acme/5</link></item></catalog>",
    "https://acme.example/torn.xml": "<jobs><job><url>https://acme.example/jobs/1</url></jobs>",
    "https://acme.example/text": "no xml",
    "https://acme.example/none": None,
    "https://acme.example/empty": "",
}


def test_links_of_xml_feeds(spark):
    got = trees.feed_links(spark.createDataFrame(list(FEEDS.items()), "url string, body string")).collect()
    assert sorted((r.url.removeprefix("https://acme.example/"), r.link, r.label, r.title, r.job) for r in got) == [
        ("careers/feed", "https://acme.example/home", "link", None, False),
        ("careers/feed", "https://acme.example/openings/ml-intern-42", "link", "Machine Learning Intern", True),
        ("careers/feed?page=1", "https://acme.example/careers/feed?page=2", "next", None, False),
        ("careers/feed?page=1", "https://acme.example/careers/jobs/r-9", "link", "Research Intern", True),
        ("careers/feed?page=1", "https://acme.example/second?a=1&b=2", "link", "Second", True),
        ("catalog.xml", "https://jobs.lever.co/acme/5", "link", None, False),
        ("jobs.xml", "https://acme.example/careers/positions/123", "job-url", "Software Engineering Intern", True),
        ("jobs.xml", "https://acme.example/x", "url", None, True),
        ("jobs.xml", "https://boards.greenhouse.io/acme/jobs/9", "description", "Software Engineering Intern", True),
        ("jobs.xml", "https://jobs.lever.co/acme/123", "apply-url", "Software Engineering Intern", True),
        ("rdf", "https://acme.example/a", "link", "One", True),
    ]


def test_records_in_records(spark):
    """A position within a job: the inner title names its link, and every record that holds a link counts."""
    body = "<list><item><title>Outer</title><id>1</id><position><title>Inner</title><url>/p/1</url></position></item></list>"
    got = trees.feed_links(spark.createDataFrame([("https://a.io/f", body), ("https://a.io/f", body)], "url string, body string")).collect()
    assert [(r.link, r.title, r.job) for r in got] == [("https://a.io/p/1", "Inner", True)]


def test_sitemaps(spark):
    docs = [
        ("index", '<sm:sitemapindex xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:sitemap><sm:loc> a </sm:loc><sm:lastmod>2026-01-02</sm:lastmod></sm:sitemap><sm:sitemap><sm:loc>b</sm:loc></sm:sitemap></sm:sitemapindex>'),
        ("a", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="urn:i"><url><loc>u1</loc></url><url id="2"><loc>u2</loc><lastmod>2026-01-01</lastmod><i:image><i:loc>pic</i:loc></i:image></url><url><loc>u3</loc><lastmod>2026-02-01</lastmod></url><url><loc>u1</loc></url><url><lastmod>2026-05-05</lastmod></url></urlset>'),
        ("b", "<feed><entry><link href='e1'/><updated>2026-01-01T00:00:00Z</updated></entry></feed>"),
        ("c", "<x><y><loc>deep</loc></y></x>"),
        ("torn", "<urlset><url><loc>z</loc></urlset>"),
        ("none", None),
    ]
    frame = spark.createDataFrame(docs, "url string, body string")
    got = sorted((r.url, r.is_index, r.place, r["loc"], r.lastmod) for r in trees.sitemap_urls(frame).collect())
    assert got == [
        ("a", False, 1, "u3", "2026-02-01"), ("a", False, 2, "u2", "2026-01-01"), ("a", False, 3, "u1", None), ("b", False, 1, "e1", "2026-01-01T00:00:00Z"), ("c", False, 1, "deep", None), ("index", True, 1, "a", "2026-01-02"), ("index", True, 2, "b", None),
    ]
    assert sorted((r["loc"], r.listed_by) for r in trees.sitemap_pages(frame).collect()) == [("deep", None), ("e1", "index"), ("u1", "index"), ("u2", "index"), ("u3", "index")]


def script(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def job(title, **more):
    return {"@type": "JobPosting", "title": title, "url": f"https://a.io/{title}"} | more


def test_jsonld_of_any_depth(spark):
    pages = {
        "deep": script([[job("a")], {"@graph": [{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": job("b")}, [job("c")]]}, {"@type": "Thing"}]}]) + "<p>" + script(job("d")),
        "kinds": script({"@type": ["Thing", "JobPosting"], "title": " e ", "sameAs": "https://a.io/same", "identifier": {"name": "n-1"}, "hiringOrganization": "Acme"}),
        "fields": script(
            job("f", identifier={"value": 17, "name": "x"}, hiringOrganization={"name": "Beta"}, datePosted="2026-01-01", employmentType=["INTERN", "FULL_TIME"], description="about",
                jobLocation=[{"address": {"addressLocality": "Rome", "addressRegion": "", "addressCountry": "IT"}}, {"addressLocality": "Oslo"}, "Paris", {"address": "street"}])
        ),
        "place": script(job("g", identifier="g-1", jobLocation={"address": {"addressLocality": "Bern", "addressCountry": {"@type": "Country", "name": "CH"}}})) + script(job("h", jobLocation=[], applicantLocationRequirements={"name": "x", "addressRegion": "EU"})),
        "dropped": script({"@type": "JobPosting", "title": "no link"}) + script({"@type": "JobPosting", "url": "u", "title": " "}) + script("not json") + script("") + script({"@type": "Thing", "other": job("x")}),
        "none": None,
    }
    got = trees.jsonld_postings(spark.createDataFrame(list(pages.items()), "url string, html string")).orderBy("page_url", "at").collect()
    rows = [(r.page_url, r.title, r.apply_url, r.source_id, r.company, r.locations, r.posted_raw, r.employment_type, r.description) for r in got]
    plain = lambda page, title, id_=None, locations=(): (page, title, f"https://a.io/{title}", id_ or f"https://a.io/{title}", None, list(locations), None, None, "")
    assert rows == [
        *(plain("deep", t) for t in "abcd"),
        ("fields", "f", "https://a.io/f", "17", "Beta", ["Rome, IT", "Oslo"], "2026-01-01", "INTERN, FULL_TIME", "about"),
        ("kinds", "e", "https://a.io/same", "n-1", "Acme", [], None, None, ""),
        plain("place", "g", "g-1", ["Bern, CH"]), plain("place", "h", None, ["EU"]),
    ]


@pytest.mark.parametrize(("html", "found"), [
    ("<h1>Data <b>Science</b>\n Intern</h1>", ["Data Science Intern"]),
    ('<div class="x job-title-main">One Intern</div><span data-testid="job-title">Two <br>Lines</span><p data-automation-id="jobPostingHeader">Three</p>', ["One Intern", "Two Lines", "Three"]),
    ('<meta property="og:title" content="Og | "><meta name="title" content="Named"><title>Page &amp; more</title>', ["Og", "Named", "Page & more"]),
    ('<script type="application/json">{"props":[{"title":"Real Job","applyUrl":"x"},{"name":"Other"}]}</script>', ["Real Job", "Other"]),
    ('<script id="__NEXT_DATA__">{"jobTitle": "Next Role"}</script>', ["Next Role", "Next Role"]),
    ('<script>var x = {"position_title": "Caf\\u00e9 Intern"}</script>', ["Café Intern"]),
    ("<h1>Open <div>never closed", ["Open never closed"]),
    ("<script type='application/json'>{torn</script>", []),
])
def test_titles_of_a_page(html, found):
    assert [text for _, kind, text in trees.titles(html) if kind != "text"] == found


def test_pages_are_recovered_by_their_leads(spark):
    page = "<html><head><title>%s</title></head><body><h1>%s</h1><p>%s</p></body></html>"
    state = '<script type="application/json">{"job":{"title":"Platform Engineer Intern","jobId":1},"brand":{"name":"Acme Platform Engineer Hub"}}</script>'
    rows = [
        (1, "https://a.com/1", page % ("Acme", "Data Engineer", "An internship")), (2, "https://a.com/2", page % ("Acme", "Chef", "intern")), (3, "https://a.com/3", page % ("Jobs", "Lab Intern", "in Summer, 2027")),
        (4, "https://a.com/4", page % ("x", "Data Engineer", "This position is closed, intern")), (5, "https://a.com/5", page % ("x", "Careers", "Role: Night-Nurse! intern")), (6, "https://a.com/6", None),
        (7, "https://a.com/7", page % ("Acme careers", "Welcome all", "intern " + state)), (8, "https://a.com/8", page % ("x", "Lab Intern", "2026")), (9, "https://a.com/9", page % ("x", "Data Engineer", "no word of it")),
        (10, "https://a.com/10", page % ("Long title of an Intern", "Intern II", "Summer 2027")),
    ]
    leads = [("https://A.com/1/?utm_source=x", "Senior Data Engineer"), ("https://a.com/1", "Pilot Trainer"), ("https://a.com/2", "Pilot"), ("https://a.com/4", "Data Engineer"), ("https://a.com/5", "Night nurse"), ("https://a.com/7", "Platform Engineer"), ("https://a.com/9", "Data Engineer")]
    got = trees.recovered_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(leads, "url string, title string")).collect()
    assert sorted((r.page_id, r.title, r.lead_title, r.found, r.similarity) for r in got) == [
        (1, "Senior Data Engineer", "Senior Data Engineer", "Data Engineer", 1.0),
        (3, "Lab Intern", None, "Lab Intern", 1.0),
        (5, "Night nurse", "Night nurse", "x", 0.0),
        (7, "Platform Engineer", "Platform Engineer", "Platform Engineer Intern", 1.0),
        (10, "Intern II", None, "Intern II", 1.0),
    ]
