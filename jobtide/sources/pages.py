"""Sources that are text rather than JSON boards: tables, feeds, scripts in pages, URL corpora."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CLOSED_MARK, COMPANY_HEADERS, DATA_ATTRIBUTES, DIRECTORY_HOSTS, EMBEDDED_ATTRIBUTES, FEED_URL_KEYS, GENERIC_ANCHORS, INTERN, JOB_CONTAINERS, LOCATION_HEADERS, MICRODATA, PATH_DENY, SAME_COMPANY, STRUCTURED_KEYS, SUBDOMAIN_DENY, TARGETS, TIME_HEADERS, TITLE_HEADERS
from ..functions import rules
from ..functions import text as tx
from ..functions import urls as ux

# Paths of single jobs by provider.
JOB_PATHS = {
    "jobvite": r"jobs\.jobvite\.com/[^/]+/job/(\w+)", "icims": r"\.icims\.com/jobs/(\d+)", "oracle-cloud": r"oraclecloud\.com/.*/job/(\d+)", "rippling": r"ats\.rippling\.com/(?:[a-z]{2}-[A-Z]{2}/)?[^/]+/jobs/([\w-]+)",
    "successfactors": r"successfactors\.(?:com|eu)/.*[?&]career_job_req_id=(\w+)", "jazzhr": r"\.applytojob\.com/apply/([A-Za-z0-9]{4,})",
    "teamtailor": r"\.teamtailor\.com/jobs/(\d+)", "recruitee": r"\.recruitee\.com/o/([\w-]+)", "workable": r"apply\.workable\.com/[^/]+/j/(\w+)",
}
CAREER_PATHS = ("/careers", "/jobs", "/careers/jobs", "/join-us")


MARKDOWN_LINK, HREF = r"\]\((https?://[^)\s]+)\)", r"""(?i)href\s*=\s*["'](https?://[^"']+)["']"""


def cells_of(line: Column) -> Column:
    return F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|")


def html_rows(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))


def html_cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))


def links_of(line: Column) -> Column:
    """Links of a line, Markdown's before HTML's."""
    return F.array_distinct(F.concat(F.regexp_extract_all(line, F.lit(MARKDOWN_LINK), F.lit(1)), F.regexp_extract_all(line, F.lit(HREF), F.lit(1))))


def above(doc: str = "doc", line: str = "line"):
    return W.partitionBy(doc).orderBy(line).rowsBetween(W.unboundedPreceding, W.currentRow)


def registry_rows(docs: DataFrame) -> DataFrame:
    """(doc, body) of lists in Markdown or HTML to (doc, line, company, title, location, apply_url) of rows that say "intern".

    A blank, dash or arrow company repeats the one above; the link with the best score is taken; of rows with one
    company, title and link, whatever their case, the first stays.
    """
    pipes = docs.select("doc", F.posexplode(F.split("body", "\r?\n")).alias("at", "text")).filter(F.ltrim("text").startswith("|")).withColumn("cells", cells_of(F.col("text")))
    tables = docs.select("doc", F.posexplode(html_rows(F.col("body"))).alias("at", "text")).withColumn("cells", html_cells(F.col("text")))
    both = pipes.withColumn("line", F.col("at").cast("long")).unionByName(tables.withColumn("line", F.col("at") + F.lit(1 << 40)))
    rows = both.filter(F.lower("text").contains("intern") & (F.size("cells") >= 2)).withColumn("cells", F.transform("cells", tx.clean_text))
    named = F.element_at("cells", 1)
    rows = rows.filter(~named.rlike("^[-:]+$") | named.isin(*SAME_COMPANY)).withColumn("part", F.when(F.col("line") < F.lit(1 << 40), 0).otherwise(1))
    shown = F.when(~named.isin(*SAME_COMPANY), named)
    filled = F.last(F.when(~F.lower(shown).isin("company", "employer"), shown), ignorenulls=True).over(W.partitionBy("doc", "part").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.select("doc", "line", F.coalesce(shown, filled).alias("company"), F.try_element_at("cells", F.lit(2)).alias("title"), F.coalesce(F.try_element_at("cells", F.lit(3)), F.lit("")).alias("location"), ux.choose_apply_url(links_of(F.col("text"))).alias("apply_url"))
    rows = rows.filter("apply_url is not null and company is not null and title <> ''")
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("doc", F.lower("company"), F.lower("title"), "apply_url").orderBy("line"))).filter("nth = 1").drop("nth")


def header_of(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(tx.clean_text(cell)), "[^a-z0-9]+", " "))


def place_of(headers: Column, names: tuple[str, ...]) -> Column:
    """Where the first header of these names stands, from 1; null if there is none."""
    found = F.filter(F.transform(headers, lambda h, i: F.when(h.isin(*names), i + 1)), lambda p: p.isNotNull())
    return F.try_element_at(found, F.lit(1))


def sensor_tables(docs: DataFrame) -> DataFrame:
    """(doc, body) of trackers' tables to (doc, line, company, title, location, timing, apply_url) of open rows.

    Columns go by their headers' names, in Markdown and HTML tables. A Markdown heading of two marks names the company
    of tables that have no such column, and ends the table before it. A blank, dash or arrow company repeats the one
    above; rows that are marked closed or have no link drop out.
    """
    lines = docs.select("doc", F.posexplode(F.split("body", "\r?\n")).alias("line", "text"))
    cells = F.when(F.col("text").contains("|"), cells_of(F.col("text")))
    lines = lines.select("doc", "line", "text", F.when(F.trim("text").rlike("^## "), tx.clean_text(F.substring(F.trim("text"), 4, 10**6))).alias("heading"), F.when(~F.col("text").rlike(r"^[\s|:-]+$"), cells).alias("cells"))
    lines = lines.withColumn("section", F.last("heading", ignorenulls=True).over(above())).filter("heading is not null or cells is not null").withColumn("heads", F.transform("cells", header_of))
    is_head = place_of(F.col("heads"), TITLE_HEADERS).isNotNull() & (place_of(F.col("heads"), COMPANY_HEADERS).isNotNull() | F.col("section").isNotNull())
    lines = lines.withColumn("is_head", F.coalesce(is_head, F.lit(False)))
    begun = F.when(F.col("heading").isNotNull(), F.array().cast("array<string>")).when(F.col("is_head"), F.col("heads"))
    marked = lines.withColumn("headers", F.last(begun, ignorenulls=True).over(above())).filter(F.col("heading").isNull() & ~F.col("is_head") & (F.size("headers") > 0))
    # A table in HTML: its first row heads it; a row one cell short lacks the company.
    tables = docs.select("doc", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<table[^>]*>.*?</table>"), F.lit(0))).alias("nth", "table"))
    tables = tables.select("doc", "nth", html_rows(F.col("table")).alias("rows")).withColumn("headers", F.transform(html_cells(F.try_element_at("rows", F.lit(1))), header_of))
    rows = tables.select("doc", "nth", "headers", F.posexplode("rows").alias("at", "text")).filter("at > 0").withColumn("cells", html_cells(F.col("text")))
    short = (F.size("cells") == F.size("headers") - 1) & (place_of(F.col("headers"), COMPANY_HEADERS) == 1)
    rows = rows.withColumn("cells", F.when(short, F.concat(F.array(F.lit("")), "cells")).otherwise(F.col("cells"))).filter(place_of(F.col("headers"), COMPANY_HEADERS).isNotNull())
    rows = rows.select("doc", (F.lit(1 << 40) + F.col("nth").cast("long") * (1 << 20) + F.col("at")).alias("line"), "text", "cells", "headers", F.lit(None).cast("string").alias("section"), F.concat_ws(":", F.lit("t"), "nth").alias("table"))
    every = marked.select("doc", F.col("line").cast("long").alias("line"), "text", "cells", "headers", "section", F.lit("m").alias("table")).unionByName(rows)
    at = lambda names: F.coalesce(tx.clean_text(F.try_element_at("cells", place_of(F.col("headers"), names).cast("int"))), F.lit(""))
    every = every.select("doc", "line", "text", "section", "table", place_of(F.col("headers"), COMPANY_HEADERS).alias("own"), at(COMPANY_HEADERS).alias("named"), at(TITLE_HEADERS).alias("title"), at(LOCATION_HEADERS).alias("location"), at(TIME_HEADERS).alias("timing"))
    named = F.when(F.col("own").isNotNull() & ~F.col("named").isin(*SAME_COMPANY), F.col("named"))
    before = F.last(named, ignorenulls=True).over(W.partitionBy("doc", "table").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    company = F.coalesce(named, F.when(F.col("own").isNull(), F.col("section")), before, "section")
    every = every.withColumn("company", company).withColumn("apply_url", ux.choose_apply_url(links_of(F.col("text"))))
    return every.filter(F.col("company").isNotNull() & (F.col("title") != "") & F.col("apply_url").isNotNull() & ~F.col("text").contains(CLOSED_MARK)).select("doc", "line", "company", "title", "location", "timing", "apply_url")


def detail_page(html: Column, url: Column) -> tuple[Column, Column, Column]:
    """(title, date, id): h1, else og:title; the itemprop date, else a time's; the id in the link, else the link."""
    none = lambda x: F.nullif(x, F.lit(""))
    head = tx.clean_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    shown = F.coalesce(none(head), none(F.regexp_extract(html, r"""(?is)<meta[^>]*og:title[^>]*content=["']([^"']*)""", 1)))
    date = F.coalesce(none(F.regexp_extract(html, r"""(?is)itemprop=["']datePosted["'][^>]*content=["']([^"']*)""", 1)), none(F.regexp_extract(html, r"""(?is)<time[^>]*datetime=["']([^"']*)""", 1)))
    return shown, date, F.coalesce(none(F.regexp_extract(url, r"(?i)(?:/job/|career_job_req_id=)([A-Za-z0-9_-]+)", 1)), url)


JOB_RESULT = r"(?i)(?:/about/careers/applications/)?jobs/results/(\d+)(?:-([^?#\"'<>\\\\]+))?"


def search_results(pages: DataFrame) -> DataFrame:
    """(page_id, html) of result pages to (page_id, job_id, title): the anchor's text, else the link's slug; jobs named outside anchors too."""
    body = F.replace(F.replace("html", F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&"))
    own = pages.select("page_id", body.alias("body"))
    anchors = own.select("page_id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("at", "a"))
    href = F.regexp_extract("a", r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)""", 1)
    text = tx.clean_text(F.regexp_replace(F.regexp_replace("a", "(?is)^<a[^>]*>|</a>$", ""), "<[^>]+>", " "))
    slug = lambda link: F.coalesce(F.nullif(tx.humanize_slug(F.regexp_extract(link, JOB_RESULT, 2)), F.lit("")), F.lit("Google internship"))
    named = anchors.select("page_id", "at", F.regexp_extract(href, JOB_RESULT, 1).alias("job_id"), F.when(~F.lower(text).isin(*GENERIC_ANCHORS, ""), text).alias("label"), slug(href).alias("slug"))
    raw = own.select("page_id", F.posexplode(F.regexp_extract_all("body", F.lit(JOB_RESULT), F.lit(0))).alias("at", "link")).select("page_id", F.lit(1 << 30).alias("at"), F.regexp_extract("link", JOB_RESULT, 1).alias("job_id"), F.lit(None).cast("string").alias("label"), slug(F.col("link")).alias("slug"))
    both = named.unionByName(raw).filter("job_id <> ''")
    # The last anchor with a text names a job; without one, the first slug does.
    return both.groupBy("page_id", "job_id").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("at"))).alias("label"), F.min_by("slug", F.struct("at", "slug")).alias("slug")).select("page_id", "job_id", F.coalesce("label", "slug").alias("title"))


ATTRIBUTE = r"""(?is)\b{0}\s*=\s*["']([^"']*)["']"""


def resolved(base: Column, raw: Column) -> Column:
    """The link that `raw` means on the page `base`, without its fragment; null unless it is http."""
    raw = F.replace(F.trim(F.regexp_replace(F.regexp_replace(raw, "(?i)%3A", ":"), "(?i)%2F", "/")), F.lit("\\/"), F.lit("/"))
    raw = F.regexp_replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), "#.*$", "")
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^(\w+://[^/]+)$", "$1/")
    folder = F.regexp_replace(folder, r"[^/]*$", "")
    full = (
        F.when(raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(ux.scheme(base), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(ux.scheme(base), F.lit("://"), ux.host(base), raw))
        .when(raw == "", F.regexp_replace(base, "#.*$", ""))
        .when(raw.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), raw))
        .otherwise(F.concat(folder, raw))
    )
    return ux.normalize_http_url(full)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to edges (page_id, link, label): one row a link, with its first label that is not empty.

    Nine kinds, in this order: anchors; `link` elements that are feeds or careers; addresses in the text; and, where they
    lead to a provider, a career page or a job: JSON-LD, meta refresh, microdata, embedding elements, data attributes,
    addresses in inline scripts.
    """
    own = pages.select("page_id", "url", "html")
    attribute = lambda tag, name: F.regexp_extract(tag, ATTRIBUTE.format(name), 1)
    every = lambda pattern, group=0: F.regexp_extract_all("html", F.lit(pattern), F.lit(group))
    plain = F.regexp_replace("html", "(?is)<script[^>]*>.*?</script>", " ")
    entry = lambda kind, raw, label: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), label.alias("label"))
    text = lambda a: tx.clean_text(F.regexp_replace(F.regexp_replace(a, "(?is)^<a[^>]*>|</a>$", ""), "<[^>]+>", " "))
    anchors = F.transform(F.filter(F.regexp_extract_all(plain, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0)), lambda a: a.rlike(r"(?is)^<a\b[^>]*\bhref\s*=")), lambda a: entry(0, attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), "href"), text(a)))
    rels = F.transform(every(r"(?is)<link\b[^>]*\bhref\s*=[^>]*>"), lambda t: entry(1, attribute(t, "href"), F.trim(F.regexp_replace(F.concat_ws(" ", attribute(t, "rel"), attribute(t, "type"), attribute(t, "title")), r"\s+", " "))))
    inline = F.transform(every(r"""(?i)https?(?::|%3A)(?:\\?/|%2F){2}[^\s"'<>\\]+"""), lambda u: entry(2, F.rtrim(F.regexp_replace(u, r"[),.;]+$", "")), F.lit("")))
    scripts = F.array_join(every(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1), " ")
    job = F.lower(scripts).contains('"jobposting"')
    keys = "|".join(STRUCTURED_KEYS)
    said = F.transform(F.regexp_extract_all(scripts, F.lit(rf'"(?:{keys})"\s*:\s*"([^"]+)"'), F.lit(1)), lambda u: F.when(job | F.lower(u).contains("job") | F.lower(u).contains("career"), entry(3, u, F.lit("json-ld:JobPosting"))))
    moved = F.transform(every(r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>"), lambda t: entry(4, F.regexp_extract(t, r"""(?is)url=\s*["']?([^"'>\s]+)""", 1), F.lit("meta:refresh")))
    micro = F.transform(every(rf"(?is)<[^>]*\bitemprop\s*=\s*[\"'](?:{'|'.join(MICRODATA)})[\"'][^>]*>"), lambda t: entry(5, F.coalesce(*(F.nullif(attribute(t, a), F.lit("")) for a in ("href", "content", "value")), F.lit("")), F.concat(F.lit("microdata:"), F.lower(attribute(t, "itemprop")))))

    def of_tag(tag: str, name: str) -> Column:
        return F.transform(every(rf"(?is)<{tag}\b[^>]*>"), lambda t: entry(6, F.regexp_extract(t, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(f"{tag}:{name}")))

    def of_data(name: str) -> Column:
        return F.transform(every(rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), lambda u: entry(7, u, F.lit(name)))

    embedded = F.flatten(F.array(*(of_tag(*x) for x in EMBEDDED_ATTRIBUTES)))
    data = F.flatten(F.array(*map(of_data, DATA_ATTRIBUTES)))
    code = F.array_join(F.filter(every(r"(?is)<script\b[^>]*>.*?</script>"), lambda t: ~t.rlike(r"(?is)^<script\b[^>]*(?:\bsrc\s*=|ld\+json)")), " ")
    code = F.regexp_replace(code, "(?is)<script[^>]*>|</script>", " ")
    coded = F.transform(F.regexp_extract_all(code, F.lit(r"""(?i)(?:https?:)?(?:\\/\\/|//)[^\s"'<>]+|/[A-Za-z0-9._~!$&()*+,;=:@%/-]*(?:job|career|intern|position|vacanc)[A-Za-z0-9._~!$&()*+,;=:@%/?#-]*"""), F.lit(0)), lambda u: entry(8, F.regexp_replace(u, r"[),;\]}]+$", ""), F.lit("script:inline-config")))
    found = own.select("page_id", "url", F.posexplode(F.concat(anchors, rels, inline, said, moved, micro, embedded, data, coded)).alias("at", "e")).filter("e is not null and e.raw is not null")
    found = found.select("page_id", "at", "e.kind", "e.label", "e.raw", resolved(F.col("url"), F.col("e.raw")).alias("link")).filter("link is not null and (raw <> '' or kind = 0)")
    hint = F.when(F.col("kind") == 3, "json-ld jobposting").when(F.col("kind") == 4, "meta refresh careers").when(F.col("kind") == 5, "schema jobposting").when(F.col("kind") == 8, "inline script config").when(F.col("kind") == 6, F.replace("label", F.lit(":"), F.lit(" "))).otherwise(F.col("label"))
    useful = ux.provider_kind(F.col("link")).isNotNull() | ux.is_career_url(F.col("link"), hint)
    feed = F.lower("label").rlike("alternate|rss|atom") | ux.is_career_url(F.col("link"), F.col("label"))
    kept = F.when(F.col("kind").isin(0, 2), True).when(F.col("kind") == 1, feed).when(F.col("kind").isin(3, 5, 8), useful | ux.is_detail_url(F.col("link"))).otherwise(useful)
    return found.filter(kept).groupBy("page_id", "link").agg(F.coalesce(F.min_by("label", F.when(F.col("label") != "", F.col("at"))), F.lit("")).alias("label"))


def directory_employers(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) of a start-up directory to (profile_url, name, slug): anchors to `/companies/{slug}`, the batch cut off."""
    anchors = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a>"), F.lit(0))).alias("a"))
    link = resolved(F.col("url"), F.regexp_extract("a", ATTRIBUTE.format("href"), 1))
    text = tx.clean_text(F.regexp_replace(F.regexp_replace("a", "(?is)^<a[^>]*>|</a>$", ""), "<[^>]+>", " "))
    name = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\b[WSFP]\d{4}\b.*$", "")), " (?:Active|Inactive).*$", ""))
    parts = ux.segments(F.col("profile_url"))
    rows = anchors.select(link.alias("profile_url"), name.alias("name")).filter(ux.host(F.col("profile_url")).isin(*DIRECTORY_HOSTS) & (F.size(parts) == 2) & (F.try_element_at(parts, F.lit(1)) == "companies") & (F.col("name") != "") & ~F.lower("name").isin("companies", "startup directory"))
    return rows.groupBy("profile_url").agg(F.min("name").alias("name")).withColumn("slug", F.element_at(ux.segments(F.col("profile_url")), 2))


def _walk(body: str, most: int = 20_000) -> list[tuple[str, str, bool]]:
    """(key, text, in a job) of the strings under link keys of a JSON text, up to `most` nodes deep and wide."""
    try:
        stack = [(json.loads(body), False)]
    except ValueError:
        return []
    plain, out, seen = lambda key: "".join(x for x in key.casefold() if x.isalnum()), [], 0
    while stack and seen < most:
        (value, job), seen = stack.pop(), seen + 1
        if isinstance(value, dict):
            keys = {plain(k) for k in value}
            job = job or bool(keys & {"title", "jobtitle", "positiontitle", "name"} and keys & {"id", "jobid", "requisitionid", "reqid", "url", "applyurl"})
            for key, child in value.items():
                if isinstance(child, str) and plain(key) in FEED_URL_KEYS:
                    out.append((key, child.strip(), job or plain(key).startswith("next")))
                elif isinstance(child, (dict, list)):
                    stack.append((child, job or plain(key) in JOB_CONTAINERS))
        elif isinstance(value, list):
            stack.extend((child, job) for child in value if isinstance(child, (dict, list)))
    return out


def json_links(docs: DataFrame) -> DataFrame:
    """(url, body) to distinct (url, link): strings under link keys that stand in a job or lead to one."""

    def run(batches):
        for batch in batches:
            rows = [(url, *found) for url, body in zip(batch.url, batch.body) for found in _walk(body or "")]
            yield pd.DataFrame(rows, columns=["url", "key", "raw", "job"])

    found = docs.select("url", "body").mapInPandas(run, "url string, key string, raw string, job boolean").withColumn("link", resolved(F.col("url"), F.col("raw"))).filter("link is not null")
    good = F.col("job") | ux.provider_kind(F.col("link")).isNotNull() | ux.is_career_url(F.col("link"), F.col("key")) | ux.is_detail_url(F.col("link"))
    return found.filter(good).select("url", "link").distinct()


def url_corpus(lines: DataFrame) -> DataFrame:
    """(value) crawl-index lines to (url, timestamp) of those with status 200."""
    row = F.from_json("value", "url string, status string, timestamp string").alias("d")
    return lines.select(row).filter("d.status = '200' and d.url is not null").select("d.url", "d.timestamp")


def job_links(edges: DataFrame) -> DataFrame:
    """(link) to (provider, job_id, link): one row a job; the smallest link stays."""
    hits = F.coalesce(*(F.when(F.col("link").rlike(p), F.struct(F.lit(k).alias("provider"), F.regexp_extract("link", p, 1).alias("job_id"))) for k, p in JOB_PATHS.items()))
    return edges.withColumn("hit", hits).filter("hit is not null").groupBy("hit.provider", "hit.job_id").agg(F.min("link").alias("link"))


def tenants(links: DataFrame) -> DataFrame:
    """(url) to (kind, tenant, urls): a provider census without names that are no tenant; counts combine before the shuffle."""
    kind, key = F.col("t.kind"), F.lower("t.key")
    denied = F.when(kind.isin("recruitee", "teamtailor", "icims"), F.split_part(key, F.lit("."), F.lit(1)).isin(*SUBDOMAIN_DENY)).otherwise(key.isin(*PATH_DENY))
    return links.select(ux.provider_tenant(F.col("url")).alias("t")).filter(F.col("t").isNotNull() & ~denied).groupBy(kind.alias("kind"), F.col("t.key").alias("tenant")).agg(F.count("*").alias("urls"))


def career_seeds(hosts: DataFrame) -> DataFrame:
    """(host) to (host, url): likely career pages; none on a provider's shared host."""
    own = hosts.filter(ux.provider_kind(F.concat(F.lit("https://"), "host", F.lit("/"))).isNull())
    return own.select("host", F.explode(F.array(*(F.concat(F.lit("https://"), "host", F.lit(p)) for p in CAREER_PATHS))).alias("url")).distinct()


def enrich(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Dates, types and descriptions of undated technical internships from the JSON-LD of their pages.

    postings: (title, apply_url, category, target_match, posted_raw, employment_type, description); details: (page_url,
    at, url, posted_raw, employment_type, description), the jobs of a page in order. Of a page's jobs, that with the
    posting's link counts, else the first.
    """
    cut = lambda x: F.regexp_replace(x, "/+$", "")
    job = F.struct("posted_raw", "employment_type", "description")
    own = F.when(cut(F.col("url")) == cut(F.col("page_url")), 0).otherwise(1)
    best = details.groupBy(cut(F.col("page_url")).alias("key")).agg(F.min_by(job, F.struct(own, "at")).alias("job"))
    met = postings.join(best, cut(F.col("apply_url")) == F.col("key"), "left")
    due = F.col("posted_raw").isNull() & (F.col("target_match") != "not_internship") & (F.col("category") != "other") & F.col("key").isNotNull()
    none = lambda x: F.nullif(F.trim(x), F.lit(""))
    fill = lambda x: F.when(due, F.coalesce(none(F.col(f"job.{x}")), F.col(x))).otherwise(F.col(x))
    return met.withColumns({x: fill(x) for x in ("posted_raw", "employment_type", "description")}).drop("key", "job")


def recovered_matches(recovered: DataFrame, leads: DataFrame, same: float = 0.55, other: float = 0.8) -> DataFrame:
    """Best lead of each recovered posting: same URL needs `same`, else `other` in its company and host.

    Equal links meet directly. Of a company and host, only titles that share a token are compared: without one
    their similarity is none. Equal titles of a company and host are one lead, that of the smallest key.
    """
    part = lambda df, side: df.select(F.col("key").alias(side), F.col("company").alias(f"{side}_company"), F.col("title").alias(f"{side}_title"), F.col("url").alias(f"{side}_url"), ux.host(F.col("url")).alias(f"{side}_host"))
    r, lead = part(recovered, "r"), part(leads, "l")
    place = lambda s: [F.col(f"{s}_company"), F.col(f"{s}_host")]
    near = r.join(lead, (F.col("r_company") == F.col("l_company")) & (F.col("r_url") == F.col("l_url")))
    near = near.select(F.col("r").alias("key"), F.col("l").alias("lead"), F.lit(True).alias("same_url"), tx.title_similarity(F.col("r_title"), F.col("l_title")).alias("similarity")).filter(F.col("similarity") >= same)
    # Titles of a place, once each, by their tokens.
    titles = lambda df, s: df.select(*place(s), f"{s}_title").distinct().withColumn("token", F.explode(F.array_distinct(tx.title_tokens(F.col(f"{s}_title")))))
    pairs = titles(r, "r").join(titles(lead, "l").withColumnRenamed("token", "l_token"), (F.col("r_company") == F.col("l_company")) & (F.col("r_host") == F.col("l_host")) & (F.col("token") == F.col("l_token"))).select(*place("r"), "r_title", "l_title").distinct()
    pairs = pairs.withColumn("similarity", tx.title_similarity(F.col("r_title"), F.col("l_title"))).filter(F.col("similarity") >= other)
    first = lead.groupBy(*place("l"), "l_title").agg(F.min("l").alias("lead")).select(F.col("l_company").alias("c"), F.col("l_host").alias("h"), F.col("l_title").alias("t"), "lead")
    best = pairs.join(first, (F.col("r_company") == F.col("c")) & (F.col("r_host") == F.col("h")) & (F.col("l_title") == F.col("t"))).groupBy(*place("r"), "r_title").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "lead")).alias("b"))
    far = r.select(F.col("r").alias("key"), F.col("r_company").alias("c"), F.col("r_host").alias("h"), F.col("r_title").alias("t")).join(best, (F.col("c") == F.col("r_company")) & (F.col("h") == F.col("r_host")) & (F.col("t") == F.col("r_title")))
    far = far.select("key", F.col("b.lead").alias("lead"), F.lit(False).alias("same_url"), (-F.col("b.less")).alias("similarity"))
    both = near.unionByName(far).groupBy("key").agg(F.min(F.struct((~F.col("same_url")).alias("apart"), (-F.col("similarity")).alias("less"), "lead")).alias("b"))
    return both.select("key", F.col("b.lead").alias("lead"), (~F.col("b.apart")).alias("same_url"), (-F.col("b.less")).alias("similarity"))


LEGACY_IDS = ("posting_key", "family_key", "company", "title", "apply_url", "canonical_apply_url", "source", "source_id")


def import_legacy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, rejects) of old rows: ids that must be there, times that stand in for missing ones, clamped numbers.

    A reject says what it lacks; a description stays only with a target.
    """
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    missing = F.array_compact(F.array(*(F.when(blank(x), x) for x in LEGACY_IDS)))
    first = F.coalesce("first_seen_at", "last_seen_at", "posted_at", "updated_at")
    why = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(first.isNull(), "missing first_seen_at/last_seen_at")
    marked = rows.withColumns({"reject": why, "first_seen_at": first, "last_seen_at": F.coalesce("last_seen_at", first)})
    year, rank = F.col("year").try_cast("int"), F.greatest(F.lit(0), F.coalesce(F.col("rank").try_cast("int"), F.lit(0)))
    good = marked.filter("reject is null").drop("reject").withColumns({"year": F.when(year.between(-32768, 32767), year), "rank": rank, "target_match": F.coalesce(F.nullif(F.trim("target_match"), F.lit("")), F.lit("unknown"))})
    good = good.withColumn("description", F.when(F.col("target_match").isin(*TARGETS), F.trim("description")).otherwise(""))
    return good, marked.filter("reject is not null").select("posting_key", "reject")


def sanitized_snapshot(families: DataFrame, schema: int) -> DataFrame:
    """Families of an old snapshot (schema below 4) that were verified then, and the modes their openings may keep.

    Families have verified, quality, direct_openings and openings (structs with source and source_mode); a newer
    snapshot stays as it is.
    """
    if schema >= 4:
        return families
    trusted = F.coalesce("verified", F.lit(False)) | (F.coalesce("direct_openings", F.lit(0)) > 0) | F.lower(F.coalesce("quality", F.lit(""))).isin("employer", "verified", "direct")
    kept = ("registry", "lead", "external-index", "verification-lead", "market-sensor")

    def safe(o: Column) -> Column:
        mode, source = F.lower(F.coalesce(o["source_mode"], F.lit(""))), F.lower(F.coalesce(o["source"], F.lit("")))
        sensor = source.startswith("registry:") | source.startswith("sensor:")
        return o.withField("source_mode", F.when(mode.isin(*kept), o["source_mode"]).when(sensor, "market-sensor").when(mode == "", "direct").otherwise(o["source_mode"]))

    return families.filter(trusted).withColumns({"verified": F.lit(True), "quality": F.lit("employer"), "openings": F.transform("openings", safe)})
