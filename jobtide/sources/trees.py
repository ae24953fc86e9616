"""Sources whose records hang in trees of any depth: XML, JSON-LD and the titles of a page.

A parser reads each text once and gives a row an element, object or title; what the rows mean is
decided by Spark's expressions, groupings and joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import (
    JOB_SIGNAL_KEYS,
    PAGE_INTERN,
    SITEMAP_ENTRIES,
    SITEMAP_PLACES,
    SITEMAP_TIMES,
    SUMMER_2027,
    TITLE_ATTRIBUTES,
    TITLE_CLASSES,
    TITLE_KEYS,
    TITLE_METAS,
    XML_ADDRESSES,
    XML_FEEDS,
    XML_IDS,
    XML_JOBS,
    XML_RECORDS,
    XML_TITLES,
    XML_URLS,
)
from ..functions import rules
from ..functions import text as tx
from ..functions import urls as ux
from .pages import resolved


#: Rows that a task gathers before it hands them on.
ROWS = 10_000


def rows_of(frame: DataFrame, key: str, text: str, read: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """(key, doc, *schema): the rows that `read` gives of each text; doc tells texts of one key apart. Null gives none."""
    names = [f.split()[0] for f in schema.split(", ")]
    kind = dict(frame.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for batch in batches:
            for of, doc, body in zip(batch["key"], batch["doc"], batch["body"], strict=True):
                for row in read(body):
                    found.append((of, doc, *row))
                    if len(found) == ROWS:
                        yield pd.DataFrame(found, columns=[key, "doc", *names])
                        found = []
        yield pd.DataFrame(found, columns=[key, "doc", *names])

    texts = frame.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("doc"), F.col(text).alias("body")).filter("body is not null")
    return texts.mapInPandas(run, f"{key} {kind}, doc long, {schema}")


# XML: elements with their place in the document.

ELEMENTS = "root string, at int, parent int, depth int, holder string, tag string, rel string, address string, text string, records array<int>"


def local(name: str) -> str:
    """A name without its namespace, in lower case."""
    return name[name.rfind("}") + 1 :].casefold()


def elements(body: str) -> Iterator[tuple]:
    """The elements in document order; nothing of a text that is not well-formed.

    parent and holder are the number and name of the element above; address is the first attribute that
    names one; records are the numbers of the records that an element lies in, or is.
    """
    try:
        top = ElementTree.fromstring(body)
    except (ElementTree.ParseError, ValueError):
        return
    waiting, at, root = [(top, -1, 0, None, [])], 0, local(top.tag)
    while waiting:
        node, parent, depth, holder, records = waiting.pop()
        tag = local(node.tag)
        records = [*records, at] if tag in XML_RECORDS else records
        address = next((v.strip() for k, v in node.attrib.items() if local(k) in XML_ADDRESSES and v.strip()), "")
        yield root, at, parent, depth, holder, tag, (node.get("rel") or "").casefold(), address, (node.text or "").strip(), records
        waiting += [(child, at, depth + 1, tag, records) for child in reversed(node)]
        at += 1


def is_address(raw: Column) -> Column:
    return ~raw.rlike(r"\s") & (raw.rlike("(?i)^https?://[^/?#]") | raw.startswith("/") | raw.startswith("./") | raw.startswith("../"))


def addresses(raw: Column) -> Column:
    """A text that is an address, or the addresses in it."""
    found = F.transform(F.regexp_extract_all(raw, F.lit(r"""(?i)https?://[^\s"'<>]+"""), F.lit(0)), lambda u: F.regexp_replace(u, r"[),.;]+$", ""))
    return F.when(is_address(raw), F.array(raw)).otherwise(found)


def feed_links(docs: DataFrame) -> DataFrame:
    """(url, body) of RSS, Atom or job XML to (url, link, label, title, job), one row a link.

    A record is a job by its name, or if it holds a title with an id or an address. Links of jobs count; those of other
    records only if they lead to a provider, a career page or a single job; `link`, `guid` and `loc` elements of a
    feed always do, and what says rel=next is labelled so. Addresses in a job's other texts count if they lead to a
    provider or a single job. A guid that is no address is none. title is that of the innermost record.
    """
    nodes = rows_of(docs, "url", "body", elements, ELEMENTS)
    within = nodes.filter(F.size("records") > 0).withColumn("record", F.explode("records"))
    titled = F.col("tag").isin(*XML_TITLES)
    about = within.groupBy("url", "doc", "record").agg(
        F.max(F.when(F.col("at") == F.col("record"), F.col("tag"))).alias("kind"),
        F.bool_or(titled).alias("titled"),
        F.bool_or(F.col("tag").isin(*XML_IDS, *XML_URLS)).alias("named"),
        F.min_by("text", F.when(titled & (F.col("text") != ""), F.col("at"))).alias("title"),
    )
    about = about.select("url", "doc", "record", "title", (F.col("kind").isin(*XML_JOBS) | F.col("titled") & F.col("named")).alias("job"))
    bare = nodes.filter(F.size("records") == 0).select(*nodes.columns, F.lit(-1).alias("record"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("job"))
    every = within.join(about, ["url", "doc", "record"]).unionByName(bare)
    shaped = F.col("tag").isin(*XML_URLS) | (F.col("address") != "") | F.col("rel").isin("alternate", "related", "next")
    # In a feed a query alone is an address too.
    own = F.when((F.col("address") != ""), F.array("address")).otherwise(F.array().cast("array<string>"))
    raw = every.select("*", shaped.alias("shaped"), F.explode(F.array_distinct(F.concat(own, addresses(F.col("text"))))).alias("raw"))
    raw = raw.filter((F.col("tag") != "guid") | is_address(F.col("raw"))).withColumn("link", resolved(F.col("url"), F.col("raw"))).filter("link is not null")
    leads = ux.provider_kind(F.col("link")).isNotNull() | ux.is_detail_url(F.col("link"))
    careers, next_ = ux.is_career_url(F.col("link"), F.col("tag")), F.col("rel") == "next"
    of_feed = F.col("root").isin(*XML_FEEDS) & F.col("tag").isin("link", "guid", "loc")
    kept = F.when(F.col("shaped"), of_feed | (F.col("record") >= 0) & (F.col("job") | next_ | leads | careers)).otherwise(F.col("job") & leads)
    label = F.coalesce(F.max(F.when(next_, F.lit("next"))), F.min_by("tag", F.struct("at", "record")))
    return raw.filter(kept).groupBy("url", "link").agg(label.alias("label"), F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("record", "doc"))).alias("title"), F.bool_or("job").alias("job"))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """(url, body) to (url, is_index, loc, lastmod, place), one row an address: dated entries first, newest first, then document order.

    Entries are the elements right under the root, whatever their namespaces; a document without any gives every `loc`.
    """
    nodes = rows_of(docs, "url", "body", elements, ELEMENTS)
    named = F.coalesce(F.nullif("address", F.lit("")), F.nullif("text", F.lit("")))
    entries = nodes.filter((F.col("depth") == 2) & F.col("holder").isin(*SITEMAP_ENTRIES)).groupBy("url", "doc", "root", "parent")
    entries = entries.agg(F.min_by(named, F.when(F.col("tag").isin(*SITEMAP_PLACES) & named.isNotNull(), F.col("at"))).alias("loc"), F.max_by("text", F.when(F.col("tag").isin(*SITEMAP_TIMES), F.col("at"))).alias("lastmod"))
    entries = entries.filter("loc is not null").select("url", "doc", "root", F.col("parent").alias("at"), "loc", F.nullif("lastmod", F.lit("")).alias("lastmod"), F.lit(0).alias("kind"))
    bare = nodes.filter("tag = 'loc' and text <> ''").select("url", "doc", "root", "at", F.col("text").alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit(1).alias("kind"))
    both = entries.unionByName(bare).withColumn("least", F.min("kind").over(W.partitionBy("url", "doc"))).filter("kind = least")
    order = (F.col("lastmod").isNull(), F.col("lastmod").desc(), "at", "doc")
    once = both.withColumn("nth", F.row_number().over(W.partitionBy("url", "loc").orderBy(*order))).filter("nth = 1")
    place = F.row_number().over(W.partitionBy("url").orderBy(*order))
    return once.select("url", (F.col("root") == "sitemapindex").alias("is_index"), "loc", "lastmod", place.alias("place"))


def sitemap_pages(docs: DataFrame) -> DataFrame:
    """(url, body) to (listed_by, url, loc, lastmod, place): entries of sitemaps with the index that lists the sitemap; indexes give no rows of their own."""
    every = sitemap_urls(docs)
    lists = every.filter("is_index").groupBy(F.col("loc").alias("url")).agg(F.min("url").alias("listed_by"))
    return every.filter("not is_index").join(lists, "url", "left").select("listed_by", "url", "loc", "lastmod", "place")


# JSON-LD: objects of scripts.

LD_SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json[^>]*>(.*?)</script>"""


def job_objects(body: str) -> Iterator[tuple]:
    """The JobPosting objects of a script, as JSON, in document order: in lists, @graph, itemListElement and item, however deep."""
    try:
        waiting = [json.loads(body)]
    except (ValueError, RecursionError):
        return
    at = 0
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            kind = node.get("@type")
            inner = [node[k] for k in ("@graph", "itemListElement", "item") if k in node]
            if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                yield at, json.dumps({k: v for k, v in node.items() if k not in ("@graph", "itemListElement", "item")})
                at += 1
            waiting += reversed(inner)


def got(path: str, of: Column | None = None) -> Column:
    """The text at a path of the object, trimmed; null if it is not there, empty, or no plain value."""
    value = F.try_variant_get(F.col("v") if of is None else of, path, "variant")
    plain = ~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
    return F.when(plain, F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit("")))


def shape(path: str, of: Column | None = None) -> Column:
    """OBJECT, ARRAY or a plain type; null if nothing is there."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(F.col("v") if of is None else of, path, "variant")), r"^\w+", 0)


def places(path: str) -> Column:
    """"Locality, region, country" of the place, or of each place, at a path; those that say none of it drop out."""
    listed = F.when(shape(path) == "ARRAY", F.try_variant_get("v", path, "array<variant>")).when(shape(path) == "OBJECT", F.array(F.try_variant_get("v", path, "variant")))

    def one(place: Column) -> Column:
        address = lambda part: F.when(shape("$.address", place) == "OBJECT", got(f"$.address.{part}", place)).when(shape("$.address", place).isNull(), got(f"$.{part}", place))
        country = F.coalesce(address("addressCountry"), address("addressCountry.name"))
        return F.concat_ws(", ", address("addressLocality"), address("addressRegion"), country)

    return F.filter(F.transform(F.filter(listed, lambda p: shape("$", p) == "OBJECT"), one), lambda p: p != "")


def jsonld_postings(pages: DataFrame) -> DataFrame:
    """(url, html) to the jobs of a page's ld+json scripts: (page_url, at, title, apply_url, source_id, company, locations, posted_raw, employment_type, description).

    The link is url, else sameAs; the id is the identifier's value, else its name, else the link. A job without a
    title or a link drops out, as does a script that is no JSON.
    """
    scripts = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(LD_SCRIPT), F.lit(1))).alias("script", "body"))
    scripts = scripts.withColumn("key", F.struct("url", "script"))
    found = rows_of(scripts.withColumn("key", F.to_json("key")), "key", "body", job_objects, "at int, job string")
    where = F.from_json("key", "url string, script int")
    jobs = found.select(where["url"].alias("page_url"), (where["script"].cast("long") * (1 << 32) + F.col("at")).alias("at"), F.try_parse_json("job").alias("v"))
    whole = lambda key: F.coalesce(got(f"$.{key}"), got(f"$.{key}.name"))
    at = places("$.jobLocation")
    rows = jobs.select(
        "page_url", "at", got("$.title").alias("title"), F.coalesce(got("$.url"), got("$.sameAs")).alias("apply_url"), F.coalesce(got("$.identifier"), got("$.identifier.value"), got("$.identifier.name")).alias("own_id"), whole("hiringOrganization").alias("company"),
        F.coalesce(F.when(F.size(at) > 0, at), places("$.applicantLocationRequirements"), F.array().cast("array<string>")).alias("locations"), got("$.datePosted").alias("posted_raw"), F.coalesce(got("$.employmentType"), F.array_join(F.try_variant_get("v", "$.employmentType", "array<string>"), ", ")).alias("employment_type"), F.coalesce(got("$.description"), F.lit("")).alias("description"),
    )
    return rows.filter("title is not null and apply_url is not null").select("page_url", "at", "title", "apply_url", F.coalesce("own_id", "apply_url").alias("source_id"), "company", "locations", "posted_raw", "employment_type", "description")


# Titles of pages without structure.

NAMED_IN_TEXT = re.compile(r'"(?:jobTitle|job_title|positionTitle|position_title)"\s*:\s*"((?:\\.|[^"\\]){4,240})"', re.IGNORECASE)
SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    """The texts of elements that hold titles, the scripts of JSON, and what is visible."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: list[tuple[str, str]] = []
        self.scripts: list[str] = []
        self.seen: list[str] = []
        self.open: list[tuple[str, list[str], str]] = []
        self.hidden: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.titles += [("meta", own.get("content", "")) for k, v in TITLE_METAS if own.get(k) == v]
        if tag in ("script", "style"):
            self.hidden = []
            if tag == "script" and (own.get("type") == "application/json" or own.get("id") == "__NEXT_DATA__"):
                self.scripts.append("")
                self.hidden = self.scripts
        held = tag in ("h1", "title") or any(own.get(k) == v for k, v in TITLE_ATTRIBUTES) or any(c in own.get("class", "") for c in TITLE_CLASSES)
        if tag not in VOID and (held or any(t == tag for t, _, _ in self.open)):
            self.open.append((tag, [], "title" if tag == "title" else "shown" if held else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = None
        if any(t == tag for t, _, _ in self.open):
            while True:
                name, parts, kind = self.open.pop()
                if kind:
                    self.titles.append((kind, " ".join(parts)))
                if name == tag:
                    return

    def handle_data(self, data: str) -> None:
        if self.hidden is self.scripts and self.scripts:
            self.scripts[-1] += data
        elif self.hidden is None and data.strip():
            self.seen.append(data.strip())
            for _, parts, _ in self.open:
                parts.append(data.strip())


def titles_in(value: object) -> Iterator[tuple[str, str]]:
    """(kind, text) under keys of titles, of the objects of a JSON text: "job" where another key says that it is one."""
    waiting = [value]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            kind = "job" if any(k in node for k in JOB_SIGNAL_KEYS) else "other"
            yield from ((kind, node[k]) for k in TITLE_KEYS if isinstance(node.get(k), str))
            waiting += reversed(node.values())
        elif isinstance(node, list):
            waiting += reversed(node)


def titles(html: str) -> Iterator[tuple]:
    """(at, kind, text): what is visible (kind "text") and every title, in order: of elements, metas, JSON scripts, and named in any script."""
    page = Page()
    page.feed(html)
    page.close()
    unclosed = [(kind, " ".join(parts)) for _, parts, kind in page.open if kind]
    found = [("text", " ".join(page.seen)), *page.titles, *unclosed]
    for script in page.scripts:
        try:
            found += titles_in(json.loads(script))
        except (ValueError, RecursionError):
            continue
    for raw in NAMED_IN_TEXT.findall(html):
        try:
            found.append(("job", json.loads(f'"{raw}"')))
        except ValueError:
            found.append(("job", raw))
    for at, (kind, text) in enumerate(found):
        yield at, kind, SPACE.sub(" ", unescape(text)).strip() if kind == "text" else SPACE.sub(" ", unescape(text)).strip(" -|\t")


def squeezed(text: Column) -> Column:
    """Lower-case letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def recovered_pages(pages: DataFrame, leads: DataFrame, least: float = 0.55) -> DataFrame:
    """(page_id, url, html) and leads (url, title) to (page_id, title, lead_title, found, similarity), one row a page and lead, or a page.

    Pages that say that they are closed drop out. All titles of a page are candidates: those of elements and metas, and
    of JSON (4 to 240 characters; in objects that are no jobs they must say "intern"). For a lead the most similar counts,
    of equals the shortest; it must be similar, or the lead's own title must stand in the page, and the page must say
    "intern". Without a lead the shortest title that says "intern" counts, if the page says "Summer 2027".
    """
    open_ = pages.filter(F.col("html").isNotNull() & ~rules.page_is_closed(F.col("html")))
    read = rows_of(open_, "page_id", "html", titles, "at int, kind string, text string")
    says = lambda c: F.col(c).rlike("(?i)" + PAGE_INTERN)
    sized = F.length("text").between(4, 240)
    good = F.when(F.col("kind").isin("meta", "title"), F.col("text") != "").when(F.col("kind") == "other", sized & says("text")).otherwise(sized & (F.col("kind") != "text"))
    # Of titles that differ in case the first stays.
    once = read.filter(good).groupBy("page_id", "doc", F.lower("text").alias("low")).agg(F.min_by("text", "at").alias("found")).drop("low")
    shown = read.filter("kind = 'text'").select("page_id", "doc", F.col("text").alias("shown"))
    about = open_.select("page_id", F.xxhash64("page_id", "html").alias("doc"), ux.canonical_url(F.col("url")).alias("key"), "html").join(shown, ["page_id", "doc"])
    about = about.select("page_id", "doc", "key", F.concat_ws(" ", "shown", "html").alias("evidence"))
    about = about.select("page_id", "doc", "key", squeezed(F.col("evidence")).alias("body"), says("evidence").alias("intern"), F.col("evidence").rlike("(?i)" + SUMMER_2027).alias("summer"))
    one = leads.select(ux.canonical_url(F.col("url")).alias("key"), F.col("title").alias("lead_title")).filter("lead_title is not null").distinct()
    both = about.join(one, "key", "left")
    led = both.filter("lead_title is not null and intern").select("page_id", "doc", "lead_title", F.col("body").contains(squeezed(F.col("lead_title"))).alias("said"))
    near = led.join(once, ["page_id", "doc"], "left").withColumn("similarity", F.coalesce(tx.title_similarity(F.col("lead_title"), F.coalesce("found", F.lit(""))), F.lit(0.0)))
    best = near.groupBy("page_id", "lead_title").agg(F.max_by(F.struct("found", "similarity"), F.struct("similarity", -F.length("found"), "found")).alias("b"), F.bool_or("said").alias("said"))
    best = best.filter(F.col("said") | (F.col("b.similarity") >= least)).select("page_id", F.col("lead_title").alias("title"), "lead_title", "b.found", "b.similarity")
    alone = both.filter("lead_title is null and summer").select("page_id", "doc").join(once.filter(says("found")), ["page_id", "doc"])
    alone = alone.groupBy("page_id").agg(F.min_by("found", F.struct(F.length("found"), "found")).alias("found"))
    none = F.lit(None).cast("string")
    return best.unionByName(alone.select("page_id", F.col("found").alias("title"), none.alias("lead_title"), "found", F.lit(1.0).alias("similarity")))
