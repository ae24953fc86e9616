"""Column functions over URLs; parts are taken by patterns, which never throw on odd input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import APPLY_MARKERS, CAREER_MARKERS, CAREER_SUBDOMAINS, CLICK_KEYS, DETAIL_MARKERS, JOB_ID, MULTIPART_SUFFIXES, NON_APPLICATION_HOSTS, PROVIDERS, TRACKING_KEYS


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_extract(host(url), r"^([^:]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def param(url: Column, name: str) -> Column:
    """The first value of a query key; empty if absent."""
    return F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]+)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def any_of(col: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (col.contains(t) for t in tokens))


def rebuilt(scheme_: Column, host_: Column, path_: Column, query_: Column, fragment_: Column | None = None) -> Column:
    tail = F.concat(F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""), F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise("") if fragment_ is not None else F.lit(""))
    return F.concat(scheme_, F.lit("://"), host_, path_, tail)


def rooted(path_: Column) -> Column:
    cut = F.regexp_replace(path_, "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def kept_query(url: Column, drop) -> Column:
    """Pairs whose lower-cased key `drop` does not take, decoded and encoded again."""
    coded = lambda c: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    key = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~drop(F.lower(F.coalesce(F.try_url_decode(key(p)), key(p)))))
    return F.array_join(F.transform(pairs, lambda p: F.concat(coded(key(p)), F.lit("="), coded(F.regexp_extract(p, "=(.*)$", 1)))), "&")


def canonical_url(url: Column) -> Column:
    u = F.trim(url)
    return rebuilt(scheme(u), host(u), rooted(path(u)), kept_query(u, lambda k: k.isin(*TRACKING_KEYS)))


def canonical_application_url(url: Column) -> Column:
    u = F.trim(url)
    return rebuilt(scheme(u), host(u), rooted(F.regexp_replace(path(u), "/{2,}", "/")), query(u))


def strip_tracking_query(url: Column) -> Column:
    raw_host = F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)
    return F.when(query(url) == "", url).otherwise(rebuilt(scheme(url), raw_host, path(url), kept_query(url, lambda k: k.startswith("utm_") | k.isin(*CLICK_KEYS)), fragment(url)))


def clean_sensor_url(url: Column) -> Column:
    return F.rtrim(F.trim(F.coalesce(url, F.lit(""))), F.lit("\"'.,;>"))


def normalize_http_url(url: Column) -> Column:
    """Null unless http(s) with a host."""
    raw = F.trim(url)
    for pattern, out in ((r"\\/", "/"), ("(?i)%3A", ":"), ("(?i)%2F", "/")):
        raw = F.regexp_replace(raw, pattern, out)
    raw_host = F.regexp_extract(raw, r"^[^:/?#]+://([^/?#]*)", 1)
    return F.when(scheme(raw).isin("http", "https") & (raw_host != ""), rebuilt(scheme(raw), raw_host, F.when(path(raw) == "", "/").otherwise(path(raw)), query(raw)))


UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def identity_of(scheme_: Column, h: Column, path_: Column, query_: Column, source: Column, source_id: Column) -> Column:
    """One key for copies of a requisition from different feeds, from the parts of its URL.

    The parts should be columns of their own, else each use computes its pattern again.
    """
    p = F.regexp_replace(path_, "/+$", "")
    value = lambda name: F.nullif(F.regexp_extract(query_, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    found = lambda ok, pattern: F.when(ok, F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")))
    tagged = lambda tag, col: F.concat(F.lit(tag + ":"), col)
    plain = rebuilt(scheme_, h, rooted(F.regexp_replace(p, "/apply$", "")), query_)
    return F.coalesce(
        tagged("greenhouse", value("gh_jid")),
        tagged("greenhouse", value("job_id")),
        tagged("greenhouse", found(h.contains("greenhouse"), r"/(?:jobs?|apply)/(\d+)(?:/|$)")),
        tagged("lever", F.lower(found(h == "jobs.lever.co", UUID))),
        tagged("ashby", F.lower(found(h == "jobs.ashbyhq.com", UUID))),
        tagged("google", found(h.contains("google.com"), r"/jobs/results/(\d+)")),
        tagged("smartrecruiters", found(h.contains("smartrecruiters.com"), r"/(\d{8,})(?:/|$)")),
        tagged("amazon", found(h.endswith("amazon.jobs"), r"/jobs/(\d+)(?:/|$)")),
        F.concat(F.lit("workday:"), h, F.lit(":"), F.lower(found(h.contains("myworkdayjobs.com"), r"_([A-Za-z]{0,6}\d[A-Za-z0-9-]*)$"))),
        F.when(plain != ":///", plain),
        F.concat_ws(":", source, source_id),
    )


def application_identity(url: Column, source: Column, source_id: Column) -> Column:
    return identity_of(scheme(url), host(url), path(url), query(url), source, source_id)


def is_actionable_url(url: Column) -> Column:
    return scheme(url).isin("http", "https") & ~host(url).isin(*NON_APPLICATION_HOSTS)


def is_specific_url(url: Column) -> Column:
    p = F.lower(F.regexp_replace(path(url), "/+$", ""))
    home = p.isin("", "/careers", "/jobs", "/open-positions", "/about/careers/applications/jobs/results") | p.rlike("(/careers|/jobs|/search|/jobs/results)$")
    return is_actionable_url(url) & (query(url).rlike(r"(?i)(?:^|&)gh_jid=\d+(?:&|$)") | ~home)


def provider_kind(url: Column) -> Column:
    h = bare_host(url)
    return F.coalesce(*(F.when(h.contains(f) if f.endswith(".") else (h == f) | h.endswith("." + f), kind) for f, kind in PROVIDERS.items()))


def registrable_domain(host_: Column) -> Column:
    labels = F.split(F.lower(host_), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) < 2, host_).when((F.size(labels) >= 3) & F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".").isin(*MULTIPART_SUFFIXES), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")).otherwise(last(2))


def same_employer_surface(url: Column, seed: Column) -> Column:
    clean = lambda c: F.btrim(F.trim(F.regexp_extract(F.lower(c), "^([^:]*)", 1)), F.lit("."))
    target, own = clean(host(url)), clean(seed)
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    career = lambda c: reduce(lambda a, b: a | b, (c.startswith(s) for s in CAREER_SUBDOMAINS))
    return (target != "") & (own != "") & ((bare(target) == bare(own)) | (registrable_domain(target) == registrable_domain(own)) & (career(target) | career(own)))


def is_career_url(url: Column, label: Column) -> Column:
    return any_of(F.lower(F.concat_ws(" ", path(url), query(url), F.coalesce(label, F.lit("")))), CAREER_MARKERS)


def is_detail_url(url: Column) -> Column:
    return any_of(F.lower(path(url)), DETAIL_MARKERS) & (url.rlike(JOB_ID) | (F.size(segments(url)) >= 3))


GREENHOUSE_HOSTS = ("boards.greenhouse.io", "job-boards.greenhouse.io", "job-boards.eu.greenhouse.io")


def greenhouse_token(url: Column) -> Column:
    banned = ("jobs", "job", "embed", "apply")
    embedded, first = F.trim(param(url, "for")), F.try_element_at(segments(url), F.lit(1))
    return F.when(host(url).isin(*GREENHOUSE_HOSTS), F.when((embedded != "") & ~F.lower(embedded).isin(*banned), embedded).when(~F.lower(first).isin(*banned) & ~first.rlike(r"^\d+$"), first))


def workday_site(url: Column) -> Column:
    parts = segments(url)
    at = F.array_position(parts, F.lit("job"))
    before = F.when(at > 0, F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(parts)
    return F.try_element_at(F.reverse(F.filter(before, lambda s: ~s.rlike("^[A-Za-z]{2}(?:-[A-Za-z]{2})?$") & ~F.lower(s).isin("search", "jobs"))), F.lit(1))


def is_board_landing(url: Column) -> Column:
    h, p = host(url), F.regexp_replace(path(url), "/+$", "")
    job = (param(url, "gh_jid") != "") | (param(url, "job_id") != "") | (param(url, "token") != "") | p.rlike(r"(?i)/(?:jobs?|apply)/(?:\d+|[0-9a-f-]{20,})(?:/|$)")
    return F.when(h.contains("greenhouse.io"), ~job & greenhouse_token(url).isNotNull()).when(h.isin("jobs.lever.co", "jobs.ashbyhq.com"), F.size(segments(url)) == 1).when(h.contains(".myworkdayjobs.com"), ~F.lower(p).contains("/job/")).otherwise(False)


def provider_tenant(url: Column) -> Column:
    """struct(kind, key), null if the host is no provider's."""
    h, s = bare_host(url), segments(url)
    first = F.try_element_at(s, F.lit(1))
    sub = F.regexp_extract(h, r"([^.]*)\.[^.]+\.[^.]+$", 1)
    after = lambda word: F.try_element_at(s, (F.array_position(s, F.lit(word)) + 1).cast("int"))
    slug = F.when(F.lower(first).isin("en-us", "en-gb", "es-419", "fr-fr", "de-de"), F.try_element_at(s, F.lit(2))).otherwise(first)
    origin = F.concat(scheme(url), F.lit("://"), h)
    rules = (
        ("smartrecruiters", h == "jobs.smartrecruiters.com", first), ("jobvite", h == "jobs.jobvite.com", first), ("rippling", h == "ats.rippling.com", slug),
        ("teamtailor", h.endswith(".teamtailor.com") & ~h.isin("www.teamtailor.com", "support.teamtailor.com"), sub), ("icims", h.endswith(".icims.com") & F.array_contains(s, "jobs"), h),
        ("oracle-cloud", h.contains("oraclecloud.com") & F.array_contains(s, "sites"), F.concat(origin, F.lit(" "), after("sites"))), ("successfactors", h.contains("successfactors.") & (param(url, "company") != ""), F.concat(origin, F.lit(" "), param(url, "company"))),
        ("recruitee", h.endswith(".recruitee.com") & ~h.isin("api.recruitee.com", "docs.recruitee.com", "www.recruitee.com"), sub), ("workable", h == "apply.workable.com", first), ("workable", h.endswith(".workable.com") & ~h.isin("www.workable.com", "apply.workable.com"), sub),
    )
    return F.coalesce(*(F.when(ok & key.isNotNull() & (key != ""), F.struct(F.lit(kind).alias("kind"), key.alias("key"))) for kind, ok, key in rules))


def application_score(url: Column) -> Column:
    h, p = host(url), F.lower(path(url))
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    score = points(any_of(h, tuple(PROVIDERS)), 500) + points(any_of(p, APPLY_MARKERS), 200) + points(url.contains("gh_jid=") | url.contains("job_id="), 250) + points(h.startswith("jobs.") | h.startswith("careers."), 80) - points(p.isin("", "/"), 100)
    return F.when(~scheme(url).startswith("http") | (h == "") | p.rlike(r"\.(?:png|jpe?g|gif|svg|webp|ico)$"), -10000).when(~is_actionable_url(url), -9000).otherwise(score)


def choose_apply_url(urls: Column) -> Column:
    """The highest score, the later of equals; null if none scores above -9000."""
    scored = F.filter(F.transform(urls, lambda u, i: F.struct(application_score(u).alias("score"), i.alias("at"), u.alias("url"))), lambda s: s["score"] > -9000)
    return F.array_max(scored)["url"]
