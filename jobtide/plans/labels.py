"""Queries of scores, labels, keys and delays that take several forms, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CAREER_MARKERS, CATEGORY_LABELS, INFERRED_LABELS
from ..functions import rules
from ..functions import urls as ux
from ..sources.fixtures import VIEWS, view
from .scalars import any_sql, host, path

c = F.col


def surfaces(edges: DataFrame) -> DataFrame:
    """(page, base_host, url, label) to (page, url, score, place): the best score of each link of a page, the highest first."""
    own = ux.host(c("url"))
    said = F.lower(F.coalesce("label", F.lit("")))
    site = reduce(lambda a, b: a | b, (said.contains(t) for t in ("website", "homepage", "company site")))
    career = reduce(lambda a, b: a | b, (said.contains(t) | F.lower(ux.path(c("url"))).contains(t) for t in CAREER_MARKERS))
    score = F.when(own != c("base_host"), 20).otherwise(0) + F.when(site, 100).otherwise(0) + F.when(career, 80).otherwise(0)
    best = edges.filter(ux.scheme(c("url")).isin("http", "https") & (own != "")).groupBy("page", "url").agg(F.max(score).alias("score"))
    pages = best.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("score", "url")), asc=False).alias("links"))
    return pages.select("page", F.posexplode("links").alias("at", "l")).select("page", "l.url", "l.score", (c("at") + 1).alias("place"))


def label_of(category: Column, title: Column) -> Column:
    """What alerts call a category; for the rest, what the title says."""
    key, text = F.lower(F.trim(F.coalesce(category, F.lit("")))), F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    known = F.create_map(*(F.lit(x) for k, v in CATEGORY_LABELS.items() for x in (k, v)))
    rest = F.coalesce(*(F.when(reduce(lambda a, b: a | b, (text.contains(t) for t in tokens)), label) for tokens, label in INFERRED_LABELS))
    named = F.coalesce(F.try_element_at(known, key), F.initcap(F.replace(key, F.lit("-"), F.lit(" "))))
    return F.when(~key.isin("", "other", "other-technical"), named).otherwise(F.coalesce(rest, F.try_element_at(known, key), F.lit("Other technical")))


def request_key(path_: Column, params: Column) -> Column:
    """The path and its parameters (map of strings) that are not empty, false or 0, sorted by name and encoded."""
    given = F.map_entries(F.map_filter(params, lambda k, v: v.isNotNull() & ~v.isin("", "false", "0")))
    query = F.array_join(F.transform(F.array_sort(given), lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")
    return F.when(query == "", path_).otherwise(F.concat(path_, F.lit("?"), query))


def backoff(failures: Column, first: int, doublings: int, most: int) -> Column:
    """first * 2^(failures - 1), the power and the seconds bounded."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), F.least(F.greatest(failures - 1, F.lit(0)), F.lit(doublings)))).cast("long")


DAY = 86400


def _surfaces(spark, sf_dir):
    links = view(spark, sf_dir, "fx_links")
    base = F.when(c("n") % 2 == 0, "jobs.lever.co").otherwise("github.com")
    label = F.when(c("id") % 5 == 0, "Company Website").when(c("id") % 5 == 1, "Open Jobs").otherwise(c("label"))
    edges = links.select(F.floor(c("id") / 40).alias("page"), "url", label.alias("label"), base.alias("base_host"))
    return surfaces(edges.unionByName(links.select(F.floor(c("id") / 40).alias("page"), "url", F.lit("homepage").alias("label"), F.lit("github.com").alias("base_host")).filter(c("id") % 7 == 0)))


def _labels(spark, sf_dir):
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("ml-ai", "other", "", "other-technical", "quant", "field-service"))), (c("id") % 6 + 1).cast("int"))
    return view(spark, sf_dir, "fx_texts").select("id", label_of(kinds, c("title")).alias("label"))


def _keys(spark, sf_dir):
    params = F.create_map(F.lit("q"), c("name"), F.lit("page"), (c("n") % 3).cast("string"), F.lit("remote"), (c("id") % 2 == 0).cast("string"), F.lit("company"), F.when(c("id") % 4 == 0, c("company")))
    return view(spark, sf_dir, "fx_texts").select("id", request_key(F.when(c("id") % 5 == 0, "/api/facets").otherwise("/api/families"), F.when(c("id") % 11 > 0, params).otherwise(F.create_map().cast("map<string,string>"))).alias("key"))


def _delays(spark, sf_dir):
    failures = c("consecutive_failures")
    return view(spark, sf_dir, "fx_targets").select("source", rules.retry_delay(failures, c("interval_seconds"), c("last_status")).alias("source_delay"), backoff(failures, 6 * 3600, 4, 7 * DAY).alias("candidate_delay"), backoff(failures, 12 * 3600, 5, 30 * DAY).alias("observation_delay"))


def queries() -> dict:
    return {"hiring_surface_score": _surfaces, "category_label": _labels, "request_key": _keys, "retry_delay": _delays}


def oracle() -> dict[str, str]:
    label = "case when id % 5 = 0 then 'Company Website' when id % 5 = 1 then 'Open Jobs' else label end"
    text = "' ' || lower(title) || ' '"
    rest = "case " + " ".join(f"when {any_sql(text, t)} then '{v}'" for t, v in INFERRED_LABELS)
    encoded = "replace(url_encode({0}), '%20', '+')"
    pair = lambda k, v, ok: f"case when {ok} then '{k}=' || {encoded.format(v)} end"
    return {
        "hiring_surface_score": f"""with fx_links as ({VIEWS['fx_links']}), e as (select id // 40 as page, url, {label} as label, case when n % 2 = 0 then 'jobs.lever.co' else 'github.com' end as base from fx_links union all select id // 40, url, 'homepage', 'github.com' from fx_links where id % 7 = 0)
          select page, url, score, (row_number() over (partition by page order by score desc, url desc))::int as place from (select page, url, max((case when {host('url')} <> base then 20 else 0 end + case when {any_sql('lower(label)', ('website', 'homepage', 'company site'))} then 100 else 0 end + case when {any_sql('lower(label)', CAREER_MARKERS)} or {any_sql(f'lower({path("url")})', CAREER_MARKERS)} then 80 else 0 end)::int) as score from e where url like 'http%' or url like 'HTTP%' group by 1, 2)""",
        "category_label": f"with fx_texts as ({VIEWS['fx_texts']}) select id, case id % 6 when 0 then 'ML / AI' when 4 then 'Quant' when 5 then 'Field Service' else {rest} else 'Other technical' end end as label from fx_texts",
        "request_key": f"""with fx_texts as ({VIEWS['fx_texts']}) select id, path || case when query = '' then '' else '?' || query end as key from (select id, case when id % 5 = 0 then '/api/facets' else '/api/families' end as path, case when id % 11 = 0 then '' else concat_ws('&', {pair('company', 'company', "id % 4 = 0 and company <> ''")}, {pair('page', '(n % 3)::varchar', 'n % 3 > 0')}, {pair('q', 'name', "name <> ''")}, {pair('remote', "'true'", 'id % 2 = 0')}) end as query from fx_texts)""",
        "retry_delay": f"""with fx_targets as ({VIEWS['fx_targets']}) select source, case last_status when 'partial' then greatest(600, interval_seconds) when 'empty' then greatest(21600, interval_seconds) else case when consecutive_failures > 0 then least(21600, (greatest(300, interval_seconds) * power(2, least(consecutive_failures, 5)))::bigint) else interval_seconds end end as source_delay,
          list_min([604800, 21600 * (1 << greatest(least(consecutive_failures - 1, 4), 0))])::bigint as candidate_delay, list_min([2592000, 43200 * (1 << greatest(least(consecutive_failures - 1, 5), 0))])::bigint as observation_delay from fx_targets""",
    }
