"""Feed queries: each operator by several arguments, and SQL for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INDEX_MODES, TARGETS, TECH
from ..operators import feed
from ..sources.fixtures import AS_OF
from ..sources.shared import shared
from . import dialect, inventory  # noqa: F401  inventory registers the views
from .scalars import names

c = F.col
KEYS = ("family_key", "company", "title")


def families(spark, sf_dir) -> DataFrame:
    """The families, their places as an array."""
    return dialect.frame(spark, sf_dir, "families").withColumn("places", F.split("locations", "[|]"))


def nested(spark, sf_dir) -> DataFrame:
    """Families with their openings as structs, sorted by places, then link."""
    opening = F.struct(F.split("locations", "[|]").alias("places"), "apply_url", "identity", "source_mode", "latest_posted_at", "posting_key")
    openings = dialect.frame(spark, sf_dir, "fold_applications").groupBy(c("family_key").alias("of")).agg(F.array_sort(F.collect_list(opening)).alias("openings"))
    return families(spark, sf_dir).drop("openings").join(openings, c("family_key") == c("of")).drop("of")


def each(args, run, *columns) -> DataFrame:
    """The rows of all arguments, each with its argument as text."""
    return reduce(DataFrame.unionByName, (run(a).select(F.lit(str(a)).alias("arg"), *columns) for a in args))


def coded(df: DataFrame) -> DataFrame:
    """Places that begin with A get a code, as American places have."""
    return df.withColumn("places", F.transform("places", lambda p: F.when(p.startswith("A"), F.concat(p, F.lit(", "), F.substring(p, 1, 2))).otherwise(p)))


# What callers ask for.
TARGET_ARGS, TRUST_ARGS = ("exact", "default", "wrong_year", ""), ("verified", "leads", "all")
TRACK_ARGS = (("", "tech"), ("quant", "tech"), ("", "all"))
SEARCH_ARGS = ("supplier INTERN", "software asia", "2027", "100%_sure", "")
PLACE_ARGS, COMPANY_ARGS = ("al", "AR", "asia", "a, a", "_r", "Remote"), ("SUPPLIER#000000003", "nobody", "")
DAYS_ARGS, SORTS = (1, 100, 1000), ("newest", "verified", "company")
RANK_ARGS = ("Supplier#000000003", "supplier#000000003 intern", "Supplier#00000000", "supplier#0000 x", "software engineering")
PAGE_ARGS, KEY_ARGS = ((1, 50), (3, 20), (9999, 50)), ("", "7", "g")
BASIC_ARGS = (("software", "", "default"), ("asia", "quant", "default"), ("", "", "wrong_year"), ("#00000000", "hardware", "exact"))


def _detail(spark, sf_dir):
    opening = F.transform("openings", lambda o: F.concat_ws(" ", o["identity"], o["source_mode"]))
    columns = ("family_key", "opening_count", "location_count", F.array_join("places", "|").alias("locations"), F.array_join(F.array_sort(opening), ";").alias("openings"), "verified", "quality")
    all_ = nested(spark, sf_dir)
    return each(TRUST_ARGS, lambda t: feed.shown(feed.by_trust(all_, t), t), *columns)


def _facets(spark, sf_dir):
    base = families(spark, sf_dir)
    args = [(t, g) for t in TRUST_ARGS for g in ("default", "")]
    return each(args, lambda a: feed.facets(feed.by_track(feed.by_target(feed.by_trust(base, a[0]), a[1]))), "facet", "value", "n")


def _index(spark, sf_dir):
    """The compact index: fields of a family, and its openings as structs, one row an opening."""
    tech = feed.by_track(nested(spark, sf_dir))
    return tech.select(*KEYS, "category", "season", "year", "target_match", "locations", F.size("places").alias("location_count"), "opening_count", "direct_openings", "backstop_openings", "first_posted_at", "latest_posted_at", "posted_precision", "first_detected_at", "last_verified_at", F.exists("places", lambda p: feed.holds(p, "remote")).alias("remote"), F.posexplode("openings").alias("nth", "o")).select("*", "o.identity", "o.apply_url", "o.source_mode", c("o.latest_posted_at").alias("opening_posted_at"), F.array_join("o.places", "|").alias("opening_locations"), "o.posting_key").drop("o")


def _keyset(spark, sf_dir):
    """Pages of an index that is stored in ranges of its keys."""
    root = shared(spark, "index")
    feed.store_index(dialect.frame(spark, sf_dir, "families").select(*KEYS), root)
    return each(KEY_ARGS, lambda k: feed.stored_page_after(spark, root, k, 100), *KEYS)


def _presets(spark, sf_dir):
    """The fixed responses: the first page of each sort, the facets and the figures, keyed by request."""
    base = feed.by_track(feed.by_target(families(spark, sf_dir), "default"))
    verified = feed.by_trust(base, "verified")
    pages = [feed.page_of(verified, feed.order_of(s), 1, 50).select(F.lit(f"/families?sort={s}").alias("request"), c("family_key").alias("item"), c("total").alias("n")) for s in SORTS]
    counts = feed.facets(verified).select(F.lit("/facets").alias("request"), F.concat_ws("=", "facet", "value").alias("item"), "n")
    figures = verified.agg(F.count("*").alias("families"), F.sum("direct_openings").alias("listings"), F.countDistinct("company").alias("companies"))
    stats = figures.select(F.lit("/stats").alias("request"), F.explode(F.array(*(F.struct(F.lit(k).alias("item"), F.coalesce(c(k), F.lit(0)).cast("long").alias("n")) for k in ("families", "listings", "companies")))).alias("s")).select("request", "s.item", "s.n")
    return reduce(DataFrame.unionByName, [*pages, counts, stats])


def _search_rank(spark, sf_dir):
    base = families(spark, sf_dir)
    rank = lambda q: base.withColumn("relevance", feed.relevance(q)).orderBy("relevance", *feed.order_of("newest")).limit(100)
    return each(RANK_ARGS, rank, "relevance", *KEYS)


def _page(spark, sf_dir):
    base = feed.by_trust(families(spark, sf_dir), "verified")
    return each(PAGE_ARGS, lambda a: feed.page_of(base, feed.order_of("newest"), *a), "total", *KEYS)


def _basic(spark, sf_dir):
    base = families(spark, sf_dir)
    order = [F.coalesce("latest_posted_at", "first_detected_at").desc(), c("family_key")]
    return each(BASIC_ARGS, lambda a: feed.page_of(feed.basic_search(base, *a), order, 1, 100), "total", *KEYS)


def over(args, run, prepare=lambda df: df):
    """A query of one filter over all families."""
    return lambda spark, sf_dir: (lambda base: each(args, lambda a: run(base, a), *KEYS))(prepare(families(spark, sf_dir)))


def queries() -> dict:
    return {
        "feed_target": over(TARGET_ARGS, feed.by_target), "feed_track": over(TRACK_ARGS, lambda df, a: feed.by_track(df, *a)), "feed_trust": over(TRUST_ARGS, feed.by_trust),
        "feed_search": over(SEARCH_ARGS, feed.by_search), "feed_location": over(PLACE_ARGS, feed.by_location, coded), "feed_company": over(COMPANY_ARGS, feed.by_company),
        "feed_remote": over(("remote",), lambda df, _: feed.remote_only(df)), "feed_posted_within": over(DAYS_ARGS, lambda df, d: feed.posted_within(df, d, AS_OF)),
        "feed_order": lambda spark, sf_dir: (lambda base: each(SORTS, lambda s: feed.ordered(base, s), "place", *KEYS))(families(spark, sf_dir)),
        "keyset_page": _keyset, "search_rank": _search_rank, "feed_page": _page, "families_basic_search": _basic, "family_detail": _detail, "facets": _facets, "export_family_index": _index, "export_preset_responses": _presets,
    }


# The same rows in SQL, written from what each request asks.
TECHS, GOOD = names(TECH), names(TARGETS)
ANY = "(company ilike '%{0}%' escape '!' or title ilike '%{0}%' escape '!' or locations ilike '%{0}%' escape '!')"
PLACES = "string_split(locations, '|')"
CODED = f"list_transform({PLACES}, lambda p: case when p like 'A%' then p || ', ' || p[1:2] else p end)"
TARGET_SQL = {"exact": "year = 2027 and season = 'summer'", "default": "year = 2027", "wrong_year": "target_match = 'wrong_year'", "": "true"}
TRUST_SQL = {"verified": "direct_openings > 0", "leads": "direct_openings = 0 and backstop_openings > 0", "all": "true"}
SEARCH_SQL = {"supplier INTERN": f"{ANY.format('supplier')} and {ANY.format('intern')}", "software asia": f"{ANY.format('software')} and {ANY.format('asia')}", "2027": ANY.format("2027"), "100%_sure": ANY.format("100!%!_sure"), "": "true"}
PLACE_SQL = {"al": "(p = 'AL' or p ilike '%, AL')", "AR": "(p = 'AR' or p ilike '%, AR')", "asia": "p ilike '%asia%'", "a, a": "p ilike '%a, a%'", "_r": "p ilike '%!_r%' escape '!'", "Remote": "p ilike '%remote%'"}
RECENT = "case when latest_posted_at is null then date_trunc('hour', first_detected_at) when posted_precision = 'timestamp' then latest_posted_at else date_trunc('day', latest_posted_at) end desc"
BY = {
    "newest": f"{RECENT}, direct_openings <= 0, list_position(['timestamp', 'day'], posted_precision) nulls last, last_verified_at desc nulls last, family_key",
    "verified": f"direct_openings <= 0, last_verified_at desc nulls last, {RECENT}, family_key", "company": "lower(company), lower(title), family_key",
}
RANK_SQL = "case when lower(company) = lower('{q}') then 0 when lower(company) = lower('{f}') then 1 when company ilike '{q}%' then 2 when company ilike '{f}%' then 3 when title ilike '%{q}%' then 4 else 5 end"
BASIC_SQL = {BASIC_ARGS[0]: f"target_match in ({GOOD}) and {ANY.format('software')}", BASIC_ARGS[1]: f"target_match in ({GOOD}) and category = 'quant' and {ANY.format('asia')}", BASIC_ARGS[2]: "target_match = 'wrong_year'", BASIC_ARGS[3]: f"year = 2027 and season = 'summer' and category = 'hardware' and {ANY.format('#00000000')}"}


def united(args, query) -> str:
    """One select an argument; `query` gives all after the argument's column."""
    return " union all ".join(f"(select '{str(a).replace(chr(39), chr(39) * 2)}' as arg, {query(a)})" for a in args)


def oracle() -> dict[str, str]:
    keys = ", ".join(KEYS)
    where = lambda args, sql: united(args, lambda a: f"{keys} from {{families}} where {sql(a)}")
    paged = lambda args, sql, order, limit: united(args, lambda a: f"(select count(*) from {{families}} where {sql(a)}) as total, {keys} from {{families}} where {sql(a)} order by {order} {limit(a)}")
    modes = {"verified": "source_mode = 'direct'", "leads": f"source_mode in ({names(INDEX_MODES)})", "all": "true"}
    detail = lambda t: f"""f.family_key, case when '{t}' = 'all' then f.opening_count else count(a.identity) end as opening_count, len(coalesce(list_distinct(flatten(list({PLACES.replace('locations', 'a.locations')}) filter (a.identity is not null))), {PLACES.replace('locations', 'any_value(f.locations)')})) as location_count,
      array_to_string(list_sort(list_distinct(coalesce(flatten(list({PLACES.replace('locations', 'a.locations')}) filter (a.identity is not null)), {PLACES.replace('locations', 'any_value(f.locations)')}))), '|') as locations, coalesce(string_agg(a.identity || ' ' || a.source_mode, ';' order by a.identity || ' ' || a.source_mode), '') as openings,
      f.direct_openings > 0 as verified, case when f.direct_openings > 0 then 'verified' else 'lead' end as quality from {{families}} f left join (select * from {{fold_applications}} where {modes[t]}) a on a.family_key = f.family_key where {TRUST_SQL[t].replace('direct_', 'f.direct_').replace('backstop_', 'f.backstop_')} group by f.family_key, f.opening_count, f.direct_openings"""  # noqa: E731
    base = lambda a: f"from {{families}} where {TRUST_SQL[a[0]]} and {TARGET_SQL[a[1]]} and category in ({TECHS})"
    facet = lambda b: f"select 'company' as facet, company as value, count(*) as n {b} group by company union all select 'category', category, count(*) {b} group by category union all select * from (select 'remote' as facet, 'true' as value, count(*) as n {b} and locations ilike '%remote%') r where n > 0"
    shown = base(("verified", "default"))
    sql = {
        "feed_target": where(TARGET_ARGS, TARGET_SQL.get), "feed_trust": where(TRUST_ARGS, TRUST_SQL.get), "feed_search": where(SEARCH_ARGS, SEARCH_SQL.get),
        "feed_track": where(TRACK_ARGS, lambda a: f"category = '{a[0]}'" if a[0] else "true" if a[1] == "all" else f"category in ({TECHS})"),
        "feed_location": where(PLACE_ARGS, lambda a: f"len(list_filter({CODED}, lambda p: {PLACE_SQL[a]})) > 0"), "feed_company": where(COMPANY_ARGS, lambda a: f"company ilike '{a}'" if a else "true"),
        "feed_remote": where(("remote",), lambda a: "locations ilike '%remote%'"), "feed_posted_within": where(DAYS_ARGS, lambda a: f"latest_posted_at is not null and latest_posted_at >= {{as_of}} - to_days({a})"),
        "feed_order": united(SORTS, lambda s: f"row_number() over (order by {BY[s]}) as place, {keys} from {{families}}"),
        "keyset_page": united(KEY_ARGS, lambda k: f"{keys} from {{families}} where family_key > '{k}' order by family_key limit 100"),
        "search_rank": united(RANK_ARGS, lambda q: (lambda r: f"{r} as relevance, {keys} from {{families}} order by {r}, {BY['newest']} limit 100")(RANK_SQL.format(q=q, f=q.split()[0]))),
        "feed_page": paged(PAGE_ARGS, lambda a: "direct_openings > 0", BY["newest"], lambda a: f"limit {a[1]} offset {(a[0] - 1) * a[1]}"),
        "families_basic_search": paged(BASIC_ARGS, BASIC_SQL.get, "coalesce(latest_posted_at, first_detected_at) desc, family_key", lambda a: "limit 100"),
        "family_detail": united(TRUST_ARGS, detail),
        "facets": " union all ".join(f"(select '{str((t, g)).replace(chr(39), chr(39) * 2)}' as arg, * from ({facet(base((t, g)))}))" for t in TRUST_ARGS for g in ("default", "")),
        "export_family_index": f"""select f.family_key, f.company, f.title, f.category, f.season, f.year, f.target_match, f.locations, len({PLACES.replace('locations', 'f.locations')})::int as location_count, f.opening_count, f.direct_openings, f.backstop_openings, f.first_posted_at, f.latest_posted_at, f.posted_precision, f.first_detected_at, f.last_verified_at, f.locations ilike '%remote%' as remote,
          (row_number() over (partition by f.family_key order by {PLACES.replace('locations', 'a.locations')}, a.apply_url, a.identity) - 1)::int as nth, a.identity, a.apply_url, a.source_mode, a.latest_posted_at as opening_posted_at, a.locations as opening_locations, a.posting_key from {{families}} f join {{fold_applications}} a using (family_key) where f.category in ({TECHS})""",
        "export_preset_responses": " union all ".join([*(f"(select '/families?sort={s}' as request, family_key as item, (select count(*) {shown}) as n {shown} order by {BY[s]} limit 50)" for s in SORTS), f"(select '/facets' as request, facet || '=' || value as item, n from ({facet(shown)}))", *(f"(select '/stats' as request, '{k}' as item, {v} as n {shown})" for k, v in (("families", "count(*)"), ("listings", "coalesce(sum(direct_openings), 0)::bigint"), ("companies", "count(distinct company)")))]),
    }
    return {k: dialect.whole(v) for k, v in sql.items()}
