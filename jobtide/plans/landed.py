"""Ingest queries: payloads are built from the tables as JSON, then read as a provider's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import INTERN, PROGRAM, SUMMER_2027, YEAR
from ..operators import postings as ops
from ..operators import providers, selection
from ..sources import ingest, trees
from ..sources.fixtures import VIEWS, view
from ..sources.shared import shared
from .scalars import BARE, CANON, SCALARS

c = F.col
#: Rows a board: a payload has a fixed size, and their number grows with the tables.
ROWS = 200
BOARD = f"cast(floor(id / {ROWS}) as int)"
#: How providers spell a row of fx_texts, the texts before and after the list of jobs by board (the first whose number divides it).
SHAPES = {
    "ingest_greenhouse": ([('{"jobs":', "}")], "named_struct('id', id, 'title', title, 'absolute_url', url, 'first_published', age, 'offices', array(named_struct('name', name)))"),
    "ingest_lever": ([("", "")], "named_struct('id', id, 'text', title, 'applyUrl', url, 'categories', named_struct('location', name, 'commitment', reason))"),
    "ingest_ashby": ([('{"jobs":', "}")], "named_struct('id', id, 'title', title, 'jobUrl', url, 'location', name, 'employmentType', reason, 'publishedAt', age)"),
    "ingest_smartrecruiters": ([('{"totalFound":9,"content":', "}"), ('{"total":9,"postings":', "}")], "named_struct('uuid', id, 'name', title, 'jobAdUrl', url, 'typeOfEmployment', reason, 'location', named_struct('city', name), 'releasedDate', case when n % 2 = 0 then age end, 'createdAt', age)"),
    "ingest_recruitee": ([('{"offers":', "}"), ('{"content":', "}"), ('{"results":', "}")], "named_struct('offer_id', id, 'title', title, 'apply_url', case when n % 3 = 0 then url end, 'careers_url', case when n % 3 <> 0 then url end, 'city', case when n % 2 = 0 then name end, 'location', case when n % 2 = 1 then named_struct('city', name) end, 'contract_type', reason, 'publishedAt', age)"),
    "ingest_workable": ([('{"jobs":', "}"), ('{"results":', "}"), ('{"content":', "}"), ('{"data":{"jobs":', "}}")], "named_struct('code', id, 'title', title, 'shortlink', url, 'type', reason, 'location', named_struct('country', name), 'createdAt', age)"),
    "ingest_isolved": ([('{"success":true,"data":{"jobs":', "}}")], "named_struct('id', id, 'title', title, 'url', url, 'location', name, 'startDate', age)"),
}
TYPED = ("ingest_lever", "ingest_ashby", "ingest_smartrecruiters", "ingest_recruitee", "ingest_workable")
UNDATED = ("ingest_lever",)
URL = "concat('https://jobs.example.com/', cast(id as string))"
CUTOFF = "timestamp '2001-07-01 00:00:00'"


def rows_of(spark, sf_dir, name="fx_texts"):
    return view(spark, sf_dir, name).withColumn("board", F.expr(BOARD))


def gathered(rows, row, wraps):
    """(board, body): the rows of each board as a list of JSON, between the texts of its kind."""
    lists = rows.groupBy("board").agg(F.to_json(F.collect_list(F.expr(row))).alias("jobs"))
    nth = c("board") % len(wraps)
    before, after = (F.element_at(F.array(*(F.lit(w[i]) for w in wraps)), nth + 1) for i in (0, 1))
    return lists.select("board", F.concat(before, "jobs", after).alias("body"))


def payloads(spark, sf_dir, kind):
    """(source, company, body) of each board."""
    wraps, row = SHAPES[kind]
    rows = rows_of(spark, sf_dir).withColumn("url", F.expr(URL)).withColumn("id", c("id").cast("string"))
    return gathered(rows, row, wraps).select(F.concat(F.lit(kind.removeprefix("ingest_") + ":"), c("board").cast("string")).alias("source"), F.lit("Acme").alias("company"), "body")


def _ingest(kind):
    def run(spark, sf_dir):
        got = ingest.ingest(kind, payloads(spark, sf_dir, kind))
        return got.select("source", "source_id", "title", "apply_url", F.array_join("locations", "|").alias("locations"), "employment_type", "posted_raw")

    return run


def _oracle(kind):
    typed = "reason" if kind in TYPED else "cast(null as varchar)"
    dated = "cast(null as varchar)" if kind in UNDATED else "age"
    return f"with fx_texts as ({VIEWS['fx_texts']}) select '{kind.removeprefix('ingest_')}:' || (id // {ROWS}) as source, id::varchar as source_id, trim(title) as title, 'https://jobs.example.com/' || id as apply_url, name as locations, {typed} as employment_type, {dated} as posted_raw from fx_texts"


DAY = "concat('2001-', case when id % 2 = 0 then '06' else '07' end, '-', lpad(cast(n % 28 + 1 as string), 2, '0'), 'T00:00:00Z')"


def _openroles(spark, sf_dir):
    row = f"named_struct('i', cast(id as string), 'c', company, 'ti', title, 'u', {URL}, 'loc', name, 'p', case when id % 5 <> 0 then {DAY} end, 'f', case when id % 5 = 0 and id % 2 = 1 then {DAY} end, 's', cast(id % 7 = 0 as int), 'r', cast(id % 11 = 0 as int))"
    raw = gathered(rows_of(spark, sf_dir), row, [("", "")]).select(F.lit("sensor:openroles").alias("source"), F.lit("").alias("company"), "body")
    return ingest.recent(ingest.ingest("ingest_openroles", raw), F.expr(CUTOFF)).select("source_id", "company", "title", "apply_url", "posted_raw")


def _registry(spark, sf_dir):
    row = "named_struct('id', cast(id as string), 'title', label, 'company_name', kind, 'url', url, 'locations', array(label), 'date_posted', cast(n as string), 'active', n % 5 <> 0, 'is_visible', n % 7 <> 0)"
    raw = gathered(rows_of(spark, sf_dir, "fx_links"), row, [("", "")]).select(F.concat(F.lit("registry:"), "board").alias("source"), F.lit("List").alias("company"), "body")
    jobs, boards = ingest.split_landings(ingest.ingest("ingest_registry_json", raw))
    shown = ("source", "source_id", "company", "title", "apply_url", "posted_raw")
    return jobs.select(F.lit("posting").alias("part"), *shown).unionByName(boards.select(F.lit("discovery").alias("part"), *shown))


def _sensor_json(spark, sf_dir):
    """Boards in turn: a list, a list under a key, a map; every third one is of several cycles."""
    rows = rows_of(spark, sf_dir).withColumn("url", F.expr(URL))
    job = "named_struct('job_id', case when n % 2 = 0 then cast(id as string) end, 'employer', concat('Firm ', n), 'role', title, 'apply_url', url, 'location', name, 'date_added', age, 'is_open', id % 9 <> 0, 'is_visible', id % 10 <> 0, 'terms', array(case when n % 4 = 0 then 'Summer 2027' else 'Fall 2026' end))"
    lists = gathered(rows.filter(c("board") % 3 < 2), job, [("", ""), ('{"listings":', "}")])
    maps = rows.filter(c("board") % 3 == 2).groupBy("board").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(c("id").cast("string"), F.expr(job))))).alias("body"))
    raw = lists.unionByName(maps).select(F.concat(F.lit("sensor:"), "board").alias("source"), F.when(c("board") % 3 == 2, "json-map").otherwise("json").alias("kind"), F.when(c("board") % 2 == 0, "summer-2027").otherwise("mixed").alias("cycle"), "body")
    found = ingest.sensor_rows(raw)
    sorted_ = ops.classify_postings(found.withColumn("source_mode", F.lit("market-sensor")).withColumn("source_confirms", c("cycle") == "summer-2027"))
    specs = raw.select("source", "cycle")
    return selection.stamped(sorted_.drop("cycle"), specs).select("source", "source_id", "company", "apply_url", "posted_raw", "year", "season", "target_match")


def _sitemap(spark, sf_dir):
    """Sitemaps in turn, with a namespace and without, torn, or listed by an index for every ten of them."""
    rows = rows_of(spark, sf_dir, "fx_links")
    kind = c("board") % 3
    dated = F.concat(F.lit("lastmod>2001-07-"), F.lpad((c("n") % 28 + 1).cast("string"), 2, "0"))

    def entry(ns):
        return F.concat(F.lit(f"<{ns}url><{ns}loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(f"</{ns}loc>"), F.when(c("n") % 3 > 0, F.concat(F.lit(f"<{ns}"), dated, F.lit(f"</{ns}lastmod>"))).otherwise(""), F.lit(f"</{ns}url>"))

    parts = rows.groupBy("board").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.when(kind == 1, entry("sm:")).otherwise(entry("")).alias("e")))), lambda x: x["e"]), "").alias("items"))
    before = F.when(kind == 1, '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">').otherwise('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
    docs = parts.select(c("board").cast("string").alias("url"), F.concat(before, "items", F.when(kind == 1, "</sm:urlset>").when(kind == 0, "</urlset>").otherwise("</url>")).alias("body"))
    lists = parts.select((c("board") / 10).cast("int").alias("tenth"), "board").groupBy("tenth").agg(F.array_join(F.transform(F.array_sort(F.collect_list("board")), lambda b: F.concat(F.lit("<sm:sitemap><sm:loc>"), b.cast("string"), F.lit("</sm:loc></sm:sitemap>"))), "").alias("items"))
    indexes = lists.select(F.concat(F.lit("index-"), "tenth").alias("url"), F.concat(F.lit('<sm:sitemapindex xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9">'), "items", F.lit("</sm:sitemapindex>")).alias("body"))
    return trees.sitemap_pages(docs.unionByName(indexes))


PAGE = 50


def _completeness(spark, sf_dir):
    """Boards of two providers in pages of 50; in turn a board gives its own size as total, five more, or none."""
    rows, out = rows_of(spark, sf_dir).withColumn("page", F.floor(c("id") / PAGE)), None
    sizes = rows.groupBy("board").agg(F.count("*").alias("size"))
    total = F.when(c("board") % 3 == 0, c("size")).when(c("board") % 3 == 1, c("size") + 5)
    shapes = {"ingest_smartrecruiters": ("totalFound", "content", "named_struct('id', cast(id as string), 'name', title)"), "ingest_workday": ("total", "jobPostings", "named_struct('title', title, 'externalPath', cast(id as string))")}
    for kind, (said, list_, row) in shapes.items():
        pages = rows.groupBy("board", "page").agg(F.collect_list(F.expr(row)).alias(list_)).join(sizes, "board")
        body = F.to_json(F.struct(total.alias(said), list_))
        raw = pages.select(F.concat(F.lit(kind.removeprefix("ingest_") + ":"), "board").alias("source"), F.lit("Acme").alias("company"), body.alias("body"))
        one = ingest.board_snapshots(kind, raw)
        out = one if out is None else out.unionByName(one)
    return out


CHUNK_ROWS, CHUNKS = 100, 40
CHUNK = f"cast(floor(id / {CHUNK_ROWS}) as int)"


def _chunks(spark, sf_dir):
    """Chunks of 100 rows as files, newest first, three days apart, every fourth undated; the manifest says what to read."""
    root = shared(spark, "chunks")
    row = f"named_struct('i', cast(id as string), 'c', company, 'ti', title, 'u', {URL}, 'p', {DAY})"
    chunks = view(spark, sf_dir, "fx_texts").groupBy(F.expr(CHUNK).alias("chunk")).agg(F.to_json(F.collect_list(F.expr(row))).alias("body"))
    chunks.repartition("chunk").write.partitionBy("chunk").text(f"{root}/files")
    entry = F.struct(F.concat(F.lit("chunk="), "chunk").alias("file"), F.when(c("chunk") % 4 != 3, F.date_format(F.date_sub(F.lit("2001-07-31").cast("date"), c("chunk") * 3), "yyyy-MM-dd'T'00:00:00'Z'")).alias("posted_max"))
    manifest = chunks.select("chunk").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("chunk", entry.alias("e")))), lambda x: x["e"]).alias("slim_index_chunks"))).alias("value"))
    return ingest.chunk_postings(spark, f"{root}/files", manifest, F.expr(CUTOFF), CHUNKS).select("source_id", "title", "posted_raw")


NEW_PROVIDERS = (("example.com", "own-board", 900), ("acme.co.uk", "acme", 901), ("zon.", "amazon", 902))


def _providers(spark, sf_dir):
    """Kinds of links by the fixed table and three rows more, one of them a fragment before a dot."""
    known = providers.registry(spark).unionByName(spark.createDataFrame(list(NEW_PROVIDERS), "fragment string, kind string, place int"))
    return providers.with_kinds(view(spark, sf_dir, "fx_links").select("id", "url"), "url", known).select("id", "provider")


def queries() -> dict:
    return {k: _ingest(k) for k in SHAPES} | {
        "ingest_openroles": _openroles, "ingest_registry_json": _registry, "ingest_sensor_json": _sensor_json, "ingest_sitemap": _sitemap,
        "completeness": _completeness, "prune_dated_chunks": _chunks, "provider_registry": _providers,
    }


def oracle() -> dict[str, str]:
    texts, links = f"with fx_texts as ({VIEWS['fx_texts']}) ", f"with fx_links as ({VIEWS['fx_links']}) "
    hit = lambda p: f"regexp_matches(title, '(?i){p}')"
    landing = SCALARS["is_board_landing"][2]["landing"][1]
    evidence, years = f"({hit(INTERN)} or {hit(PROGRAM)})", f"list_distinct(regexp_extract_all(title, '{YEAR}'))"
    return {k: _oracle(k) for k in SHAPES} | {
        "ingest_openroles": texts + f"select id::varchar as source_id, trim(company) as company, trim(title) as title, {URL} as apply_url, {DAY} as posted_raw from fx_texts where id % 7 <> 0 and id % 11 <> 0 and trim(company) <> '' and (id % 5 <> 0 or id % 2 = 1) and {DAY} >= '2001-07-01'",
        "ingest_registry_json": links + f"select case when {landing} then 'discovery' else 'posting' end as part, 'registry:' || (id // {ROWS}) as source, id::varchar as source_id, kind as company, trim(label) as title, trim(url) as apply_url, n::varchar as posted_raw from fx_links where n % 5 <> 0 and n % 7 <> 0",
        "ingest_sensor_json": texts + f"""select 'sensor:' || board as source, case when n % 2 = 0 then id::varchar else (select {CANON} from (select apply_url as url)) end as source_id, company, apply_url, posted_raw, case when stamp then 2027 when list_contains(years, '2027') then 2027 when len(years) = 1 then years[1]::int end as year, case when stamp then 'summer' else season end as season, case when stamp then 'source_confirmed' else match end as target_match from
          (select *, match = 'unknown' and (board % 2 = 0 or n % 4 = 0) as stamp from (select *, case when not {evidence} then 'not_internship' when list_contains(years, '2027') and season = 'summer' or {hit(SUMMER_2027)} then 'exact' when len(years) > 0 and not list_contains(years, '2027') then 'wrong_year' when list_contains(years, '2027') and season <> 'summer' then 'wrong_season' when len(years) = 1 and season is null then 'year_confirmed' when board % 2 = 0 and len(years) = 0 and season = 'summer' then 'source_confirmed' else 'unknown' end as match
          from (select id, n, title, id // {ROWS} as board, 'Firm ' || n as company, {URL} as apply_url, age as posted_raw, {years} as years, case when {hit('summer')} then 'summer' when {hit('fall')} then 'fall' end as season from fx_texts where id % 9 <> 0 and id % 10 <> 0 and (id // {ROWS} % 2 = 0 or n % 4 = 0 or contains(title, '2027') and title ilike '%intern%' and not title ilike '%fall%'))))""",
        "completeness": texts + f"""select kind || ':' || board as source, n as rows_scanned, case board % 3 when 0 then n when 1 then n + 5 end as expected, board % 3 = 0 and n < 2000 as complete, case when board % 3 = 0 and n < 2000 then 'ok' else 'truncated' end as status
          from (select id // {ROWS} as board, count(*) as n from fx_texts group by 1), (select unnest(['smartrecruiters', 'workday']) as kind)""",
        # Dated chunks end three days apart; the first that ends before the cutoff, and what follows, stays unread.
        "prune_dated_chunks": texts + f"""select id::varchar as source_id, trim(title) as title, {DAY} as posted_raw from fx_texts, (select coalesce(min(k), 999999999) as stop from range(100000) r(k) where k % 4 <> 3 and date '2001-07-31' - (k * 3)::int < date '2001-07-01')
          where id // {CHUNK_ROWS} < least(stop, {CHUNKS}) and trim(company) <> '' and {DAY} >= '2001-07-01'""",
        "provider_registry": links + f"select id, coalesce({SCALARS['provider_kind'][2]['provider'][1]}, case when {BARE} = 'example.com' or {BARE} like '%.example.com' then 'own-board' when {BARE} = 'acme.co.uk' or {BARE} like '%.acme.co.uk' then 'acme' when contains({BARE}, 'zon.') then 'amazon' end) as provider from fx_links",
        "ingest_sitemap": links + f"""select 'index-' || (board // 10) as listed_by, board::varchar as url, loc, mod_ as lastmod, row_number() over (partition by board order by mod_ is null, mod_ desc, id) as place
          from (select board, loc, mod_, id from (select *, trim(url) as loc, id // {ROWS} as board, case when n % 3 > 0 then '2001-07-' || lpad((n % 28 + 1)::varchar, 2, '0') end as mod_ from fx_links) where board % 3 < 2 qualify row_number() over (partition by board, loc order by mod_ is null, mod_ desc, id) = 1)""",
    }
