"""Landed payloads to postings_in: from_json over a union of the providers' shapes, explode, project.

`raw` has (source, company, body) and, for feeds with a clock, fetched_at. A body that is not
JSON gives no rows. Every job gives (source, company, source_id, title, apply_url, locations,
description, employment_type, posted_raw).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import urls as ux

PLACE = "struct<name:string,city:string,region:string,state:string,country:string>"
FIELDS = ("source_id", "title", "apply_url", "locations", "description", "employment_type", "posted_raw")
NO_TEXT = "cast(null as string)"
FLAT = "filter(array(nullif(concat_ws(', ', {0}.city, {0}.region, {0}.state, {0}.country), '')), v -> v is not null)"


@dataclass(frozen=True)
class Board:
    """The shape of a payload and where its jobs' fields stand; the first key that is not blank wins."""

    schema: str
    rows: str
    source_id: str
    title: str
    apply_url: str
    locations: str
    description: str = NO_TEXT
    employment_type: str = NO_TEXT
    posted_raw: str = NO_TEXT
    keep: str = "true"
    company: str = "company"


def first(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim({k}), '')" for k in keys) + ")"


def names(path: str) -> str:
    return f"filter(transform({path}, p -> p.name), n -> coalesce(n, '') <> '')"


WORKABLE = f"struct<id:string,shortcode:string,code:string,title:string,name:string,url:string,application_url:string,shortlink:string,location:{PLACE},city:string,state:string,country:string,description:string,description_plain:string,employment_type:string,type:string,published_at:string,created_at:string,createdAt:string>"
# The providers' key names.
BOARDS = {
    "ingest_greenhouse": Board(f"jobs array<struct<id:string,title:string,absolute_url:string,content:string,first_published:string,updated_at:string,offices:array<{PLACE}>,location:{PLACE}>>", "d.jobs", "job.id", first("job.title"), first("job.absolute_url"), f"case when size({names('job.offices')}) > 0 then {names('job.offices')} else filter(array(job.location.name), n -> n is not null) end", "job.content", posted_raw="job.first_published"),
    "ingest_lever": Board("value array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,descriptionPlain:string,categories:struct<location:string,commitment:string>>>", "d.value", "job.id", first("job.text"), first("job.hostedUrl", "job.applyUrl"), "filter(array(job.categories.location), n -> n is not null)", "job.descriptionPlain", "job.categories.commitment"),
    "ingest_ashby": Board("jobs array<struct<id:string,title:string,jobUrl:string,applyUrl:string,location:string,secondaryLocations:array<struct<location:string>>,descriptionPlain:string,descriptionHtml:string,employmentType:string,publishedAt:string>>", "d.jobs", first("job.id", "job.jobUrl"), first("job.title"), first("job.jobUrl", "job.applyUrl"), "filter(concat(array(job.location), coalesce(transform(job.secondaryLocations, p -> p.location), array())), n -> n is not null)", first("job.descriptionPlain", "job.descriptionHtml"), "job.employmentType", "job.publishedAt"),
    "ingest_smartrecruiters": Board(f"totalFound long, total long, content array<struct<id:string,uuid:string,refNumber:string,name:string,title:string,applyUrl:string,referralUrl:string,jobAdUrl:string,releasedDate:string,createdOn:string,createdAt:string,typeOfEmployment:string,employmentType:string,location:{PLACE}>>, postings array<struct<id:string,uuid:string,refNumber:string,name:string,title:string,applyUrl:string,referralUrl:string,jobAdUrl:string,releasedDate:string,createdOn:string,createdAt:string,typeOfEmployment:string,employmentType:string,location:{PLACE}>>", "coalesce(d.content, d.postings)", first("job.id", "job.uuid", "job.refNumber"), first("job.name", "job.title"), "coalesce(" + first("job.applyUrl", "job.referralUrl", "job.jobAdUrl") + ", concat('https://jobs.smartrecruiters.com/', split_part(source, ':', 2), '/', job.id))", FLAT.format("job.location"), employment_type=first("job.typeOfEmployment", "job.employmentType"), posted_raw=first("job.releasedDate", "job.createdOn", "job.createdAt")),
    "ingest_recruitee": Board(", ".join(f"{k} array<struct<id:string,slug:string,offer_id:string,title:string,name:string,careers_url:string,url:string,apply_url:string,location:{PLACE},city:string,state:string,country:string,description:string,description_plain:string,employment_type:string,contract_type:string,published_at:string,publishedAt:string,created_at:string>>" for k in ("offers", "content", "results")), "coalesce(d.offers, d.content, d.results)", first("job.id", "job.slug", "job.offer_id"), first("job.title", "job.name"), "coalesce(" + first("job.careers_url", "job.url", "job.apply_url") + ", concat('https://', split_part(source, ':', 2), '.recruitee.com/o/', " + first("job.id", "job.slug", "job.offer_id") + "))", "filter(array(nullif(coalesce(job.location.name, concat_ws(', ', coalesce(job.location.city, job.city), coalesce(job.location.region, job.state), coalesce(job.location.country, job.country))), '')), v -> v is not null)", first("job.description", "job.description_plain"), first("job.employment_type", "job.contract_type"), first("job.published_at", "job.publishedAt", "job.created_at")),
    "ingest_workable": Board(", ".join(f"{k} array<{WORKABLE}>" for k in ("jobs", "results", "content")) + f", data struct<jobs:array<{WORKABLE}>>", "coalesce(d.jobs, d.results, d.content, d.data.jobs)", first("job.shortcode", "job.code", "job.id"), first("job.title", "job.name"), "coalesce(" + first("job.url", "job.application_url", "job.shortlink") + ", concat('https://apply.workable.com/', split_part(source, ':', 2), '/j/', " + first("job.shortcode", "job.code", "job.id") + ", '/'))", "filter(array(nullif(coalesce(job.location.name, concat_ws(', ', coalesce(job.location.city, job.city), coalesce(job.location.region, job.state), coalesce(job.location.country, job.country))), '')), v -> v is not null)", first("job.description", "job.description_plain"), first("job.employment_type", "job.type"), first("job.published_at", "job.created_at", "job.createdAt")),
    "ingest_isolved": Board("success boolean, data struct<jobs:array<struct<id:string,title:string,url:string,location:string,startDate:string>>>", "case when d.success then d.data.jobs end", "job.id", first("job.title"), first("job.url"), "filter(array(job.location), n -> n is not null)", posted_raw="job.startDate"),
    "ingest_openroles": Board("value array<struct<i:string,c:string,ti:string,u:string,p:string,f:string,loc:string,s:int,r:int>>", "d.value", first("job.i", "job.u"), first("job.ti"), first("job.u"), "filter(array(nullif(trim(job.loc), '')), n -> n is not null)", posted_raw=first("job.p", "job.f"), keep="coalesce(job.s, 0) <> 1 and coalesce(job.r, 0) <> 1 and trim(job.c) <> ''", company="trim(job.c)"),
    "ingest_registry_json": Board("value array<struct<id:string,title:string,company_name:string,url:string,locations:array<string>,active:boolean,is_visible:boolean,date_posted:string>>", "d.value", first("job.id", "job.url"), first("job.title"), first("job.url"), "coalesce(job.locations, array())", posted_raw="job.date_posted", keep="coalesce(job.active, true) and coalesce(job.is_visible, true)", company="coalesce(nullif(trim(job.company_name), ''), company)"),
    "ingest_workday": Board("total int, jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "d.jobPostings", first("job.externalPath", "job.title"), first("job.title"), "concat('https://', split_part(source, ':', 2), '.myworkdayjobs.com', job.externalPath)", "filter(array(job.locationsText), n -> n is not null)", posted_raw="job.postedOn"),
}


def ingest(kind: str, raw: DataFrame) -> DataFrame:
    """Rows without title, link or id drop out, as do a board's repeated ids (the first stays)."""
    board = BOARDS[kind]
    body = F.concat(F.lit('{"value":'), F.col("body"), F.lit("}")) if board.rows == "d.value" else F.col("body")
    jobs = raw.select("source", "company", F.from_json(body, board.schema).alias("d")).select("source", "company", F.posexplode(F.expr(board.rows)).alias("at", "job")).filter(F.expr(board.keep))
    out = jobs.select("source", F.expr(board.company).alias("company"), "at", *(F.expr(getattr(board, f)).alias(f) for f in FIELDS)).filter(F.col("title").isNotNull() & F.col("apply_url").isNotNull() & F.col("source_id").isNotNull())
    nth = F.row_number().over(W.partitionBy("source", "source_id").orderBy("at", "title", "apply_url"))
    return out.withColumn("nth", nth).filter("nth = 1").drop("nth", "at")


def recent(postings: DataFrame, cutoff: Column) -> DataFrame:
    """Postings dated at or after the cutoff; what has no date that can be read is as good as old."""
    return postings.filter(rules.parse_iso_ts(F.col("posted_raw")) >= cutoff)


#: Spellings of the fields of a sensor's row; the first that is not blank wins.
SENSOR = "struct<id:string,job_id:string,source_id:string,company:string,company_name:string,employer:string,title:string,role:string,position:string,job_title:string,url:string,apply_url:string,job_url:string,application_url:string,location:string,locationsText:string,locations:array<string>,timing:string,date_posted:string,posted_at:string,first_seen_at:string,date_added:string,added:string,age:string,is_visible:boolean,is_open:boolean,active:boolean,season:string,cycle:string,terms:array<string>>"
WRAPPED = ("jobs", "listings", "items", "results", "data")


def sensor_rows(raw: DataFrame) -> DataFrame:
    """Rows of sensors' JSON (source, kind, cycle, body): a list, the values of a map (kind json-map), or a list under a known key.

    Closed and hidden rows, and rows of a mixed list for another cycle, drop out, as do rows without company,
    title or link. `cycle_text` is what a row says about its cycle.
    """
    alone = F.from_json(F.concat(F.lit('{"value":'), "body", F.lit("}")), f"value array<{SENSOR}>")["value"]
    within = F.from_json("body", ", ".join(f"{k} array<{SENSOR}>" for k in WRAPPED))
    listed = F.when(F.ltrim("body").startswith("["), alone).otherwise(F.coalesce(*(within[k] for k in WRAPPED)))
    every = F.when(F.col("kind") == "json-map", F.map_values(F.from_json("body", f"map<string,{SENSOR}>"))).otherwise(listed)
    one = raw.select("source", "cycle", F.posexplode(every).alias("at", "j")).filter("j is not null")
    pick = lambda *keys: F.expr(first(*(f"j.{k}" for k in keys)))
    places = F.filter(F.coalesce("j.locations", F.array(pick("location", "locationsText"))), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    rows = one.select(
        "source", "cycle", pick("company", "company_name", "employer").alias("company"), pick("title", "role", "position", "job_title").alias("title"), pick("url", "apply_url", "job_url", "application_url").alias("apply_url"), places.alias("locations"),
        pick("timing", "date_posted", "posted_at", "first_seen_at", "date_added", "added", "age").alias("posted_raw"), F.lower(F.coalesce(pick("season", "cycle"), F.array_join("j.terms", " "), F.lit(""))).alias("cycle_text"), F.coalesce("j.is_open", "j.active", F.lit(True)).alias("active"), F.coalesce("j.is_visible", F.lit(True)).alias("shown"),
        F.coalesce(pick("id", "job_id", "source_id"), ux.canonical_url(pick("url", "apply_url", "job_url", "application_url")), F.col("at").cast("string")).alias("source_id"),
    ).filter("active and shown and company is not null and title is not null and apply_url is not null")
    title = F.lower("title")
    for_2027 = F.col("cycle_text").contains("summer 2027") | title.contains("2027") & title.contains("intern") & ~title.rlike("fall|winter|spring")
    return rows.filter((F.col("cycle") != "mixed") | for_2027).drop("active", "shown")


def split_landings(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, discovery): links to whole boards are leads to crawl, not jobs."""
    landing = ux.is_board_landing(F.col("apply_url"))
    return postings.filter(~landing), postings.filter(landing)


#: Where paged boards say how many jobs they have; rows that one search can give at most.
TOTALS = {"ingest_smartrecruiters": "coalesce(d.totalFound, d.total)", "ingest_workday": "d.total"}
SEARCH_CAP = 2000


def board_snapshots(kind: str, raw: DataFrame) -> DataFrame:
    """(source, company, body), a row a page of a paged board, to (source, rows_scanned, expected, complete, status).

    A board is complete if its pages hold as many rows as the largest total that they give; one that shows as many
    rows as a search can give at most is not, whatever it says, nor is one that gives no total.
    """
    board = BOARDS[kind]
    d = raw.select("source", F.from_json("body", board.schema).alias("d"))
    return completeness(d.select("source", F.coalesce(F.expr(f"size({board.rows})"), F.lit(0)).alias("rows"), F.expr(TOTALS[kind]).cast("long").alias("total")), SEARCH_CAP)


def completeness(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """(source, rows, total) of result pages to (source, rows_scanned, expected, complete, status)."""
    out = pages.groupBy("source").agg(F.sum(F.greatest("rows", F.lit(0))).cast("long").alias("rows_scanned"), F.max("total").alias("expected"))
    whole = F.coalesce(F.col("rows_scanned") >= F.col("expected"), F.lit(False))
    whole = whole & (F.col("expected") < cap) if cap else whole
    return out.withColumn("complete", F.coalesce(whole, F.lit(False))).withColumn("status", F.when(F.col("complete"), "ok").otherwise("truncated"))


def chosen_chunks(manifest: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """(value), the JSON of one manifest, newest chunk first, to (place, file, posted_max) of those to read.

    A dated chunk that ends before the cutoff stops the list, as all behind it are older; undated ones do not. At most
    `most` are taken; entries without a file do not count.
    """
    parsed = F.from_json("value", "slim_index_chunks array<struct<file:string,posted_max:string>>")["slim_index_chunks"]
    each = manifest.select(F.posexplode(parsed).alias("at", "chunk")).select("at", "chunk.file", rules.parse_iso_ts(F.col("chunk.posted_max")).alias("posted_max")).filter("file <> ''")
    # One manifest is one list: what is numbered are its entries, not postings.
    order = W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    stopped = F.max(F.when(F.col("posted_max") < cutoff, 1).otherwise(0)).over(order)
    return each.withColumns({"stopped": stopped, "place": F.row_number().over(W.orderBy("at"))}).filter((F.col("stopped") == 0) & (F.col("place") <= most)).select("place", "file", "posted_max")


def chunk_postings(spark: SparkSession, root: str, manifest: DataFrame, cutoff: Column, most: int, source: str = "sensor:openroles-recent") -> DataFrame:
    """Recent postings of the chunks that the manifest leaves; the others are never opened. Files may be gzipped."""
    files = [f"{root}/{r.file}" for r in chosen_chunks(manifest, cutoff, most).select("file").collect()]
    text = spark.read.text(files, wholetext=True) if files else spark.createDataFrame([], "value string")
    raw = text.select(F.lit(source).alias("source"), F.lit("").alias("company"), F.col("value").alias("body"))
    return recent(ingest("ingest_openroles", raw), cutoff)
