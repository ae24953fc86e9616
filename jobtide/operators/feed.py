"""The feed: filters, orders, pages and counts over role families, by the caller's arguments.

Families have family_key, company, title, category, season, year, target_match, `places` (an array),
opening_count, direct_openings, backstop_openings, latest_posted_at, posted_precision,
first_detected_at and last_verified_at; those with `openings` (an array of structs with identity,
apply_url, source_mode, posted_at and places) can be shown by trust. An empty argument filters nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import INDEX_MODES, TARGETS, TECH
from ..sources import publish
from .ranks import numbered

c = F.col


def by_target(families: DataFrame, target: str) -> DataFrame:
    """exact: summer 2027; default and year_confirmed: 2027; another: that target match."""
    if target == "exact":
        return families.filter((c("year") == 2027) & (F.lower(F.coalesce("season", F.lit(""))) == "summer"))
    if target in ("default", "year_confirmed"):
        return families.filter(c("year") == 2027)
    return families.filter(c("target_match") == target) if target else families


def by_track(families: DataFrame, category: str = "", track: str = "tech") -> DataFrame:
    if category:
        return families.filter(c("category") == category)
    return families if track == "all" else families.filter(c("category").isin(*TECH))


def by_trust(families: DataFrame, trust: str) -> DataFrame:
    if trust == "all":
        return families
    return families.filter((c("direct_openings") == 0) & (c("backstop_openings") > 0) if trust == "leads" else c("direct_openings") > 0)


def holds(column: Column, text: str) -> Column:
    """Whether the text stands in the column, whatever the case; never a pattern."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def by_search(families: DataFrame, query: str) -> DataFrame:
    """Each token stands in the company, the title or the places."""
    for token in query.split():
        families = families.filter(holds(c("company"), token) | holds(c("title"), token) | holds(F.array_join("places", " "), token))
    return families


def by_location(families: DataFrame, place: str) -> DataFrame:
    """A code of two letters is a whole place or ends one after a comma; other text may stand anywhere in it."""
    if re.fullmatch("[A-Za-z]{2}", place):
        return families.filter(F.exists("places", lambda p: (p == place.upper()) | F.endswith(F.lower(p), F.lit(f", {place.lower()}"))))
    return families.filter(F.exists("places", lambda p: holds(p, place)))


def by_company(families: DataFrame, company: str) -> DataFrame:
    return families.filter(F.lower("company") == company.lower()) if company else families


def remote_only(families: DataFrame) -> DataFrame:
    return by_location(families, "remote")


def posted_within(families: DataFrame, days: int, as_of: str) -> DataFrame:
    """By the employer's own date; the time of first detection never stands in for it."""
    return families.filter(c("latest_posted_at") >= F.expr(f"{as_of} - interval {int(days)} days"))


def activity() -> Column:
    """The time shown: to the second only where the employer gave one."""
    found, day = F.date_trunc("hour", "first_detected_at"), F.date_trunc("day", "latest_posted_at")
    return F.when(c("latest_posted_at").isNull(), found).when(c("posted_precision") == "timestamp", c("latest_posted_at")).otherwise(day)


def order_of(sort: str) -> list[Column]:
    """newest, verified or company; each ends in the key, so places are certain."""
    verified = F.when(c("direct_openings") > 0, 0).otherwise(1)
    if sort == "company":
        return [F.lower("company"), F.lower("title"), c("family_key")]
    if sort == "verified":
        return [verified, c("last_verified_at").desc_nulls_last(), activity().desc(), c("family_key")]
    precision = F.when(c("posted_precision") == "timestamp", 0).when(c("posted_precision") == "day", 1).otherwise(2)
    return [activity().desc(), verified, precision, c("last_verified_at").desc_nulls_last(), c("family_key")]


def ordered(families: DataFrame, sort: str) -> DataFrame:
    return numbered(families, *order_of(sort))


def relevance(query: str) -> Column:
    """0 to 5: the company is the query, is its first word, starts with either, the title holds it, none."""
    if not query:
        return F.lit(5)
    name, whole, first = F.lower("company"), query.lower(), query.split()[0].lower()
    return F.when(name == whole, 0).when(name == first, 1).when(name.startswith(whole), 2).when(name.startswith(first), 3).when(F.contains(F.lower("title"), F.lit(whole)), 4).otherwise(5)


def page_of(families: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page, each row with the total of all pages."""
    total = families.agg(F.count("*").alias("total"))
    return families.orderBy(*order).offset(max(0, page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def page_after(families: DataFrame, last_key: str, size: int) -> DataFrame:
    return families.filter(c("family_key") > last_key).orderBy("family_key").limit(size)


#: Ranges of keys in which a stored index is cut.
RANGES = 32


def store_index(families: DataFrame, root: str, n: int = RANGES) -> bool:
    """Publish families in ranges of their keys, each sorted; the version's note says what key each range begins and ends with, and its rows."""
    spark = families.sparkSession
    dealt = families.repartitionByRange(n, "family_key").withColumn("range_", F.spark_partition_id()).sortWithinPartitions("family_key")
    part, _ = publish.staged(dealt, root, "range_", keep_partitions=True)
    one = publish.Version(tables={"index": part})
    # One row a range.
    ends = publish.read_with(spark, one, "index", "range_").groupBy("range_").agg(F.min("family_key").alias("first"), F.max("family_key").alias("last"), F.count("*").alias("n")).orderBy("first").collect()
    note = {"ranges": [[str(r.range_), r["first"], r["last"], r.n] for r in ends]}
    return publish.commit(spark, root, publish.newest(spark, root), {"index": part}, note)


def stored_page_after(spark: SparkSession, root: str, last_key: str, size: int) -> DataFrame:
    """The page behind a key from a stored index: only the ranges that can hold it are read."""
    version, wanted, rows = publish.newest(spark, root), [], 0
    for name, first, last, n in version.note["ranges"]:
        if last > last_key and rows < size:
            wanted.append(name)
            # What of the range a key lies in is behind it is not known; every later range counts in full.
            rows += n if first > last_key else 0
    return page_after(publish.read(spark, version, "index", wanted), last_key, size)


def basic_search(families: DataFrame, query: str = "", category: str = "", target: str = "default") -> DataFrame:
    """One text in company, title or places; the default targets or one."""
    found = families.filter(c("target_match").isin(*TARGETS)) if target == "default" else by_target(families, target)
    found = found.filter(c("category") == category) if category else found
    return found.filter(holds(c("company"), query) | holds(c("title"), query) | holds(F.array_join("places", " "), query)) if query else found


def sorted_places(places: Column) -> Column:
    return F.array_sort(F.array_distinct(places))


def shown(families: DataFrame, trust: str) -> DataFrame:
    """Families as they are shown: openings by trust (verified: direct; leads: index modes), counts and places of those."""
    keep = {"verified": lambda o: o["source_mode"] == "direct", "leads": lambda o: o["source_mode"].isin(*INDEX_MODES)}.get(trust, lambda o: F.lit(True))
    kept = families.withColumn("openings", F.filter("openings", keep))
    count = c("opening_count") if trust == "all" else F.size("openings").cast("long")
    own = F.flatten(F.transform("openings", lambda o: o["places"]))
    places = sorted_places(F.when(F.size(own) > 0, own).otherwise(c("places")))
    kept = kept.withColumns({"opening_count": count, "places": places, "verified": c("direct_openings") > 0})
    return kept.withColumns({"location_count": F.size("places"), "quality": F.when(c("verified"), "verified").otherwise("lead")})


def facets(families: DataFrame) -> DataFrame:
    """(facet, value, n, place): companies and categories by count, and how many are remote; one pass over the families."""
    remote = F.exists("places", lambda p: holds(p, "remote"))
    named = families.select(F.explode(F.array(F.struct(F.lit("company").alias("facet"), c("company").alias("value")), F.struct(F.lit("category").alias("facet"), c("category").alias("value")), F.when(remote, F.struct(F.lit("remote").alias("facet"), F.lit("true").alias("value"))))).alias("f"))
    return named.filter("f is not null").groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
