"""What to read, check or show next: filters, stamps, batches and rotating slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import INDEX_MODES, NON_APPLICATION_HOSTS, TARGETS
from ..functions import urls as ux
from .ranks import numbered, numbered_within

c = F.col
FAST_BOARDS = ("boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com")


def mixed_cycle(rows: DataFrame) -> DataFrame:
    """Open rows of a list of several cycles that are for summer 2027, by their cycle's text or their title."""
    cycle, title = F.lower(F.coalesce("cycle_text", F.lit(""))), F.lower("title")
    other = reduce(lambda a, b: a | b, (title.contains(s) for s in ("fall", "winter", "spring")))
    return rows.filter(F.coalesce("active", F.lit(True)) & (cycle.contains("summer 2027") | title.contains("2027") & title.contains("intern") & ~other))


def stamped(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of unknown cycle that their source's spec dates: all of a summer list, or those whose own text says so in a mixed one."""
    met = rows.join(specs.select(c("source").alias("of"), "cycle"), c("source") == c("of"), "left")
    said = (c("cycle") == "summer-2027") | (c("cycle") == "mixed") & F.lower(F.coalesce("cycle_text", F.lit(""))).contains("summer 2027")
    hit = (c("target_match") == "unknown") & F.coalesce(said, F.lit(False))
    pick = lambda x, new: F.when(hit, new).otherwise(c(x))
    return met.withColumns({"year": pick("year", 2027), "season": pick("season", "summer"), "target_match": pick("target_match", "source_confirmed")}).drop("of", "cycle")


def label_changes(corpus: DataFrame, postings: DataFrame) -> DataFrame:
    """(posting_key, field, expected, found) wherever a fresh label differs from the frozen one."""
    met = corpus.alias("f").join(postings.alias("p"), "posting_key")
    fields = ("category", "target_match", "season")
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), c(f"f.{x}").alias("expected"), c(f"p.{x}").alias("found")) for x in fields)))
    return met.select("posting_key", each.alias("d")).select("posting_key", "d.*").filter(~c("expected").eqNullSafe(c("found")))


def batches(leads: DataFrame, size: int) -> DataFrame:
    """Adds `batch`: leads of one company and host in runs of `size`, the newest first."""
    placed = numbered_within(leads.withColumn("host", ux.host(c("url"))), ["company", "host"], c("posted_at").desc_nulls_last(), c("posting_key"))
    return placed.withColumn("batch", F.floor((c("place") - 1) / size) + 1).drop("place")


def retryable(leads: DataFrame, as_of: Column, hours: int, minutes: int, n: int) -> DataFrame:
    """Leads first seen within `hours` whose check failed at least `minutes` ago."""
    ok = c("active") & c("source_mode").isin(*INDEX_MODES) & c("target_match").isin(*TARGETS) & (c("first_seen_at") >= as_of - F.expr(f"interval {int(hours)} hours"))
    tried = c("link_status").isin("blocked", "error", "unverified", "checking") & (c("link_checked_at") <= as_of - F.expr(f"interval {int(minutes)} minutes"))
    return leads.filter(ok & tried).orderBy(c("first_seen_at").desc(), "link_checked_at", "posting_key").limit(n)


def rotated(rows: DataFrame, key: str, n: int, slot: int) -> DataFrame:
    """The slot's n rows of a fixed shuffled order that ends where it begins; all rows, if they are no more than n."""
    placed = numbered(rows, F.sha2(c(key), 256), c(key))
    size = placed.agg(F.count("*").alias("size_"))
    start = F.lit(slot * n) % c("size_")
    return placed.crossJoin(F.broadcast(size)).filter((c("size_") <= n) | (F.pmod(c("place") - 1 - start, c("size_")) < n)).drop("place", "size_")


def verification_plan(sensors: DataFrame, durable: DataFrame, pages: int, boards: int, slot: int, cap: int) -> DataFrame:
    """(lane, name): cheap boards; the newest dated pages of other hosts, then undated ones in turn; slow boards in turn.

    Pages of hosts where nobody can apply are no evidence. A name counts once, in its first lane.
    """
    seen = sensors.select(c("url"), F.coalesce("posted_at", "sensor_at").alias("at"))
    both = seen.select("url").unionByName(durable.select("url")).distinct().withColumn("host", ux.host(c("url")))
    fast = both.filter(c("host").isin(*FAST_BOARDS)).select(F.concat_ws(":", "host", F.lower(F.try_element_at(ux.segments(c("url")), F.lit(1)))).alias("name")).distinct()
    slow = both.filter(c("host").endswith(".myworkdayjobs.com")).select(F.concat(F.lit("workday:"), "host").alias("name")).distinct()
    other = seen.withColumn("host", ux.host(c("url"))).filter((c("host") != "") & ~c("host").isin(*FAST_BOARDS, *NON_APPLICATION_HOSTS))
    hot = other.groupBy("url").agg(F.max("at").alias("at"))
    dated = hot.filter("at is not null").orderBy(c("at").desc(), "url").limit(pages)
    left = F.greatest(F.lit(0), F.lit(pages) - F.count("*")).alias("left_")
    undated = numbered(hot.filter("at is null"), F.sha2("url", 256), c("url")).crossJoin(F.broadcast(dated.agg(left)))
    undated = undated.crossJoin(F.broadcast(hot.filter("at is null").agg(F.count("*").alias("size_")))).filter((c("left_") > 0) & ((c("size_") <= c("left_")) | (F.pmod(c("place") - 1 - F.lit(slot) * c("left_") % c("size_"), c("size_")) < c("left_"))))
    lanes = [fast.withColumn("lane", F.lit(1)), dated.select(c("url").alias("name"), F.lit(2).alias("lane")), undated.select(c("url").alias("name"), F.lit(2).alias("lane")), rotated(slow, "name", boards, slot).withColumn("lane", F.lit(3))]
    planned = reduce(DataFrame.unionByName, lanes).groupBy("name").agg(F.min("lane").alias("lane"))
    return planned.orderBy("lane", "name").limit(cap)


def shard_of(name: Column, shards: int) -> Column:
    """The first 16 hex digits of the name's SHA-1, modulo the shards."""
    return F.pmod(F.conv(F.substring(F.sha1(name), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(shards)).cast("int")


def census_shard(census: DataFrame, shards: int, index: int) -> DataFrame:
    """(name, kind) of the two small providers' boards in one shard."""
    kind = F.when(c("source").startswith("domain:isolvedhire:"), "isolvedhire").when(c("source").startswith("domain:jazzhr:"), "jazzhr")
    name = F.concat_ws(":", kind, F.split_part("source", F.lit(":"), F.lit(3)))
    return census.filter(kind.isNotNull()).select(name.alias("name"), kind.alias("kind")).distinct().filter(shard_of(c("name"), shards) == index)


def direct_boards(fresh: DataFrame, durable: DataFrame, schema: int, workday: int, cap: int) -> DataFrame:
    """(name, kind, origin): boards of this run and remembered ones, the former's evidence first; caps by kind."""
    both = durable.select("name", "scope", F.lit(1).alias("rank"), F.lit("durable").alias("origin")).unionByName(fresh.select("name", "scope", F.lit(0).alias("rank"), F.lit("fresh").alias("origin"))).filter(~c("scope").eqNullSafe("historical"))
    one = both.groupBy("name").agg(F.min_by("origin", "rank").alias("origin"))
    prefix = F.split_part("name", F.lit(":"), F.lit(1))
    one = one.withColumn("kind", F.when(prefix.isin("greenhouse", "lever", "ashby"), "board").when(prefix.isin("schema", "workday"), prefix).otherwise("other"))
    capped = reduce(DataFrame.unionByName, (one.filter(c("kind") == k).orderBy("name").limit(n) for k, n in (("schema", schema), ("workday", workday))), one.filter(c("kind").isin("board", "other")))
    order = F.when(c("kind") == "board", 0).when(c("kind") == "schema", 1).when(c("kind") == "workday", 2).otherwise(3)
    return capped.orderBy(order, "name").limit(cap)


def filled(lines: DataFrame) -> DataFrame:
    """Lines whose company cell is blank, an arrow or a dash take the last company named above them in their document."""
    empty = F.trim("cell").isin("", "↳", "-", "–", "—")
    above = W.partitionBy("doc").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("company", F.last(F.when(~empty, F.trim("cell")), ignorenulls=True).over(above))


def snapshot_observations(snapshot: DataFrame, as_of: Column, direct_hours: int = 72, lead_hours: int = 24) -> DataFrame:
    """Observations of a nested snapshot (families of openings of evidence) that are young enough for their kind."""
    openings = snapshot.select("family_key", F.explode_outer("openings").alias("o"))
    evidence = openings.select("family_key", "o.canonical_apply_url", F.explode_outer("o.evidence").alias("e")).select("family_key", "canonical_apply_url", "e.*").filter("source is not null")
    limit = F.when(c("source_mode").isin("direct", "verification"), direct_hours).otherwise(lead_hours) * 3600
    return evidence.filter(F.timestamp_diff("SECOND", c("observed_at"), as_of) <= limit)
