"""Gates: one row of figures, the rules that fail, and the verdict; publish only what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BAD_STATUSES, CATEGORIES, SEASONS, TARGET_RANK
from . import figures
from .figures import seconds, together, within

c = F.col


def judged(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `failed`, the names of the rules that do not hold (unknown counts as failed), and `passed`."""
    broken = F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))), ",")
    return row.withColumn("failed", broken).withColumn("passed", c("failed") == "")


def snapshot_sanity(index: DataFrame, previous: DataFrame, as_of: Column, expected: Column, least: int = 100, keep: float = 0.5) -> DataFrame:
    """Enough listings, no impossible counts, a whole index, and no collapse against the last snapshot."""
    row = index.agg(F.coalesce(F.sum("direct_openings"), F.lit(0)).alias("active"), F.countDistinct(F.when(c("direct_openings") > 0, c("company"))).alias("companies"), F.count_if((c("direct_openings") > 0) & within("first_detected_at", as_of, 24)).alias("new_today"), F.count("*").alias("exported"))
    row = together(row, previous.agg(F.coalesce(F.sum("direct_openings"), F.lit(0)).alias("previous"))).withColumn("expected", expected)
    return judged(row, {"minimum": c("active") >= least, "companies": c("companies") <= c("active"), "new": c("new_today") <= c("active"), "complete": c("exported") >= c("expected"), "collapse": (c("previous") < least) | (c("active") >= F.floor(c("previous") * keep))})


def keys_of(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("roles"), F.countDistinct(F.trim("family_key")).alias("distinct_keys"), F.count_if(F.trim("family_key") == "").alias("blank_keys"), F.max("last_verified_at").alias("generated_at"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", "family_key", "company", "title", "locations"))), F.lit(0)).alias("bytes"))


def snapshot_contract(index: DataFrame, responses: DataFrame, required: tuple[str, ...], expected: DataFrame, as_of: Column, hours: float = 168, megabytes: float = 15) -> DataFrame:
    """The parts a reader needs, whole and unique keys, an age within bounds, a bounded size."""
    there = responses.filter(c("request").isin(*required)).agg(F.countDistinct("request").alias("parts"))
    row = together(keys_of(index), there, expected.agg(F.count("*").alias("expected"))).withColumn("age_hours", F.round(seconds(c("generated_at"), as_of) / 3600, 2))
    return judged(row, {"parts": c("parts") == len(required), "empty": (c("roles") > 0) & (c("expected") > 0), "incomplete": c("roles") >= c("expected"), "keys": (c("blank_keys") == 0) & (c("distinct_keys") == c("roles")), "future": c("age_hours") >= -1, "old": c("age_hours") <= hours, "size": c("bytes") <= megabytes * 1e6})


def snapshot_usable(index: DataFrame, total: DataFrame, as_of: Column, minutes: int = 45) -> DataFrame:
    row = together(keys_of(index).drop("bytes"), total.agg(F.count("*").alias("total"))).withColumn("age_minutes", F.round(seconds(c("generated_at"), as_of) / 60, 1))
    return judged(row, {"future": c("age_minutes") >= -5, "old": c("age_minutes") <= minutes, "empty": c("roles") > 0, "total": c("total") == c("roles"), "keys": (c("blank_keys") == 0) & (c("distinct_keys") == c("roles"))})


def sensor_recall(sensors: DataFrame, openings: DataFrame, as_of: Column, least: float = 0.995) -> DataFrame:
    """Every link a sensor saw is published, with a sensor time no older than the one seen."""
    seen = sensors.groupBy(c("canonical_apply_url").alias("url")).agg(F.max("posted_at").alias("expected"))
    done = openings.groupBy("canonical_apply_url").agg(F.max("sensor_at").alias("actual"))
    met = seen.join(done, c("url") == c("canonical_apply_url"), "left").withColumn("recent", c("expected") >= as_of - F.expr("interval 24 hours"))
    lost = c("expected").isNotNull() & (c("actual").isNull() | (c("actual") < c("expected")))
    row = met.agg(F.count("*").alias("expected_urls"), F.count("canonical_apply_url").alias("published_urls"), F.count("expected").alias("timestamped_urls"), F.count_if(lost).alias("timestamp_drops"), F.count_if("recent").alias("recent_timestamped_urls"), F.count_if(lost & c("recent")).alias("recent_timestamp_drops"))
    row = row.withColumns({"missing_urls": c("expected_urls") - c("published_urls"), "recall": F.when(c("expected_urls") == 0, 1.0).otherwise(F.round(c("published_urls") / c("expected_urls"), 6))})
    return judged(row, {"recall": c("recall") >= least, "timestamps": c("timestamp_drops") == 0})


def market_snapshot(index: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    row = together(index.agg(F.count("*").alias("families"), F.max("market_event_at").alias("newest_event")), runs.agg(F.countDistinct(F.when(c("status") == "ok", c("source"))).alias("sensors")))
    return judged(row, {"families": c("families") >= 100, "sensors": c("sensors") >= 3, "newest": seconds(c("newest_event"), as_of) <= 96 * 3600})


def export_health(targets: DataFrame, as_of: Column, minutes: int = 360) -> DataFrame:
    row = figures.inventory_state(targets, as_of).select("total", "fresh", "healthy", F.round(seconds(c("latest_activity_at"), as_of) / 60, 1).alias("activity_minutes"))
    return judged(row, {"empty": c("total") > 0, "fresh": (c("fresh") > 0) & (c("fresh") <= c("total")), "future": c("activity_minutes") >= -5, "old": c("activity_minutes") <= minutes})


def production(targets: DataFrame, families: DataFrame, runs: DataFrame, universe: DataFrame, as_of: Column, minutes: int = 90, sources: int = 100, listings: int = 25, grace: int = 30) -> DataFrame:
    """Floors of sources, listings, activity, freshness and employers; workers that catch up excuse stale sources."""
    state = figures.inventory_state(targets, as_of).select("total", "running", "fresh", "unhealthy", "degraded", F.greatest(F.lit(0.0), F.round(seconds(c("latest_activity_at"), as_of) / 60, 1)).alias("activity_minutes"))
    product = families.filter((c("target_match") != "not_internship") & (c("direct_openings") > 0)).agg(F.count("*").alias("active_families"), F.coalesce(F.sum("direct_openings"), F.lit(0)).alias("active_listings"), F.countDistinct("company").alias("companies"))
    lately = within("finished_at", as_of, 24)
    recent = runs.agg(F.count_if(lately).alias("recent_snapshots"), F.count_if(lately & c("status").isin(*BAD_STATUSES)).alias("recent_failed"))
    known = universe.agg(F.count("*").alias("known_employers"), F.count_if(c("status") == "enumerated").alias("enumerated_employers"))
    row = together(state, product, recent, known).withColumn("catching_up", (c("running") > 0) & (c("activity_minutes") <= min(minutes, grace)))
    return judged(row, {"sources": c("total") >= sources, "listings": c("active_listings") >= listings, "activity": c("activity_minutes") <= minutes, "fresh": (c("fresh") > 0) | c("catching_up"), "employers": c("known_employers") > 0, "enumerated": c("enumerated_employers") > 0})


def attention(targets: DataFrame, as_of: Column) -> DataFrame:
    """(source, reason) of each enabled source that needs someone: a bad status, no complete run, or one twice its interval ago."""
    late = (c("interval_seconds") > 0) & (seconds(c("last_complete_at"), as_of) > c("interval_seconds") * 2)
    running = c("lease_expires_at") > as_of
    reason = F.when(c("last_status").isin(*BAD_STATUSES), c("last_status")).when(c("last_complete_at").isNull(), "never_completed").when(late, F.when(running, "overdue_running").otherwise("overdue"))
    return targets.filter("enabled").select("source", reason.alias("reason")).filter("reason is not null")


def coverage(targets: DataFrame, universe: DataFrame, as_of: Column) -> DataFrame:
    """(part, source, reason, n): success, pending or failure with its detail, then the sources by name."""
    named = attention(targets, as_of)
    state = figures.inventory_state(targets, as_of).select("total", "fresh", "unhealthy")
    people = universe.agg(F.count("*").alias("known"), F.count_if(c("status") == "enumerated").alias("enumerated"), F.count_if(c("status") != "enumerated").alias("unresolved"), F.count_if("blind_spot").alias("blind"))
    row = together(state, people, named.agg(F.count("*").alias("n")), targets.agg(F.count("*").alias("listed"), F.countDistinct("source").alias("apart"), F.count_if(F.trim("source") == "").alias("blank")))
    detail = (
        F.when((c("total") <= 0) | (c("fresh") > c("total")) | (c("unhealthy") > c("total")), "counts are invalid")
        .when((c("enumerated") + c("unresolved") != c("known")) | (c("blind") > c("unresolved")), "employer counts are contradictory")
        .when(c("known") == 0, "no employers")
        .when(c("enumerated") == 0, "no enumerated employers")
        .when((c("blank") > 0) | (c("listed") != c("apart")), "blank or duplicate sources")
        .when(c("unhealthy") > c("n"), "unhealthy sources are not named")
    )
    busy, whole = (c("unhealthy") > 0) | (c("n") > 0), c("fresh") == c("total")
    verdict = F.when(detail.isNotNull(), "failure").when(busy, "pending").when(~whole, "failure").otherwise("success")
    said = F.coalesce(detail, F.when(busy, "sources need attention").when(~whole, "counts disagree").otherwise("all sources are fresh"))
    return row.select(F.lit("verdict").alias("part"), verdict.alias("source"), said.alias("reason"), F.greatest("unhealthy", "n").alias("n")).unionByName(named.select(F.lit("attention").alias("part"), "source", "reason", F.lit(1).cast("long").alias("n")))


def stall(families: DataFrame, catalog: DataFrame, queue: DataFrame, as_of: Column, hours: float = 48, minutes: float = 180) -> DataFrame:
    """The newest visible listing and the oldest due candidate are not too old; no due candidate is fine."""
    listing = families.filter("direct_openings > 0").agg(F.round(seconds(F.max(F.coalesce("latest_posted_at", "first_detected_at")), as_of) / 3600, 2).alias("listing_hours"))
    row = together(listing, figures.source_growth(catalog, queue, as_of).select("due", c("oldest_due_age_minutes").alias("due_minutes")))
    return judged(row, {"visible_listing_activity_stalled": c("listing_hours") <= hours, "source_candidate_backlog_stalled": F.coalesce(c("due_minutes") <= minutes, F.lit(True))})


def row_constraints(families: DataFrame) -> DataFrame:
    """What each stored family must be: named, counted without a remainder, and of known kinds."""
    blank = (F.trim("company") == "") | (F.trim("title") == "") | (F.trim("family_key") == "")
    odd = ~c("category").isin(*CATEGORIES, "other") | ~c("target_match").isin(*TARGET_RANK) | ~c("posted_precision").isin("timestamp", "day", "unknown") | ~F.coalesce("season", F.lit("summer")).isin(*SEASONS)
    negative, uneven = (c("opening_count") < 0) | (c("direct_openings") < 0) | (c("backstop_openings") < 0), c("opening_count") != c("direct_openings") + c("backstop_openings")
    late = c("first_detected_at").isNull() | c("last_verified_at").isNull()
    row = families.agg(F.count("*").alias("families"), F.count_if(blank).alias("blank"), F.count_if(negative).alias("negative"), F.count_if(uneven).alias("uneven"), F.count_if(odd).alias("unknown_kinds"), F.count_if(late).alias("undated"))
    return judged(row, {k: c(k) == 0 for k in ("blank", "negative", "uneven", "unknown_kinds", "undated")})
