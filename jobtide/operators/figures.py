"""Figures about the inventory: one aggregate a table, its conditions as filters, small rows joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import BAD_STATUSES, EMPLOYER_DATE_MODES, TARGETS, TECH
from ..functions import text as tx
from . import reconcile

c = F.col
FRESH_TIMES, FRESH_FLOOR = 3, 5400


def together(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.crossJoin(b), rows)


def within(column: str, as_of: Column, hours: int) -> Column:
    return c(column) >= as_of - F.expr(f"interval {int(hours)} hours")


def seconds(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(100 * a / b, 1)).otherwise(0.0)


def health_counts(as_of: Column) -> dict[str, Column]:
    """Counts of sources that do not count one twice: unhealthy is the union of its causes."""
    late = seconds(c("last_complete_at"), as_of) > F.greatest(c("interval_seconds") * FRESH_TIMES, F.lit(FRESH_FLOOR))
    never, bad = c("last_complete_at").isNull(), c("last_status").isin(*BAD_STATUSES)
    return {
        "total": F.count("*"), "running": F.count_if(c("lease_expires_at") > as_of), "due": F.count_if(c("next_run_at") <= as_of), "never_completed": F.count_if(never), "overdue": F.count_if(late), "degraded": F.count_if(bad),
        "fresh": F.count_if(~never & ~late & ~bad), "unhealthy": F.count_if(never | late | bad), "latest_activity_at": F.max("last_finished_at"), "coverage_watermark": F.min("last_complete_at"),
    }


def current(targets: DataFrame) -> DataFrame:
    return targets.filter(c("enabled") & c("scheduled") & c("validated") & (c("scope") == "current"))


def inventory_state(targets: DataFrame, as_of: Column) -> DataFrame:
    counts = health_counts(as_of)
    del counts["due"]
    row = current(targets).agg(*(v.alias(k) for k, v in counts.items()))
    history = targets.agg(F.count_if(c("scheduled") & c("validated") & (c("scope") == "historical")).alias("historical"))
    return together(row, history).withColumns({"fresh_percent": percent(c("fresh"), c("total")), "healthy": (c("total") > 0) & (c("unhealthy") == 0)})


def provider_health(targets: DataFrame, as_of: Column) -> DataFrame:
    rows = current(targets).groupBy("kind").agg(*(v.alias(k) for k, v in health_counts(as_of).items()))
    return rows.withColumns({"due_percent": percent(c("due"), c("total")), "fresh_percent": percent(c("fresh"), c("total"))})


def source_growth(catalog: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """Sizes of the catalog and the queue, what is new, and how long the oldest due candidate waits."""
    due = c("status").isin("candidate", "retry") & (c("next_run_at") <= as_of) & (c("leased_until").isNull() | (c("leased_until") < as_of))
    known = catalog.agg(F.count("*").alias("catalog_total"), F.count_if("validated").alias("validated_total"), F.count_if(within("last_discovered_at", as_of, 24)).alias("a24"), F.count_if(within("last_discovered_at", as_of, 168)).alias("a7"), F.max("last_discovered_at").alias("at"))
    asked = queue.agg(F.count("*").alias("candidate_total"), *(F.count_if(c("status") == s).alias(s) for s in ("candidate", "retry", "rejected")), F.count_if(due).alias("due"), F.count_if(within("discovered_at", as_of, 24)).alias("b24"), F.count_if(within("discovered_at", as_of, 168)).alias("b7"), F.max("discovered_at").alias("bt"), F.min(F.when(due, c("next_run_at"))).alias("oldest_due_at"))
    return together(known, asked).select(
        "catalog_total", "validated_total", "candidate_total", "candidate", "retry", "rejected", "due", (c("a24") + c("b24")).alias("new_unique_24h"), (c("a7") + c("b7")).alias("new_unique_7d"), F.greatest("at", "bt").alias("latest_unique_source_at"),
        "oldest_due_at", F.round(seconds(c("oldest_due_at"), as_of) / 60, 1).alias("oldest_due_age_minutes"),
    )


def funnel(families: DataFrame, postings: DataFrame, snapshots: DataFrame, catalog: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Families, postings, snapshots and sources of a window, and three ratios between them."""
    target, verified = c("target_match").isin(*TARGETS), c("direct_openings") > 0
    found, seen = within("first_detected_at", as_of, hours), within("first_seen_at", as_of, hours)
    jobs = families.agg(F.count_if(target & verified).alias("active_verified_jobs"), F.coalesce(F.sum(F.when(target & verified, c("direct_openings"))), F.lit(0)).alias("active_verified_openings"), F.countDistinct(F.when(target & verified, c("company"))).alias("active_verified_companies"), F.count_if(target & verified & found).alias("new_verified_jobs"), F.count_if((c("target_match") != "not_internship") & verified & found).alias("new_visible_jobs"))
    rows = postings.agg(F.count_if(seen).alias("discovered_postings"), F.count_if(seen & target).alias("target_postings"), F.count_if(seen & target & c("source_mode").isin(*EMPLOYER_DATE_MODES)).alias("verified_postings"), F.count_if(seen & c("target_match").isin("not_internship", "wrong_year", "wrong_season")).alias("rejected_postings"))
    good, none = c("complete") & c("error").isNull(), F.lit(0)
    crawls = snapshots.filter(within("finished_at", as_of, hours)).agg(
        F.count("*").alias("crawl_attempts"), F.countDistinct("source").alias("crawled_sources"), F.count_if(good).alias("complete_crawls"), F.count_if(~good).alias("failed_crawls"), F.coalesce(F.sum("rows_scanned"), none).cast("long").alias("rows_scanned"), F.coalesce(F.sum("target_rows"), none).cast("long").alias("target_rows"),
        F.coalesce(F.sum("new_rows"), none).cast("long").alias("new_rows"), F.count_if(good & (c("rows_scanned") > 0) & (c("target_rows") == 0)).alias("zero_target_crawls"), F.count_if(good & (c("new_rows") == 0)).alias("zero_new_crawls"),
    )
    promoted = catalog.agg(F.count_if(c("validated") & (c("origin") == "probe") & within("last_discovered_at", as_of, hours)).alias("promoted_sources"))
    return together(jobs, rows, crawls, promoted).withColumns({"verified_rate": ratio(c("verified_postings"), c("discovered_postings")), "target_rate": ratio(c("target_rows"), c("rows_scanned")), "job_rate": ratio(c("new_verified_jobs"), c("promoted_sources"))})


def failure_counts(rows: DataFrame, reason: Column, n: int = 25) -> DataFrame:
    """(reason, n, examples): the buckets with most rows, up to three different texts of each."""
    said = rows.select(F.substring(F.coalesce(reason, F.lit("unknown")), 1, 240).alias("said")).withColumn("reason", tx.reason_bucket(c("said")))
    # Of each bucket three texts are kept before anything is gathered; the counts are made apart.
    third = F.row_number().over(W.partitionBy("reason").orderBy("said"))
    few = said.distinct().withColumn("nth", third).filter("nth <= 3").groupBy("reason").agg(F.array_sort(F.collect_list("said")).alias("examples"))
    few = said.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")
    return few.orderBy(c("n").desc(), "reason").limit(n)


def zero_yield(snapshots: DataFrame, as_of: Column, hours: int, n: int) -> DataFrame:
    """Sources that were read in the window and gave nothing new."""
    seen = snapshots.filter(within("finished_at", as_of, hours)).groupBy("source").agg(F.sum("rows_scanned").cast("long").alias("rows_scanned"), F.count("*").alias("crawls"), F.sum("new_rows").alias("new"))
    return seen.filter("new = 0").drop("new").orderBy(c("rows_scanned").desc(), "source").limit(n)


def tasks(queue: DataFrame, as_of: Column) -> DataFrame:
    """(source, next_run_at, overdue): what is due and not leased comes first."""
    overdue = (c("next_run_at") <= as_of) & (c("leased_until").isNull() | (c("leased_until") < as_of))
    return queue.select("source", "next_run_at", overdue.alias("overdue")).orderBy(c("overdue").desc(), "next_run_at", "source")


def publication_delta(before: DataFrame, after: DataFrame, postings: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Verified postings without a family, and new verified jobs, before and after a rebuild."""
    own = postings.filter(c("active") & c("target_match").isin(*TARGETS) & c("source_mode").isin(*EMPLOYER_DATE_MODES)).select("family_key")
    gaps = lambda f, name: own.join(f.select("family_key"), "family_key", "left_anti").agg(F.count("*").alias(name))
    jobs = lambda f, name: f.agg(F.count_if(c("target_match").isin(*TARGETS) & (c("direct_openings") > 0) & within("first_detected_at", as_of, hours)).alias(name))
    row = together(gaps(before, "gaps_before"), gaps(after, "gaps_after"), jobs(before, "a"), jobs(after, "b"))
    return row.select("gaps_before", "gaps_after", F.greatest(F.lit(0), c("gaps_before") - c("gaps_after")).alias("gaps_repaired"), (c("b") - c("a")).alias("verified_jobs_delta"))


def coverage(families: DataFrame, postings: DataFrame) -> DataFrame:
    """What the families and the four modes cover; recall of the registry by identity or role."""
    target, tech = c("target_match").isin(*TARGETS), c("category").isin(*TECH)
    jobs = families.filter(target & tech).agg(F.count("*").alias("families"), F.countDistinct("company").alias("companies"), F.count_if(c("direct_openings") > 0).alias("direct_families"), F.count_if((c("direct_openings") == 0) & (c("backstop_openings") > 0)).alias("backstop_only"))
    own = postings.filter(c("active") & target & tech & c("source_mode").isin("registry", "direct", "verification", "external-index"))
    ids = lambda mode: F.countDistinct(F.when(c("source_mode") == mode, c("identity")))
    counts = own.agg(F.countDistinct("identity").alias("known_applications"), ids("registry").alias("registry_floor"), ids("direct").alias("direct_applications"), ids("verification").alias("verified_applications"), F.countDistinct(F.when(c("source_mode") == "direct", c("source"))).alias("productive_direct_sources"), F.countDistinct(F.when((c("source_mode") == "direct") & c("posted_at").isNotNull(), c("identity"))).alias("dated"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    found = (n(reconcile.recalled(postings, ("direct",)), "direct_matches"), n(reconcile.recalled(postings, EMPLOYER_DATE_MODES), "independent_matches"), n(reconcile.direct_only(postings), "direct_only"))
    row = together(jobs, counts, *found)
    share = lambda a, b: F.when(c(b) > 0, F.round(100 * c(a) / c(b), 1))
    return row.withColumns({"registry_only": c("registry_floor") - c("independent_matches"), "registry_recall_percent": share("independent_matches", "registry_floor"), "direct_date_coverage_percent": share("dated", "direct_applications")}).drop("dated")


def contract(health: DataFrame) -> DataFrame:
    """(figure, value, n): classes of sources by what their last run says, and histograms of modes and statuses."""
    now, past = c("scope") == "current", c("scope") == "historical"
    board, note = c("complete") & (c("mode") == "board") & (c("status") == "ok"), F.coalesce("note", F.lit(""))
    checked = now & (c("mode") == "verification")
    classes = {
        "configured_sources": F.lit(True), "current_sources": now, "historical_sources": past, "complete_enumerators": now & board, "historical_enumerators": past & board, "actionable_anomalies": now & (c("error").isNotNull() | c("status").isin("broken", "truncated", "empty")),
        "access_limited": now & ((c("status") == "blocked") | note.contains("access-blocked")), "stale_verifications": checked & ((c("status") == "stale") | note.contains("stale/closed")), "unstructured_verifications": checked & ((c("status") == "unstructured") | note.contains("without JobPosting")),
        "dormant_watches": past & c("status").isin("dormant", "empty", "stale"), "historical_failures": past & c("error").isNotNull(), "truncated_sources": now & (c("mode") == "board") & c("expected_rows").isNotNull() & (c("rows_scanned") < c("expected_rows")),
    }
    row = health.agg(*(F.count_if(v).alias(k) for k, v in classes.items()))
    named = row.select(F.explode(F.array(*(F.struct(F.lit("class").alias("figure"), F.lit(k).alias("value"), c(k).alias("n")) for k in classes))).alias("f")).select("f.*")
    both = health.select(F.explode(F.array(F.struct(F.lit("mode").alias("figure"), c("mode").alias("value")), F.struct(F.lit("status").alias("figure"), F.coalesce("status", F.lit("unknown")).alias("value")))).alias("f"))
    return named.unionByName(both.groupBy("f.figure", "f.value").agg(F.count("*").alias("n")))


def feed_stats(families: DataFrame, postings: DataFrame, targets: DataFrame, as_of: Column) -> DataFrame:
    """The public figures: verified families, leads, movement of links and validated sources."""
    own, verified = families.filter((c("year") == 2027) & c("category").isin(*TECH)), c("direct_openings") > 0
    lead, pick = (c("direct_openings") == 0) & (c("backstop_openings") > 0), lambda x: F.when(verified, c(x))
    jobs = own.agg(
        F.count_if(verified).alias("role_families"), F.coalesce(F.sum(pick("direct_openings")), F.lit(0)).alias("active_listings"), F.countDistinct(pick("company")).alias("companies"), F.count_if(verified & within("latest_posted_at", as_of, 24)).alias("new_verified_24h"),
        F.count_if(verified & within("first_detected_at", as_of, 24)).alias("discovered_24h"), F.count_if(lead).alias("leads"), F.coalesce(F.sum(F.when(lead, c("backstop_openings"))), F.lit(0)).alias("lead_apps"),
    )
    moved = postings.filter((c("source_mode") == "direct") & (c("year") == 2027) & c("category").isin(*TECH)).agg(F.countDistinct(F.when(within("first_seen_at", as_of, 24) & c("removed_at").isNull(), c("canonical_apply_url"))).alias("new_urls_24h"), F.countDistinct(F.when(within("removed_at", as_of, 24), c("canonical_apply_url"))).alias("removed_urls_24h"))
    return together(jobs, moved, current(targets).agg(F.count("*").alias("validated_sources"))).withColumn("net_urls_24h", c("new_urls_24h") - c("removed_urls_24h"))


def market_stats(index: DataFrame, as_of: Column) -> DataFrame:
    """The counters of the fused index; a job is new by an outside date, never by its verification."""
    own, lead = index.filter(c("category").isin(*TECH)), ~c("verified")
    dated = F.coalesce("latest_posted_at", "latest_sensor_at")
    active, day = F.coalesce(dated, c("first_detected_at")), as_of - F.expr("interval 24 hours")
    return own.agg(
        F.count_if(c("verified")).alias("role_families"), F.coalesce(F.sum(F.when(c("verified"), c("direct_openings"))), F.lit(0)).alias("active_listings"), F.countDistinct(F.when(c("verified") & (c("company") != ""), F.lower("company"))).alias("companies"),
        F.count_if(c("verified") & (dated >= day)).alias("new_verified_24h"), F.count_if(active >= day).alias("market_events_24h"), F.count_if(dated >= day).alias("dated_market_events_24h"), F.count_if(c("latest_posted_at") >= day).alias("employer_posted_24h"), F.count_if(c("latest_sensor_at") >= day).alias("sensor_reported_24h"),
        F.count_if(dated.isNull() & (active >= day)).alias("first_seen_only_24h"), F.count_if(c("first_detected_at") >= day).alias("discovered_24h"), F.count_if(lead).alias("leads"), F.coalesce(F.sum(F.when(lead, c("backstop_openings"))), F.lit(0)).alias("lead_apps"),
        F.count_if(lead & (active >= as_of - F.expr("interval 14 days"))).alias("verification_backlog"), F.max(active).alias("newest_event"),
    ).withColumns({"new_today": c("new_verified_24h"), "new_24h": c("new_verified_24h"), "verified_listings": c("active_listings"), "verified_families": c("role_families")})


def crawl_summary(runs: DataFrame, n: int = 100) -> DataFrame:
    """(part, value, n): selected and refreshed sources, the statuses, and the first failures."""
    fine = c("complete") & c("error").isNull() & ~c("status").isin(*BAD_STATUSES)
    row = runs.agg(F.count("*").alias("selected"), F.countDistinct(F.when(fine, c("source"))).alias("refreshed"))
    counts = row.select(F.explode(F.array(*(F.struct(F.lit("summary").alias("part"), F.lit(k).alias("value"), c(k).alias("n")) for k in ("selected", "refreshed")))).alias("f")).select("f.*")
    statuses = runs.groupBy(F.lit("status").alias("part"), F.coalesce("status", F.lit("ok")).alias("value")).agg(F.count("*").alias("n"))
    failed = runs.filter(c("error").isNotNull()).orderBy("finished_at", "source").limit(n).groupBy(F.lit("failure").alias("part"), F.concat_ws(" ", "source", F.substring("error", 1, 300)).alias("value")).agg(F.count("*").alias("n"))
    return counts.unionByName(statuses).unionByName(failed)


def sensor_health(runs: DataFrame, index: DataFrame) -> DataFrame:
    """Sensors that ran well or not, the watermark of those that did, the freshest event of the index."""
    good = c("status") == "ok"
    row = runs.agg(F.count("*").alias("total"), F.count_if(good).alias("fresh"), F.count_if(~good).alias("unhealthy"), F.max("finished_at").alias("latest_activity_at"), F.min(F.when(good, c("finished_at"))).alias("coverage_watermark"))
    seen = index.agg(F.count("*").alias("families"), F.max(F.coalesce("latest_posted_at", "latest_sensor_at", "first_detected_at")).alias("freshest_market_event_at"))
    half = F.greatest(F.lit(1), F.floor(c("total") / 2))
    return together(row, seen).withColumns({"fresh_percent": percent(c("fresh"), c("total")), "healthy": (c("unhealthy") == 0) & (c("fresh") > 0), "ok": (c("fresh") > 0) & (c("fresh") >= half) & (c("families") > 0)})


def shard_health(runs: DataFrame, shards: int) -> DataFrame:
    """(shard, selected, refreshed) by the sources' stable hash."""
    fine = c("complete") & c("error").isNull() & ~c("status").isin(*BAD_STATUSES)
    return runs.groupBy(tx.stable_shard(c("source"), shards).alias("shard")).agg(F.count("*").alias("selected"), F.countDistinct(F.when(fine, c("source"))).alias("refreshed"), F.sum("rows_scanned").cast("long").alias("rows_scanned"))


def probe_audit(postings: DataFrame) -> DataFrame:
    """Rows, targets and trusted dates a source, and one row of totals (source null)."""
    trusted = F.when(c("source_mode").isin(*EMPLOYER_DATE_MODES), c("posted_at"))
    return postings.rollup("source").agg(F.count("*").alias("n"), F.count_if(c("target_match").isin(*TARGETS)).alias("target_rows"), F.count(trusted).alias("trusted_dates"), F.max(trusted).alias("newest"), F.grouping("source").cast("int").alias("total"))


def feed_lag(postings: DataFrame, snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """Whether postings or removals are newer than the last projection of the feed; without a projection it lags."""
    now = together(postings.filter(c("active") & (c("target_match") != "not_internship")).agg(F.max("first_seen_at").alias("latest_posting_at")), snapshots.filter("removed_rows > 0").agg(F.max("finished_at").alias("latest_removal_at")))
    done = state.agg(F.count("*").alias("n"), F.max("projected_at").alias("projected_at"), F.max("posting_at").alias("projected_posting_at"), F.max("removal_at").alias("projected_removal_at"))
    newer = lambda a, b: c(a).isNotNull() & (c(b).isNull() | (c(a) > c(b)))
    return together(now, done).select((c("n") > 0).alias("ready"), ((c("n") == 0) | newer("latest_posting_at", "projected_posting_at") | newer("latest_removal_at", "projected_removal_at")).alias("lagging"), "projected_at", "latest_posting_at", "projected_posting_at", "latest_removal_at", "projected_removal_at")
