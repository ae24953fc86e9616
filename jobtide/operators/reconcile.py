"""Reconciliation: snapshots, checks and probes merged into the stored tables.

Each operator takes whole tables and gives the changed one; `as_of` is a column. A partial or failed
snapshot never removes anything, and every rule that picks one row ends in a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import BAD_STATUSES, CADENCE, EMPLOYER_DATE_MODES, FALLBACK_KINDS, INDEX_MODES, TARGETS, TECH
from ..functions import rules
from ..functions import text as tx
from ..functions import urls as ux

c = F.col


def is_target(row: str = "") -> Column:
    return c(f"{row}target_match").isin(*TARGETS)


def upsert(held: DataFrame, snap: DataFrame, as_of: Column) -> DataFrame:
    """A snapshot's rows over the stored ones: what the snapshot knows wins, a known date stays with its precision."""
    both = held.alias("o").join(snap.alias("n"), c("o.posting_key") == c("n.posting_key"), "full_outer")
    listed, fresh = c("n.posting_key").isNotNull(), c("o.posting_key").isNull()
    kept = lambda x: F.coalesce(f"n.{x}", f"o.{x}").alias(x)
    dated = lambda x: F.when(fresh | c("n.posted_at").isNotNull(), c(f"n.{x}")).otherwise(c(f"o.{x}")).alias(x)
    return both.select(
        kept("posting_key"), kept("title"), kept("target_match"), kept("posted_at"), kept("updated_at"), dated("posted_precision"), dated("posted_confidence"),
        F.when(listed, F.when(is_target("n."), c("n.description")).otherwise("")).otherwise(c("o.description")).alias("description"),
        F.coalesce("o.first_seen_at", as_of).alias("first_seen_at"), F.when(listed, as_of).otherwise(c("o.last_seen_at")).alias("last_seen_at"),
        (listed | c("o.active")).alias("active"), F.when(~listed, c("o.removed_at")).alias("removed_at"),
    )


def restore_removed(postings: DataFrame, sources: DataFrame, as_of: Column, hours: int = 6) -> DataFrame:
    """Direct rows of the refreshed sources that went inactive with no time of removal, if seen within `hours`: active and pending."""
    lately = c("last_seen_at") >= as_of - F.expr(f"interval {int(hours)} hours")
    hit = postings.join(sources.select(c("source").alias("of")).distinct(), c("source") == c("of"), "left")
    back = ~c("active") & c("removed_at").isNull() & (c("source_mode") == "direct") & lately & c("of").isNotNull()
    return hit.withColumns({"removed_at": F.when(back, as_of).otherwise(c("removed_at")), "active": c("active") | back}).drop("of")


def provider_stale(postings: DataFrame, boards: DataFrame, snap: DataFrame) -> DataFrame:
    """Keys of active index rows whose squashed company is a completely listed greenhouse board that no longer lists them.

    Two equality joins: company with board, then (board, identity) with what the board lists.
    """
    whole = boards.filter(c("complete") & c("status").isin("ok", "empty") & c("source").startswith("greenhouse:")).select("source", F.lower(F.split_part("source", F.lit(":"), F.lit(2))).alias("board"))
    listed = snap.filter(is_target()).select(c("source").alias("at"), c("identity").alias("same")).distinct()
    index = postings.filter(c("active") & c("source_mode").isin(*INDEX_MODES)).select("posting_key", "identity", F.regexp_replace(F.lower("company"), "[^a-z0-9]", "").alias("squashed"))
    met = index.join(whole, c("squashed") == c("board"))
    return met.join(listed, (c("source") == c("at")) & (c("identity") == c("same")), "left_anti").select("posting_key").distinct()


def link_states(postings: DataFrame, checks: DataFrame) -> DataFrame:
    """(posting_key, link_status, link_checked_at, active): the checks' results by link; a closed link is inactive."""
    done = checks.select("url", rules.link_state(c("code"), c("closed_text")).alias("state"), "checked_at")
    met = postings.join(done, c("canonical_apply_url") == c("url"), "left")
    return met.select("posting_key", F.coalesce("state", F.lit("unchecked")).alias("link_status"), c("checked_at").alias("link_checked_at"), (c("active") & ~c("state").eqNullSafe("closed")).alias("active"))


def without_dead_hosts(postings: DataFrame) -> DataFrame:
    """(posting_key, active): links to hosts where nobody can apply close their rows."""
    return postings.select("posting_key", (c("active") & ux.is_actionable_url(c("url"))).alias("active"))


def schedule(catalog: DataFrame, targets: DataFrame, health: DataFrame, as_of: Column) -> DataFrame:
    """Targets of the validated catalog with their cadence; what a healthy source is known by fills gaps.

    Targets outside the catalog stay, disabled and unscheduled.
    """
    known = catalog.filter(c("validated") & c("kind").isin(*CADENCE)).select(c("source").alias("s"), "kind", "scope")
    good = health.filter(c("complete") & c("last_success_at").isNotNull() & ~c("status").isin(*BAD_STATUSES, "dormant")).select(c("source").alias("h"), "last_success_at", "last_attempt_at", "status", "rows_scanned")
    all_ = targets.join(known, c("source") == c("s"), "full_outer").withColumn("source", F.coalesce("source", "s")).join(good, c("source") == c("h"), "left")
    planned = c("s").isNotNull()
    all_ = all_.withColumns({"interval_seconds": F.when(planned, rules.crawl_interval(c("kind"), c("scope"))).otherwise(c("interval_seconds")), "priority": F.when(planned, rules.crawl_priority(c("kind"), c("scope")))})
    fill = planned & c("h").isNotNull()
    pending, none = F.coalesce("last_status", F.lit("pending")) == "pending", F.coalesce("last_rows", F.lit(0)) == 0
    due = F.greatest(as_of, c("last_success_at") + F.make_dt_interval(secs=c("interval_seconds")))
    return all_.select(
        "source", (planned & ~c("kind").isin(*FALLBACK_KINDS)).alias("enabled"), planned.alias("scheduled"), "priority", "interval_seconds",
        F.when(fill, F.coalesce("last_complete_at", "last_success_at")).otherwise(c("last_complete_at")).alias("last_complete_at"),
        F.when(fill, F.coalesce("last_finished_at", "last_attempt_at")).otherwise(c("last_finished_at")).alias("last_finished_at"),
        F.when(fill & pending, c("status")).otherwise(F.coalesce("last_status", F.lit("pending"))).alias("last_status"),
        F.when(fill & none, c("rows_scanned")).otherwise(F.coalesce("last_rows", F.lit(0))).cast("long").alias("last_rows"),
        F.when(fill & c("last_complete_at").isNull(), due).otherwise(c("next_run_at")).alias("next_run_at"),
    )


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each source; the complete one of two at a time."""
    first = W.partitionBy("source").orderBy(c("finished_at").desc(), c("complete").desc(), "status", "rows_scanned")
    return runs.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def finish_targets(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Targets after their newest run: when they are due, what is complete, failures in a row."""
    run = latest(runs).select(c("source").alias("of"), "finished_at", "complete", "status", "rows_scanned", "error")
    met = targets.join(run, c("source") == c("of"), "left")
    ran, every, failures = c("of").isNotNull(), c("interval_seconds"), c("consecutive_failures") + 1
    cut = c("status").isin("blocked", "truncated", "partial") | ~c("complete")
    delay = (
        F.when(c("error").isNotNull(), F.least(F.lit(21600), F.greatest(F.lit(300), every) * F.pow(F.lit(2), F.least(failures, F.lit(5)))))
        .when(cut, F.least(F.lit(21600), F.greatest(F.lit(600), every)))
        .when(c("rows_scanned") == 0, F.greatest(every, F.lit(21600)))
        .otherwise(every)
    ).cast("long")
    return met.select(
        "source", F.when(ran, c("finished_at") + F.make_dt_interval(secs=delay)).alias("next_run_at"), F.when(ran & c("complete") & c("error").isNull(), c("finished_at")).otherwise(c("last_complete_at")).alias("last_complete_at"),
        F.coalesce("finished_at", "last_finished_at").alias("last_finished_at"), F.coalesce("status", "last_status").alias("last_status"), F.coalesce("rows_scanned", F.lit(0)).cast("long").alias("last_rows"),
        F.when(ran, F.when(c("error").isNotNull() | cut, failures).otherwise(0)).otherwise(c("consecutive_failures")).cast("long").alias("consecutive_failures"), c("error").alias("last_error"),
    )


def probe_outcomes(candidates: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promoted sources, the queue with what was probed moved on)."""
    run = probes.select(c("source").alias("of"), "complete", c("status").alias("result"), "error", "mode", "note")
    met = candidates.join(run, c("source") == c("of"), "left")
    good = c("of").isNotNull() & c("error").isNull() & c("complete") & c("result").isin("ok", "empty") & c("mode").isin("board", "board-search")
    failures = c("consecutive_failures") + 1
    tried, rejected = c("of").isNotNull(), (c("result") == "dormant") | (failures >= 5)
    delay = F.least(F.lit(604800), F.lit(21600) * F.pow(F.lit(2), F.least(failures - 1, F.lit(4)))).cast("long")
    queue = met.filter(~good).select(
        "source", F.when(tried, F.when(rejected, "rejected").otherwise("retry")).otherwise(c("status")).alias("status"), F.when(tried, delay).alias("delay"),
        F.when(tried, failures).otherwise(c("consecutive_failures")).cast("long").alias("consecutive_failures"), F.when(tried, F.coalesce("error", "note", "result")).otherwise(c("last_error")).alias("last_error"),
    )
    return met.filter(good).select("source", "kind", c("result").alias("status")), queue


def retire_dormant(targets: DataFrame, catalog: DataFrame, runs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Targets and catalog without sources whose newest run found no board; nothing of theirs counts as complete."""
    gone = latest(runs).filter(c("status") == "dormant").select(c("source").alias("of"), F.lit(True).alias("dormant"))
    mark = lambda df: df.join(gone, c("source") == c("of"), "left").drop("of").withColumn("dormant", F.coalesce("dormant", F.lit(False)))
    left = mark(targets).select("source", (c("enabled") & ~c("dormant")).alias("enabled"), (c("scheduled") & ~c("dormant")).alias("scheduled"), F.when(c("dormant"), "dormant").otherwise(c("last_status")).alias("last_status"), "last_complete_at")
    right = mark(catalog).select(
        "source", (c("validated") & ~c("dormant")).alias("validated"), F.when(c("dormant"), "historical").otherwise(c("scope")).alias("scope"), F.when(c("dormant"), "retired-dormant").otherwise(c("origin")).alias("origin"),
        F.when(c("dormant"), as_of).otherwise(c("last_discovered_at")).alias("last_discovered_at"),
    )
    return left, right


def key_changes(held: DataFrame, snap: DataFrame, complete: DataFrame) -> DataFrame:
    """(source, new_keys, removed_keys): listed but not known; active but not listed, where the listing is complete."""
    known = held.select("posting_key", "source", c("active").alias("was_active"), F.lit(True).alias("known"))
    both = known.join(snap.select("posting_key", c("source").alias("at"), F.lit(True).alias("listed")), "posting_key", "full_outer").withColumn("source", F.coalesce("source", "at"))
    counted = both.groupBy("source").agg(F.count_if(c("known").isNull()).alias("new_keys"), F.count_if(c("listed").isNull() & c("was_active")).alias("missing"))
    met = counted.join(complete.select(c("source").alias("of")).distinct(), c("source") == c("of"), "left")
    return met.select("source", "new_keys", F.when(c("of").isNotNull(), c("missing")).otherwise(0).cast("long").alias("removed_keys"))


def unverified_leads(leads: DataFrame, as_of: Column, days: int, n: int) -> DataFrame:
    """The leads to verify next: unseen elsewhere, not lately tried, first-seen today and unchecked ones first, one an identity."""
    state, hour = F.coalesce("link_status", F.lit("unchecked")), lambda h: as_of - F.expr(f"interval {h} minutes")
    since = lambda x, minutes: c(x) < hour(minutes)
    idle = c("link_checked_at").isNull() | (state == "checking") & since("link_checked_at", 15) | (state != "checking") & since("link_checked_at", 360)
    verified = leads.filter(c("active") & c("source_mode").isin(*EMPLOYER_DATE_MODES) & is_target()).select(c("identity").alias("same")).distinct()
    own = leads.filter(c("active") & c("source_mode").isin(*INDEX_MODES) & is_target() & (c("first_seen_at") >= as_of - F.expr(f"interval {int(days)} days")) & ~state.isin("closed", "invalid", "verified") & idle & ux.is_actionable_url(c("canonical_apply_url")))
    own = own.join(verified, c("identity") == c("same"), "left_anti")
    order = [(c("first_seen_at") >= hour(1440)).desc(), (state == "unchecked").desc(), c("first_seen_at").desc(), c("last_seen_at").desc(), c("posting_key")]
    first = own.withColumn("nth", F.row_number().over(W.partitionBy("identity").orderBy(*order))).filter("nth = 1")
    return first.orderBy(*order).limit(n).select("posting_key", "identity", state.alias("link_status"))


def lead_outcomes(leads: DataFrame, results: DataFrame) -> DataFrame:
    """(posting_key, outcome) of each active lead: what its page's result says, or unchecked."""
    met = leads.filter(c("active") & c("source_mode").isin(*INDEX_MODES)).join(results, c("canonical_apply_url") == c("url"), "left")
    outcome = F.when(c("url").isNull(), "unchecked").when(c("matched"), "verified").when(c("closed"), "closed").when(c("result") == "blocked", "blocked").when(c("error").isNotNull(), "error").otherwise("unverified")
    return met.select("posting_key", outcome.alias("outcome"))


def roles(postings: DataFrame) -> DataFrame:
    """(source_mode, identity, role) of active technical targets."""
    return postings.filter(c("active") & is_target() & c("category").isin(*TECH)).select("source_mode", "identity", tx.coverage_role_signature(c("company"), c("normalized_title")).alias("role")).distinct()


def recalled(postings: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Identities of the registry floor that the modes hold, by identity or by a shared role."""
    own = roles(postings)
    floor, other = own.filter(c("source_mode") == "registry"), own.filter(c("source_mode").isin(*modes))
    by_identity = floor.join(other.select("identity").distinct(), "identity", "left_semi")
    return by_identity.unionByName(floor.join(other.select("role").distinct(), "role", "left_semi")).select("identity").distinct()


def direct_only(postings: DataFrame) -> DataFrame:
    """Direct identities of which no role is in the registry."""
    own = roles(postings)
    shared = own.filter(c("source_mode") == "direct").join(own.filter(c("source_mode") == "registry").select("role").distinct(), "role", "left_semi")
    return own.filter(c("source_mode") == "direct").join(shared.select("identity").distinct(), "identity", "left_anti").select("identity").distinct()


def merged_observations(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Raw employer observations by key: arrays are united, signals keep their maximum, a resolved one stays so."""
    both = old.alias("o").join(new.alias("n"), c("o.key") == c("n.key"), "full_outer")
    empty = F.array().cast("array<string>")
    united = lambda x: F.array_sort(F.array_union(F.coalesce(f"o.{x}", empty), F.coalesce(f"n.{x}", empty))).alias(x)
    # Of a key in both maps the new value stays.
    nothing = F.create_map().cast("map<string,string>")
    older, newer = F.coalesce("o.metadata", nothing), F.coalesce("n.metadata", nothing)
    metadata = F.map_concat(F.map_filter(older, lambda k, _: ~F.array_contains(F.map_keys(newer), k)), newer)
    return both.select(
        F.coalesce("n.key", "o.key").alias("key"), F.coalesce("n.name", "o.name").alias("name"), united("aliases"), united("sectors"), F.coalesce("n.location", "o.location").alias("location"), F.greatest("o.signal", "n.signal").alias("signal"),
        metadata.alias("metadata"), F.when(c("n.key").isNotNull(), as_of).otherwise(c("o.last_seen_at")).alias("last_seen_at"), F.when(c("n.key").isNull() | (c("o.probe_status") == "resolved"), c("o.probe_status")).otherwise("candidate").alias("probe_status"),
    )


def merged_candidates(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Candidates found again count one more piece of evidence; scope current and status validated stay."""
    both = old.alias("o").join(new.alias("n"), c("o.source") == c("n.source"), "full_outer")
    found = c("n.source").isNotNull()
    return both.select(
        F.coalesce("o.source", "n.source").alias("source"), F.coalesce("n.kind", "o.kind").alias("kind"), F.when(c("o.scope") == "current", "current").otherwise(F.coalesce("n.scope", "o.scope")).alias("scope"),
        (F.coalesce("o.evidence_count", F.lit(0)) + F.when(found, 1).otherwise(0)).cast("long").alias("evidence_count"), F.when(~found | (c("o.status") == "validated"), c("o.status")).otherwise("candidate").alias("status"),
        F.coalesce("n.origin", "o.origin").alias("origin"), F.when(found, as_of).otherwise(c("o.discovered_at")).alias("last_seen_at"),
    )


def merged_health(health: DataFrame, runs: DataFrame, quarantine: int = 3) -> DataFrame:
    """Health after one run a source: a success clears failures, the third failure in a row quarantines."""
    run = runs.alias("n").join(health.alias("o"), c("o.source") == c("n.source"), "full_outer")
    ran, failed, productive, failures = c("n.source").isNotNull(), c("n.error").isNotNull(), c("n.target_rows") > 0, F.coalesce("o.consecutive_failures", F.lit(0)) + 1
    old = F.coalesce("o.lifecycle", F.lit("candidate"))
    won = F.when(productive, "productive").when(old == "quarantined", "candidate").otherwise(old)
    lost = F.when(c("o.source").isNotNull() & (failures >= quarantine), "quarantined").otherwise(old)
    worn = c("o.source").isNotNull() & (failures >= quarantine)
    pick = lambda success, failure, none: F.when(~ran, none).when(failed, failure).otherwise(success)
    return run.select(
        F.coalesce("n.source", "o.source").alias("source"), pick(c("n.complete"), F.lit(False), c("o.complete")).alias("complete"), F.coalesce("n.rows_scanned", "o.rows_scanned").cast("long").alias("rows_scanned"),
        pick(c("n.target_rows"), F.coalesce("o.target_rows", F.lit(0)), c("o.target_rows")).cast("long").alias("target_rows"), F.coalesce("n.finished_at", "o.last_attempt_at").alias("last_attempt_at"),
        pick(F.coalesce(F.when(~c("n.status").isin("blocked", "broken"), c("n.finished_at")), c("o.last_success_at")), c("o.last_success_at"), c("o.last_success_at")).alias("last_success_at"),
        F.when(ran, c("n.status")).otherwise(c("o.status")).alias("status"), pick(F.when(productive, "current").otherwise(c("n.scope")), F.when(worn, "historical").otherwise(c("n.scope")), c("o.scope")).alias("scope"),
        pick(won, lost, c("o.lifecycle")).alias("lifecycle"), pick(F.lit(0), failures, c("o.consecutive_failures")).cast("long").alias("consecutive_failures"),
    )
