"""Queries of figures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FAILURES, TARGETS, TECH
from ..operators import figures as op
from ..operators import reconcile
from ..sources.fixtures import AS_OF
from . import dialect, reconcile as plans
from .dialect import TEXTS
from .scalars import any_sql, names

c = F.col
VIEWS = {
    "targets_leased": "select *, case consecutive_failures when 2 then {as_of} + interval 10 minutes when 3 then {as_of} - interval 10 minutes end as lease_expires_at, last_finished_at + (interval 1 day) * (consecutive_failures * 30) as next_run_at from {fx_targets}",
    "families_before": "select * from {families} where opening_count % 3 <> 0",
    "health_runs": "select source, complete, status, error, rows_scanned, scope, case when rows_scanned % 3 = 0 then rows_scanned + 5 end as expected_rows, case when rows_scanned % 7 = 0 then 'verification' else mode end as mode, case rows_scanned % 4 when 0 then 'page without JobPosting' when 1 then 'access-blocked' when 2 then 'stale/closed' end as note from {runs}",
    "projection": "select max(first_seen_at) as projected_at, min(last_seen_at) as posting_at, max(last_seen_at) as removal_at from {postings}",
}
TEXTS.update(VIEWS)
HOURS, SHARDS = 720, 7


def now():
    return F.expr(AS_OF)


RUNS = {
    "inventory_state": lambda got: op.inventory_state(got("targets_leased"), now()), "provider_health": lambda got: op.provider_health(got("targets_leased"), now()), "source_growth": lambda got: op.source_growth(got("catalog"), got("queue"), now()),
    "conversion_funnel": lambda got: op.funnel(got("families"), got("postings"), got("runs"), got("catalog"), now(), HOURS), "failure_counts": lambda got: op.failure_counts(got("queue"), F.coalesce("last_error", "status")).withColumn("examples", F.array_join("examples", "|")),
    "zero_yield_sources": lambda got: op.zero_yield(got("runs"), now(), HOURS, 50), "task_overdue": lambda got: op.tasks(got("queue"), now()), "publication_delta": lambda got: op.publication_delta(got("families_before"), got("families"), got("postings"), now(), HOURS),
    "coverage_summary": lambda got: op.coverage(got("families"), got("postings")), "coverage_contract": lambda got: op.contract(got("health_runs")), "feed_stats": lambda got: op.feed_stats(got("families"), got("postings"), got("fx_targets"), now()),
    "market_stats": lambda got: op.market_stats(got("fuse_families"), now()), "crawl_summary": lambda got: op.crawl_summary(got("runs")), "sensor_health": lambda got: op.sensor_health(reconcile.latest(got("runs")), got("fuse_families")), "shard_health": lambda got: op.shard_health(got("runs"), SHARDS),
    "source_probe_audit": lambda got: op.probe_audit(got("postings")), "feed_lag": lambda got: op.feed_lag(got("postings"), got("runs"), got("projection")),
}


def queries() -> dict:
    return {k: lambda spark, sf_dir, f=f: f(lambda name: dialect.frame(spark, sf_dir, name)) for k, f in RUNS.items()}


GOOD, TECHS = names(TARGETS), names(TECH)
BAD = "'broken', 'blocked', 'truncated', 'partial'"
STATE = f"(select *, last_complete_at is null as never, date_diff('second', last_complete_at, {{as_of}}) > greatest(interval_seconds * 3, 5400) as late, last_status in ({BAD}) as bad from {{targets_leased}} where enabled and scheduled and validated and scope = 'current')"
COUNTS = "count(*) as total, count(*) filter (lease_expires_at > {as_of}) as running, count(*) filter (never) as never_completed, count(*) filter (late) as overdue, count(*) filter (bad) as degraded, count(*) filter (not never and not late and not bad) as fresh, count(*) filter (never or late or bad) as unhealthy, max(last_finished_at) as latest_activity_at, min(last_complete_at) as coverage_watermark"
PCT = "case when count(*) > 0 then round(100.0 * {0} / count(*), 1) else 0.0 end"
FINE = f"complete and error is null and status not in ({BAD})"
BUCKET = "case " + " ".join(f"when {any_sql('lower(said)', t)} then '{k}'" for k, t in FAILURES) + " else case when lower(said) in ('', 'none', 'unknown', 'candidate', 'retry', 'rejected') then 'unclassified' else 'other' end end"
SINCE = f"{{as_of}} - interval {HOURS} hours"
RATE = "case when {b} > 0 then round({a}::double / {b}, 4) else 0.0 end"
OWN = f"from {{postings}} where active and target_match in ({GOOD}) and category in ({TECHS})"
gaps = lambda f: f"(select count(*) from {{postings}} where active and target_match in ({GOOD}) and source_mode in ('direct', 'verification') and family_key not in (select family_key from {{{f}}}))"
jobs = lambda f: f"(select count(*) from {{{f}}} where target_match in ({GOOD}) and direct_openings > 0 and first_detected_at >= {SINCE})"
ids = lambda mode, extra="": f"(select count(distinct identity) {OWN} and source_mode = '{mode}'{extra})"
recalled = lambda modes: f"(select count(*) from ({plans.recall_sql(modes)}))"
CLASS = {
    "configured_sources": "true", "current_sources": "now", "historical_sources": "past", "complete_enumerators": "now and board", "historical_enumerators": "past and board", "actionable_anomalies": "now and (error is not null or status in ('broken', 'truncated', 'empty'))",
    "access_limited": "now and (status = 'blocked' or contains(coalesce(note, ''), 'access-blocked'))", "stale_verifications": "now and mode = 'verification' and (status = 'stale' or contains(coalesce(note, ''), 'stale/closed'))", "unstructured_verifications": "now and mode = 'verification' and (status = 'unstructured' or contains(coalesce(note, ''), 'without JobPosting'))",
    "dormant_watches": "past and status in ('dormant', 'empty', 'stale')", "historical_failures": "past and error is not null", "truncated_sources": "now and mode = 'board' and rows_scanned < expected_rows",
}
MARKED = "(select *, scope = 'current' as now, scope = 'historical' as past, complete and mode = 'board' and status = 'ok' as board from {health_runs})"
DATED = "coalesce(latest_posted_at, latest_sensor_at)"
DAY = "{as_of} - interval 24 hours"
DUE = "status in ('candidate', 'retry') and next_run_at <= {as_of} and (leased_until is null or leased_until < {as_of})"
SQL = {
    "inventory_state": f"select {COUNTS}, (select count(*) from {{fx_targets}} where scheduled and validated and scope = 'historical') as historical, {PCT.format('count(*) filter (not never and not late and not bad)')} as fresh_percent, count(*) > 0 and count(*) filter (never or late or bad) = 0 as healthy from {STATE}",
    "provider_health": f"select kind, {COUNTS}, count(*) filter (next_run_at <= {{as_of}}) as due, {PCT.format('count(*) filter (next_run_at <= {as_of})')} as due_percent, {PCT.format('count(*) filter (not never and not late and not bad)')} as fresh_percent from {STATE} group by kind",
    "source_growth": f"""select (select count(*) from {{catalog}}) as catalog_total, (select count(*) from {{catalog}} where validated) as validated_total, count(*) as candidate_total, count(*) filter (status = 'candidate') as candidate, count(*) filter (status = 'retry') as retry, count(*) filter (status = 'rejected') as rejected, count(*) filter ({DUE}) as due,
      count(*) filter (discovered_at >= {DAY}) + (select count(*) from {{catalog}} where last_discovered_at >= {DAY}) as new_unique_24h, count(*) filter (discovered_at >= {{as_of}} - interval 7 days) + (select count(*) from {{catalog}} where last_discovered_at >= {{as_of}} - interval 7 days) as new_unique_7d,
      greatest(max(discovered_at), (select max(last_discovered_at) from {{catalog}})) as latest_unique_source_at, min(next_run_at) filter ({DUE}) as oldest_due_at, round(date_diff('second', min(next_run_at) filter ({DUE}), {{as_of}}) / 60.0, 1) as oldest_due_age_minutes from {{queue}}""",
    "conversion_funnel": f"""with f as (select count(*) filter (good) as active_verified_jobs, coalesce(sum(direct_openings) filter (good), 0)::bigint as active_verified_openings, count(distinct company) filter (good) as active_verified_companies, count(*) filter (good and fresh) as new_verified_jobs, count(*) filter (fresh and direct_openings > 0 and target_match <> 'not_internship') as new_visible_jobs from (select *, target_match in ({GOOD}) and direct_openings > 0 as good, first_detected_at >= {SINCE} as fresh from {{families}})),
      p as (select count(*) as discovered_postings, count(*) filter (target_match in ({GOOD})) as target_postings, count(*) filter (target_match in ({GOOD}) and source_mode in ('direct', 'verification')) as verified_postings, count(*) filter (target_match in ('not_internship', 'wrong_year', 'wrong_season')) as rejected_postings from {{postings}} where first_seen_at >= {SINCE}),
      s as (select count(*) as crawl_attempts, count(distinct source) as crawled_sources, count(*) filter (ok) as complete_crawls, count(*) filter (not ok) as failed_crawls, coalesce(sum(rows_scanned), 0)::bigint as rows_scanned, coalesce(sum(target_rows), 0)::bigint as target_rows, coalesce(sum(new_rows), 0)::bigint as new_rows, count(*) filter (ok and rows_scanned > 0 and target_rows = 0) as zero_target_crawls, count(*) filter (ok and new_rows = 0) as zero_new_crawls from (select *, complete and error is null as ok from {{runs}} where finished_at >= {SINCE})),
      c as (select count(*) as promoted_sources from {{catalog}} where validated and origin = 'probe' and last_discovered_at >= {SINCE})
      select f.*, p.*, s.*, c.*, {RATE.format(a='verified_postings', b='discovered_postings')} as verified_rate, {RATE.format(a='target_rows', b='rows_scanned')} as target_rate, {RATE.format(a='new_verified_jobs', b='promoted_sources')} as job_rate from f, p, s, c""",
    "failure_counts": f"select reason, count(*) as n, array_to_string(list_sort(list(distinct said))[1:3], '|') as examples from (select said, {BUCKET} as reason from (select coalesce(last_error, status)[1:240] as said from {{queue}})) group by reason order by n desc, reason limit 25",
    "zero_yield_sources": f"select source, sum(rows_scanned)::bigint as rows_scanned, count(*) as crawls from {{runs}} where finished_at >= {SINCE} group by source having sum(new_rows) = 0 order by rows_scanned desc, source limit 50",
    "task_overdue": "select source, next_run_at, next_run_at <= {as_of} and coalesce(leased_until < {as_of}, true) as overdue from {queue}",
    "publication_delta": f"select *, greatest(0, gaps_before - gaps_after) as gaps_repaired from (select {gaps('families_before')} as gaps_before, {gaps('families')} as gaps_after, {jobs('families')} - {jobs('families_before')} as verified_jobs_delta)",
    "coverage_summary": f"""select *, registry_floor - independent_matches as registry_only, case when registry_floor > 0 then round(100.0 * independent_matches / registry_floor, 1) end as registry_recall_percent, case when direct_applications > 0 then round(100.0 * dated / direct_applications, 1) end as direct_date_coverage_percent from (select (select count(*) from f) as families, (select count(distinct company) from f) as companies, (select count(*) from f where direct_openings > 0) as direct_families, (select count(*) from f where direct_openings = 0 and backstop_openings > 0) as backstop_only,
      (select count(distinct identity) {OWN} and source_mode in ('registry', 'direct', 'verification', 'external-index')) as known_applications, {ids('registry')} as registry_floor, {ids('direct')} as direct_applications, {ids('verification')} as verified_applications, (select count(distinct source) {OWN} and source_mode = 'direct') as productive_direct_sources, {ids('direct', ' and posted_at is not null')} as dated,
      {recalled("'direct'")} as direct_matches, {recalled("'direct', 'verification'")} as independent_matches, (select count(*) from ({plans.SQL['direct_only']})) as direct_only)""".replace("from f)", f"from {{families}} where target_match in ({GOOD}) and category in ({TECHS}))").replace("from f where ", f"from {{families}} where target_match in ({GOOD}) and category in ({TECHS}) and ").replace("select *, registry_floor", "select * exclude (dated), registry_floor"),
    "coverage_contract": " union all ".join(f"select 'class' as figure, '{k}' as value, count(*) filter ({v}) as n from {MARKED}" for k, v in CLASS.items()) + " union all select 'mode', mode, count(*) from {health_runs} group by mode union all select 'status', coalesce(status, 'unknown'), count(*) from {health_runs} group by 2",
    "feed_stats": f"""select *, new_urls_24h - removed_urls_24h as net_urls_24h from (select count(*) filter (v) as role_families, coalesce(sum(direct_openings) filter (v), 0)::bigint as active_listings, count(distinct company) filter (v) as companies, count(*) filter (v and latest_posted_at >= {DAY}) as new_verified_24h, count(*) filter (v and first_detected_at >= {DAY}) as discovered_24h, count(*) filter (not v and backstop_openings > 0) as leads, coalesce(sum(backstop_openings) filter (not v and backstop_openings > 0), 0)::bigint as lead_apps from (select *, direct_openings > 0 as v from {{families}} where year = 2027 and category in ({TECHS}))),
      (select count(distinct canonical_apply_url) filter (first_seen_at >= {DAY} and removed_at is null) as new_urls_24h, count(distinct canonical_apply_url) filter (removed_at >= {DAY}) as removed_urls_24h from {{postings}} where source_mode = 'direct' and year = 2027 and category in ({TECHS})), (select count(*) as validated_sources from {{fx_targets}} where enabled and scheduled and validated and scope = 'current')""",
    "market_stats": f"""select *, new_verified_24h as new_today, new_verified_24h as new_24h, active_listings as verified_listings, role_families as verified_families from (select count(*) filter (verified) as role_families, coalesce(sum(direct_openings) filter (verified), 0)::bigint as active_listings, count(distinct lower(company)) filter (verified and company <> '') as companies, count(*) filter (verified and dated >= {DAY}) as new_verified_24h, count(*) filter (active >= {DAY}) as market_events_24h, count(*) filter (dated >= {DAY}) as dated_market_events_24h,
      count(*) filter (latest_posted_at >= {DAY}) as employer_posted_24h, count(*) filter (latest_sensor_at >= {DAY}) as sensor_reported_24h, count(*) filter (dated is null and active >= {DAY}) as first_seen_only_24h, count(*) filter (first_detected_at >= {DAY}) as discovered_24h, count(*) filter (not verified) as leads, coalesce(sum(backstop_openings) filter (not verified), 0)::bigint as lead_apps, count(*) filter (not verified and active >= {{as_of}} - interval 14 days) as verification_backlog, max(active) as newest_event
      from (select *, {DATED} as dated, coalesce({DATED}, first_detected_at) as active from {{fuse_families}} where category in ({TECHS})))""",
    "crawl_summary": f"select 'summary' as part, 'selected' as value, count(*) as n from {{runs}} union all select 'summary', 'refreshed', count(distinct source) from {{runs}} where {FINE} union all select 'status', coalesce(status, 'ok'), count(*) from {{runs}} group by 2 union all select 'failure', source || ' ' || error[1:300], count(*) from (select * from {{runs}} where error is not null order by finished_at, source limit 100) group by 2",
    "sensor_health": f"""select *, case when total > 0 then round(100.0 * fresh / total, 1) else 0.0 end as fresh_percent, unhealthy = 0 and fresh > 0 as healthy, fresh > 0 and fresh >= greatest(1, total // 2) and families > 0 as ok from (select count(*) as total, count(*) filter (status = 'ok') as fresh, count(*) filter (status <> 'ok') as unhealthy, max(finished_at) as latest_activity_at, min(finished_at) filter (status = 'ok') as coverage_watermark from {plans.NEWEST_RUN}),
      (select count(*) as families, max(coalesce({DATED}, first_detected_at)) as freshest_market_event_at from {{fuse_families}})""",
    "shard_health": f"select (('0x' || substr(sha256(source), 1, 16))::ubigint % {SHARDS})::int as shard, count(*) as selected, count(distinct source) filter ({FINE}) as refreshed, sum(rows_scanned)::bigint as rows_scanned from {{runs}} group by 1",
    "source_probe_audit": f"select source, count(*) as n, count(*) filter (target_match in ({GOOD})) as target_rows, count(posted_at) filter (source_mode in ('direct', 'verification')) as trusted_dates, max(posted_at) filter (source_mode in ('direct', 'verification')) as newest, 0 as total from {{postings}} group by source union all select null, count(*), count(*) filter (target_match in ({GOOD})), count(posted_at) filter (source_mode in ('direct', 'verification')), max(posted_at) filter (source_mode in ('direct', 'verification')), 1 from {{postings}}",
    "feed_lag": "select projected_at is not null as ready, projected_at is null or coalesce(p > posting_at, p is not null) or coalesce(r > removal_at, r is not null) as lagging, projected_at, p as latest_posting_at, posting_at as projected_posting_at, r as latest_removal_at, removal_at as projected_removal_at from (select max(first_seen_at) as p from {postings} where active and target_match <> 'not_internship'), (select max(finished_at) as r from {runs} where removed_rows > 0), {projection}",
}


def oracle() -> dict[str, str]:
    return {k: dialect.whole(v) for k, v in SQL.items()}
