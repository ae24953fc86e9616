"""Queries of gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CATEGORIES, SEASONS, TARGET_RANK, TECH
from ..operators import feed
from ..operators import gates as op
from ..sources.fixtures import AS_OF
from . import dialect
from . import feed as feeds
from .dialect import TEXTS
from .figures import BAD, SQL as FIGURES
from .scalars import names

c = F.col
TEXTS["index"] = f"select * from {{families}} where category in ({names(TECH)})"
TEXTS["published_openings"] = "select canonical_apply_url, case when length(title) % 11 = 4 then null else sensor_at end as sensor_at from {fuse_openings} where length(title) % 17 <> 3"
TEXTS["sensor_postings"] = "select canonical_apply_url, posted_at from {postings} where source_mode in ('registry', 'external-index', 'verification-lead')"
PARTS = ("/families?sort=newest", "/families?sort=verified", "/facets", "/stats")


def now():
    return F.expr(AS_OF)


RUNS = {
    "gate_snapshot_sanity": lambda got, _: op.snapshot_sanity(got("index"), got("families_before"), now(), F.lit(1).cast("long")), "gate_snapshot_contract": lambda got, at: op.snapshot_contract(got("index"), feeds.queries()["export_preset_responses"](*at), PARTS, feed.by_track(got("families")), now()),
    "gate_snapshot_usable": lambda got, _: op.snapshot_usable(got("index"), got("index"), now()), "gate_sensor_recall": lambda got, _: op.sensor_recall(got("sensor_postings"), got("published_openings"), now()), "gate_market_snapshot": lambda got, _: op.market_snapshot(got("fuse_families"), got("runs"), now()),
    "gate_export_health": lambda got, _: op.export_health(got("targets_leased"), now()), "gate_production": lambda got, _: op.production(got("targets_leased"), got("families"), got("runs"), got("employer_universe"), now()), "gate_coverage": lambda got, _: op.coverage(got("targets_leased"), got("employer_universe"), now()),
    "gate_stall": lambda got, _: op.stall(got("families"), got("catalog"), got("queue"), now()), "gate_row_constraints": lambda got, _: op.row_constraints(got("families")),
}


def queries() -> dict:
    return {k: lambda spark, sf_dir, f=f: f(lambda name: dialect.frame(spark, sf_dir, name), (spark, sf_dir)) for k, f in RUNS.items()}


def judged(row: str, rules: dict[str, str]) -> str:
    failed = "concat_ws(',', " + ", ".join(f"case when coalesce({ok}, false) then null else '{name}' end" for name, ok in rules.items()) + ")"
    return f"select *, {failed} as failed, {failed} = '' as passed from ({row})"


KEYS = "count(*) as roles, count(distinct trim(family_key)) as distinct_keys, count(*) filter (trim(family_key) = '') as blank_keys, max(last_verified_at) as generated_at"
MINUTES = "date_diff('second', {0}, {{as_of}}) / 60.0"
ATTENTION = f"(select * from (select source, case when last_status in ({BAD}) then last_status when last_complete_at is null then 'never_completed' when interval_seconds > 0 and date_diff('second', last_complete_at, {{as_of}}) > 2 * interval_seconds then case when lease_expires_at > {{as_of}} then 'overdue_running' else 'overdue' end end as reason from {{targets_leased}} where enabled) where reason is not null)"
known = lambda values: names(values)
SQL = {
    "gate_snapshot_sanity": judged("select *, 1::bigint as expected from (select coalesce(sum(direct_openings), 0)::bigint as active, count(distinct company) filter (direct_openings > 0) as companies, count(*) filter (direct_openings > 0 and first_detected_at >= {as_of} - interval 24 hours) as new_today, count(*) as exported from {index}), (select coalesce(sum(direct_openings), 0)::bigint as previous from {families_before})", {"minimum": "active >= 100", "companies": "companies <= active", "new": "new_today <= active", "complete": "exported >= expected", "collapse": "previous < 100 or active >= floor(previous * 0.5)"}),
    "gate_snapshot_contract": judged(f"select *, {len(PARTS)}::bigint as parts, roles as expected, round(date_diff('second', generated_at, {{as_of}}) / 3600.0, 2) as age_hours from (select {KEYS}, coalesce(sum(strlen(family_key || company || title || locations)), 0)::bigint as bytes from {{index}})", {"parts": f"parts = {len(PARTS)}", "empty": "roles > 0 and expected > 0", "incomplete": "roles >= expected", "keys": "blank_keys = 0 and distinct_keys = roles", "future": "age_hours >= -1", "old": "age_hours <= 168", "size": "bytes <= 15000000"}),
    "gate_snapshot_usable": judged(f"select *, roles as total, round({MINUTES.format('generated_at')}, 1) as age_minutes from (select {KEYS} from {{index}})", {"future": "age_minutes >= -5", "old": "age_minutes <= 45", "empty": "roles > 0", "total": "total = roles", "keys": "blank_keys = 0 and distinct_keys = roles"}),
    "gate_sensor_recall": judged("select *, expected_urls - published_urls as missing_urls, case when expected_urls = 0 then 1.0 else round(published_urls::double / expected_urls, 6) end as recall from (select count(*) as expected_urls, count(p.u) as published_urls, count(s.t) as timestamped_urls, count(*) filter (s.t is not null and coalesce(p.t < s.t, true)) as timestamp_drops, count(*) filter (s.t >= {as_of} - interval 1 day) as recent_timestamped_urls, count(*) filter (s.t >= {as_of} - interval 1 day and coalesce(p.t < s.t, true)) as recent_timestamp_drops from (select canonical_apply_url as u, max(posted_at) as t from {sensor_postings} group by 1) s left join (select canonical_apply_url as u, max(sensor_at) as t from {published_openings} group by 1) p on p.u = s.u)", {"recall": "recall >= 0.995", "timestamps": "timestamp_drops = 0"}),
    "gate_market_snapshot": judged("select * from (select count(*) as families, max(market_event_at) as newest_event from {fuse_families}), (select count(distinct source) as sensors from {runs} where status = 'ok')", {"families": "families >= 100", "sensors": "sensors >= 3", "newest": "date_diff('hour', newest_event, {as_of}) <= 96"}),
    "gate_export_health": judged(f"select total, fresh, healthy, round({MINUTES.format('latest_activity_at')}, 1) as activity_minutes from ({FIGURES['inventory_state']})", {"empty": "total > 0", "fresh": "fresh > 0 and fresh <= total", "future": "activity_minutes >= -5", "old": "activity_minutes <= 360"}),
    "gate_production": judged(f"""select *, running > 0 and activity_minutes <= 30 as catching_up from (select total, running, fresh, unhealthy, degraded, greatest(0.0, round({MINUTES.format('latest_activity_at')}, 1)) as activity_minutes from ({FIGURES['inventory_state']})),
      (select count(*) as active_families, coalesce(sum(direct_openings), 0)::bigint as active_listings, count(distinct company) as companies from {{families}} where target_match <> 'not_internship' and direct_openings > 0), (select count(*) as recent_snapshots, count(*) filter (status in ({BAD})) as recent_failed from {{runs}} where finished_at >= {{as_of}} - interval 24 hours),
      (select count(*) as known_employers, count(*) filter (status = 'enumerated') as enumerated_employers from {{employer_universe}})""", {"sources": "total >= 100", "listings": "active_listings >= 25", "activity": "activity_minutes <= 90", "fresh": "fresh > 0 or catching_up", "employers": "known_employers > 0", "enumerated": "enumerated_employers > 0"}),
    "gate_coverage": f"""select 'verdict' as part, case when bad is not null then 'failure' when unhealthy > 0 or n > 0 then 'pending' when fresh <> total then 'failure' else 'success' end as source, coalesce(bad, case when unhealthy > 0 or n > 0 then 'sources need attention' when fresh <> total then 'counts disagree' else 'all sources are fresh' end) as reason, greatest(unhealthy, n) as n from
      (select *, case when total <= 0 or fresh > total or unhealthy > total then 'counts are invalid' when enumerated + unresolved <> known or blind > unresolved then 'employer counts are contradictory' when known = 0 then 'no employers' when enumerated = 0 then 'no enumerated employers' when listed <> apart then 'blank or duplicate sources' when unhealthy > n then 'unhealthy sources are not named' end as bad from
      (select total, fresh, unhealthy from ({FIGURES['inventory_state']})), (select count(*) as known, count(*) filter (status = 'enumerated') as enumerated, count(*) filter (status <> 'enumerated') as unresolved, count(*) filter (blind_spot) as blind from {{employer_universe}}), (select count(*) as n from {ATTENTION}), (select count(*) as listed, count(distinct nullif(trim(source), '')) as apart from {{targets_leased}}))
      union all select 'attention', source, reason, 1 from {ATTENTION}""",
    "gate_stall": judged(f"select listing_hours, due, oldest_due_age_minutes as due_minutes from (select round(date_diff('second', max(coalesce(latest_posted_at, first_detected_at)), {{as_of}}) / 3600.0, 2) as listing_hours from {{families}} where direct_openings > 0), ({FIGURES['source_growth']})", {"visible_listing_activity_stalled": "listing_hours <= 48", "source_candidate_backlog_stalled": "due_minutes is null or due_minutes <= 180"}),
    "gate_row_constraints": judged(f"select count(*) as families, count(*) filter (trim(company) = '' or trim(title) = '' or trim(family_key) = '') as blank, count(*) filter (least(opening_count, direct_openings, backstop_openings) < 0) as negative, count(*) filter (opening_count <> direct_openings + backstop_openings) as uneven, count(*) filter (category not in ({known(CATEGORIES)}, 'other') or target_match not in ({known(TARGET_RANK)}) or posted_precision not in ('timestamp', 'day', 'unknown') or season not in ({known(SEASONS)})) as unknown_kinds, count(*) filter (first_detected_at is null or last_verified_at is null) as undated from {{families}}", {k: f"{k} = 0" for k in ("blank", "negative", "uneven", "unknown_kinds", "undated")}),
}


def oracle() -> dict[str, str]:
    return {k: dialect.whole(v) for k, v in SQL.items()}
