"""Queries of due lists, catalogs and readiness over views of the tables, and SQL that was written apart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..constants import TARGET_RANK, TARGETS, TECH
from ..functions import text as tx
from ..operators import dates
from ..operators import schedule as op
from ..sources.fixtures import AS_OF
from . import dialect, figures, reconcile  # noqa: F401  they register views
from .dialect import TEXTS
from .scalars import clean, digest, names, rep

c = F.col
LATER = "timestamp '2027-02-01 00:00:00'"
SEEN_AT = "timestamp '2024-01-25 00:00:00'"
HOURS = (720, 24 * 365 * 4)
MODE = "case kind when 'workday-search' then 'board-search' when 'domain' then case when consecutive_failures % 2 = 0 then 'verification' else 'domain' end else 'board' end"

#: Views; one text for both engines.
VIEWS = {
    "due_targets": "select *, last_finished_at - (interval 1 hour) * consecutive_failures as last_started_at, interval_seconds / 900 as priority from {targets_leased}",
    "census_seen": "select source_id as key, case when value > 50 then concat('https://', source_id, '.example') end as official_url, round(value / 10) as technical_signal, round(value / 30) as internship_signal, cast(floor(value) as int) % 4 as consecutive_failures, observed_at as last_seen_at, case when value > 90 then 'resolved' when value > 40 then 'unresolved' else 'retry' end as probe_status, observed_at + interval 3 days as next_probe_at, case when value < 20 then observed_at + interval 20 days end as lease_expires_at from (select *, row_number() over (partition by source_id order by observed_at desc, source) as nth from {fx_observations}) o where nth = 1",
    "targets_due": "select source, interval_seconds, enabled, scheduled, last_status, case when consecutive_failures % 2 = 0 then last_complete_at when consecutive_failures = 1 then {as_of} - interval 1 hour end as last_complete_at, {as_of} + (interval 1 second) * (interval_seconds * consecutive_failures) as next_run_at from (select *, case consecutive_failures when 4 then 'ok' else 'empty' end as status_ from {fx_targets}) t",
    "healths": f"select source, {MODE} as mode, last_finished_at as last_attempt_at from {{fx_targets}} where interval_seconds <> 900",
    "catalog_modes": f"select source, {MODE} as mode, scope from {{fx_targets}}",
    "posted": "select replace(source, 'schema:', 'greenhouse:') as source, source_mode, active, target_match from {postings} where length(title) % 9 < 3",
    "health_more": "select * from {health_now} union all select concat(source, '-old') as source, complete, rows_scanned, target_rows, last_attempt_at, last_success_at, status, scope, lifecycle, consecutive_failures from {health_now} where consecutive_failures = 3",
    "finds": "select case when evidence_count % 3 = 0 then concat(source, '-new') else source end as source, 'domain' as kind, case when scope = 'current' then 'historical' else 'current' end as scope, status = 'validated' as validated, 'sweep' as origin from {fx_candidates} where evidence_count % 2 = 0",
    "named": "select replace(source, ':', ':acme') as source, kind, scope from {fx_targets} where consecutive_failures < 4",
    "spelt": "select concat(replace(source, ':', ':Acme'), case when consecutive_failures % 2 = 1 then '-B' else '' end) as source, 'lever' as kind, 'historical' as scope from {fx_targets}",
    "dated": "select id, case id % 8 when 0 then concat('4 July 2001 ', cast(n % 24 as string), ':05') when 1 then 'Wed, 04 Jul 2001 22:30:00 +0200' when 2 then concat('Jul 4th 2001 at ', cast(n % 12 + 1 as string), ' pm') when 3 then '2001/07/04' when 4 then '2001-07-04T10:00:00Z' when 5 then cast(n + 1000000000 as string) when 6 then 'no date at all' end as raw from {fx_texts}",
    "labelled": "select id, case id % 9 when 0 then concat('greenhouse:', cast(id as string)) when 1 then concat('Registry :  job list ', cast(id as string)) when 2 then 'verification-lead:usa' when 3 then 'external-index:big_tech-list2go:x' when 4 then concat('own board:', cast(id as string)) when 6 then 'DIRECT' when 7 then 'registry: - ' when 8 then 'workday:a:b' end as source from {fx_texts}",
    "sensor_jobs": "select canonical_apply_url, first_seen_at from {postings} where source_mode in ('registry', 'external-index', 'verification-lead')",
    "feed_jobs": "select canonical_apply_url, first_seen_at from {postings} where active and source_mode in ('direct', 'verification')",
}
TEXTS.update(VIEWS)


def now():
    return F.expr(AS_OF)


def plain(name, kind="timestamp_ntz"):
    return c(name).cast(kind).alias(name)


def nested(got):
    """Families with their postings as openings."""
    opening = F.struct("identity", "canonical_apply_url", "source_mode", "first_seen_at", "last_seen_at")
    return got("postings").groupBy("family_key").agg(F.collect_list(opening).alias("openings"))


def windows(run):
    out = None
    for hours in HOURS:
        one = run(hours).withColumn("hours", F.lit(hours))
        out = one if out is None else out.unionByName(one)
    return out


def stats(got):
    return op.inventory_counts(got("families"), got("catalog"))


def _promoted(got):
    """Each opening of the feed's families, and of the families of the whole inventory, where every posting is one."""
    out = None
    for part, name in (("feed", "fold_applications"), ("inventory", "postings")):
        families = got(name).groupBy("family_key").agg(F.collect_list(F.struct("identity", "posting_key", "source_mode")).alias("openings"))
        families = op.promoted(families).withColumn("promoted", F.size(F.filter("openings", lambda o: o["verification_mode"] == "employer-page")).cast("long"))
        one = families.select(F.lit(part).alias("part"), "family_key", F.inline("openings"), "direct_openings", "backstop_openings", "promoted")
        out = one if out is None else out.unionByName(one)
    return out.select("part", "identity", "family_key", "posting_key", "source_mode", "verification_mode", "direct_openings", "backstop_openings", "promoted")


RUNS = {
    "due_sources": lambda got: op.due_sources(got("due_targets"), now(), 50).select("source", "kind", plain("next_run_at")),
    "due_candidates": lambda got: op.due_candidates(got("queue"), now(), 100).select("source", "kind", "evidence_count"),
    "due_observations": lambda got: op.due_observations(got("census_seen"), F.expr(SEEN_AT), 100).select("key", "official_url"),
    "links_to_check": lambda got: op.links_to_check(got("leads"), 500).select("canonical_apply_url", plain("last_checked")),
    "requeue_empty_current": lambda got: op.requeued(got("targets_due"), got("catalog"), now()).select("source", plain("due_at")),
    "productive_sources": lambda got: op.productive(got("healths"), got("posted")).select("source", "mode"),
    "refresh_selection": lambda got: op.refresh_selection(got("catalog_modes"), got("healths").withColumn("last_attempt_at", c("last_attempt_at").cast("timestamp_ntz")), got("posted"), 40),
    "source_diagnostics": lambda got: op.source_diagnostics(got("targets_now"), got("health_more"), got("catalog")).select("source", "complete", "rows_scanned", "target_rows", "status", "scope", "lifecycle", "consecutive_failures", "catalog_kind", "enabled", "interval_seconds", "crawl_status", "crawl_rows", "crawl_failures"),
    "current_market_filter": lambda got: op.current_market(got("postings"), F.expr(LATER)).select("posting_key", "category", "year"),
    "inherit_cycle_from_sensor": lambda got: op.with_sensor_cycles(got("postings").filter(c("source_mode") == "direct").withColumn("category", F.when(F.length("title") % 3 == 0, "other").otherwise(c("category"))), got("postings").filter(c("source_mode").isin("registry", "external-index"))).select("posting_key", "year", "season", "target_match", "category"),
    "readiness": lambda got: op.readiness(stats(got).withColumn("companies", c("companies") % 30).withColumn("validated_sources", c("validated_sources") % 20)),
    "bootstrap_readiness": lambda got: op.bootstrap_readiness(got("families"), got("catalog")),
    "provider_health_rollup": lambda got: op.provider_rollup(figures.RUNS["provider_health"](got)),
    "market_summary": lambda got: op.market_summary(got("postings"), got("fx_candidates")),
    "catalog_upsert": lambda got: op.catalog_upsert(got("catalog"), got("finds"), now()).select("source", "kind", "scope", "validated", "origin", plain("last_discovered_at")),
    "merge_catalog": lambda got: op.merged_catalog(got("named"), got("spelt"), got("fx_candidates")).select("source", "kind", "scope"),
    "parse_date": lambda got: dates.with_dates(got("dated"), "raw", dt.datetime(2001, 8, 1)).select("id", plain("read_at")),
    "source_label": lambda got: got("labelled").select("id", tx.source_label(c("source")).alias("label")),
    "census_net_new": lambda got: op.net_new(got("finds"), got("catalog"), got("queue").filter("status = 'retry'")),
    "validate_catalog_bootstrap": lambda got: op.bootstrap_validated(got("catalog"), got("runs"), got("postings")),
    "display_title": lambda got: op.display_titles(got("fold_applications")),
    "employer_evidence": lambda got: op.employer_evidence(got("postings")),
    "recent_rejected": lambda got: op.recent_rejected(got("queue"), 25).select("source", "kind", plain("next_run_at")),
    "read_previous_first_seen": lambda got: op.previous_first_seen(nested(got)),
    "seed_from_snapshot": lambda got: op.seeds(nested(got)),
    "promote_verified_openings": _promoted,
    "durable_activity_stats": lambda got: windows(lambda h: op.activity(got("postings"), now(), h)),
    "verified_window": lambda got: windows(lambda h: op.verified_window(got("families"), now(), h)),
    "sensor_recall": lambda got: op.sensor_recall(got("sensor_jobs"), got("feed_jobs")),
    "array_union_sorted": lambda got: op.places_of(got("postings")),
}


def queries() -> dict:
    return {k: lambda spark, sf_dir, f=f: f(lambda name: dialect.frame(spark, sf_dir, name)) for k, f in RUNS.items()}


GOOD, TECHS = names(TARGETS), names(TECH)
FREE = "({0} is null or {0} < {{as_of}})"
MATCH = "case target_match " + " ".join(f"when '{m}' then {r}" for m, r in TARGET_RANK.items()) + " end"
LIVE = f"select source, source_mode from {{posted}} where active and target_match in ({GOOD})"
PRODUCTIVE = f"select source, mode, last_attempt_at from {{healths}} h where mode = 'board-search' and exists (select 1 from ({LIVE}) p where p.source = h.source and p.source_mode = 'direct') or mode in ('verification', 'domain') and exists (select 1 from ({LIVE}) p where p.source = h.source and p.source_mode = 'verification')"
JOBS = "target_match <> 'not_internship'"
COUNTS = f"(select count(*) filter ({JOBS} and direct_openings > 0) as active_families, coalesce(sum(direct_openings) filter ({JOBS}), 0)::bigint as active_listings, count(distinct company) filter ({JOBS} and direct_openings > 0) as companies, (select count(*) filter (validated) from {{catalog}}) as validated_sources from {{families}})"
CANONICAL = "case when regexp_matches(source, '^(ashby|greenhouse|lever):') then lower(source) else source end"
OWN = f"source_mode = 'direct' and year = 2027 and category in ({TECHS})"
EVIDENCE = "case source_mode when 'direct' then case when active then 'validated-source' else 'historical-direct' end when 'registry' then 'current-index' when 'external-index' then 'market-index' when 'verification' then 'employer-page' when 'verification-lead' then 'employer-page-lead' else 'other-evidence' end"
SQL = {
    "due_sources": f"""select source, kind, next_run_at from {{due_targets}} where scheduled and enabled and next_run_at <= {{as_of}} and {FREE.format('lease_expires_at')}
      order by last_complete_at is not null, last_complete_at, coalesce(last_started_at, timestamp '1970-01-01'), next_run_at, priority, source limit 50""",
    "due_candidates": f"select source, kind, evidence_count from {{queue}} where status in ('candidate', 'retry') and next_run_at <= {{as_of}} and {FREE.format('leased_until')} order by scope = 'current' desc, evidence_count desc, next_run_at, source limit 100",
    "due_observations": f"""select key, official_url from {{census_seen}} where probe_status in ('candidate', 'retry', 'unresolved') and next_probe_at <= {SEEN_AT} and (lease_expires_at is null or lease_expires_at < {SEEN_AT})
      order by official_url is not null desc, technical_signal desc, internship_signal desc, consecutive_failures, last_seen_at desc, key limit 100""",
    "links_to_check": f"select canonical_apply_url, min(link_checked_at) as last_checked from {{leads}} where active and source_mode = 'direct' and target_match in ({GOOD}) group by 1 order by last_checked nulls first, canonical_apply_url limit 500",
    "requeue_empty_current": """select t.source, (case when k.source is not null and t.enabled and t.scheduled and t.last_status = 'empty' and t.next_run_at > {as_of} + to_seconds(t.interval_seconds)
      then case when t.last_complete_at is null or t.last_complete_at < {as_of} - to_seconds(greatest(3 * t.interval_seconds, 5400)) then {as_of} else {as_of} + to_seconds(t.interval_seconds) end else t.next_run_at end)::timestamp as due_at
      from {targets_due} t left join (select distinct source from {catalog} where validated and scope = 'current') k on k.source = t.source""",
    "productive_sources": f"select source, mode from ({PRODUCTIVE})",
    "refresh_selection": f"""with g as ({PRODUCTIVE}), k as (select * from {{catalog_modes}} where scope = 'current'),
      s as (select source from (select source, 0 as turn, last_attempt_at from g where mode = 'board-search' union all select source, 1, null from k where mode = 'board-search' and source not in (select source from {{healths}} where mode = 'board-search')) order by turn, last_attempt_at nulls first, source limit 40)
      select distinct source, mode from k where mode = 'board' or mode = 'board-search' and source in (select source from s) or mode in ('verification', 'domain') and (source, mode) in (select (source, mode) from g)""",
    "source_diagnostics": """select coalesce(t.source, h.source) as source, h.complete, h.rows_scanned, h.target_rows, h.status, coalesce(h.scope, k.scope) as scope, h.lifecycle, h.consecutive_failures, k.kind as catalog_kind, t.enabled, t.interval_seconds, t.last_status as crawl_status, t.last_rows as crawl_rows, t.consecutive_failures as crawl_failures
      from {targets_now} t full join {health_more} h on h.source = t.source left join {catalog} k on k.source = coalesce(t.source, h.source)""",
    "current_market_filter": f"select posting_key, category, year from {{postings}} where target_match <> 'not_internship' and category in ({TECHS}) and coalesce(year, 9999) >= extract(year from {LATER})",
    "inherit_cycle_from_sensor": f"""with s as (select * from (select *, row_number() over (partition by canonical_apply_url order by {MATCH} desc, coalesce(posted_at, first_seen_at) desc, posting_key) as nth from {{postings}} where source_mode in ('registry', 'external-index') and target_match in ({GOOD})) where nth = 1),
      d as (select * replace (case when length(title) % 3 = 0 then 'other' else category end as category) from {{postings}} where source_mode = 'direct'), m as (select d.*, d.target_match = 'unknown' and s.posting_key is not null as takes, s.year as y, s.season as n, s.target_match as t, s.category as g from d left join s on s.canonical_apply_url = d.canonical_apply_url)
      select posting_key, case when takes then coalesce(y, 2027) else year end as year, case when takes then coalesce(n, 'summer') else season end as season, case when takes then t else target_match end as target_match, case when takes and category = 'other' then g else category end as category from m""",
    "readiness": f"""with o as (select active_listings, companies % 30 as companies, validated_sources % 20 as validated_sources from {COUNTS}), d as (select *, greatest(0, 100 - active_listings)::bigint as active_listings_deficit, greatest(0, 20 - companies)::bigint as companies_deficit, greatest(0, 25 - validated_sources)::bigint as validated_sources_deficit from o)
      select *, active_listings >= 100 and companies >= 20 and validated_sources >= 25 as complete, case when active_listings >= 100 and companies >= 20 and validated_sources >= 25 then 'ready' else 'recovering' end as state, round(100 * least(1.0::double, active_listings / 100, companies / 20, validated_sources / 25), 1) as completion_percent from d""",
    "bootstrap_readiness": f"select *, active_listings >= 100 and companies >= 20 and validated_sources >= 25 as ready from {COUNTS}",
    "provider_health_rollup": f"""with p as ({figures.SQL['provider_health']}), r as (select *, 0 as is_total from p union all select null, sum(total)::bigint, sum(never_completed)::bigint, sum(overdue)::bigint, sum(degraded)::bigint, sum(due)::bigint, 1 from p)""",
    "market_summary": f"select count(*) as postings, count(*) filter (target_match in ({GOOD})) as targets, count(*) filter (target_match = 'exact') as exact, (select count(*) from {{fx_candidates}}) as candidates, (select string_agg(kind || ':' || n, '|' order by kind || ':' || n) from (select kind, count(*) as n from {{fx_candidates}} group by 1)) as candidate_kinds from {{postings}}",
    "catalog_upsert": """select source, kind, scope, validated, origin, last_discovered_at from {catalog} where source not in (select source from {finds}) union all
      select n.source, n.kind, case when o.scope = 'current' then 'current' else n.scope end, coalesce(o.validated, false) or n.validated, case when n.validated or o.source is null then n.origin else o.origin end, {as_of} from {finds} n left join {catalog} o on o.source = n.source""",
    "merge_catalog": f"""select source, kind, scope from (select *, row_number() over (partition by {CANONICAL} order by turn, scope = 'current' desc, source) as nth from (select source, kind, scope, 0 as turn from {{named}} union all select source, kind, scope, 1 from {{spelt}} union all select source, kind, scope, 2 from {{fx_candidates}})) where nth = 1""",
    "parse_date": "select id, case id % 8 when 0 then make_timestamp(2001, 7, 4, n % 24, 5, 0) when 1 then timestamp '2001-07-04 20:30:00' when 2 then make_timestamp(2001, 7, 4, case when n % 12 + 1 = 12 then 12 else n % 12 + 13 end, 0, 0) when 3 then timestamp '2001-07-04' when 4 then timestamp '2001-07-04 10:00:00' when 5 then make_timestamp((n + 1000000000)::bigint * 1000000) end as read_at from {fx_texts}",
    "source_label": "select id, case id % 9 when 0 then 'Greenhouse' when 1 then 'Registry · Job List ' || id when 2 then 'Verification lead · USA' when 3 then 'External index · Big Tech List2Go' when 4 then source when 5 then 'unknown' when 6 then 'Employer site' when 7 then 'Registry' else 'Workday' end as label from {labelled}",
    "census_net_new": "select distinct source, kind from {finds} f where not exists (select 1 from {catalog} k where k.source = f.source and k.validated) and not exists (select 1 from {queue} q where q.source = f.source and q.status = 'retry')",
    "validate_catalog_bootstrap": "select source, validated or source in (select source from {runs} where complete and error is null and status in ('ok', 'empty')) or source in (select source from {postings} where source_mode = 'direct') as validated from {catalog}",
    "display_title": f"select family_key, title from (select *, row_number() over (partition by family_key order by length(title), title) as nth from (select family_key, {clean('title')} as title from {{fold_applications}})) where nth = 1",
    "employer_evidence": f"""select {digest(24, f"trim({rep('lower(company)', ('[^a-z0-9]+', ' '))})")} as employer, {EVIDENCE} as evidence, source, year, count(*) as roles, count(*) filter (active) as active_roles, min(first_seen_at) as first_seen, max(last_seen_at) as last_seen, min(canonical_apply_url) as sample_url from {{postings}} group by 1, 2, 3, 4""",
    "recent_rejected": "select source, kind, next_run_at from {queue} where status = 'rejected' order by next_run_at desc, source limit 25",
    "read_previous_first_seen": "select canonical_apply_url, min(first_seen_at) as first_seen_at from {postings} group by 1",
    "seed_from_snapshot": "select canonical_apply_url, identity from (select *, row_number() over (partition by canonical_apply_url order by last_seen_at desc, identity desc) as nth from {postings} where source_mode in ('direct', 'verification')) where nth = 1",
    "promote_verified_openings": " union all ".join(f"""select '{part}' as part, identity, family_key, posting_key, case when source_mode = 'verification' then 'direct' else source_mode end as source_mode, case when source_mode = 'verification' then 'employer-page' end as verification_mode,
      count(*) filter (source_mode in ('direct', 'verification')) over (partition by family_key) as direct_openings, count(*) filter (source_mode not in ('direct', 'verification')) over (partition by family_key) as backstop_openings, count(*) filter (source_mode = 'verification') over (partition by family_key) as promoted from {{{name}}}""" for part, name in (("feed", "fold_applications"), ("inventory", "postings"))),
    "durable_activity_stats": " union all ".join(f"select {h} as hours, count(distinct canonical_apply_url) filter (first_seen_at >= {{as_of}} - to_hours({h})) as discovered, count(distinct canonical_apply_url) filter (not active and removed_at >= {{as_of}} - to_hours({h})) as removed from {{postings}} where {OWN}" for h in HOURS),
    "verified_window": " union all ".join(f"select {h} as hours, count(*) as families, coalesce(sum(direct_openings), 0)::bigint as openings, count(*) filter (first_detected_at >= {{as_of}} - to_hours({h})) as new_families from {{families}} where direct_openings > 0" for h in HOURS),
    "sensor_recall": """select count(*) as expected, count(f.at_) as published, max(s.at_) as newest_sensor, max(f.at_) as newest_published, round(count(f.at_) / count(*), 4) as recall, coalesce(max(f.at_) >= max(s.at_), false) as current
      from (select canonical_apply_url, max(first_seen_at) as at_ from {sensor_jobs} group by 1) s left join (select canonical_apply_url, max(first_seen_at) as at_ from {feed_jobs} group by 1) f on f.canonical_apply_url = s.canonical_apply_url""",
    "array_union_sorted": "select company, string_agg(distinct place, '|' order by place) as places from (select company, unnest(locations) as place from {postings}) group by 1",
}
SQL["provider_health_rollup"] = f"""select kind, total, never_completed, overdue, degraded, due, provider_count, is_total, never_completed + overdue + degraded = 0 as ok, case when total > 0 then round(100 * due / total, 1) else 0.0 end as due_percent
  from (select kind, sum(total)::bigint as total, sum(never_completed)::bigint as never_completed, sum(overdue)::bigint as overdue, sum(degraded)::bigint as degraded, sum(due)::bigint as due, count(*) as provider_count, 0 as is_total from ({figures.SQL['provider_health']}) group by kind
  union all select null, sum(total)::bigint, sum(never_completed)::bigint, sum(overdue)::bigint, sum(degraded)::bigint, sum(due)::bigint, count(*), 1 from ({figures.SQL['provider_health']}))"""


def oracle() -> dict[str, str]:
    return {k: dialect.whole(v) for k, v in SQL.items()}
