"""The inventory's relational operators over postings, applications, families, targets and snapshots."""

from __future__ import annotations



from ..constants import BAD_STATUSES, CATEGORIES, INTERN, PROGRAM, SEASONS, SOURCE_RANK, SUMMER_2027, TARGET_RANK, TARGETS, TECH, YEAR
from ..operators import postings as ops
from . import dialect
from .dialect import BUILT, OTHER, STORED, TEXTS
from .scalars import CANON, company, identity, names, norm_title, raw_key

BUILT["postings"] = (ops.from_view, ("fx_postings",))
STORED.add("postings")
_hit = lambda p: f"regexp_matches(title, '(?i){p}')"
OTHER["postings"] = f"""select * exclude (evidence, years), posting_key_ as posting_key from (select *, source || '|' || source_id as posting_key_, {identity('canonical_apply_url', 'source', 'source_id')} as identity, {norm_title('title')} as normalized_title,
  substr(sha256({raw_key('company')} || '|' || {norm_title('title')} || '|' || coalesce(season, '') || '|' || coalesce(year::varchar, '') || '|'), 1, 24) as family_key from
  (select *, case when target_match = 'source_confirmed' then 2027 when list_contains(years, '2027') then 2027 when len(years) = 1 then years[1]::int end as year from
  (select *, case when not evidence then 'not_internship' when list_contains(years, '2027') and season = 'summer' or {_hit(SUMMER_2027)} then 'exact' when len(years) > 0 and not list_contains(years, '2027') then 'wrong_year' when list_contains(years, '2027') and season <> 'summer' then 'wrong_season'
     when len(years) = 1 and season is null then 'year_confirmed' when source_mode = 'registry' and len(years) = 0 and season = 'summer' then 'source_confirmed' else 'unknown' end as target_match from
  (select source, source_id, source_mode, {company('company')} as company, title, [loc1, loc2] as locations, apply_url, posted_at, first_seen_at, last_seen_at, active, source_mode = 'registry' as source_confirms, case when not active then last_seen_at end as removed_at,
     {_hit(INTERN)} or {_hit(PROGRAM)} as evidence, list_distinct(regexp_extract_all(title, '{YEAR}')) as years, case {' '.join(f"when {_hit(p)} then '{n}'" for n, p in SEASONS.items())} end as season, case {' '.join(f"when {_hit(p)} then '{n}'" for n, p in CATEGORIES.items())} else 'other' end as category,
     (select {CANON.replace('url', 'z.apply_url')} from (select apply_url) z) as canonical_apply_url from fx_postings))))""".replace("from fx_postings", "from {fx_postings}")

RANK = "case source_mode " + " ".join(f"when '{m}' then {r}" for m, r in SOURCE_RANK.items()) + " else 99 end"
MATCH = "case target_match " + " ".join(f"when '{m}' then {r}" for m, r in TARGET_RANK.items()) + " else -2 end"
TECHS, GOOD, BAD = names(TECH), names(TARGETS), names(BAD_STATUSES)

# Applications and families. A partial sort key always ends in posting_key, so runs agree.
OTHER["fold_applications"] = f"""select identity, max(case when sel = 1 then posting_key end) as posting_key, max(case when sel = 1 then company end) as company, max(case when sel = 1 then title end) as title, max(case when sel = 1 then category end) as category, max(case when sel = 1 then apply_url end) as apply_url, max(case when sel = 1 then source end) as source, max(case when sel = 1 then source_mode end) as source_mode,
  max(case when anc = 1 then family_key end) as family_key, max(case when anc = 1 then season end) as season, max(case when anc = 1 then year end) as year, max(case when anc = 1 then target_match end) as target_match, array_join(array_sort(array_distinct(flatten(array_agg(locations)))), '|') as locations,
  min(case when source_mode in ('direct', 'verification') then posted_at end) as first_posted_at, max(case when source_mode in ('direct', 'verification') then posted_at end) as latest_posted_at, min(first_seen_at) as first_detected_at, max(last_seen_at) as last_verified_at, array_join(array_sort(array_agg(distinct concat(source_mode, ':', source))), '|') as source_variants, count(*) as variants
 from (select *, row_number() over (partition by identity order by {RANK}, case when posted_at is null then 1 else 0 end, length(title), title, posting_key) as sel, row_number() over (partition by identity order by {MATCH} desc, {RANK}, posting_key) as anc from {{postings}} where active and target_match in ({GOOD}, 'unknown')) r
 group by identity having sum(case when source_mode <> 'verification-lead' then 1 else 0 end) > 0"""
OTHER["build_families"] = f"""select family_key, max(case when sel = 1 then company end) as company, max(case when sel = 1 then title end) as title, max(case when sel = 1 then category end) as category, max(case when anc = 1 then season end) as season, max(case when anc = 1 then year end) as year, max(case when anc = 1 then target_match end) as target_match,
  count(*) as opening_count, array_join(array_sort(array_distinct(flatten(array_agg(split(locations, '[|]'))))), '|') as locations, array_join(array_sort(array_agg(concat(locations, ' ', apply_url, ' ', identity))), ';') as openings, min(first_posted_at) as first_posted_at, max(latest_posted_at) as latest_posted_at, case when max(latest_posted_at) is null then 'unknown' else 'day' end as posted_precision,
  min(first_detected_at) as first_detected_at, max(last_verified_at) as last_verified_at, cast(sum(case when source_mode in ('direct', 'verification') then 1 else 0 end) as bigint) as direct_openings, cast(sum(case when source_mode in ('direct', 'verification') then 0 else 1 end) as bigint) as backstop_openings
 from (select *, row_number() over (partition by family_key order by {RANK}, case when first_posted_at is null then 1 else 0 end, length(title), title, posting_key) as sel, row_number() over (partition by family_key order by {MATCH} desc, {RANK}, posting_key) as anc from {{fold_applications}}) a group by family_key"""
OTHER["fold_applications"] = dialect.translated(OTHER["fold_applications"])
OTHER["build_families"] = dialect.translated(OTHER["build_families"]).replace("split(locations, '[|]')", "string_split(locations, '|')")
# Folds are one grouping: the row that speaks for a group is the least by a struct that ends in posting_key, and the
# partial results of a hot group combine before the shuffle.
TEXTS["fold_applications"] = f"""select identity, s.posting_key as posting_key, s.company as company, s.title as title, s.category as category, s.apply_url as apply_url, s.source as source, s.source_mode as source_mode, a.family_key as family_key, a.season as season, a.year as year, a.target_match as target_match, array_join(array_sort(places), '|') as locations,
  first_posted_at, latest_posted_at, first_detected_at, last_verified_at, array_join(array_sort(said), '|') as source_variants, variants from
 (select identity, min_by(struct(posting_key, company, title, category, apply_url, source, source_mode), struct({RANK}, posted_at is null, length(title), title, posting_key)) as s, min_by(struct(family_key, season, year, target_match), struct(-{MATCH}, {RANK}, posting_key)) as a, collect_set(place) as places, collect_set(concat(source_mode, ':', source)) as said,
   min(case when source_mode in ('direct', 'verification') then posted_at end) as first_posted_at, max(case when source_mode in ('direct', 'verification') then posted_at end) as latest_posted_at, min(first_seen_at) as first_detected_at, max(last_seen_at) as last_verified_at, count_if(coalesce(at, 0) = 0) as variants, count_if(source_mode <> 'verification-lead') as firm
  from (select *, posexplode_outer(locations) as (at, place) from {{postings}} where active and target_match in ({GOOD}, 'unknown')) r group by identity) g where firm > 0"""
TEXTS["build_families"] = f"""select family_key, s.company as company, s.title as title, s.category as category, a.season as season, a.year as year, a.target_match as target_match, opening_count, array_join(array_sort(places), '|') as locations, array_join(array_sort(openings), ';') as openings, first_posted_at, latest_posted_at, case when latest_posted_at is null then 'unknown' else 'day' end as posted_precision, first_detected_at, last_verified_at, direct_openings, backstop_openings from
 (select family_key, min_by(struct(company, title, category), struct({RANK}, first_posted_at is null, length(title), title, posting_key)) as s, min_by(struct(season, year, target_match), struct(-{MATCH}, {RANK}, posting_key)) as a, count(*) as opening_count, array_distinct(flatten(collect_set(split(locations, '[|]')))) as places, collect_list(concat(locations, ' ', apply_url, ' ', identity)) as openings,
   min(first_posted_at) as first_posted_at, max(latest_posted_at) as latest_posted_at, min(first_detected_at) as first_detected_at, max(last_verified_at) as last_verified_at, count_if(source_mode in ('direct', 'verification')) as direct_openings, count_if(source_mode not in ('direct', 'verification')) as backstop_openings from {{fold_applications}} group by family_key) g"""
OTHER["families"] = "select * from {build_families}"
# The read model has no list of openings, so its folds carry no links, sources or lists of them: of an application, the best row
# and the row it is matched by, each the least of a struct that begins with its order and ends that order in posting_key.
TEXTS["brief_applications"] = f"""select identity, s.posting_key as posting_key, s.company as company, s.title as title, s.category as category, s.source_mode as source_mode, a.family_key as family_key, a.season as season, a.year as year, a.target_match as target_match, array_distinct(flatten(places)) as places, first_posted_at, latest_posted_at, first_detected_at, last_verified_at from
 (select identity, min(struct({RANK} as rank, posted_at is null as undated, length(title) as n, title, posting_key, company, category, source_mode)) as s, min(struct(-{MATCH} as rank, {RANK} as next, posting_key, family_key, season, year, target_match)) as a, collect_set(locations) as places,
   min(case when source_mode in ('direct', 'verification') then posted_at end) as first_posted_at, max(case when source_mode in ('direct', 'verification') then posted_at end) as latest_posted_at, min(first_seen_at) as first_detected_at, max(last_seen_at) as last_verified_at, count_if(source_mode <> 'verification-lead') as firm
  from {{postings}} where active and target_match in ({GOOD}, 'unknown') group by identity) g where firm > 0"""
TEXTS["families"] = f"""select family_key, s.company as company, s.title as title, s.category as category, a.season as season, a.year as year, a.target_match as target_match, opening_count, array_join(array_sort(array_distinct(flatten(places))), '|') as locations, first_posted_at, latest_posted_at, case when latest_posted_at is null then 'unknown' else 'day' end as posted_precision, first_detected_at, last_verified_at, direct_openings, backstop_openings from
 (select family_key, min(struct({RANK} as rank, first_posted_at is null as undated, length(title) as n, title, posting_key, company, category)) as s, min(struct(-{MATCH} as rank, {RANK} as next, posting_key, season, year, target_match)) as a, count(*) as opening_count, collect_set(array_sort(places)) as places,
   min(first_posted_at) as first_posted_at, max(latest_posted_at) as latest_posted_at, min(first_detected_at) as first_detected_at, max(last_verified_at) as last_verified_at, count_if(source_mode in ('direct', 'verification')) as direct_openings, count_if(source_mode not in ('direct', 'verification')) as backstop_openings from {{brief_applications}} group by family_key) g"""
STORED.add("families")  # the feed's read model, as publishing leaves it

VISIBLE = "case when latest_posted_at is null then date_trunc('hour', first_detected_at) when posted_precision = 'timestamp' then latest_posted_at else date_trunc('day', latest_posted_at) end"
VERIFIED = "case when direct_openings > 0 then 0 else 1 end"
NEWEST = f"{VISIBLE} desc, {VERIFIED}, case posted_precision when 'timestamp' then 0 when 'day' then 1 else 2 end, last_verified_at desc nulls last, family_key"
SHOWN = "family_key, company, title, category, season, year, target_match, opening_count, locations, latest_posted_at, first_detected_at, last_verified_at, direct_openings, backstop_openings"
PUBLIC = f"year = 2027 and category in ({TECHS}) and direct_openings > 0"

# Feed: filters, orders and pages over families.
TEXTS |= {
    "best_opening_lateral": "select family_key, identity, apply_url, source_mode from (select *, row_number() over (partition by family_key order by case when source_mode in ('direct', 'verification') then 0 else 1 end, latest_posted_at desc nulls last, identity) as nth from {fold_applications}) a where nth = 1",
}
# Aggregates over families and postings.
TEXTS |= {
    "daily_movement": f"select count(distinct case when first_seen_at >= {{as_of}} - interval 24 hours and removed_at is null then canonical_apply_url end) as new_urls_today, count(distinct case when removed_at >= {{as_of}} - interval 24 hours then canonical_apply_url end) as removed_urls_today from {{postings}} where source_mode = 'direct' and year = 2027 and category in ({TECHS})",
    "snapshot_fallback_stats": "select count(*) as families, cast(sum(opening_count) as bigint) as openings, count(distinct company) as companies, count(case when direct_openings > 0 then 1 end) as verified, max(latest_posted_at) as newest_posted, max(first_detected_at) as newest_found from {families}",
    "listing_freshness": "select max(latest_posted_at) as newest_posted_at, max(first_detected_at) as newest_found_at, cast(secs(max(latest_posted_at), {as_of}) as double) / 3600 as posted_age_hours, cast(secs(max(first_detected_at), {as_of}) as double) / 3600 as found_age_hours, count(case when first_detected_at >= {as_of} - interval 24 hours then 1 end) as found_24h, count(case when first_detected_at >= {as_of} - interval 168 hours then 1 end) as found_7d from {families} where direct_openings > 0",
    "posting_freshness": "select count(*) as trusted, count(case when posted_at >= {as_of} - interval 24 hours then 1 end) as last_24h, count(case when posted_at >= {as_of} - interval 72 hours then 1 end) as last_72h, count(case when posted_at >= {as_of} - interval 168 hours then 1 end) as last_7d, max(posted_at) as newest from {postings} where posted_at is not null and source_mode in ('direct', 'verification')",
    "companies_by_mode": "select source_mode, count(distinct company) as companies from {postings} where active group by source_mode",
    "notification_eligibility": "select family_key, min(first_seen_at) as first_seen_at, bool_or(source_mode in ('direct', 'verification')) as any_verified, bool_or(source_mode not in ('direct', 'verification')) as any_lead from {postings} where active group by family_key",
    "known_applications": "select distinct identity from {postings} where active and source_mode in ('direct', 'verification', 'registry')",
    "registry_only": "select distinct identity from {postings} where active and source_mode = 'registry' except select distinct identity from {postings} where active and source_mode in ('direct', 'verification')",
    "published_intersection": "select canonical_apply_url from {postings} where source_mode = 'external-index' intersect select canonical_apply_url from {postings} where source_mode = 'direct'",
    "publication_gaps": "select posting_key, family_key from {postings} p where active and source_mode in ('direct', 'verification') and not exists (select 1 from {families} f where f.family_key = p.family_key)",
    "is_default_target": f"select posting_key, target_match in ({GOOD}) as default_target from {{postings}}",
    "classify_postings": "select posting_key, company, title, category, season, year, target_match from {postings}",
    "internship_evidence": "select posting_key, target_match <> 'not_internship' as evidence from {postings}",
    "cycle_year_season": "select posting_key, year, season from {postings}",
    "target_match": "select posting_key, target_match from {postings}",
    "categorize": "select posting_key, category from {postings}",
    "seed_regression_corpus": "select posting_key, title, category, target_match from {postings} order by first_seen_at desc, posting_key limit 500",
    "require_identity": "select posting_key, trim(company) <> '' and trim(title) <> '' and trim(canonical_apply_url) <> '' as accepted from {postings}",
}
# Sources, health and scheduling.
FRESH = "greatest(interval_seconds * 3, 5400)"
LATE = f"secs(last_complete_at, {{as_of}}) > {FRESH}"
CURRENT = "enabled and scheduled and validated and scope = 'current'"
COUNTS = f"""count(*) as total, count(case when last_complete_at is null then 1 end) as never_completed, count(case when {LATE} then 1 end) as overdue, count(case when last_status in ({BAD}) then 1 end) as degraded,
  count(case when secs(last_complete_at, {{as_of}}) <= {FRESH} and last_status not in ({BAD}) then 1 end) as fresh, count(case when last_complete_at is null or {LATE} or last_status in ({BAD}) then 1 end) as unhealthy"""
TEXTS |= {
    "current_targets": f"select source, kind, interval_seconds, last_complete_at, last_status from {{fx_targets}} where {CURRENT}",
    "inventory_state_legacy": f"select count(*) as total, count(case when secs(last_complete_at, {{as_of}}) > interval_seconds * 2 then 1 end) as overdue, count(case when last_status in ({BAD}) then 1 end) as degraded, greatest(0, count(*) - count(case when secs(last_complete_at, {{as_of}}) > interval_seconds * 2 then 1 end) - count(case when last_status in ({BAD}) then 1 end)) as fresh from {{fx_targets}} where {CURRENT}",
    "unscheduled_validated": "select c.source from {fx_candidates} c left join {fx_targets} t on c.source = t.source where c.status = 'validated' and (t.source is null or not t.scheduled)",
    "balanced_by_kind": "select source, kind, nth from (select source, kind, row_number() over (partition by kind order by evidence_count desc, source) as nth from {fx_candidates}) r order by nth, kind limit 60",
    "stalled_sources": f"select source, last_complete_at from {{fx_targets}} where {CURRENT} and (last_complete_at is null or {LATE}) order by last_complete_at nulls first, source limit 25",
    "unhealthy_sources": f"select source, last_status, consecutive_failures from {{fx_targets}} where last_status in ({BAD}) order by consecutive_failures desc, source limit 25",
    "collapse_case_duplicates": "select source, validated from (select source, validated, row_number() over (partition by lower(source) order by case when validated then 0 else 1 end, case when scope = 'current' then 0 else 1 end, last_finished_at desc, source) as nth from (select source, validated, scope, last_finished_at from {fx_targets} union all select upper(source) as source, not validated as validated, scope, last_finished_at from {fx_targets}) u) r where nth = 1",
    "prune_validated_candidates": "select source, status from {fx_candidates} c where not exists (select 1 from (select source from {fx_candidates} where status = 'validated') v where v.source = c.source)",
    "promote_scope": f"select t.source, case when p.source is not null then 'current' else t.scope end as scope from {{fx_targets}} t left join (select distinct source from {{postings}} where active and source_mode = 'direct' and target_match in ({GOOD})) p on p.source = t.source",
    "audit_rollup": f"select kind, count(*) as sources, count(case when last_status in ({BAD}) then 1 end) as unhealthy from {{fx_targets}} group by kind",
}
# Reconciliation: snapshots against the stored postings. `incoming` is what a complete snapshot listed.
TEXTS |= {
    "incoming": "select * from {postings} where source_mode = 'direct' and cast(substring(source_id, 1, 1) as int) % 3 <> 0",
    "stored": "select * from {postings} where source_mode <> 'direct' or cast(substring(source_id, length(source_id), 1) as int) % 4 <> 0",
    "pending_removal": "select o.posting_key, case when o.removed_at is null then {as_of} else o.removed_at end as removed_at, not coalesce(secs(o.removed_at, {as_of}) >= greatest(1800, least(coalesce(t.interval_seconds, 0), 21600)), false) as active from {stored} o left join {fx_targets} t on t.source = o.source where o.active and o.source_mode = 'direct' and not exists (select 1 from {incoming} n where n.posting_key = o.posting_key)",
    "close_identity_stale": f"select distinct p.posting_key from {{stored}} p join (select distinct identity from {{stored}} where source_mode = 'direct' and target_match in ({GOOD}) except select distinct identity from {{incoming}}) g on g.identity = p.identity where p.active and p.source_mode in ('registry', 'external-index', 'verification-lead') and p.target_match in ({GOOD})",
    "close_urls": "select posting_key from {postings} p where active and source_mode in ('registry', 'verification', 'external-index') and exists (select 1 from (select distinct canonical_apply_url from {postings} where not active) c where c.canonical_apply_url = p.canonical_apply_url)",
    "recovered_distinct_on": "select company, title, canonical_apply_url, posting_key from (select *, row_number() over (partition by company, title, canonical_apply_url order by last_seen_at desc, posting_key) as nth from {postings} where source_mode = 'verification') r where nth = 1",
    "dedupe_posting_key": "select posting_key, last_seen_at from (select posting_key, last_seen_at, row_number() over (partition by posting_key order by last_seen_at desc, canonical_apply_url desc) as nth from (select * from {stored} union all select * from {incoming}) u) r where nth = 1",
    "dedupe_sensor_rows": "select posting_key, company, title, canonical_apply_url from (select *, row_number() over (partition by company, title, canonical_apply_url order by coalesce(posted_at, first_seen_at) desc, posting_key) as nth from {postings} where source_mode in ('registry', 'external-index')) r where nth = 1",
    "notification_representative": "select family_key, posting_key from (select family_key, posting_key, row_number() over (partition by family_key order by posted_at desc nulls last, first_seen_at desc, posting_key) as nth from {postings} where active) r where nth = 1",
    "pending_notifications": f"select f.family_key, f.title from {{families}} f where f.category in ({TECHS}) and not exists (select 1 from (select family_key from {{families}} where opening_count > 3) l where l.family_key = f.family_key) order by f.first_detected_at desc, f.family_key limit 200",
    "bootstrap_suppress": "select family_key, 'alerts' as channel from {families} where first_detected_at < {as_of} - interval 2400 hours",
    "notification_rows": "select family_key, substring(company, 1, 80) as company, substring(title, 1, 120) as title, substring(locations, 1, 60) as place from {families} where direct_openings > 0",
    "replace_refreshed_sources": "select posting_key, source from {stored} s where not exists (select 1 from {incoming} i where i.source = s.source) union all select posting_key, source from {incoming}",
    "supersede_by_url": "select posting_key from {stored} s where not exists (select 1 from {incoming} i where i.source = s.source) and not exists (select 1 from {incoming} i where i.canonical_apply_url = s.canonical_apply_url)",
    "collect_observations": "select posting_key, 'kept' as part from {stored} where source_mode = 'verification' union all select posting_key, 'sensor' as part from {stored} where source_mode in ('registry', 'external-index') union all select posting_key, 'direct' as part from {incoming}",
}
# Observations, employers and fusion.
TEXTS |= {
    "rank_feeds": "select source, rows_scanned from (select source, cast(max(rows_scanned) as bigint) as rows_scanned, max(finished_at) as pushed from {fx_snapshots} group by source) f order by pushed desc, rows_scanned desc, source limit 40",
}
HIDDEN = ("families", "brief_applications", "incoming", "stored")


#: The operators of this module.
OWN = tuple(k for k in TEXTS if k not in HIDDEN)


def queries() -> dict:
    return {k: lambda spark, sf_dir, k=k: dialect.frame(spark, sf_dir, k) for k in OWN}


def oracle() -> dict[str, str]:
    return {k: dialect.oracle(k) for k in OWN}
