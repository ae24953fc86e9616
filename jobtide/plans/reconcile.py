"""Reconciliation queries over stored rows, snapshots, checks and probes derived from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CADENCE, FALLBACK_KINDS, INDEX_MODES, TARGETS, TECH
from ..operators import reconcile as op
from ..sources.fixtures import AS_OF
from . import dialect
from .dialect import TEXTS
from .scalars import SIG, actionable, names

c = F.col
PARTKEY = "cast(regexp_extract(canonical_apply_url, '/jobs/([0-9]+)-', 1) as int)"
REASON = "case {0} when 0 then null when 1 then 'HTTP 403 Forbidden' when 2 then 'Read timed out' when 3 then 'json decode failed' when 4 then 'certificate expired' when 5 then 'gone 410' else 'odd thing' end"

#: Views; the same text runs in both engines.
VIEWS = {
    "held": "select *, case when posted_at is null then 'unknown' else 'day' end as posted_precision, case when posted_at is null then 'unknown' when source_mode = 'direct' then 'official' else 'structured' end as posted_confidence, case when length(source_id) % 2 = 0 then last_seen_at end as updated_at, concat('About ', title) as description from {stored}",
    "snap": "select posting_key, source, identity, title, target_match, case when length(title) % 3 = 0 then null else posted_at end as posted_at, 'timestamp' as posted_precision, 'employer' as posted_confidence, case when length(title) % 2 = 0 then last_seen_at end as updated_at, concat('New ', title) as description from {incoming}",
    "dimmed": "select posting_key, source, source_mode, active, case when length(source_id) % 2 = 0 then removed_at end as removed_at, {as_of} - (interval 1 hour) * (length(title) % 12) as last_seen_at from {postings}",
    "whole_sources": "select source from {fx_targets} where last_status in ('ok', 'empty')",
    "board_snap": "select posting_key, identity, target_match, concat('greenhouse:', replace(lower(company), '#', '')) as source from {incoming} where length(title) % 5 <> 0",
    "boards": "select source, count(*) % 4 <> 0 as complete, case when count(*) % 5 = 0 then 'partial' else 'ok' end as status from {board_snap} group by source",
    "checks": f"select canonical_apply_url as url, case {PARTKEY} % 6 when 0 then 200 when 1 then 404 when 2 then 403 when 3 then 500 when 4 then 410 else 429 end as code, {PARTKEY} % 5 = 0 as closed_text, max(last_seen_at) as checked_at from {{postings}} where {PARTKEY} % 7 <> 0 group by canonical_apply_url",
    "linked": "select p.posting_key, p.active, p.company, l.url, l.url as canonical_apply_url from {postings} p join {fx_links} l on l.id = cast(split_part(p.source_id, '-', 3) as int)",
    "runs": "select source, finished_at, rows_scanned, target_rows, new_rows, removed_rows, case when error is not null then false else complete end as complete, status, error, mode, case when rows_scanned % 4 = 0 then 'historical' else 'current' end as scope from (select *, case when complete then case when target_rows > 0 then 'ok' when rows_scanned % 3 = 0 then 'dormant' else 'empty' end else case rows_scanned % 4 when 0 then 'broken' when 1 then 'blocked' when 2 then 'truncated' else 'partial' end end as status, case when not complete and rows_scanned % 4 < 2 then 'HTTP 403 Forbidden' end as error, case when rows_scanned % 5 = 0 then 'site' else 'board' end as mode from {fx_snapshots}) r",
    "catalog": "select source, kind, scope, validated, 'census' as origin, last_finished_at as last_discovered_at from {fx_targets} where consecutive_failures < 4 union all select source, case when evidence_count % 2 = 0 then 'lever' else 'verification' end as kind, scope, status = 'validated' as validated, 'probe' as origin, {as_of} as last_discovered_at from {fx_candidates} where evidence_count % 10 = 0",
    "targets_now": "select source, interval_seconds, case when consecutive_failures % 2 = 0 then last_complete_at end as last_complete_at, case when consecutive_failures % 3 = 0 then last_finished_at end as last_finished_at, case when consecutive_failures = 1 then 'pending' else last_status end as last_status, consecutive_failures * 10 as last_rows, consecutive_failures, enabled, scheduled, {as_of} as next_run_at from {fx_targets}",
    "health_now": "select source, last_status <> 'partial' as complete, interval_seconds / 100 as rows_scanned, consecutive_failures as target_rows, last_finished_at as last_attempt_at, last_complete_at as last_success_at, last_status as status, scope, case when consecutive_failures >= 3 then 'quarantined' when validated then 'productive' else 'candidate' end as lifecycle, consecutive_failures from {fx_targets} where interval_seconds <> 900",
    "queue": f"select *, {{as_of}} + (interval 1 hour) * (evidence_count - 25) as next_run_at, {{as_of}} - (interval 1 hour) * (evidence_count * 5) as discovered_at, case when evidence_count % 7 = 0 then {{as_of}} + interval 1 hour end as leased_until, {REASON.format('consecutive_failures')} as last_error, 'census' as origin from {{fx_candidates}}",
    "probes": "select source, case evidence_count % 6 when 0 then 'ok' when 1 then 'empty' when 2 then 'dormant' when 3 then 'blocked' when 4 then 'ok' else 'broken' end as status, evidence_count % 6 in (0, 1, 4) as complete, case when evidence_count % 6 = 5 then 'Read timed out' end as error, case when evidence_count % 4 = 0 then 'site' else 'board' end as mode, case when evidence_count % 6 = 3 then 'challenge page' end as note from {fx_candidates} where consecutive_failures % 3 <> 2",
    "leads": "select *, case length(title) % 5 when 0 then 'closed' when 1 then 'unchecked' when 2 then 'checking' when 3 then 'blocked' end as link_status, case when length(title) % 5 in (0, 2, 3) then {as_of} - (interval 1 minute) * (length(source_id) * 37) end as link_checked_at from {postings}",
    "verdicts": "select url, code = 200 as matched, code in (404, 410) as closed, case when code in (403, 429) then 'blocked' else 'ok' end as result, case when code = 500 then 'HTTP 500' end as error from {checks}",
    "found": "select case when evidence_count % 2 = 0 then source else concat(source, '-new') end as source, 'domain' as kind, case when scope = 'current' then 'historical' else 'current' end as scope, 'sweep' as origin from {fx_candidates} where evidence_count % 3 = 0",
    "deliveries": "select family_key, case when direct_openings > 0 then 'verified' else 'leads' end as channel, case when opening_count > 2 then 'sent' else 'suppressed' end as disposition, first_detected_at as delivered_at from {families} where opening_count > 1",
    "claims": "select family_key, case when backstop_openings > 0 then 'leads' else 'verified' end as channel from {families} where opening_count % 3 = 1",
}
TEXTS.update(VIEWS)
#: Views whose arrays and maps are spelt differently; (text, text for the other engine).
TEXTS["employers_seen"] = "select source_id as key, concat('User ', source_id) as name, array('u', source) as aliases, array(source_mode) as sectors, case when value > 50 then source end as location, value / 100 as signal, map('by', source_mode, source, 'yes') as metadata, observed_at as last_seen_at, case when value > 80 then 'resolved' else 'retry' end as probe_status from (select *, row_number() over (partition by source_id order by observed_at, source) as nth from {fx_observations} where source_mode = 'direct') o where nth = 1"
TEXTS["employers_new"] = "select source_id as key, concat('Person ', source_id) as name, array('p', source) as aliases, array(source_mode, 'new') as sectors, case when value > 30 then source end as location, value / 90 as signal, map('by', source_mode, source, 'no') as metadata, observed_at as last_seen_at, 'candidate' as probe_status from (select *, row_number() over (partition by source_id order by observed_at desc, source) as nth from {fx_observations} where source_mode <> 'direct') o where nth = 1"
for _name in ("employers_seen", "employers_new"):
    _text = TEXTS[_name]
    for _a, _b in (("array('u', source)", "['u', source]"), ("array('p', source)", "['p', source]"), ("array(source_mode)", "[source_mode]"), ("array(source_mode, 'new')", "[source_mode, 'new']"), ("map('by', source_mode, source, 'yes')", "map(['by', source], [source_mode, 'yes'])"), ("map('by', source_mode, source, 'no')", "map(['by', source], [source_mode, 'no'])")):
        _text = _text.replace(_a, _b)
    dialect.OTHER[_name] = _text
HIDDEN = {*VIEWS, "employers_seen", "employers_new"}
DAYS, N = 2400, 300


def now():
    return F.expr(AS_OF)


def _observed(spark, got):
    old, new = got("employers_seen"), got("employers_new")
    merged = op.merged_observations(old, new, now())
    joined = lambda x: F.array_join(x, "|").alias(x)
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return merged.select("key", "name", joined("aliases"), joined("sectors"), "location", F.round("signal", 6).alias("signal"), F.array_join(pairs, "|").alias("metadata"), "last_seen_at", "probe_status")


def _retired(spark, got):
    targets, catalog = op.retire_dormant(got("targets_now"), got("catalog"), got("runs"), now())
    left = targets.select(F.lit("target").alias("part"), "source", c("enabled").alias("live"), c("last_status").alias("state"), F.lit(None).cast("string").alias("origin"), c("last_complete_at").alias("at"))
    return left.unionByName(catalog.select(F.lit("catalog").alias("part"), "source", c("validated").alias("live"), c("scope").alias("state"), "origin", c("last_discovered_at").alias("at")))


def _probed(spark, got):
    promoted, queue = op.probe_outcomes(got("queue"), got("probes"))
    none = lambda kind: F.lit(None).cast(kind)
    return queue.select(F.lit("queue").alias("part"), "source", "status", "delay", "consecutive_failures", "last_error").unionByName(promoted.select(F.lit("promoted").alias("part"), "source", "status", none("long").alias("delay"), none("long").alias("consecutive_failures"), none("string").alias("last_error")))


def _recalled(spark, got):
    postings = got("postings")
    return op.recalled(postings, ("direct",)).select(F.lit("direct").alias("by"), "identity").unionByName(op.recalled(postings, ("direct", "verification")).select(F.lit("independent").alias("by"), "identity"))


def _ledger(spark, got):
    return op_ledger(got("families"), got("deliveries"), got("claims"), 100)


def op_ledger(families, deliveries, claims, n):
    """The newest families: what was delivered and claimed a channel, and which channel they are eligible for."""
    newest = families.orderBy(c("first_detected_at").desc(), "family_key").limit(n)
    sent = deliveries.groupBy(c("family_key").alias("of")).agg(*(f(F.when(c("channel") == ch, c(x))).alias(f"{ch}_{x}") for ch in ("verified", "leads") for x, f in (("disposition", F.max), ("delivered_at", F.max))))
    held = claims.groupBy(c("family_key").alias("by")).agg(*(F.bool_or(c("channel") == ch).alias(f"{ch}_claimed") for ch in ("verified", "leads")))
    met = newest.join(sent, c("family_key") == c("of"), "left").join(held, c("family_key") == c("by"), "left")
    base, claimed = c("target_match").isin(*TARGETS) & c("category").isin(*TECH), lambda ch: F.coalesce(f"{ch}_claimed", F.lit(False)).alias(f"{ch}_claimed")
    return met.select("family_key", *(c(f"{ch}_disposition").isNotNull().alias(f"{ch}_has_delivery") for ch in ("verified", "leads")), "verified_disposition", "leads_disposition", "verified_delivered_at", claimed("verified"), claimed("leads"), (base & (c("direct_openings") > 0)).alias("verified_eligible"), (base & (c("direct_openings") == 0) & (c("backstop_openings") > 0)).alias("lead_eligible"))


def _channels(spark, got):
    counted = lambda d: F.count_if(c("disposition") == d)
    return got("deliveries").groupBy("channel").agg(counted("sent").alias("sent_total"), counted("suppressed").alias("suppressed_total"), F.max(F.when(c("disposition") == "sent", c("delivered_at"))).alias("last_sent_at"))


#: key: what it does with the views it names.
RUNS = {
    "upsert_postings": lambda spark, got: op.upsert(got("held"), got("snap"), now()), "restore_legacy_removed": lambda spark, got: op.restore_removed(got("dimmed"), got("whole_sources"), now()).select("posting_key", "active", "removed_at"),
    "close_provider_stale": lambda spark, got: op.provider_stale(got("stored"), got("boards"), got("board_snap")), "apply_link_states": lambda spark, got: op.link_states(got("postings"), got("checks")), "close_non_actionable": lambda spark, got: op.without_dead_hosts(got("linked")),
    "schedule_catalog": lambda spark, got: op.schedule(got("catalog"), got("targets_now"), got("health_now"), now()), "crawl_target_update": lambda spark, got: op.finish_targets(got("targets_now"), got("runs")), "candidate_outcome": _probed, "retire_dormant": _retired,
    "new_and_removed_keys": lambda spark, got: op.key_changes(got("held"), got("snap"), got("whole_sources")), "unverified_leads": lambda spark, got: op.unverified_leads(got("leads"), now(), DAYS, N), "lead_outcomes": lambda spark, got: op.lead_outcomes(got("postings"), got("verdicts")),
    "registry_recall_join": _recalled, "direct_only": lambda spark, got: op.direct_only(got("postings")), "observation_upsert": _observed, "candidate_upsert": lambda spark, got: op.merged_candidates(got("queue"), got("found"), now()),
    "health_upsert": lambda spark, got: op.merged_health(got("health_now"), op.latest(got("runs"))), "ledger_diagnostics": _ledger, "channel_totals": _channels,
}


def queries() -> dict:
    return {k: lambda spark, sf_dir, f=f: f(spark, lambda name: dialect.frame(spark, sf_dir, name)) for k, f in RUNS.items()}


GOOD, TECHS, INDEX = names(TARGETS), names(TECH), names(INDEX_MODES)
NEWEST_RUN = "(select * from (select *, row_number() over (partition by source order by finished_at desc, complete desc, status, rows_scanned) as nth from {runs}) where nth = 1)"
ROLES = f"(select distinct source_mode, identity, {SIG.replace('title', 'normalized_title')} as role from {{postings}} where active and target_match in ({GOOD}) and category in ({TECHS}))"
EVERY = "case when scope = 'historical' then 86400 else case kind " + " ".join(f"when '{k}' then {v[0]}" for k, v in CADENCE.items()) + " else 3600 end end"
FIRST = "case when scope = 'historical' then 500 else case kind " + " ".join(f"when '{k}' then {v[1]}" for k, v in CADENCE.items()) + " else 100 end end"


def recall_sql(modes: str) -> str:
    return f"select distinct f.identity from {ROLES} f where f.source_mode = 'registry' and (f.identity in (select identity from {ROLES} where source_mode in ({modes})) or f.role in (select role from {ROLES} where source_mode in ({modes})))"


SQL = {
    "upsert_postings": f"""select n.posting_key, n.title, n.target_match, coalesce(n.posted_at, o.posted_at) as posted_at, coalesce(n.updated_at, o.updated_at) as updated_at, case when n.posted_at is null and o.posting_key is not null then o.posted_precision else n.posted_precision end as posted_precision, case when n.posted_at is null and o.posting_key is not null then o.posted_confidence else n.posted_confidence end as posted_confidence,
      case when n.target_match in ({GOOD}) then n.description else '' end as description, coalesce(o.first_seen_at, {{as_of}}) as first_seen_at, {{as_of}} as last_seen_at, true as active, null::timestamp as removed_at from {{snap}} n left join {{held}} o on o.posting_key = n.posting_key
      union all select posting_key, title, target_match, posted_at, updated_at, posted_precision, posted_confidence, description, first_seen_at, last_seen_at, active, removed_at from {{held}} where posting_key not in (select posting_key from {{snap}})""",
    "restore_legacy_removed": "select posting_key, active or back as active, case when back then {as_of} else removed_at end as removed_at from (select *, not active and removed_at is null and source_mode = 'direct' and date_diff('hour', last_seen_at, {as_of}) <= 6 and source in (select source from {whole_sources}) as back from {dimmed})",
    "close_provider_stale": f"select distinct p.posting_key from {{stored}} p join {{boards}} b on b.source = 'greenhouse:' || regexp_replace(lower(p.company), '[^a-z0-9]', '', 'g') and b.complete and b.status in ('ok', 'empty') where p.active and p.source_mode in ({INDEX}) and (b.source, p.identity) not in (select (source, identity) from {{board_snap}} where target_match in ({GOOD}))",
    "apply_link_states": "select posting_key, coalesce(state, 'unchecked') as link_status, checked_at as link_checked_at, active and coalesce(state, '') <> 'closed' as active from {postings} p left join (select url, checked_at, case when code in (404, 410) then 'closed' when code = 200 then case when closed_text then 'closed' else 'active' end when code = 500 then 'failed' else 'protected' end as state from {checks}) k on k.url = p.canonical_apply_url",
    "close_non_actionable": f"select posting_key, active and {actionable('url')} as active from {{linked}}",
    "schedule_catalog": f"""select coalesce(k.source, t.source) as source, coalesce(k.kind not in ({names(FALLBACK_KINDS)}), false) as enabled, k.source is not null as scheduled, case when k.source is not null then k.first end as priority, coalesce(k.every, t.interval_seconds) as interval_seconds,
      case when g.source is not null then coalesce(t.last_complete_at, g.last_success_at) else t.last_complete_at end as last_complete_at, case when g.source is not null then coalesce(t.last_finished_at, g.last_attempt_at) else t.last_finished_at end as last_finished_at,
      case when g.source is not null and coalesce(t.last_status, 'pending') = 'pending' then g.status else coalesce(t.last_status, 'pending') end as last_status, (case when g.source is not null and coalesce(t.last_rows, 0) = 0 then g.rows_scanned else coalesce(t.last_rows, 0) end)::bigint as last_rows,
      case when g.source is not null and t.last_complete_at is null then greatest({{as_of}}, g.last_success_at + to_seconds(k.every)) else t.next_run_at end as next_run_at
      from (select *, {EVERY} as every, {FIRST} as first from {{catalog}} where validated and kind in ({names(CADENCE)})) k full join {{targets_now}} t on t.source = k.source left join (select * from {{health_now}} where complete and last_success_at is not null and status not in ('broken', 'blocked', 'truncated', 'partial', 'dormant')) g on g.source = k.source""",
    "crawl_target_update": f"""select t.source, case when r.source is not null then r.finished_at + to_seconds(case when r.error is not null then least(21600, greatest(300, t.interval_seconds) * power(2, least(t.consecutive_failures + 1, 5)))::bigint when not whole then least(21600, greatest(600, t.interval_seconds)) when r.rows_scanned = 0 then greatest(21600, t.interval_seconds) else t.interval_seconds end) end as next_run_at,
      case when r.complete and r.error is null then r.finished_at else t.last_complete_at end as last_complete_at, coalesce(r.finished_at, t.last_finished_at) as last_finished_at, coalesce(r.status, t.last_status) as last_status, coalesce(r.rows_scanned, 0)::bigint as last_rows,
      (case when r.source is null then t.consecutive_failures when r.error is null and whole then 0 else t.consecutive_failures + 1 end)::bigint as consecutive_failures, r.error as last_error from {{targets_now}} t left join (select *, complete and status not in ('blocked', 'truncated', 'partial') as whole from {NEWEST_RUN}) r on r.source = t.source""",
    "candidate_outcome": """with m as (select q.*, p.source is not null as tried, p.status as result, p.error, p.note, coalesce(p.error is null and p.complete and p.status in ('ok', 'empty') and p.mode = 'board', false) as good from {queue} q left join {probes} p on p.source = q.source)
      select 'promoted' as part, source, result as status, null::bigint as delay, null::bigint as consecutive_failures, null as last_error from m where good
      union all select 'queue', source, case when not tried then status when result = 'dormant' or consecutive_failures >= 4 then 'rejected' else 'retry' end, case when tried then (21600 * power(2, least(consecutive_failures, 4)))::bigint end, (consecutive_failures + tried::int)::bigint, case when tried then coalesce(error, note, result) else last_error end from m where not good""",
    "retire_dormant": f"""select 'target' as part, source, enabled and not gone as live, case when gone then 'dormant' else last_status end as state, null as origin, last_complete_at as at from (select *, source in (select source from {NEWEST_RUN} where status = 'dormant') as gone from {{targets_now}})
      union all select 'catalog', source, validated and not gone, case when gone then 'historical' else scope end, case when gone then 'retired-dormant' else origin end, case when gone then {{as_of}} else last_discovered_at end from (select *, source in (select source from {NEWEST_RUN} where status = 'dormant') as gone from {{catalog}})""",
    "new_and_removed_keys": """select source, sum(fresh)::bigint as new_keys, (case when source in (select source from {whole_sources}) then sum(gone) else 0 end)::bigint as removed_keys from (select source, (posting_key not in (select posting_key from {held}))::int as fresh, 0 as gone from {snap}
      union all select source, 0, (active and posting_key not in (select posting_key from {snap}))::int from {held}) group by source""",
    "unverified_leads": f"""select posting_key, identity, state as link_status from (select *, row_number() over (partition by identity order by today desc, state = 'unchecked' desc, first_seen_at desc, last_seen_at desc, posting_key) as nth from (select *, coalesce(link_status, 'unchecked') as state, first_seen_at >= {{as_of}} - interval 1 day as today from {{leads}}) l
      where active and source_mode in ({INDEX}) and target_match in ({GOOD}) and first_seen_at >= {{as_of}} - to_days({DAYS}) and state not in ('closed', 'invalid', 'verified') and (link_checked_at is null or link_checked_at < {{as_of}} - case when state = 'checking' then interval 15 minutes else interval 6 hours end)
      and {actionable('canonical_apply_url')} and identity not in (select identity from {{leads}} where active and source_mode in ('direct', 'verification') and target_match in ({GOOD}))) where nth = 1 order by today desc, state = 'unchecked' desc, first_seen_at desc, last_seen_at desc, posting_key limit {N}""",
    "lead_outcomes": f"select posting_key, case when url is null then 'unchecked' when matched then 'verified' when closed then 'closed' when result = 'blocked' then 'blocked' when error is not null then 'error' else 'unverified' end as outcome from {{postings}} p left join {{verdicts}} v on v.url = p.canonical_apply_url where active and source_mode in ({INDEX})",
    "registry_recall_join": f"""select 'direct' as by, identity from ({recall_sql("'direct'")}) union all select 'independent', identity from ({recall_sql("'direct', 'verification'")})""",
    "direct_only": f"select identity from {ROLES} where source_mode = 'direct' group by identity having bool_and(role not in (select role from {ROLES} where source_mode = 'registry'))",
    "observation_upsert": """select coalesce(n.key, o.key) as key, coalesce(n.name, o.name) as name, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])))), '|') as aliases, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.sectors, []), coalesce(n.sectors, [])))), '|') as sectors, coalesce(n.location, o.location) as location, round(greatest(o.signal, n.signal), 6) as signal,
      array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(map_entries(coalesce(o.metadata, map([]::varchar[], []::varchar[]))), lambda e: not list_contains(map_keys(coalesce(n.metadata, map([]::varchar[], []::varchar[]))), e.key)), lambda e: e.key || '=' || e.value), list_transform(map_entries(coalesce(n.metadata, map([]::varchar[], []::varchar[]))), lambda e: e.key || '=' || e.value)))), '|') as metadata,
      case when n.key is not null then {as_of} else o.last_seen_at end as last_seen_at, case when n.key is null or coalesce(o.probe_status, '') = 'resolved' then o.probe_status else 'candidate' end as probe_status from {employers_seen} o full join {employers_new} n on n.key = o.key""",
    "candidate_upsert": "select coalesce(o.source, n.source) as source, coalesce(n.kind, o.kind) as kind, case when o.scope = 'current' then 'current' else coalesce(n.scope, o.scope) end as scope, (coalesce(o.evidence_count, 0) + (n.source is not null)::int)::bigint as evidence_count, case when n.source is null or coalesce(o.status, '') = 'validated' then o.status else 'candidate' end as status, coalesce(n.origin, o.origin) as origin, case when n.source is not null then {as_of} else o.discovered_at end as last_seen_at from {queue} o full join {found} n on n.source = o.source",
    "health_upsert": f"""select coalesce(n.source, o.source) as source, case when n.source is null then o.complete when n.error is not null then false else n.complete end as complete, coalesce(n.rows_scanned, o.rows_scanned)::bigint as rows_scanned, (case when n.source is null then o.target_rows when n.error is not null then coalesce(o.target_rows, 0) else n.target_rows end)::bigint as target_rows,
      coalesce(n.finished_at, o.last_attempt_at) as last_attempt_at, coalesce(case when n.error is null and n.status not in ('blocked', 'broken') then n.finished_at end, o.last_success_at) as last_success_at, coalesce(n.status, o.status) as status,
      case when n.source is null then o.scope when n.error is null and n.target_rows > 0 then 'current' when n.error is not null and o.consecutive_failures >= 2 then 'historical' else n.scope end as scope,
      case when n.source is null then o.lifecycle when n.error is not null then case when o.consecutive_failures >= 2 then 'quarantined' else coalesce(o.lifecycle, 'candidate') end when n.target_rows > 0 then 'productive' when coalesce(o.lifecycle, 'candidate') = 'quarantined' then 'candidate' else coalesce(o.lifecycle, 'candidate') end as lifecycle,
      (case when n.source is null then o.consecutive_failures when n.error is not null then coalesce(o.consecutive_failures, 0) + 1 else 0 end)::bigint as consecutive_failures from {NEWEST_RUN} n full join {{health_now}} o on o.source = n.source""",
    "ledger_diagnostics": f"""with f as (select * from {{families}} order by first_detected_at desc, family_key limit 100) select family_key, {', '.join(f"family_key in (select family_key from {{deliveries}} where channel = '{ch}') as {ch}_has_delivery, (select max(disposition) from {{deliveries}} d where d.channel = '{ch}' and d.family_key = f.family_key) as {ch}_disposition, family_key in (select family_key from {{claims}} where channel = '{ch}') as {ch}_claimed" for ch in ('verified', 'leads'))},
      (select max(delivered_at) from {{deliveries}} d where d.channel = 'verified' and d.family_key = f.family_key) as verified_delivered_at, target_match in ({GOOD}) and category in ({TECHS}) and direct_openings > 0 as verified_eligible, target_match in ({GOOD}) and category in ({TECHS}) and direct_openings = 0 and backstop_openings > 0 as lead_eligible from f""",
    "channel_totals": "select channel, count(*) filter (disposition = 'sent') as sent_total, count(*) filter (disposition = 'suppressed') as suppressed_total, max(delivered_at) filter (disposition = 'sent') as last_sent_at from {deliveries} group by channel",
}


def oracle() -> dict[str, str]:
    return {k: dialect.whole(v) for k, v in SQL.items()}
