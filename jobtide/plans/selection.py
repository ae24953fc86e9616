"""Queries of selections, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import INDEX_MODES, NON_APPLICATION_HOSTS, TARGETS
from ..operators import selection as op
from ..sources.fixtures import AS_OF
from . import dialect
from .dialect import TEXTS
from .scalars import host, names, parts

c = F.col
TEXTS.update({
    "sensor_rows": "select *, case when length(source_id) % 3 = 0 then 'Summer 2027, Fall 2027' else season end as cycle_text from {postings}",
    "season_specs": "select source, case when length(source) % 2 = 0 then 'summer-2027' else 'mixed' end as cycle from {postings} where source_mode in ('registry', 'external-index') group by source",
    "corpus": "select posting_key, case when title like '%Machine Learning%' then 'software' else category end as category, case when title like '%Trading%' then 'not_internship' else target_match end as target_match, season from {postings} where length(source_id) % 2 = 0",
    "lead_links": "select p.posting_key, p.company, p.posted_at, l.url from {postings} p join {fx_links} l on l.id = cast(split_part(p.source_id, '-', 3) as int) where p.source_mode in ('registry', 'external-index', 'verification-lead')",
    "plan_sensors": "select url, case when length(company) % 2 = 0 or length(posting_key) % 3 = 0 then null else posted_at end as posted_at, cast(null as timestamp) as sensor_at from {lead_links}",
    "plan_durable": "select url from {fx_links} where n % 2 = 0",
    "census": "select concat(case evidence_count % 3 when 0 then 'domain:isolvedhire:' when 1 then 'domain:jazzhr:' else 'domain:acme:' end, cast(evidence_count * 100 + consecutive_failures as string)) as source from {fx_candidates}",
    "fresh_boards": "select concat(case evidence_count % 5 when 0 then 'greenhouse:' when 1 then 'schema:' when 2 then 'workday:' when 3 then 'lever:' else 'icims:' end, source) as name, scope from {fx_candidates} where consecutive_failures < 4",
    "durable_boards": "select concat(case evidence_count % 5 when 0 then 'greenhouse:' when 1 then 'schema:' when 2 then 'workday:' when 3 then 'lever:' else 'icims:' end, source) as name, 'current' as scope from {fx_candidates} where consecutive_failures > 2",
    "sensor_lines": "select n as doc, id as line, case id % 4 when 0 then concat(' ', name, ' ') when 1 then '' when 2 then '↳' else '—' end as cell, title from {fx_texts}",
})
HOURS, MINUTES, SIZE, PAGES, BOARDS, SLOT, CAP, SHARDS = 24 * 60, 30, 25, 40, 3, 5, 200, 4


def now():
    return F.expr(AS_OF)


def snapshot(got):
    """Families as a publisher nests them: openings, each with its evidence."""
    said = F.transform("evidence", lambda e: F.struct(e["source"].alias("source"), e["source_mode"].alias("source_mode"), F.timestamp_micros(-e["at"]).alias("observed_at")))
    return got("fuse_openings").groupBy("family_key").agg(F.collect_list(F.struct("canonical_apply_url", said.alias("evidence"))).alias("openings"))


RUNS = {
    "mixed_cycle_filter": lambda got: op.mixed_cycle(got("sensor_rows")).select("posting_key"), "cycle_stamp": lambda got: op.stamped(got("sensor_rows"), got("season_specs")).select("posting_key", "year", "season", "target_match"), "classification_regression": lambda got: op.label_changes(got("corpus"), got("postings")),
    "batch_leads": lambda got: op.batches(got("lead_links"), SIZE).select("posting_key", "company", "host", "batch"), "retryable_leads": lambda got: op.retryable(got("leads"), now(), HOURS, MINUTES, 100).select("posting_key", "link_status"), "rotating_slice": lambda got: op.rotated(got("fx_candidates"), "source", 37, SLOT).select("source"),
    "verification_plan": lambda got: op.verification_plan(got("plan_sensors"), got("plan_durable"), PAGES, BOARDS, SLOT, CAP), "shard_census": lambda got: op.census_shard(got("census"), SHARDS, 1), "direct_selection": lambda got: op.direct_boards(got("fresh_boards"), got("durable_boards"), 12, 6, CAP),
    "ffill_company": lambda got: op.filled(got("sensor_lines")).select("doc", "line", "company"), "read_snapshot_observations": lambda got: op.snapshot_observations(snapshot(got), now()).select("family_key", "canonical_apply_url", "source", "source_mode", c("observed_at").cast("timestamp_ntz").alias("observed_at")),
}


def queries() -> dict:
    return {k: lambda spark, sf_dir, f=f: f(lambda name: dialect.frame(spark, sf_dir, name)) for k, f in RUNS.items()}


GOOD, INDEX = names(TARGETS), names(INDEX_MODES)
FAST = names(op.FAST_BOARDS)
turn = lambda rows, key, n, slot: f"(select {key} from (select {key}, row_number() over (order by sha256({key}), {key}) - 1 as nth, count(*) over () as size from {rows}) where size <= {n} or ((nth - ({slot} * {n}) % size) % size + size) % size < {n})"
BOTH = f"(select url, {host('url')} as host from (select url from {{plan_sensors}} union select url from {{plan_durable}}))"
HOT = f"(select url, max(coalesce(posted_at, sensor_at)) as at_ from {{plan_sensors}} where {host('url')} not in ('', {FAST}, {names(NON_APPLICATION_HOSTS)}) group by url)"
DATED = f"(select url from {HOT} where at_ is not null order by at_ desc, url limit {PAGES})"
LEFT = f"greatest(0, {PAGES} - (select count(*) from {DATED}))"
SQL = {
    "mixed_cycle_filter": "select posting_key from {sensor_rows} where active and (lower(cycle_text) like '%summer 2027%' or title like '%2027%' and title ilike '%intern%' and not regexp_matches(title, '(?i)fall|winter|spring'))",
    "cycle_stamp": "select posting_key, case when hit then 2027 else year end as year, case when hit then 'summer' else season end as season, case when hit then 'source_confirmed' else target_match end as target_match from (select r.*, r.target_match = 'unknown' and coalesce(s.cycle = 'summer-2027' or s.cycle = 'mixed' and r.cycle_text ilike '%summer 2027%', false) as hit from {sensor_rows} r left join {season_specs} s on s.source = r.source)",
    "classification_regression": " union all ".join(f"select p.posting_key, '{x}' as field, f.{x} as expected, p.{x} as found from {{corpus}} f join {{postings}} p on p.posting_key = f.posting_key where f.{x} is distinct from p.{x}" for x in ("category", "target_match", "season")),
    "batch_leads": f"select posting_key, company, host, (row_number() over (partition by company, host order by posted_at desc nulls last, posting_key) + {SIZE - 1}) // {SIZE} as batch from (select *, {host('url')} as host from {{lead_links}})",
    "retryable_leads": f"select posting_key, link_status from {{leads}} where active and source_mode in ({INDEX}) and target_match in ({GOOD}) and first_seen_at >= {{as_of}} - to_hours({HOURS}) and link_status in ('blocked', 'error', 'unverified', 'checking') and link_checked_at <= {{as_of}} - to_minutes({MINUTES}) order by first_seen_at desc, link_checked_at, posting_key limit 100",
    "rotating_slice": f"select source from {turn('{fx_candidates}', 'source', 37, SLOT)}",
    "verification_plan": f"""select name, min(lane) as lane from (select distinct host || ':' || lower({parts('url')}[1]) as name, 1 as lane from {BOTH} where host in ({FAST}) union all select url, 2 from {DATED}
      union all select url, 2 from (select url, row_number() over (order by sha256(url), url) - 1 as nth, count(*) over () as size, {LEFT} as room from {HOT} where at_ is null) where room > 0 and (size <= room or ((nth - ({SLOT} * room) % size) % size + size) % size < room)
      union all select name, 3 from {turn(f"(select distinct 'workday:' || host as name from {BOTH} where host like '%.myworkdayjobs.com')", 'name', BOARDS, SLOT)}) group by name order by lane, name limit {CAP}""",
    "shard_census": f"select * from (select distinct case when source like 'domain:isolvedhire:%' then 'isolvedhire' else 'jazzhr' end || ':' || split_part(source, ':', 3) as name, case when source like 'domain:isolvedhire:%' then 'isolvedhire' else 'jazzhr' end as kind from {{census}} where source like 'domain:isolvedhire:%' or source like 'domain:jazzhr:%') where ('0x' || sha1(name)[1:16])::uhugeint % {SHARDS} = 1",
    "direct_selection": f"""select name, kind, origin from (select *, row_number() over (partition by kind order by name) as nth from (select *, case when regexp_matches(name, '^(greenhouse|lever|ashby):') then 'board' when name like 'schema:%' then 'schema' when name like 'workday:%' then 'workday' else 'other' end as kind from
      (select name, min(origin) as origin_, case when bool_or(origin = 'fresh') then 'fresh' else 'durable' end as origin from (select name, scope, 'fresh' as origin from {{fresh_boards}} union all select name, scope, 'durable' from {{durable_boards}}) where scope <> 'historical' group by name))) where kind not in ('schema', 'workday') or nth <= case kind when 'schema' then 12 else 6 end order by list_position(['board', 'schema', 'workday', 'other'], kind), name limit {CAP}""",
    "ffill_company": "select doc, line, last_value(case when trim(cell) not in ('', '↳', '-', '–', '—') then trim(cell) end ignore nulls) over (partition by doc order by line rows between unbounded preceding and current row) as company from {sensor_lines}",
    "read_snapshot_observations": "select * from (select o.family_key, p.canonical_apply_url, p.source, p.source_mode, max(coalesce(p.posted_at, p.first_seen_at))::timestamp as observed_at from {postings} p join {fuse_openings} o on o.canonical_apply_url = p.canonical_apply_url group by 1, 2, 3, 4) where date_diff('second', observed_at, {as_of}) <= case when source_mode in ('direct', 'verification') then 72 else 24 end * 3600",
}


def oracle() -> dict[str, str]:
    return {k: dialect.whole(v) for k, v in SQL.items()}
