"""One query a column function: the function's value beside its row, over a whole view, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import APPLY_MARKERS, CADENCE, CAREER_MARKERS, CAREER_SUBDOMAINS, CLICK_KEYS, CLOSED, COMPANY_ALIASES, DETAIL_MARKERS, FAILURES, LEGAL_SUFFIX, MULTIPART_SUFFIXES, NON_APPLICATION_HOSTS, PROVIDERS, TITLE_STOPWORDS, TRACKING_KEYS
from ..functions import rules, text, urls
from ..sources.fixtures import AS_OF, VIEWS, view

c = F.col


def as_of() -> Column:
    return F.expr(AS_OF)



def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def any_sql(x: str, tokens) -> str:
    return "(" + " or ".join(f"contains({x}, '{t}')" for t in tokens) + ")"


def rep(x: str, *steps: tuple[str, str]) -> str:
    for pattern, out in steps:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{out}', 'g')"
    return x


def got(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


# The same rules in the other engine's dialect, without lookaround.
def clean(x: str) -> str:
    return "trim(" + rep(f"coalesce({x}, '')", (r"(?i)<\s*br\s*/?\s*>|</p>|</div>|</li>", " | "), (r"(?i)^\[(.+)\]\(https?://[^)]+\)$", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("<[^>]+>", " "), ("&amp;", "&"), ("&nbsp;", " "), (r"\s+", " ")) + ", ' *|·-—–')"


def raw_key(x: str) -> str:
    return f"trim({rep('trim(' + rep(f'lower({clean(x)})', ('&', ' and '), (r'\([^)]*\)', ' '), ('[^a-z0-9]+', ' ')) + ')', (LEGAL_SUFFIX, ''))})"


def company(x: str) -> str:
    pairs = " ".join(f"when '{k}' then '{v}'" for k, v in COMPANY_ALIASES.items())
    return f"coalesce(case {raw_key(x)} {pairs} end, nullif({clean(x)}, ''), 'Unknown company')"


def norm_title(x: str) -> str:
    t = rep(f"lower({clean(x)})", (r"\s+(?:-|–|—|\|)\s+(?:remote|hybrid|onsite|on-site|[a-z .'-]+,\s*[a-z]{2}|[a-z .'-]+,\s*(?:usa|united states))$", ""), (r"\[(?:remote|hybrid|onsite|on-site)\]", ""), (r"\s*\((?:remote|hybrid|onsite|on-site)\)\s*$", ""), (r"\s*\((?:summer|fall|spring|winter)\s+20\d{2}\)\s*$", ""), (r"\b(?:summer|fall|spring|winter)\s+20\d{2}\b", ""), ("[^a-z0-9+#./ -]+", " "), (r"\s+", " "))
    t = f"trim({t}, ' -/')"
    return f"case when contains({t}, 'intern') then trim({rep(t, (r'\b(?:i{1,3}|iv|v|1|2|3|4|5)\b$', ''))}) else {t} end"


def scheme(u: str) -> str:
    return f"lower({got(u, '^([A-Za-z][A-Za-z0-9+.-]*):')})"


def host(u: str) -> str:
    return f"lower({got(u, '^[^:/?#]+://([^/?#]*)')})"


def path(u: str) -> str:
    return got(u, "^[^:/?#]+://[^/?#]*([^?#]*)")


def query(u: str) -> str:
    return got(u, r"^[^?#]*\?([^#]*)")


def param(u: str, name: str) -> str:
    return got(query(u), f"(?:^|&){name}=([^&]+)")


def parts(u: str) -> str:
    return f"list_filter(string_split({path(u)}, '/'), lambda s: s <> '')"


def rooted(p: str) -> str:
    return f"coalesce(nullif({rep(p, ('/+$', ''))}, ''), '/')"


def built(s: str, h: str, p: str, q: str, f: str = "''") -> str:
    return f"{s} || '://' || {h} || {p} || case when {q} <> '' then '?' || {q} else '' end || case when {f} <> '' then '#' || {f} else '' end"


def kept(u: str, drop: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({query(u)}, '&'), lambda p: p <> '' and not ({drop})), lambda p: {got('p', '^([^=]*)')} || '=' || {got('p', '=(.*)$')}), '&')"


KEY = f"lower({got('p', '^([^=]*)')})"
CANON = built(scheme("url"), host("url"), rooted(path("url")), kept("url", f"{KEY} in ({names(TRACKING_KEYS)})"))
UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def identity(u: str, source: str, source_id: str) -> str:
    h, p = host(u), rep(path(u), ("/+$", ""))
    one = lambda tag, ok, pattern, low="": f"case when {ok} and regexp_matches({p}, '{pattern}') then '{tag}:' || {low}({got(p, pattern)}) end"
    plain = built(scheme(u), h, rooted(rep(p, ("/apply$", ""))), query(u))
    return f"""coalesce('greenhouse:' || coalesce(nullif({param(u, 'gh_jid')}, ''), nullif({param(u, 'job_id')}, '')), {one('greenhouse', f"contains({h}, 'greenhouse')", r'/(?:jobs?|apply)/(\d+)(?:/|$)')}, {one('lever', f"{h} = 'jobs.lever.co'", UUID, 'lower')}, {one('ashby', f"{h} = 'jobs.ashbyhq.com'", UUID, 'lower')},
      {one('google', f"contains({h}, 'google.com')", r'/jobs/results/(\d+)')}, {one('smartrecruiters', f"contains({h}, 'smartrecruiters.com')", r'/(\d{8,})(?:/|$)')}, {one('amazon', f"{h} like '%amazon.jobs'", r'/jobs/(\d+)(?:/|$)')},
      case when contains({h}, 'myworkdayjobs.com') and regexp_matches({p}, '_([A-Za-z]{{0,6}}\\d[A-Za-z0-9-]*)$') then 'workday:' || {h} || ':' || lower({got(p, r'_([A-Za-z]{0,6}\d[A-Za-z0-9-]*)$')}) end, nullif({plain}, ':///'), concat_ws(':', {source}, {source_id}))"""


def actionable(u: str) -> str:
    return f"({scheme(u)} in ('http', 'https') and {host(u)} not in ({names(NON_APPLICATION_HOSTS)}))"


def domain(h: str) -> str:
    return f"case when len(string_split({h}, '.')) < 2 then {h} when len(string_split({h}, '.')) >= 3 and array_to_string(string_split({h}, '.')[-2:], '.') in ({names(MULTIPART_SUFFIXES)}) then array_to_string(string_split({h}, '.')[-3:], '.') else array_to_string(string_split({h}, '.')[-2:], '.') end"


def score(u: str) -> str:
    h, p = host(u), f"lower({path(u)})"
    return f"""case when {scheme(u)} not like 'http%' or {h} = '' or regexp_matches({p}, '\\.(?:png|jpe?g|gif|svg|webp|ico)$') then -10000 when not {actionable(u)} then -9000 else
      (case when {any_sql(h, PROVIDERS)} then 500 else 0 end + case when {any_sql(p, APPLY_MARKERS)} then 200 else 0 end + case when contains({u}, 'gh_jid=') or contains({u}, 'job_id=') then 250 else 0 end + case when {h} like 'jobs.%' or {h} like 'careers.%' then 80 else 0 end - case when {p} in ('', '/') then 100 else 0 end) end"""


def similarity(a: str, b: str) -> str:
    tokens = lambda x: f"list_distinct(list_filter(string_split(trim({rep(f'lower({x})', ('[^a-z0-9]+', ' '))}), ' '), lambda t: length(t) > 1 and t not in ({names(TITLE_STOPWORDS)})))"
    least = f"least(len({tokens(a)}), len({tokens(b)}))"
    return f"case when {least} > 0 then len(list_intersect({tokens(a)}, {tokens(b)})) / {least} else 0.0 end"


def digest(n: int, x: str) -> str:
    return f"substr(sha256({x}), 1, {n})"


def first_case(x: str, pairs, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {any_sql(x, t)} then '{k}'" for k, t in pairs) + f" else {otherwise} end"


def cadence(i: int, default: int, historical: int) -> str:
    return f"case when scope = 'historical' then {historical} else (case kind " + " ".join(f"when '{k}' then {v[i]}" for k, v in CADENCE.items()) + f" else {default} end) end"


H, LINK, TEXT, POST = host("url"), "fx_links", "fx_texts", "fx_postings"
WHO = ("source", "source_id")
SIG = f"""lower({company('company')}) || ':' || array_to_string(list_transform(list_filter(regexp_extract_all(lower(title), '[a-z0-9+#]+'), lambda t: t not in ('or', 'summer', '2027')), lambda t: case when t = 'engineering' then 'engineer' when t in ('internship', 'internships') then 'intern' else t end), ' ')"""
BARE = got(H, "^([^:]*)")
AGE = r"(?i)(?:^|[^\d])(\d+)\s*(m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|week|weeks)(?:\s+ago)?\b"
STRIP = built(scheme("url"), got("url", "^[^:/?#]+://([^/?#]*)"), path("url"), kept("url", f"{KEY} like 'utm\\_%' escape '\\' or {KEY} in ({names(CLICK_KEYS)})"), got("url", "#(.*)$"))
PROB = "round(least(0.985::double, 0.18::double + 0.52 * least(1, n % 2) + 0.38 * least(1, n % 3) + 0.20 * least(3, n % 5) + 0.12 * least(2, n % 4)), 4)"
TECHP = "case when n % 9 = 0 then 0.08 else round(least(0.995::double, 0.38 + 0.24 * ln(1 + (n % 9)::double)), 4) end"
SEG1, SUB = f"{parts('url')}[1]", got(BARE, r"([^.]*)\.[^.]+\.[^.]+$")
TENANT = {
    "smartrecruiters": (f"{BARE} = 'jobs.smartrecruiters.com'", SEG1), "rippling": (f"{BARE} = 'ats.rippling.com'", f"case when lower({SEG1}) in ('en-us', 'en-gb', 'es-419', 'fr-fr', 'de-de') then {parts('url')}[2] else {SEG1} end"), "icims": (f"{BARE} like '%.icims.com' and list_contains({parts('url')}, 'jobs')", BARE),
    "oracle-cloud": (f"contains({BARE}, 'oraclecloud.com')", f"{scheme('url')} || '://' || {BARE} || ' ' || {parts('url')}[list_position({parts('url')}, 'sites') + 1]"), "recruitee": (f"{BARE} like '%.recruitee.com'", SUB), "workable": (f"{BARE} = 'apply.workable.com'", SEG1),
}
SITE_PARTS = f"(case when list_contains({parts('url')}, 'job') then {parts('url')}[1:list_position({parts('url')}, 'job') - 1] else {parts('url')} end)"

#: key: (view, id columns, {output: (column, SQL)}); columns are made on demand, as they need a session.
SCALARS: dict[str, tuple[str, tuple[str, ...], dict[str, tuple[Callable[[], Column], str]]]] = {
    "clean_text": (TEXT, ("id",), {"cleaned": (lambda: text.clean_text(c("company")), clean("company"))}),
    "company_key": (TEXT, ("id",), {"key": (lambda: text.company_key(c("company")), raw_key(company("company")))}),
    "canonical_company": (TEXT, ("id",), {"canonical": (lambda: text.canonical_company(c("company")), company("company"))}),
    "normalize_locations": (POST, WHO, {"places": (lambda: text.normalize_locations(F.array("loc1", "loc2", "loc1")), "list_filter([loc1, loc2], lambda v, i: i = 1 or lower(v) <> lower(loc1))")}),
    "canonical_url": (LINK, ("id",), {"canonical": (lambda: urls.canonical_url(c("url")), CANON)}),
    "canonical_application_url": (LINK, ("id",), {"canonical": (lambda: urls.canonical_application_url(c("url")), built(scheme("url"), H, rooted(rep(path("url"), ("/{2,}", "/"))), query("url")))}),
    "strip_tracking_query": (LINK, ("id",), {"stripped": (lambda: urls.strip_tracking_query(c("url")), f"case when {query('url')} = '' then url else {STRIP} end")}),
    "clean_sensor_url": (LINK, ("id",), {"cleaned": (lambda: urls.clean_sensor_url(F.concat(F.lit(" "), c("url"), F.lit('.,"'))), """rtrim(trim(' ' || url || '.,"'), '"''.,;>')""")}),
    "normalize_http_url": (LINK, ("id",), {"normalized": (lambda: urls.normalize_http_url(F.replace(c("url"), F.lit("/"), F.lit("%2f"))), f"case when {scheme('url')} in ('http', 'https') then " + built(scheme("url"), got("url", "^[^:/?#]+://([^/?#]*)"), f"coalesce(nullif({path('url')}, ''), '/')", query("url")) + " end")}),
    "application_identity": (LINK, ("id",), {"identity": (lambda: urls.application_identity(urls.canonical_url(c("url")), c("kind"), c("id").cast("string")), f"(select {identity('z.u', 'kind', 'id::varchar')} from (select {CANON} u) z)")}),
    "canonical_source_name": (POST, WHO, {"canonical": (lambda: text.canonical_source_name(F.concat(c("source"), F.lit("X"))), "case when regexp_matches(source, '^(ashby|greenhouse|lever):') then lower(source || 'X') else source || 'X' end")}),
    "normalize_title": (TEXT, ("id",), {"normalized": (lambda: text.normalize_title(c("title")), norm_title("title"))}),
    "family_key": (TEXT, ("id",), {"key": (lambda: text.family_key(c("company"), c("title"), F.lit("summer"), c("n"), F.lit(None).cast("string")), digest(24, f"{raw_key(company('company'))} || '|' || {norm_title('title')} || '|summer|' || n || '|'"))}),
    "coverage_role_signature": (TEXT, ("id",), {"signature": (lambda: text.coverage_role_signature(c("company"), c("title")), SIG)}),
    "title_similarity": (TEXT, ("id",), {"similarity": (lambda: text.title_similarity(c("title"), F.concat(c("name"), F.lit(" engineering intern analyst"))), similarity("title", "name || ' engineering intern analyst'"))}),
    "is_actionable_url": (LINK, ("id",), {"actionable": (lambda: urls.is_actionable_url(c("url")), actionable("url"))}),
    "is_specific_url": (LINK, ("id",), {"specific": (lambda: urls.is_specific_url(c("url")), f"{actionable('url')} and (regexp_matches({query('url')}, '(?i)(?:^|&)gh_jid=\\d+(?:&|$)') or not regexp_matches(lower({rep(path('url'), ('/+$', ''))}), '^(|/open-positions|/about/careers/applications/jobs/results)$|(/careers|/jobs|/search|/jobs/results)$'))")}),
    "provider_kind": (LINK, ("id",), {"provider": (lambda: urls.provider_kind(c("url")), "case " + " ".join(f"when contains({BARE}, '{f}') then '{k}'" if f.endswith(".") else f"when {BARE} = '{f}' or {BARE} like '%.{f}' then '{k}'" for f, k in PROVIDERS.items()) + " end")}),
    "registrable_domain": (LINK, ("id",), {"domain": (lambda: urls.registrable_domain(urls.host(c("url"))), domain(H))}),
    "same_employer_surface": (LINK, ("id",), {"same": (lambda: urls.same_employer_surface(c("url"), F.lit("acme.co.uk")), f"{H} <> '' and ({rep(BARE, ('^www\\.', ''))} = 'acme.co.uk' or {domain(BARE)} = 'acme.co.uk' and (" + " or ".join(f"{BARE} like '{p}%'" for p in CAREER_SUBDOMAINS) + "))")}),
    "is_career_url": (LINK, ("id",), {"career": (lambda: urls.is_career_url(c("url"), c("label")), any_sql(f"lower({path('url')} || ' ' || {query('url')} || ' ' || coalesce(label, ''))", CAREER_MARKERS))}),
    "is_detail_url": (LINK, ("id",), {"detail": (lambda: urls.is_detail_url(c("url")), f"{any_sql(f'lower({path('url')})', DETAIL_MARKERS)} and (regexp_matches(url, '(?i)(?:/|[?&])(?:job|jobs|jobid|job_id|gh_jid|req|requisition)[=/_-]?[0-9a-f-]{{3,}}') or len({parts('url')}) >= 3)")}),
    "greenhouse_token": (LINK, ("id",), {"token": (lambda: urls.greenhouse_token(c("url")), f"case when {H} in ({names(urls.GREENHOUSE_HOSTS)}) and lower({SEG1}) not in ('jobs', 'job', 'embed', 'apply') then {SEG1} end")}),
    "workday_site": (LINK, ("id",), {"site": (lambda: urls.workday_site(c("url")), f"list_reverse(list_filter({SITE_PARTS}, lambda s: not regexp_matches(s, '^[A-Za-z]{{2}}(?:-[A-Za-z]{{2}})?$') and lower(s) not in ('search', 'jobs')))[1]")}),
    "is_board_landing": (LINK, ("id",), {"landing": (lambda: urls.is_board_landing(c("url")), f"case when contains({H}, 'greenhouse.io') then not regexp_matches({path('url')}, '(?i)/(?:jobs?|apply)/(?:\\d+|[0-9a-f-]{{20,}})(?:/|$)') when {H} in ('jobs.lever.co', 'jobs.ashbyhq.com') then len({parts('url')}) = 1 when contains({H}, '.myworkdayjobs.com') then not contains(lower({path('url')}), '/job/') else false end")}),
    "provider_tenant": (LINK, ("id",), {"tenant_kind": (lambda: urls.provider_tenant(c("url"))["kind"], "case " + " ".join(f"when {ok} then '{k}'" for k, (ok, _) in TENANT.items()) + " end"), "tenant": (lambda: urls.provider_tenant(c("url"))["key"], "case " + " ".join(f"when {ok} then {key}" for ok, key in TENANT.values()) + " end")}),
    "application_score": (LINK, ("id",), {"score": (lambda: urls.application_score(c("url")), score("url"))}),
    "choose_apply_url": (LINK, ("id",), {"chosen": (lambda: urls.choose_apply_url(F.array(F.lit("https://github.com/x"), c("url"), F.lit("https://example.com/"))), f"case when {score('url')} > -100 then url else 'https://example.com/' end")}),
    "parse_date": (TEXT, ("id",), {"ts": (lambda: rules.parse_date(c("age")).cast("timestamp_ntz"), "case id % 6 when 2 then make_timestamp((n + 1000000000)::bigint * 1000000) when 3 then timestamp '2001-07-04 00:00:00' end")}),
    "parse_sensor_time": (TEXT, ("id",), {
        "ts": (lambda: rules.parse_sensor_time(c("age"), as_of())["ts"].cast("timestamp_ntz"), f"case id % 6 when 0 then {AS_OF} - to_days(n::int) when 1 then {AS_OF} - interval 1 day when 2 then make_timestamp((n + 1000000000)::bigint * 1000000) when 3 then timestamp '2001-07-04 00:00:00' when 4 then {AS_OF} - to_hours(n::int) end"),
        "time_precision": (lambda: rules.parse_sensor_time(c("age"), as_of())["precision"], "case id % 6 when 0 then 'day' when 1 then 'day' when 2 then 'timestamp' when 3 then 'date' when 4 then 'relative' else 'unknown' end")}),
    "workday_relative_date": (TEXT, ("id",), {
        "ts": (lambda: rules.workday_relative_date(c("workday"), as_of())["ts"].cast("timestamp_ntz"), f"case id % 4 when 0 then {AS_OF} when 1 then {AS_OF} - to_days(n::int) when 2 then timestamp '2001-07-04 10:00:00' end"),
        "time_precision": (lambda: rules.workday_relative_date(c("workday"), as_of())["precision"], "case id % 4 when 2 then 'timestamp' when 3 then 'unknown' else 'day' end")}),
    "parse_iso_ts": (TEXT, ("id",), {"ts": (lambda: rules.parse_iso_ts(c("workday")).cast("timestamp_ntz"), "case when workday like '2001%' then timestamp '2001-07-04 10:00:00' end")}),
    "visible_activity": (POST, WHO, {"activity": (lambda: rules.visible_activity(c("posted_at"), F.lit("day"), c("first_seen_at")).cast("timestamp_ntz"), "coalesce(date_trunc('day', posted_at), date_trunc('hour', first_seen_at))::timestamp")}),
    "market_activity": (POST, WHO, {"activity": (lambda: rules.market_activity(F.when(c("source_mode") == "direct", c("posted_at")), F.when(c("source_mode") == "registry", c("posted_at")), c("last_seen_at"), c("first_seen_at")), "coalesce(case when source_mode in ('direct', 'registry') then posted_at end, last_seen_at, first_seen_at)")}),
    "source_activity": (POST, WHO, {"activity": (lambda: rules.source_activity(c("posted_at"), c("last_seen_at")), "coalesce(posted_at, last_seen_at)")}),
    "employer_key": (POST, WHO, {"key": (lambda: text.employer_key(c("company")), digest(24, f"trim({rep('lower(company)', ('[^a-z0-9]+', ' '))})"))}),
    "observation_key": (POST, WHO, {"key": (lambda: text.hashed(28, c("source"), c("source_id"), c("company")), digest(28, "source || '|' || source_id || '|' || company"))}),
    "evidence_key": (POST, WHO, {"key": (lambda: text.hashed(28, text.employer_key(c("company")), c("source"), c("source_mode")), digest(28, f"{digest(24, f'trim({rep('lower(company)', ('[^a-z0-9]+', ' '))})')} || '|' || source || '|' || source_mode"))}),
    "evidence_type": (POST, WHO, {"kind": (lambda: rules.evidence_type(c("source_mode"), c("active"), F.lit("current")), "case source_mode when 'direct' then case when active then 'validated-source' else 'historical-direct' end when 'registry' then 'current-index' when 'external-index' then 'market-index' when 'verification' then 'employer-page' when 'verification-lead' then 'employer-page-lead' else 'other-evidence' end")}),
    "event_year": (POST, WHO, {"event_year": (lambda: rules.event_year(F.lit(None).cast("int"), c("title")), "try_cast(nullif(regexp_extract(title, '((?:19|20)\\d{2})', 1), '') as int)")}),
    "employer_probabilities": (TEXT, ("id",), {"internship": (lambda: rules.internship_probability(c("n") % 7, c("n") % 2, c("n") % 3, c("n") % 5, c("n") % 4), f"case when n % 7 > 0 then 0.999 else {PROB} end"), "technical": (lambda: rules.technical_probability(c("n") % 9), TECHP)}),
    "frontier_score": (TEXT, ("id",), {"frontier": (lambda: rules.frontier_score(F.lit(0.5), F.lit(0.25), c("n") * F.lit(10.0), c("n") % 5, c("n") % 2, c("n") % 3), "case when n % 3 > 0 then 0.0 else round(100 * (0.42 * 0.5::double + 0.30 * 0.25::double + 0.12 * exp(-(n * 10.0::double) / 730) + 0.10 * least(1.0::double, (n % 5) / 3.0::double) + 0.06 * case when n % 2 = 0 then 1.0::double else 0.15::double end), 3) end")}),
    "reason_bucket": (TEXT, ("id",), {"bucket": (lambda: text.reason_bucket(c("reason")), first_case("lower(coalesce(reason, 'unknown'))", FAILURES, "case when lower(coalesce(reason, 'unknown')) in ('', 'none', 'unknown', 'candidate', 'retry', 'rejected') then 'unclassified' else 'other' end"))}),
    "outcome_status": (TEXT, ("id",), {"status": (lambda: rules.outcome_status(F.lit(400) + c("n") % 30, c("id") % 2 == 0), "case when 400 + n % 30 in (401, 403, 429) then 'blocked' when 400 + n % 30 in (404, 410) and id % 2 = 0 then 'dormant' else 'broken' end")}),
    "normalize_result_status": ("fx_snapshots", ("source", "finished_at"), {"status": (lambda: rules.normalize_result_status(c("complete"), c("target_rows"), F.when(c("new_rows") > 0, "current").otherwise("historical"), F.lit("ok")), "case when not complete then 'truncated' when target_rows = 0 then case when new_rows > 0 then 'empty' else 'dormant' end else 'ok' end")}),
    "page_verdict_rollup": (TEXT, ("id",), {"status": (lambda: rules.page_verdict(c("n") % 3, c("n") % 2, c("n") % 5, c("n") % 4, c("n") % 7)["status"], "case when n % 7 > 0 then case when n % 3 > 0 or n % 2 > 0 or n % 5 > 0 or n % 4 > 0 then 'partial' else 'broken' end when n % 3 > 0 then case when n % 2 = 0 and n % 5 = 0 and n % 4 = 0 then 'verified' else 'partial' end when n % 5 > 0 and n % 2 = 0 and n % 4 = 0 then 'blocked' when n % 2 > 0 and n % 5 = 0 and n % 4 = 0 then 'stale' when n % 4 > 0 and n % 5 = 0 and n % 2 = 0 then 'unstructured' else 'mixed' end")}),
    "link_state": (TEXT, ("id",), {"state": (lambda: rules.link_state(F.element_at(F.array(*map(F.lit, (200, 404, 403, 500, 410, 429))), (c("n") % 6 + 1).cast("int")), c("id") % 5 == 0), "case n % 6 when 0 then case when id % 5 = 0 then 'closed' else 'active' end when 1 then 'closed' when 2 then 'protected' when 3 then 'failed' when 4 then 'closed' else 'protected' end")}),
    "stable_shard": (POST, WHO, {"shard": (lambda: text.stable_shard(c("source"), 7), "(('0x' || substr(sha256(source), 1, 16))::ubigint % 7)::int")}),
    "humanize_slug": (TEXT, ("id",), {"shown": (lambda: text.humanize_slug(F.concat_ws("-", F.lit("acme"), F.lit("labs"), c("n").cast("string"))), "'Acme Labs ' || n")}),
    "crawl_cadence": ("fx_targets", ("source",), {"every": (lambda: rules.crawl_interval(c("kind"), c("scope")), cadence(0, 3600, 86400)), "priority": (lambda: rules.crawl_priority(c("kind"), c("scope")), cadence(1, 100, 500))}),
}


def _query(name: str):
    source, ids, outs = SCALARS[name]
    return lambda spark, sf_dir: view(spark, sf_dir, source).select(*ids, *(col().alias(out) for out, (col, _) in outs.items()))


def _oracle(name: str) -> str:
    source, ids, outs = SCALARS[name]
    return f"with {source} as ({VIEWS[source]}) select {', '.join(ids)}, " + ", ".join(f"{sql} as {out}" for out, (_, sql) in outs.items()) + f" from {source}"


def queries() -> dict:
    return {k: _query(k) for k in SCALARS} | {"page_is_closed": lambda spark, sf_dir: view(spark, sf_dir, "pages").select("page_id", rules.page_is_closed(c("html")).alias("closed"))}


def oracle() -> dict[str, str]:
    visible = rep("html", ("(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " "), (r"\s+", " "))
    return {k: _oracle(k) for k in SCALARS} | {"page_is_closed": f"select page_id, regexp_matches(substr({visible}, 1, 100000), '{CLOSED}') as closed from pages"}
