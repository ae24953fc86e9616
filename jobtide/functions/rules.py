"""Column functions for dates, statuses, scores and cadences; `as_of` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CADENCE, CLOSED


def parse_iso_ts(col: Column) -> Column:
    """Z and offsets accepted; naive values are UTC; null if it is no date. A time alone is none: Spark would take today's."""
    return F.when(F.trim(col).rlike(r"^[+-]?\d{4}"), F.try_to_timestamp(F.regexp_replace(F.trim(col), "Z$", "+00:00")))


def parse_date(col: Column) -> Column:
    """Epoch seconds or milliseconds, ISO, or a few written forms."""
    n = col.try_cast("double")
    seconds = F.when(n > 1e10, n / 1000).otherwise(n)
    written = (F.try_to_timestamp(col, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy"))
    return F.coalesce(F.when(n.isNotNull(), F.timestamp_seconds(seconds)), parse_iso_ts(col), *written)


def parse_sensor_time(col: Column, as_of: Column) -> Column:
    """struct(ts, precision) of a tracker's time text."""
    v = F.trim(F.coalesce(col, F.lit("")))
    low = F.lower(v)
    n = F.when(v.rlike(r"^\d{10,13}$"), v.cast("double"))
    epoch = F.when(n > 1e10, n / 1000).otherwise(n)
    age = r"(?i)(?<!\d)(\d+)\s*(m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|week|weeks)(?:\s+ago)?\b"
    count, unit = F.regexp_extract(v, age, 1).try_cast("int"), F.substring(F.lower(F.regexp_extract(v, age, 2)), 1, 1)
    back = lambda **k: as_of - F.make_dt_interval(**k)
    zero = F.lit(0)
    pair = lambda ts, p: F.struct(ts.alias("ts"), p.alias("precision"))
    none = pair(F.lit(None).cast("timestamp"), F.lit("unknown"))
    parsed = parse_date(v)
    return (
        F.when(low.isin("", "-", "—", "n/a", "na", "unknown", "none"), none)
        .when(epoch.between(946684800, 4102444800), pair(F.timestamp_seconds(epoch), F.lit("timestamp")))
        .when(low.isin("today", "new", "just now"), pair(as_of, F.lit("day")))
        .when(low == "yesterday", pair(as_of - F.expr("interval 1 day"), F.lit("day")))
        .when(unit == "m", pair(back(days=zero, hours=zero, mins=count), F.lit("relative")))
        .when(unit == "h", pair(back(days=zero, hours=count), F.lit("relative")))
        .when(unit == "d", pair(back(days=count), F.lit("day")))
        .when(unit == "w", pair(back(days=count * 7), F.lit("day")))
        .when(parsed.isNotNull(), pair(parsed, F.when(v.rlike(r"\d:\d|T\d"), "timestamp").otherwise("date")))
        .otherwise(none)
    )


def workday_relative_date(col: Column, as_of: Column) -> Column:
    """struct(ts, precision) of 'Posted Today', 'Posted 30+ Days Ago' or an ISO time."""
    days = F.regexp_extract(col, r"(?i)(\d+)\+?\s+Day", 1).try_cast("int")
    iso = F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), parse_iso_ts(col))
    pair = lambda ts, p: F.struct(ts.alias("ts"), F.lit(p).alias("precision"))
    return F.when(col.rlike(r"(?i)\bToday\b"), pair(as_of, "day")).when(days.isNotNull(), pair(as_of - F.make_dt_interval(days=days), "day")).when(iso.isNotNull(), pair(iso, "timestamp")).otherwise(pair(F.lit(None).cast("timestamp"), "unknown"))


def visible_activity(posted: Column, precision: Column, detected: Column) -> Column:
    """The employer's date, to the day unless exact; else the detection time to the hour."""
    return F.when(posted.isNull(), F.date_trunc("hour", detected)).when(precision == "timestamp", posted).otherwise(F.date_trunc("day", posted))


def market_activity(event: Column, posted: Column, sensor: Column, first_seen: Column) -> Column:
    return F.coalesce(event, posted, sensor, first_seen)


def source_activity(posted: Column, sensor: Column) -> Column:
    return F.coalesce(posted, sensor)


def evidence_type(mode: Column, validated: Column, scope: Column) -> Column:
    named = F.create_map(*(F.lit(x) for x in ("registry", "current-index", "external-index", "market-index", "universe-seed", "historical-internship", "verification", "employer-page", "verification-lead", "employer-page-lead")))
    return F.when(mode == "direct", F.when(F.coalesce(validated, F.lit(False)) & F.coalesce(scope == "current", F.lit(False)), "validated-source").otherwise("historical-direct")).otherwise(F.coalesce(F.try_element_at(named, mode), F.lit("other-evidence")))


def event_year(year: Column, source: Column) -> Column:
    return F.coalesce(year, F.regexp_extract(source, r"((?:19|20)\d{2})", 1).try_cast("int"))


def internship_probability(direct: Column, registry: Column, verification: Column, historical: Column, market: Column) -> Column:
    upto = lambda c, n: F.least(F.lit(n), c)
    score = F.lit(0.18).cast("double") + 0.52 * upto(registry, 1) + 0.38 * upto(verification, 1) + 0.20 * upto(historical, 3) + 0.12 * upto(market, 2)
    return F.when(direct > 0, 0.999).otherwise(F.round(F.least(F.lit(0.985), score), 4))


def technical_probability(roles: Column) -> Column:
    return F.when(roles == 0, 0.08).otherwise(F.round(F.least(F.lit(0.995), 0.38 + 0.24 * F.log1p(roles.cast("double"))), 4))


def frontier_score(internship: Column, technical: Column, age_days: Column, historical: Column, registry: Column, direct: Column) -> Column:
    score = 100 * (0.42 * internship + 0.30 * technical + 0.12 * F.exp(-F.greatest(F.lit(0.0), age_days) / 730) + 0.10 * F.least(F.lit(1.0), historical / 3.0) + 0.06 * F.when(registry == 0, 1.0).otherwise(0.15))
    return F.when(direct > 0, 0.0).otherwise(F.round(score, 3))


def outcome_status(http_status: Column, enumerates: Column) -> Column:
    return F.when(http_status.isin(401, 403, 429), "blocked").when(http_status.isin(404, 410) & enumerates, "dormant").otherwise("broken")


def normalize_result_status(complete: Column, rows: Column, scope: Column, status: Column) -> Column:
    return F.when(~complete & (status == "ok"), "truncated").when(complete & (rows == 0), F.when(scope == "historical", "dormant").otherwise("empty")).otherwise(status)


def page_verdict(verified: Column, stale: Column, blocked: Column, unstructured: Column, errors: Column) -> Column:
    """struct(status, note) from a run's counts."""
    some, nothing_else = (lambda c: c > 0), (stale == 0) & (blocked == 0) & (unstructured == 0)
    status = (
        F.when(some(errors), F.when(some(verified) | ~nothing_else, "partial").otherwise("broken"))
        .when(some(verified), F.when(nothing_else, "verified").otherwise("partial"))
        .when(some(blocked) & (stale == 0) & (unstructured == 0), "blocked").when(some(stale) & (blocked == 0) & (unstructured == 0), "stale").when(some(unstructured) & (blocked == 0) & (stale == 0), "unstructured").otherwise("mixed")
    )
    said = lambda c, one, more="": F.when(some(c), F.concat(c.cast("string"), F.lit(" " + one), F.when(c != 1, "s").otherwise(""), F.lit(more)))
    note = F.concat_ws("; ", said(stale, "stale/closed page"), said(blocked, "access-blocked page"), said(unstructured, "reachable page", " without sufficient job evidence"), said(errors, "transport/server failure"))
    return F.struct(status.alias("status"), F.when(note != "", note).alias("note"))


def link_state(http_status: Column, closed: Column) -> Column:
    return F.when(http_status.isin(404, 410) | (http_status == 200) & closed, "closed").when(http_status == 200, "active").when(http_status.isin(401, 403, 406, 429), "protected").otherwise("failed")


def page_is_closed(html: Column) -> Column:
    """A closing phrase among the first 100,000 visible characters."""
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", " "), r"\s+", " ")
    return F.substring(visible, 1, 100000).rlike(CLOSED)


def crawl_interval(kind: Column, scope: Column) -> Column:
    by_kind = F.create_map(*(F.lit(x) for k, (seconds, _) in CADENCE.items() for x in (k, seconds)))
    return F.when(scope == "historical", 86400).otherwise(F.coalesce(F.try_element_at(by_kind, kind), F.lit(3600)))


def crawl_priority(kind: Column, scope: Column) -> Column:
    by_kind = F.create_map(*(F.lit(x) for k, (_, priority) in CADENCE.items() for x in (k, priority)))
    return F.when(scope == "historical", 500).otherwise(F.coalesce(F.try_element_at(by_kind, kind), F.lit(100)))


def retry_delay(failures: Column, interval: Column, status: Column) -> Column:
    """Seconds until a source is due again."""
    base = F.least(F.lit(21600), F.greatest(F.lit(300), interval) * F.pow(F.lit(2), F.least(failures, F.lit(5))).cast("long"))
    return F.when(status == "partial", F.greatest(F.lit(600), interval)).when(status == "empty", F.greatest(F.lit(21600), interval)).when(failures > 0, base).otherwise(interval).cast("long")
