"""What is due now, and what the catalog, health and readiness tables say; each by the caller's clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import TARGET_RANK, TARGETS, TECH
from ..functions import rules
from ..functions import text as tx
from .figures import percent, together

c = F.col
#: An empty board is asked again after so many of its intervals, or so many seconds, whichever is longer.
FRESH_INTERVALS, FRESH_SECONDS = 3, 5400
#: Smallest inventory that counts as whole.
FLOORS = {"active_listings": 100, "companies": 20, "validated_sources": 25}


def later(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + seconds.cast("long") * 1_000_000)


def unleased(lease: str, as_of: Column) -> Column:
    return c(lease).isNull() | (c(lease) < as_of)


def due_sources(targets: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Scheduled targets whose time has come and that nobody works on: those never completed first, then the longest ago."""
    due = targets.filter(c("scheduled") & c("enabled") & (c("next_run_at") <= as_of) & unleased("lease_expires_at", as_of))
    order = (c("last_complete_at").isNotNull(), "last_complete_at", F.asc_nulls_first("last_started_at"), "next_run_at", "priority", "source")
    return due.orderBy(*order).limit(n)


def due_candidates(queue: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Candidates to probe: current ones first, then by evidence."""
    due = queue.filter(c("status").isin("candidate", "retry") & (c("next_run_at") <= as_of) & unleased("leased_until", as_of))
    return due.orderBy(c("scope") != "current", F.desc("evidence_count"), "next_run_at", "source").limit(n)


def due_observations(seen: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Observed employers to resolve: those with a site of their own first, then by signals, failures and age."""
    due = seen.filter(c("probe_status").isin("candidate", "retry", "unresolved") & (c("next_probe_at") <= as_of) & unleased("lease_expires_at", as_of))
    return due.orderBy(c("official_url").isNull(), F.desc("technical_signal"), F.desc("internship_signal"), "consecutive_failures", F.desc("last_seen_at"), "key").limit(n)


def links_to_check(postings: DataFrame, n: int) -> DataFrame:
    """(canonical_apply_url, last_checked) of direct targets: links never checked first, then the longest ago."""
    own = postings.filter(c("active") & (c("source_mode") == "direct") & c("target_match").isin(*TARGETS))
    return own.groupBy("canonical_apply_url").agg(F.min("link_checked_at").alias("last_checked")).orderBy(c("last_checked").isNotNull(), "last_checked", "canonical_apply_url").limit(n)


def requeued(targets: DataFrame, catalog: DataFrame, as_of: Column) -> DataFrame:
    """Adds `due_at`: validated current boards that were empty, and that wait longer than their interval, come at it, or now if they are stale."""
    known = catalog.filter(c("validated") & (c("scope") == "current")).select("source").distinct().withColumn("known", F.lit(True))
    met = targets.join(known, "source", "left")
    wait = later(as_of, c("interval_seconds"))
    held = c("known") & c("enabled") & c("scheduled") & (c("last_status") == "empty") & (c("next_run_at") > wait)
    stale = c("last_complete_at").isNull() | (later(c("last_complete_at"), F.greatest(c("interval_seconds") * FRESH_INTERVALS, F.lit(FRESH_SECONDS))) < as_of)
    due = F.when(stale, as_of.cast("timestamp")).otherwise(F.least(c("next_run_at").cast("timestamp"), wait))
    return met.withColumn("due_at", F.when(F.coalesce(held, F.lit(False)), due).otherwise(c("next_run_at").cast("timestamp"))).drop("known")


def productive(health: DataFrame, postings: DataFrame) -> DataFrame:
    """(source, mode, last_attempt_at) of searches with an active direct target, and of verifications and domains with a verified one."""
    live = postings.filter(c("active") & c("target_match").isin(*TARGETS))
    asks = F.when(c("mode") == "board-search", "direct").when(c("mode").isin("verification", "domain"), "verification")
    return health.withColumn("asks", asks).join(live.select("source", c("source_mode").alias("asks")), ["source", "asks"], "left_semi").select("source", "mode", "last_attempt_at")


def refresh_selection(catalog: DataFrame, health: DataFrame, postings: DataFrame, searches: int) -> DataFrame:
    """(source, mode) of the current catalog that a refresh reads.

    Boards all; verifications and domains that are productive; of searches the productive ones, the longest not
    tried first, filled up to `searches` with those that were never tried.
    """
    current, good = catalog.filter(c("scope") == "current"), productive(health, postings)
    tried = good.filter(c("mode") == "board-search").select("source", F.lit(0).alias("turn"), "last_attempt_at")
    new = current.filter(c("mode") == "board-search").join(health.filter(c("mode") == "board-search"), "source", "left_anti").select("source", F.lit(1).alias("turn"), F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"))
    chosen = tried.unionByName(new).orderBy("turn", F.asc_nulls_first("last_attempt_at"), "source").limit(searches).select("source")
    by = lambda mode, rows: current.filter(c("mode") == mode).join(rows.select("source"), "source", "left_semi")
    found = current.filter(~c("mode").isin("board-search", "verification", "domain")).unionByName(by("board-search", chosen))
    for mode in ("verification", "domain"):
        found = found.unionByName(by(mode, good.filter(c("mode") == mode)))
    return found.select("source", "mode").distinct()


def source_diagnostics(targets: DataFrame, health: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a target or health row, with its catalog entry."""
    t, h, k = targets.alias("t"), health.alias("h"), catalog.alias("k")
    both = t.join(h, c("t.source") == c("h.source"), "full").withColumn("of", F.coalesce("t.source", "h.source"))
    met = both.join(k, c("k.source") == c("of"), "left")
    return met.select(
        c("of").alias("source"), "h.complete", "h.rows_scanned", "h.target_rows", "h.last_attempt_at", "h.status", F.coalesce("h.scope", "k.scope").alias("scope"), "h.lifecycle", "h.consecutive_failures", c("k.kind").alias("catalog_kind"), "t.enabled", "t.interval_seconds",
        "t.last_complete_at", c("t.last_status").alias("crawl_status"), c("t.last_rows").alias("crawl_rows"), c("t.consecutive_failures").alias("crawl_failures"),
    )


def current_market(postings: DataFrame, as_of: Column) -> DataFrame:
    """Internships in technical categories whose year, if they have one, is not over."""
    return postings.filter((c("target_match") != "not_internship") & c("category").isin(*TECH) & (c("year").isNull() | (c("year") >= F.year(as_of))))


def with_sensor_cycles(direct: DataFrame, sensors: DataFrame) -> DataFrame:
    """Direct postings of unknown cycle take year, season, match, and a missing category, from the best sensor row of their link.

    The best has the highest match, then the newest market event (when it was posted, else first seen), then the least key.
    """
    rank = F.coalesce(*(F.when(c("target_match") == m, r) for m, r in TARGET_RANK.items()))
    event = F.coalesce(c("posted_at").cast("timestamp_ntz"), c("first_seen_at").cast("timestamp_ntz"))
    lead = F.struct(F.coalesce("year", F.lit(2027)).alias("year"), F.coalesce("season", F.lit("summer")).alias("season"), "target_match", "category")
    best = sensors.filter(c("target_match").isin(*TARGETS)).select("canonical_apply_url", "posting_key", lead.alias("lead"), rank.alias("rank"), F.unix_micros(event.cast("timestamp")).alias("event"))
    best = best.groupBy("canonical_apply_url").agg(F.min_by("lead", F.struct(-c("rank"), -c("event"), "posting_key")).alias("lead"))
    met = direct.join(best, "canonical_apply_url", "left")
    takes = (c("target_match") == "unknown") & c("lead").isNotNull()
    pick = lambda x: F.when(takes, c(f"lead.{x}")).otherwise(c(x))
    bare = F.coalesce("category", F.lit("")).isin("", "other")
    return met.withColumns({"year": pick("year"), "season": pick("season"), "category": F.when(takes & bare, c("lead.category")).otherwise(c("category")), "target_match": pick("target_match")}).drop("lead")


def readiness(observed: DataFrame) -> DataFrame:
    """One row of observed figures against FLOORS: deficits, state, and the least of the ratios in percent."""
    short = {k: F.greatest(F.lit(0), F.lit(v) - c(k)).cast("long") for k, v in FLOORS.items()}
    ratio = F.least(*(F.least(F.lit(1.0), c(k) / v) for k, v in FLOORS.items()))
    whole = F.greatest(*short.values()) == 0
    return observed.select(*FLOORS, *(v.alias(f"{k}_deficit") for k, v in short.items()), whole.alias("complete"), F.when(whole, "ready").otherwise("recovering").alias("state"), F.round(100 * ratio, 1).alias("completion_percent"))


def inventory_counts(families: DataFrame, catalog: DataFrame) -> DataFrame:
    """(active_families, active_listings, companies, validated_sources), one row."""
    job = c("target_match") != "not_internship"
    own = families.filter(job & (c("direct_openings") > 0))
    # Companies are counted apart, so the other figures need no expanded rows.
    firms = own.select("company").distinct().agg(F.count("company").alias("companies"))
    figures = families.agg(F.count_if(job & (c("direct_openings") > 0)).alias("active_families"), F.coalesce(F.sum(F.when(job, c("direct_openings"))), F.lit(0)).cast("long").alias("active_listings"))
    return together(figures, firms, catalog.agg(F.count_if("validated").alias("validated_sources")))


def bootstrap_readiness(families: DataFrame, catalog: DataFrame) -> DataFrame:
    counts = inventory_counts(families, catalog)
    return counts.withColumn("ready", (c("active_listings") >= FLOORS["active_listings"]) & (c("companies") >= FLOORS["companies"]) & (c("validated_sources") >= FLOORS["validated_sources"]))


def provider_rollup(providers: DataFrame) -> DataFrame:
    """Providers' counts with the total (total = 1, kind null) in one grouping; a provider without a kind stays its own."""
    counts = ("total", "never_completed", "overdue", "degraded", "due")
    rows = providers.rollup("kind").agg(*(F.sum(k).cast("long").alias(k) for k in counts), F.count("*").alias("provider_count"), F.grouping("kind").cast("int").alias("is_total"))
    unhealthy = F.greatest(c("never_completed"), c("overdue"), c("degraded")) > 0
    return rows.withColumns({"ok": ~unhealthy, "due_percent": percent(c("due"), c("total"))})


def market_summary(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: postings, targets, exact ones, candidate sources, and how many of each kind."""
    seen = postings.agg(F.count("*").alias("postings"), F.count_if(c("target_match").isin(*TARGETS)).alias("targets"), F.count_if(c("target_match") == "exact").alias("exact"))
    kinds = candidates.groupBy("kind").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", c("n").cast("string")))), "|").alias("candidate_kinds"))
    return together(seen, kinds)


def catalog_upsert(catalog: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """The catalog after new findings, one row a source: scope stays current, validated stays true, an origin gives way to a validated one alone."""
    o, n = catalog.alias("o"), found.alias("n")
    new = c("n.source").isNotNull()
    met = o.join(n, c("o.source") == c("n.source"), "full")
    return met.select(
        F.coalesce("n.source", "o.source").alias("source"), F.coalesce("n.kind", "o.kind").alias("kind"), F.when(c("o.scope") == "current", "current").otherwise(F.coalesce("n.scope", "o.scope")).alias("scope"), (F.coalesce("o.validated", F.lit(False)) | F.coalesce("n.validated", F.lit(False))).alias("validated"),
        F.when(c("o.source").isNull() | F.coalesce("n.validated", F.lit(False)), c("n.origin")).otherwise(c("o.origin")).alias("origin"), F.when(new, as_of).otherwise(c("o.last_discovered_at")).alias("last_discovered_at"),
    )


def merged_catalog(*lists: DataFrame) -> DataFrame:
    """One row a canonical source name: the first list that names it, then current before historical."""
    every = None
    for turn, rows in enumerate(lists):
        one = rows.select("source", "kind", "scope", F.lit(turn).alias("turn"), tx.canonical_source_name(c("source")).alias("name"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("name").agg(F.min_by(F.struct("source", "kind", "scope"), F.struct("turn", c("scope") != "current", "source")).alias("r")).select("r.*", "name")


def net_new(census: DataFrame, catalog: DataFrame, queue: DataFrame) -> DataFrame:
    """Sources of a census that no validated catalog entry and no queue knows."""
    known = catalog.filter("validated").select("source").unionByName(queue.select("source"))
    return census.join(known, "source", "left_anti").select("source", "kind").distinct()


def bootstrap_validated(catalog: DataFrame, runs: DataFrame, postings: DataFrame) -> DataFrame:
    """The catalog, validated also where a complete run went well or a direct posting stands."""
    fine = runs.filter(c("complete") & c("error").isNull() & c("status").isin("ok", "empty")).select("source")
    proof = fine.unionByName(postings.filter(c("source_mode") == "direct").select("source")).distinct().withColumn("proved", F.lit(True))
    return catalog.join(proof, "source", "left").select("source", (c("validated") | c("proved").isNotNull()).alias("validated"))


def display_titles(applications: DataFrame) -> DataFrame:
    """(family_key, title): a family's shortest cleaned title."""
    rows = applications.select("family_key", tx.clean_text(c("title")).alias("title"))
    return rows.groupBy("family_key").agg(F.min_by("title", F.struct(F.length("title"), "title")).alias("title"))


def employer_evidence(postings: DataFrame, scope: str = "current") -> DataFrame:
    """Postings of an employer by kind of evidence, source and year."""
    rows = postings.withColumns({"employer": tx.employer_key(c("company")), "evidence": rules.evidence_type(c("source_mode"), c("active"), F.lit(scope))})
    return rows.groupBy("employer", "evidence", "source", "year").agg(F.count("*").alias("roles"), F.count_if("active").alias("active_roles"), F.min("first_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.min("canonical_apply_url").alias("sample_url"))


def recent_rejected(queue: DataFrame, n: int) -> DataFrame:
    """The candidates that were rejected last."""
    return queue.filter(c("status") == "rejected").orderBy(F.desc("next_run_at"), "source").limit(n)


def previous_first_seen(snapshot: DataFrame) -> DataFrame:
    """(canonical_apply_url, first_seen_at) of a snapshot's openings: the earliest a link was ever seen."""
    each = snapshot.select(F.explode("openings").alias("o"))
    return each.groupBy(c("o.canonical_apply_url").alias("canonical_apply_url")).agg(F.min("o.first_seen_at").alias("first_seen_at"))


def seeds(snapshot: DataFrame) -> DataFrame:
    """(canonical_apply_url, identity) of a snapshot's verified openings: the one seen last for each link."""
    each = snapshot.select(F.explode("openings").alias("o")).filter(c("o.source_mode").isin("direct", "verification"))
    return each.groupBy(c("o.canonical_apply_url").alias("canonical_apply_url")).agg(F.max_by("o.identity", F.struct("o.last_seen_at", "o.identity")).alias("identity"))


def promoted(families: DataFrame) -> DataFrame:
    """Families whose openings verified on the employer's page count as the employer's own, with both kinds of openings counted anew.

    Other openings stay as they are, with the mark of an earlier promotion; a family whose openings are null has none.
    """
    kind = families.schema["openings"].dataType
    marked = "verification_mode" in kind.elementType.names
    seen = lambda o: o["source_mode"] == "verification"
    mark = lambda o: F.when(seen(o), "employer-page").otherwise(o["verification_mode"] if marked else F.lit(None))
    mode = lambda o: F.when(seen(o), "direct").otherwise(o["source_mode"])
    openings = F.transform(F.coalesce("openings", F.array().cast(kind)), lambda o: o.withField("verification_mode", mark(o)).withField("source_mode", mode(o)))
    own = F.size(F.filter("openings", lambda o: o["source_mode"] == "direct")).cast("long")
    return families.withColumn("openings", openings).withColumn("direct_openings", own).withColumn("backstop_openings", F.size("openings") - c("direct_openings"))


def activity(postings: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """(discovered, removed): links of the employers' own 2027 jobs that came or went within the hours."""
    own = postings.filter((c("source_mode") == "direct") & (c("year") == 2027) & c("category").isin(*TECH))
    since = later(as_of, F.lit(-3600 * hours))
    links = own.groupBy("canonical_apply_url").agg(F.bool_or(c("first_seen_at") >= since).alias("came"), F.bool_or(~c("active") & (c("removed_at") >= since)).alias("went"))
    return links.agg(F.count_if("came").alias("discovered"), F.count_if("went").alias("removed"))


def verified_window(families: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """(families, openings, new_families) of those with the employer's own openings."""
    own = families.filter("direct_openings > 0")
    return own.agg(F.count("*").alias("families"), F.coalesce(F.sum("direct_openings"), F.lit(0)).cast("long").alias("openings"), F.count_if(c("first_detected_at") >= later(as_of, F.lit(-3600 * hours))).alias("new_families"))


def sensor_recall(sensors: DataFrame, feed: DataFrame) -> DataFrame:
    """One row: how many of the sensors' links the feed holds, and whether it is as new as they are."""
    asked = sensors.groupBy("canonical_apply_url").agg(F.max("first_seen_at").alias("sensor_at"))
    held = feed.groupBy("canonical_apply_url").agg(F.max("first_seen_at").alias("feed_at"))
    row = asked.join(held, "canonical_apply_url", "left").agg(F.count("*").alias("expected"), F.count("feed_at").alias("published"), F.max("sensor_at").alias("newest_sensor"), F.max("feed_at").alias("newest_published"))
    fresh = c("newest_sensor").isNull() | F.coalesce(c("newest_published") >= c("newest_sensor"), F.lit(False))
    return row.withColumns({"recall": F.when(c("expected") == 0, 1.0).otherwise(F.round(c("published") / c("expected"), 4)), "current": fresh})


def places_of(postings: DataFrame) -> DataFrame:
    """(company, places): a company's places, once each, in order; they combine before the shuffle."""
    return postings.select("company", F.explode_outer("locations").alias("place")).groupBy("company").agg(F.array_join(F.array_sort(F.collect_set("place")), "|").alias("places"))
