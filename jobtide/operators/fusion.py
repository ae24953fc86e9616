"""Observations fused to openings and families; employers from all evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMPLOYER_DATE_MODES, TARGET_RANK
from ..functions import rules
from ..functions import text as tx
from ..functions import urls as ux

c = F.col


def match_rank(column: str = "target_match") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in TARGET_RANK.items() for x in (k, v))), c(column)), F.lit(-2))


def is_employer(column: str = "source_mode") -> Column:
    return c(column).isin(*EMPLOYER_DATE_MODES)


def fuse_openings(observations: DataFrame) -> DataFrame:
    """One opening a link: the best posting (the employer's first), the newest dates of each kind, all evidence.

    Evidence is one entry a (source, mode), the newest; copies combine before they are gathered.
    """
    event = F.coalesce("posted_at", "first_seen_at")
    best = F.struct(F.when(is_employer(), 1).otherwise(0).alias("pool"), match_rank().alias("rank"), event.alias("event"), c("last_seen_at").alias("seen"))
    row = F.struct("posting_key", "company", "title", "category", "family_key", "target_match", F.array_join("locations", "|").alias("locations"))
    one = observations.select("canonical_apply_url", "source", "source_mode", "posted_at", "first_seen_at", "last_seen_at", "posting_key", best.alias("best"), row.alias("row"), event.alias("event"))
    first = F.struct(-c("best.pool"), -c("best.rank"), -F.unix_micros(c("best.event").cast("timestamp")), -F.unix_micros(c("best.seen").cast("timestamp")), "posting_key")
    said = one.groupBy("canonical_apply_url", "source", "source_mode").agg(
        F.min_by("row", first).alias("row"), F.min(first).alias("first"), F.max("posted_at").alias("posted_at"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("event").alias("event"),
    )
    of = lambda x, ok: F.max(F.when(ok, c(x)))
    fused = said.groupBy("canonical_apply_url").agg(
        F.min_by("row", "first").alias("row"), of("posted_at", is_employer()).alias("posted_at"), of("posted_at", ~is_employer()).alias("sensor_at"), F.min("first_seen_at").alias("first_seen_at"), of("last_seen_at", is_employer()).alias("verified_at"),
        F.bool_or(is_employer()).alias("direct"), F.count("*").alias("evidence_count"), F.array_sort(F.collect_list(F.struct((-F.unix_micros(c("event").cast("timestamp"))).alias("at"), "source", "source_mode"))).alias("evidence"), F.sort_array(F.collect_set(F.when(~is_employer(), c("source")))).alias("sensors"),
    )
    kind = F.when(c("posted_at").isNotNull(), "employer-posted").when(c("sensor_at").isNotNull(), "sensor-reported").otherwise("first-seen")
    return fused.select("canonical_apply_url", "row.*", "posted_at", "sensor_at", "first_seen_at", "verified_at", "direct", "evidence_count", "evidence", "sensors", kind.alias("event_kind"), F.when(kind == "first-seen", "hour").otherwise("day").alias("event_precision"), F.coalesce("posted_at", "sensor_at", "first_seen_at").alias("market_event_at"))


def fuse_families(openings: DataFrame) -> DataFrame:
    """One family a key: its strongest opening speaks for it, the newest event dates it."""
    first = F.struct(F.when(c("direct"), 0).otherwise(1), -match_rank(), -F.unix_micros(c("market_event_at").cast("timestamp")), "canonical_apply_url")
    said = F.struct("company", "title", "category", "target_match", c("canonical_apply_url").alias("strongest"))
    fused = openings.groupBy("family_key").agg(
        F.min_by(said, first).alias("row"), F.count("*").alias("opening_count"), F.count_if("direct").alias("direct_openings"), F.count_if(~c("direct")).alias("backstop_openings"), F.bool_or("direct").alias("verified"), F.max("market_event_at").alias("market_event_at"), F.max("posted_at").alias("latest_posted_at"), F.max("sensor_at").alias("latest_sensor_at"),
        F.min("first_seen_at").alias("first_detected_at"), F.max("verified_at").alias("last_verified_at"), F.sum("evidence_count").alias("evidence_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sensors")))).alias("sensors"), F.bool_or(F.contains(F.lower("locations"), F.lit("remote"))).alias("remote"),
    )
    return fused.select("family_key", "row.*", *(x for x in fused.columns if x not in ("family_key", "row")))


def rebuilt_families(families: DataFrame, openings: DataFrame) -> DataFrame:
    """Family fields computed anew from its openings, of which the last one written a link counts."""
    last = openings.groupBy("family_key", "canonical_apply_url").agg(F.max_by(F.struct("source_mode", "posted_at", "first_seen_at", "last_seen_at", "locations"), F.struct("last_seen_at", "posting_key")).alias("o")).select("family_key", "o.*")
    fields = last.groupBy("family_key").agg(
        F.count("*").alias("opening_count"), F.count_if(is_employer()).alias("direct_openings"), F.count_if(~is_employer()).alias("backstop_openings"), F.max(F.when(is_employer(), c("posted_at"))).alias("latest_posted_at"), F.min(F.when(is_employer(), c("posted_at"))).alias("first_posted_at"), F.min("first_seen_at").alias("first_detected_at"), F.max("last_seen_at").alias("last_verified_at"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("locations")))), "|").alias("locations"),
    )
    return families.select(c("family_key").alias("of"), "company", "title", "category").join(fields, c("of") == c("family_key")).drop("of").withColumn("posted_precision", F.when(c("latest_posted_at").isNull(), "unknown").otherwise("day"))


def employer_universe(postings: DataFrame, technical: Column, as_of: Column) -> DataFrame:
    """One row an employer: names, evidence, years and counts; probabilities, status, score and blind spot from them."""
    mode = lambda m: c("source_mode") == m
    intern = c("target_match") != "not_internship"
    kind = rules.evidence_type(c("source_mode"), c("active"), F.lit("current"))
    own = postings.groupBy(tx.employer_key(c("company")).alias("employer_key")).agg(
        F.min("company").alias("name"), F.array_sort(F.collect_set("company")).alias("aliases"), F.array_sort(F.collect_set(kind)).alias("evidence_types"), F.array_sort(F.collect_set("source")).alias("evidence_sources"), F.countDistinct("source").alias("sources"), F.count("*").alias("roles"),
        F.array_sort(F.collect_set(F.when(~c("active"), rules.event_year(c("year"), c("title"))))).alias("historical_years"), F.count_if(~c("active") & intern).alias("historical_internships"), F.count_if(mode("registry") | mode("external-index")).alias("index_mentions"), F.count_if(mode("direct") & c("active") & intern).alias("direct_openings"),
        F.countDistinct(F.when(mode("direct"), c("source"))).alias("direct_sources"), F.count_if(mode("verification") & intern).alias("pages"), F.count_if(technical).alias("technical_roles"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    own = own.withColumns({"internship_probability": rules.internship_probability(c("direct_openings"), c("index_mentions"), c("pages"), c("historical_internships"), c("sources")), "technical_probability": rules.technical_probability(c("technical_roles")), "status": F.when(c("direct_openings") > 0, "enumerated").when(c("direct_sources") > 0, "located").when(c("index_mentions") > 0, "indexed").otherwise("unresolved")})
    age = F.timestamp_diff("SECOND", c("last_seen_at"), as_of) / 86400
    own = own.withColumn("frontier_score", rules.frontier_score(c("internship_probability"), c("technical_probability"), age, c("historical_internships"), c("index_mentions"), c("direct_openings")))
    return own.withColumn("blind_spot", (c("index_mentions") == 0) & (c("direct_openings") == 0) & (c("technical_probability") >= 0.5))


def ecosystem(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(employers, evidence) from raw observations: maxima and counts a name; the latest link a (name, source)."""
    employers = observations.groupBy("employer").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("source")).alias("evidence_sources"), F.max("signal").alias("internship_probability"), F.bool_or(c("location").isNotNull()).alias("located"), F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))
    evidence = observations.groupBy("employer", "source").agg(F.count("*").alias("n"), F.max_by("link", F.struct("observed_at", "link")).alias("link"), F.max("observed_at").alias("last_seen_at"))
    return employers, evidence


def merged_universe(universe: DataFrame, found: DataFrame) -> DataFrame:
    """Found employers over the known ones, of which those that are enumerated stay as they are."""
    both = universe.alias("u").join(found.alias("e"), c("u.employer") == c("e.employer"), "full_outer")
    stays, empty = c("u.status") == "enumerated", F.array().cast("array<string>")
    new = c("u.employer").isNull()
    keep = lambda x, merged: F.when(F.coalesce(stays, F.lit(False)), c(f"u.{x}")).otherwise(merged).alias(x)
    united = lambda x: keep(x, F.array_sort(F.array_union(F.coalesce(f"u.{x}", empty), F.coalesce(f"e.{x}", empty))))
    return both.select(
        F.coalesce("u.employer", "e.employer").alias("employer"), united("aliases"), united("evidence_sources"), keep("evidence_count", F.coalesce("u.evidence_count", F.lit(0)) + F.coalesce("e.evidence_count", F.lit(0))),
        keep("internship_probability", F.greatest("u.internship_probability", "e.internship_probability")), F.when(new, F.when(c("e.located"), "located").otherwise("unresolved")).when(~stays & c("e.located"), "located").otherwise(c("u.status")).alias("status"),
        keep("first_seen_at", F.least("u.first_seen_at", "e.first_seen_at")), keep("last_seen_at", F.greatest("u.last_seen_at", "e.last_seen_at")),
    )


def universe_summary(universe: DataFrame) -> DataFrame:
    done = c("status").isin("enumerated", "located")
    row = universe.agg(F.count("*").alias("known_employers"), *(F.count_if(c("status") == s).alias(f"{s}_employers") for s in ("enumerated", "located", "indexed", "unresolved")), F.count_if("blind_spot").alias("blind_spots"), F.count_if(done).alias("resolved"), F.coalesce(F.sum("technical_roles"), F.lit(0)).alias("technical_roles"))
    return row.withColumn("resolution_percent", F.when(c("known_employers") > 0, F.round(100 * c("resolved") / c("known_employers"), 1)).otherwise(0.0))


def frontier(universe: DataFrame, n: int) -> DataFrame:
    """The employers to look for next."""
    return universe.filter(~c("status").isin("enumerated")).orderBy(c("frontier_score").desc(), "employer_key").limit(n).select("employer_key", "name", "frontier_score")


def company_votes(postings: DataFrame) -> DataFrame:
    """(host, company): by active votes, votes, the shorter name, the name."""
    votes = postings.groupBy(ux.host(c("canonical_apply_url")).alias("host"), "company").agg(F.count("*").alias("n"), F.count_if("active").alias("n_current"))
    return votes.groupBy("host").agg(F.min_by("company", F.struct(-c("n_current"), -c("n"), F.length("company"), "company")).alias("company"), F.sum("n").alias("votes"))


def tenants(postings: DataFrame) -> DataFrame:
    """(kind, tenant, scope): each board that postings' links belong to; current if any of them is active."""
    named = postings.select(ux.provider_tenant(c("url")).alias("t"), "active").filter("t.kind is not null and t.key <> ''")
    return named.groupBy(c("t.kind").alias("kind"), c("t.key").alias("tenant")).agg(F.when(F.bool_or("active"), "current").otherwise("historical").alias("scope"), F.count("*").alias("n"))
