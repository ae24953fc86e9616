"""Normalise and classify postings: one projection of column functions, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INTERN, PROGRAM, SEASONS, SUMMER_2027, TARGETS, YEAR
from ..functions import text as tx
from ..functions import urls as ux
from ..sources.shared import written


def hit(col: Column, pattern: str) -> Column:
    return col.rlike("(?i)" + pattern)


def internship_evidence(title: Column, kind: Column, description: Column) -> Column:
    """`description` counts only as far as the caller has blanked it for indirect modes."""
    return hit(title, INTERN) | hit(title, PROGRAM) | hit(kind, INTERN) | hit(description, INTERN)


def cycle(title: Column, description: Column) -> tuple[Column, Column, Column]:
    """(years of evidence, year, season)."""
    own = F.array_distinct(F.regexp_extract_all(title, F.lit(YEAR), F.lit(0)))
    years = F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.regexp_extract_all(description, F.lit(YEAR), F.lit(0))))
    year = F.when(F.array_contains(years, "2027"), 2027).when(F.size(years) == 1, F.try_element_at(years, F.lit(1)).cast("int"))
    both = F.concat_ws(" ", title, description)
    return years, year, F.coalesce(*(F.when(hit(both, p), name) for name, p in SEASONS.items()))


def target_match(evidence: Column, years: Column, season: Column, title: Column, description: Column, confirmed: Column) -> Column:
    in_2027 = F.array_contains(years, "2027")
    summer = F.coalesce(season == "summer", F.lit(False))
    return (
        F.when(~evidence, "not_internship")
        .when(in_2027 & summer | hit(title, SUMMER_2027) | hit(description, SUMMER_2027), "exact")
        .when((F.size(years) > 0) & ~in_2027, "wrong_year")
        .when(in_2027 & season.isNotNull() & ~summer, "wrong_season")
        .when(in_2027 & (F.size(years) == 1) & season.isNull(), "year_confirmed")
        .when(confirmed & ~title.rlike(YEAR) & summer, "source_confirmed")
        .otherwise("unknown")
    )


def classify_postings(postings: DataFrame) -> DataFrame:
    """Adds or replaces company, title, locations, category, season, year, target_match.

    Needs company, title, locations, source_mode; employment_type, description and
    source_confirms are used if they are there.
    """
    have = set(postings.columns)
    opt = lambda name, empty: F.coalesce(F.col(name), F.lit(empty)) if name in have else F.lit(empty)
    p = postings.withColumns({"_title": tx.clean_text(F.col("title")), "_name": tx.clean_text(F.col("company")), "_kind": tx.clean_text(opt("employment_type", "")), "_text": F.when(tx.employer_dated(F.col("source_mode")), tx.clean_text(opt("description", ""))).otherwise("")})
    title, kind, body = F.col("_title"), F.col("_kind"), F.col("_text")
    years, year, season = cycle(title, body)
    p = p.withColumns({"_years": years, "_year": year, "season": season})
    p = p.withColumn("target_match", target_match(internship_evidence(title, kind, body), F.col("_years"), F.col("season"), title, body, opt("source_confirms", False)))
    return p.withColumns({
        "year": F.when(F.col("target_match") == "source_confirmed", 2027).otherwise(F.col("_year")), "category": F.coalesce(tx.category_of(F.concat_ws(" ", title, kind)), tx.category_of(body), F.lit("other")),
        "company": tx.company_of_clean(F.col("_name")), "title": title, "locations": tx.normalize_locations(F.col("locations")),
    }).drop("_title", "_name", "_kind", "_text", "_years", "_year")


def normalize_postings(postings: DataFrame) -> DataFrame:
    """Classified postings with posting_key, canonical_apply_url, identity, normalized_title, family_key."""
    kind = F.lower(F.trim(F.coalesce(F.col("employment_type"), F.lit("")))) if "employment_type" in postings.columns else F.lit("")
    url = F.col("canonical_apply_url")
    p = classify_postings(postings).withColumn("canonical_apply_url", ux.canonical_url(F.col("apply_url")))
    p = p.withColumns({"_scheme": ux.scheme(url), "_host": ux.host(url), "_path": ux.path(url), "_query": ux.query(url), "normalized_title": tx.title_of_clean(F.col("title")), "_company": tx.key_of_clean(F.col("company"))})
    parts = ("_company", "normalized_title", F.coalesce("season", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), kind)
    return p.withColumns({
        "posting_key": F.concat_ws("|", "source", "source_id"), "family_key": F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24),
        "identity": ux.identity_of(F.col("_scheme"), F.col("_host"), F.col("_path"), F.col("_query"), F.col("source"), F.col("source_id")),
    }).drop("_scheme", "_host", "_path", "_query", "_company")


def judged_once(rows: DataFrame, keys: dict[str, str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Joins what `judge` makes of the distinct values of some columns back to the rows; keys: column to the name that `judge` keeps it under.

    The values are written first, so Spark knows their size when it plans: if they are few it broadcasts them, and the
    rows are not shuffled to meet them.
    """
    values, own = written(judge(rows.select(*keys).distinct()), "values"), {f"_own_{k}": v for k, v in keys.items()}
    for k in keys:
        rows = rows.withColumnRenamed(k, f"_own_{k}")
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(v)) for k, v in own.items()))
    return rows.join(values, met, "left").drop(*own, *own.values())


def normalize_by_value(postings: DataFrame) -> DataFrame:
    """As `normalize_postings`, for postings without texts of their own (employment_type, description).

    Titles, companies and places repeat across postings, so each distinct one is cleaned and matched once; links hardly
    do, and are taken apart by row. Each kind of value takes a pass over its own columns, so `postings` should be a table.
    """

    def titles(rows: DataFrame) -> DataFrame:
        empty = {"company": F.lit(""), "locations": F.array().cast("array<string>"), "source_mode": F.lit("")}
        found = classify_postings(rows.withColumns({"_raw": F.col("title"), **empty})).withColumnRenamed("source_confirms", "_confirms")
        return found.select("_raw", "_confirms", "title", "season", "year", "target_match", "category", tx.title_of_clean(F.col("title")).alias("normalized_title"))

    def companies(rows: DataFrame) -> DataFrame:
        named = rows.select(F.col("company").alias("_raw"), tx.company_of_clean(tx.clean_text(F.col("company"))).alias("company"))
        return named.withColumn("_company", tx.key_of_clean(F.col("company")))

    rows = postings.withColumn("_sure", F.col("source_confirms"))
    rows = judged_once(rows, {"title": "_raw", "source_confirms": "_confirms"}, titles).withColumnRenamed("_sure", "source_confirms")
    rows = judged_once(rows, {"company": "_raw"}, companies)
    rows = judged_once(rows, {"locations": "_raw"}, lambda r: r.select(F.col("locations").alias("_raw"), tx.normalize_locations(F.col("locations")).alias("locations")))
    url = F.col("canonical_apply_url")
    rows = rows.withColumn("canonical_apply_url", ux.canonical_url(F.col("apply_url")))
    rows = rows.withColumns({"_scheme": ux.scheme(url), "_host": ux.host(url), "_path": ux.path(url), "_query": ux.query(url)})
    parts = ("_company", "normalized_title", F.coalesce("season", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(""))
    return rows.withColumns({
        "posting_key": F.concat_ws("|", "source", "source_id"), "family_key": F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24),
        "identity": ux.identity_of(F.col("_scheme"), F.col("_host"), F.col("_path"), F.col("_query"), F.col("source"), F.col("source_id")),
    }).drop("_scheme", "_host", "_path", "_query", "_company")


def from_view(view: DataFrame) -> DataFrame:
    """Postings of the fixture view; a registry's rows are list-scoped.

    The view joins six tables; its rows are written once, so that no pass over them joins or shuffles again.
    """
    rows = written(view, "landed").select("source", "source_id", "source_mode", "company", "title", F.array("loc1", "loc2").alias("locations"), "apply_url", "posted_at", "first_seen_at", "last_seen_at", "active", (F.col("source_mode") == "registry").alias("source_confirms"), F.when(~F.col("active"), F.col("last_seen_at")).alias("removed_at"))
    return normalize_by_value(rows)


def is_default_target(match: Column) -> Column:
    return match.isin(*TARGETS)
