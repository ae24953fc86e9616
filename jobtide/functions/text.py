"""Column functions over names, titles and locations; all stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ALL_OVER, CATEGORIES, CLEANING, COMPANY_ALIASES, EDGES, EMPLOYER_DATE_MODES, EMPTY_PLACES, FAILURES, LEGAL_SUFFIX, LEVEL, SOURCE_DETAILS, SOURCE_LABELS, STATES, TITLE_NOISE, TITLE_STOPWORDS


def chain(col: Column, *steps: tuple[str, str]) -> Column:
    """One regexp_replace after the other."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def clean_text(col: Column) -> Column:
    """Visible text: tags, Markdown links, flags and emoji dropped, space collapsed, edges stripped."""
    cleaned = F.btrim(chain(F.coalesce(col, F.lit("")), *CLEANING), F.lit(EDGES))
    # One test spares plain text the whole chain.
    return F.when(col.rlike("^[A-Za-z0-9_.,()#:/+]+(?:[ -]+[A-Za-z0-9_.,()#:/+]+)*$") & ~col.contains("  "), col).otherwise(cleaned)


def key_of_clean(name: Column) -> Column:
    key = chain(F.lower(name), ("&", " and "), (r"\([^)]*\)", " "), (r"[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(F.trim(key), LEGAL_SUFFIX, ""))


def raw_company_key(col: Column) -> Column:
    return key_of_clean(clean_text(col))


def company_of_clean(name: Column) -> Column:
    """The alias of a cleaned name's key, else the name, else 'Unknown company'."""
    aliases = F.create_map(*(F.lit(x) for pair in COMPANY_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, key_of_clean(name)), F.when(name != "", name), F.lit("Unknown company"))


def canonical_company(col: Column) -> Column:
    return company_of_clean(clean_text(col))


def company_key(col: Column) -> Column:
    return raw_company_key(canonical_company(col))


def title_of_clean(cleaned: Column) -> Column:
    """Presentation noise goes, specialisation stays; levels go after intern titles."""
    title = F.btrim(chain(F.lower(cleaned), *TITLE_NOISE), F.lit(" -/"))
    return F.when(title.contains("intern"), F.trim(F.regexp_replace(title, LEVEL, ""))).otherwise(title)


def normalize_title(col: Column) -> Column:
    return title_of_clean(clean_text(col))


def family_key(company: Column, title: Column, season: Column, year: Column, kind: Column) -> Column:
    parts = (company_key(company), normalize_title(title), F.coalesce(season, F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.lower(F.trim(F.coalesce(kind, F.lit("")))))
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def normalize_locations(col: Column) -> Column:
    """Distinct place names in their order; empty values and dates go, joined states are split."""
    named = F.transform(F.filter(F.transform(col, clean_text), lambda v: ~F.lower(v).isin(*EMPTY_PLACES) & ~v.rlike(r"^\d{4}-\d{2}-\d{2}$")), lambda v: F.when(F.lower(v).isin(*ALL_OVER), "United States").otherwise(v))
    plain = F.transform(named, lambda v: F.replace(chain(v, (r"(?i)^\s*\d+\s+locations?\s*\*+\s*", ""), (r"(?i)\b\d+\s+locations?\b", " ")), F.lit("Remote-Friendly"), F.lit("Remote")))
    chunks = F.flatten(F.transform(plain, lambda v: F.split(v, r"\s*(?:\||/|;|·|\n|\r|\t|\*\*)\s*")))
    fixed = F.flatten(F.transform(chunks, lambda v: F.split(F.regexp_replace(v, rf"\b({STATES})(?=[\s,;|·—–]*[A-Z][a-z])", "$1\u0001"), "\u0001")))
    trimmed = F.filter(F.transform(fixed, lambda v: F.btrim(F.regexp_replace(v, r"\s+", " "), F.lit(" ,;-·*—–"))), lambda v: ~F.lower(v).isin(*EMPTY_PLACES))
    # Plain names need no more than the last step.
    plain_names = F.forall(col, lambda v: v.rlike(r"^[A-Za-z0-9_.]+(?: [A-Za-z0-9_.]+)*$") & ~v.rlike(r"\b[A-Z]{2}(?:\b|[A-Z][a-z])|(?i:locations?|not stated)|^\d{4}"))
    return F.when(F.coalesce(plain_names, F.lit(False)), distinct_names(col)).otherwise(distinct_names(trimmed))


def distinct_names(names: Column) -> Column:
    """The first of names that differ only in case, in order."""
    # Arrays bound to a lambda's variable are computed once, not once an element.
    bound = F.transform(F.array(names), lambda t: F.struct(t.alias("t"), F.transform(t, F.lower).alias("low")))
    return F.transform(bound, lambda s: F.filter(s["t"], lambda v, i: F.array_position(s["low"], F.lower(v)) == i + 1))[0]


def coverage_role_signature(company: Column, title: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9+#]+"), F.lit(0)), lambda t: F.when(t == "engineering", "engineer").when(t.isin("internship", "internships"), "intern").otherwise(t))
    return F.concat(F.lower(canonical_company(company)), F.lit(":"), F.array_join(F.filter(tokens, lambda t: ~t.isin("or", "summer", "2027")), " "))


def title_tokens(col: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " ")), " "), lambda t: (F.length(t) > 1) & ~t.isin(*TITLE_STOPWORDS)))


def title_similarity(left: Column, right: Column) -> Column:
    """Shared tokens over the smaller set's size; 0 if either has none."""
    a, b = title_tokens(left), title_tokens(right)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))).otherwise(0.0)


def canonical_source_name(col: Column) -> Column:
    name = clean_text(col)
    parts = F.split(name, ":")
    return F.when(name.rlike("^(ashby|greenhouse|lever):"), F.concat(F.element_at(parts, 1), F.lit(":"), F.lower(F.substring(name, F.length(F.element_at(parts, 1)) + 2, F.length(name))))).when(name.startswith("workday:") & (F.size(parts) >= 3), F.concat_ws(":", F.element_at(parts, 1), F.lower(F.element_at(parts, 2)), F.lower(F.try_element_at(parts, F.lit(3))))).otherwise(name)


def humanize_slug(col: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(col, "[-_]+", " ")))


def hashed(n: int, *cols: Column) -> Column:
    """The first n hex digits of the SHA-256 of the parts joined by a bar; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256), 1, n)


def employer_key(col: Column) -> Column:
    return hashed(24, F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " ")))


def shortened(col: Column, n: int) -> Column:
    """Single spaces; a longer text is cut to n characters that end in an ellipsis."""
    text = F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def source_label(col: Column) -> Column:
    """How an alert names a source: its kind's name, with its second part for lists and leads; an unknown kind as it is."""
    raw = F.coalesce(F.nullif(shortened(col, 180), F.lit("")), F.lit("unknown"))
    parts = F.transform(F.split(raw, ":"), lambda p: F.trim(p))
    kind = F.lower(F.element_at(parts, 1))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair)), kind)
    bare = F.trim(F.translate(F.try_element_at(parts, F.lit(2)), "_-", "  "))
    # A letter after anything that is no letter is a capital.
    title = F.array_join(F.transform(F.split(F.lower(bare), r"(?<=\P{L})"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 180))), "")
    detail = F.when(bare.rlike(r"^\p{L}{1,5}$"), F.upper(bare)).otherwise(title)
    full = F.when(kind.isin(*SOURCE_DETAILS) & (bare != ""), shortened(F.concat(named, F.lit(" · "), detail), 180)).otherwise(named)
    return F.when(named.isNull(), raw).otherwise(full)


def stable_shard(col: Column, n: int) -> Column:
    """The first eight bytes of the name's SHA-256, as an unsigned number, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(col, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n)).cast("int")


def reason_bucket(col: Column) -> Column:
    value = F.lower(F.when(F.coalesce(col, F.lit("")) == "", "unknown").otherwise(col))
    out = F.lit(None).cast("string")
    for label, tokens in FAILURES:
        out = F.coalesce(out, F.when(reduce(lambda a, b: a | b, (value.contains(t) for t in tokens)), label))
    return F.coalesce(out, F.when(value.isin("", "none", "unknown", "candidate", "retry", "rejected"), "unclassified").otherwise("other"))


def category_of(text: Column) -> Column:
    """The first rule that hits; null if none does."""
    return F.coalesce(*(F.when(text.rlike("(?i)" + p), name) for name, p in CATEGORIES.items()))


def employer_dated(mode: Column) -> Column:
    return mode.isin(*EMPLOYER_DATE_MODES)
