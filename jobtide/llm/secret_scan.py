"""Secret scan over an incremental blob ledger, in DataFrame functions alone.

Every version of a path (each row: rows that share a path are its versions) is content-addressed by
the SHA-256 of its text. The ledger, a table in the shared folder, holds the (blob, rule_version)
pairs that were scanned before, with what was found. Only unseen pairs are scanned, one text a blob,
and appended; findings are then read from the ledger and joined back to every path that holds the
blob. The join is dealt by blob and a salt of the path, so copies of one blob spread over tasks.

Defined cases: null text counts as empty and has no findings; rows with a null path stay and
are scanned; repeated rows give repeated result rows; at one start, assign precedes access and
access hex; overlapping spans of several kinds all stay; very long texts and texts of very many
matches take time in proportion; an empty table leaves the ledger as it is and gives empty results;
extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table, text_of


@dataclass(frozen=True)
class Rule:
    """A leftmost, non-overlapping pattern; matches whose `group` is under `least` characters drop."""

    kind: str
    pattern: str
    group: int
    least: int


# The base rules, in the order in which ties at one start are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a maximal run of 16 or more, as runs are never split
)
RULE_VERSION = "base-1"


#: Matches, or characters, a block; see `located` and `without`.
BLOCK = 256
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
#: Parts in which the paths of one blob are dealt.
SALTS = 16


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _with_places(blobs: DataFrame, some: Column) -> DataFrame:
    """Adds steps, blocks and before to found and gaps, where `some` match is there.

    A step is a match and the piece before it. `before` holds the lengths of all that stands before
    each block of BLOCK steps, so a match sums its own block alone, and a text of very many matches
    costs little more than its length. Each column reads the one before it twice, which keeps
    Catalyst from computing it anew for every element.
    """
    blobs = blobs.withColumn("steps", F.when(some, F.zip_with("gaps", F.transform("found", F.length), lambda g, n: g + F.coalesce(n, F.lit(0)))))
    blobs = blobs.withColumn("blocks", F.when(some, F.transform(F.sequence(F.lit(0), (F.size("steps") / BLOCK).cast("int")), lambda b: _sum(F.slice("steps", b * BLOCK + 1, F.lit(BLOCK))))))
    return blobs.withColumn("before", F.when(some, F.transform(F.sequence(F.lit(0), F.size("blocks") - 1), lambda b: _sum(F.slice("blocks", F.lit(1), b)))))


def located(rule: Rule, order: int) -> Column:
    """array<struct<start,ord,end,kind>> from the columns of `_with_places`; code points, end exclusive.

    The pieces between the matches and the matches themselves tile the text, so a match starts
    at the summed lengths of all that stands before it.
    """

    def at(m: Column, i: Column) -> Column:
        block = (i / BLOCK).cast("int")
        start = F.element_at("before", block + 1) + _sum(F.slice("steps", block * BLOCK + 1, i % BLOCK)) + F.element_at("gaps", i + 1)
        kept = F.length(m) if rule.group == 0 else F.length(F.regexp_extract(m, rule.pattern, rule.group))
        return F.struct(start.cast("long").alias("start"), F.lit(order).alias("ord"), (start + F.length(m)).cast("long").alias("end"), F.lit(rule.kind).alias("kind"), (kept >= rule.least).alias("ok"))

    return F.transform(F.filter(F.transform("found", at), lambda s: s["ok"]), lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text) to (blob, spans) of every blob: spans sorted by start, then kind."""
    hit = blobs.withColumns({f"found{n}": F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)) for n, rule in enumerate(rules)})
    for n, rule in enumerate(rules):
        some = F.size(f"found{n}") > 0
        hit = _with_places(hit.withColumns({"found": F.col(f"found{n}"), "gaps": F.when(some, F.transform(F.split("text", rule.pattern, -1), F.length))}), some)
        hit = hit.withColumn(f"spans{n}", F.when(some, located(rule, n)).otherwise(F.array().cast(SPANS)))
    return hit.select("blob", F.array_sort(F.concat(*(f"spans{n}" for n in range(len(rules))))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def addressed(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, text, blob) of every version."""
    return versions.select(F.col(path_col).alias("path"), text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))


def unseen(versions: DataFrame, ledger: DataFrame, rule_version: str) -> DataFrame:
    """(blob, text), one row for each blob that `ledger` does not hold at `rule_version`.

    Copies combine before the shuffle.
    """
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct()
    return versions.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path` as it is now; an empty one is begun there if there is none."""
    # Not createDataFrame, which runs tasks in Python even for no rows.
    spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rule_version"), F.array().cast(SPANS).alias("spans")).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def scan(versions: DataFrame, path: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger at `path` has not seen and append it; all blobs of `rule_version` as (blob, spans)."""
    spark = versions.sparkSession
    todo = unseen(addressed(versions, path_col, text_col), open_ledger(spark, path), rule_version)
    scan_blobs(todo, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(path)
    now = spark.read.schema(LEDGER).parquet(path)
    return now.filter(F.col("rule_version") == rule_version).select("blob", "spans")


def with_blobs(rows: DataFrame, found: DataFrame, path: Column) -> DataFrame:
    """Each row (with a column `blob`) and the columns of its blob in `found`, or nulls."""
    dealt = found.withColumnRenamed("blob", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("own_salt", F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int"))
    # Spark sizes what is exploded as if each blob had one row, and spans as if each had one entry.
    return rows.join(dealt.hint("merge"), (F.col("blob") == F.col("of")) & (F.col("own_salt") == F.col("salt")), "left").drop("of", "salt", "own_salt")


def findings(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, spans), one row a version; `ledger` as `scan` gives it."""
    hits = ledger.filter(F.size("spans") > 0).dropDuplicates(["blob"])
    own = addressed(versions, path_col, text_col).select("path", "blob")
    return with_blobs(own, hits, F.col("path")).select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def unions(ledger: DataFrame) -> DataFrame:
    """(blob, cuts): the spans of each blob that has some, those that overlap or touch made one; in order."""
    one = ledger.filter(F.size("spans") > 0).dropDuplicates(["blob"]).select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    by_start = W.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    one = one.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    one = one.withColumn("nth", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    cuts = one.groupBy("blob", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return cuts.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def without(rows: DataFrame, text: str, cuts: str, name: str, mask: str = "[SECRET]") -> DataFrame:
    """`rows` with a column `name`: the text with `mask` for each of its cuts; as it is where cuts are null.

    The text is cut into blocks of BLOCK characters once, so a piece costs its own length.
    """
    rows = rows.withColumn("pieces", F.when(F.col(cuts).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(a: Column, b: Column) -> Column:
        first, last = (a / BLOCK).cast("int"), ((b - 1) / BLOCK).cast("int")
        run = F.array_join(F.slice("pieces", first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(run, (a - first * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length(text).cast("long")))
    clean = F.when(F.size("pieces") > 0, F.array_join(F.zip_with(begins, ends, piece), mask)).otherwise(F.col(text))
    return rows.withColumn(name, clean).drop("pieces")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the blob of every document."""
    docs = table(spark, sf_dir, "documents")
    per_path = findings(docs, scan(docs, shared_dir(spark, "ledger")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return per_path.select(F.col("path").alias("doc_id"), *(count(r.kind).alias(f"n_{r.kind}") for r in RULES), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob")


_ASSIGN_SQL = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _located_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""select doc_id, blob, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint, 'o': {order}, 'n': length(m[i]), 'g': length(g[i]), 'k': '{kind}'}}), lambda r: r.g >= {least})) r
      from (select doc_id, blob, regexp_extract_all(text, '{pattern}', 0) m, regexp_extract_all(text, '{pattern}', {group}) g, regexp_split_to_array(text, '{pattern}') p from t)"""


ORACLE = {
    "op4_secret_scan": f"""with t as (select doc_id, coalesce(text, '') as text, sha256(coalesce(text, '')) as blob from documents),
    f as ({_located_sql('assign', 0, _ASSIGN_SQL, 2, 12)} union all {_located_sql('access', 1, 'AKIA[A-Z0-9]+', 0, 18)} union all {_located_sql('hex', 2, '[0-9a-f]+', 0, 16)}),
    a as (select doc_id, count(*) filter (r.k = 'assign') n_assign, count(*) filter (r.k = 'access') n_access, count(*) filter (r.k = 'hex') n_hex, string_agg(r.k || ':' || r.s || ':' || (r.s + r.n), ',' order by r.s, r.o) spans from f group by 1)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans, blob from t left join a using (doc_id)""",
}
QUERIES = {"op4_secret_scan": op4_secret_scan}
