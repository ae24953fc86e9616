"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share a budget of
`share` times all words. No target passes `most` times its source's words; what a full source
leaves is shared again by weight. That water level has a closed form: with the sources sorted by
cap/weight, the first one whose cap is not reached by (budget - caps before it) / (weights from
it on) sets the level, and target = min(cap, weight * level).

Selection: a document's key is exponential, -ln(u) / quality, u from a hash of its id, so
smaller keys are drawn first, and more often for better text. target // source words full
epochs take every document; the rest of the target is filled in key order by prefix sums. The
sums are taken in two levels: words per (source, key bucket), then single documents in the one
bucket per source in which the budget ends, so no source is sorted in one task. The document at
the boundary is taken in part, so a source's words meet the whole part of its target.

Defined cases: null or blank text has size 0 and is never taken; null source is a source of its
own, listed last; repeated rows (same id) are separate documents with equal keys, told apart by
text, and identical ones may swap places; a null id hashes like the text 'null'; empty tables
give empty results; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, text_of, written

# Weights of the sources, repeating in their order.
WEIGHTS = (5, 2, 1)
BUCKETS = 4096


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id alone: 48 bits of an MD5, plus a half."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(2**48)


def quality(text: Column) -> Column:
    """Between 0.5 and 2: the share of ASCII letters among the characters."""
    return 0.5 + 1.5 * F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) / F.greatest(F.length(text), F.lit(1))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target). Windows run over sources, not documents."""
    by_name, all_ = W.orderBy(F.col("source").isNull(), "source"), W.partitionBy()
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    filled = ranked.withColumn("cap", F.col("source_size") * most).withColumns({
        "caps_before": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weights_from": F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)),
        "budget": F.sum("source_size").over(all_) * share,
    })
    level = filled.withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("weights_from"))
    # Among the sources that stay open, the first in fill order has the level that holds for all.
    is_open, fill = F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    held = F.min_by("level", F.when(is_open, fill)).over(all_)
    return level.withColumn("held", held).select("source", "source_size", F.when(F.col("w") * F.col("held") < F.col("cap"), F.col("w") * F.col("held")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix-1", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), and `carry` columns."""
    text = text_of()
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / quality(text)).alias("key"), F.xxhash64(text).alias("tie"), *carry)
    if not carry:
        # Sizes and keys alone are a small table; written once, they spare two more passes over the texts.
        sized = written(sized, "mix")
    # 1 - exp(-key) is monotone in the key and spreads the documents over the buckets.
    sized = sized.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))
    cells = sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    goal = targets(cells.groupBy("source").agg(F.sum("cell").alias("source_size")), weights, share, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = F.coalesce(F.sum("cell").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = cells.withColumn("before", before).join(goal.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).select(F.col("source").alias("cell_source"), F.col("bucket").alias("cell_bucket"), "cell", "before", "source_size", "target", "epochs", "rest")
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("bucket") == F.col("cell_bucket")))
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("cell") > F.col("rest"))
    cols = ["doc_id", "source", "size", "source_size", "target", *carry]
    whole = placed.filter(~ends_here).select(*cols, (F.col("size") * (F.col("epochs") + (F.col("before") < F.col("rest")).cast("long"))).alias("taken"))
    run = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = placed.filter(ends_here).withColumn("run", F.col("before") + run)
    part = part.select(*cols, (F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("run")))).alias("taken"))
    return whole.unionByName(part)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op5_source_mix": r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
      -ln((('0x' || substr(md5('mix-1' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0) / (0.5 + 1.5 * length(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) as key from documents),
    s as (select source, sum(size)::bigint as source_size from d group by 1),
    w as (select *, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as w, source_size * 2 as cap from s),
    l as (select *, ((sum(source_size) over ()) * 1.5::double - coalesce(sum(cap) over (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source is null, source rows between current row and unbounded following) as level from w),
    h as (select arg_min(level, cap / w) as held from l where level <= cap / w),
    t as (select source, source_size, least(cap::double, w * held) as target from l, h),
    g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
    r as (select *, floor(target - epochs * source_size)::bigint as rest from g),
    o as (select d.doc_id, d.size, r.source_size, r.target, r.epochs, r.rest, coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id rows between unbounded preceding and 1 preceding), 0) as run from d join r on d.source is not distinct from r.source)
    select doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, rest - run)))::bigint as taken from o""",
}
QUERIES = {"op5_source_mix": op5_source_mix}
