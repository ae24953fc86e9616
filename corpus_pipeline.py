"""Clean a corpus in five stages: language, near-duplicates, secrets, mixture, tokens.

Each stage takes what its predecessor kept and gives the columns of documents, but for the last,
which gives token ids. In every stage any column may be null, extra columns of any name go
through as they are, very long texts are read whole, and an empty table gives an empty one; what a
stage does with null and empty texts, repeated rows and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.llm import language_id, mixing, near_copies, secret_scan, sentencepiece_bpe
from jobtide.llm.common import shared_dir, small_batches, text_of, written

#: Documents whose best language is less likely than this are rejected, as are those without letters.
LEAST_SCORE = 0.4

#: The stages are models and iterative jobs, which SQL does not express.
ORACLE_SQL = None


def carried(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """`columns`, and the input row but for those given by name as `row`, so none of it can clash with a stage's own."""
    small_batches(docs.sparkSession)
    names = [c for c in columns if isinstance(c, str)]
    return docs.select(*columns, F.struct(*(docs[quoted(c)] for c in docs.columns if c not in names)).alias("row"))


def unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs out of `row`, those in `new` replaced."""
    return df.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which replaces `lang`; trained on the given ones' labels.

    Null and empty texts, and texts without a letter, are rejected; rows with a null `lang` are judged and never learned
    from; without any label nothing is recognised. Repeated rows are judged alike; of equal scores the first name counts.
    """
    small_batches(spark)
    model = language_id.train(docs)
    judged = language_id.annotate(carried(docs, "text"), model, "pred", "score")
    return unpacked(judged.filter((F.col("pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs, text=F.col("text"), lang=F.col("pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word Jaccard 0.8 or more): that of the smallest doc_id, null ids last.

    An id with several texts is several documents; of repeated rows one stays, whichever columns they differ in: that of
    the least hash of its columns. Null and blank texts are copies of each other. Ties between ids that are null go to
    the least digest of the text.
    """
    small_batches(spark)
    found = near_copies.near_copies(docs)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    best = written(found.groupBy("root").agg(first).select("first.digest", "first.id"), "near")
    # Maps have no hash; rows that differ in a map alone may swap places.
    tie = F.xxhash64(*(docs[quoted(c)] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"))
    own = carried(docs, F.col("doc_id"), near_copies.digest_of(text_of()).alias("own"), tie.alias("tie"))
    kept = own.join(best, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return unpacked(kept.withColumn("place", F.row_number().over(W.partitionBy("own").orderBy("tie"))).filter(F.col("place") == 1), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each run of spans that the scan finds is replaced in the text, and n_chars follows.

    Null and empty texts and texts without a finding stay as they are; rows that repeat stay and change alike.
    """
    cuts = secret_scan.unions(secret_scan.scan(docs, shared_dir(spark, "ledger")))
    marked = secret_scan.with_blobs(carried(docs, F.sha2(text_of(), 256).alias("blob")), cuts, F.col("row").getField("doc_id"))
    marked = secret_scan.without(marked.withColumn("given", text_of("row.text")), "given", "cuts", "clean")
    hit = F.col("cuts").isNotNull()
    text = F.when(hit, F.col("clean")).otherwise(F.col("row").getField("text"))
    return unpacked(marked, docs, text=text, n_chars=F.length(text).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one in which a source's budget ends is rounded to whole copies.

    Null and blank texts have no words and are never taken; a null source is a source of its own, last in order; repeated
    rows are documents of their own, next to each other in the order of selection, in which identical ones may swap.
    """
    taken = mixing.mix(carried(docs, *map(F.col, ("doc_id", "source", "text"))), carry=("row",))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("int")
    return unpacked(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids; null and empty texts give the end id alone, repeated rows a row each.

    As in op6, all ids are decoded again; ids that do not give their text back end the run.
    """
    small_batches(spark)
    return sentencepiece_bpe.encode(docs, checks=True).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
