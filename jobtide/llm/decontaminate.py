"""Benchmark decontamination: a broadcast hash set of test n-grams against all windows of the documents.

Texts are normalised to words (runs of ASCII letters and digits, A-Z lower-cased, and of characters
beyond ASCII). Each window of WIDTH consecutive words of an item is a gram; an item of fewer words is
one gram as a whole. Grams are hashed to 64 bits and broadcast; every window of every document is looked
up, and a window counts only if its words equal the gram's. Grams beyond `most_bytes` are not
broadcast: the hashes of all windows are then joined to them by a shuffle that is salted by the place of
the window, and verified when they meet their text again. All of it is DataFrame functions.

Defined cases: null and empty texts have no words and no hits; an item without words has no gram; an
item with a null id marks words, but is neither counted nor named; items that repeat an id count once;
repeated rows give repeated result rows; rows with null ids stay; a document shorter than WIDTH words is
hit by grams of its length or less alone; an empty table of items leaves every document clean; extra
columns of any name are kept by `decontaminated`, as rows travel as one struct. A text is one
array of words in a task, some ten times its length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, written

#: Words in a gram.
WIDTH = 10
#: Grams are broadcast up to so many bytes of words and item ids.
BROADCAST = 64 << 20
#: Parts in which the windows of one hash are dealt where grams are not broadcast.
SALTS = 16
# Fixed value: what parts words, before and after A-Z are lower-cased.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; a text of ASCII alone takes the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(f"[^{BETWEEN}]+"), F.lit(0))


def grams(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, hash, items), one row a distinct gram; items are the ids, as strings, in order."""
    items = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("words")).filter(F.size("words") > 0)
    whole = F.least(F.lit(width), F.size("words"))
    windows = items.select("item", "words", whole.alias("n"), F.explode(F.sequence(F.lit(1), F.size("words") - whole + 1)).alias("start"))
    found = windows.select("item", F.slice("words", F.col("start"), F.col("n")).alias("gram")).groupBy("gram")
    return found.agg(F.sort_array(F.collect_set("item")).alias("items")).select("gram", F.xxhash64("gram").alias("hash"), "items")


def row_of(id_col: str, text_col: str) -> Column:
    """What a row goes by: its id with its text, so rows that repeat an id stay apart unless they are equal."""
    return F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_of(text_col)), 256)


def windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(row, words, start, width, hash) of every window of those widths."""
    last = F.size("words") - min(widths) + 1
    found = docs.select("row", "words", F.explode(F.when(last > 0, F.sequence(F.lit(1), last))).alias("start"))
    found = found.withColumn("width", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0]))
    if len(widths) > 1:
        found = found.filter(F.col("start") + F.col("width") - 1 <= F.size("words"))
    return found.withColumn("hash", F.xxhash64(F.slice("words", F.col("start"), F.col("width"))))


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BROADCAST) -> DataFrame:
    """(row, hit, items): for each row that some gram occurs in, the places of the hit words, from 1, and the item ids."""
    docs = docs.select(row_of(id_col, text_col).alias("row"), words_of(text_of(text_col)).alias("words")).filter(F.size("words") > 0)
    known = written(items, "grams")
    # No more widths than `width` exist.
    widths = sorted(r[0] for r in known.select(F.size("gram")).distinct().collect()) or [width]
    n_bytes = known.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " ")) + 64)).first()[0] or 0
    same = F.slice("words", F.col("start"), F.col("width")) == F.col("gram")
    if n_bytes <= most_bytes:
        found = windows(docs, widths).join(F.broadcast(known), "hash").filter(same)
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = windows(docs, widths).select("row", "start", "width", "hash", (F.col("start") % SALTS).alias("salt"))
        maybe = keys.join(dealt, ["hash", "salt"]).select("row", "start", "width", "gram", "items").distinct()
        found = maybe.join(docs.dropDuplicates(["row"]), "row").filter(same)
    found = found.groupBy("row").agg(F.collect_set(F.struct("start", "width")).alias("at"), F.collect_set("items").alias("of"))
    places = F.flatten(F.transform("at", lambda a: F.sequence(a["start"], a["start"] + a["width"] - 1)))
    return found.select("row", F.sort_array(F.array_distinct(places)).alias("hit"), F.sort_array(F.array_distinct(F.flatten("of"))).alias("items"))


def judged(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BROADCAST) -> DataFrame:
    """(id, n_words, hit, items) of every row; hit and items are empty where no gram occurs."""
    found = hits(docs, grams(items, width), width, id_col, text_col, most_bytes)
    own = docs.select(F.col(id_col).alias("id"), row_of(id_col, text_col).alias("row"), F.size(words_of(text_of(text_col))).cast("long").alias("n_words"))
    return own.join(found, "row", "left").select("id", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def runs(hit: str) -> Column:
    """The maximal runs (from, to) of the sorted places `hit`, both inclusive."""
    firsts = F.filter(hit, lambda p, i: (i == 0) | (F.get(hit, i - 1) != p - 1))
    lasts = F.filter(hit, lambda p, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != p + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("from"), b.alias("to")))


def decontaminated(docs: DataFrame, items: DataFrame, remove: str = "spans", width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = BROADCAST) -> DataFrame:
    """The rows of `docs`, with their columns, without what occurs in the items.

    remove="documents" drops every row that is hit; "spans" takes each run of hit words, and what
    stands between them, out of the text, and leaves the text around it as it was.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    found = hits(docs, grams(items, width), width, id_col, text_col, most_bytes)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row_of(id_col, text_col).alias("row"))
    if remove == "documents":
        return rows.join(found, "row", "left_anti").select("doc.*")
    word = f"[^{BETWEEN}]+"
    rows = rows.join(found.select("row", "hit"), "row", "left").withColumn("runs", F.when(F.size("hit") > 0, runs("hit")))
    some, text = F.col("runs").isNotNull(), F.col(f"doc.`{text_col}`")
    rows = rows.withColumns({"words": F.when(some, F.regexp_extract_all(text, F.lit(word), F.lit(0))), "gaps": F.when(some, F.split(text, word, -1))})
    # The text is gap 1, word 1, gap 2, ... and a last gap; a kept piece ends with the gap before the next run.
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["to"]))
    ends = F.concat(F.transform("runs", lambda r: r["from"] - 1), F.array(F.size("words")))

    def piece(a: Column, b: Column) -> Column:
        steps = F.zip_with(F.slice("gaps", a + 1, b - a), F.slice("words", a + 1, b - a), lambda g, w: F.concat(g, w))
        return F.concat(F.array_join(steps, ""), F.element_at("gaps", b + 1))

    left = F.when(some & (F.size("words") + 1 == F.size("gaps")), F.array_join(F.zip_with(begins, ends, piece), "")).otherwise(text)
    return rows.withColumn("left", left).select(*(F.col("left").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op12_decontaminate": f"""with d as (select row_number() over () as r, doc_id, {_WORDS_SQL} as w from documents),
    b as (select item_id, {_WORDS_SQL} as w from benchmark),
    g as (select distinct item_id, least(10, len(w)) as n, w[s:s + least(10, len(w)) - 1] as gram from b, lateral (select unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as s) where len(w) > 0),
    h as (select r, s, g.n, g.item_id from (select r, w, s, n from d, (select distinct n from g) k, lateral (select unnest(generate_series(1, len(w) - n + 1)) as s) where len(w) >= n) x join g on g.n = x.n and x.w[s:s + x.n - 1] = g.gram),
    p as (select r, count(distinct q) as n_hit from h, lateral (select unnest(generate_series(s, s + n - 1)) as q) group by 1),
    i as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join p using (r) left join i using (r)""",
}
QUERIES = {"op12_decontaminate": op12_decontaminate}
