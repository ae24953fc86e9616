"""Phrase collocations by direct-address tiles of frequency-ranked ids, doubled up level by level.

Every language apart. Tasks cut the lower-cased texts into words and pieces and keep them in groups of
about GROUP words: a sequence of ids of the group's own dictionary, and that dictionary with its counts, cut
by hash into buckets. A level then goes as follows:

1. A bucket sums up what all groups counted. What occurs LEAST times or more is frequent and is ranked by
   falling frequency within its bucket; the ranks of all buckets, interleaved, are the ids.
2. Each group gets the ids of its own entries alone, never a whole vocabulary, and recodes itself.
3. Neighbours that are both frequent form pairs. A pair lies in the tile (left // TILE, right // TILE);
   tiles that are well filled are counted by numpy's bincount over all cells, the others as sorted
   coordinates. The pairs are the group's next dictionary, and their numbers its next sequence.

So a pair of words is an entry of level 2, and a pair of overlapping entries of level k is one of k + 1
words: a phrase is counted only if both phrases within it that are one word shorter are frequent, which
any frequent phrase fulfils. Counts are longs and scores exact decimals. Groups hold a fixed number of
words and buckets grow in number with the input, so a task holds about one group or one bucket (each bucket
with at most one entry of a group for each phrase, however often the group repeats it). What travels is packed
column by column, not a row an entry.

Defined cases: null text is empty; null lang is `und`, as is a lang so named; empty texts and empty
tables have no phrases; a language with fewer candidates gives all of them; repeated rows count each
time; a long text is cut between pieces of about SLICE bytes, and a piece without any mark is read in
one go; ties go to the greater count, then to the phrase's bytes; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, shards, table, text_of, tidy, total_bytes, written

#: Words that a group holds before it is closed, bytes of a text that are cut into words at once, and bytes of text a bucket.
GROUP, SLICE, BUCKET = 1 << 21, 1 << 20, 8 << 20
#: Side of a tile, and the part of its cells that pairs must reach for it to be counted by direct address.
TILE, FILLED = 1024, 1 / 8
LEAST, WORDS, TOP = 30, 4, 2000
# The contract's score and the share at which a longer phrase stands for a shorter one, in percent.
SCORE, SHARE = 2_000_000, 80
# What ends a piece, and what parts words besides the space.
ENDS, TAB = b".,;:!?\n\x0b\x0c\r", b"\t"
MARKS = bytes.maketrans(ENDS + TAB, b"." * len(ENDS) + b" ")
#: A group's sequence (ids, with n words), or a bucket of its dictionary: entries from number `first` on, by word or by pair.
PART = "grp bigint, lang string, bucket int, n bigint, first bigint, ids binary, cnt binary, word binary, left binary, right binary"
#: A frequent entry of a bucket (id, a, and word or pair), or what one group has of them: its numbers and the ids they get.
FOUND = "grp bigint, lang string, local binary, ids binary, id bigint, a bigint, word string, left bigint, right bigint"


def packed(values: np.ndarray, steps: bool = False) -> bytes:
    """Integers by planes of bytes, compressed; steps: as differences, for what rises."""
    import pyarrow as pa

    values = np.asarray(values, np.int64)
    values = np.diff(values, prepend=np.int64(0)) if steps else values
    planes = values.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(values) else b"")


def unpacked(data: bytes, steps: bool = False) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()
    return np.cumsum(values) if steps else values


def all_of(column, steps: bool = False) -> np.ndarray:
    """The integers of all rows of a packed column, in order."""
    return np.concatenate([np.empty(0, np.int64), *(unpacked(x, steps) for x in column.to_pylist())])


def rows(schema: str, found: list[dict]):
    """An Arrow table of a few rows; a column that no row has is null."""
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in found], kinds[kind]) for name, kind in fields})


class Dictionary(dict):
    """Word to id in order of appearance; the mark between pieces is -1."""

    def __init__(self) -> None:
        super().__init__({b".": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) - 1
        return found


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end where a piece ends."""
    at = 0
    while at < len(text):
        end = text.find(b".", at + SLICE)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted array."""
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
    return zip(buckets[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def encode(group: int, n_buckets: int):
    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        open_, held, nth = {}, 0, TaskContext.get().partitionId() << 24

        def closed() -> Iterator:
            for lang, (words, parts) in open_.items():
                ids, names = np.concatenate(parts), np.array([w for w, i in words.items() if i >= 0], object)
                if not len(names):
                    continue
                buckets = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % n_buckets
                order = np.argsort(buckets, kind="stable")
                place = np.full(len(names) + 1, -1, np.int64)  # the mark, -1, takes the last
                place[order] = np.arange(len(names))
                ids, names, counts = place[ids], names[order], np.bincount(ids[ids >= 0], minlength=len(names))[order]
                found = [{"bucket": -1, "n": int(counts.sum()), "ids": packed(ids)}]
                found += [{"bucket": b, "n": to - at, "first": at, "cnt": packed(counts[at:to]), "word": text_packed(names[at:to])} for b, at, to in by_bucket(buckets[order])]
                yield from rows(PART, [x | {"grp": nth, "lang": lang} for x in found]).to_batches()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for part in slices(text.encode().lower().translate(MARKS)):
                    words, parts = open_.setdefault(lang, (Dictionary(), []))
                    found = part.replace(b".", b" . ").split()
                    parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                    parts.append(np.full(1, -1, np.int32))
                    held += len(found) + 1
                    if held >= group:
                        yield from closed()
                        open_, held, nth = {}, 0, nth + 1
        yield from closed()

    return tidy(run)


def text_packed(words: np.ndarray) -> bytes:
    """Words, none of which holds a space, compressed."""
    import pyarrow as pa

    text = b" ".join(words)
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def text_unpacked(data: bytes) -> list[bytes]:
    import pyarrow as pa

    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b" ")


def merge(least: int, n_buckets: int):
    """One bucket of a language, of all groups: the frequent entries, and the ids that each group's entries get."""

    def run(key, parts):
        import pyarrow as pa

        lang, bucket = (k.as_py() for k in key)
        parts = parts.sort_by("grp")
        counts, sizes = all_of(parts["cnt"]), parts["n"].to_numpy()
        if parts["word"].null_count == 0:
            words = pa.array([w for x in parts["word"].to_pylist() for w in text_unpacked(x)], pa.binary()).dictionary_encode()
            entry, said = words.indices.to_numpy().astype(np.int64), words.dictionary
            pairs = None
        else:
            sides = [np.unique(all_of(parts[side], side == "left"), return_inverse=True) for side in ("left", "right")]
            codes, entry = np.unique(sides[0][1] * len(sides[1][0]) + sides[1][1], return_inverse=True)
            pairs = [sides[0][0][codes // len(sides[1][0])], sides[1][0][codes % len(sides[1][0])]]
        total = np.zeros(int(entry.max()) + 1, np.int64)
        np.add.at(total, entry, counts)
        kept = np.flatnonzero(total >= least)
        kept = kept[np.argsort(-total[kept], kind="stable")]
        ids = np.full(len(total), -1, np.int64)
        ids[kept] = np.arange(len(kept)) * n_buckets + bucket
        own, found, at = ids[entry], [], 0
        for grp, first, n in zip(parts["grp"].to_pylist(), parts["first"].to_pylist(), sizes.tolist(), strict=True):
            there = np.flatnonzero(own[at : at + n] >= 0)
            if len(there):
                found.append({"grp": grp, "lang": lang, "local": packed(first + there, True), "ids": packed(own[at : at + n][there])})
            at += n
        groups, n = rows(FOUND, found), len(kept)
        fields = {"lang": pa.repeat(pa.scalar(lang), n), "id": pa.array(ids[kept]), "a": pa.array(total[kept])}
        fields |= {"word": said.take(pa.array(kept)).cast(pa.string())} if pairs is None else {"left": pa.array(pairs[0][kept]), "right": pa.array(pairs[1][kept])}
        entries = pa.table([fields.get(f.name, pa.nulls(n, f.type)) for f in groups.schema], schema=groups.schema)
        return pa.concat_tables([groups, entries])

    return run


def tiled(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, count) of the distinct pairs, and for each given pair the number of its own."""
    span = int(right.max()) // TILE + 1
    _, tile, filled = np.unique(left // TILE * span + right // TILE, return_inverse=True, return_counts=True)
    lefts, rights, counts, own, n = [], [], [], np.empty(len(left), np.int64), 0
    rest = np.ones(len(left), bool)
    for t in np.flatnonzero(filled >= TILE * TILE * FILLED):
        here = np.flatnonzero(tile == t)
        a, b = int(left[here[0]]) // TILE * TILE, int(right[here[0]]) // TILE * TILE
        code = (left[here] - a) * TILE + right[here] - b
        cells = np.bincount(code, minlength=TILE * TILE)
        used = np.flatnonzero(cells)
        number = np.empty(TILE * TILE, np.int64)
        number[used] = np.arange(n, n + len(used))
        own[here], rest[here] = number[code], False
        lefts.append(used // TILE + a)
        rights.append(used % TILE + b)
        counts.append(cells[used])
        n += len(used)
    width = int(right.max()) + 1
    codes, inverse, cells = np.unique(left[rest] * width + right[rest], return_inverse=True, return_counts=True)
    own[rest] = n + inverse
    return np.concatenate([*lefts, codes // width]), np.concatenate([*rights, codes % width]), np.concatenate([*counts, cells]), own


def paired(n_buckets: int):
    """A group's sequence and the ids of its frequent entries: its next sequence and dictionary."""

    def run(sequence, found):
        if not sequence.num_rows or not found.num_rows:
            return rows(PART, [])
        ids, local = unpacked(sequence["ids"][0].as_py()), all_of(found["local"], True)
        known, rank = np.unique(all_of(found["ids"]), return_inverse=True)  # by frequency, and without the gaps of other groups' entries
        of = np.full(max(int(ids.max()), int(local.max())) + 2, -1, np.int64)
        of[local] = rank
        seq = of[ids]  # -1, the mark, takes the last
        both = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
        if not len(both):
            return rows(PART, [])
        left, right, counts, own = tiled(seq[both], seq[both + 1])
        left, right = known[left], known[right]
        mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        buckets = ((mixed >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((right, left, buckets))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        next_ = np.full(len(seq), -1, np.int64)
        next_[both] = place[own]
        # Of each run of marks the first stays.
        there = next_ >= 0
        next_ = next_[there | np.concatenate([[False], there[:-1]])]
        left, right, counts = left[order], right[order], counts[order]
        out = [{"bucket": -1, "n": int(counts.sum()), "ids": packed(next_)}]
        out += [{"bucket": b, "n": to - at, "first": at, "cnt": packed(counts[at:to]), "left": packed(left[at:to], True), "right": packed(right[at:to])} for b, at, to in by_bucket(buckets[order])]
        return rows(PART, [x | {"grp": sequence["grp"][0].as_py(), "lang": sequence["lang"][0].as_py()} for x in out])

    return run


def phrased(entries: DataFrame, shorter: DataFrame) -> DataFrame:
    """Entries (lang, id, a, left, right) with their phrase and the counts of what it begins and ends with."""
    side = lambda name: shorter.select("lang", F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("phrase", "last", "heads", "tails")))
    both = entries.join(side("left"), ["lang", "left"]).join(side("right"), ["lang", "right"])
    return both.select("lang", "id", "left", "right", "a", F.concat_ws(" ", "left_phrase", "right_last").alias("phrase"), F.col("right_last").alias("last"), F.concat("left_heads", F.array("a")).alias("heads"), F.concat("right_tails", F.array("a")).alias("tails"))


def phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, lang_col: str = "lang", text_col: str = "text", group: int = GROUP) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), the words of each language, and for each length (lang, id, phrase, a, heads, tails) of the phrases that occur `least` times.

    heads[k] and tails[k] count the phrase's first and last k + 1 words; left and right are the ids of
    the phrases without its last and its first word.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    n_buckets = shards(total_bytes(texts), BUCKET)
    now, levels, totals = written(texts.mapInArrow(encode(group, n_buckets), PART), "phrases"), [], None
    for k in range(1, words + 1):
        if totals is None:
            totals = written(now.filter("bucket < 0").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        parts = now.filter("bucket >= 0").drop("ids")
        found = written(parts.groupBy("lang", "bucket").applyInArrow(merge(least, n_buckets), FOUND), "found")
        entries = found.filter("id is not null")
        if k == 1:
            full = entries.select("lang", "id", "a", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("heads"), F.array("a").alias("tails"))
        else:
            full = phrased(entries.select("lang", "id", "a", "left", "right"), levels[-1])
        levels.append(written(full, "level"))
        if k < words:
            sequences, ids = now.filter("bucket < 0").select("grp", "lang", "ids"), found.filter("id is null").select("grp", "lang", "local", "ids")
            nexts = sequences.groupBy("grp", "lang").cogroup(ids.groupBy("grp", "lang")).applyInArrow(paired(n_buckets), PART)
            before, now = now, written(nexts, "phrases")
            dropped(before)
    return totals, levels


def scored(level: DataFrame, words: int) -> DataFrame:
    """Adds l, r and score: those of the cut that scores lowest, of equals the earliest."""
    exact = lambda c: c.cast("decimal(20,0)")

    def cut(k: int) -> Column:
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))
        return F.struct(F.call_function("div", F.lit(SCORE).cast("decimal(10,0)") * exact(F.col("a")), exact(l) + exact(r)).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return level.withColumn("cut", F.array_min(F.array(*(cut(k) for k in range(1, words))))).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def standing(level: DataFrame, longer: DataFrame | None) -> DataFrame:
    """The phrases that no longer one stands for.

    The longer phrases of one word more suffice: whichever longer phrase holds this one, a phrase of one
    word more lies between them and is at least as frequent.
    """
    if longer is None:
        return level
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    held = longer.select("lang", "a", F.explode(F.array("left", "right")).alias("id")).groupBy("lang", "id").agg(F.max("a").alias("most"))
    return level.join(held, ["lang", "id"], "left").filter(F.col("most").isNull() | (exact("most") * 100 < exact("a") * SHARE)).drop("most")


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases."""
    totals, levels = phrases(docs, words, least, lang_col, text_col, group)
    cols = ("lang", "phrase", "a", "l", "r", "score")
    best = None
    for k in range(2, words + 1):
        one = scored(standing(levels[k - 1], levels[k] if k < words else None), k).select(*cols)
        best = one if best is None else best.unionByName(one)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of every part first, so that no task sorts a language.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    best = best.withColumn("at", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("at") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2000 of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_collocations": r"""with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
    p as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as piece from t),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
    g as (select lang, k, ws[i:i + k - 1] as ph from w, (select unnest([1, 2, 3, 4]) as k) ks, lateral (select unnest(generate_series(1, len(ws) - k + 1)) as i) where len(ws) >= k),
    f as (select lang, k, ph, count(*) as a from g group by all),
    n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
    c as (select * from f where k >= 2 and a >= 30),
    cuts as (select c.lang, c.k, c.ph, c.a, j, x.a as l, y.a as r, ((2000000::hugeint * c.a) // (x.a::hugeint + y.a))::bigint as score
      from c, lateral (select unnest(generate_series(1, c.k - 1)) as j) join f x on x.lang = c.lang and x.ph = c.ph[1:j] join f y on y.lang = c.lang and y.ph = c.ph[j + 1:c.k]),
    best as (select * from cuts qualify row_number() over (partition by lang, ph order by score, j) = 1),
    inner_ as (select lang, ph[i:i + m - 1] as ph, max(a) as most from c, (select unnest([2, 3]) as m) ms, lateral (select unnest(generate_series(1, k - m + 1)) as i) where k > m group by 1, 2),
    left_ as (select b.lang, array_to_string(b.ph, ' ') as phrase, b.a, b.l, b.r, b.score from best b left join inner_ i on i.lang = b.lang and i.ph = b.ph where i.most is null or 100::hugeint * i.most < 80::hugeint * b.a)
    select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_) join n using (lang) where rank <= 2000""",
}
QUERIES = {"op11_collocations": op11_collocations}
