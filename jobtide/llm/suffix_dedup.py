"""Exact removal of repeated byte strings by a sparse, range-partitioned suffix sort.

A string of LENGTH = 50 bytes holds 19 stretches of 32 bytes; the one with the least hash is its
anchor. Equal strings have equal anchors at equal places, so it is enough to sort the suffixes
that start at anchors, with the bytes that may stand before them. First, anchors whose 32 bytes
stand in one document alone drop out (no string there repeats). What is left is dealt to buckets:
at up to RANGES splitters of the leading bytes, drawn from a sample of at most SAMPLE suffixes, and
within a range by a hash of the leading bytes, so buckets keep their size as the input grows.

Equal leading bytes share a bucket, and with them all equal strings, so no two buckets hold strings
to compare. Where the sample holds the same leading bytes HOT times, that would be one large bucket:
suffixes there are cut into their single strings, which are dealt by all their bytes instead. A
bucket sorts its suffixes by multikey quicksort, eight bytes a key: each key refines only runs that
are still equal; then the strings of one place after the other. A string that all documents share
is sent once a group of documents.

A byte goes if a string over it also starts in a document with a smaller doc_id.

Defined cases: null and empty texts have no bytes; texts under 50 bytes stay whole; very long texts
are read as the others are; rows that repeat a doc_id count as one document and never remove from
each other; null ids come last; empty tables give empty results; extra input columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, text_of
from .rounds import ASK, LAST_ID, QUESTIONS, Asked, answered, ask_repeated, byte_values, grouped, ids_of, least_at, mixed, packed, prefixes, repeated, unpacked, windows_hash

LENGTH, STRETCH, LEAD = 50, 32, 24
#: Bounds of the sample and of the splitters drawn from it; bytes of text a bucket; how often a sampled lead is hot.
SAMPLE, RANGES, BUCKET_BYTES, HOT = 200_000, 4096, 4 << 20, 8
BEFORE = LENGTH - STRETCH
CONTEXT = BEFORE + LENGTH


class Part:
    """Some documents' bytes in one array, and their anchors."""

    def __init__(self, raws: list[bytes], ids: np.ndarray):
        self.bytes = np.frombuffer(b"".join(raws), np.uint8)
        self.size = np.array([len(r) for r in raws], np.int64)
        self.start = np.cumsum(self.size) - self.size
        h = windows_hash(prefixes(byte_values(self.bytes)), STRETCH)
        anchor = least_at(h, BEFORE + 1)
        inner = np.arange(len(self.bytes)) - np.repeat(self.start, self.size)
        ok = np.flatnonzero(inner <= np.repeat(self.size, self.size) - LENGTH)
        at = anchor[ok]
        # A document's strings with one anchor stand in a row.
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1])]) if len(at) else np.zeros(0, np.int64)
        self.at = at[new]
        self.lo, self.hi = ok[new], ok[np.r_[new[1:], len(at)] - 1] if len(at) else new
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1
        # Empty documents share their start with the next one; the last of them owns the bytes.
        self.ids, self.hash = ids[self.doc], h[self.at]

    def contexts(self, pick: np.ndarray) -> np.ndarray:
        """One row an anchor: first and last place of its strings, and the bytes around it."""
        place = self.at[pick, None] + np.arange(-BEFORE, LENGTH)
        begin, end = self.start[self.doc[pick], None], (self.start + self.size)[self.doc[pick], None]
        out = np.zeros((len(pick), 2 + CONTEXT), np.uint8)
        out[:, 0], out[:, 1] = self.lo[pick] - self.at[pick] + BEFORE, self.hi[pick] - self.at[pick] + BEFORE
        # What lies outside the strings is blanked, so it neither tells contexts apart nor travels.
        inside = (place >= begin) & (place < end) & (place >= self.lo[pick, None]) & (place < self.hi[pick, None] + LENGTH)
        out[:, 2:] = np.where(inside, self.bytes[np.clip(place, 0, max(0, len(self.bytes) - 1))], 0)
        return out


def parts_of(docs: pd.DataFrame) -> list[Part]:
    raws, ids, at, out = [t.encode() for t in docs.text], ids_of(docs), 0, []
    for run in portions(raws, 1_000_000):
        out.append(Part(run, ids[at : at + len(run)]))
        at += len(run)
    return out


def joined(arrays: list[np.ndarray], like: np.ndarray) -> np.ndarray:
    return np.concatenate(arrays) if arrays else like


def anchors(parts: list[Part], buckets: int) -> Asked:
    return Asked(joined([p.hash for p in parts], np.zeros(0, np.uint64)), joined([p.ids for p in parts], np.zeros(0, np.int64)), buckets)


def leads_of(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, 2 + BEFORE : 2 + BEFORE + LEAD]).view(f"S{LEAD}").ravel()


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers, eight bytes each, that sort alike."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def hashed(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words), np.uint64)
    for word in words.T:
        h = mixed(h ^ word) + np.uint64(0x632BE59BD9B4E019)
    return h


def singles(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of one string each, and the rows they come from."""
    count = rows[:, 1].astype(np.int64) - rows[:, 0] + 1
    owner = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + rows[owner, 0]
    out = np.zeros((len(owner), 2 + CONTEXT), np.uint8)
    out[:, 0] = out[:, 1] = place
    at = 2 + place[:, None] + np.arange(LENGTH)
    np.put_along_axis(out, at, rows[owner[:, None], at], axis=1)
    return out, owner


class Dealer:
    """The bucket of each context."""

    def __init__(self, sample: np.ndarray, buckets: int):
        """sample: leading bytes of some suffixes."""
        ranges = min(buckets, RANGES)
        self.slots = -(-buckets // ranges)
        self.buckets = ranges * self.slots
        leads, count = np.unique(sample, return_counts=True)
        self.hot = leads[count >= HOT]
        self.splitters = np.unique(np.sort(sample)[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample

    def is_hot(self, leads: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, leads), len(self.hot) - 1)
        return self.hot[at] == leads if len(self.hot) else np.zeros(len(leads), bool)

    def bucket(self, rows: np.ndarray) -> np.ndarray:
        leads = leads_of(rows)
        words = words_of(rows)
        own = (hashed(words[:, [2, 3, 4]]) % np.uint64(self.slots)).astype(np.int64)
        own += np.searchsorted(self.splitters, leads, side="right") * self.slots
        return np.where(self.is_hot(leads), (hashed(words) % np.uint64(self.buckets)).astype(np.int64), own)


class Suffixes:
    """The anchors of a group that repeat (by part), their contexts, and the distinct ones to ask about."""

    def __init__(self, parts: list[Part], asked: Asked, replies: pd.DataFrame, dealer: Dealer):
        yes = asked.replied(replies, "bit")[asked.of]
        self.picks = [np.flatnonzero(y) for y in np.split(yes, np.cumsum([len(p.at) for p in parts])[:-1])]
        rows = joined([p.contexts(k) for p, k in zip(parts, self.picks)], np.zeros((0, 2 + CONTEXT), np.uint8))
        self.n, ids = len(rows), joined([p.ids[k] for p, k in zip(parts, self.picks)], np.zeros(0, np.int64))
        hot = dealer.is_hot(leads_of(rows))
        cut, owner = singles(rows[hot])
        self.owner = np.r_[np.flatnonzero(~hot), np.flatnonzero(hot)[owner]]
        self.rows, self.ids = np.concatenate([rows[~hot], cut]), ids[self.owner]
        words = words_of(self.rows)
        # Neighbours in a bucket have like leading bytes, which packs well.
        self.asked = Asked(hashed(words), self.ids, 0, lambda first: dealer.bucket(self.rows[first]), exact=words, by=lambda first: words[first][:, [4, 3, 2]].T)

    def sent(self, gid: int) -> pd.DataFrame:
        got = self.asked.sent(lambda p: packed(self.rows[self.asked.pick[p]].tobytes()), lambda p: packed(self.asked.least[p].astype("<i8").tobytes()))
        return pd.DataFrame(got | {"gid": gid})[["bucket", "gid", "n", "x0", "x1"]]

    def masks(self, replies: pd.DataFrame) -> list[np.ndarray]:
        """By part, a bit a string of each anchor: whether a smaller id holds it."""
        of = self.asked.of
        said = np.where(self.ids == self.asked.least[of], self.asked.replied(replies, "<u4")[of], np.uint32(0xFFFFFFFF))
        lo, hi = self.rows[:, 0].astype(np.uint32), self.rows[:, 1].astype(np.uint32)
        mask = np.zeros(self.n, np.uint32)
        np.bitwise_or.at(mask, self.owner, said & ((np.uint32(2) << hi) - (np.uint32(1) << lo)))
        return np.split(mask, np.cumsum([len(k) for k in self.picks])[:-1])


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, and the group of equal rows of each place in it; a key refines equal runs alone."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.r_[False, words[order[1:], 0] != words[order[:-1], 0]]) if len(order) else order
    for key in words.T[1:]:
        same = np.r_[False, group[1:] == group[:-1]]
        tied = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(tied):
            break
        within = np.lexsort((key[order[tied]], group[tied]))
        order[tied] = order[tied][within]
        split = np.zeros(len(order), bool)
        split[1:] = (group[1:] != group[:-1]) | (key[order[1:]] != key[order[:-1]]) & same[1:]
        group = np.cumsum(split)
    return order, group


def answer_suffixes(key: tuple, asks: pd.DataFrame) -> pd.DataFrame:
    """For each context a bit a string: whether a smaller id holds the string.

    Equal contexts of several groups are sorted together first; their strings are sorted once.
    """
    n = asks.n.to_numpy()
    rows = np.frombuffer(b"".join(map(unpacked, asks.x0)), np.uint8).reshape(-1, 2 + CONTEXT)
    ids = np.frombuffer(b"".join(map(unpacked, asks.x1)), "<i8")
    order, group = multikey_order(words_of(rows))
    own = np.empty(len(rows), np.int64)
    own[order] = group
    rows = rows[order[np.r_[True, group[1:] != group[:-1]]]]
    smallest = np.full(len(rows), LAST_ID)
    np.minimum.at(smallest, own, ids)
    masks = np.zeros(len(own), np.uint32)
    for place in range(BEFORE + 1):
        masks |= (string_minima(rows, smallest, place)[own] < ids).astype(np.uint32) << np.uint32(place)
    return pd.DataFrame({"gid": asks.gid, "level": 2, "bucket": int(key[0]), "reply": [m.astype("<u4").tobytes() for m in np.split(masks, np.cumsum(n)[:-1])]})


def string_minima(rows: np.ndarray, ids: np.ndarray, place: int) -> np.ndarray:
    """For each context the smallest id that holds its string at `place`; LAST_ID where none starts.

    Equal strings have their anchor at equal places, so no other place need be compared.
    """
    least, has = np.full(len(rows), LAST_ID), np.flatnonzero((rows[:, 0] <= place) & (place <= rows[:, 1]))
    if len(has):
        order, group = multikey_order(words_of(rows[has, 2 + place : 2 + place + LENGTH]))
        best = np.full(int(group[-1]) + 1, LAST_ID)
        np.minimum.at(best, group, ids[has[order]])
        least[has[order]] = best[group]
    return least


def sampled(docs: DataFrame) -> np.ndarray:
    """Leading bytes of one suffix of each of at most about SAMPLE rows, drawn by hash; rows that repeat are drawn one by one."""
    raw, h, size = F.encode("text", "UTF-8"), F.xxhash64("doc_id", "text"), F.octet_length("text")
    every = -(-docs.count() // SAMPLE) or 1
    lead = docs.filter((size > LEAD) & (F.pmod(F.xxhash64(h, F.monotonically_increasing_id()), F.lit(every)) == 0)).select(F.substring(raw, (F.pmod(F.xxhash64(h), size - LEAD) + 1).cast("int"), F.lit(LEAD)).alias("lead"))
    return np.array([bytes(x) for x in lead.toPandas().lead], f"S{LEAD}")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (binary), starts and ends (removed runs, in bytes of the text)."""
    rows, partitions, n_bytes = grouped(docs)
    buckets = max(12, n_bytes // 10 // QUESTIONS)
    dealer = Dealer(sampled(docs.select("doc_id", text_of().alias("text"))), max(12, n_bytes // BUCKET_BYTES))

    def ask_anchors(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return ask_repeated(anchors(parts_of(group), buckets), int(key[0]))

    def ask_suffixes(key: tuple, group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = parts_of(group)
        return Suffixes(parts, anchors(parts, buckets), replies, dealer).sent(int(key[0]))

    def finish(key: tuple, group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = parts_of(group)
        found = Suffixes(parts, anchors(parts, buckets), replies[replies.level == 1], dealer)
        out = []
        for part, pick, own in zip(parts, found.picks, found.masks(replies[replies.level == 2])):
            lo, count = part.lo[pick], part.hi[pick] - part.lo[pick] + 1
            owner = np.repeat(np.arange(len(pick)), count)
            begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + lo[owner]
            begin = begin[(own[owner] >> (begin - part.at[pick][owner] + BEFORE).astype(np.uint32) & 1).astype(bool)]
            edge = np.zeros(len(part.bytes) + 1, np.int32)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for a, n in zip(part.start.tolist(), part.size.tolist()):
                mine = gone[a : a + n]
                turn = np.flatnonzero(np.diff(np.r_[0, mine.view(np.int8), 0])) if mine.any() else np.zeros(0, np.int64)
                out.append((n, part.bytes[a : a + n][~mine].tobytes(), turn[::2], turn[1::2]))
        return pd.DataFrame(out, columns=["n_bytes", "kept", "starts", "ends"]).assign(doc_id=group.doc_id.astype("Int64").array)

    def met(replies: DataFrame, step, schema: str) -> DataFrame:
        return rows.groupBy("gid").cogroup(replies.repartition(partitions, "gid").groupBy("gid")).applyInPandas(step, schema)

    first = answered(rows.groupBy("gid").applyInPandas(ask_anchors, ASK), repeated(1), buckets)
    second = answered(met(first, ask_suffixes, ASK), answer_suffixes, dealer.buckets)
    return met(first.unionByName(second), finish, "n_bytes long, kept binary, starts array<long>, ends array<long>, doc_id long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    got = suffix_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
