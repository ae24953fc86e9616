"""Exact removal of repeated word windows by level-wise doubling.

Windows of 13, 25 and 50 words: only what repeats in two documents at one length is extended to
twice that length (13 + 13 sharing a word, 25 + 25), until the windows of LENGTH = 50 that are
left are asked for the smallest document that holds them. At the first length it is enough to
look at the least of the 13 windows inside each window of 25. A word goes if a window of 50
over it also starts in a document with a smaller doc_id.

The two filtering levels compare 64-bit hashes, where a collision only lets a window pass. At the
last level windows are compared by 128-bit BLAKE2 digests of their words' bytes, which nobody can
make collide.

Defined cases: null and blank texts have no words; texts under 50 words stay whole; rows that
repeat a doc_id count as one document and never remove from each other; null ids come last;
empty tables give empty results; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table
from .rounds import ASK, QUESTIONS, Asked, answered, ask_repeated, byte_values, grouped, ids_of, least_at, prefixes, repeated, spans_hash, windows_hash

LENGTH, HALF, QUARTER = 50, 25, 13


class Part:
    """Some documents' words in one array, and their windows' hashes."""

    def __init__(self, raws: list[bytes], ids: np.ndarray):
        # A space ends each document, so words never run on.
        raw = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
        size = np.array([len(r) + 1 for r in raws], np.int64)
        blank = (raw == 32) | (raw >= 9) & (raw <= 13)
        before = np.r_[True, blank[:-1]]
        start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        self.raws, self.bytes, self.blank, self.lens = raws, raw, blank, end - start
        stop = np.cumsum(size)
        self.n = np.diff(np.searchsorted(start, np.r_[0, stop]))
        self.first = np.cumsum(self.n) - self.n
        words = spans_hash(prefixes(byte_values(raw)), start, end)
        self.prefix = prefixes(words)
        self.left = np.repeat(self.n, self.n) - (np.arange(len(words)) - np.repeat(self.first, self.n))
        self.ids = np.repeat(ids, self.n)
        self.quarter = windows_hash(self.prefix, QUARTER)
        self.pick = least_at(self.quarter, HALF - QUARTER + 1)
        self.halves = np.flatnonzero(self.left >= HALF)
        self.seen = np.unique(self.pick[self.halves])

    def digests(self, k: np.ndarray) -> np.ndarray:
        """(n, 2) words of the digests of the windows of LENGTH words that start at the words k."""
        if not len(k):
            return np.zeros((0, 2), np.uint64)
        joined = np.full(int(self.lens.sum()) + len(self.lens), 32, np.uint8)
        own = np.repeat(np.arange(len(self.lens)), self.lens)
        joined[np.arange(len(own)) + own] = self.bytes[~self.blank]
        stop = np.cumsum(self.lens + 1) - 1
        text, begin, end = joined.tobytes(), (stop - self.lens)[k].tolist(), stop[k + LENGTH - 1].tolist()
        return np.frombuffer(b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin, end)]), "<u8").reshape(-1, 2)


def parts_of(docs: pd.DataFrame) -> list[Part]:
    raws, ids, at, out = [t.encode() for t in docs.text], ids_of(docs), 0, []
    for run in portions(raws, 2_000_000):
        out.append(Part(run, ids[at : at + len(run)]))
        at += len(run)
    return out


def _asked(pairs: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> Asked:
    h, ids = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Asked(h, ids, buckets)


def _by_part(values: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1])


def quarters(parts: list[Part], buckets: int) -> Asked:
    return _asked([(p.quarter[p.seen], p.ids[p.seen]) for p in parts], buckets)


def halves(parts: list[Part], replies: pd.DataFrame, buckets: int) -> tuple[list[np.ndarray], Asked]:
    """Windows of 25 words whose least window of 13 repeats: their places by part, and the questions."""
    asked = quarters(parts, buckets)
    yes = asked.replied(replies[replies.level == 1], "bit")[asked.of]
    places = []
    for part, own in zip(parts, _by_part(yes, [len(p.seen) for p in parts])):
        flag = np.zeros(len(part.left) + 1, bool)
        flag[part.seen] = own
        places.append(part.halves[flag[part.pick[part.halves]]])
    return places, _asked([(spans_hash(p.prefix, k, k + HALF), p.ids[k]) for p, k in zip(parts, places)], buckets)


def wholes(parts: list[Part], replies: pd.DataFrame, buckets: int) -> tuple[list[np.ndarray], Asked, np.ndarray]:
    """Windows of 50 words of which both halves repeat, and their digests."""
    at, asked = halves(parts, replies, buckets)
    yes = asked.replied(replies[replies.level == 2], "bit")[asked.of]
    places = []
    for part, own, k in zip(parts, _by_part(yes, [len(a) for a in at]), at):
        flag = np.zeros(len(part.left) + HALF + 1, bool)
        flag[k] = own
        k = k[own & (part.left[k] >= LENGTH)]
        places.append(k[flag[k + HALF]])
    digests = np.concatenate([p.digests(k) for p, k in zip(parts, places)]) if parts else np.zeros((0, 2), np.uint64)
    ids = np.concatenate([p.ids[k] for p, k in zip(parts, places)]) if parts else np.zeros(0, np.int64)
    return places, Asked(digests[:, 0], ids, buckets, exact=digests), digests


def answer_smaller(key: tuple, asks: pd.DataFrame) -> pd.DataFrame:
    """A bit a window: whether another group holds it in a document with a smaller id."""
    n = asks.n.to_numpy()
    h, ids = np.frombuffer(b"".join(asks.x0), "<u8").reshape(-1, 2), np.frombuffer(b"".join(asks.x1), "<i8")
    order = np.lexsort((ids, h[:, 1], h[:, 0]))
    new = np.r_[True, (h[order][1:] != h[order][:-1]).any(axis=1)]
    least = ids[order][new]
    said = np.empty(len(h), bool)
    said[order] = least[np.cumsum(new) - 1] < ids[order]
    return pd.DataFrame({"gid": asks.gid, "level": 3, "bucket": int(key[0]), "reply": [np.packbits(x).tobytes() for x in np.split(said, np.cumsum(n)[:-1])]})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    rows, parts_, n_bytes = grouped(docs)
    buckets = max(12, n_bytes // 30 // QUESTIONS)

    def ask_quarters(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return ask_repeated(quarters(parts_of(group), buckets), int(key[0]))

    def ask_halves(key: tuple, group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        return ask_repeated(halves(parts_of(group), replies, buckets)[1], int(key[0]))

    def ask_wholes(key: tuple, group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        _, asked, digests = wholes(parts_of(group), replies, buckets)
        got = asked.sent(lambda p: digests[asked.pick[p]].astype("<u8").tobytes(), lambda p: asked.least[p].astype("<i8").tobytes())
        return pd.DataFrame(got | {"gid": int(key[0])})[["bucket", "gid", "n", "x0", "x1"]]

    def finish(key: tuple, group: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = parts_of(group)
        places, asked, _ = wholes(parts, replies, buckets)
        smaller = asked.replied(replies[replies.level == 3], "bit")
        out, at = [], 0
        for part, k in zip(parts, places):
            of, at = asked.of[at : at + len(k)], at + len(k)
            k = k[smaller[of] | (part.ids[k] > asked.least[of])]
            edge = np.zeros(len(part.left) + 1, np.int32)
            np.add.at(edge, k, 1)
            np.add.at(edge, k + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for raw, a, n in zip(part.raws, part.first.tolist(), part.n.tolist()):
                mine = gone[a : a + n]
                words = raw.split()
                kept = [w for w, g in zip(words, mine.tolist()) if not g] if mine.any() else words
                out.append((n, n - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"]).assign(doc_id=group.doc_id.astype("Int64").array)

    def met(replies: DataFrame, step, schema: str) -> DataFrame:
        return rows.groupBy("gid").cogroup(replies.repartition(parts_, "gid").groupBy("gid")).applyInPandas(step, schema)

    first = answered(rows.groupBy("gid").applyInPandas(ask_quarters, ASK), repeated(1), buckets)
    second = answered(met(first, ask_halves, ASK), repeated(2), buckets)
    third = answered(met(first.unionByName(second), ask_wholes, ASK), answer_smaller, buckets)
    replies = first.unionByName(second).unionByName(third)
    return met(replies, finish, "n_words long, n_removed long, kept string, doc_id long")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
