"""Question rounds between groups of documents and buckets of hashes.

Documents are dealt to groups of about GROUP_BYTES. In a round, each group sends every distinct
hash it asks about once, to the bucket of the hash, whatever the number of documents that share
it; buckets gather what the groups sent and reply to each group in the order it asked. A group
finds its order again from its documents, so a reply is a bit or a few bytes a question. A hash
that all documents share thus costs a bucket one entry a group. The documents' own shuffle is the
same subplan in all rounds, which Spark runs once. Hashes of windows only filter (equal windows have
equal hashes); what is removed is decided by the bytes, or by 128-bit digests of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards, tasks, text_of, total_bytes

GROUP_BYTES = 12 << 20
QUESTIONS = 2_000_000
LAST_ID = np.iinfo(np.int64).max
#: Seeds the tables below; equal on all workers.
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(int(_RNG.integers(2**62, 2**63)) | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 20), b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _POWERS


def prefixes(values: np.ndarray) -> np.ndarray:
    """Sums of values times powers; windows' polynomial hashes are differences of two."""
    return np.r_[np.uint64(0), np.cumsum(values * powers(len(values))[0][: len(values)])]


def spans_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def windows_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Of every k values in a row."""
    n = max(0, len(prefix) - k)
    return mixed((prefix[k:] - prefix[:n]) * powers(len(prefix))[1][:n])


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


#: Places take 28 bits of a key; longer arrays are done in parts that overlap.
PLACES = 1 << 28


def least_at(h: np.ndarray, w: int, most: int = PLACES) -> np.ndarray:
    """The place of the least of each w hashes in a row, leftmost of equals (36 bits decide)."""
    if len(h) > most:
        step = most - w + 1
        return np.concatenate([least_at(h[at : at + most], w, most) + at for at in range(0, len(h) - w + 1, step)])
    key = (h >> np.uint64(28) << np.uint64(28)) | np.arange(len(h), dtype=np.uint64)
    step, n = 1, max(0, len(h) - w + 1)
    while 2 * step <= w:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    return (np.minimum(key[:n], key[w - step : w - step + n]) & np.uint64(PLACES - 1)).astype(np.int64)


def grouped(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(gid, doc_id, text), one partition a group or few, the number of partitions, and the bytes of all texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n_bytes = total_bytes(rows)
    n = shards(n_bytes, GROUP_BYTES)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("gid"), "doc_id", "text").repartition(tasks(n), "gid"), tasks(n), n_bytes


def answered(asks: DataFrame, answer, buckets: int) -> DataFrame:
    """The replies of all buckets; partitions follow their number, so tasks keep their size."""
    return asks.repartition(tasks(buckets), "bucket").groupBy("bucket").applyInPandas(answer, REPLY)


def ids_of(docs: pd.DataFrame) -> np.ndarray:
    """Null ids come after all others, and as one document."""
    return docs.doc_id.astype("Int64").fillna(LAST_ID).to_numpy(np.int64)


class Asked:
    """The distinct questions of a group, dealt to buckets; `least` is each one's smallest id.

    Equal hashes are one question, or, where `exact` rows are given, equal hashes of equal rows are.
    Questions stand in a bucket in the order of `by` (by default that of their hashes).
    """

    def __init__(self, h: np.ndarray, ids: np.ndarray, buckets: int, bucket_of: Callable | None = None, exact: np.ndarray | None = None, by: Callable | None = None):
        order = np.lexsort((ids, h))
        hs, ds = h[order], ids[order]
        new = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.zeros(0, bool)
        if exact is not None and len(hs):
            new[1:] |= (exact[order[1:]] != exact[order[:-1]]).any(axis=1)
        first = np.flatnonzero(new)
        self.hash, self.least, self.pick = hs[first], ds[first], order[first]
        self.many = ds[np.r_[first[1:], len(hs)] - 1] != self.least if len(hs) else np.zeros(0, bool)
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        bucket = bucket_of(self.pick) if bucket_of else ((self.hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((*by(self.pick), bucket)) if by else np.argsort(bucket, kind="stable")
        self.bucket, at = np.unique(bucket[self.order], return_index=True)
        self.parts = [self.order[a:b] for a, b in zip(at, np.r_[at[1:], len(self.order)])]

    def sent(self, *columns: Callable[[np.ndarray], bytes]) -> dict:
        return {"bucket": self.bucket, "n": [len(p) for p in self.parts]} | {f"x{i}": [f(p) for p in self.parts] for i, f in enumerate(columns)}

    def replied(self, replies: pd.DataFrame, dtype: str) -> np.ndarray:
        """The replies in the order of `hash`; dtype 'bit' for packed bits."""
        out = np.zeros(len(self.hash), bool if dtype == "bit" else dtype)
        got = dict(zip(replies.bucket, replies.reply))
        for b, part in zip(self.bucket.tolist(), self.parts):
            out[part] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=len(part)).view(bool) if dtype == "bit" else np.frombuffer(got[b], dtype)
        return out


def low(h: np.ndarray) -> bytes:
    """The low four bytes; a bucket of QUESTIONS hashes has few false hits, and only filters rely on them."""
    return h.astype("<u4").tobytes()


def packed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


ASK = "bucket long, gid long, n long, x0 binary, x1 binary"
REPLY = "gid long, level long, bucket long, reply binary"


def repeated(level: int):
    """Replies a bit a hash: whether two documents hold it."""

    def answer(key: tuple, asks: pd.DataFrame) -> pd.DataFrame:
        n = asks.n.to_numpy()
        h = np.frombuffer(b"".join(asks.x0), "<u4")
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(asks.x1, n)]).astype(bool)
        order = np.argsort(h)
        hs = h[order]
        new = np.r_[True, hs[1:] != hs[:-1]]
        group = np.cumsum(new) - 1
        yes = (np.bincount(group) > 1) | (np.bincount(group, weights=many[order]) > 0)
        said = np.empty(len(h), bool)
        said[order] = yes[group]
        return pd.DataFrame({"gid": asks.gid, "level": level, "bucket": int(key[0]), "reply": [np.packbits(x).tobytes() for x in np.split(said, np.cumsum(n)[:-1])]})

    return answer


def ask_repeated(asked: Asked, gid: int) -> pd.DataFrame:
    got = asked.sent(lambda p: low(asked.hash[p]), lambda p: np.packbits(asked.many[p]).tobytes())
    return pd.DataFrame(got | {"gid": gid})[["bucket", "gid", "n", "x0", "x1"]]
