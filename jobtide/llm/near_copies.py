"""Groups of near copies: five-word shingle sets of Jaccard similarity LEAST or more, by SimHash and MinHash candidates.

Shingles: A-Z lower-cased, words, every five in a row, as a set; a text of fewer words is one
shingle. Equal texts are one node. Every candidate is judged by its exact similarity, so no pair below LEAST is linked.

SimHash: a 64-bit fingerprint of the shingles, repeats included. Nodes of one fingerprint are candidates of the least
of them, and fingerprints that differ by at most simhash.LIMIT bits meet by their one-bit-deleted halves (`simhash.links`).
At 0.8 two fingerprints differ by about 10 bits, which no such index reaches, so for the copies that differ
by more, nodes that share one of BANDS keys, each made of ROWS MinHash values, are candidates too: a pair at
similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8.

Nodes that share a key are first judged against the least of them only. Keys whose nodes are not all connected then stay
open. A node of which too few shingles stand in another open text to reach LEAST with any is left out. The others are
judged against their key's lead, the node whose shingles are the most common, and what they differ from it in (D, the
shingles of one of both alone) finds all that is left: with X = 9 |D| - |text|, two texts are similar exactly if 18 times
what their D share is X + X or more. Nodes similar to the lead (X at most its size) are connected through it. Of
any other pair one is far from the lead, so both must share a part of D that is known beforehand, and
hence one of its first shingles in any fixed order (prefix filter). These meet in an equality join; no
pairs of a group are formed for sharing a key. How many rows that join makes depends on how much the D have in
common, not on the square of the group.

Keys and shingles are exploded from arrays, which Spark sizes as if they held one entry, and texts are larger than their
compressed files; joins of them are by sorting, so none is broadcast for a size taken too low.

Defined cases: null and blank texts have no shingle and are copies of each other; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, text_of, tidy, written
from .components import components
from .rounds import mixed
from .simhash import LOWER, links, voted

SHINGLE = 5
#: Least similarity, as a fraction of two whole numbers, so that no rounding decides.
LEAST = (4, 5)
BANDS, ROWS = 16, 4
_ODD = np.random.default_rng(20240301).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()  # bytes split at the space and 0x09-0x0D


def shingles(text: str) -> set:
    words = words_of(text)
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def grams_of(text: str) -> np.ndarray:
    """A 64-bit hash of each shingle, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words_of(text)], np.uint64)
    parts = [h[i : max(len(h) - SHINGLE + 1, 0) + i] for i in range(SHINGLE)] if len(h) > SHINGLE else [h[i : i + 1] for i in range(len(h))]
    grams = np.zeros(len(parts[0]) if parts else 0, np.uint64)
    for part in parts:
        grams = mixed(grams + part)
    return grams


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys and a fingerprint a text."""
    hashes, sizes = [], []
    for text in texts:
        hashes.append(grams_of(text))
        sizes.append(len(hashes[-1]))
    size = np.array(sizes, np.int64)
    out = np.zeros((len(texts), BANDS), np.uint64)
    some = np.flatnonzero(size)
    grams = np.concatenate([np.zeros(0, np.uint64), *hashes])
    if len(some):
        at = (np.cumsum(size) - size)[some]
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for odd in _ODD[band * ROWS : (band + 1) * ROWS]:
                x = grams * odd
                key = mixed(key + np.minimum.reduceat(x ^ (x >> np.uint64(32)), at))
            out[some, band] = key
    return out, voted(grams, size)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _nodes(docs: DataFrame) -> DataFrame:
    """(node, digest, id, keys, fp) of each distinct text; nodes are numbers, id is the least doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, prints = [], []
            for p in portions(batch.text.tolist(), 1_000_000):
                k, f = keys_of(p)
                keys += list(k.view(np.int64))
                prints += f.view(np.int64).tolist()
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "digest": batch.digest, "keys": keys, "fp": np.array(prints, np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"), text_of().alias("text"))
    keyed = rows.mapInPandas(tidy(run), "doc_id long, digest binary, keys array<long>, fp long")
    texts = keyed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    return written(texts.select(F.monotonically_increasing_id().alias("node"), "digest", "id", "keys", "fp"), "near")


def _printed(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) by SimHash: nodes of one fingerprint with the least of them, and the least of near fingerprints."""
    classes = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near")
    same = nodes.select("node", "fp").join(classes, "fp").filter(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return same.unionByName(links(classes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, set()
        for batch in batches:
            good = []
            for a, x, y in zip(batch.a, batch.x, batch.y):
                if a != last:
                    last, own = a, shingles(x)
                good.append(similar(own, shingles(y)))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return written(_both(pairs, texts).mapInPandas(tidy(run), "a long, b long"), "near")


def _both(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, x, y): the pairs with their texts."""
    one, two = (texts.select(F.col("node").alias(f"{s}_node"), F.col("text").alias(t)) for s, t in (("a", "x"), ("b", "y")))
    return pairs.join(two.hint("merge"), F.col("b") == F.col("b_node")).join(one.hint("merge"), F.col("a") == F.col("a_node")).select("a", "b", "x", "y")


def unlike(lead: set, own: set) -> tuple[int, int, int, list[int]]:
    """(size of D, X, tight, first hashes of D) of a text against its lead; `tight` of them are for partners far from the lead.

    D is in a fixed order: what the lead has not, which is mostly rare, goes first, each part by its hash.
    """
    import xxhash

    more = own - lead
    size = 2 * len(more) + len(lead) - len(own)
    x, lead_size = 9 * size - len(own), len(lead)
    # Of D are shared: with a far text at least (x + lead_size + 1) / 18; a far one shares with a near one at least (x - lead_size) / 18.
    tight = max(0, size + 1 - -(-(x + lead_size + 1) // 18))
    most = size + 1 - -(-(x - lead_size) // 18) if x > lead_size else tight
    kept: list[int] = []
    for part in (more, lead - own):
        if len(kept) < most:
            kept += sorted(xxhash.xxh64_intdigest(b" ".join(g)) - 2**63 for g in part)
    return size, x, tight, kept[: max(0, most)]


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, near, size, x, tight, first) of pairs of a lead a and a text b: `near` if similar, the rest as in `unlike`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, lead = None, set()
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.a, batch.b, batch.x, batch.y):
                if a != last:
                    last, lead = a, shingles(x)
                own = shingles(y)
                rows.append((a, b, similar(lead, own), *unlike(lead, own)))
            yield pd.DataFrame(rows, columns=["a", "b", "near", "size", "x", "tight", "first"])

    kind = "a long, b long, near boolean, size long, x long, tight long, first array<long>"
    return written(_both(pairs, texts).mapInPandas(tidy(run), kind), "near")


def _left(compared: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates (a, b), not connected yet, of which one at least is far from a lead that both were compared with."""
    own = compared.join(roots.withColumnRenamed("node", "of"), F.col("b") == F.col("of"), "left").select("a", "b", "near", "size", "x", "tight", F.coalesce("root", "b").alias("root"), F.posexplode("first").alias("place", "gram"))
    own = own.withColumn("tight", F.col("place") < F.col("tight"))
    far, all_ = (own.select(F.col("a").alias("lead"), "gram", *(F.col(k).alias(f"{n}_{k}") for k in ("b", "near", "size", "x", "tight", "root"))) for n in "ab")
    # Two far texts meet once, by shingles that are among the first of both.
    once = F.col("b_near") | ((F.col("a_b") < F.col("b_b")) & F.col("a_tight") & F.col("b_tight"))
    able = 18 * F.least("a_size", "b_size") >= F.col("a_x") + F.col("b_x")
    met = far.filter(~F.col("a_near")).hint("merge").join(all_.hint("merge"), ["lead", "gram"]).filter((F.col("a_root") != F.col("b_root")) & once & able)
    return met.select(F.least("a_b", "b_b").alias("a"), F.greatest("a_b", "b_b").alias("b")).distinct()


def _shared(texts: DataFrame) -> DataFrame:
    """(of, size, shared, common) of each text: its different shingles, how many of them stand in another of the texts, and how common they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch[at : at + 256]
                yield pd.DataFrame({"of": part.node, "grams": [np.unique(grams_of(t)).view(np.int64) for t in part.text]})

    grams = texts.mapInPandas(tidy(run), "of long, grams array<long>").select("of", F.explode_outer("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.col("gram").alias("common"), "n")
    met = grams.join(often.hint("merge"), F.col("gram") == F.col("common"), "left")
    return written(met.groupBy("of").agg(F.count("gram").alias("size"), F.count("common").alias("shared"), F.round(F.avg(F.log(F.coalesce("n", F.lit(1)))), 6).alias("common")), "near")


def near_copies(docs: DataFrame) -> DataFrame:
    """(digest, id, root) of every distinct text; root is the same number in a group of near copies."""
    nodes = _nodes(docs)
    index = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = index.groupBy("band", "key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    met = written(index.join(shared.hint("merge"), ["band", "key"]), "near")
    keyed = met.filter(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    first = written(_printed(nodes).unionByName(keyed).distinct(), "near")

    # One text for each node that meets another; copies combine before the shuffle.
    wanted = met.select("node").union(first.select("a")).union(first.select("b")).distinct().join(nodes.select("node", "digest"), "node")
    texts = docs.select(digest_of(text_of()).alias("digest"), text_of().alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    texts = written(texts.join(wanted, "digest").select("node", "text"), "near")

    found = _judged(first, texts)
    roots = components(found)
    open_ = met.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    split = open_.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter(F.col("low") < F.col("high")).select("band", "key")
    open_ = written(open_.join(split, ["band", "key"]), "near")
    counts = _shared(texts.join(open_.select(F.col("node").alias("of")).distinct(), F.col("node") == F.col("of"), "left_semi"))
    # One more than counted, so that hashes that collide drop no pair.
    most, sizes = F.col("shared") + 1, F.col("size") + F.col("shared")
    able = open_.join(counts, F.col("node") == F.col("of")).filter(most * LEAST[1] >= (sizes - most) * LEAST[0])
    leads = able.groupBy("band", "key").agg(F.max(F.struct("common", "node")).alias("lead")).select("band", "key", F.col("lead.node").alias("a"))
    second = able.select("band", "key", F.col("node").alias("b")).join(leads, ["band", "key"]).filter(F.col("a") != F.col("b")).select("a", "b").distinct()
    compared = _compared(second, texts)
    found = written(found.unionByName(compared.filter("near").select("a", "b")), "near")
    rest = _left(compared, components(found)).join(first, ["a", "b"], "left_anti")
    roots = components(found.unionByName(_judged(rest, texts)))
    return nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
