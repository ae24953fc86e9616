"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints: A-Z lower-cased, words, three-word shingles with repeats, XXH64 (seed 42) of each;
a bit is set if it is set in over half of the hashes. Equal fingerprints form a class. To link
classes at LIMIT = 3 or fewer differing bits, a fingerprint is cut into two halves: one of them
then differs by at most one bit. So each half is indexed under its 32 variants with one bit
deleted, variants meet in an equality join, and the join verifies the whole distance. A pair is
taken from one variant alone (the low half if that differs by at most one bit, and the deleted
bit that differs, or bit 0), so no pair comes twice. Components come from the links.

Defined cases: null and blank texts have fingerprint zero and are linked like any other; texts
of one or two words have one shingle; repeated rows keep a row each; rows with a null id belong
to their class but never name a component (a component of null ids alone has a null id); empty
tables give empty results; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, text_of, tidy, written
from .components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LIMIT = 3
#: Hashes whose bits are spread at once.
VOTES = 1 << 18


def voted(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of `size` hashes: the bits set in over half of them; bits are spread a part at a time."""
    votes, owner = np.zeros((len(size), 64), np.int64), np.repeat(np.arange(len(size)), size)
    for at in range(0, len(hashes), VOTES):
        part = owner[at : at + VOTES]
        bits = np.unpackbits(hashes[at : at + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        votes[part[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint_texts(texts: list[str], shingle: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    import xxhash

    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.encode().translate(LOWER).split()  # bytes split at the space and 0x09-0x0D
        if len(words) <= shingle:
            grams = [b" ".join(words)] if words else []
        else:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(hashes)
        hashes.extend([digest(g, 42) for g in grams])
        sizes.append(len(hashes) - n)
    size = np.array(sizes, np.int64)
    return voted(np.array(hashes, np.uint64), size)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long), the unsigned fingerprint's bits in a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [fingerprint_texts(p) for p in portions(batch.text.tolist(), 1_000_000)]
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "fp": np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(tidy(run), "doc_id long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """(fp, first) of distinct fingerprints to pairs (a, b) of `first` within LIMIT bits."""
    half = lambda h: F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF))
    variants = [(F.lit(h * 32 + b).cast("long") * F.lit(1 << 32)).bitwiseOR(half(h).bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b)))) for h in (0, 1) for b in range(32)]
    index = classes.select("fp", "first", F.explode(F.array(*variants)).alias("variant"))
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    slot = F.shiftrightunsigned("l.variant", 32)
    own = lambda d, base: (slot == base) & (d == 0) | (F.bit_count(d) == 1) & (d == F.expr(f"shiftleft(1L, cast(shiftrightunsigned(l.variant, 32) as int) - {base})")) & (slot >= base) & (slot < base + 32)
    once = F.when(F.bit_count(low) <= 1, own(low, 0)).otherwise(own(high, 32))
    near = (F.col("l.variant") == F.col("r.variant")) & (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(x) <= LIMIT) & once
    # Spark sizes the index as the classes before they were exploded, and would broadcast 64 rows for each of them.
    return index.hint("merge").alias("l").join(index.hint("merge").alias("r"), near).select(F.col("l.first").alias("a"), F.col("r.first").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable) of every document."""
    prints = written(fingerprints(docs), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # A class of null ids alone still takes part: it goes by a negative number of its own.
    first = F.coalesce("least", -F.abs(F.xxhash64("fp") / 2).cast("long") - 2)
    classes = written(classes.select("fp", "least", first.alias("first")), "simhash")
    roots = components(links(classes))
    named = classes.join(roots, F.col("first") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "first").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = named.select("fp", "root").join(best, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return prints.join(whole, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
