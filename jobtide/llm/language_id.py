"""Language identification by sparse multinomial logistic regression on character n-grams.

Features: TF-IDF of hashed 1- to 3-grams of the lower-cased text in which every run of other
characters is one space; the term frequency is the share among the text's n-grams. Document
frequencies come from all learning rows. Weights come from follow-the-regularised-leader with
elastic-net penalties on a sample of at most SAMPLE labelled rows, those with the smallest
hashes of their ids and texts (rows that repeat both count once), a fifth of which is kept for
temperature calibration: the temperature of the least loss against smoothed labels, so a sample
that is told apart without error does not ask for certainty. The sample's features (not its
texts) and SLOTS document frequencies come to the driver, both bounded.

Defined cases: null text, or a text without a letter, is `und` with score 0; rows with a null
lang are predicted and never learned from; without any learning row all is `und`; null ids count
as not held out by a CRC of the text 'null' and keep a row each, as repeated rows do; empty
tables give empty results; languages of equal score go by name; very long texts are read whole;
extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, tidy

SLOTS = 1 << 16
SAMPLE = 3000
UNKNOWN = "und"
#: L1 leaves about one weight in seven of the n-grams seen.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.1, 1e-3
#: Updates of the weights: three passes over a full sample, more over a smaller one.
STEPS = 7200


class Hasher:
    """Slots of the n-grams of a text."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        keep = self.letter[codes]
        if not keep.any():
            return None
        codes = np.where(keep, codes, 32)
        codes = codes[keep | np.r_[True, keep[:-1]]]
        codes = np.r_[np.uint32(32), codes, np.uint32(32)].astype(np.uint32)
        one = codes * np.uint32(2654435761)
        two = (one[:-1] ^ (codes[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (codes[2:] * np.uint32(668265263))) * np.uint32(374761393)
        return np.concatenate([one >> np.uint32(16), (two ^ two >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(16), (three ^ three >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(16)])


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % 3 == 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each slot, and how many there are; SLOTS numbers whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, df, n = Hasher(), np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for text in batch.text:
                slots = hasher(text)
                if slots is not None:
                    seen = np.zeros(SLOTS + 1, bool)
                    seen[slots] = True
                    df += seen
                    n += 1
        df[SLOTS] = n
        used = np.flatnonzero(df)
        yield pd.DataFrame({"slot": used, "n": df[used]})

    rows = texts.mapInPandas(tidy(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SLOTS + 1, np.int64)
    df[rows.slot.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return df[:SLOTS], int(df[SLOTS])


def sampled(rows: DataFrame, n: int = SAMPLE) -> pd.DataFrame:
    """(lang, slots, share) of the n rows with the smallest hashes of id and text; n at most, however often rows repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            out = []
            for lang, text in zip(batch.lang, batch.text):
                slots = hasher(text)
                if slots is not None:
                    own, count = np.unique(slots, return_counts=True)
                    out.append((lang, own.astype(np.int32).tobytes(), (count / len(slots)).astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "slots", "share"])

    # Hashes alone are ordered; n of them, a fixed bound, are then broadcast to fetch their texts.
    keyed = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    chosen = keyed.select("order").distinct().orderBy("order").limit(n)
    few = keyed.join(F.broadcast(chosen), "order", "left_semi").groupBy("order").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.lang", "row.text")
    got = few.mapInPandas(tidy(run), "lang string, slots binary, share binary").toPandas()
    return got.sort_values(["lang", "slots", "share"], ignore_index=True)


def fit(sample: pd.DataFrame, idf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights (SLOTS x languages, IDF folded in), biases, temperature."""
    langs = sorted(set(sample.lang))
    k = len(langs)
    if not k:
        return [], np.zeros((SLOTS, 0), np.float32), np.zeros(0, np.float32), 1.0
    data = []
    for lang, slots, share in zip(sample.lang, sample.slots, sample.share):
        s = np.frombuffer(slots, np.int32)
        data.append((langs.index(lang), s, np.frombuffer(share, np.float32) * idf[s]))
    rng = np.random.default_rng(7)
    data = [data[i] for i in rng.permutation(len(data))]
    kept, learned = data[: len(data) // 5], data[len(data) // 5 :]
    z, n, w = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))
    turns = np.concatenate([rng.permutation(len(learned)) for _ in range(-(-STEPS // len(learned)))])
    for i in turns[:STEPS]:
        y, s, v = learned[i]
        s, v = np.append(s, SLOTS), np.append(v, 1.0)
        zz, nn = z[s], n[s]
        ww = np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2), 0)
        p = np.exp((o := v @ ww) - o.max())
        p /= p.sum()
        p[y] -= 1
        g = v[:, None] * p
        z[s] = zz + g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA * ww
        n[s] = nn + g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)
    logits = np.array([v @ w[s] + w[SLOTS] for _, s, v in kept]).reshape(-1, k)
    truth = np.array([y for y, _, _ in kept], int)

    slack = 1 / (len(kept) + 2)
    goal = np.full(logits.shape, slack / max(1, k - 1))
    goal[np.arange(len(truth)), truth] = 1 - slack if k > 1 else 1

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.log(np.exp(x).sum(axis=1)).sum() - (goal * x).sum())

    temperature = min(np.geomspace(1e-3, 1e2, 251), key=loss) if len(kept) else 1.0
    return langs, (w[:SLOTS] * idf[:, None]).astype(np.float32), w[SLOTS].astype(np.float32), float(temperature)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """A model from text and non-null lang of the rows that are not held out."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text")).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    return fit(sampled(rows), idf)


def judged(texts, hasher: Hasher, model: tuple[list[str], np.ndarray, np.ndarray, float]) -> list[tuple[str, float]]:
    langs, w, bias, t = model
    columns = [np.ascontiguousarray(w[:, j]) for j in range(len(langs))]
    out = []
    for text in texts:
        slots = hasher(text) if langs else None
        if slots is None:
            out.append((UNKNOWN, 0.0))
            continue
        x = (np.array([c[slots].mean(dtype=np.float64) for c in columns]) + bias) / t
        p = np.exp(x - x.max())
        out.append((langs[int(p.argmax())], float(p.max() / p.sum())))
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, lang_pred, score; the model is SLOTS x languages numbers, shared by broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            yield pd.DataFrame(judged(batch.text, hasher, shared.value), columns=["lang_pred", "score"]).assign(doc_id=batch.doc_id.astype("Int64").array)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(tidy(run), "lang_pred string, score double, doc_id long")


def annotate(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, float], lang_col: str, score_col: str) -> DataFrame:
    """All columns of docs and the prediction, without a join; the text travels once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "lang_pred string, score double"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for texts in batches:
            yield pd.DataFrame(judged(texts, hasher, shared.value), columns=["lang_pred", "score"])

    # Else a filter on what it gives would judge every text a second time, in workers of its own.
    judge = F.pandas_udf(tidy(run), schema).asNondeterministic()
    return docs.withColumn("_judged", judge(text_of())).withColumns({lang_col: F.col("_judged.lang_pred"), score_col: F.col("_judged.score")}).drop("_judged")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
