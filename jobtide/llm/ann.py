"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector by groups of Gaussian projections. A projection's cells are its two
ends, and a group's cell is the end that the vector lies farthest out in, seen from the sample's centre; a bucket is the
row of its groups' cells. Near vectors share such an end far oftener than others do, where halves of a projection that meet at the
centre hold as many of the others, so fewer of these are seen, and their share falls faster as the table grows.
A query visits those buckets of a table whose cells have the smallest expected sum of distances
to its own farthest, which is the order of estimated success. How many it visits is
measured, not set: for TRIALS vectors of the sample the true neighbours are searched among all vectors, and the
fewest probes count that would have shown a share of RECALL of them. Candidates of all tables are merged and reranked
by exact Euclidean distance in double precision. The centre comes from a sample of at most SAMPLE
vectors (those with the smallest hashes of their ids); every vector is indexed.

Only ids and bucket numbers travel through the index: a query meets a bucket as one row with the list of its vectors, so
pairs are never rows. Candidates meet their vectors in shards of about SHARD vectors, to which a query's vector goes
once, or once for each batch of its lists.

Equal vectors enter the index once, so a very common vector fills no bucket; a class hands on
its least members, as many as a result can hold. Buckets over CHUNK vectors are dealt to
several groups, which the queries visit all. A query that finds fewer than it could is
searched again against all vectors, in blocks.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another
length than most of the sample take no part; ties go to the smaller vec_id; rows that repeat a
vec_id count once a class; rows with a null id take no part; an empty table gives an empty
result; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

TABLES, SAMPLE, CHUNK, SHARD = 24, 2000, 4096, 8192
#: Vectors of the sample whose true neighbours are searched, the share of these that the probes must show, and the most probes a table.
TRIALS, RECALL, PROBES = 128, 0.95, 8192
#: A table has the fewest groups whose cells, 2^GROUP_BITS at most, give its buckets; two at least.
GROUP_BITS = 9


def bits_for(n: int) -> float:
    """Binary digits of a table's number of buckets: as many buckets as vectors, near where probes and pairs together are fewest."""
    return float(np.log2(max(n, 500)))


def likeliest(costs: np.ndarray, n: int) -> np.ndarray:
    """(up to n, groups) places of cells, one a group, by ascending sums of the ascending costs (groups, cells).

    Costs in one dimension are those of the second cell of groups that have two.
    """
    costs = np.asarray(costs, float)
    if costs.ndim == 1:
        costs = np.stack([np.zeros(len(costs)), costs], axis=1)
    total, chosen = np.zeros(1), np.zeros((1, 0), int)
    for group in costs:
        # The n best of all groups so far start with some of the n best of those before.
        sums = (total[:, None] + group).ravel()
        best = np.argsort(sums, kind="stable")[:n]
        total, chosen = sums[best], np.column_stack([chosen[best // len(group)], best % len(group)])
    return chosen


class Hashes:
    """The tables' projections, from a bounded sample, and the order of perturbations."""

    def __init__(self, sample: np.ndarray, bits: float, probes: int = PROBES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centre, self.groups = sample.mean(axis=0), max(2, int(np.ceil(bits / GROUP_BITS)))
        size, self.n = sample.shape[1], max(1, round(2 ** (bits / self.groups) / 2))
        # Gaussian projections, made orthogonal and of one length as far as the dimensions reach, so no cell is larger than others.
        turned = [np.linalg.qr(rng.standard_normal((size, min(size, self.n - at))))[0] for _ in range(TABLES * self.groups) for at in range(0, self.n, size)]
        self.a = np.concatenate(turned, axis=1).reshape(size, TABLES, self.groups, self.n).transpose(1, 2, 0, 3)
        # The expected distance from the farthest of so many normal projections, of two sides each, to the 2nd, 3rd, ... farthest.
        drawn = rng.standard_normal((2000, self.n))
        far = -np.sort(-np.concatenate([drawn, -drawn], axis=1), axis=1).mean(axis=0)
        self.flips = likeliest(np.tile(far[0] - far, (self.groups, 1)), probes)

    def fitted(self, q: np.ndarray, x: np.ndarray, recall: float = RECALL) -> Hashes:
        """Keeps the fewest probes that show the share `recall` of the pairs q[i], x[i]; all if none suffice."""
        if len(q):
            place = {m: i for i, m in enumerate(map(tuple, self.flips.tolist()))}
            first = np.full(len(q), PROBES)
            for t in range(TABLES):
                # How many cells lie before that of x, seen from q: the perturbation that leads from q to x.
                ranks = []
                for at, of in zip(self.places(q, t), self.places(x, t)):
                    ranks.append((at > np.take_along_axis(at, of.argmax(axis=1)[:, None], axis=1)).sum(axis=1))
                first = np.minimum(first, [place.get(m, PROBES) for m in zip(*(r.tolist() for r in ranks))])
            first.sort()
            self.flips = self.flips[: int(first[int(np.ceil(recall * len(first))) - 1]) + 1]
        return self

    def places(self, x: np.ndarray, t: int) -> list[np.ndarray]:
        """For each group of a table, (n, cells): how far out the vectors lie on each side of each projection."""
        return [np.concatenate([at, -at], axis=1) for at in ((x - self.centre) @ a for a in self.a[t])]

    def _numbers(self, cells: list[np.ndarray]) -> np.ndarray:
        """A bucket's number from its cells, one a group."""
        number = np.zeros_like(cells[0], dtype=np.int64)
        for cell in cells:
            number = number * 2 * self.n + cell
        return number

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(n, TABLES) numbers."""
        parts = [x[at : at + 4096] for at in range(0, max(len(x), 1), 4096)]
        return np.concatenate([np.stack([self._numbers([at.argmax(axis=1) for at in self.places(part, t)]) for t in range(TABLES)], axis=1) for part in parts])

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(n, TABLES, probes) buckets, likeliest first."""
        out = []
        for t in range(TABLES):
            order = [np.argsort(-at, axis=1, kind="stable") for at in self.places(x, t)]
            out.append(self._numbers([o[:, r] for o, r in zip(order, self.flips.T)]))
        return np.stack(out, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of the vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, exact distance) of the k nearest, and of all that rounding could put among them."""
    d = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * (q @ x.T)
    k = min(k, d.shape[1])
    edge = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-9 * (1 + (q**2).sum(axis=1))
    row, col = np.nonzero(d <= edge[:, None])
    return row, ids[col], np.sqrt(((q[row] - x[col]) ** 2).sum(axis=1))


FOUND = "query_id long, rep long, score double"


def _table(query: list, rep: list, score: list, k: int) -> pd.DataFrame:
    """Each query's k best."""
    if not query:
        return pd.DataFrame({"query_id": [], "rep": [], "score": []}).astype({"query_id": "int64", "rep": "int64", "score": "float64"})
    got = pd.DataFrame({"query_id": np.concatenate(query), "rep": np.concatenate(rep), "score": np.concatenate(score)})
    return got.drop_duplicates(["query_id", "rep"]).sort_values(["query_id", "score", "rep"]).groupby("query_id", sort=False).head(k)


def _reranked(k: int):
    """Exact distances of the candidates (reps) of each query among a shard's vectors."""

    def run(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        query, rep, score = [], [], []
        if len(asks):
            order = np.argsort(vectors.rep.to_numpy())
            ids, x = vectors.rep.to_numpy()[order], _stack(vectors.vec)[order]
            for one, q, reps in zip(asks.query_id, asks.vec, asks.reps):
                at = np.searchsorted(ids, reps)
                d = np.sqrt(((q - x[at]) ** 2).sum(axis=1))
                best = np.lexsort((reps, d))[:k]
                query.append(np.full(len(best), one))
                rep.append(np.asarray(reps)[best])
                score.append(d[best])
        return _table(query, rep, score, k)

    return run


def _searched(k: int):
    """The nearest of all of a block's vectors to every query."""

    def run(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        query, rep, score = [], [], []
        if len(vectors) and len(asks):
            x, ids, q, names = _stack(vectors.vec), vectors.rep.to_numpy(), _stack(asks.vec), asks.query_id.to_numpy()
            for at in range(0, len(q), 512):
                row, found, d = nearest(x, ids, q[at : at + 512], k)
                query.append(names[at : at + 512][row])
                rep.append(found)
                score.append(d)
        return _table(query, rep, score, k)

    return run


def true_pairs(classes: DataFrame, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(q[i], one of its k nearest other vectors), for all of them: each task keeps k a query, and no more reach the driver."""
    asks = classes.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            if len(b):
                x = _stack(b.vec)
                row, col, d = nearest(x, np.arange(len(x)), asks.value, k + 1)
                found = pd.DataFrame({"of": row, "score": d, "vec": list(x[col])})
                best = pd.concat([*([] if best is None else [best]), found[found.score > 0]]).sort_values(["of", "score"], kind="stable").groupby("of", sort=False).head(k)
        if best is not None:
            yield best.astype({"of": "int32", "score": "float64"})

    found = classes.select("vec").mapInPandas(run, "of int, score double, vec array<double>")
    nth = F.row_number().over(W.partitionBy("of").orderBy("score", "vec"))
    pairs = found.withColumn("nth", nth).filter(F.col("nth") <= k).collect()
    return q[[r.of for r in pairs]], np.array([r.vec for r in pairs]).reshape(-1, q.shape[1])


def candidates(classes: DataFrame, ask: DataFrame, hashes, tasks: int) -> DataFrame:
    """(q, shards, reps): a row for each bucket, or part of one, that a query visits, with all its vectors (rep) and their shards."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"rep": b.rep, "shard": b["shard"], "buckets": list(hashes.value.buckets(_stack(b.vec)))})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, (1 << 16) // hashes.value.flips.shape[0])
            for at in range(0, len(batch), step):
                b = batch[at : at + step]
                yield pd.DataFrame({"q": b.q, "buckets": list(hashes.value.probes(_stack(b.vec)).reshape(len(b), -1))})

    key = ["tab", "bucket", "part"]
    indexed = classes.select("rep", "shard", "vec").mapInPandas(index, "rep long, shard long, buckets array<long>").select("rep", "shard", F.posexplode("buckets").alias("tab", "bucket"))
    probes = ask.select("q", "vec").repartition(tasks, "q").mapInPandas(probe, "q long, buckets array<long>").select("q", F.posexplode("buckets").alias("nth", "bucket"))
    probes = probes.select("q", F.floor(F.col("nth") / hashes.value.flips.shape[0]).cast("int").alias("tab"), "bucket")
    hot = indexed.groupBy("tab", "bucket").count().filter(F.col("count") > CHUNK).select("tab", "bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = indexed.join(hot, ["tab", "bucket"], "left").select("tab", "bucket", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), F.struct("shard", "rep").alias("one"))
    dealt = dealt.groupBy(*key).agg(F.collect_list("one").alias("all"))
    asked = probes.join(hot, ["tab", "bucket"], "left").select("tab", "bucket", "q", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(asked, key).select("q", F.col("all.shard").alias("shards"), F.col("all.rep").alias("reps"))


def by_shard(shown: DataFrame) -> DataFrame:
    """(q, shard, reps): what was shown to a query, without repeats, for each shard; a query shown very much has several rows a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.repeat(b.column("q").to_numpy(), np.diff(b.column("reps").offsets.to_numpy()))
                rows = np.stack([q, *(b.column(name).flatten().to_numpy() for name in ("shards", "reps"))])
                rows = rows[:, np.lexsort(rows[::-1])]
                new = np.diff(rows, axis=1, prepend=rows[:, :1] - 1) != 0
                rows, new = rows[:, new.any(axis=0)], new[:2].any(axis=0)[new.any(axis=0)]
                starts = np.flatnonzero(new)
                reps = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.shape[1]), pa.int32()), pa.array(rows[2]))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0, starts]), pa.array(rows[1, starts]), reps], ["q", "shard", "reps"])

    return shown.repartition("q").sortWithinPartitions("q").mapInArrow(run, "q long, shard long, reps array<long>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score. Both: (vec_id, embedding); a query's own id is no candidate."""
    spark = vectors.sparkSession
    ok = usable(vectors)
    few = [r.vec for r in ok.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    length = Counter(map(len, few)).most_common(1)[0][0] if few else 1
    # Equal vectors count once here too, so a very common one neither moves the centre nor decides how many probes are made.
    few = np.array(list(dict.fromkeys(tuple(v) for v in few if len(v) == length))) if few else np.zeros((1, 1))
    ok, ask = (d.filter(F.size("vec") == length) for d in (ok, usable(queries)))
    classes = written(ok.groupBy("vec").agg(F.min("vec_id").alias("rep")), "ann")
    ask = written(ask.dropDuplicates(["vec_id", "vec"]).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "vec"), "ann")
    n, asked = classes.count(), ask.count()
    hashes = spark.sparkContext.broadcast(Hashes(few, bits_for(n)).fitted(*true_pairs(classes, few[:TRIALS], k)))
    shards = max(12, -(-n // SHARD))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)))
    asks = by_shard(candidates(dealt, ask, hashes, max(12, asked // 2048))).join(ask.withColumnRenamed("q", "own"), F.col("q") == F.col("own")).select("shard", "query_id", "vec", "reps")
    found = dealt.groupBy("shard").cogroup(asks.groupBy("shard")).applyInPandas(_reranked(k + 1), FOUND)
    found = written(found.dropDuplicates(["query_id", "rep"]), "ann")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k + 1, n)).select("query_id")
    short = written(ask.join(enough, "query_id", "left_anti"), "ann")
    if not short.isEmpty():
        blocks = max(1, n // 16384)
        block = classes.select("rep", "vec", F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("shard"))
        all_ = short.select("query_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("shard"))
        found = found.unionByName(block.groupBy("shard").cogroup(all_.groupBy("shard")).applyInPandas(_searched(k + 1), FOUND)).dropDuplicates(["query_id", "rep"])
    by_rep = found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("score", "rep"))).filter(F.col("place") <= k + 1)
    named = classes.select(F.col("vec").alias("class_vec"), F.col("rep").alias("class_rep"))
    members = ok.distinct().join(named, F.col("vec") == F.col("class_vec")).select("class_rep", F.col("vec_id").alias("member"))
    members = members.withColumn("nth", F.row_number().over(W.partitionBy("class_rep").orderBy("member"))).filter(F.col("nth") <= k + 1)
    hits = by_rep.join(members, F.col("rep") == F.col("class_rep")).filter(F.col("member") != F.col("query_id")).groupBy("query_id", F.col("member").alias("vec_id")).agg(F.min("score").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op8_ann": op8_ann}
