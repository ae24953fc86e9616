"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are neither a space nor 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch of rows that goes to a Python worker, where the session leaves Spark's own 64 MB.
BATCH = 6 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Rows are whole texts, so batches are bounded by bytes; a session that sets its own bound keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that driver and executors share.

    Only where driver and executors are one process, as in tests, is an unset folder replaced.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _OWN.setdefault("root", f"file:{tempfile.gettempdir()}/checkpoints")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_OWN: dict[str, str] = {}


def written(df: DataFrame, purpose: str, **options) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it again."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that `written` gave, once nothing reads it any more."""
    spark = table.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def total_bytes(df: DataFrame, col: str = "text") -> int:
    """One pass over one column; a single number comes back."""
    return df.agg(F.sum(F.octet_length(F.col(col)).cast("long"))).first()[0] or 0


def shards(n_bytes: int, per: int, least: int = 12) -> int:
    """How many groups of about `per` bytes; grows with the input, not a cap."""
    return max(least, -(-n_bytes // per))


def tidy(run: Callable) -> Callable:
    """`run` over a task's batches; when they are through, the worker gives back the memory it no longer uses.

    Spark reuses its Python workers, so what one task leaves behind would count against the next.
    """

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def tasks(groups: int) -> int:
    """Partitions for so many groups: one each, and from 50,000 on 16 a partition, so tasks keep their size."""
    return min(groups, max(50_000, groups // 16))


def portions(texts: list, chars: int = 2_000_000) -> Iterator[list]:
    """Runs of texts (or bytes) of about `chars` in length; a longer one is a run of its own."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > chars:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run
