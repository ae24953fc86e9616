"""Places in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds 1, 2, ... in `order`, which must end in a unique column.

    Rows are dealt to ranges of the order, numbered within their range, and shifted by the counts of
    the ranges before: only one row a range meets in a single task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    shift = dealt.groupBy("range_").count().withColumn("shift_", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(W.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("own_", own).join(F.broadcast(shift), "range_").withColumn(name, F.col("own_") + F.col("shift_")).drop("range_", "own_", "shift_")


def numbered_within(rows: DataFrame, keys: list[str], *order: Column, name: str = "place") -> DataFrame:
    """Adds 1, 2, ... in `order` for each of the keys, so a key with very many rows spreads over ranges too.

    Only keys that go on from one range to the next have rows before them: at most one a range meets in the broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *keys, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("range_", *keys).count().withColumn("shift_", F.sum("count").over(before)).filter("shift_ is not null")
    shift = counts.select(F.col("range_").alias("of_"), F.struct(*keys).alias("key_"), "shift_")
    own = F.row_number().over(W.partitionBy("range_", *keys).orderBy(*order))
    met = dealt.withColumn("own_", own).join(F.broadcast(shift), (F.col("range_") == F.col("of_")) & F.struct(*keys).eqNullSafe(F.col("key_")), "left")
    return met.withColumn(name, F.col("own_") + F.coalesce("shift_", F.lit(0))).drop("range_", "own_", "of_", "key_", "shift_")
