"""Providers as rows: a link's kind by an equi-join of its host's endings with a small table of host fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PROVIDERS
from ..functions import urls as ux

#: Rows of the table up to which it is broadcast.
MOST = 100_000


def registry(spark) -> DataFrame:
    """The fixed providers, in order, as (fragment, kind, place); callers add rows."""
    return spark.createDataFrame([(f, k, i) for i, (f, k) in enumerate(PROVIDERS.items())], "fragment string, kind string, place int")


def with_kinds(links: DataFrame, url: str, known: DataFrame) -> DataFrame:
    """Adds `provider`: the kind of the fragment with the least place that the link's host is, or ends with after a dot.

    A fragment that ends with a dot may stand before any dot of the host. Hosts are judged once each: their endings are
    exploded, so the table may grow without the plan growing.
    """
    lengths = sorted(r[0] for r in known.filter(F.col("fragment").endswith(".")).select(F.length("fragment") - 1).distinct().collect())
    rows = links.withColumn("host_", ux.bare_host(F.col(url)))
    hosts = rows.select("host_").distinct().filter("host_ <> ''")
    labels = F.split("host_", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    inner = F.slice("labels", 1, F.size("labels") - 1)
    # Whatever a label ends with, of the lengths that the table asks for.
    ends = F.flatten(F.transform(inner, lambda w: F.array(*(F.when(F.length(w) >= n, F.concat(F.substring(w, F.length(w) - n + 1, F.lit(n)), F.lit("."))) for n in lengths)))) if lengths else F.array().cast("array<string>")
    asked = hosts.withColumn("labels", labels).select("host_", F.explode(F.array_distinct(F.concat(endings, F.array_compact(ends)))).alias("fragment"))
    table = known.groupBy("fragment").agg(F.min_by("kind", "place").alias("kind"), F.min("place").alias("place"))
    table = F.broadcast(table) if known.limit(MOST + 1).count() <= MOST else table
    found = asked.join(table, "fragment").groupBy("host_").agg(F.min_by("kind", "place").alias("provider"))
    return rows.join(found, "host_", "left").drop("host_")
