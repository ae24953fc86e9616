"""Declarative operators: one SQL text, run by Spark over DataFrames, and by other engines over views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures
from ..sources.fixtures import AS_OF
from ..sources.shared import shared

#: name: SQL over other names in braces; {as_of} is a timestamp.
TEXTS: dict[str, str] = {}
#: names whose SQL for other engines differs.
OTHER: dict[str, str] = {}
#: names that Spark builds with the DataFrame API: (function, the names it takes).
BUILT: dict[str, tuple] = {}

NAME = re.compile(r"\{([a-z]\w*)\}")


def needs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(NAME.findall(text)) if n != "as_of"]


def spark_text(text: str, as_of: str) -> str:
    return re.sub(r"secs\(", "timestampdiff(second, ", text.replace("{as_of}", as_of))


def apply(key: str, spark: SparkSession, as_of: str = AS_OF, **frames: DataFrame) -> DataFrame:
    """The operator `key` over the frames it names."""
    return spark.sql(spark_text(TEXTS[key], as_of), **frames)


#: Names that are computed once for each state of their tables and read back, as an ingest job stores them.
STORED: set[str] = set()
_PATHS: dict[tuple, tuple] = {}


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The files under it and their versions, as Spark lists them, so changed tables are computed anew; building it may
    # write tables of its own, so that comes after.
    under = BUILT[name][1] if name in BUILT else needs(TEXTS[name])
    key = (spark.sparkContext.applicationId, name, *(stamp(spark, frame(spark, sf_dir, n)) for n in under))
    if key not in _PATHS:
        made, path = built(spark, sf_dir, name), shared(spark, name)
        made.write.option("compression", "zstd").parquet(path)
        _PATHS[key] = path, made.schema
    path, schema = _PATHS[key]
    return spark.read.schema(schema).parquet(path)


def stamp(spark: SparkSession, df: DataFrame) -> tuple:
    """Path, length and time of change of each file that `df` reads; one listing a folder."""
    hadoop, files = spark.sparkContext._jsc.hadoopConfiguration(), set(df.inputFiles())
    found = []
    for folder in sorted({name.rsplit("/", 1)[0] for name in files}):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(hadoop).listStatus(path):
            name = status.getPath().getName()
            if f"{folder}/{name}" in files:
                found.append((f"{folder}/{name}", status.getLen(), status.getModificationTime()))
    return tuple(sorted(found)) if len(found) == len(files) else (*sorted(files), *found)


def built(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BUILT:
        build, takes = BUILT[name]
        return build(*(frame(spark, sf_dir, n) for n in takes))
    return apply(name, spark, **{n: frame(spark, sf_dir, n) for n in needs(TEXTS[name])})


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A name over the tables of a folder."""
    if name in STORED:
        return stored(spark, sf_dir, name)
    if name in BUILT or name in TEXTS:
        return built(spark, sf_dir, name)
    return fixtures.view(spark, sf_dir, name)


def translated(text: str) -> str:
    """Spark's text in the other dialect: a few names differ."""
    for a, b in (("secs(", "date_diff('second', "), ("array_join(", "array_to_string("), ("sha2(", "sha_256("), ("array_contains(", "list_contains("), ("slice(", "list_slice("), ("named_struct(", "row("), ("date_trunc_ts(", "date_trunc(")):
        text = text.replace(a, b)
    return re.sub(r"sha_256\((.*?), 256\)", r"sha256(\1)", text)


def other(name: str) -> str:
    return OTHER.get(name) or translated(TEXTS[name])


def oracle(name: str) -> str:
    """The whole query, its views as common table expressions."""
    return whole(other(name))


def whole(query: str) -> str:
    """A query over names in braces, with the views it needs as common table expressions."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in fixtures.TABLES or n in order:
            return
        for used in needs(fixtures.VIEWS[n] if n in fixtures.VIEWS else other(n)):
            visit(used)
        order.append(n)

    for used in needs(query):
        visit(used)
    named = lambda text: NAME.sub(lambda m: AS_OF if m[1] == "as_of" else m[1], text)
    views = ", ".join(f"{n} as materialized ({named(fixtures.VIEWS[n] if n in fixtures.VIEWS else other(n))})" for n in order)
    return (f"with {views} " if views else "") + f"select * from ({named(query)}) as result"
