"""A store of pages by identity: what was resolved once is at hand later, with the places it was seen at."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "identity string, source string, kind string, name string, address string, seen string"


def store(pages: DataFrame, folder: str) -> None:
    """Append pages (COLUMNS) to the store, one folder of files for each first two digits, so that a prefix reads one of them."""
    pages.select("identity", "source", "kind", "name", "address", "seen").withColumn("shelf", F.substring("identity", 1, 2)).write.mode("append").partitionBy("shelf").parquet(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(identity, source, kind, name, places): each page once, its places (address, seen) each once at the time seen last, the latest last."""
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "identity string, source string, kind string, name string, places array<struct<seen:string,address:string>>, shelf string")
    rows = spark.read.schema(COLUMNS + ", shelf string").parquet(folder)
    last = rows.groupBy("shelf", "identity", "address").agg(F.max("seen").alias("seen"), F.max_by(F.struct("source", "kind", "name"), "seen").alias("p"))
    return last.groupBy("shelf", "identity").agg(F.max_by("p", "seen").alias("p"), F.array_sort(F.collect_list(F.struct("seen", "address"))).alias("places")).select("identity", "p.*", "places", "shelf")


def lookup(spark: SparkSession, folder: str, prefix: str):
    """The page whose identity begins with ``prefix`` (12 digits or more), null if there is none; a ValueError names the candidates if there are several."""
    prefix = prefix.lower().removeprefix("sha256:")
    if len(prefix) < 12:
        raise ValueError("a prefix has at least twelve digits")
    got = stored(spark, folder).where(F.col("shelf") == prefix[:2]).where(F.startswith("identity", F.lit(prefix))).limit(2).collect()
    if len(got) > 1:
        raise ValueError(f"{prefix} is ambiguous: {', '.join(sorted(r.identity for r in got))}")
    return got[0] if got else None


def held(folders: dict[str, str]) -> dict[str, dict[str, int]]:
    """Files and bytes below each folder, by its name."""
    out = {}
    for name, folder in folders.items():
        sizes = [os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files]
        out[name] = {"files": len(sizes), "bytes": sum(sizes)}
    return out


def clear(folders: dict[str, str], names: list[str]) -> list[str]:
    """Remove the named folders; returns those that were there."""
    gone = [n for n in names if os.path.isdir(folders[n])]
    for n in gone:
        shutil.rmtree(folders[n])
    return gone
