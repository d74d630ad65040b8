"""A folder of source files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, folder: str, pattern: str = "*.c") -> DataFrame:
    """(file, text) of the files below a folder whose names fit; bytes that are no UTF-8 are replaced, none are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    replaced = F.udf(lambda b: bytes(b).decode("utf-8", "replace"), "string")
    # bytes that are UTF-8 are read natively; only the others are read by Python
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(replaced("content"))
    return raw.select(F.col("path").alias("file"), text.alias("text"))
