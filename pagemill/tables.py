"""The index tables as DataFrames, and the readings of their dirty columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_BLANKS = " \t\n\r\f\x0b"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str | Column) -> DataFrame:
    """A table of ``sf_dir``, pruned to ``columns`` when given. Rows are as stored, duplicates included."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def identity_of(column: Column | str) -> Column:
    """An identity as the index keys it: lower case, without a ``sha256:`` prefix."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(c), "^sha256:", "")


def is_sha(column: Column | str) -> Column:
    """Whether a revision is written as 12 to 40 hex digits."""
    c = F.col(column) if isinstance(column, str) else column
    return c.rlike("^[0-9a-fA-F]{12,40}$")


def whole_files(locations: DataFrame) -> DataFrame:
    """Distinct (identity, repo, sha, path) of the whole-file locations."""
    return locations.where(F.col("symbol").isNull()).select("identity", "repo", "sha", "path").distinct()


def latest_revision(revisions: DataFrame) -> DataFrame:
    """(repo, sha) of the revision crawled last, one row a repository."""
    return (
        revisions.where(F.col("crawl_seq").isNotNull())
        .groupBy("repo")
        .agg(F.max_by("sha", "crawl_seq").alias("sha"))
    )
