"""Incremental ingest: files that arrive become pages, revisions that are known are left alone."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.extraction import extract

FILES = "repo string, sha string, path string, text string"


def crawl_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet files of (repo, sha, path, text) as they arrive and append their pages to ``target/pages``.

    A file that an earlier batch wrote is skipped, so a batch that is run again after a failure, or
    files that arrive twice, add nothing; files of a revision may come in any number of batches. ``pages`` is
    kept in one folder a repository, and only those of the batch's repositories are read. Read ``target/pages``
    by ``pagemill.operators.extraction`` to make the other tables.
    """
    pages = os.path.join(target, "pages")

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        fresh = batch.dropDuplicates(["repo", "sha", "path"])
        try:
            done = s.read.parquet(pages).select("repo", "sha", "path")
        except Exception as e:  # noqa: BLE001 - the first batch has nothing to read
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            asked = batch.select("repo").distinct()
            fresh = fresh.join(done.join(asked, "repo", "left_semi").distinct(), ["repo", "sha", "path"], "left_anti")
        extract(fresh).write.mode("append").partitionBy("repo").parquet(pages)

    return spark.readStream.schema(FILES).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
