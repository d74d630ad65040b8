"""Clones of repositories that a crawl reads: fetched on the driver, read by the executors through ``git_tree``."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources.registry import locator_of


def git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True).stdout.strip()


def ask(folder: str, *args: str) -> str | None:
    """What git answers, null where it fails."""
    try:
        return git(folder, *args) or None
    except subprocess.CalledProcessError:
        return None


def fetched(cache: str, locator: str, url: str, want: str | None = None) -> str:
    """The bare clone of a repository below ``cache``: made if there is none, brought up to date unless it has the commit wanted.

    A clone is made beside its place and moved there when it is whole, so that one that breaks off, or two
    at a time, leave nothing half done.
    """
    place = os.path.join(cache, *locator.split("/"))
    if os.path.isdir(place):
        if not (want and ask(place, "cat-file", "-e", f"{want}^{{commit}}") is not None) and not (want and ask(place, "rev-parse", "--verify", f"{want}^{{commit}}")):
            git(place, "fetch", "--quiet", "--prune", "--tags", "origin", "+refs/heads/*:refs/heads/*")
        return place
    os.makedirs(os.path.dirname(place), exist_ok=True)
    beside = tempfile.mkdtemp(prefix=".clone-", dir=os.path.dirname(place))
    try:
        subprocess.run(["git", "clone", "--quiet", "--bare", url, beside], check=True, capture_output=True)
        try:
            os.rename(beside, place)
        except OSError:  # another one was first
            if not os.path.isdir(place):
                raise
    finally:
        shutil.rmtree(beside, ignore_errors=True)
    return place


def default_branch(folder: str) -> str:
    """The branch a clone's HEAD names, 'main' where it names none."""
    return ask(folder, "symbolic-ref", "--short", "HEAD") or "main"


def checked_out(folder: str) -> str:
    """The branch of a working copy, or the tag that stands on a detached HEAD, or else its commit."""
    return ask(folder, "symbolic-ref", "--short", "-q", "HEAD") or ask(folder, "describe", "--tags", "--exact-match", "HEAD") or git(folder, "rev-parse", "HEAD")


def is_sparse(folder: str) -> bool:
    return ask(folder, "config", "--bool", "core.sparseCheckout") == "true"


def on_disk(files: DataFrame, folder: str) -> DataFrame:
    """Rows (with a ``path``) of the files that a sparse working copy holds on disk; all rows for another one."""
    if not is_sparse(folder):
        return files
    tracked = git(folder, "ls-files", "-t", "-z").split("\0")
    held = [(x[2:],) for x in tracked if x and not x.startswith("S ")]
    return files.join(files.sparkSession.createDataFrame(held, "path string"), "path", "left_semi")


def handle(row: dict, cache: str, url: str, rev: str | None = None) -> tuple[str, str, str]:
    """(folder, commit, branch) to crawl of a registered repository (locator, default_branch, local_path): a local clone as it is checked out, else the fetched one."""
    if row.get("local_path"):
        folder = row["local_path"]
        branch = rev or checked_out(folder)
    else:
        folder = fetched(cache, row["locator"], url, rev)
        branch = rev or row.get("default_branch") or default_branch(folder)
    return folder, git(folder, "rev-parse", "--verify", f"{branch}^{{commit}}"), branch


def registered(repos: DataFrame, spark: SparkSession, target: str, added_at: str, cache: str | None = None) -> DataFrame:
    """The ``repos`` table with one more repository, given by its locator or by the folder of a local clone.

    A clone's locator is that of its origin. What is known of a repository stays where nothing new is said of it.
    """
    local = os.path.abspath(target) if os.path.isdir(target) else None
    locator, branch = target, None
    if local:
        url = git(local, "remote", "get-url", "origin")
        locator = spark.createDataFrame([(url,)], "url string").select(locator_of("url")).first()[0]
        if locator is None:
            raise ValueError(f"{url} is no address of a repository")
        branch = checked_out(local)
    new = spark.createDataFrame([(locator, branch, local, added_at)], "locator string, default_branch string, local_path string, added_at string").withColumn("n", F.lit(1))
    both = repos.select("locator", "default_branch", "local_path", "added_at").withColumn("n", F.lit(0)).unionByName(new)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c)
    return both.groupBy("locator").agg(latest("default_branch"), latest("local_path"), F.min("added_at").alias("added_at"))
