"""Registry entries from files, and locators from clone addresses."""

from __future__ import annotations

import subprocess
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "name string, registry string, target string, description string, owner string, default_label string, versions map<string,string>"


def read_names(spark: SparkSession, folder: str, registry: str) -> DataFrame:
    """Entries of ``names/*.toml`` files; files that are no TOML, or have no target, give no row, and neither does a folder that is not there."""
    schema = pa.schema([("name", pa.string()), ("registry", pa.string()), ("target", pa.string()), ("description", pa.string()), ("owner", pa.string()), ("default_label", pa.string()), ("versions", pa.map_(pa.string(), pa.string()))])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                try:
                    e = tomllib.loads(text)
                except tomllib.TOMLDecodeError:
                    continue
                if e.get("target"):
                    labels = [(k, str(v)) for k, v in e.get("versions", {}).items()]
                    rows.append({"name": e.get("name"), "registry": registry, "target": e["target"], "description": e.get("description"), "owner": e.get("owner"), "default_label": e.get("default"), "versions": labels})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    try:
        texts = spark.read.text(f"{folder}/*.toml", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], NAMES)  # every lookup is a miss
    return texts.mapInArrow(parsed, NAMES)


def declared(folder: str, rev: str, file: str) -> tuple[str, list[str]]:
    """(commit, names) that a repository claims for itself in a TOML file (``name`` or ``names``) at a revision; no names where the file is missing or no TOML."""
    sha = subprocess.run(["git", "-C", folder, "rev-parse", "--verify", f"{rev}^{{commit}}"], check=True, capture_output=True, text=True).stdout.strip()
    got = subprocess.run(["git", "-C", folder, "show", f"{sha}:{file}"], capture_output=True)
    try:
        said = tomllib.loads(got.stdout.decode()) if got.returncode == 0 else {}
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        said = {}
    names = said.get("names", [said["name"]] if "name" in said else [])
    return sha, [n for n in names if isinstance(n, str)] if isinstance(names, list) else []


def first_registry(names: DataFrame, order: list[str]) -> DataFrame:
    """One row a name: that of the first registry in ``order`` that has it."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("registry"))
    return names.where(rank > 0).withColumn("rank", rank).groupBy("name").agg(F.min_by(F.struct(*[c for c in names.columns if c != "name"]), "rank").alias("e")).select("name", "e.*")


def snapshot(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries with the fresh ones in place of kept ones of the same name and registry (the last ``snapshotted_at`` wins)."""
    both = kept.unionByName(fresh, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("name", "registry")]
    return both.groupBy("name", "registry").agg(F.max_by(F.struct(*rest), "snapshotted_at").alias("e")).select("name", "registry", "e.*")


def locator_of(url: Column | str) -> Column:
    """host/owner/repo of an https, ssh or scp clone address; null for others."""
    c = F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"(?:\.git)?/*$", "")
    web = r"^(?:https?|ssh|git)://(?:[^@/]*@)?([^/:]+)(?::\d+)?/([^/]+)/([^/]+)$"
    scp = r"^(?:[^@/]+@)([^:/]+):([^/]+)/([^/]+)$"

    def joined(pattern: str) -> Column:
        return F.concat_ws("/", *[F.lower(F.regexp_extract(c, pattern, n)) for n in (1, 2, 3)])

    return F.when(c.rlike(web), joined(web)).when(c.rlike(scp), joined(scp))
