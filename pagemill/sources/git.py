"""Files of a git tree as a Spark data source.

    spark.dataSource.register(GitTree)
    spark.read.format("git_tree").option("path", clone).option("repo", name).option("rev", "main").load()

One partition reads a stretch of the tree with a single ``git cat-file --batch``, so that a
large tree costs few processes. The clone must be visible to the executors at the same path.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _git(path: str, *args: str, given: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", path, *args], input=given, check=True, capture_output=True).stdout


class _Stretch(InputPartition):
    def __init__(self, sha: str, paths: list[str]):
        self.sha, self.paths = sha, paths


class GitTree(DataSource):
    """Rows (repo, sha, path, text, committed_at); undecodable and missing files have a null text."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "repo string, sha string, path string, text string, committed_at bigint"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.repo = options["path"], options.get("repo", options["path"])
        self.rev, self.stretch = options.get("rev", "HEAD"), int(options.get("filesPerPartition", 2000))

    def partitions(self) -> list[_Stretch]:
        sha = _git(self.path, "rev-parse", "--verify", f"{self.rev}^{{commit}}").decode().strip()
        names = _git(self.path, "ls-tree", "-r", "-z", "--name-only", sha).decode().split("\0")[:-1]
        return [_Stretch(sha, names[k : k + self.stretch]) for k in range(0, len(names), self.stretch)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        when = int(_git(self.path, "show", "-s", "--format=%ct", partition.sha))
        raw = _git(self.path, "cat-file", "--batch", given="".join(f"{partition.sha}:{p}\n" for p in partition.paths).encode())
        at = 0
        for path in partition.paths:
            head, _, _ = raw[at:].partition(b"\n")
            at += len(head) + 1
            text = None
            parts = head.rsplit(b" ", 2)
            if len(parts) == 3 and parts[-1].isdigit():
                size = int(parts[-1])
                try:
                    text = raw[at : at + size].decode() if parts[1] == b"blob" else None
                except UnicodeDecodeError:
                    text = None
                at += size + 1
            yield self.repo, partition.sha, path, text, when
