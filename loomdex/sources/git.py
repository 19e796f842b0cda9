"""What git says about a tree: commit, changed files and changed lines for each of them."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class GitState:
    commit: str | None = None
    dirty_files: list[str] = field(default_factory=list)
    hunk_summary: dict[str, int] = field(default_factory=dict)


def _git(root: str, *args: str) -> str | None:
    """The output of a git command, or None where there is no git or no repository."""
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace").rstrip("\n") if done.returncode == 0 else None


def head(root: str) -> str | None:
    return _git(root, "rev-parse", "HEAD")


def numstat(line: Column) -> Column:
    """A line of ``git diff --numstat`` as (path, lines): added and removed together, binary
    files as 0; null for any other line."""
    parts = F.split(line, "\t", 3)
    number = lambda i: F.coalesce(F.get(parts, i).try_cast("long"), F.lit(0).cast("long"))
    return F.when(F.size(parts) == 3, F.struct(F.get(parts, 2).alias("path"), (number(0) + number(1)).alias("lines")))


def changed_lines(diff: DataFrame) -> DataFrame:
    """path and lines of a table of numstat lines (value), summed by path."""
    found = diff.select(numstat(F.col("value")).alias("n")).where("n is not null").select("n.*")
    return found.groupBy("path").agg(F.sum("lines").alias("lines"))


def state(root: str) -> GitState:
    """The state of the working tree that holds ``root``."""
    status = (_git(root, "status", "--porcelain") or "").split("\n")
    out = GitState(head(root), [s for line in status if (s := line[3:].strip())])
    for line in (_git(root, "diff", "--numstat") or "").split("\n"):
        added, removed, path = (line.split("\t", 2) + ["", "", ""])[:3]
        if path:
            out.hunk_summary[path] = sum(int(n) for n in (added, removed) if n.isdigit())
    return out
