"""Git as Spark data sources: the files of a commit, the log, and the difference of two commits.

spark.dataSource.register(GitTree); spark.read.format("git_tree").option("repo", path).option("rev", "HEAD").load()

The repository must be at the same path on the executors, as a mirror or a shared mount.  Files are read in ranges of the listing.
"""

from __future__ import annotations

import itertools
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, timeout=600).stdout


@dataclass(frozen=True)
class State:
    """A repository's root, commit, and whether tracked files differ from it."""

    root: str
    commit: str
    dirty: bool


class DirtyRepository(Exception):
    pass


def state(repo: str, exclude: str | None = None) -> State:
    """The state of a repository; changes under the folder exclude do not count.  Without a repository or a commit, a CalledProcessError."""
    root = git(repo, "rev-parse", "--show-toplevel").decode().strip()
    commit = git(root, "rev-parse", "--verify", "HEAD").decode().strip()
    only = ["--", ".", *([f":(exclude){exclude}"] if exclude else [])]
    return State(root, commit, bool(git(root, "status", "--porcelain=v1", "-z", "--untracked-files=no", *only)))


def clean_state(repo: str, allow_dirty: bool = False, exclude: str | None = None) -> State:
    """state(), refused if the tree is dirty and that is not allowed."""
    found = state(repo, exclude)
    if found.dirty and not allow_dirty:
        raise DirtyRepository(f"{found.root} has changes that are not committed")
    return found


class Names(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(None)
        self.names = names


def _cut(names: list[str], size: int) -> list[Names]:
    return [Names(names[i : i + size]) for i in range(0, len(names), size)] or [Names([])]


WORKTREE = "WORKTREE"


class GitTree(DataSource):
    """path, content, size of the tracked files of a commit, or of the working tree (option rev = WORKTREE).

    Options: suffix (default .py) keeps only such names, exclude leaves a folder out, maxBytes leaves larger files' content null; so is that
    of links and of what is no regular file.  A tracked file that is gone from the working tree has neither content nor size.
    """

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, content binary, size long"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.rev = options["repo"], options.get("rev", "HEAD")
        self.exclude = options.get("exclude")
        self.suffix, self.most, self.size = options.get("suffix", ".py"), int(options.get("maxBytes", 2 << 20)), int(options.get("filesPerPartition", 500))

    def partitions(self) -> list[Names]:
        if self.rev == WORKTREE:
            listed = git(self.repo, "ls-files", "-z").decode().split("\0")
        else:  # mode type id, tab, path; links and submodules are marked
            rows = [x.split("\t", 1) for x in git(self.repo, "ls-tree", "-r", "-z", self.rev).decode().split("\0") if x]
            listed = [path if head.startswith("100") else f"\0{path}" for head, path in rows]
        kept = (x for x in listed if x and x.endswith(self.suffix) and not (self.exclude and x.lstrip("\0").startswith(f"{self.exclude}/")))
        return _cut(sorted(kept, key=lambda x: x.lstrip("\0").split("/")), self.size)

    def read(self, partition: Names) -> Iterator[tuple]:
        for name in partition.names:
            path = name.lstrip("\0")
            if self.rev == WORKTREE:
                full = os.path.join(self.repo, path)
                if os.path.islink(full) or not os.path.isfile(full):
                    yield path, None, None
                    continue
                size = os.path.getsize(full)
                with open(full, "rb") as f:
                    yield path, f.read() if size <= self.most else None, size
            elif name != path:
                yield path, None, None
            else:
                content = git(self.repo, "cat-file", "blob", f"{self.rev}:{path}")
                yield path, content if len(content) <= self.most else None, len(content)


class GitLog(DataSource):
    """seq (0 is the newest), commit, path of the latest commits (option latest, default 500); merges list no path."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "seq long, commit string, path string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.rev, self.latest = options["repo"], options.get("rev", "HEAD"), options.get("latest", "500")

    def read(self, partition) -> Iterator[tuple]:
        text = git(self.repo, "log", f"-n{self.latest}", "--root", "--name-only", "--no-renames", "-z", "--format=%x01%H", self.rev).decode()
        for seq, block in enumerate(text.split("\x01")[1:]):
            commit, *names = [x.strip("\n") for x in block.split("\0")]
            for path in sorted({x for x in names if x}):
                yield seq, commit.strip(), path


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.M)


class GitDiff(DataSource):
    """status, path, old_path, binary, old, new, hunks, snippets, truncated of each file that differs between the commits base and head (options).

    snippets: the first SNIPPETS hunks as text, header and SNIPPET_LINES lines each.
    """

    @classmethod
    def name(cls) -> str:
        return "git_diff"

    def schema(self) -> str:
        return "status string, path string, old_path string, binary boolean, old binary, new binary, hunks array<struct<old_start:int,old_count:int,new_start:int,new_count:int>>, snippets array<string>, truncated boolean"

    def reader(self, schema) -> DataSourceReader:
        return _DiffReader(self.options)


def hunks(patch: str) -> list[tuple[int, int, int, int]]:
    """(old start, count, new start, count) of each hunk header; a count that is left out is 1."""
    return [tuple(int(x) if x is not None else 1 for x in m.groups()) for m in _HUNK.finditer(patch)]


#: Hunks of a file that are shown, and lines of each.
SNIPPETS, SNIPPET_LINES = 20, 40


def snippets(patch: str) -> tuple[list[str], bool]:
    """The first hunks of a patch as text, and whether any was cut or left out."""
    starts = [m.start() for m in _HUNK.finditer(patch)]
    parts = [patch[a:b].rstrip("\n").split("\n") for a, b in itertools.pairwise([*starts, len(patch)])]
    shown = parts[:SNIPPETS]
    return ["\n".join(x[: SNIPPET_LINES + 1]) for x in shown], len(parts) > SNIPPETS or any(len(x) > SNIPPET_LINES + 1 for x in shown)


class _DiffReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.base, self.head = options["repo"], options["base"], options["head"]

    def partitions(self) -> list[Names]:
        fields = git(self.repo, "diff", "--name-status", "-z", "-M", self.base, self.head).decode().split("\0")
        rows, i = [], 0
        while i < len(fields) and fields[i]:
            code = fields[i][0]
            if code == "R":
                rows.append("\0".join(("R", fields[i + 2], fields[i + 1])))
                i += 3
            elif code in "AMDT":
                rows.append("\0".join(("M" if code == "T" else code, fields[i + 1], "" if code == "A" else fields[i + 1])))
                i += 2
            else:
                raise ValueError(f"unsupported change {fields[i]} of {fields[i + 1]}")
        return _cut(rows, 100)

    def read(self, partition: Names) -> Iterator[tuple]:
        for row in partition.names:
            status, path, old_path = row.split("\0")
            old = git(self.repo, "cat-file", "blob", f"{self.base}:{old_path}") if status != "A" else None
            new = git(self.repo, "cat-file", "blob", f"{self.head}:{path}") if status != "D" else None
            patch = git(self.repo, "diff", "-U0", "-M", self.base, self.head, "--", *dict.fromkeys(filter(None, (old_path, path)))).decode(errors="replace")
            binary = any(b"\0" in (x or b"")[:8000] for x in (old, new))
            yield status, path, old_path or None, binary, old, new, [] if binary else hunks(patch), *(([], False) if binary else snippets(patch))


def register(spark) -> None:
    for source in (GitTree, GitLog, GitDiff):
        spark.dataSource.register(source)
