"""Runs that appear in a folder of chunk files as a whole, or not at all.

A folder keeps one small file per run below ``_commits``, numbered without gaps. It is created only if
its number is still free, so of two runs that finish together one is second and looks again. Readers take
the files that are listed; what a killed run moved in and never listed is invisible. Chunk numbers are
settled by the same step: a run that lost the race gets the numbers after the winner's, and ``shift`` says
by how much they differ from those in its files.

A folder without commits belongs to other tools: all its files count. The first run that appends to it
lists what is there as commit 0 before it moves anything in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession

from voxloom.sources.files import create_if_absent, get_text, glob_paths, move_into

COMMITS = "_commits"
DONE = "_done"


class CommitConflict(RuntimeError):
    """Other runs took the next number again and again."""


@dataclass(frozen=True)
class Commit:
    """What one run added: its files, the chunk numbers it got, and where its done rows are listed."""

    run: str
    split: str = ""
    division: int | None = None
    first: int = 1
    n_chunks: int = 0
    shift: int = 0
    done: str | None = None
    files: tuple[str, ...] = field(default_factory=tuple)

    def text(self) -> str:
        return json.dumps(asdict(self) | {"files": list(self.files)})

    @staticmethod
    def parse(text: str) -> Commit:
        found = json.loads(text)
        return Commit(**(found | {"files": tuple(found["files"])}))


def _path(folder: str, number: int) -> str:
    return f"{folder}/{COMMITS}/{number:012d}.json"


def read_commits(spark: SparkSession, folder: str) -> list[Commit]:
    """All commits of a folder in their order."""
    return [Commit.parse(get_text(spark, p)) for p in glob_paths(spark, f"{folder}/{COMMITS}/*.json")]


def visible_files(spark: SparkSession, folder: str, pattern: str, commits: list[Commit] | None = None) -> list[str]:
    """Files of a folder that match ``pattern`` and that readers may take, sorted by path."""
    found = glob_paths(spark, f"{folder}/{pattern}")
    commits = read_commits(spark, folder) if commits is None else commits
    if not commits:
        return found
    listed = {f for c in commits for f in c.files}
    return [p for p in found if p.rsplit("/", 1)[-1] in listed]


def visible_in_folders(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """``visible_files`` of all folders directly below ``root``, by two listings."""
    found = glob_paths(spark, f"{root}/*/{pattern}")
    listed: dict[str, set[str]] = {}
    for path in glob_paths(spark, f"{root}/*/{COMMITS}/*.json"):
        listed.setdefault(path.rsplit("/", 3)[1], set()).update(Commit.parse(get_text(spark, path)).files)
    kept = []
    for path in found:
        _, folder, name = path.rsplit("/", 2)
        if folder not in listed or name in listed[folder]:
            kept.append(path)
    return kept


def adopt(spark: SparkSession, folder: str, pattern: str) -> None:
    """Put a folder under commits: what is there now becomes commit 0, unless a run was first."""
    if not read_commits(spark, folder):
        names = tuple(p.rsplit("/", 1)[-1] for p in glob_paths(spark, f"{folder}/{pattern}"))
        create_if_absent(spark, _path(folder, 0), Commit("adopted", files=names).text())


def next_chunk(commits: Iterable[Commit], split: str, division: int | None) -> int:
    """The chunk number after the last committed one of a split (and division)."""
    return max((c.first + c.n_chunks for c in commits if (c.split, c.division) == (split, division)), default=1)


def commit(spark: SparkSession, folder: str, new: Commit, attempts: int = 1000) -> Commit:
    """List a run. Its chunk numbers start at ``new.first``, or later when another run took those."""
    for _ in range(attempts):
        commits = read_commits(spark, folder)
        first = max(new.first, next_chunk(commits, new.split, new.division))
        settled = Commit(**(asdict(new) | {"first": first, "shift": first - new.first, "files": new.files}))
        if create_if_absent(spark, _path(folder, len(commits)), settled.text()):
            return settled
    raise CommitConflict(f"no free number in {folder}/{COMMITS} after {attempts} attempts")


def commit_once(spark: SparkSession, folder: str, new: Commit) -> Commit:
    """``commit``, unless a run of that name is listed: then that one, as when a batch is replayed."""
    known = [c for c in read_commits(spark, folder) if c.run == new.run]
    if known and known[0].n_chunks != new.n_chunks:
        raise CommitConflict(f"run {new.run} came back with {new.n_chunks} chunks instead of {known[0].n_chunks}")
    return known[0] if known else commit(spark, folder, new)


def append_run(
    spark: SparkSession,
    write: Callable[[str], object],
    folder: str,
    pattern: str,
    new: Commit,
    done: DataFrame | None = None,
    moved: Callable[[str], None] | None = None,
) -> Commit:
    """``write`` into a hidden folder of this run below ``folder``, move its files in, and list them.

    ``done`` names the input rows of the run (see ``operators.done``); it is written beside the files and
    counts from the moment they do. ``moved`` is told the name of every file that was moved.
    """
    adopt(spark, folder, pattern)
    run = uuid.uuid4().hex
    write(f"{folder}/_run-{run}")
    kept = None
    if done is not None:
        kept = f"{DONE}/{run}"
        done.write.parquet(f"{folder}/{kept}")
    names = move_into(spark, f"{folder}/_run-{run}", folder, moved)
    return commit(spark, folder, Commit(**(asdict(new) | {"run": run, "done": kept, "files": tuple(names)})))


def left_over(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files that no commit lists: what killed runs left behind, or runs that have not ended yet."""
    commits = read_commits(spark, folder)
    listed = {f for c in commits for f in c.files}
    paths = glob_paths(spark, f"{folder}/*")
    return [p for p in paths if commits and fnmatch(name := p.rsplit("/", 1)[-1], pattern) and name not in listed]
