"""A Python data source over git repositories.

    spark.dataSource.register(GitDataSource)
    spark.read.format("git").option("repo", path).option("mode", "log").load()

Modes: log (commits), churn, diff (added lines), tree (files of HEAD), blob
(content of `revisions`, comma-joined, default HEAD), repos (one row) and count
(commits of the window, 0 where they can't be counted).  Each
repository of `repos` (comma-joined) is a partition; option `pushdown` passes
filters on email to git, `since` a start; and diffs and blobs are cut
into batches of commits or files, so that many repositories and long histories
read in parallel.  Executors need git and the repositories at these paths.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..schema import ADDED_LINES, BLOBS, CHURN, COMMITS, COUNTS, REPOS, TREE

SCHEMAS = {"log": COMMITS, "churn": CHURN, "diff": ADDED_LINES, "tree": TREE, "blob": BLOBS, "repos": REPOS, "count": COUNTS}
BATCH = 200
#: Commits of a diff's partition, and the parts into which a revision's files are dealt.
RANGE, STRIDES = 2_000, 4
RECORD, FIELD = "\x01", "\x02"
_FORMAT = RECORD + FIELD.join(("%H", "%P", "%ae", "%aI", "%cI", "%G?")) + FIELD


@dataclass
class Part(InputPartition):
    repo: str
    items: tuple = ()

    def __init__(self, repo: str, items: tuple = ()) -> None:
        super().__init__((repo, items))
        self.repo, self.items = repo, items


class GitError(RuntimeError):
    pass


def git(repo: str, *arguments: str, given: bytes | None = None, quiet: bool = False) -> bytes:
    done = subprocess.run(["git", "-C", repo, *arguments], input=given, capture_output=True)
    if done.returncode and not quiet:
        message = done.stderr.decode(errors="replace").strip()
        if "does not have any commits" in message or "bad default revision" in message or "ambiguous argument 'HEAD'" in message:
            return b""
        raise GitError(f"git {arguments[0]} failed: {message[:200]}")
    return b"" if done.returncode else done.stdout


def log_records(repo: str, *more: str) -> Iterator[tuple[list[str], list[str]]]:
    """Header fields and numstat lines of each commit, oldest first, read as git writes them."""
    command = ["git", "-C", repo, "log", "--reverse", "--numstat", f"--format={_FORMAT}", *more]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace") as run:
        header: list[str] | None = None
        lines: list[str] = []
        for line in run.stdout:
            if line.startswith(RECORD):
                if header:
                    yield header, lines
                header, lines = line[1:].rstrip("\n").split(FIELD), []
            elif line.strip():
                lines.append(line.rstrip("\n"))
        if header:
            yield header, lines
        error = run.stderr.read()
        if run.wait() and "does not have any commits" not in error:
            raise GitError(f"git log failed: {error.strip()[:200]}")


def positions(repo: str) -> Iterator[tuple[str, int]]:
    """(sha, pos) of the whole history, in the order of log_records."""
    with subprocess.Popen(["git", "-C", repo, "log", "--reverse", "--format=%H"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) as run:
        for pos, line in enumerate(run.stdout):
            yield line.strip(), pos


def commit_count(repo: str, *more: str) -> int:
    """Commits without reading them; 0 where they can't be counted."""
    found = git(repo, "rev-list", "--count", *more, "HEAD", quiet=True).strip()
    return int(found) if found.isdigit() else 0


def added_text(repo: str, shas: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """(sha, path, added lines) of these commits against their first parents."""
    out = git(repo, "-c", "core.quotepath=off", "diff-tree", "--stdin", "--root", "-r", "-p", "-U0", "-m", "--first-parent", "--no-renames", "--no-color", "--no-ext-diff", f"--format={RECORD}%H", given="".join(f"{s}\n" for s in shas).encode(), quiet=True)
    sha, path, lines = "", None, []
    for raw in out.decode(errors="replace").split("\n"):
        line = raw.removesuffix("\r")
        if line.startswith(RECORD) or line.startswith("diff --git ") or line.startswith("+++ "):
            if path is not None:
                yield sha, path, "\n".join(lines)
            path, lines = None, []
            if line.startswith(RECORD):
                sha = line[1:41]
            elif line.startswith("+++ b/"):
                path = line[6:].rstrip("\t")
        elif path is not None and line.startswith("+"):
            lines.append(line[1:])
    if path is not None:
        yield sha, path, "\n".join(lines)


def tree_entries(repo: str, revision: str = "HEAD") -> Iterator[tuple[str, int]]:
    for entry in git(repo, "ls-tree", "-r", "-l", "-z", revision, quiet=True).split(b"\0"):
        meta, tab, path = entry.partition(b"\t")
        fields = meta.split()
        if tab and fields[1] == b"blob":
            yield path.decode(errors="replace"), int(fields[3])


def blob_contents(repo: str, wanted: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(request, content) for `revision:path` requests; what is missing is skipped."""
    out = git(repo, "cat-file", "--batch", given="".join(f"{w}\n" for w in wanted).encode(), quiet=True)
    at = 0
    for w in wanted:
        end = out.index(b"\n", at)
        head = out[at:end]
        at = end + 1
        if head.endswith(b" missing") or head.endswith(b" ambiguous"):
            continue
        size = int(head.rsplit(b" ", 1)[1])
        yield w, out[at : at + size].decode(errors="replace")
        at += size + 1


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.mode = options.get("mode", "log")
        self.repos = [r for r in options.get("repos", options.get("repo", "")).split(",") if r]
        self.since = options.get("since")
        self.revisions = tuple(options.get("revisions", "HEAD").split(","))
        self.emails: tuple[str, ...] = ()
        if not self.repos:
            raise ValueError("option repo or repos is needed")

    def _window(self) -> list[str]:
        return [f"--since={self.since}"] if self.since else []

    def partitions(self) -> list[Part]:
        # What is in a part is listed where it is read; here it is only counted.
        if self.mode == "diff":
            return [Part(r, (k, RANGE)) for r in self.repos for k in range(0, max(1, commit_count(r, *self._window())), RANGE)]
        if self.mode == "blob":
            return [Part(r, (v, k)) for r in self.repos for v in self.revisions for k in range(STRIDES)]
        return [Part(r) for r in self.repos]

    def read(self, part: Part) -> Iterator[tuple]:
        repo = part.repo
        if self.mode in ("log", "churn"):
            authors = [f"--author=<{_escaped(e)}>" for e in self.emails]
            # A filter must not change what it lets through: positions are those of the whole history, read in step.
            narrowed = bool(authors or self.since)
            places = positions(repo) if narrowed else iter(())
            for pos, (header, lines) in enumerate(log_records(repo, *self._window(), *authors)):
                sha, parents, email, author, committer, status = header[:6]
                if narrowed and self.mode == "log":
                    pos = next(p for s, p in places if s == sha)
                if self.mode == "log":
                    above = parents.split()
                    yield repo, pos, sha, above[0] if above else None, email, _time(author), _time(committer), status == "G", len(above) > 1
                else:
                    for k, line in enumerate(lines):
                        added, deleted, path = line.split("\t", 2)
                        yield repo, sha, k, path, int(added) if added != "-" else 0, int(deleted) if deleted != "-" else 0
        elif self.mode == "diff":
            first, many = part.items
            shas = git(repo, "rev-list", f"--skip={first}", f"--max-count={many}", *self._window(), "HEAD").decode().split()
            for batch in (shas[k : k + BATCH] for k in range(0, len(shas), BATCH)):
                yield from ((repo, *found) for found in added_text(repo, tuple(batch)))
        elif self.mode == "count":
            yield repo, commit_count(repo, *self._window())
        elif self.mode == "tree":
            for path, size in tree_entries(repo):
                yield repo, path, size
        elif self.mode == "blob":
            revision, first = part.items
            wanted = [f"{revision}:{p}" for p, _ in tree_entries(repo, revision)][first::STRIDES]
            for batch in (wanted[k : k + 1000] for k in range(0, len(wanted), 1000)):
                for request, content in blob_contents(repo, tuple(batch)):
                    yield repo, revision, request.partition(":")[2], content
        else:
            url = git(repo, "config", "--get", "remote.origin.url", quiet=True).decode().strip()
            shallow = git(repo, "rev-parse", "--is-shallow-repository", quiet=True).decode().strip() == "true"
            email = git(repo, "config", "--get", "user.email", quiet=True).decode().strip()
            yield repo, url or None, shallow, datetime.now(UTC), email or None


def _escaped(email: str) -> str:
    return "".join("\\" + c if c in r".[]*^$\\" else c for c in email)


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text)


class PushdownReader(GitReader):
    """Equality on email narrows the walk; git matches patterns, so Spark filters once more."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if self.mode == "log" and isinstance(f, EqualTo) and f.attribute == ("email",):
                self.emails = (f.value,)
            elif self.mode == "log" and isinstance(f, In) and f.attribute == ("email",):
                self.emails = tuple(f.value)
            yield f


class GitDataSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        mode = self.options.get("mode", "log")
        if mode not in SCHEMAS:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(SCHEMAS)}")
        return SCHEMAS[mode]

    def reader(self, schema) -> GitReader:  # noqa: ANN001
        # Spark refuses pushFilters unless spark.sql.python.filterPushdown.enabled is set, as histlens.session does.
        return (PushdownReader if self.options.get("pushdown", "").lower() == "true" else GitReader)(dict(self.options))
