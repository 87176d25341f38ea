"""A git repository's log as a Spark data source, read in time slices.

``spark.read.format("gitlog").option("repo", path)`` with options ``rev`` (default ``--all``),
``since`` and ``until`` (committer dates), ``slice_days`` and ``numstat``; each slice is one
partition. With ``pushdown`` and ``spark.sql.python.filterPushdown.enabled`` both true, filters
on ``committer_date`` reach git.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

LOG = "sha string, author_date timestamp, committer_date timestamp, author string, subject string, body string, full_message string, parents array<string>, log_idx bigint"
NUMSTAT = "sha string, committer_date timestamp, path string, additions bigint, deletions bigint"
UTC = timezone.utc


class Slice(InputPartition):
    def __init__(self, number: int, since: datetime | None, until: datetime | None) -> None:
        self.number, self.since, self.until = number, since, until


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return NUMSTAT if self.options.get("numstat", "false") == "true" else LOG

    def reader(self, schema) -> "GitLogReader":  # noqa: ANN001
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else GitLogReader
        return kind(dict(self.options))


def _moment(text: str | None) -> datetime | None:
    if not text:
        return None
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=UTC)


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.since, self.until = _moment(options.get("since")), _moment(options.get("until"))

    def _git(self, *args: str) -> bytes:
        return subprocess.run(["git", "-C", self.options["repo"], *args], check=True, capture_output=True, timeout=float(self.options.get("timeout", 600))).stdout

    def partitions(self) -> list[Slice]:
        rev = self.options.get("rev", "--all")
        times = [int(x) for x in self._git("log", rev, "--format=%ct").split()]
        if not times:
            return [Slice(0, self.since, self.until)]
        lo = max(self.since, datetime.fromtimestamp(min(times), UTC)) if self.since else datetime.fromtimestamp(min(times), UTC)
        hi = min(self.until, datetime.fromtimestamp(max(times) + 1, UTC)) if self.until else datetime.fromtimestamp(max(times) + 1, UTC)
        step = timedelta(days=float(self.options.get("slice_days", 365)))
        out, at = [], lo
        while at < hi:
            out.append(Slice(len(out), at, min(at + step, hi)))
            at += step
        return out or [Slice(0, lo, lo)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        numstat = self.options.get("numstat", "false") == "true"
        fields = "%H%x00%aI%x00%cI%x00%an%x00%P%x00%B"
        args = ["log", self.options.get("rev", "--all"), f"--format=%x1f{fields}%x1e"]
        if partition.since:
            args.append(f"--since={(partition.since - timedelta(seconds=1)).isoformat()}")
        if partition.until:
            args.append(f"--until={partition.until.isoformat()}")
        if numstat:
            args += ["--numstat", "--no-renames"]
        for i, entry in enumerate(self._git(*args).decode("utf-8", "replace").split("\x1f")[1:]):
            head, _, tail = entry.partition("\x1e")
            sha, authored, committed, author, parents, message = head.split("\0", 5)
            at = datetime.fromisoformat(committed)
            if (partition.since and at < partition.since) or (partition.until and at >= partition.until):
                continue
            if numstat:
                for line in tail.strip().split("\n"):
                    parts = line.split("\t", 2)
                    if len(parts) == 3:
                        yield sha, at, parts[2], 0 if parts[0] == "-" else int(parts[0]), 0 if parts[1] == "-" else int(parts[1])
            else:
                text = message.strip()
                subject, _, body = text.partition("\n")
                yield sha, datetime.fromisoformat(authored), at, author, subject, body.strip(), text, parents.split(), partition.number * 1_000_000_000 + i


class PushingReader(GitLogReader):
    """The reader for sessions that allow Python sources to take filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("committer_date",):
                self.since = max(self.since or f.value.astimezone(UTC), f.value.astimezone(UTC))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("committer_date",):
                end = f.value.astimezone(UTC) + timedelta(seconds=1)
                self.until = min(self.until or end, end)
            yield f  # git works in whole seconds, so Spark still applies every filter
