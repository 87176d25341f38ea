"""Relations read from a git repository for given commits: diffs, blame, trees.

Keys are made distinct before git runs, so each commit is read once; a failure is a row with
its error, not a lost or repeated read, and counts stay the same from run to run.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelode.functions.tree import problems
from changelode.operators import diffs as texts

TIMEOUT = 15.0
DIFFS = "sha string, status string, error string, is_merge boolean, parents int, patch_id string, raw_diff string, changed_files array<string>"
BLAME = "sha string, path string, line bigint, origin_sha string, error string"
PAIR_DIFFS = "base string, head string, status string, error string, merge_base string, patch_id string, raw_diff string, numstat string"
PARENTS = "sha string, parent string, parents int, error string"
REMOVED = "sha string, path string, line bigint, content string, error string"
REVERSE = "sha string, patch_id string, error string"
COMMITS = (
    "sha string, parents array<string>, author string, author_email string, author_date string, committer string, committer_email string, committer_date string, subject string,"
    " body string, message string, changed_paths array<string>, patch string, patch_method string, error string"
)
TREE = "commitish string, path string, mode string, blob string, size bigint, link_target string, error string"


def git(repo: str, *args: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=stdin, check=True, capture_output=True, timeout=TIMEOUT).stdout


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _patch_id(repo: str, raw: bytes) -> str:
    """Git's stable patch id of a diff; an empty diff has none, which is an error."""
    got = git(repo, "patch-id", "--stable", stdin=raw).split()
    if not got:
        raise ValueError("no patch id: the diff is empty")
    return got[0].decode()


def _rows(keys: DataFrame, ddl: str, read: Callable[..., list[tuple]], on_error: Callable[..., tuple]) -> DataFrame:
    names = [c.split()[0] for c in ddl.replace(",  ", ", ").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key in b.itertuples(index=False):
                try:
                    rows += read(*key)
                except (subprocess.SubprocessError, OSError, ValueError) as e:
                    rows.append(on_error(*key, (getattr(e, "stderr", None) or b"").decode("utf-8", "replace").strip() or str(e)))
            yield pd.DataFrame(rows, columns=names)

    return keys.distinct().mapInPandas(run, ddl)


def commit_diffs(shas: DataFrame, repo: str) -> DataFrame:
    """Patch, stable patch id and paths of each commit (``shas``: sha); merges have no patch."""

    def read(sha: str) -> list[tuple]:
        parents = git(repo, "rev-list", "--parents", "-n", "1", sha).split()[1:]
        if len(parents) > 1:
            return [(sha, "ok", None, True, len(parents), None, None, [])]
        raw = git(repo, "show", "--format=", "--no-color", "-M", sha)
        patch = git(repo, "patch-id", "--stable", stdin=raw).split()
        if not patch:
            return [(sha, "error", "no patch id: the diff is empty", False, len(parents), None, None, None)]
        names = [x for x in git(repo, "show", "--format=", "--name-only", "-z", sha).decode("utf-8", "replace").split("\0") if x]
        return [(sha, "ok", None, False, len(parents), patch[0].decode(), raw.decode("utf-8", "replace"), sorted(names))]

    return _rows(shas.select("sha"), DIFFS, read, lambda sha, e: (sha, "error", e, None, None, None, None, None))


def _pair_diffs(pairs: DataFrame, repo: str, dots: str) -> DataFrame:
    def read(base: str, head: str) -> list[tuple]:
        if not base or not head:
            raise ValueError("base or head is empty")
        common = _text(git(repo, "merge-base", base, head)).strip() if dots == "..." else None
        span = f"{base}{dots}{head}"
        raw = git(repo, "diff", "--no-color", "-M", span)
        stat = _text(git(repo, "diff", "--numstat", "--no-renames", span))
        return [(base, head, "ok", None, common, _patch_id(repo, raw) if raw.strip() else None, _text(raw), stat)]

    rows = _rows(pairs.select("base", "head"), PAIR_DIFFS, read, lambda base, head, e: (base, head, "error", e, None, None, None, None))
    return rows.withColumn("files", texts.numstat(F.col("numstat"))).drop("numstat")


def request_diffs(pairs: DataFrame, repo: str) -> DataFrame:
    """What a request changes, from the merge base to its head (``pairs``: base, head): patch, patch id, files.

    Functions come from the patch with :func:`changelode.operators.diffs.diff_symbols`; an empty
    diff has no patch id, an unreadable pair is a row with its error.
    """
    return _pair_diffs(pairs, repo, "...")


def endpoint_diffs(pairs: DataFrame, repo: str) -> DataFrame:
    """The difference of two commits themselves (``pairs``: base, head), whatever lies between."""
    return _pair_diffs(pairs, repo, "..")


def parents(shas: DataFrame, repo: str) -> DataFrame:
    """(sha, parent, parents, error): the first parent of each commit and how many it has."""

    def read(sha: str) -> list[tuple]:
        found = _text(git(repo, "rev-list", "--parents", "-n", "1", sha)).split()[1:]
        return [(sha, found[0] if found else None, len(found), None)]

    return _rows(shas.select("sha"), PARENTS, read, lambda sha, e: (sha, None, None, e))


def removed_lines(shas: DataFrame, repo: str) -> DataFrame:
    """(sha, path, line, content, error): lines that a commit takes from its parent, at their former places.

    Read without context lines; merges and roots have none.
    """

    def read(sha: str) -> list[tuple]:
        if len(git(repo, "rev-list", "--parents", "-n", "1", sha).split()) != 2:
            return []
        raw = _text(git(repo, "show", "--format=", "--no-color", "-p", "-U0", "-M", sha))
        return [(sha, path, old, text, None) for kind, path, old, _, text in texts.walk(raw) if kind == "-"]

    return _rows(shas.select("sha"), REMOVED, read, lambda sha, e: (sha, None, None, None, e))


def reverse_patches(shas: DataFrame, repo: str) -> DataFrame:
    """(sha, patch_id, error): the stable patch id of each commit read backwards, from it to its parent."""

    def read(sha: str) -> list[tuple]:
        return [(sha, _patch_id(repo, git(repo, "diff", "--no-color", "-M", sha, f"{sha}^")), None)]

    return _rows(shas.select("sha"), REVERSE, read, lambda sha, e: (sha, None, e))


def exported(shas: DataFrame, repo: str) -> DataFrame:
    """Metadata, changed paths and the canonical patch of each commit.

    A merge is compared with its first parent, a root with nothing; ``patch_method`` says which.
    A commit whose patch fails keeps its metadata and has the error beside it.
    """
    fields = "%H%x00%P%x00%an%x00%ae%x00%aI%x00%cn%x00%ce%x00%cI%x00%s%x00%b%x00%B"

    def read(sha: str) -> list[tuple]:
        parts = _text(git(repo, "show", "-s", "--no-show-signature", f"--format={fields}", f"{sha}^{{commit}}")).split("\0", 10)
        own, above = parts[0], parts[1].split()
        names = _text(git(repo, "diff-tree", "--root", "--no-commit-id", "--name-only", "-r", "-m", "--first-parent", "-z", own)).split("\0")
        plain = ["--no-ext-diff", "--binary", "--full-index"]
        how = "first_parent" if len(above) > 1 else "parent" if above else "root"
        patch, error = None, None
        try:
            patch = _text(git(repo, "diff", *plain, above[0], own, "--") if len(above) > 1 else git(repo, "show", "--format=", *plain, "--patch", own, "--"))
        except (subprocess.SubprocessError, OSError) as e:
            error = str(e)
        return [(sha, above, *parts[2:10], parts[10].rstrip("\n"), sorted({n for n in names if n}), patch, how, error)]

    return _rows(shas.select("sha"), COMMITS, read, lambda sha, e: (sha, *[None] * 13, e))


def merge_bases(pairs: DataFrame, repo: str) -> DataFrame:
    """(base, head, merge_base, error) of each pair of commits."""
    read = lambda base, head: [(base, head, _text(git(repo, "merge-base", base, head)).strip(), None)]
    return _rows(pairs.select("base", "head"), "base string, head string, merge_base string, error string", read, lambda base, head, e: (base, head, None, e))


def resolved(names: DataFrame, repo: str) -> DataFrame:
    """(name, sha, error): the full commit id of each name; an ambiguous or unknown one is a row with its error."""
    read = lambda name: [(name, _text(git(repo, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}")).strip(), None)]
    return _rows(names.select("name"), "name string, sha string, error string", read, lambda name, e: (name, None, e or "unknown"))


def head(repo: str) -> str:
    """The commit id that the repository's head is at."""
    return _text(git(repo, "rev-parse", "HEAD")).strip()


def parse_blame(text: str) -> list[tuple[int, str]]:
    """(line, origin) of a porcelain blame: headers of a full id and the final line as third field."""
    return [(int(m[2]), m[1]) for m in re.finditer(r"(?m)^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$", text)]


def blame(ranges: DataFrame, repo: str) -> DataFrame:
    """Origins of line ranges on a commit's parent (``ranges``: sha, path, first, last), moves and copies followed."""

    def read(sha: str, path: str, first: int, last: int) -> list[tuple]:
        text = git(repo, "blame", "--porcelain", "-M", "-C", "-L", f"{first},{last}", f"{sha}^", "--", path).decode("utf-8", "replace")
        return [(sha, path, line, origin, None) for line, origin in parse_blame(text)]

    return _rows(ranges.select("sha", "path", "first", "last"), BLAME, read, lambda sha, path, first, last, e: (sha, path, first, None, e))


def tree(commits: DataFrame, repo: str) -> DataFrame:
    """Entries of each commit's tree with link targets (``commits``: commitish)."""

    def read(commitish: str) -> list[tuple]:
        out, links = [], []
        for entry in git(repo, "ls-tree", "-r", "-z", "-l", commitish).decode("utf-8", "surrogateescape").split("\0"):
            if entry:
                head, path = entry.split("\t", 1)
                mode, _, blob, size = head.split()
                if mode == "120000":
                    links.append((len(out), blob))
                out.append((commitish, path.encode("utf-8", "replace").decode(), mode, blob, int(size) if size != "-" else None, None, None))
        # Targets of all links in one process: a header line, the content and a line end for each.
        rest = git(repo, "cat-file", "--batch", stdin="".join(f"{blob}\n" for _, blob in links).encode()) if links else b""
        for i, _ in links:
            header, _, rest = rest.partition(b"\n")
            size = int(header.split()[2])
            out[i] = (*out[i][:5], _text(rest[:size]), None)
            rest = rest[size + 1 :]
        return out

    return _rows(commits.select("commitish"), TREE, read, lambda c, e: (c, None, None, None, None, None, e))


def exportable(pairs: DataFrame, entries: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, head, blocker): why a request cannot be exported, or null: no base or head, no merge base, a tree with problems.

    ``entries``: trees by commitish (of heads), ``bases``: base, head, merge_base, error.
    """
    broken = problems(entries.where("error is null")).groupBy(F.col("commitish").alias("head")).agg(F.min(F.concat_ws(": ", "path", "problem")).alias("tree"))
    unread = entries.where("error is not null").select(F.col("commitish").alias("head"), F.col("error").alias("unread")).distinct()
    joined = pairs.select("base", "head").distinct().join(bases.select("base", "head", "merge_base"), ["base", "head"], "left").join(unread, "head", "left").join(broken, "head", "left")
    absent = F.coalesce(F.col("base") == "", F.lit(True)) | F.coalesce(F.col("head") == "", F.lit(True))
    why = F.when(absent, "base or head is unknown").when(F.col("merge_base").isNull(), "no merge base").otherwise(F.coalesce("unread", "tree"))
    return joined.select("base", "head", why.alias("blocker"))


def materialize(entries: DataFrame, repo: str, commitish: str, target: str) -> int:
    """Writes the files of one tree below a new folder, and returns how many there are.

    A tree with problems is refused before anything is written. Driver work for one case: files
    are written where the target lies, links as links.
    """
    one = entries.where(F.col("commitish") == commitish)
    if found := problems(one).take(1):
        raise ValueError(f"{found[0]['path']}: {found[0]['problem']}")
    root = Path(target)
    root.mkdir(parents=True)
    n = 0
    for e in one.where("path is not null").toLocalIterator():
        place = root / e["path"]
        place.parent.mkdir(parents=True, exist_ok=True)
        if e["mode"] == "120000":
            place.symlink_to(e["link_target"])
        else:
            place.write_bytes(git(repo, "cat-file", "blob", e["blob"]))
            place.chmod(0o755 if e["mode"] == "100755" else 0o644)
        n += 1
    return n


def uninspected(corrective: DataFrame, diffs: DataFrame) -> DataFrame:
    """(record_id, n, first): candidate commits whose diff could not be read, and the first twenty ids.

    ``corrective``: record_id, sha, log_idx. The list is cut to twenty, as the record holds; the count is exact.
    """
    failed = corrective.join(diffs.where("status = 'error'").select("sha"), "sha", "left_semi")
    ids = F.transform(F.slice(F.array_sort(F.collect_set(F.struct("log_idx", "sha"))), 1, 20), lambda x: x["sha"])
    return failed.groupBy("record_id").agg(F.count_distinct("sha").alias("n"), ids.alias("first"))
