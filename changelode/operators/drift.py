"""Problem 4: schemas that drift between files, by tagged-union inference.

Each readable line gives a schema whose leaves carry type tags; schemas of one file are fused
into, per path, the set of alternative types with counts and a profile of the values. Fusing
is associative, so lines fuse inside a batch before anything is shuffled, and what travels is
bounded by files times paths, not by lines. Files are compared with their predecessor in the
stream; new alternatives are reported, conflicts split into typed branches, and every branch
converts to one canonical column.

Reading: a line is readable if it is one JSON object. Null values count as absent. An array's
elements have no field of their own; the fields of its objects follow ``[]``.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelode.functions.times import parse_time

TYPES = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array"}

#: Kinds of scalar values, tried in this order; the share of each in a file is its profile.
SHAPES = [
    ("time", re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?$")),
    ("url", re.compile(r"[a-z][a-z0-9+.-]*://\S+$", re.I)),
    ("flag", re.compile(r"(true|false|yes|no)$", re.I)),
    ("count", re.compile(r"[+-]?\d+$")),
    ("version", re.compile(r"v?\d+(\.\d+)+$")),
    ("id", re.compile(r"(?=\S*\d)[\w/+.-]+$")),
    ("word", re.compile(r"\S+$")),
    ("text", re.compile(r"")),
]
KINDS = [k for k, _ in SHAPES] + ["small", "large", "moment", "fraction", "boolean", "nested"]


def kind_of(value: Any) -> str:
    """The kind of a value, finer than its JSON type."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "fraction" if isinstance(value, float) and value != int(value) else "moment" if abs(value) >= 3e8 else "large" if abs(value) >= 3e4 else "small"
    if isinstance(value, str):
        return next(k for k, p in SHAPES if p.match(value.strip()))
    if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
        return "word"
    return "nested"


def readable(raw: str | None) -> dict | None:
    """The object on a line, or None if the line is null, blank, cut off or no object."""
    if not raw or not raw.strip():
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


TAGS = {t: 1 << i for i, t in enumerate(("string", "boolean", "number", "object", "array"))}
KIND_PLACE = {k: i for i, k in enumerate(KINDS)}


def fuse(value: dict, into: dict[str, list], at: str = "") -> None:
    """Adds one object's tagged paths to ``into``: path -> [count, tags, total length, kinds]."""
    for name, x in value.items():
        if x is None:
            continue
        path = f"{at}.{name}" if at else name
        if (entry := into.get(path)) is None:
            entry = into[path] = [0, 0, 0, [0] * len(KINDS)]
        entry[0] += 1
        entry[1] |= TAGS[TYPES[type(x)]]
        entry[2] += len(x) if isinstance(x, (str, list, dict)) else len(str(x))
        entry[3][KIND_PLACE[kind_of(x)]] += 1
        if isinstance(x, dict):
            fuse(x, into, path)
        elif isinstance(x, list):
            _fuse_items(x, into, path + "[]")


def _fuse_items(items: list, into: dict[str, list], at: str) -> None:
    for item in items:
        if isinstance(item, dict):
            fuse(item, into, at)
        elif isinstance(item, list):
            _fuse_items(item, into, at + "[]")


def shapes(bundles: DataFrame) -> DataFrame:
    """One row for each file and path: tags of its types as bits, count, length and kinds of its values."""
    counts = ["n", "types", "size", *KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files: dict[tuple[str, str], dict[str, list]] = defaultdict(dict)
            for stream, file, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (obj := readable(raw)) is not None:
                    fuse(obj, files[stream, file])
            rows = [(stream, file, path, n, tags, size, *kinds) for (stream, file), paths in files.items() for path, (n, tags, size, kinds) in paths.items()]
            columns = list(zip(*rows)) or [()] * (3 + len(counts))
            arrays = [pa.array(c, pa.string()) for c in columns[:3]] + [pa.array(c, pa.int64()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["stream", "file_name", "path", *counts])

    ddl = "stream string, file_name string, path string, " + ", ".join(f"`{c}` bigint" for c in counts)
    partial = bundles.where("stream is not null and file_name is not null and raw is not null").select("stream", "file_name", "raw").mapInArrow(run, ddl)
    return (
        partial.groupBy("stream", "file_name", "path")
        .agg(F.bit_or("types").alias("types"), F.sum("n").alias("n"), F.sum("size").alias("size"), *[F.sum(k).alias(k) for k in KINDS])
        .select("stream", "file_name", "path", F.struct("types", "n", "size", F.array(*KINDS).alias("kinds")).alias("shape"))
    )


def successors(bundles: DataFrame) -> DataFrame:
    """(stream, file_name, next_name): each file's successor by ``written_at``, then name.

    In two levels, weeks and files within a week, so that a stream with very many files is
    never sorted as one group.
    """
    files = bundles.where("stream is not null and file_name is not null").groupBy("stream", "file_name").agg(F.min("written_at").alias("at")).withColumn("week", F.coalesce(F.date_trunc("week", "at"), F.timestamp_seconds(F.lit(0))))
    first = files.groupBy("stream", "week").agg(F.min(F.struct("at", "file_name")).alias("first"))
    following = first.select("stream", "week", F.lead("first").over(Window.partitionBy("stream").orderBy("week"))["file_name"].alias("later"))
    inside = Window.partitionBy("stream", "week").orderBy("at", "file_name")
    return files.withColumn("next_name", F.lead("file_name").over(inside)).join(following, ["stream", "week"]).select("stream", "file_name", F.coalesce("next_name", "later").alias("next_name"))


def differences(shape: DataFrame, order: DataFrame) -> DataFrame:
    """(stream, file_name, path, old, new) where a file and its predecessor differ in a path.

    ``old`` or ``new`` is null where the path is absent. The first file has none; a file
    without a readable line differs from its neighbours in everything.
    """
    new = shape.select("stream", "file_name", "path", F.lit(None).cast(shape.schema["shape"].dataType).alias("old"), F.col("shape").alias("new"))
    old = shape.join(order, ["stream", "file_name"]).where(F.col("next_name").isNotNull()).select("stream", F.col("next_name").alias("file_name"), "path", F.col("shape").alias("old"), F.lit(None).cast(shape.schema["shape"].dataType).alias("new"))
    later = order.where(F.col("next_name").isNotNull()).select("stream", F.col("next_name").alias("file_name"))
    return (
        new.join(later, ["stream", "file_name"], "left_semi")
        .unionByName(old)
        .groupBy("stream", "file_name", "path")
        .agg(F.max("old").alias("old"), F.max("new").alias("new"))
        .where(F.col("old").isNull() | F.col("new").isNull() | (F.col("old.types") != F.col("new.types")))
    )


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _holder(parent: str) -> str:
    """The field that holds the objects a parent path names."""
    return re.sub(r"(\[\])+$", "", parent)


def _words(path: str) -> set[str]:
    return set(re.findall(r"[a-z]+", path.rpartition(".")[2].lower()))


def _under(paths: set[str], top: str) -> set[str]:
    return {p[len(top) :] for p in paths if p.startswith((top + ".", top + "[]"))}


def alike(old: Any, new: Any, old_path: str, new_path: str, removed: set[str], added: set[str]) -> float:
    """How well a field that went and one that came pass for the same field; 0 if they don't.

    Types must be equal and so must the prevailing kind of value; objects and arrays of objects
    must share fields. Beyond that, shared words of the names, similar lengths and similar
    presence decide between several.
    """
    if old["types"] != new["types"]:
        return 0.0
    nested_old, nested_new = _under(removed, old_path), _under(added, new_path)
    if nested_old or nested_new:
        shared = len(nested_old & nested_new) / max(1, len(nested_old | nested_new))
        if shared < 0.25:
            return 0.0
        score = 1 + shared
    else:
        total_o, total_n = max(1, sum(old["kinds"])), max(1, sum(new["kinds"]))
        overlap = sum(min(a / total_o, b / total_n) for a, b in zip(old["kinds"], new["kinds"]))
        if overlap < 0.5:
            return 0.0
        score = overlap
    words_o, words_n = _words(old_path), _words(new_path)
    mean_o, mean_n = old["size"] / max(1, old["n"]), new["size"] / max(1, new["n"])
    score += len(words_o & words_n) / max(1, len(words_o | words_n))
    score += 0.6 * min(mean_o, mean_n) / max(mean_o, mean_n, 1e-9)
    return score + 0.3 * min(old["n"], new["n"]) / max(old["n"], new["n"])


def changes(rows: list[tuple[str, Any, Any]], apart: set[tuple[str, str]] | None) -> list[tuple[str, str, str]]:
    """(change, field_path, old_path) of one file, from its differing paths.

    ``apart`` holds pairs of paths that occur side by side in some file: such fields are two
    and never one renamed. With ``apart`` None, the candidate pairs come out instead.
    """
    removed = {p: o for p, o, n in rows if n is None}
    added = {p: n for p, o, n in rows if o is None}
    retyped = {p for p, o, n in rows if o is not None and n is not None}
    out: list[tuple[str, str, str]] = []
    renamed: dict[str, str] = {}
    gone_o, gone_n = set(removed), set(added)

    def moved(path: str) -> str:
        """An old path under renamed holders, as it would be called now."""
        holder = _holder(_parent(path))
        if not holder:
            return path
        now = renamed.get(holder) or moved(holder)
        return now + path[len(holder) :]

    def settled(path: str, gone: set[str]) -> bool:
        """Whether all holders of ``path`` are unchanged, so that it is its own account."""
        holder = _holder(_parent(path))
        return not holder or (holder not in gone and holder not in retyped and settled(holder, gone))

    depth = lambda p: p.count(".")
    for level in range(1 + max([0, *map(depth, [*removed, *added])])):
        olds = [p for p in removed if depth(p) == level and settled(p, gone_o)]
        news = [p for p in added if depth(p) == level and settled(p, gone_n)]
        for o in list(olds):  # kept under a renamed holder
            if moved(o) != o and moved(o) in news:
                if removed[o]["types"] != added[moved(o)]["types"]:
                    out.append(("type_changed", moved(o), ""))
                else:
                    renamed[o] = moved(o)
                    gone_o.discard(o)
                    gone_n.discard(moved(o))
                news.remove(moved(o))
                olds.remove(o)
        pairs = []
        for o in olds:
            for n in news:
                if _parent(moved(o)) == _parent(n) and (s := alike(removed[o], added[n], o, n, set(removed), set(added))):
                    pairs.append((-s, o, n))
        if apart is None:
            out += [("candidate", n, o) for _, o, n in pairs]
            pairs = [x for x in pairs]
        for _, o, n in sorted(pairs):
            if o in olds and n in news and (apart is None or ((o, n) not in apart and (n, o) not in apart)):
                out.append(("renamed", n, o))
                renamed[o] = n
                gone_o.discard(o)
                gone_n.discard(n)
                olds.remove(o)
                news.remove(n)
        out += [("removed", o, "") for o in olds] + [("added", n, "") for n in news]
    out += [("type_changed", p, "") for p in retyped if settled(p, gone_o | gone_n)]
    return out


def drift(bundles: DataFrame) -> DataFrame:
    """(file_name, change, field_path, old_path) of every change between consecutive files."""
    from changelode.plans.durable import durable

    return decided(bundles, durable(shapes(bundles))).drop("stream")


def decided(bundles: DataFrame, shape: DataFrame) -> DataFrame:
    """(stream, file_name, change, field_path, old_path) of every change, given the files' shapes.

    Renames are decided with evidence from all files: of two names that stand side by side in
    any file, neither replaced the other. Those pairs are found by equi-joins on the paths that
    are candidates at all. What one task sees is a file's differing paths, which its schema bounds.
    """
    from changelode.plans.durable import durable

    diff = durable(differences(shape, successors(bundles)))

    # One row a file with all its differing paths; the schema bounds the row.
    per_file = durable(diff.groupBy("stream", "file_name").agg(F.sort_array(F.collect_list(F.struct("path", "old", "new"))).alias("rows")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({(o, n) for rows in b.column(0).to_pylist() for c, n, o in changes(_entries(rows), None) if c == "candidate"})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["a", "b"])

    pairs = per_file.select("rows").mapInArrow(candidates, "a string, b string").distinct()
    # Names stand side by side in distinct sets of candidate names, which are far fewer than files.
    names = pairs.select(F.col("a").alias("path")).unionByName(pairs.select(F.col("b").alias("path"))).distinct()
    sets = shape.select("stream", "file_name", "path").join(names, "path").groupBy("stream", "file_name").agg(F.sort_array(F.collect_set("path")).alias("paths")).select("paths").distinct()
    member = sets.select(F.sha2(F.to_json("paths"), 256).alias("set"), F.explode("paths").alias("path"))
    apart = pairs.join(member.withColumnRenamed("path", "a"), "a").join(member.withColumnRenamed("path", "b"), ["set", "b"], "left_semi").select("a", "b").distinct()
    # Each file takes the pairs among its own differing paths.
    own = (
        diff.select("stream", "file_name", F.col("path").alias("a")).join(apart, "a").join(diff.select("stream", "file_name", F.col("path").alias("b")), ["stream", "file_name", "b"], "left_semi")
    )
    kept = own.groupBy("stream", "file_name").agg(F.collect_set(F.struct("a", "b")).alias("apart"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, str, str, str, str]] = []
            for stream, file, rows, sets in zip(*(b.column(i).to_pylist() for i in range(4))):
                out += [(stream, file, *x) for x in changes(_entries(rows), {(x["a"], x["b"]) for x in sets or ()})]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(5)], names=["stream", "file_name", "change", "field_path", "old_path"])

    return per_file.join(kept, ["stream", "file_name"], "left").select("stream", "file_name", "rows", "apart").mapInArrow(decide, "stream string, file_name string, change string, field_path string, old_path string")


def _entries(rows: list[dict]) -> list[tuple[str, Any, Any]]:
    return [(r["path"], r["old"], r["new"]) for r in rows]


def one_name(renames: list[tuple[str, str, int]], schemas: list[tuple[Any, list[str]]]) -> dict[str, str]:
    """Path -> canonical path of one stream, for the paths whose canonical path is another.

    ``renames`` are (old, new, files), ``schemas`` the distinct sets of paths of its files with
    their first time. Names that replace each other are one field, called by the name that came
    first; fields below a renamed one go with it. Two names that stand side by side in a file
    are never made one, even if a chain of renames leads from one to the other; of such a
    chain the renames of most files hold.
    """
    first: dict[str, tuple] = {}
    for at, paths in schemas:
        for p in paths:
            first[p] = min(first.get(p, (at, p)), (at, p))
    group: dict[str, set[str]] = {}  # path under its canonical parent -> all that are one with it
    called: dict[str, str] = {}

    def key(path: str) -> str:
        parent, dot, name = path.rpartition(".")
        return name if not dot else f"{canon(_holder(parent))}{parent[len(_holder(parent)) :]}.{name}"

    def canon(path: str) -> str:
        return called.get(k := key(path), k)

    depth = lambda p: p.count(".")
    for level in sorted({depth(o) for o, _, _ in renames}):
        stand = [{key(p) for p in paths if depth(p) == level} for _, paths in schemas]
        born: dict[str, tuple] = {}
        for p, at in first.items():
            if depth(p) == level:
                born[key(p)] = min(born.get(key(p), at), at)
        for _, o, n in sorted((-files, key(o), key(n)) for o, n, files in renames if depth(o) == level):
            a, b = group.get(o, {o}), group.get(n, {n})
            if n not in a and _parent(o) == _parent(n) and not any(a & s and b & s for s in stand):
                group |= dict.fromkeys(a | b, a | b)
        for k, names in group.items():
            if depth(k) == level:
                called[k] = min(names, key=lambda x: (born.get(x, (float("inf"), x)), x))
    return {p: c for p in first if (c := canon(p)) != p}


def canonical_paths(bundles: DataFrame, shape: DataFrame) -> DataFrame:
    """(stream, file_name, path, name, shape): every file's paths with the name of their field in the stream.

    What one task sees of a stream is its distinct renames and its distinct sets of paths, not its files.
    """
    from changelode.plans.durable import durable

    renames = decided(bundles, shape).where("change = 'renamed'").groupBy("stream", "old_path", "field_path").agg(F.count("*").alias("n"))
    renames = durable(renames.groupBy("stream").agg(F.collect_list(F.struct("old_path", "field_path", "n")).alias("renames")))
    written = bundles.where("stream is not null and file_name is not null").groupBy("stream", "file_name").agg(F.coalesce(F.min(F.unix_micros("written_at")), F.lit(0)).alias("at"))
    sets = shape.groupBy("stream", "file_name").agg(F.sort_array(F.collect_list("path")).alias("paths")).join(renames.select("stream"), "stream", "left_semi")
    sets = sets.join(written, ["stream", "file_name"]).groupBy("stream", "paths").agg(F.min("at").alias("at")).groupBy("stream").agg(F.collect_list(F.struct("at", "paths")).alias("sets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stream, pairs, seen in zip(*(b.column(i).to_pylist() for i in range(3))):
                names = one_name([(r["old_path"], r["field_path"], r["n"]) for r in pairs], [(x["at"], x["paths"]) for x in seen])
                out += [(stream, *x) for x in names.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["stream", "path", "name"])

    named = renames.join(sets, "stream").select("stream", "renames", "sets").mapInArrow(run, "stream string, path string, name string")
    return shape.join(named, ["stream", "path"], "left").select("stream", "file_name", "path", F.coalesce("name", "path").alias("name"), "shape")


def _kinds(*names: str) -> Column:
    """How many values of a path are of some kinds."""
    total = F.lit(0)
    for n in names:
        total = total + F.element_at("shape.kinds", KIND_PLACE[n] + 1)
    return F.sum(total)


def field_types(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, type): the one type all values of a field convert to without loss; of :func:`canonical_paths`.

    A field is a time if it has times as text and its numbers could all be moments; numbers
    alone stay numbers, however large. Text that mostly counts does not make numbers of text.
    """
    profile = paths.groupBy(*keys).agg(
        F.bit_or("shape.types").alias("tags"), F.sum("shape.n").alias("n"), _kinds("time").alias("times"), _kinds("moment").alias("moments"), _kinds("count").alias("counts"), _kinds("flag").alias("flags"),
        _kinds("url", "flag", "count", "version", "id", "word", "text").alias("other_text"), _kinds("small", "large", "fraction").alias("other_numbers"),
    )
    has = lambda *tags: F.col("tags").bitwiseAND(F.lit(sum(TAGS[t] for t in tags))) == F.col("tags")
    kind = (
        F.when(has("string", "number") & (F.col("times") > 0) & (F.col("other_text") == 0) & (F.col("other_numbers") == 0), "timestamp")
        .when(has("number"), "double")
        .when(has("boolean") | (has("boolean", "string") & (F.col("flags") == F.col("other_text")) & (F.col("times") == 0) & (F.col("tags") != TAGS["string"])), "boolean")
        .when(has("number", "string") & (F.col("counts") == F.col("other_text")) & (F.col("times") == 0) & (F.col("tags") != TAGS["string"]), "double")
        .otherwise("string")
    )
    return profile.select(*keys, "n", "tags", kind.alias("type"))


def moment(v: float) -> str | None:
    """Seconds or milliseconds since 1970 as an ISO time, or None if no calendar has it."""
    try:
        at = datetime.fromtimestamp(v / 1000 if abs(v) > 3e11 else v, timezone.utc)
    except (OverflowError, OSError, ValueError):
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


def plain(v: Any, time: bool) -> str | None:
    """The canonical text of a value: true or false, ISO times for the moments of a time field, JSON for what nests."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    if time and isinstance(v, (int, float)):
        return moment(v) or json.dumps(v)
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _lines(bundles: DataFrame, paths: DataFrame) -> DataFrame:
    """(stream, file_name, line_no, raw, names): each line once, with (path, name, time) of its file's renamed or time fields.

    A file's lines come together, so that neither the distinct lines nor the names move the texts again.
    """
    times = field_types(paths, ["stream", "name"]).where("type = 'timestamp'").select("stream", "name", F.lit(True).alias("time"))
    told = paths.join(times, ["stream", "name"], "left").where("name != path or time").select("stream", "file_name", F.struct("path", "name", F.coalesce("time", F.lit(False)).alias("time")).alias("x"))
    names = told.groupBy("stream", "file_name").agg(F.collect_list("x").alias("names"))
    once = bundles.select("stream", "file_name", "line_no", "raw").where("raw is not null").repartition("stream", "file_name").dropDuplicates(["stream", "file_name", "line_no"])
    return once.join(names, ["stream", "file_name"], "left").select("stream", "file_name", "line_no", "raw", "names")


def branches(bundles: DataFrame) -> DataFrame:
    """All readable bundles, one row for each line and path, one at least a line.

    Columns: stream, file_name, line_no, path, the typed branches ``as_string``, ``as_number``,
    ``as_boolean``, ``as_json`` (objects' and arrays' own text), of which one is set, and
    ``value``, the canonical text all branches convert to (true/false for flags, ISO times for
    the moments of time fields). ``path`` is the file's own, with positions in arrays
    (``a.b[2].c``); ``field_path`` drops them and has the one name of its field in the stream,
    through all renames that were decided. An object without fields has its path with ``{}``, a
    line without fields an empty path and no value. Repeated lines count once.
    """
    from changelode.plans.durable import durable

    def walk(v: Any, path: str) -> Iterator[tuple[str, Any]]:
        if isinstance(v, dict) and any(x is not None for x in v.values()):
            for k, x in v.items():
                if x is not None:
                    yield from walk(x, f"{path}.{k}" if path else k)
        elif isinstance(v, dict):
            yield path, {} if path else None
        elif isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v):
            for i, x in enumerate(v, 1):
                if x is not None:
                    yield from walk(x, f"{path}[{i}]")
        else:
            yield path, v

    def number(v: Any) -> float | None:
        try:
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        except OverflowError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["stream", "file_name", "line_no", "path", "field_path", "as_string", "as_number", "as_boolean", "as_json", "value"]
        for b in batches:
            rows = []
            for stream, file, no, raw, told in zip(b["stream"], b["file_name"], b["line_no"], b["raw"], b["names"]):
                if (obj := readable(raw)) is None:
                    continue
                named, times = _told(told)
                for path, v in walk(obj, ""):
                    field = re.sub(r"\[\d+\]", "[]", path)
                    rows.append(
                        (stream, file, no, path, _named(field, named), v if isinstance(v, str) else None, number(v), v if isinstance(v, bool) else None)
                        + (json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else None, plain(v, field in times))
                    )
            yield pd.DataFrame(rows, columns=names)

    ddl = "stream string, file_name string, line_no int, path string, field_path string, as_string string, as_number double, as_boolean boolean, as_json string, value string"
    return _lines(bundles, durable(canonical_paths(bundles, durable(shapes(bundles))))).mapInPandas(run, ddl)


def _told(told: Any) -> tuple[dict[str, str], set[str]]:
    rows = told if told is not None else []
    return {x["path"]: x["name"] for x in rows if x["name"] != x["path"]}, {x["path"] for x in rows if x["time"]}


MAX_COLUMNS = 1000  # fields that have columns of their own, the most frequent ones; all others share a map


def canonical(bundles: DataFrame) -> DataFrame:
    """All readable bundles in one consistent table: one row a line, one column a field.

    Columns: stream, file_name, line_no, then each field outside of arrays under its one name
    through all renames (``a.b`` is ``a_b``), in the one type all its values convert to without
    loss (number, boolean, time, else text). Arrays are JSON text with the one names inside, as
    is an object where other files have a value. ``other_fields`` maps the names of fields
    beyond MAX_COLUMNS to their text. Fields a line lacks are null; a line without fields has
    nulls only. Repeated lines count once.
    """
    from changelode.plans.durable import durable

    paths = durable(canonical_paths(bundles, durable(shapes(bundles))))
    top = field_types(paths.where("path not like '%[]%' and name not like '%[]%'"), ["name"]).where(F.col("tags") != TAGS["object"])
    chosen = sorted((r["name"], r["type"]) for r in top.orderBy(F.desc("n"), "name").limit(MAX_COLUMNS).collect())
    place = {name: i for i, (name, _) in enumerate(chosen)}
    titles: list[str] = []
    for name, _ in chosen:
        title = name.replace(".", "_")
        taken = {t.lower() for t in titles} | {"stream", "file_name", "line_no", "other_fields"}
        k = 2
        while title.lower() in taken:
            title, k = f"{name.replace('.', '_')}_{k}", k + 1
        titles.append(title)

    def renamed(v: Any, path: str, named: dict[str, str]) -> Any:
        if isinstance(v, list):
            return [renamed(x, path + "[]", named) for x in v]
        if isinstance(v, dict):
            return {_named(p, named).rpartition(".")[2]: renamed(x, p, named) for k, x in v.items() if x is not None for p in [f"{path}.{k}"]}
        return v

    def flat(v: dict, path: str, named: dict[str, str]) -> Iterator[tuple[str, str, Any]]:
        for k, x in v.items():
            if x is not None:
                p = f"{path}.{k}" if path else k
                name = _named(p, named)
                if isinstance(x, dict) and name not in place:
                    yield from flat(x, p, named)
                else:
                    yield p, name, renamed(x, p, named) if isinstance(x, (dict, list)) else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[tuple] = []
            cells: list[list] = [[] for _ in chosen]
            others: list[list] = []
            for stream, file, no, raw, told in zip(*(c.to_pylist() for c in b.columns)):
                if (obj := readable(raw)) is None:
                    continue
                named, times = _told(told)
                row: list = [None] * len(chosen)
                rest: dict[str, str] = {}
                for path, name, v in flat(obj, "", named):
                    text = plain(v, path in times)
                    if (i := place.get(name)) is None:
                        rest[name] = text
                    else:
                        row[i] = text
                keys.append((stream, file, no))
                others.append(list(rest.items()))
                for cell, x in zip(cells, row):
                    cell.append(x)
            head = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, pa.string()) for c in cells), pa.array(others, pa.map_(pa.string(), pa.string()))], names=["stream", "file_name", "line_no", *(f"c{i}" for i in range(len(chosen))), "other_fields"])

    ddl = "stream string, file_name string, line_no int, " + "".join(f"c{i} string, " for i in range(len(chosen))) + "other_fields map<string,string>"
    wide = _lines(bundles, paths).mapInArrow(run, ddl)
    typed = {"timestamp": lambda c: parse_time(c), "string": lambda c: c}
    columns = [typed.get(kind, lambda c, kind=kind: c.try_cast(kind))(F.col(f"c{i}")).alias(title) for i, ((_, kind), title) in enumerate(zip(chosen, titles))]
    return wide.select("stream", "file_name", "line_no", *columns, "other_fields")


def _named(field: str, named: dict[str, str]) -> str:
    """The canonical name of a path, or of the longest beginning of it that has one."""
    holder = field
    while holder and holder not in named:
        holder = _holder(holder) if holder.endswith("[]") else _parent(holder)
    return named[holder] + field[len(holder) :] if holder else field
