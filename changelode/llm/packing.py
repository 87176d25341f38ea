"""Problem 7: filling containers of fixed capacity, by bulk-synchronous best fit.

Documents and gaps are swept in the order of their sizes, and all documents of one size and all
containers with one gap move together, as runs: a round takes the largest open size, matches
its run with the successor gap (the smallest that holds the size), gives conflicts to the lower
rank, moves the filled containers to their new gap, and repeats until the run is placed; what
finds no gap opens containers. Sizes are whole numbers up to the capacity, so the sweep's state
is a histogram of at most ``capacity`` runs whatever the number of documents. One task sweeps
the histogram of one window; ranks within a size, and with them each document's container, are
computed where the documents are. Nothing is collected.

Defined results: every document is placed in every window; one larger than the capacity is cut
into full pieces and a rest, others never. Documents without tokens (null and empty texts) are
spread over the containers and use no space. Windows with a null or non-positive capacity have
no rows, one listed with several capacities has the largest; without documents the result is empty.
"""

from __future__ import annotations

import bisect
import functools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelode.plans.durable import durable

GROUP_WINDOWS = 1000  # windows that are filled together
GROUP_ROWS = 200_000  # ranks are made in groups of about so many rows
BLOCK = 1 << 16  # ranks that look for their segment together
SENT = 200_000  # rows of a plan, some megabytes, that are sent to all tasks; a larger one is shuffled


class Gaps:
    """Containers by gap, as runs of consecutive numbers."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first, count)
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap not in self.runs:
            bisect.insort(self.sizes, gap)
        self.runs[gap].append((first, count))

    def successor(self, size: int) -> int | None:
        i = bisect.bisect_left(self.sizes, size)
        return self.sizes[i] if i < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` containers with this gap."""
        first, count = self.runs[gap].pop()
        if count > most:
            self.runs[gap].append((first + most, count - most))
        elif not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(bisect.bisect_left(self.sizes, gap))
        return first, min(count, most)


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Per size the segments (first rank, first container, documents a container), and the number of containers."""
    gaps, opened = Gaps(), 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    for size in sorted((s for s in counts if s > 0), reverse=True):
        rank, left, segments = 0, counts[size], []
        while left:
            gap = gaps.successor(size)
            if gap is None:
                each = capacity // size
                full, rest = divmod(left, each)
                segments.append((rank, opened, each))
                if full:
                    gaps.add(capacity - each * size, opened, full)
                if rest:
                    gaps.add(capacity - rest * size, opened + full, 1)
                opened += full + (rest > 0)
                break
            first, n = gaps.take(gap, left)
            segments.append((rank, first, 1))
            gaps.add(gap - size, first, n)
            rank, left = rank + n, left - n
        out[size] = segments
    return out, opened


def pieces(sizes: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """(window_id, doc_id, piece, start_token, n_tokens): whole documents, or full pieces and a rest."""
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("window_id"), F.lit(c).cast("bigint").alias("capacity")) for w, c in windows]))
    n, c = F.col("n_tokens"), F.col("w.capacity")
    parts = F.greatest(F.lit(1), F.ceil(n / c).cast("int"))
    return (
        sizes.select("doc_id", "n_tokens", each.alias("w"))
        .withColumn("piece", F.explode(F.sequence(F.lit(1), parts)))
        .select(F.col("w.window_id").alias("window_id"), "doc_id", "piece", ((F.col("piece") - 1) * c).alias("start_token"), F.greatest(F.lit(0), F.least(c, n - (F.col("piece") - 1) * c)).alias("n_tokens"))
    )


def ranked(items: DataFrame, keys: list[str], order: list[str], groups: Column) -> DataFrame:
    """``items`` with ``rank`` (from 0) within ``keys``; a frequent key is cut into ``groups`` parts.

    Parts are ranked apart and offset by the totals of the parts before, so no window spans
    more rows than a part, however many share a key.
    """
    cut = items.withColumn("_part", F.pmod(F.xxhash64(*order), groups))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    return cut.withColumn("_here", F.row_number().over(part) - 1).join(totals, [*keys, "_part"]).withColumn("rank", F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def capacities(pack_windows: DataFrame) -> Iterator[list[tuple[int, int]]]:
    """The windows that hold something, in groups of about GROUP_WINDOWS; the tables have one group."""
    rows = pack_windows.where("capacity_tokens > 0 and window_id is not null").groupBy("window_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    groups = max(1, -(-rows.count() // GROUP_WINDOWS))
    for g in range(groups):
        if part := rows.where(F.pmod(F.xxhash64("window_id"), F.lit(groups)) == g).collect():
            yield sorted((r[0], r[1]) for r in part)


KEYS = ["window_id", "n_tokens"]
PLAN = "window_id bigint, n_tokens bigint, rank bigint, until bigint, first bigint, each bigint, containers bigint, n bigint"


def plans(histogram: DataFrame) -> DataFrame:
    """(window_id, n_tokens, rank, until, first, each, containers, n): where the documents of each size go, by their ranks.

    ``histogram``: window_id, capacity, n_tokens, n. One task plans one window, from at most
    ``capacity`` + 1 rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window, capacity = int(pdf["window_id"].iloc[0]), int(pdf["capacity"].iloc[0])
        counts = {int(s): int(n) for s, n in zip(pdf["n_tokens"], pdf["n"])}
        made, opened = plan(counts, capacity)
        rows = []
        for size, n in counts.items():
            segments = made[size] if size else [(0, 0, 1)]
            ends = [s[0] for s in segments[1:]] + [n]
            rows += [(window, size, rank, end, first, each, max(1, opened), n) for (rank, first, each), end in zip(segments, ends)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return histogram.groupBy("window_id").applyInPandas(run, PLAN)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be sent to all tasks if it has at most SENT rows, else to be shuffled."""
    return F.broadcast(df) if rows <= SENT else df


def pack(sizes: DataFrame, pack_windows: DataFrame) -> DataFrame:
    """(window_id, doc_id, piece, start_token, n_tokens, container_id) of every document.

    ``sizes``: doc_id, n_tokens; it is read twice, so hand in a written or checkpointed table.
    """
    out = sizes.sparkSession.createDataFrame([], "window_id bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint, container_id bigint")
    parts = [_pack(sizes, windows) for windows in capacities(pack_windows)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else out


def _pack(sizes: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    items = pieces(sizes, windows)
    capacity = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for w in windows for x in w]), F.col("window_id"))
    made = durable(plans(items.groupBy(*KEYS).agg(F.count("*").alias("n")).withColumn("capacity", capacity)))
    rows = made.count()
    order = ["doc_id", "piece"]
    known = _small(made.where("rank = 0").select(*KEYS, (F.floor(F.col("n") / GROUP_ROWS) + 1).alias("groups")), rows)
    numbered = ranked(items.join(known, KEYS).select(*KEYS, *order, "start_token", "groups"), KEYS, order, F.col("groups"))
    # Segments by blocks of ranks, so that a document meets only those of its block.
    block = F.explode(F.sequence(F.floor(F.col("rank") / BLOCK), F.floor((F.greatest(F.col("until"), F.col("rank") + 1) - 1) / BLOCK))).alias("block")
    blocks = made.select(*KEYS, "containers", "rank", "first", "each", block).groupBy(*KEYS, "block", "containers").agg(F.sort_array(F.collect_list(F.struct("rank", "first", "each"))).alias("segments"))
    joined = numbered.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(_small(blocks, rows), [*KEYS, "block"])
    segment = F.element_at(F.filter("segments", lambda s: s["rank"] <= F.col("rank")), -1)
    container = F.when(F.col("n_tokens") == 0, F.col("rank") % F.col("containers")).otherwise(segment["first"] + F.floor((F.col("rank") - segment["rank"]) / segment["each"]))
    return joined.select("window_id", "doc_id", "piece", "start_token", "n_tokens", (container + 1).cast("bigint").alias("container_id"))


def fill_report(packed: DataFrame, pack_windows: DataFrame) -> DataFrame:
    """Per window: containers, tokens, the least possible number of containers, and the filled share."""
    windows = pack_windows.where("capacity_tokens > 0").groupBy("window_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return (
        packed.groupBy("window_id", "container_id").agg(F.sum("n_tokens").alias("used"))
        .groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .join(windows, "window_id")
        .select("window_id", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
    )
