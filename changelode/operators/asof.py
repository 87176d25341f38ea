"""Problem 3: attributes as known at the time of an event, by version numbers.

Changes (an edit becomes known, an edit is deleted) and events (cut-offs) are put on one time
line per entity as narrow rows. The cumulative count of changes up to an event is its version
number; what holds at a number is the same for all events that share it, so wide attributes
are attached afterwards by an equi-join on the entity and the version's edit.

An entity may hold a third of all rows, so nothing is sorted or counted over a whole entity at
once: all time lines are range-sorted together and cut into chunks of about equally many rows,
wherever an entity begins or ends; chunk totals (one row an entity and chunk) are accumulated,
and counts inside chunks are added. Which edit holds at a number is a running maximum for edits
that are never deleted; an edit that is deleted holds for a range of numbers and is filed under
the range's dyadic intervals, at most two a power of two, in which events look up their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelode.functions.times import parse_time
from changelode.plans.durable import durable

ENTITY = ["repository", "pr"]


def squeezed(c: Column) -> Column:
    """A text without white space, for comparison."""
    return F.regexp_replace(c, r"[\s\p{Z}]+", "")


def running(events: DataFrame, entity: list[str], ts: str, order: list[str], sums: dict[str, str], maxima: dict[str, str] | None = None) -> DataFrame:
    """Running sums and maxima of columns in the order of ``ts`` within an entity, up to and with each row.

    ``sums`` and ``maxima`` name a result for a column. Rows are range-sorted by entity and
    order, and a row's chunk is the partition it falls into, written once so that it never
    changes. No window spans more than a chunk's rows or an entity's chunks, however many rows
    an entity has or fall on one time.
    """
    maxima = maxima or {}
    chunked = durable(events.repartitionByRange(*entity, ts, *order).withColumn("_chunk", F.spark_partition_id()))
    chunks = Window.partitionBy(*entity).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk = Window.partitionBy(*entity, "_chunk").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = [F.sum(c).alias(f"_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_{n}") for n, c in maxima.items()]
    before = [F.coalesce(F.sum(f"_{n}").over(chunks), F.lit(0)).alias(f"_{n}_before") for n in sums] + [F.max(f"_{n}").over(chunks).alias(f"_{n}_before") for n in maxima]
    totals = chunked.groupBy(*entity, "_chunk").agg(*per_chunk).select(*entity, "_chunk", *before)
    here = {f"_{n}_here": F.sum(c).over(chunk) for n, c in sums.items()} | {f"_{n}_here": F.max(c).over(chunk) for n, c in maxima.items()}
    both = {n: F.col(f"_{n}_here") + F.col(f"_{n}_before") for n in sums} | {n: F.greatest(f"_{n}_here", f"_{n}_before") for n in maxima}
    joined = chunked.withColumns(here).join(totals, [*entity, "_chunk"]).withColumns(both)
    return joined.drop("_chunk", *here, *(f"_{n}_before" for n in both))


def successors(rows: DataFrame, entity: list[str], order: str) -> DataFrame:
    """(entity, order, later): each row's successor in its entity; ``order`` is unique there. Rows without one are left out.

    Rows are numbered in chunks and meet their successor by an equi-join on entity and number.
    """
    numbered = durable(running(rows.select(*entity, order, F.lit(1).alias("_one")), entity, order, [], {"_number": "_one"}).select(*entity, order, "_number"))
    return numbered.join(numbered.select(*entity, (F.col("_number") - 1).alias("_number"), F.col(order).alias("later")), [*entity, "_number"]).select(*entity, order, "later")


def dyadic_cover(start: Column, end: Column) -> Column:
    """The canonical dyadic intervals of [start, end) as an array of (level, index).

    At level k the rest of the range runs from ceil(start/2^k) to floor(end/2^k); its first
    interval is taken if odd, as is its last; the evens are merged at the next level.
    """
    low = lambda k: F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    high = lambda k: F.call_function("shiftright", end.cast("long"), k)
    node = lambda k, i: F.struct(k.alias("level"), i.alias("index"))
    none = F.lit(None).cast("struct<level:int,index:bigint>")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(40)),
        lambda k: F.array(
            F.when((low(k) < high(k)) & (low(k) % 2 == 1), node(k, low(k))).otherwise(none),
            F.when((low(k) < high(k)) & (high(k) % 2 == 1), node(k, high(k) - 1)).otherwise(none),
        ),
    )
    return F.filter(F.flatten(each), lambda x: x.isNotNull())


def in_force(edits: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case with a cut-off the edit in force, or null: (case_id, edit_id).

    ``edits``: repository, pr, edit_id, edited_at, created_at, deleted_at. ``cases``: case_id,
    repository, pr, cutoff. An edit is known at a cut-off if ``edited_at`` and ``created_at``
    are at or before it and ``deleted_at`` is null or after it; edits without ``edited_at`` or
    ``created_at`` are never known. The known edit with the latest ``edited_at``, then the
    highest id, is in force. Entities or cases with a null key have none.
    """
    known = (
        edits.select(*ENTITY, "edit_id", "edited_at", F.greatest("edited_at", "created_at").alias("from"), "created_at", "deleted_at")
        .where(F.col("edited_at").isNotNull() & F.col("created_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("from"))))
        .drop("created_at")
        .distinct()
        .withColumn("rank", F.struct("edited_at", "edit_id"))
    )
    nothing = F.lit(None).cast("struct<edited_at:timestamp,edit_id:bigint>")
    lasting = F.when(F.col("deleted_at").isNull(), F.col("rank"))
    line = ["ts", "kind", "change", "edit_id", "case_id", "best", "rank"]
    starts = known.select(*ENTITY, F.col("from").alias("ts"), F.lit(0).alias("kind"), F.lit(1).alias("change"), "edit_id", F.lit(None).cast("string").alias("case_id"), lasting.alias("best"), "rank")
    ends = known.where(F.col("deleted_at").isNotNull()).select(
        *ENTITY, F.col("deleted_at").alias("ts"), F.lit(1).alias("kind"), F.lit(1).alias("change"), "edit_id", F.lit(None).cast("string").alias("case_id"), nothing.alias("best"), "rank"
    )
    asked = cases.select(
        *ENTITY, F.col("cutoff").alias("ts"), F.lit(2).alias("kind"), F.lit(0).alias("change"), F.lit(None).cast("bigint").alias("edit_id"), "case_id", nothing.alias("best"), nothing.alias("rank")
    )
    times = starts.unionByName(ends).unionByName(asked).select(*ENTITY, *line)
    numbered = durable(running(times, ENTITY, "ts", ["kind", "edit_id", "case_id"], {"number": "change"}, {"holds": "best"}))

    points = numbered.where(F.col("kind") == 2).select("case_id", *ENTITY, "number", "holds")
    ranges = (
        numbered.where(F.col("kind") < 2)
        .groupBy(*ENTITY, "rank")
        .agg(F.min(F.when(F.col("kind") == 0, F.col("number"))).alias("start"), F.min(F.when(F.col("kind") == 1, F.col("number"))).alias("end"))
        .where(F.col("end").isNotNull() & F.col("start").isNotNull())
    )
    nodes = (
        ranges.select(*ENTITY, "rank", F.explode(dyadic_cover(F.col("start"), F.col("end"))).alias("node"))
        .groupBy(*ENTITY, F.col("node.level").alias("level"), F.col("node.index").alias("index"))
        .agg(F.max("rank").alias("rank"))
    )
    levels = nodes.groupBy(*ENTITY).agg(F.collect_set("level").alias("levels"))
    passing = (
        points.join(levels, ENTITY)
        .select("case_id", *ENTITY, "number", F.explode("levels").alias("level"))
        .withColumn("index", F.expr("shiftright(number, level)"))
        .join(nodes, [*ENTITY, "level", "index"])
        .groupBy("case_id")
        .agg(F.max("rank").alias("passing"))
    )
    return points.join(passing, "case_id", "left").select("case_id", F.greatest("holds", "passing")["edit_id"].alias("edit_id"))


def distinct_edits(body_edits: DataFrame) -> DataFrame:
    """One row for each edit that counts, with its text's digest."""
    return (
        body_edits.where(F.col("edited_at").isNotNull() & F.col("edit_id").isNotNull())
        .select(*ENTITY, "edit_id", "edited_at", "created_at", "deleted_at", F.md5(squeezed(F.col("diff"))).alias("digest"))
        .distinct()
    )


def distinct_cases(review_metadata: DataFrame) -> DataFrame:
    """One row for each case with a readable cut-off, with its description's digest."""
    return (
        review_metadata.select("case_id", *ENTITY, parse_time(F.col("cutoff_timestamp")).alias("cutoff"), F.md5(squeezed(F.col("description"))).alias("digest"))
        .where(F.col("cutoff").isNotNull() & F.col("case_id").isNotNull())
        .distinct()
    )


def known_at_cutoff(body_edits: DataFrame, review_metadata: DataFrame, field_decisions: DataFrame) -> DataFrame:
    """(case_id, kind, ref_id): versions in force, leaked descriptions and leaked decisions.

    Null or unreadable times never count as late; null descriptions and texts equal nothing.
    Repeated rows count once; with no cases or no edits the result has the rows that remain.
    """
    edits, cases = durable(distinct_edits(body_edits)), durable(distinct_cases(review_metadata))
    held = durable(in_force(edits, cases))
    versions = held.where(F.col("edit_id").isNotNull()).select("case_id", F.lit("version").alias("kind"), F.col("edit_id").alias("ref_id"))

    held_text = held.join(edits.select("edit_id", F.col("digest").alias("held")).distinct(), "edit_id", "left").select("case_id", "held")
    open_cases = (
        cases.where(F.col("digest").isNotNull())
        .join(held_text, "case_id", "left")
        .where(F.col("held").isNull() | (F.col("held") != F.col("digest")))
        .select("case_id", *ENTITY, "cutoff", "digest")
    )
    # The lowest later edit with the same text: a running minimum over one time line, read backwards,
    # for each entity and digest, so that many cases never meet many edits of one text.
    key = [*ENTITY, "digest"]
    late = edits.join(open_cases.select(*key).distinct(), key, "left_semi").select(*key, (-F.unix_micros(F.greatest("edited_at", "created_at"))).alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("case_id"), (-F.col("edit_id")).alias("best"))
    asked = open_cases.select(*key, (-F.unix_micros("cutoff")).alias("ts"), F.lit(0).alias("kind"), "case_id", F.lit(None).cast("bigint").alias("best"))
    lowest = running(late.unionByName(asked), key, "ts", ["kind", "best", "case_id"], {}, {"found": "best"}).where("case_id is not null and found is not null")
    leaks = lowest.groupBy("case_id").agg(F.min(-F.col("found")).alias("ref_id")).select("case_id", F.lit("description_leak").alias("kind"), "ref_id")
    decisions = (
        field_decisions.where("included and decision_id is not null")
        .select("case_id", "decision_id", parse_time(F.col("valid_at")).alias("valid_at"))
        .join(cases.select("case_id", "cutoff"), "case_id")
        .where(F.col("valid_at") > F.col("cutoff"))
        .select("case_id", F.lit("decision_leak").alias("kind"), F.col("decision_id").alias("ref_id"))
        .distinct()
    )
    return versions.unionByName(leaks).unionByName(decisions)


def described_as_known(body_edits: DataFrame, review_metadata: DataFrame) -> DataFrame:
    """(case_id, edit_id, text): the wide text of the version in force, attached by equi-join."""
    edits, cases = distinct_edits(body_edits), durable(distinct_cases(review_metadata))
    held = durable(in_force(edits, cases).join(cases.select("case_id", *ENTITY), "case_id"))
    # Only texts that are held by a case move; others are dropped where they are read.
    wanted = held.where("edit_id is not null").select("edit_id").distinct()
    texts = body_edits.join(wanted, "edit_id", "left_semi").select(*ENTITY, "edit_id", F.col("diff").alias("text")).dropDuplicates(["edit_id"])
    return held.join(texts, [*ENTITY, "edit_id"], "left").select("case_id", "edit_id", "text")
