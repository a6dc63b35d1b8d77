"""Mixing of sources to target weights by weighted fair queueing.

Each source is a queue.  Its documents stand in a shuffled order (by the MD5 of
their id), epoch after epoch; a document's virtual finish time is the cumulative
size of its source up to and with it, divided by the source's target.  All queues
are merged in the order of finish time, and the mix is cut where the total size
would pass the budget, which is the size of everything.  A source of target t has
given close to t when time reaches 1.

Targets share the budget by weight; a target stops at ``MAX_EPOCHS`` times its
source's size, and the excess is shared again by weight until none is above.
That fixed point is found at once: with sources sorted by size over weight, the
first k are held at their limit for the least k at which the rest need no limit.

Cumulative sums run in two levels, so that no source is ever one task: sizes are
summed by (source, leading hex digits of the MD5), the few thousand sums of a
source are accumulated, and each such bin is accumulated by itself on top.  Rows that
agree in source, id and size, of which there may be any number, are one entry of their bin
with a count; each gets its place behind the others from numbers by input partition
(``numbered``), so they never meet in one task.  The global order is cut by bins of
finish time, which are cut again until the one in which the budget ends has at most ``SLOT_ROWS`` rows.
Only DataFrame operations are used; texts are read once for their size and never shuffled.

Edge cases: null or empty texts have size 0 and are never taken.  A null source
is a source of its own, the last.  Rows with a null id shuffle by their text; rows that
tie in all of MD5, id and size are interchangeable, so the result as a set of rows is
the same in every run.  A source without words has target 0.  Very long texts count whole.
An empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import prepare, unused_names

MAX_EPOCHS = 3
BIN_DIGITS = 3
TIME_BINS = 1 << 16
SLOT_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh 1, 2, 3 and again."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle)
    return sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, cycle)), place + 1).cast("double").alias("weight"))


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight); one row for each source."""
    limit = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(order), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = sources.select("source", "source_size", "weight", limit.alias("limit"), (left / weight_left).alias("level"))
    # Sources below the first whose limit reaches its level are held at their limit.
    free = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level"))).otherwise(None)).over(every)
    share = free["level"] * F.col("weight")
    return level.select("source", "source_size", F.when(free.isNull() | (F.col("limit") < share), F.col("limit")).otherwise(share).alias("target"))


def _row_hash() -> Column:
    """128 bits that stand for a row's id, text and source."""
    row = ("doc_id", "text", F.col("source").cast("string"))
    return F.struct(F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2"))


def numbered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``rows`` (``key``, row: a checkpointed ``monotonically_increasing_id``, and more) with a number from 1 on among the rows of a key.

    A key's rows are counted by input partition, and numbered within each on top of the partitions before, so no task has more rows of a key than a partition holds.
    """
    part = F.shiftright("row", 33)
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    begins = rows.groupBy(F.col(key).alias("k"), part.alias("p")).agg(F.count(F.lit(1)).alias("n")).select("k", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy(key, part).orderBy("row")
    return rows.withColumn("within", F.row_number().over(inside)).join(begins, (F.col(key) == F.col("k")) & (part == F.col("p"))).select(*rows.columns, (F.col("earlier") + F.col("within")).alias(number))


def _cut(timed: DataFrame, budget: int) -> tuple[float, bool, str | None]:
    """(finish, whether the source is null, source) of the last row of ``timed`` (source, size, finish) that fits into ``budget`` in the order of finish and source."""
    low, width, before = 0.0, 2.0, 0
    while True:
        # The first range also takes all that is later.
        slot = F.least(F.floor((F.col("finish") - low) / width * TIME_BINS), F.lit(TIME_BINS - 1)).cast("int")
        part = timed if width == 2.0 else timed.where((F.col("finish") >= low) & (F.col("finish") < low + width))
        upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        slots = part.groupBy(slot.alias("slot")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).select("slot", "n", "rows", F.sum("n").over(upto).alias("upto"))
        edge = slots.where(F.col("upto") + before > budget).agg(F.min(F.struct("slot", (F.col("upto") - F.col("n")).alias("before"), "rows"))).first()[0]
        if edge is None:
            # All of it fits; in a range that was cut out before, rounding alone can bring this about.
            return (float("inf"), False, None) if width == 2.0 else (math.nextafter(low + width, 0.0), True, None)
        if edge["rows"] <= SLOT_ROWS or width / TIME_BINS < 1e-12 or edge["slot"] == TIME_BINS - 1:
            break
        low, width, before = low + edge["slot"] * (width / TIME_BINS), width / TIME_BINS, before + edge["before"]
    # In that slot, the last document that still fits; (finish, source) is unique among rows with words.
    order = Window.orderBy("finish", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    inside = part.where(slot == edge["slot"]).select("finish", F.col("source").isNull().alias("last"), "source", (F.sum("size").over(order) + edge["before"] + before).alias("upto"))
    found = inside.where(F.col("upto") <= budget).agg(F.max(F.struct("finish", "last", "source"))).first()[0]
    # Nothing of the slot fits: all that lies before it is taken, nothing at or after its beginning.
    return tuple(found) if found is not None else (math.nextafter(low + edge["slot"] * (width / TIME_BINS), 0.0), True, None)


def mix(docs: DataFrame, sources: DataFrame | None = None, *, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, finish) for each row of ``docs`` (doc_id, text, source).

    ``sources`` (source, source_size, weight) defaults to the weights 1, 2, 3 in turn;
    ``finish`` is the virtual finish time of the first epoch, null for sources without target.
    """
    prepare(docs.sparkSession)
    # Rows without an id are spread by their text, so that they don't all share one place in the queue.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    key = F.md5(name.cast("binary"))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"), _row_hash().alias("uid"), F.monotonically_increasing_id().alias("row")).checkpoint()
    # Rows that tie in the queue are one entry.
    entry = F.struct("source", "key", "doc_id", "size")
    entries = sized.groupBy(entry.alias("e")).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("uid")).select("e", "e.*", "n", "uid", F.substring("e.key", 1, BIN_DIGITS).alias("bin"))
    total = F.col("size") * F.col("n")
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    entries = entries.withColumn("upto", F.sum(total).over(inside)).checkpoint()
    sizes = entries.groupBy("source").agg(F.sum(total).alias("source_size"))
    goal = targets(sources if sources is not None else cyclic_weights(sizes), max_epochs)
    # Where each bin of each source begins.
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    begins = entries.groupBy("source", "bin").agg(F.sum(total).alias("n")).select("source", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    starts = begins.join(goal, begins["source"].eqNullSafe(goal["source"])).select(begins["source"].alias("s"), F.col("bin").alias("b"), "begin", "source_size", "target")
    columns = ("doc_id", "source", "size", "uid", "source_size", "target", "upto")
    placed = entries.join(starts, (F.col("bin") == F.col("b")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("begin") + F.col("upto"))
    several = placed.where("n > 1").select(F.col("e").alias("entry"), "n", "source_size", "target", "upto")
    alone = placed.where("n = 1").select(*columns)
    if not several.isEmpty():
        each = numbered(sized.withColumn("e", entry).join(several.select("entry"), F.col("e") == F.col("entry"), "left_semi"), "e", "number")
        alone = alone.unionByName(each.join(several, F.col("e") == F.col("entry")).withColumn("upto", F.col("upto") - F.col("size") * (F.col("n") - F.col("number"))).select(*columns))
    queued = alone.checkpoint()
    budget = goal.agg(F.sum("source_size")).first()[0] or 0
    finish = lambda epoch: (epoch * F.col("source_size") + F.col("upto")) / F.col("target")
    live = (F.col("size") > 0) & (F.col("target") > 0)
    timed = queued.where(live).select("source", "size", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")).select("source", "size", finish(F.col("epoch")).alias("finish"))
    cut_finish, cut_last, cut_source = _cut(timed, budget)
    cut = F.struct(F.lit(cut_finish).alias("finish"), F.lit(cut_last).alias("last"), F.lit(cut_source).cast("string").alias("source"))
    taken = lambda e: F.when(F.struct(finish(F.lit(e)).alias("finish"), F.col("source").isNull().alias("last"), F.col("source")) <= cut, 1).otherwise(0)
    copies = F.when(live, sum((taken(e) for e in range(1, max_epochs)), taken(0))).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), F.when(live, finish(F.lit(0))).alias("finish"), "uid")


def mixed_documents(docs: DataFrame, *, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with copies (how often), taken, size, source_size, target and finish.

    Columns of ``docs`` with these names give way.  Texts are shuffled once, to meet their row of the plan.
    Equal rows, which the plan can't tell apart, meet its rows by number.
    """
    names = ("copies", "taken", "size", "source_size", "target", "finish")
    plan = mix(docs, max_epochs=max_epochs).checkpoint()
    key, uid, entry = unused_names(docs, "key", "uid", "plan")
    given = plan.select(F.col("uid").alias(uid), F.struct(*names).alias(entry))
    repeated = plan.groupBy("uid").count().where("count > 1").select(F.col("uid").alias(uid)).checkpoint()
    keyed = docs.withColumn(key, _row_hash())
    out = lambda df: df.where(F.col(f"{entry}.copies") > 0).select(*(c for c in docs.columns if c not in names), *(F.col(f"{entry}.{n}").alias(n) for n in names))
    if repeated.isEmpty():
        return out(keyed.join(given.where(F.col(f"{entry}.copies") > 0), F.col(key) == F.col(uid)))
    once = given.join(repeated, uid, "left_anti").where(F.col(f"{entry}.copies") > 0)
    again = keyed.join(repeated, F.col(key) == F.col(uid), "left_semi").select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("k1"), F.monotonically_increasing_id().alias("row")).checkpoint()
    plans = given.join(repeated, uid, "left_semi").select(F.col(uid).alias("k2"), entry, F.monotonically_increasing_id().alias("row")).checkpoint()
    left, right = numbered(again, "k1", "i1").drop("row"), numbered(plans, "k2", "i2").drop("row")
    met = left.join(right, (F.col("k1") == F.col("k2")) & (F.col("i1") == F.col("i2"))).select("doc.*", entry)
    return out(keyed.join(once, F.col(key) == F.col(uid))).unionByName(out(met))
