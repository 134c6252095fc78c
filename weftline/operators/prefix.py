"""Numbers, sums, neighbours and recurrences over groups of any size.

A window over a group sorts the group in one task. Here rows are dealt to range partitions by group and
order, with a number of their own as the last key, so that neither a hot group nor a hot order is one
partition; the table is written, as an order that is dealt twice could differ. A partition is a slot.
Windows then see one slot at a time, and what earlier slots hold of a group is carried over: only the
first group of a slot can have begun before it, so there is at most one such row per slot, and these are
joined by broadcast, whatever the number of rows.

Where rows need their neighbours, blocks of neighbouring numbers are windows of bounded size, and the rows
next to a border are copied to the block beyond it (a halo), so that no block has to see another.

In all of them, null orders come first, rows of one order follow each other in any order, and rows of a
null group are one group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.scratch import written

#: Numbers in a block, where the method does not say otherwise.
BLOCK = 4096
#: A row's place in its partition is in the low bits of Spark's ascending numbers.
_SLOT_BITS = 33


def ordered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows as a table with ``_at``, which ascends in the order given, and ``_slot``, their partition."""
    keyed = rows.withColumn("_own", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(*order, "_own").sortWithinPartitions(*order, "_own").drop("_own")
    return written(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_slot", F.shiftright("_at", _SLOT_BITS))


def _carried(placed: DataFrame, group: str, value: Column) -> DataFrame:
    """``_group, _from, _before``: sums of earlier slots, for the slots whose first group began before them."""
    sums = placed.groupBy(F.col(group).alias("_group"), F.col("_slot").alias("_from")).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy("_group").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("_group", "_from", F.count("*").over(earlier).alias("_n"), F.sum("_sum").over(earlier).alias("_before")).where("_n > 0").drop("_n")


def _resumed(placed: DataFrame, carried: DataFrame, group: str) -> DataFrame:
    return placed.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slot") == F.col("_from")), "left")


def summed(placed: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``ordered`` rows with ``name``, the sum of ``value`` over the rows of a group up to this one."""
    here = F.sum(value).over(W.partitionBy(group, "_slot").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    total = F.coalesce(here, F.lit(0)) + F.coalesce("_before", F.lit(0))
    return _resumed(placed, _carried(placed, group, F.col(value)), group).withColumn(name, total).drop("_group", "_from", "_before")


def filled(placed: DataFrame, group: str, *values: str) -> DataFrame:
    """``ordered`` rows with each of ``values`` replaced by its last value in the group that was not null, up to this row.

    Rows of two tables in one order make this a join with the last row at or before, whatever the size of a group.
    """
    ends = placed.groupBy(F.col(group).alias("_group"), F.col("_slot").alias("_from")).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in values])
    earlier = W.partitionBy("_group").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("_group", "_from", F.count("*").over(earlier).alias("_n"), *[F.last(v, ignorenulls=True).over(earlier).alias(f"_earlier_{v}") for v in values]).where("_n > 0").drop("_n")
    here = W.partitionBy(group, "_slot").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    known = {v: F.coalesce(F.last(v, ignorenulls=True).over(here), F.col(f"_earlier_{v}")) for v in values}
    return _resumed(placed, carried, group).withColumns(known).drop("_group", "_from", *[f"_earlier_{v}" for v in values])


def running_sum(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of a group up to this one. A null value adds nothing."""
    return summed(ordered(rows.withColumn("_value", value), group, order), group, "_value", name).select(*rows.columns, name)


def numbered(rows: DataFrame, group: str, *order: str | Column, name: str = "nth") -> DataFrame:
    """Adds ``name``: how many rows of the group come before this one."""
    placed = ordered(rows, group, *order)
    here = F.col("_at") - F.min("_at").over(W.partitionBy(group, "_slot"))
    return _resumed(placed, _carried(placed, group, F.lit(1)), group).withColumn(name, here + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def haloed(rows: DataFrame, nth: str, size: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with ``_block``, and copies of the ``before`` rows in front of each block and the ``after`` rows behind it.

    ``_inside`` tells a block's own rows from copies. Neither border may be wider than a block.
    """
    own = F.floor(F.col(nth) / size).cast("long")
    place = F.pmod(F.col(nth), F.lit(size))
    to_next = F.when(place >= size - before, own + 1)
    to_last = F.when((place < after) & (own > 0), own - 1)
    return rows.withColumn("_block", F.explode(F.array_compact(F.array(own, to_next, to_last)))).withColumn("_inside", F.col("_block") == own)


def following(rows: DataFrame, group: str, nth: str, value: str, name: str, size: int = BLOCK) -> DataFrame:
    """Adds ``name``: the value of the next number of the group, null at its end."""
    seen = W.partitionBy(group, "_block").orderBy(nth)
    return haloed(rows, nth, size, after=1).withColumn(name, F.lead(value).over(seen)).where("_inside").select(*rows.columns, name)


def recurrence(rows: DataFrame, group: str, nth: str, value: Column, keep: float, name: str, start: Column | None = None) -> DataFrame:
    """Adds ``name``: ``y = keep * y before + (1 - keep) * value`` in order of ``nth``, from 0 without gaps.

    Before the first row, y is ``start``, an expression over the group's first row; by default its value.
    A null value counts as 0.

    Each row is a map ``y -> a y + b``, and maps compose: within a block of L numbers, b is
    ``keep^k * sum(value * keep^-k)``, a window sum; L is such that no power overflows. Blocks compose in
    the same way from one row each; those whose powers of ``keep`` are 0 as doubles no longer matter,
    so a block reads a bounded number of earlier ones.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    size = min(1 << 15, max(1, int(460 / -math.log(keep))))  # 460: e^460 squared is still a double
    reach = math.ceil(750 / (size * -math.log(keep)))  # e^-750 is 0
    x = F.coalesce(value.cast("double"), F.lit(0.0))
    first = F.coalesce((value if start is None else start).cast("double"), F.lit(0.0))
    placed = rows.withColumn("_block", F.floor(F.col(nth) / size).cast("long")).withColumn("_place", F.pmod(F.col(nth), F.lit(size)))
    placed = placed.withColumn("_term", x * (1 - keep) * F.pow(F.lit(1 / keep), "_place")).withColumn("_first", F.when(F.col(nth) == 0, first))
    blocks = placed.groupBy(F.col(group).alias("_group"), F.col("_block").alias("_of")).agg((F.sum("_term") * keep ** (size - 1)).alias("_b"), F.max("_first").alias("_first"))
    back = W.partitionBy("_group").orderBy("_of")
    last = F.reverse(F.collect_list("_b").over(back.rowsBetween(-reach, -1)))
    entering = F.aggregate(F.transform(last, lambda b, m: b * F.pow(F.lit(keep**size), m)), F.lit(0.0), lambda a, b: a + b)
    begun = F.first("_first").over(back.rowsBetween(W.unboundedPreceding, 0)) * F.pow(F.lit(keep), F.col("_of") * size)
    entries = blocks.select("_group", "_of", (entering + begun).alias("_entering"))
    joined = placed.join(entries, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")))
    inside = F.sum("_term").over(W.partitionBy(group, "_block").orderBy(nth).rowsBetween(W.unboundedPreceding, 0)) * F.pow(F.lit(keep), "_place")
    return joined.withColumn(name, inside + F.pow(F.lit(keep), F.col("_place") + 1) * F.col("_entering")).select(*rows.columns, name)
