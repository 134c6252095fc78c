"""Order statistics of whole numbers without sorting them: counts per range, then the one range again.

A round counts values by their leading bits, which is one aggregate with at most ``BINS`` rows of output,
combined before it is shuffled; the rank falls into one range, and the next round reads that range only.
Twelve bits a round settle any 64-bit number in six rounds, most tables in two or three. No task ever
holds more than the counts, however many values are distinct or equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges a round tells apart: rows that come to the driver.
BINS = 1 << 12


def selected(values: DataFrame, column: str, rank: int, bins: int = BINS) -> int | None:
    """The value with ``rank`` smaller or equal ones before it in order; null values do not count.

    Null where there are not so many values.
    """
    known = values.select(F.col(column).cast("long").alias("v")).where("v IS NOT NULL")
    low, high = known.agg(F.min("v"), F.max("v")).first()
    if low is None or rank < 0:
        return None
    while low < high:
        shift = 0
        while (high >> shift) - (low >> shift) >= bins:
            shift += 1
        part = F.shiftright("v", shift)  # keeps the order, of negative numbers too
        counts = dict(known.where(F.col("v").between(low, high)).groupBy(part.alias("part")).count().collect())
        for at in sorted(counts):
            if rank < counts[at]:
                break
            rank -= counts[at]
        else:
            return None
        low, high = max(low, at << shift), min(high, ((at + 1) << shift) - 1)
        if shift == 0:
            return low
    return low if rank < known.where(F.col("v") == low).count() else None


def median(values: DataFrame, column: str, upper: bool = True) -> int | None:
    """The upper or lower middle value; null where there is none."""
    n = values.where(F.col(column).isNotNull()).count()
    return selected(values, column, n // 2 if upper else (n - 1) // 2)
