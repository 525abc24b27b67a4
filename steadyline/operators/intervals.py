"""Joins of intervals with intervals and with points, for intervals of any length and keys of any size.

An interval is cut into dyadic blocks: at each level only those of its blocks that no larger one holds. A long interval is
a few large blocks and a few small ones at its ends, not one row for each day. A point lies in one block of each level, and
in one block of an interval's cut at most, so an equi-join on (key, level, block) finds each pair once; exact ends are
compared in the same join. A key that holds a third of all rows is spread over its blocks.
"""

from pyspark.sql import Column, DataFrame, functions as F

BASE = 4


def _height(rows: DataFrame, low: Column, high: Column) -> int:
    """Levels that the longest interval needs; one number comes to the driver."""
    most = rows.agg(F.max(high - low).alias("n")).first()["n"] or 1
    height = 0
    while BASE**height < most:
        height += 1
    return height


def _blocks(low: Column, high: Column, height: int) -> Column:
    """array<struct<level, block>> of the units low .. high - 1: at level k those blocks whose parent isn't whole."""
    def at(k: Column) -> Column:
        size = F.pow(F.lit(BASE), k).cast("bigint")
        up = lambda v, by: F.call_function("div", v + by - 1, by)
        first, end = up(low, size), F.call_function("div", high, size)
        left, right = F.least(up(first, F.lit(BASE)) * BASE, end), F.greatest(F.call_function("div", end, F.lit(BASE)) * BASE, first)
        whole = (left >= right) | (k == height)
        own = lambda a, z: F.when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<bigint>"))
        blocks = F.when(whole, own(first, end)).otherwise(F.concat(own(first, left), own(right, end)))
        return F.transform(blocks, lambda b: F.struct(k.cast("int").alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height)), at))


def stabbing_join(intervals: DataFrame, points: DataFrame, on: list[str], start: str, end: str, point: str, unit: int, after_start: bool = False) -> DataFrame:
    """Each interval [start, end) with each point in it, of the same ``on`` values (NULLs are no match). Columns of both.

    ``start``, ``end`` and ``point`` are whole numbers, 0 or more; ``unit`` is how many of them a smallest block holds, about the
    length of a short interval. With ``after_start`` a point at the start doesn't count. Empty, reversed and NULL intervals hold nothing.
    """
    low = F.call_function("div", F.col(start), F.lit(unit))
    high = F.call_function("div", F.col(end) - 1, F.lit(unit)) + 1
    proper = intervals.where(F.col(end) > F.col(start))
    height = _height(proper, low, high)
    cut = proper.select("*", F.explode(_blocks(low, high, height)).alias("_b")).select(*proper.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    level = F.explode(F.sequence(F.lit(0), F.lit(height))).alias("_level")
    placed = points.where(F.col(point).isNotNull()).select("*", level)
    placed = placed.withColumn("_block", F.call_function("div", F.col(point), F.lit(unit) * F.pow(F.lit(BASE), F.col("_level")).cast("bigint")))
    both = cut.join(placed, [*on, "_level", "_block"])
    begins = F.col(point) > F.col(start) if after_start else F.col(point) >= F.col(start)
    return both.where(begins & (F.col(point) < F.col(end))).drop("_level", "_block")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], unit: int) -> DataFrame:
    """Each interval of ``a`` with each of ``b`` that it shares a moment with; ``on`` and all names as in ``stabbing_join``.

    Of two that overlap, either the second begins within the first, or the first begins within the second, after its start.
    Apart from ``on``, the two sides' columns must have names of their own.
    """
    real = lambda df, span: df.where(F.col(span[1]) > F.col(span[0]))
    a, b = real(a, a_span), real(b, b_span)
    inside = stabbing_join(a, b, on, *a_span, b_span[0], unit)
    return inside.unionByName(stabbing_join(b, a, on, *b_span, a_span[0], unit, after_start=True))


def overlap_length(a_span: tuple[str, str], b_span: tuple[str, str]) -> Column:
    return F.least(a_span[1], b_span[1]) - F.greatest(a_span[0], b_span[0])
