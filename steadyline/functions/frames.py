"""Window frames over calendar days and statistics on them."""

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import WindowSpec

ENTITY = "entity_id"
GROUP = "group_id"


def by_day(key: str = ENTITY) -> WindowSpec:
    """One key's days in order. Panels hold one row per key and day, so a partition is bounded by the calendar."""
    return Window.partitionBy(key).orderBy("day_no")


def trailing(far: int, near: int, key: str = ENTITY) -> WindowSpec:
    """Calendar days ``day-far .. day-near``; missing days simply are not there."""
    return by_day(key).rangeBetween(-far, -near)


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)


def with_frame_stats(df: DataFrame, column: str, frame: WindowSpec, spread: bool = True) -> DataFrame:
    """Add ``_n``, ``_mean`` and (optionally) ``_sd`` of ``column`` over ``frame``; the caller renames and drops them.

    Whole-number metrics go through exact sums: the result then does not depend on the order in which rows arrive, and
    a value lying on a threshold falls on the same side in every run. Each window aggregate is a column of its own
    first, because an expression that is written twice is also evaluated twice.
    """
    x = F.col(column).cast("double")
    if not is_integral(df, column):
        parts = {"_n": F.count(x).over(frame), "_mean": F.avg(x).over(frame)}
        return df.withColumns({**parts, "_sd": F.stddev_samp(x).over(frame)} if spread else parts)
    parts = {"_n": F.count(x).over(frame), "_s": F.sum(x).over(frame)}
    df = df.withColumns({**parts, "_q": F.sum(x * x).over(frame)} if spread else parts)
    n, total = F.col("_n"), F.col("_s")
    df = df.withColumn("_mean", F.when(n > 0, total / n))
    if spread:
        variation = F.greatest(n * F.col("_q") - total * total, F.lit(0.0)) / (n * (n - 1))
        df = df.withColumn("_sd", F.when(n > 1, F.sqrt(variation)))
    return df.drop("_s", "_q")


def with_slope(df: DataFrame, column: str, frame: WindowSpec, name: str) -> DataFrame:
    """Add the least-squares slope per day of a whole-number metric over ``frame``, from exact sums."""
    y = F.col(column).cast("double")
    x = F.when(y.isNotNull(), F.col("day_no").cast("double"))
    sums = {"_n": F.count(y), "_sx": F.sum(x), "_sy": F.sum(y), "_sxy": F.sum(x * y), "_sxx": F.sum(x * x)}
    df = df.withColumns({k: v.over(frame) for k, v in sums.items()})
    n, sx = F.col("_n"), F.col("_sx")
    spread = n * F.col("_sxx") - sx * sx
    slope = F.when((n > 1) & (spread > 0), (n * F.col("_sxy") - sx * F.col("_sy")) / spread)
    return df.withColumn(name, F.round(slope, 6)).drop(*sums)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL where the divisor is zero."""
    return F.when(bottom != 0, top / bottom)
