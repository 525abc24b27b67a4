"""The strongest k rows of each group, and what they hold, without ranking the rows.

Rows are counted by bins of the order they stand in; the bin in which the k-th row lies is known from the counts alone, and
only its rows are looked at again, with bins as fine as that one is wide. A bin's true ends are taken along, so a score
that very many rows share is a bin of its own at once, and the tie-breaker is cut into bins instead. Each pass adds up
before it shuffles; what is left at the end is a few rows for each cut.
"""

from pyspark.sql import DataFrame, Window, functions as F

BINS = 1024
LEFT = 1 << 16  # so few rows of a cut's bin are put in order as they are
MOST_PASSES = 64


def cut_points(rows: DataFrame, cuts: DataFrame, group: str, score: str, tie: str, bins: int = BINS, left: int = LEFT) -> DataFrame:
    """(group, k, score, tie) of the k-th row by falling score, then rising tie, for ``cuts`` rows (group, k).

    ``tie`` is a number that is unique within a group and finite; NULL and NaN scores come last. A k beyond the group's
    rows has no cut point: all rows are within it. ``cuts`` comes to the driver: one row for each group and k.
    """
    spark = rows.sparkSession
    # falling scores as rising numbers; a double keeps the order of any number, if not every difference
    rank_score = F.when(F.col(score).isNull() | F.isnan(F.col(score).cast("double")), F.lit(float("inf"))).otherwise(-F.col(score).cast("double"))
    keyed = rows.select(F.col(group).alias("g"), rank_score.alias("x"), F.col(tie).alias("tie"), F.col(tie).cast("double").alias("y"), F.col(score).alias("s"))
    wanted = [(r[group], int(r["k"])) for r in cuts.select(group, "k").distinct().collect()]
    # of each open cut: rows before its bin, and the bin's ends in x and in y
    ends = keyed.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).collect()
    of = {r["g"]: r for r in ends}
    todo = [(g, k, 0, *(of[g][c] for c in ("n", "x0", "x1", "y0", "y1"))) for g, k in wanted if g in of and 1 <= k <= of[g]["n"]]
    open_schema = "c bigint, g string, k bigint, before bigint, n bigint, x0 double, x1 double, y0 double, y1 double"
    g_type = rows.schema[group].dataType.simpleString()
    open_schema = open_schema.replace("g string", f"g {g_type}")
    done = []
    for _ in range(MOST_PASSES):
        done += [t for t in todo if t[3] <= left or (t[4] == t[5] and t[6] == t[7])]
        todo = [t for t in todo if t not in done]
        if not todo:
            break
        table = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(todo)], open_schema))  # one row for each open cut
        by_score = F.col("x0") < F.col("x1")
        at, low, high = (F.when(by_score, F.col(a)).otherwise(F.col(b)) for a, b in (("x", "y"), ("x0", "y0"), ("x1", "y1")))
        # either end is a bin of its own, so an infinite one is out of the way; halves keep differences of huge values finite
        share = F.floor((at / 2 - low / 2) / (high / 2 - low / 2) * bins)
        bin_no = F.when(at == low, 0).when(at == high, bins - 1).otherwise(F.least(F.greatest(share, F.lit(1)), F.lit(bins - 2)))
        own = _within(keyed, table).withColumn("bin", bin_no.cast("int"))
        counted = own.groupBy("c", "bin").agg(F.count("*").alias("n"), *[f(v).alias(v + e) for v in "xy" for f, e in ((F.min, "0"), (F.max, "1"))])
        # at most ``bins`` rows for each cut
        upto = Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counted.withColumn("upto", F.sum("n").over(upto)).join(table.select("c", "k", "before"), "c")
        hit = (F.col("before") + F.col("upto") >= F.col("k")) & (F.col("before") + F.col("upto") - F.col("n") < F.col("k"))
        found = {r["c"]: r for r in placed.where(hit).collect()}
        following = []
        for i, t in enumerate(todo):
            r = found[i]
            now = (*t[:2], t[2] + r["upto"] - r["n"], r["n"], r["x0"], r["x1"], r["y0"], r["y1"])
            (done if now[2:] == t[2:] else following).append(now)  # bins as fine as doubles tell apart: no further
        todo = following
    done += todo
    schema = f"{group} {g_type}, k bigint"
    if not done:
        return spark.createDataFrame([], schema).join(rows.select(group, score, tie).limit(0), group)
    table = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(done)], open_schema))
    own = Window.partitionBy("c").orderBy("x", "tie")
    last = _within(keyed, table).withColumn("_r", F.col("before") + F.row_number().over(own)).where(F.col("_r") == F.col("k"))
    return last.select(F.col("g").alias(group), "k", F.col("s").alias(score), F.col("tie").alias(tie))


def _within(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of the open cuts' bins; a row is there once for each cut whose bin it lies in."""
    ends = table.select("c", F.col("g").alias("_g"), "k", "before", "x0", "x1", "y0", "y1")
    inside = keyed["g"].eqNullSafe(ends["_g"]) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return keyed.join(ends, inside).drop("_g")


def among_strongest(score: str, tie: str, cut_score: str, cut_tie: str):
    """Whether a row stands at or before a cut point."""
    mine, cut = F.col(score), F.col(cut_score)
    worth = lambda c: F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(float("-inf"))).otherwise(c.cast("double"))
    return (worth(mine) > worth(cut)) | ((worth(mine) == worth(cut)) & (F.col(tie) <= F.col(cut_tie)))
