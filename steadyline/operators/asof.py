"""As-of join: to each row the last row of another table up to its time, for keys of any size.

Both tables are merged into one order and cut into ranges, so a key that holds a third of all rows lies in many chunks.
Within a chunk the last row of the other table is carried along; a chunk's last one is handed to the chunks after it.
"""

from pyspark.sql import DataFrame, functions as F

from steadyline.functions.ordered import Ordered


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, left_id: str, right_id: str, take: list[str],
    prefix: str = "asof_", strict: bool = False,
) -> DataFrame:
    """``left`` with the columns ``take`` of the last right row at or before its time (``strict``: before), NULL if there is none.

    Of right rows of one time the last by ``right_id`` counts; both ids are unique and of one type, so that rows of one
    moment can be told apart. Rows with a NULL in ``on`` or in the time match nothing; left ones stay. Taken columns get
    the ``prefix``. Times and ids of both sides must have one type each.
    """
    side = F.lit(1 if strict else 0)
    known = [F.col(c).isNotNull() for c in (*on, right_time)]
    offered = right.where(sum((~k).cast("int") for k in known) == 0).select(
        *on, F.col(right_time).alias("_t"), side.alias("_side"), F.col(right_id).alias("_id"), F.struct(*take).alias("_right")
    )
    asking = left.select(*on, F.col(left_time).alias("_t"), (F.lit(1) - side).alias("_side"), F.col(left_id).alias("_id"), F.struct(*left.columns).alias("_left"))
    merged = asking.unionByName(offered, allowMissingColumns=True)
    run = Ordered(merged, on, ["_t", "_side", "_id"], "asof")
    found = run.latest(F.col("_right"), F.col("_right").isNotNull(), "_found").where(F.col("_left").isNotNull())
    answer = F.when(F.col("_t").isNotNull(), F.col("_found"))
    return found.select("_left.*", *[answer[c].alias(f"{prefix}{c}") for c in take])
