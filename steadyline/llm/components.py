"""Connected components by alternating large and small stars; each round is a table in the shared folder."""

from pyspark.sql import DataFrame, functions as F

from steadyline.sources.staging import staged


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the larger (small: the smaller) neighbours of each node to its least neighbour.

    The least neighbour comes from a grouping that is summed up before the shuffle and is joined back, so the
    neighbours of a hub stay spread; the rows do not grow.
    """
    ways = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    near = ways.join(least, "a")
    if small:
        out = near.select(F.col("b").alias("x"), "m").union(near.select(F.col("a").alias("x"), "m"))
    else:
        out = near.where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node reachable, for each node that stands in a link. Nodes are of one ordered type.

    Null ends and self-links say nothing. No links: no rows.
    """
    x, y = F.col(a), F.col(b)
    edges = staged(
        links.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(), "links",
    )
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        # a large star keeps a > b, which is what the small star starts from
        edges = staged(_star(_star(edges, False), True), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
