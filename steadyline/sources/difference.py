"""Which rows of two tables differ, found over trees of digests.

Rows fall into buckets by a hash of their key; a bucket's digest is a sum over its rows, so it is built in one pass that
adds up before the shuffle and does not mind the order of rows or a key that holds many of them. Buckets are put together
``FAN`` bits at a time up to one root. Two trees are compared from the root down, and only rows of buckets that differ
are read again. A stored tree stands for its table: comparing with last week's takes no rows of last week but those.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyline.functions.digests import digest_sums, payload
from steadyline.sources.staging import new_location, staged

BITS = 16
FAN = 8
PARTS = [f"part{i}" for i in range(4)]
NODE = "node bigint, rows bigint, " + ", ".join(f"{p} decimal(38,0)" for p in PARTS)


@dataclass(frozen=True)
class DigestTree:
    spark: SparkSession
    path: str
    keys: list[str]
    columns: list[str]
    bits: int

    def level(self, bits: int) -> DataFrame:
        return self.spark.read.schema(NODE).parquet(f"{self.path}/bits={bits}")


def _bucket(keys: list[str], bits: int):
    return F.pmod(F.xxhash64(payload(*keys)), F.lit(1 << bits)).cast("bigint")


def digest_tree(df: DataFrame, keys: list[str] | None = None, bits: int = BITS, path: str | None = None) -> DigestTree:
    """One pass over ``df``; ``2**bits`` rows are kept at most. Without keys a row is its own key. A row's digest covers all columns, by name."""
    columns = sorted(df.columns)
    keys = list(keys or columns)
    path = path or new_location(df.sparkSession, "digests")
    of = DigestTree(df.sparkSession, path, keys, columns, bits)
    digests = df.select(_bucket(keys, bits).alias("node"), F.sha2(payload(*columns), 256).alias("_d"))
    digests.groupBy("node").agg(F.count("*").alias("rows"), *digest_sums(F.col("_d"))).write.parquet(f"{path}/bits={bits}")
    while bits:
        wide, bits = bits, max(0, bits - FAN)
        nodes = of.level(wide).groupBy(F.shiftright("node", wide - bits).alias("node"))
        nodes.agg(*[F.sum(c).cast("bigint" if c == "rows" else "decimal(38,0)").alias(c) for c in ("rows", *PARTS)]).write.parquet(f"{path}/bits={bits}")
    return of


def differing_buckets(a: DigestTree, b: DigestTree) -> DataFrame:
    """(node): the lowest buckets that differ. A level is read only below nodes that differ one level higher."""
    if (a.keys, a.columns, a.bits) != (b.keys, b.columns, b.bits):
        raise ValueError("trees of other keys, columns or sizes say nothing about each other")
    bits, above, was = 0, None, 0
    while True:
        sides = []
        for of, name in ((a, "a"), (b, "b")):
            nodes = of.level(bits)
            if above is not None:
                nodes = nodes.join(above, F.shiftright(nodes["node"], bits - was) == above["open"], "left_semi")
            sides.append(nodes.select("node", F.struct("rows", *PARTS).alias(name)))
        found = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if bits == a.bits:
            return found
        above, was = found.select(F.col("node").alias("open")), bits
        # the step up from the lowest level may be shorter, so levels are counted from there
        bits += FAN if (a.bits - bits) % FAN == 0 else (a.bits - bits) % FAN


def rest_of(df: DataFrame, of: DigestTree, buckets: DataFrame) -> DataFrame:
    """The rows of ``df`` that lie in ``buckets``."""
    return df.withColumn("_node", _bucket(of.keys, of.bits)).join(buckets.select(F.col("node").alias("_node")), "_node", "left_semi").drop("_node")


def row_differences(a: DataFrame, b: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """(``keys``, status): keys whose rows are only_a, only_b or changed. A key may stand on several rows, or be NULL."""
    trees = [digest_tree(df, keys, bits) for df in (a, b)]
    buckets = staged(differing_buckets(*trees), "buckets")
    sides = []
    for df, of, name in zip((a, b), trees, "ab"):
        digest = F.sha2(payload(*of.columns), 256)
        rows = rest_of(df, of, buckets).select(payload(*keys).alias("_key"), *keys, digest.alias("_d"))
        sums = rows.groupBy("_key").agg(*[F.first(k).alias(f"{name}_{k}") for k in keys], F.count("*").alias("_n"), *digest_sums(F.col("_d")))
        sides.append(sums.withColumn(name, F.struct("_n", *PARTS)).drop("_n", *PARTS))
    both = sides[0].join(sides[1], "_key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("changed")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], status.alias("status"))
