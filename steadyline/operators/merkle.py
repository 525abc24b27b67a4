"""One seal over a whole log: a hash tree over its events, with proofs that need no other events.

Neighbours are hashed in pairs, level by level; a node without a right neighbour goes up as it is. A chain tells that its
own events fit together; a tree also gives a short proof that one event is in a sealed log (its path of sibling hashes),
that a later log still begins with an earlier one (the roots of the earlier log's full subtrees), and where two logs
differ (only subtrees with different roots are opened).

The levels are built in blocks of ``1 << LEVELS`` nodes: a block's levels are one row, so a round of work shrinks the log
by that factor, and nothing is sorted or held beyond a block.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyline.functions.digests import payload
from steadyline.functions.ordered import Ordered
from steadyline.sources.staging import new_location

LEVELS = 10
BLOCK = 1 << LEVELS
EMPTY = "empty"
PATH = "path array<struct<left boolean, hash string>>"


def _pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("node#"), left, right), 256)


def leaf(digest: Column) -> Column:
    """An event's leaf; marked, so that no inner node can pass for one."""
    return F.sha2(F.concat(F.lit("leaf#"), digest), 256)


def leaves(log: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """(``order`` columns, position from 0, leaf): the events of a whole log in order. ``order`` names events uniquely.

    Payloads are hashed where they are read; digests only are shuffled, into ranges, so no task numbers the whole log.
    """
    light = log.select(*order, leaf(F.sha2(payload(*fields), 256)).alias("leaf"))
    numbered = Ordered(light, [], order, "leaves").row_number("position")
    return numbered.withColumn("position", F.col("position") - 1)


@dataclass(frozen=True)
class Tree:
    """Blocks by round: (block, levels), where levels[k] holds the hashes at k levels above the round's own nodes."""

    spark: SparkSession
    path: str
    size: int
    rounds: int

    def blocks(self, number: int) -> DataFrame:
        return self.spark.read.schema("block bigint, levels array<array<string>>").parquet(f"{self.path}/round={number}")

    def root(self) -> str:
        if not self.size:
            return EMPTY
        top = self.blocks(self.rounds - 1).select(F.element_at("levels", -1)[0].alias("root"))
        return top.first()["root"]


def tree(numbered: DataFrame, path: str | None = None) -> Tree:
    """The tree over rows (position, leaf), positions from 0 without gaps; written to ``path`` or as a staged table."""
    spark = numbered.sparkSession
    path = path or new_location(spark, "tree")

    def above(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
        return F.transform(at, lambda i: F.when(2 * i + 1 < F.size(hashes), _pair(F.get(hashes, 2 * i), F.get(hashes, 2 * i + 1))).otherwise(F.get(hashes, 2 * i)))

    nodes, size, rounds = numbered.select(F.col("position").alias("i"), F.col("leaf").alias("hash")), None, 0
    while True:
        listed = nodes.groupBy(F.shiftright("i", LEVELS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "hash"))).alias("_n"))
        first = listed.select("block", F.array(F.transform("_n", lambda n: n["hash"])).alias("_own"))
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.col("_own"), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))
        first.select("block", grown.alias("levels")).write.parquet(f"{path}/round={rounds}")
        done = Tree(spark, path, 0, rounds + 1).blocks(rounds)
        counted = done.agg(F.count("*").alias("blocks"), F.sum(F.size(F.col("levels")[0])).alias("nodes")).first()
        size, rounds = counted["nodes"] or 0 if size is None else size, rounds + 1
        if counted["blocks"] <= 1:
            return Tree(spark, path, size, rounds)
        nodes = done.select(F.col("block").alias("i"), F.element_at("levels", -1)[0].alias("hash"))


def seal(of: Tree) -> DataFrame:
    """(events, root): what has to be kept elsewhere."""
    return of.spark.createDataFrame([(of.size, of.root())], "events bigint, root string")


def _siblings(at: Column, levels: Column, start: int = 0) -> Column:
    """Siblings on the way up through a block's levels from ``start``, lowest first; none where a node went up alone."""
    index = lambda k: F.call_function("shiftright", at.cast("int"), k)
    beside = F.transform(F.sequence(F.lit(start), F.lit(LEVELS - 1)), lambda k: F.struct(
        (index(k) % 2 == 1).alias("left"), F.get(F.get(levels, k), index(k).bitwiseXOR(F.lit(1))).alias("hash")
    ))
    return F.filter(beside, lambda s: s["hash"].isNotNull())


def proofs(of: Tree, wanted: DataFrame | None = None) -> DataFrame:
    """(position, leaf, path): for each event, or for the ``wanted`` positions, the siblings up to the root.

    Work goes from the top round down: a block's path is put before its nodes' paths, and only blocks with wanted events are opened.
    """
    top = of.spark.createDataFrame([(0, [])], f"block bigint, {PATH}")
    for number in reversed(range(of.rounds)):
        blocks = of.blocks(number)
        if wanted is not None:
            blocks = blocks.join(wanted.select(F.shiftright("position", LEVELS * (number + 1)).alias("block")).distinct(), "block", "left_semi")
        nodes = blocks.join(top, "block").select("block", "levels", "path", F.posexplode(F.col("levels")[0]).alias("_j", "leaf"))
        position = F.col("block") * BLOCK + F.col("_j")
        nodes = nodes.select(position.alias("position"), "leaf", F.concat(_siblings(F.col("_j"), F.col("levels")), "path").alias("path"))
        if not number:
            return nodes if wanted is None else nodes.join(wanted.select("position").distinct(), "position", "left_semi")
        top = nodes.select(F.col("position").alias("block"), "path")


def climbed(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_hash, lambda h, s: F.when(s["left"], _pair(s["hash"], h)).otherwise(_pair(h, s["hash"])))


def verified(events: DataFrame, proven: DataFrame, root: str, order: list[str], fields: list[str]) -> DataFrame:
    """(``order`` columns, position, siblings, ok): whether each event, as it is now, is the sealed log's one.

    ``proven``: (``order`` columns, position, path). An event without a proof is not ok.
    """
    now = events.select(*order, leaf(F.sha2(payload(*fields), 256)).alias("leaf"))
    both = now.join(proven.select(*order, "position", "path"), order, "left")
    ok = F.coalesce(climbed(F.col("leaf"), F.col("path")) == root, F.lit(False))
    return both.select(*order, "position", F.size("path").cast("bigint").alias("siblings"), ok.alias("ok"))


def _peaks(size: int) -> list[tuple[int, int]]:
    """(level, index) of the full subtrees that a log of ``size`` events falls into, largest first."""
    found, at = [], 0
    for level in reversed(range(size.bit_length())):
        if size >> level & 1:
            found.append((level, at >> level))
            at += 1 << level
    return found


def consistency(later: Tree, size: int) -> DataFrame:
    """(place, hash, path): the full subtrees of the later log's first ``size`` events, each with its way to the root.

    No more rows than bits in ``size``; one block of each round is opened for each of them.
    """
    if not 0 < size <= later.size:
        raise ValueError(f"a log of {later.size} events has no part of {size}")
    parts = []
    for place, (level, index) in enumerate(_peaks(size)):
        number = min(level // LEVELS, later.rounds - 1)
        inner = level - number * LEVELS  # levels above the round's own nodes
        block, at = divmod(index << inner, BLOCK)  # the subtree's first node of that round
        hashed = later.blocks(number).where(F.col("block") == block)
        beside = _siblings(F.lit(at), F.col("levels"), inner) if inner < LEVELS else F.array().cast(PATH.removeprefix("path "))
        own = hashed.select("block", F.get(F.col("levels")[inner], F.lit(at >> inner)).alias("hash"), beside.alias("_own"))
        parts.append(own.join(_block_path(later, number, block), "block").select(F.lit(place).alias("place"), "hash", F.concat("_own", "path").alias("path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block_path(of: Tree, number: int, block: int) -> DataFrame:
    """(block, path): the way from a round's block to the root; one block of each higher round is read."""
    path = of.spark.createDataFrame([(block, [])], f"block bigint, {PATH}")
    at = block
    for higher in range(number + 1, of.rounds):
        row = of.blocks(higher).where(F.col("block") == at >> LEVELS).select(_siblings(F.lit(at % BLOCK), F.col("levels")).alias("_more"))
        path = path.crossJoin(row).select("block", F.concat("path", "_more").alias("path"))  # one row on each side
        at >>= LEVELS
    return path


def consistent(proof: DataFrame, earlier_root: str, later_root: str) -> bool:
    """Whether a proof's subtrees make up the earlier root and all lie in the later log."""
    folded = F.aggregate(
        F.reverse(F.sort_array(F.collect_list(F.struct("place", "hash")))), F.lit(None).cast("string"),
        lambda h, p: F.when(h.isNull(), p["hash"]).otherwise(_pair(p["hash"], h)),
    )
    reached = F.bool_and(climbed(F.col("hash"), F.col("path")) == later_root)
    return bool(proof.agg(((folded == earlier_root) & reached).alias("ok")).first()["ok"])


def differing(a: Tree, b: Tree) -> DataFrame:
    """(position): where two logs' leaves differ or only one has an event; blocks with equal roots are not opened."""
    def one(t: Tree, number: int, open_blocks: DataFrame | None) -> DataFrame:
        if number >= t.rounds:  # a lower tree: its root stands alone, one level higher up it goes unchanged
            levels = F.array_repeat(F.array(F.lit(t.root())), LEVELS + 1)
            rows = t.spark.range(1).select(F.lit(0).cast("bigint").alias("block"), levels.alias("levels"))
        else:
            rows = t.blocks(number)
        return rows if open_blocks is None else rows.join(open_blocks, "block", "left_semi")

    open_blocks = None
    for number in reversed(range(max(a.rounds, b.rounds))):
        left, right = (one(t, number, open_blocks).select("block", F.col("levels").alias(n)) for t, n in ((a, "a"), (b, "b")))
        both = left.join(right, "block", "full_outer")
        both = both.where(~F.element_at("a", -1)[0].eqNullSafe(F.element_at("b", -1)[0]))
        own = lambda c: F.coalesce(F.col(c)[0], F.array().cast("array<string>"))
        longest = F.greatest(F.size(own("a")), F.size(own("b")))
        at = F.filter(F.sequence(F.lit(0), longest - 1), lambda i: ~F.get(own("a"), i).eqNullSafe(F.get(own("b"), i)))
        found = both.select((F.col("block") * BLOCK).alias("_first"), F.explode(at).alias("_j")).select((F.col("_first") + F.col("_j")).alias("block"))
        if not number:
            return found.select(F.col("block").alias("position"))
        open_blocks = found
