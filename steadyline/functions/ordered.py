"""Per-key ordered computations that stay balanced when one key holds a large part of all rows.

A plain ``Window.partitionBy(key)`` puts all rows of a key into one task. Here the rows are range-split on
(keys, order) into contiguous chunks instead, so a heavy key is spread over many chunks. Each chunk is
summarised to one row per key, the summaries are combined (at most one row per key and chunk), and the result
is handed back to the chunks. ``order`` must end in a unique column, or a heavy key cannot be split.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyline.sources.staging import staged

CHUNK = "_chunk"
KEY = "_key"
BLOCK_ROWS = 256


class Ordered:
    def __init__(
        self, df: DataFrame, keys: list[str], order: list[str | Column], name: str = "ordered",
        derived: dict[str, Column] | None = None,
    ):
        self.keys, self.order = keys, order
        # derived columns are computed after the range shuffle: its sampling pass evaluates what lies before it once more
        split = df.repartitionByRange(*keys, *order).withColumns({CHUNK: F.spark_partition_id(), **(derived or {})})
        # the key as one struct: NULL keys then compare as equal, and windows and joins agree on the partitioning
        key = F.struct(*keys) if keys else F.lit(0)
        self.df = staged(split, name).withColumn(KEY, key)

    def _local(self):
        return Window.partitionBy(CHUNK, KEY).orderBy(*self.order)

    def _with_earlier(self, rows: DataFrame, summary: list[Column], carry: dict[str, Column]) -> DataFrame:
        """Give each row the values that ``carry`` takes over the same key's earlier chunks."""
        chunks = self.df.groupBy(CHUNK, KEY).agg(*summary)
        before = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = chunks.select(CHUNK, KEY, *[c.over(before).alias(n) for n, c in carry.items()])
        return rows.join(offsets, [CHUNK, KEY], "left").drop(CHUNK, KEY)

    def row_number(self, name: str) -> DataFrame:
        rows = self.df.withColumn("_local", F.row_number().over(self._local()))
        rows = self._with_earlier(rows, [F.count("*").alias("_n")], {"_before": F.sum("_n")})
        number = F.col("_local") + F.coalesce("_before", F.lit(0))
        return rows.withColumn(name, number.cast("bigint")).drop("_local", "_before")

    def running_sums(self, columns: dict[str, str]) -> DataFrame:
        """Sum of ``column`` from the key's first row to this row, for ``{name: column}``; exact types only."""
        upto = self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.df.withColumns({f"_l_{n}": F.sum(c).over(upto) for n, c in columns.items()})
        rows = self._with_earlier(
            rows,
            [F.sum(c).alias(f"_s_{n}") for n, c in columns.items()],
            {f"_b_{n}": F.sum(f"_s_{n}") for n in columns},
        )
        sums = {n: F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0)) for n in columns}
        return rows.withColumns(sums).drop(*[f"_l_{n}" for n in columns], *[f"_b_{n}" for n in columns])

    def previous(self, column: str, name: str) -> DataFrame:
        """Value of ``column`` on the row before, within the key. ``order`` must be plain ascending names."""
        rows = self.df.withColumns(
            {"_prev": F.lag(column).over(self._local()), "_first": F.row_number().over(self._local()) == 1}
        )
        newest = F.max(F.struct(*self.order, F.col(column).alias("_v"))).alias("_newest")
        rows = self._with_earlier(rows, [newest], {"_before": F.max("_newest")})
        value = F.when(F.col("_first"), F.col("_before._v")).otherwise(F.col("_prev"))
        return rows.withColumn(name, value).drop("_prev", "_first", "_before")

    def latest(self, value: Column, counts: Column, name: str) -> DataFrame:
        """``value`` of the last row up to this one, within the key, where ``counts`` holds. ``order`` must be plain ascending names."""
        held = F.when(counts, F.struct(value.alias("_v")))
        rows = self.df.withColumn("_here", F.last(held, ignorenulls=True).over(self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        newest = F.max(F.when(counts, F.struct(*self.order, held.alias("_h")))).alias("_newest")
        rows = self._with_earlier(rows, [newest], {"_before": F.max("_newest")})
        return rows.withColumn(name, F.coalesce(F.col("_here"), F.col("_before._h"))["_v"]).drop("_here", "_before")


# ---- replay of a finite-state log ----------------------------------------------------------------
#
# Each log row acts on the state as a function over the (few) states, written as text: character i is the
# state reached from state i. Functions compose with ``translate``, and composing is associative, so blocks
# of rows, chunks of blocks and keys of chunks are combined level by level, without a long per-key array.


def state_letters(n: int) -> str:
    return "".join(chr(ord("A") + i) for i in range(n))


def _translate(text: Column, source: Column, target: Column) -> Column:
    return F.call_function("translate", text, source, target)


def _composed(steps: Column, letters: str) -> Column:
    return F.aggregate(steps, F.lit(letters), lambda f, s: _translate(f, F.lit(letters), s["_fn"]))


def _entries(steps: Column, start: Column, letters: str) -> Column:
    """Text whose i-th character is the state before step i."""
    first = F.struct(start.alias("state"), F.lit("").alias("path"))
    walk = F.aggregate(
        steps,
        first,
        lambda acc, s: F.struct(
            _translate(acc["state"], F.lit(letters), s["_fn"]).alias("state"),
            F.concat(acc["path"], acc["state"]).alias("path"),
        ),
    )
    return walk["path"]


def replay_states(
    log: DataFrame, key: str, order: list[str], source: Column, target: Column, n_states: int, initial: int
) -> DataFrame:
    """Add ``state_before`` and ``state_after`` (state numbers) to each log row.

    ``source`` / ``target``: equally long texts of letters (see ``state_letters``); a row moves state
    ``source[i]`` to ``target[i]`` and leaves any other state as it is.
    """
    letters = state_letters(n_states)
    action = _translate(F.lit(letters), source, target)
    run = Ordered(log, [key], order, "replay", derived={"_fn": action})
    rows = run.df.withColumn("_rn", F.row_number().over(run._local()) - 1).withColumns(
        {"_block": F.floor(F.col("_rn") / BLOCK_ROWS).cast("int"), "_pos": F.col("_rn") % BLOCK_ROWS}
    )

    def listed(df: DataFrame, by: list[str], index: str, keep: list[str]) -> DataFrame:
        """Steps in order per ``by``: at most a block of rows, a chunk's blocks, or a key's chunks."""
        return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(index, *keep))).alias("_steps"))

    def summed(df: DataFrame) -> DataFrame:
        return df.withColumn("_fn", _composed(F.col("_steps"), letters))

    # up: rows -> blocks -> chunks -> keys, with the functions only. (chunk, key) is one partitioning for the first
    # three levels; the chunk level is small and read twice, so it is staged.
    by_block = [CHUNK, KEY, "_block"]
    light = summed(listed(rows, by_block, "_pos", ["_fn"])).drop("_steps")
    chunks = staged(summed(listed(light, [CHUNK, KEY], "_block", ["_fn"])), "replay_chunks")
    keys = listed(chunks, [KEY], CHUNK, ["_fn"])

    # down: the state before each chunk, then before each block, then before each row
    # (a path is computed in a select of its own: next to an explode it would be computed again for every row)
    key_paths = keys.withColumn("_path", _entries(F.col("_steps"), F.lit(letters[initial]), letters))
    chunk_entry = key_paths.select(KEY, "_path", F.posexplode("_steps").alias("_i", "_s")).select(
        F.col(f"_s.{CHUNK}").alias(CHUNK), KEY, F.substring("_path", F.col("_i") + 1, F.lit(1)).alias("_entry")
    )
    block_paths = chunks.join(chunk_entry, [CHUNK, KEY]).select(
        CHUNK, KEY, _entries(F.col("_steps"), F.col("_entry"), letters).alias("_block_path")
    )
    blocks = listed(rows, by_block, "_pos", ["_fn", *log.columns])
    entered = blocks.join(block_paths, [CHUNK, KEY])
    entry = F.substring("_block_path", F.col("_block") + 1, F.lit(1))
    row_paths = entered.select("_steps", _entries(F.col("_steps"), entry, letters).alias("_row_path"))
    out = row_paths.select("_row_path", F.posexplode("_steps").alias("_i", "_s")).select(
        F.substring("_row_path", F.col("_i") + 1, F.lit(1)).alias("_before"), "_s"
    )
    after = _translate(F.col("_before"), F.lit(letters), F.col("_s._fn"))
    return out.select(
        *[F.col(f"_s.{c}").alias(c) for c in log.columns],
        (F.ascii("_before") - ord("A")).alias("state_before"),
        (F.ascii(after) - ord("A")).alias("state_after"),
    )
