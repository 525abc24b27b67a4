"""Benchmark decontamination by winnowing.

Of the k-gram hashes in each window of ``size`` words the least is kept, on both sides. Equal windows keep equal
hashes, so the join of the kept ones misses no shared window; the windows behind a joined hash are then compared
by a 128-bit hash of all their words, and touching ones make up the whole shared span.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyline.llm.batches import SMALL_SLICE_BYTES, slices
from steadyline.llm.words import ALNUM, gram_hashes, gram_starts, hashes, words_of
from steadyline.sources.staging import staged

WINDOW = 13
#: at most so many keys (two longs each) are broadcast, after counting them; more are joined by a shuffle
BROADCAST_KEYS = 500_000


def _kept(word: np.ndarray, start: np.ndarray, size: int):
    """Winnowing: (hash, first window, windows) of each run of windows that keep the same k-gram hash."""
    k = (size + 1) // 2
    grams, inside = gram_hashes(word, k), gram_starts(start, size)
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = grams[: len(inside)].copy()
    for i in range(1, size - k + 1):
        np.minimum(least, grams[i : i + len(inside)], out=least)
    at = np.flatnonzero(inside)
    value = least[at]
    # a run ends where the value changes or the text does
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (np.diff(at) != 1)])
    first = np.flatnonzero(new)
    return value[first], at[first], np.diff(np.append(first, len(at)))


def _prepared(texts: pa.Array):
    words = words_of(texts, ALNUM)
    high, low = hashes(words.vocab)
    return words, high[words.code], low[words.code]


def _text_of(start: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(start, at, "right") - 1


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, print, high, low) of every window of every item."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE_BYTES):
                words, high, low = _prepared(part.column("text"))
                counts = words.counts()
                for size in sorted(set(np.minimum(counts, window).tolist()) - {0}):
                    value, first, n = _kept(high, words.start, size)
                    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())  # all windows of the runs
                    no = _text_of(words.start, at)
                    own = np.minimum(counts, window)[no] == size
                    both = [gram_hashes(w, size)[at[own]].view(np.int64) for w in (high, low)]
                    yield pa.RecordBatch.from_arrays([
                        part.column("item_id").take(pa.array(no[own])), pa.array(np.full(own.sum(), size, np.int32)),
                        pa.array(np.repeat(value, n)[own].view(np.int64)), *map(pa.array, both),
                    ], names=["item_id", "size", "print", "high", "low"])

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, size int, print bigint, high bigint, low bigint")


def _doc_prints(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(k1, k2, size, print, first, n): the kept hashes of each document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE_BYTES):
                words, high, _ = _prepared(part.column("text"))
                for size in sizes:
                    value, first, n = _kept(high, words.start, size)
                    no = _text_of(words.start, first)
                    rows = pa.array(no)
                    yield pa.RecordBatch.from_arrays([
                        part.column("k1").take(rows), part.column("k2").take(rows), pa.array(np.full(len(no), size, np.int32)),
                        pa.array(value.view(np.int64)), pa.array((first - words.start[no]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ], names=["k1", "k2", "size", "print", "first", "n"])

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, size int, print bigint, first int, n int")


def _compared(docs: DataFrame) -> DataFrame:
    """(k1, k2, size, start, high, low) of the windows in ``runs`` of each document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE_BYTES):
                words, high, low = _prepared(part.column("text"))
                runs = part.column("runs")
                no = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
                size, first, n = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in runs.flatten().flatten())
                for s in np.unique(size).tolist():
                    mine = size == s
                    m, text = n[mine], np.repeat(no[mine], n[mine])
                    start = np.repeat(first[mine] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    at, rows = start + words.start[text], pa.array(text)
                    yield pa.RecordBatch.from_arrays([
                        part.column("k1").take(rows), part.column("k2").take(rows), pa.array(np.full(len(at), s, np.int32)),
                        pa.array(start.astype(np.int32)), *(pa.array(gram_hashes(w, s)[at].view(np.int64)) for w in (high, low)),
                    ], names=["k1", "k2", "size", "start", "high", "low"])

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, size int, start int, high bigint, low bigint")


def _counted(docs: DataFrame) -> DataFrame:
    table = np.frombuffer(bytes(0 if b == 32 or 9 <= b <= 13 else 1 for b in ALNUM), np.uint8)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE_BYTES):
                texts = part.column("text").cast(pa.large_binary()).fill_null(b"")
                at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = texts.buffers()[2]
                n = np.zeros(len(texts), np.int64)
                if data is not None and at[-1] > at[0]:
                    inside = table[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]
                    begins = inside.copy()
                    begins[1:] &= 1 - inside[:-1]
                    starts = at[:-1] - at[0]
                    full = np.diff(at) > 0
                    begins[starts[full]] = inside[starts[full]]  # a text begins anew
                    n[full] = np.add.reduceat(begins, starts[full], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array(n)], names=["doc_id", "k1", "k2", "n_words"])

    return docs.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items (array<bigint>), contaminated.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not looked at. A window is ``window``
    consecutive words of an item, or the whole of an item with fewer words. A document word inside any occurrence
    of a window is hit; ``contaminated``: at least one word in ``share`` is. Null, empty and wordless texts have no
    words, and are no item. Repeated rows are judged alike. An item without an id marks words but is not listed;
    items of one id count once. No items at all: nothing is hit.
    """
    return _judged(docs, items, window, share).drop("k1", "k2")


def _keys() -> dict[str, Column]:
    """What stands for a row's doc_id and text, also where the id is null or repeated."""
    return {"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("doc_id", "text")}


def _judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """contamination() with k1 and k2."""
    windows = staged(_item_windows(items, window), "windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most ``window`` values
    keyed = docs.select("doc_id", "text").withColumns(_keys())
    met = _doc_prints(keyed.select("k1", "k2", "text"), sizes).join(windows.select("size", "print").distinct(), ["size", "print"], "left_semi")
    runs = staged(met.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("size", "first", "n")).alias("runs")), "runs")
    few = runs.count() <= BROADCAST_KEYS
    found = keyed.select("k1", "k2", "text")
    if few:
        found = found.join(F.broadcast(runs.select("k1", "k2")), ["k1", "k2"], "left_semi")
    found = _compared(found.dropDuplicates(["k1", "k2"]).join(runs, ["k1", "k2"]))
    listed = windows.groupBy("size", "high", "low").agg(F.collect_set("item_id").alias("ids"))
    hits = found.join(listed, ["size", "high", "low"])
    per_doc = hits.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("ids"))).alias("items"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
    )["n"]
    judged = per_doc.select("k1", "k2", covered.alias("n_hit"), "items")
    every = _counted(keyed).join(judged, ["k1", "k2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return every.select(
        "k1", "k2", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **rule) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own text, also where doc_id is null or repeated."""
    bad = staged(_judged(docs, items, **rule).where("contaminated").select("k1", "k2").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    keys = _keys()
    out = docs.withColumns({f"__{k}": c for k, c in keys.items()}).alias("d")
    out = out.join(bad.alias("b"), (F.col("d.__k1") == F.col("b.k1")) & (F.col("d.__k2") == F.col("b.k2")), "left_anti")
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns])
