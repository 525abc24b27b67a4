"""Substring dedup with fixed-block anchors.

Of any run of ``window`` = 2 * block - 1 words one whole non-overlapping block lies inside, so the blocks of each
document are indexed and every rolling run of ``block`` words is looked up. Around the hits, the windows of both sides are
compared by hashes of all their words, and touching windows add up to the maximal repeats.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from steadyline.llm.exchange import NONE, Chunks, by_bucket, doc_ids, found, packed, runs, two_least, unpacked
from steadyline.llm.words import gram_hashes, gram_starts, hashes, words_of

WINDOW = 13
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


class Prepared(NamedTuple):
    words: object
    high: np.ndarray
    low: np.ndarray
    doc: np.ndarray  # id of each word's document


def _prepared(given: pa.Table) -> Prepared:
    words = words_of(given["text"])
    high, low = hashes(words.vocab)
    return Prepared(words, high[words.code], low[words.code], np.repeat(doc_ids(given), words.counts()))


def _anchors(p: Prepared, block: int, n: int):
    """Start, key and alignment of each run of ``block`` words. A key is the hash bucket and 32 bits: a filter only."""
    h = gram_hashes(p.high, block)
    start = np.flatnonzero(gram_starts(p.words.start, block))
    h = h[start]
    key = ((h >> HALF) % np.uint64(n)) << HALF | (h & LOW)
    aligned = (start - p.words.start[np.searchsorted(p.words.start, start, "right") - 1]) % block == 0
    return start, key, aligned


def _windows(p: Prepared, window: int, n: int):
    """Start, bucket and key of each window; the two together tell windows apart."""
    start = np.flatnonzero(gram_starts(p.words.start, window))
    return start, gram_hashes(p.high, window)[start] % np.uint64(n), gram_hashes(p.low, window)[start]


def _least(keys: np.ndarray, doc: np.ndarray):
    """Distinct keys, sorted, with the least document of each."""
    order = np.lexsort((doc, keys))
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], doc[first]


def repeats(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text, spans.

    A word goes if a window of ``window`` consecutive words that covers it stands in a document with a smaller
    doc_id too. kept_text: the other words, joined by one space; spans: the maximal removed runs as
    (first, end) word numbers, end exclusive. Null and empty texts have no words. Rows of one doc_id do not take from
    each other; a null doc_id comes after all others. Other columns are not looked at. ``window`` is odd;
    ``sizes``: those of Chunks.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    block, chunks = (window + 1) // 2, Chunks(docs, **sizes)
    n = chunks.n

    def ask(given: pa.Table) -> pa.Table:
        p = _prepared(given)
        start, key, aligned = _anchors(p, block, n)
        probes = np.unique(key)
        blocks, least = _least(key[aligned], p.doc[start[aligned]])
        number, rows = given["chunk"][0].as_py(), []
        at = np.searchsorted(blocks >> HALF, np.arange(n + 1))
        for bucket, part in runs((probes >> HALF).astype(np.int64)):
            mine = slice(at[bucket], at[bucket + 1])
            rows.append((bucket, number, (probes[part] & LOW).astype(np.uint32).tobytes(), (blocks[mine] & LOW).astype(np.uint32).tobytes(), packed(least[mine])))
        return _table(rows, [("bucket", pa.int32()), ("chunk", pa.int64()), ("probes", pa.binary()), ("blocks", pa.binary()), ("docs", pa.binary())])

    def look_up(given: pa.Table) -> pa.Table:
        """For each chunk its runs that are a block somewhere and stand in more than one chunk, with the least other document."""
        number = given["chunk"].to_numpy()
        probes = [np.frombuffer(b, np.uint32) for b in given["probes"].to_pylist()]
        blocks = [np.frombuffer(b, np.uint32) for b in given["blocks"].to_pylist()]
        doc = np.concatenate([unpacked(b) for b in given["docs"].to_pylist()])
        keys, first, whose, second = two_least(np.concatenate(blocks), doc, np.repeat(number, [len(b) for b in blocks]))
        chunks_of = np.zeros(len(keys), np.int64)
        met = []
        for own in probes:
            at, there = found(keys, own)
            met.append((at[there], own[there]))
            chunks_of[at[there]] += 1
        rows, bucket = [], given["bucket"][0].as_py()
        for c, (at, own) in zip(number.tolist(), met):
            shared = chunks_of[at] > 1
            at, own = at[shared], own[shared]
            if len(at):
                rows.append((bucket, c, own.tobytes(), packed(np.where(whose[at] == c, second[at], first[at]))))
        return _table(rows, ANSWER)

    def announce(given: pa.Table, answers: pa.Table) -> pa.Table:
        """The windows around hits, of those that were hit and of those that hit."""
        p = _prepared(given)
        start, key, aligned = _anchors(p, block, n)
        doc = p.doc[start]
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
        shared, elsewhere = np.zeros(len(at), bool), np.full(len(at), NONE)
        near = np.zeros(0, np.int64)
        if len(at):
            here = np.minimum.reduceat(np.where(aligned, doc, NONE)[order], at)  # least document with it as a block
            latest = np.maximum.reduceat(doc[order], at)
            answers = answers.sort_by("bucket")
            asked = [np.frombuffer(b, np.uint32).astype(np.uint64) | np.uint64(k) << HALF for k, b in zip(answers["bucket"].to_pylist(), answers["keys"].to_pylist())]
            if asked:
                pos, shared = found(np.concatenate(asked), key[order][at])
                elsewhere[shared] = np.concatenate([unpacked(b) for b in answers["docs"].to_pylist()])[pos[shared]]
            hits = np.minimum(here, elsewhere)[group] < doc[order]
            hit = aligned[order] & (shared[group] | (latest[group] > doc[order]))
            near = start[order][hits | hit]
        first, bucket, value = _windows(p, window, n)
        keep = _within(first, near, window - block)
        first, bucket, value = first[keep], bucket[keep], value[keep]
        order = np.lexsort((p.doc[first], value, bucket))
        bucket, value, least = bucket[order], value[order], p.doc[first][order]
        new = np.append(True, (np.diff(bucket) != 0) | (np.diff(value) != 0)) if len(value) else np.zeros(0, bool)
        bucket, value, least = bucket[new], value[new], least[new]
        number = given["chunk"][0].as_py()
        return _table([(b, number, value[part].tobytes(), packed(least[part])) for b, part in runs(bucket.astype(np.int64))], ANSWER)

    def compare(given: pa.Table) -> pa.Table:
        """For each chunk its announced windows that another chunk has too, with the least document there."""
        number = given["chunk"].to_numpy()
        values = [np.frombuffer(b, np.uint64) for b in given["keys"].to_pylist()]
        doc = np.concatenate([unpacked(b) for b in given["docs"].to_pylist()])
        keys, first, whose, second = two_least(np.concatenate(values), doc, np.repeat(number, [len(v) for v in values]))
        rows, bucket = [], given["bucket"][0].as_py()
        for c, own in zip(number.tolist(), values):
            at, _ = found(keys, own)
            other = np.where(whose[at] == c, second[at], first[at])
            there = other != NONE
            if there.any():
                rows.append((bucket, c, own[there].tobytes(), packed(other[there])))
        return _table(rows, ANSWER)

    def cut(given: pa.Table, answers: pa.Table) -> pa.Table:
        p = _prepared(given)
        first, bucket, value = _windows(p, window, n)
        doc = p.doc[first]
        order = np.lexsort((doc, value, bucket))
        gone = np.zeros(len(p.doc) + 1, np.int64)
        if len(order):
            new = np.append(True, (np.diff(bucket[order]) != 0) | (np.diff(value[order]) != 0))
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]  # in this chunk
            asked = [np.frombuffer(b, np.uint64) for b in answers["keys"].to_pylist()]
            if asked:
                keys, where = np.concatenate(asked), np.repeat(answers["bucket"].to_numpy(), [len(a) for a in asked])
                other = np.concatenate([unpacked(b) for b in answers["docs"].to_pylist()])
                by = np.lexsort((where, keys))
                keys, where, other = keys[by], where[by], other[by]
                pos = np.searchsorted(keys, value[order])
                for _ in range(8):  # keys are 64 random bits: hardly ever do two buckets hold one key
                    pos_in = np.minimum(pos, len(keys) - 1)
                    same = (keys[pos_in] == value[order]) & (pos < len(keys))
                    there = same & (where[pos_in] == bucket[order].astype(np.int64))
                    least = np.where(there, np.minimum(least, other[pos_in]), least)
                    if not (same & ~there).any():
                        break
                    pos = pos + (same & ~there)
            over = first[order][least < doc[order]]
            np.add.at(gone, over, 1)
            np.add.at(gone, over + window, -1)
        removed = np.cumsum(gone[:-1]) > 0
        words, counts = p.words, p.words.counts()
        kept = np.concatenate([[0], np.cumsum(~removed)])[words.start]
        chosen = words.vocab.take(pa.array(words.code[~removed]))
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept), chosen), pa.scalar(b" ", pa.large_binary()))
        edge = np.zeros(len(removed) + 1, bool)  # a text begins or ends
        edge[words.start] = True
        begins = np.flatnonzero(removed & (edge[:-1] | ~np.append(False, removed[:-1])))
        ends = np.flatnonzero(removed & (edge[1:] | ~np.append(removed[1:], False))) + 1
        no = np.searchsorted(words.start, begins, "right") - 1
        base = words.start[no]
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(no, np.arange(len(counts) + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array((begins - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["first", "end"]),
        )
        return pa.table({
            "doc_id": given["doc_id"], "n_words": counts.astype(np.int64), "n_removed": counts - np.diff(kept),
            "kept_text": text.cast(pa.large_string()).cast(pa.string()), "spans": spans,
        })

    asks = chunks.each(ask, "bucket int, chunk bigint, probes binary, blocks binary, docs binary")
    answer = "bucket int, chunk bigint, keys binary, docs binary"
    hits = by_bucket(asks, look_up, answer)
    windows = chunks.each_with(hits, announce, answer)
    others = by_bucket(windows, compare, answer)
    return chunks.each_with(others, cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<first:int,end:int>>")


ANSWER = [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())]


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, t) for (name, t), c in zip(fields, columns)})


def _within(starts: np.ndarray, anchors: np.ndarray, reach: int) -> np.ndarray:
    """Which starts have an anchor 0 to ``reach`` words after them."""
    anchors = np.sort(anchors)
    at = np.searchsorted(anchors, starts)
    return (at < len(anchors)) & (np.append(anchors, np.iinfo(np.int64).max - 1)[at] - starts <= reach)
