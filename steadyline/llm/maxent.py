"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) P(subclass | class, history) P(word | subclass). The first two factors are
softmaxes over hashed n-gram and skip features of the three words before; the third is the words' smoothed
frequency in the subclass. Classes come from a sign hash of the words' neighbours in the training texts, so words
that keep like company fall together. All counts are over the whole training corpus, and each training round is
a pass over all of it: chunks take gradient steps from common weights, which are then averaged. Texts are cut into
words once; later passes read each chunk as numbers of its distinct words and their hashes.
"""

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from steadyline.llm.exchange import Chunks, by_bucket, chunks_with, packed, runs, unpacked
from steadyline.llm.words import LOWER, hashes, mixed, words_of
from steadyline.sources.staging import staged

SIDE = 16  # classes, and subclasses of each
BITS = 8  # of the neighbour hash: SIDE * SIDE subclasses
NEAR = (1, 2)  # how far a neighbour may be
ALPHA = 0.1  # added to each count
N_FEATURES = 5
BLOCKS = 8
START = np.uint64(0x5851F42D4C957F2D)  # stands for the words before a text
END = np.uint64(0x14057B7EF767814F)
END_LEAF = 0
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Settings(NamedTuple):
    first_bits: int = 14  # 2**first_bits hashed rows of weights for classes
    second_bits: int = 15  # for subclasses
    rounds: int = 2
    batch: int = 16_384  # tokens of a gradient step at most
    steps: int = 16  # and steps of a chunk at least
    rate: float = 0.3
    caution: float = 8.0  # sum of squares that each weight starts with
    folds: int = 10  # documents with CRC-32 of their id divisible by it are not learnt from


class Model(NamedTuple):
    weights: np.ndarray  # float32, (rows, SIDE): rows for classes first
    leaf_tokens: np.ndarray
    leaf_words: np.ndarray
    end_count: int
    tokens: int
    vocabulary: int


def is_held_out(doc_id: pa.Array, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in doc_id.to_pylist()], bool)


class _Chunk:
    """The words of a chunk and its distinct words in the order in which it asks and is answered."""

    CODED = "doc_ids array<bigint>, starts binary, places binary, hashes binary"

    def __init__(self, given: pa.Table, n: int, folds: int):
        words = words_of(given["text"], LOWER)
        high, low = hashes(words.vocab)
        bucket = high % np.uint64(n)
        order = np.lexsort((low, bucket))
        self.bucket, self.low, self.hash = bucket[order].astype(np.int64), low[order], high[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.place = place[words.code] if len(order) else np.zeros(0, np.int32)
        self.start, self.doc_id = words.start, given["doc_id"].combine_chunks()
        self.held = is_held_out(self.doc_id, folds)
        self.number = given["chunk"][0].as_py()

    def coded(self) -> tuple:
        """What later passes need instead of the texts, as the columns of ``CODED``."""
        return self.doc_id.to_pylist(), packed(self.start), packed(self.place), self.hash.tobytes()

    @classmethod
    def read(cls, given: pa.Table, folds: int) -> "_Chunk":
        """A chunk from its one coded row; it can't ask again."""
        c = cls.__new__(cls)
        of = lambda name: given[name].combine_chunks()[0]
        c.doc_id = of("doc_ids").values
        c.start, c.place = unpacked(of("starts").as_py()), unpacked(of("places").as_py(), np.int32)
        c.hash = np.frombuffer(of("hashes").as_py(), np.uint64)
        c.held = is_held_out(c.doc_id, folds)
        return c

    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    def text_no(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), self.counts())

    def learnt(self) -> np.ndarray:
        """Which words stand in training documents."""
        return np.repeat(~self.held, self.counts())

    def company(self):
        """For each distinct word in training: count, neighbours, and the sum of the neighbours' sign bits."""
        n, learnt = len(self.low), self.learnt()
        text = self.text_no()
        bits = np.unpackbits((self.hash & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        signs = (bits.astype(np.int8) * 2 - 1)[self.place]
        total, near = np.zeros((len(text), BITS), np.int8), np.zeros(len(text), np.int8)  # a few neighbours at most
        for d in NEAR:
            if len(text) <= d:
                continue
            same = (text[d:] == text[:-d])[:, None]
            total[d:] += signs[:-d] * same
            total[:-d] += signs[d:] * same
            near[d:] += same[:, 0]
            near[:-d] += same[:, 0]
        at = self.place[learnt]
        count = np.bincount(at, minlength=n)
        total = np.ascontiguousarray(total[learnt].T)
        sums = np.stack([np.bincount(at, weights=total[j], minlength=n) for j in range(BITS)], axis=1)
        return count.astype(np.int64), np.bincount(at, weights=near[learnt], minlength=n).astype(np.int64), sums.astype(np.int64)

    def answered(self, answers: pa.Table):
        """(count, leaf) of each distinct word, from rows in bucket order."""
        answers = answers.sort_by("bucket")
        if not answers.num_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        counts = np.concatenate([unpacked(b) for b in answers["counts"].to_pylist()])
        return counts, np.concatenate([np.frombuffer(b, np.uint8) for b in answers["leaves"].to_pylist()])

    def sequence(self, count: np.ndarray, leaf: np.ndarray, end_count: int):
        """Per token, an end after each text: number of the text, count, leaf, and hashes of the three tokens before."""
        where, n = self.start[1:], len(self.start) - 1
        text = np.insert(self.text_no(), where, np.arange(n))
        own = np.insert(self.hash[self.place], where, END)
        counts = np.insert(count[self.place], where, end_count)
        leaves = np.insert(leaf[self.place], where, END_LEAF).astype(np.int64)
        before = []
        for d in (1, 2, 3):
            prior = np.full(len(own), START)
            if len(own) > d:
                prior[d:] = np.where(text[d:] == text[:-d], own[:-d], START)
            before.append(prior)
        return text, counts, leaves, before


def _features(before, bits: int, given: np.ndarray | None = None) -> np.ndarray:
    """Rows of weights, (N_FEATURES, tokens): bias, word before, two words before, and two skips."""
    one, two, three = before
    out = np.empty((N_FEATURES, len(one)), np.int64)
    shift = np.uint64(64 - bits)
    # the bias looks at no word: one row, or one for each class
    classes = np.zeros(1, np.uint64) if given is None else (np.arange(SIDE, dtype=np.uint64) + np.uint64(1)) * START
    rows = (mixed(classes + SPREAD) >> shift).astype(np.int64)
    out[0] = rows[0] if given is None else rows[given]
    for k, values in enumerate((one, one * SPREAD + two, two, three), 1):
        key = values + np.array([k + 1], np.uint64) * SPREAD
        if given is not None:
            key += classes[given]
        out[k] = mixed(key) >> shift
    return out


def _softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(SIDE, tokens): weights are gathered row by row, probabilities are worked out class by class."""
    total = np.take(weights, rows[0], axis=0)
    for k in range(1, N_FEATURES):
        total += np.take(weights, rows[k], axis=0)
    total = np.ascontiguousarray(total.T)
    total -= total.max(axis=0)
    np.exp(total, out=total)
    total /= total.sum(axis=0)
    return total


def _rows(before, leaf, s: Settings):
    top = _features(before, s.first_bits)
    sub = _features(before, s.second_bits, leaf // SIDE) + (1 << s.first_bits)
    return (top, leaf // SIDE), (sub, leaf % SIDE)


def _descended(weights: np.ndarray, before, leaf, s: Settings) -> np.ndarray:
    """One pass of adaptive gradient steps over the tokens; the new weights."""
    weights = weights.copy()
    squared = np.full(weights.shape, s.caution, np.float32)
    sums, step = np.empty(weights.shape[::-1], np.float32), np.empty(weights.shape, np.float32)
    batch = max(1, min(s.batch, -(-len(leaf) // s.steps)))
    edge = 1 << s.first_bits
    for i in range(0, len(leaf), batch):
        part = [b[i : i + batch] for b in before]
        for (rows, target), own in zip(_rows(part, leaf[i : i + batch], s), (slice(0, edge), slice(edge, None))):
            error = _softmax(weights, rows)
            error[target, np.arange(len(target))] -= 1.0
            flat, tiled = rows[1:].reshape(-1) - own.start, np.empty((N_FEATURES - 1, len(target)))
            for j in range(SIDE):
                tiled[:] = error[j]
                sums[j, own] = np.bincount(flat, weights=tiled.reshape(-1), minlength=sums[j, own].size)
            # the bias has one row, or one for each class: a small product
            of = leaf[i : i + batch] // SIDE if own.start else np.zeros(len(target), np.int64)
            bias = np.full(SIDE, -1)
            bias[of] = rows[0]
            for j, total in enumerate((error @ (of[:, None] == np.arange(SIDE)).astype(np.float32)).T):
                if bias[j] >= 0:
                    sums[:, bias[j]] += total
        gradient = np.ascontiguousarray(sums.T)
        squared += np.multiply(gradient, gradient, out=step)
        np.sqrt(squared, out=step)
        np.divide(gradient, step, out=step)
        weights -= np.multiply(step, np.float32(s.rate), out=step)
    return weights


SCORED = 4096  # tokens that are scored at once


def _log10(weights: np.ndarray, before, leaf, s: Settings) -> np.ndarray:
    out = np.zeros(len(leaf))
    for i in range(0, len(leaf), SCORED):
        part = [b[i : i + SCORED] for b in before]
        for rows, target in _rows(part, leaf[i : i + SCORED], s):
            out[i : i + SCORED] += np.log10(np.maximum(_softmax(weights, rows)[target, np.arange(len(target))], 1e-30))
    return out


class LanguageModel:
    """Learns from ``docs`` (doc_id, text) when made, and scores them.

    Texts are lowered (A-Z) and cut at blanks; each ends with an end token. Documents whose CRC-32 of the doc_id as
    text is divisible by ``folds`` are not learnt from. Null and empty texts are one end token; a null doc_id counts
    as empty text, so it is not learnt from. Repeated rows are learnt from as often as they stand there. Nothing to
    learn from: all counts are 0. Other columns are not looked at. ``sizes``: those of Chunks.
    """

    def __init__(self, docs: DataFrame, settings: Settings = Settings(), **sizes: int):
        s = self.settings = settings
        chunks = self.chunks = Chunks(docs, **sizes)
        n, spark = chunks.n, docs.sparkSession

        def ask(given: pa.Table) -> pa.Table:
            c = _Chunk(given, n, s.folds)
            count, near, sums = c.company()
            ends = int((~c.held).sum())
            rows = [(b, c.number, c.low[p].tobytes(), packed(count[p]), packed(near[p]), packed(sums[p].astype(np.int32)), int(near[p].sum()), sums[p].sum(axis=0).tolist(), 0) for b, p in runs(c.bucket)]
            rows = [(*r, None, None, None, None) for r in rows]
            rows.append((-1, c.number, b"", b"", b"", b"", 0, [0] * BITS, ends, *c.coded()))  # how many texts end here, and the chunk itself
            names = ["bucket", "chunk", "keys", "counts", "near", "sums", "all_near", "all_sums", "ends", "doc_ids", "starts", "places", "hashes"]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3]
            return pa.table([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

        asks = chunks.kept(chunks.each(ask, f"bucket int, chunk bigint, keys binary, counts binary, near binary, sums binary, all_near bigint, all_sums array<bigint>, ends bigint, {_Chunk.CODED}"), "asks")
        self.coded = asks.where("bucket = -1").select("chunk", "doc_ids", "starts", "places", "hashes")
        total = asks.agg(F.sum("ends").alias("ends"), F.sum("all_near").alias("near"), *[F.sum(F.get("all_sums", F.lit(j))).alias(f"s{j}") for j in range(BITS)]).first()
        mean = np.array([(total[f"s{j}"] or 0) / max(1, total["near"] or 0) for j in range(BITS)])

        def add_up(given: pa.Table) -> pa.Table:
            bucket = given["bucket"][0].as_py()
            keys = [np.frombuffer(b, np.uint64) for b in given["keys"].to_pylist()]
            known, at = np.unique(np.concatenate(keys), return_inverse=True)
            count, near = (np.bincount(at, weights=np.concatenate([unpacked(b) for b in given[c].to_pylist()]), minlength=len(known)).astype(np.int64) for c in ("counts", "near"))
            sums = np.concatenate([unpacked(b, np.int32).reshape(-1, BITS) for b in given["sums"].to_pylist()])
            leaf = np.zeros(len(known), np.int64)
            for j in range(BITS):
                leaf |= (np.bincount(at, weights=sums[:, j], minlength=len(known)) > near * mean[j]).astype(np.int64) << j
            leaf = np.where(count > 0, leaf, (known % np.uint64(SIDE * SIDE)).astype(np.int64)).astype(np.uint8)
            out, begin = [], 0
            for chunk, own in zip(given["chunk"].to_pylist(), keys):
                mine = at[begin : begin + len(own)]
                out.append((bucket, chunk, packed(count[mine]), leaf[mine].tobytes(), None, None))
                begin += len(own)
            tokens = np.bincount(leaf, weights=count, minlength=SIDE * SIDE).astype(np.int64)
            words = np.bincount(leaf[count > 0], minlength=SIDE * SIDE)
            out.append((bucket, None, b"", b"", tokens.tolist(), words.tolist()))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.table([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["bucket", "chunk", "counts", "leaves", "tokens", "words"])

        answers = staged(by_bucket(asks.where("bucket >= 0"), add_up, "bucket int, chunk bigint, counts binary, leaves binary, tokens array<bigint>, words array<bigint>"), "answers")
        leaves = answers.where("chunk is null").select(F.posexplode(F.arrays_zip("tokens", "words")).alias("leaf", "v"))
        leaves = leaves.groupBy("leaf").agg(F.sum("v.tokens").alias("tokens"), F.sum("v.words").alias("words")).collect()  # one row for each of 256
        tokens, words = np.zeros(SIDE * SIDE, np.int64), np.zeros(SIDE * SIDE, np.int64)
        for r in leaves:
            tokens[r.leaf], words[r.leaf] = r.tokens, r.words
        ends = total["ends"] or 0
        tokens[END_LEAF] += ends
        words[END_LEAF] += ends > 0
        self.answers = answers.where("chunk is not null").select("bucket", "chunk", "counts", "leaves")
        weights = np.zeros(((1 << s.first_bits) + (1 << s.second_bits), SIDE), np.float32)
        for _ in range(s.rounds if ends else 0):
            weights = self._round(spark, weights, ends)
        self.model = Model(weights, tokens, words, ends, int(tokens.sum()), int(words.sum()))

    def _round(self, spark, weights: np.ndarray, ends: int) -> np.ndarray:
        s = self.settings
        held = spark.sparkContext.broadcast(weights)

        def descend(given: pa.Table, answers: pa.Table) -> pa.Table:
            c = _Chunk.read(given, s.folds)
            text, _, leaf, before = c.sequence(*c.answered(answers), ends)
            learnt = ~c.held[text]
            del c, text  # the rest of the work needs room
            before = [before.pop(0)[learnt] for _ in range(len(before))]
            new = _descended(held.value, before, leaf[learnt], s)
            return _blocks(new * np.float32(learnt.sum() / 1e6), learnt.sum() / 1e6)

        def added(batches):
            """Sums by block, one batch after the other."""
            sums: dict[int, list] = {}
            for batch in batches:
                for block, values, share in zip(batch.column("block").to_pylist(), batch.column("values"), batch.column("share").to_pylist()):
                    own = sums.setdefault(block, [0.0, 0.0])
                    own[0] = own[0] + np.frombuffer(values.as_buffer(), np.float32).astype(np.float64)
                    own[1] += share
            if sums:
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(list(sums), pa.int32()), "values": pa.array([v.astype(np.float32).tobytes() for v, _ in sums.values()], pa.binary()),
                    "share": pa.array([w for _, w in sums.values()], pa.float64()),
                })

        schema = "block int, values binary, share double"
        own = chunks_with(self.coded, self.answers, descend, schema).mapInArrow(added, schema)
        rows = sorted(own.repartition(BLOCKS, "block").mapInArrow(added, schema).collect(), key=lambda r: r.block)  # the weights, once
        held.unpersist()
        if not rows or not rows[0].share:
            return weights
        return np.concatenate([np.frombuffer(r["values"], np.float32) / np.float32(r.share) for r in rows]).reshape(weights.shape)

    def scores(self) -> DataFrame:
        """One row for each row of the documents: doc_id, held_out, n_tokens, n_known, base_score, score.

        base_score: log10 probability under smoothed word frequencies; score: under the model. A word that was not
        learnt has the count 0 and the unseen word's share of its subclass.
        """
        s, m = self.settings, self.model
        held = self.chunks.df.sparkSession.sparkContext.broadcast(m)

        def score(given: pa.Table, answers: pa.Table) -> pa.Table:
            m, c = held.value, _Chunk.read(given, s.folds)
            text, count, leaf, before = c.sequence(*c.answered(answers), m.end_count)
            base = np.log10((count + ALPHA) / (m.tokens + ALPHA * (m.vocabulary + 1)))
            inside = np.log10((count + ALPHA) / (m.leaf_tokens + ALPHA * (m.leaf_words + 1))[leaf])
            own = _log10(m.weights, before, leaf, s) + inside
            size = len(c.doc_id)
            return pa.table({
                "doc_id": c.doc_id, "held_out": pa.array(c.held), "n_tokens": np.bincount(text, minlength=size),
                "n_known": np.bincount(text, weights=count > 0, minlength=size).astype(np.int64),
                "base_score": np.bincount(text, weights=base, minlength=size), "score": np.bincount(text, weights=own, minlength=size),
            })

        return chunks_with(self.coded, self.answers, score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def _blocks(weights: np.ndarray, share: float) -> pa.Table:
    parts = np.array_split(weights.reshape(-1), BLOCKS)
    return pa.table({
        "block": pa.array(range(BLOCKS), pa.int32()), "values": pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary()),
        "share": pa.array([share] * BLOCKS, pa.float64()),
    })
