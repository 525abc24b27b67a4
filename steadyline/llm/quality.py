"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text: its words (A-Z lowered) and pairs of words; the words' shapes (letters, digits and marks with
runs folded, a repeat of the word before as a shape of its own), pairs and triples of shapes. Each occurrence adds
``SCALE / number of words`` to its hashed feature, so a score is a sparse dot product whatever the length.
"""

import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from steadyline.llm.batches import SMALL_SLICE_BYTES, slices, with_column
from steadyline.llm.words import gram_hashes, gram_starts, hashes, listed, mixed, words_of
from steadyline.sources.staging import new_location, staged

SCALE = 8.0
BLOCKS = 16
SHAPES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
RUN = re.compile(rb"(.)\1+", re.DOTALL)
REPEAT = np.uint64(1)  # the shape of a word that stands before it too


class Settings(NamedTuple):
    bits: int = 18  # 2**bits hashed features
    max_train_rows: int = 20_000  # labelled rows that the fit uses, the least by hash of doc_id
    shards: int = 8  # fitted side by side and averaged after each round
    rounds: int = 4
    alpha: float = 1.0
    beta: float = 0.3
    l1: float = 1e-3
    l2: float = 1e-3


def occurrences(texts: pa.Array, bits: int):
    """For each kind of feature: (hashed feature, number of the text) of each occurrence; and words by text."""
    words = words_of(texts)
    vocab = listed(words.vocab)
    plain, _ = hashes(pa.array([w.lower() for w in vocab], pa.large_binary()))
    shape, _ = hashes(pa.array([RUN.sub(rb"\1", w.translate(SHAPES)) for w in vocab], pa.large_binary()))
    word, form = plain[words.code], shape[words.code]
    if len(word) > 1:
        form[1:][words.code[1:] == words.code[:-1]] = REPEAT
    text_no, found = words.text_no(), []
    for kind, (values, n) in enumerate(((word, 1), (word, 2), (form, 1), (form, 2), (form, 3))):
        inside = gram_starts(words.start, n)
        hashed = mixed(gram_hashes(values, n)[inside] + np.uint64(kind)) >> np.uint64(64 - bits)
        found.append((hashed.astype(np.int64), text_no[: len(inside)][inside]))
    return found, words.counts()


def _vectors(texts: pa.Array, bits: int):
    """Sparse vectors: (start of each text, feature, value)."""
    found, n_words = occurrences(texts, bits)
    keys = np.concatenate([(no << bits) | f for f, no in found])
    keys, times = np.unique(keys, return_counts=True)
    no = keys >> bits
    value = times * (SCALE / np.maximum(n_words, 1))[no]
    return np.searchsorted(no, np.arange(len(n_words) + 1)), keys & ((1 << bits) - 1), value


def _weights(z, n, s: Settings):
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _follow(z, n, feature, value, label, s: Settings):
    """One update of FTRL-Proximal on one vector, in place. The last coordinate is the bias."""
    w = _weights(z[feature], n[feature], s)
    p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
    g = (p - label) * value
    grown = n[feature] + g * g
    z[feature] += g - (np.sqrt(grown) - np.sqrt(n[feature])) / s.alpha * w
    n[feature] = grown


def _by_shard(vectors: DataFrame, shards: int) -> DataFrame:
    """One row for each doc_id, as a table bucketed by shard: dealt out once, and each round reads its shards from there."""
    spark = vectors.sparkSession
    # rows of a doc_id are of one shard, so the rows stay where the first deal has put them
    own = vectors.repartition(shards, "shard").dropDuplicates(["shard", "doc_id"])
    name = f"steadyline_vectors_{uuid.uuid4().hex}"
    own.write.bucketBy(shards, "shard").option("path", new_location(spark, "vectors")).format("parquet").saveAsTable(name)
    return spark.table(name)


def fitted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights, the bias last, from labelled rows (doc_id, quality 0 or 1) of documents (doc_id, text).

    Other label values and rows without doc_id are left out; a document labelled more than once counts as its least
    label, a doc_id that stands on several rows as one of them. Nothing to learn from: all weights 0, score 0.5.
    """
    s, spark = settings, docs.sparkSession
    size = (1 << s.bits) + 1
    pick = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_label"))
    pick = staged(pick.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_train_rows), "sample")
    # bounded by max_train_rows
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")

    def vectorised(batches):
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE_BYTES):
                start, feature, value = _vectors(part.column("text"), s.bits)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("_label"),
                    pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(feature, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(value, pa.float32())),
                ], names=["doc_id", "label", "feature", "value"])

    vectors = rows.mapInArrow(vectorised, "doc_id bigint, label int, feature array<int>, value array<float>")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(s.shards)).cast("int").alias("shard")
    vectors = _by_shard(vectors.select("*", shard), s.shards)
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(s.rounds):
        start = spark.sparkContext.broadcast((z, n))

        def local(given: pa.Table) -> pa.Table:
            z, n = (x.copy() for x in start.value)
            label = given["label"].to_pylist()
            # in order of doc_id, row by row where it lies: a sorted copy would double what a shard takes
            for i in pc.sort_indices(given["doc_id"]).to_pylist():
                at = np.append(given["feature"][i].values.to_numpy(zero_copy_only=False), size - 1)
                x = np.append(given["value"][i].values.to_numpy(zero_copy_only=False).astype(np.float64), 1.0)
                _follow(z, n, at, x, label[i], s)
            blobs = [(i, *(np.array_split(v, BLOCKS)[i].tobytes() for v in (z, n))) for i in range(BLOCKS)]
            return pa.table({"block": pa.array([b[0] for b in blobs], pa.int32()), "z": [b[1] for b in blobs], "n": [b[2] for b in blobs]})

        def mean(given: pa.Table) -> pa.Table:
            means = [np.mean([np.frombuffer(b) for b in given[c].to_pylist()], axis=0).tobytes() for c in ("z", "n")]
            return pa.table({"block": given["block"][:1], "z": [means[0]], "n": [means[1]]})

        schema = "block int, z binary, n binary"
        # a fixed number of blocks of a fixed size comes to the driver
        blocks = vectors.groupBy("shard").applyInArrow(local, schema).groupBy("block").applyInArrow(mean, schema).collect()
        if blocks:
            blocks.sort(key=lambda r: r.block)
            z, n = (np.concatenate([np.frombuffer(r[c]) for r in blocks]) for c in ("z", "n"))
        start.unpersist()
    return _weights(z, n, s)


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher: label 1 likelier. Empty and null texts get the bias's score."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    bits = int(np.log2(len(weights) - 1))

    def compute(texts):
        w = held.value
        found, n_words = occurrences(texts, bits)
        total = sum(np.bincount(no, w[f], minlength=len(texts)) for f, no in found)
        score = w[-1] + total * SCALE / np.maximum(n_words, 1)
        return [pa.array(1.0 / (1.0 + np.exp(-np.clip(score, -35, 35))))]

    return with_column(docs, "text", {name: T.DoubleType()}, compute, SMALL_SLICE_BYTES)


def held_out(of: int):
    """True for one document in ``of``, by CRC-32 of the doc_id as text (null: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == 0
