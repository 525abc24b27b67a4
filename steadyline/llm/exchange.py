"""Chunks of documents that ask other chunks about hashes, without moving their texts.

Documents are written once as a table of chunks that is bucketed by chunk, so each later pass finds a chunk's texts
in one task without a shuffle. A chunk asks with its distinct hashes (what many of its documents share is asked
once), packed into one row for each hash bucket; the bucket answers each chunk in the same packed form.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from steadyline.sources.staging import new_location

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 100_000  # Spark's own limit for a table
NONE = np.iinfo(np.int64).max  # no document; a null doc_id counts as this, after all others


class Chunks:
    """``docs`` (doc_id, text) as a bucketed table with a chunk number; ``n``: hash buckets, in proportion to the bytes."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES):
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = min(MOST_BUCKETS, max(1, math.ceil(total / bucket_bytes)))

        def numbered(batches):
            part, seq, size = TaskContext.get().partitionId(), 0, 0
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
                chunk = []
                for s in sizes:
                    if size and size + s > chunk_bytes:
                        seq, size = seq + 1, 0
                    size += s + 64
                    chunk.append(part << 32 | seq)
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *batch.columns], names=["chunk", "doc_id", "text"])

        self.df = self.kept(docs.select("doc_id", "text").mapInArrow(numbered, "chunk bigint, doc_id bigint, text string"), "chunks")

    def kept(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` as a table that is bucketed by chunk."""
        spark, full = rows.sparkSession, f"steadyline_{name}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.n, "chunk").option("path", new_location(spark, name)).option("compression", "zstd").format("parquet").saveAsTable(full)
        return spark.table(full)

    def each(self, compute, schema: str) -> DataFrame:
        return self.df.groupBy("chunk").applyInArrow(compute, schema)

    def each_with(self, answers: DataFrame, compute, schema: str) -> DataFrame:
        """``compute(docs, answers)`` for each chunk; there may be no answers."""
        return chunks_with(self.df, answers, compute, schema)


def chunks_with(own: DataFrame, answers: DataFrame, compute, schema: str) -> DataFrame:
    """``compute(own, answers)`` for each chunk of a table bucketed by chunk."""
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(compute, schema)


def by_bucket(asks: DataFrame, compute, schema: str) -> DataFrame:
    return asks.groupBy("bucket").applyInArrow(compute, schema)


def packed(values: np.ndarray) -> bytes:
    """An array of numbers with many like bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpacked(blob: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def doc_ids(given: pa.Table) -> np.ndarray:
    return given["doc_id"].fill_null(NONE).to_numpy()


def runs(bucket: np.ndarray):
    """(bucket, slice) of each run of equal values in a sorted array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)]):
        if z > a:
            yield int(bucket[a]), slice(a, z)


def found(sorted_keys: np.ndarray, keys: np.ndarray):
    """(position, whether it is there) of each key."""
    at = np.searchsorted(sorted_keys, keys)
    if not len(sorted_keys):
        return at, np.zeros(len(keys), bool)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


def two_least(keys: np.ndarray, doc: np.ndarray, chunk: np.ndarray):
    """Distinct keys with their least document, its chunk, and the least document of any other chunk (NONE: none).

    Each chunk gives a key once, so the second row of a key is another chunk's.
    """
    order = np.lexsort((doc, keys))
    keys, doc, chunk = keys[order], doc[order], chunk[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(keys))
    second = np.full(len(first), NONE)
    more = last - first > 1
    second[more] = doc[first[more] + 1]
    return keys[first], doc[first], chunk[first], second
