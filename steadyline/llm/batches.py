"""Arrow batches in pieces of bounded size, columns carried along."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SLICE_BYTES = 2 << 20
#: for operators that share Python workers with others: workers stay, and keep what their largest slices took
SMALL_SLICE_BYTES = 1 << 18


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts make up about ``limit`` bytes; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    run = (np.cumsum(size) - size) // limit
    cut = np.flatnonzero(np.diff(run)) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        if z > a:
            yield batch.slice(a, z - a)


def with_column(df: DataFrame, text: str, made: dict[str, T.DataType], compute, limit: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``df`` and those of ``made``, which ``compute(texts)`` gives as one array each.

    A column of ``df`` that has the name of a made one is replaced.
    """
    kept = [c for c in df.columns if c not in made or c == text]
    schema = T.StructType([*df.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(n, t) for n, t in made.items()]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                arrays = compute(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*kept, *made])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
