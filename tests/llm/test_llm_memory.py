"""What the pipeline's Python operators hold at a time: a worker serves all stages, and keeps what its largest slice took."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from steadyline.llm import decontamination, quality, similar

TEXT = " ".join(f"word{i % 61} of{i % 7}" for i in range(450))
ROWS = 200  # about 1 MB
COUNTED = pa.proxy_memory_pool(pa.default_memory_pool())  # outlives what is allocated in it


def _docs(spark):
    return spark.createDataFrame([(0, "a b")], "doc_id bigint, text string")


def _slices(spark, monkeypatch, made) -> int:
    """Slices into which the operator that ``made(docs)`` puts first cuts one Arrow batch of about 1 MB."""
    docs, runs = _docs(spark), []
    kind = type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **b: (runs.append((run, self.columns)), real(self, run, *a, **b))[1])
    made(docs)
    (run, columns), *_ = runs
    batch = pa.RecordBatch.from_pydict({c: pa.array([TEXT] * ROWS if c == "text" else range(ROWS)) for c in columns})
    assert 900_000 < batch.column("text").nbytes < 1_100_000
    return len(list(run([batch])))


KEYED = "0L k1", "0L k2", "doc_id", "text"
OPERATORS = {
    "scored": lambda docs: quality.scored(docs, np.zeros((1 << 18) + 1)),
    "with_node": lambda docs: similar._with_node(docs, 5),
    "shingles": lambda docs: similar._shingles(docs, 5),
    "item_windows": lambda docs: decontamination._item_windows(docs.selectExpr("doc_id item_id", "text"), 13),
    "doc_prints": lambda docs: decontamination._doc_prints(docs.selectExpr(*KEYED), [13]),
    "counted": lambda docs: decontamination._counted(docs.selectExpr(*KEYED)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_batch_is_worked_on_in_small_slices(spark, monkeypatch, name):
    assert _slices(spark, monkeypatch, OPERATORS[name]) >= 4


def test_the_pipeline_encodes_in_smaller_ones(spark, monkeypatch):
    # two samples of each slice
    assert _slices(spark, monkeypatch, lambda docs: corpus_pipeline.encode(spark, docs, "")) >= 2 * 14


def test_a_shard_is_followed_in_order_without_a_copy(spark, monkeypatch):
    docs = _docs(spark)
    kind, made = type(docs.groupBy("doc_id")), []
    real = kind.applyInArrow
    monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema: (made.append(f), real(self, f, schema))[1])
    quality.fitted(docs, spark.createDataFrame([(0, 1)], "doc_id bigint, quality int"), quality.Settings(rounds=1))
    local, rng, n, m = made[0], np.random.default_rng(1), 200, 20_000
    feature = np.concatenate([rng.choice(1 << 18, m, replace=False) for _ in range(n)]).astype(np.int32)
    start = pa.array(np.arange(n + 1) * m, pa.int32())
    given = pa.table({
        "doc_id": pa.array(rng.permutation(n)), "label": pa.array(rng.integers(0, 2, n).astype(np.int32)),
        "feature": pa.ListArray.from_arrays(start, pa.array(feature)), "value": pa.ListArray.from_arrays(start, pa.array(rng.random(n * m, np.float32))),
    })
    given = pa.concat_tables([given[: n // 3], given[n // 3 :]])
    ordered = local(given.sort_by("doc_id").combine_chunks())
    usual = pa.default_memory_pool()
    pa.set_memory_pool(COUNTED)
    try:
        found = local(given)
    finally:
        pa.set_memory_pool(usual)
    assert found.equals(ordered)
    assert COUNTED.max_memory() < given.nbytes / 2
