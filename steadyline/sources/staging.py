"""Intermediate tables in the shared checkpoint folder.

A staged table cuts the lineage and fixes row placement, so a lost executor costs a re-read, not a
recomputation, and a chunk number taken once stays the same for every later reader.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from steadyline.sources.guards import with_lineage


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    already_set = context.getCheckpointDir()
    if already_set:
        return already_set
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="steadyline-"))
    return context.getCheckpointDir()


def new_location(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back. Its columns keep what they derive from (see ``guards.with_lineage``)."""
    spark, df = df.sparkSession, with_lineage(df)
    path = new_location(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
