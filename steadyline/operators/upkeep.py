"""Quality summaries kept beside a partitioned table, so that a check after new data reads the new data only.

A summary is one row for each partition value: counts that add up (rows, values present, values that break a rule) and
ends that combine (least and greatest). It also holds a digest of the partition's files by name, length and time, so a
partition that gained, lost or rewrote a file is summarised anew, and no other one is read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyline.sources.staging import new_location

FILES = "files"


def _listed(table: DataFrame, by: str) -> DataFrame:
    """(by, files): a digest of each partition's files; no column of the data is read for it."""
    # the partition's value is carried as it is, so that a NULL partition is one too
    files = table.select(by, F.concat_ws("|", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("_f")).distinct()
    return files.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("_f", 256))), ","), 256).alias(FILES))


def summarised(table: DataFrame, by: str, columns: list[str], rules: dict[str, Column]) -> DataFrame:
    """One pass: per partition the rows, of each column the values present with their ends, of each rule the rows that break it."""
    parts = [F.count("*").alias("rows")]
    for c in columns:
        parts += [F.count(c).alias(f"present_{c}"), F.min(c).alias(f"least_{c}"), F.max(c).alias(f"greatest_{c}")]
    # a rule that a NULL leaves open is not broken
    parts += [F.count_if(F.coalesce(~holds, F.lit(False))).alias(f"broken_{name}") for name, holds in rules.items()]
    return table.groupBy(by).agg(*parts)


def refreshed(
    spark: SparkSession, path: str, by: str, columns: list[str], rules: dict[str, Column], known: DataFrame | None = None
) -> DataFrame:
    """Summaries of the table at ``path`` (Parquet, partitioned by ``by``), as a table, with ``read``: whether the partition was read for them.

    ``known``: what an earlier call with the same columns and rules gave. Partitions that are gone are dropped. The values
    of partitions to be read come to the driver, so that all others are pruned from the scan.
    """
    table = spark.read.parquet(path)
    listed = _listed(table, by).withColumnRenamed(by, "_by")
    if known is None:
        stale, kept = listed, None
    else:
        same = listed["_by"].eqNullSafe(known[by]) & (listed[FILES] == known[FILES])
        stale, kept = listed.join(known, same, "left_anti"), known.join(listed, same, "left_semi").withColumn("read", F.lit(False))
    values = [r["_by"] for r in stale.select("_by").collect()]
    wanted = F.col(by).isin([v for v in values if v is not None])
    fresh = summarised(table.where(wanted | F.col(by).isNull() if None in values else wanted), by, columns, rules)
    fresh = fresh.join(stale, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("read", F.lit(True))
    out = new_location(spark, "summaries")
    (fresh if kept is None else kept.select(fresh.columns).unionByName(fresh)).write.parquet(out)
    return spark.read.parquet(out)


def total(summaries: DataFrame, columns: list[str], rules: list[str]) -> DataFrame:
    """(check, column, rows, findings) of the whole table from its summaries: values missing, and rows that break a rule."""
    missing = [F.struct(F.lit("missing").alias("check"), F.lit(c).alias("of"), F.sum(F.col("rows") - F.col(f"present_{c}")).alias("findings")) for c in columns]
    broken = [F.struct(F.lit("rule").alias("check"), F.lit(r).alias("of"), F.sum(f"broken_{r}").alias("findings")) for r in rules]
    one = summaries.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.array(*missing, *broken).alias("_all"))
    return one.select("rows", F.explode("_all").alias("_c")).select("_c.check", "_c.of", "rows", F.coalesce("_c.findings", F.lit(0)).alias("findings"))
