"""Checks that run before anything is scored. Each is one pass over the table, pre-aggregated per task."""

from pyspark.sql import Column, DataFrame, functions as F


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Present and missing values per column."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["rows"], columns, "column", "present").withColumn("missing", F.col("rows") - F.col("present"))


def range_check(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside closed bounds per column. A missing value is not a range error."""
    counts = df.agg(*[F.count_if(~F.col(c).between(low, high)).alias(c) for c, (low, high) in bounds.items()])
    return counts.unpivot([], list(bounds), "rule", "n").withColumn("rule", F.concat(F.lit("range_"), "rule"))


def plausibility(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that break a row rule. ``rules`` states in SQL what must hold; NULL means not judged."""
    counts = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Surplus rows beyond the first per key."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n")).select(
        F.lit("duplicate_key").alias("rule"), "n"
    )


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference has no parent. Counted per reference first, so a frequent reference is one row in the join."""
    references = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    missing = references.join(parents, F.col(column) == F.col(parent_key), "left_anti")
    return missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n")).select(
        F.lit(f"orphan_{column}").alias("rule"), "n"
    )


def consistency(df: DataFrame, key: list[str], references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    out = duplicate_keys(df, key)
    for column, parents, parent_key in references:
        out = out.unionByName(orphans(df, column, parents, parent_key))
    return out


def quality_summary(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings per severity. Rules without findings count as zero, so a clean result is stated, not silent."""
    joined = rules.join(findings, "rule", "left")
    return joined.groupBy("severity").agg(
        F.count("*").alias("rules"),
        F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("failing"),
        F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("findings"),
    )


def gate(df: DataFrame, key: list[str], error: Column) -> DataFrame:
    """Rows fit for scoring: the key is whole and unique, and no row of that key is in error. A NULL in the key is an error."""
    whole = df.filter(" and ".join(f"`{c}` is not null" for c in key))
    bad = (
        whole.groupBy(*key)
        .agg(F.count("*").alias("_n"), F.count_if(error).alias("_errors"))
        .filter((F.col("_n") > 1) | (F.col("_errors") > 0))
    )
    return whole.join(bad.select(*key), key, "left_anti")
