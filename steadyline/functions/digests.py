"""Canonical payload text, its digest, and an order-free fingerprint of a table."""

from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = "#"
NULL_MARK = "\\N"


def payload(*columns: str) -> Column:
    """Fields joined with a separator. Escaping keeps different field lists from giving the same text."""
    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        text = F.replace(text, F.lit(SEPARATOR), F.lit("\\" + SEPARATOR))
        return F.coalesce(text, F.lit(NULL_MARK))

    return F.concat_ws(SEPARATOR, *[field(c) for c in columns])


def digest_sums(digest: Column) -> list[Column]:
    """Four sums over 15-hex-digit parts of a SHA-256 digest. Sums merge in any order, so they pre-aggregate."""
    return [
        F.coalesce(F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0))
        .cast("decimal(38,0)")
        .alias(f"part{i}")
        for i in range(4)
    ]


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (rows, digest) that is equal for equal multisets of rows, however they are laid out."""
    columns = columns or df.columns
    sums = df.select(F.sha2(payload(*columns), 256).alias("_d")).agg(
        F.count("*").alias("rows"), *digest_sums(F.col("_d"))
    )
    parts = [F.col(f"part{i}").cast("string") for i in range(4)]
    return sums.select("rows", F.sha2(F.concat_ws(SEPARATOR, F.col("rows").cast("string"), *parts), 256).alias("digest"))
