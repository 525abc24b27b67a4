"""Result tables as files with a checksum manifest, and the comparisons that go with them."""

import functools
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steadyline.functions.digests import digest_sums, fingerprint, payload
from steadyline.sources.difference import differing_buckets, digest_tree, rest_of
from steadyline.sources.guards import LINEAGE, assert_finite, assert_unambiguous, lineage, select_allowed, with_lineage
from steadyline.sources.staging import staged

FILE_BYTES = 128 << 20  # what files are cut to, by the mean bytes of a row
WHOLE_BYTES = 512 << 20  # up to here a file is hashed as one value; a larger one has a digest of its rows instead


@dataclass(frozen=True)
class Export:
    df: DataFrame
    allow: list[str]
    partition_by: str | None = None


def publish(
    exports: dict[str, Export], path: str, as_of: str, commit: str, forbidden: list[str] = (),
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write each export, then its manifest.

    Barred columns and ambiguous names are refused before anything is written. Values are checked on the written
    files, which costs a read of their float columns instead of a second computation; without a manifest, a refused
    bundle cannot be read. What each column derives from goes along: in the files, and as a table, because a column that
    names folders is in no file.
    """
    checked = {n: with_lineage(assert_unambiguous(select_allowed(e.df, e.allow, forbidden))) for n, e in exports.items()}
    spark = next(iter(checked.values())).sparkSession
    for name, df in checked.items():
        by = exports[name].partition_by
        # rebalance: even files, also when one partition value holds most rows
        rows = df.hint("rebalance", by) if by else df.hint("rebalance")
        writer = rows.write.option("maxRecordsPerFile", max(1, file_bytes // row_bytes(df)))
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/data/{name}")
        assert_finite(spark.read.parquet(f"{path}/data/{name}"))
    origins = [lineage(df).withColumn("dataset", F.lit(name)) for name, df in checked.items()]
    functools.reduce(DataFrame.unionByName, origins).coalesce(1).write.parquet(f"{path}/lineage")
    provenance = {"as_of": F.lit(as_of).cast("date"), "commit": F.lit(commit)}
    manifest(spark, f"{path}/data").withColumns(provenance).write.parquet(f"{path}/manifest")


def row_bytes(df: DataFrame) -> int:
    """Mean bytes of a row as text, one pass; a stored row is rarely larger."""
    size = F.octet_length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    return max(1, int(df.agg(F.avg(size + 8)).first()[0] or 1))


def manifest(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file, length, sha256, rows_sha256) of each parquet file below ``path``; hashed where the file is read.

    A file above ``whole_bytes`` can't be one value, so it has no ``sha256`` but a ``rows_sha256``, of its rows in any
    order; smaller files have no ``rows_sha256``. A file that can't be read has neither.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_replace("path", f"^.*/{re.escape(folder)}/", "")
    none = F.lit(None).cast("string")
    # the filter on length keeps the contents of larger files unread
    whole = files.filter(F.col("length") <= whole_bytes).select(relative.alias("file"), "length", F.sha2("content", 256).alias("sha256"), none.alias("rows_sha256"))
    large = files.select(relative.alias("file"), "length").filter(F.col("length") > whole_bytes)
    paths = [r["file"] for r in large.select("file").collect()]  # names of files above the bound only; file_bytes keeps them rare
    out = whole
    for name in sorted({_parent(p) for p in paths}):  # files of one folder have one schema
        listed = large.filter(F.col("file").isin([p for p in paths if _parent(p) == name])).withColumn("sha256", none)
        digests = _row_digests(spark, [f"{path.rstrip('/')}/{p}" for p in paths if _parent(p) == name], folder)
        out = out.unionByName(listed.withColumn("rows_sha256", none) if digests is None else listed.join(digests, "file", "left"))
    return out


def _parent(file: str) -> str:
    return file.rsplit("/", 1)[0] if "/" in file else ""


def _row_digests(spark: SparkSession, paths: list[str], folder: str) -> DataFrame | None:
    """(file, rows_sha256) of the files whose rows can be read; None if there is none. One damaged file costs the others a job each."""
    try:
        rows = spark.read.option("ignoreCorruptFiles", True).parquet(*paths)
    except AnalysisException:  # the file that is asked for the columns doesn't tell them
        apart = [_row_digests(spark, [p], folder) for p in paths] if len(paths) > 1 else []
        found = [d for d in apart if d is not None]
        return functools.reduce(DataFrame.unionByName, found) if found else None
    at = F.regexp_replace(F.url_decode("_metadata.file_path"), f"^.*/{re.escape(folder)}/", "").alias("file")
    digests = rows.select(at, F.sha2(payload(*rows.columns), 256).alias("_d")).groupBy("file").agg(F.count("*").alias("_n"), *digest_sums(F.col("_d")))
    text = F.concat_ws("#", F.col("_n").cast("string"), *[F.col(f"part{i}").cast("string") for i in range(4)])
    return digests.select("file", F.sha2(text, 256).alias("rows_sha256"))


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per file: ok, changed, missing or extra. A file that is there but can't be read is changed."""
    def side(df, mark):
        kept = F.struct("length", "sha256", "rows_sha256")
        return df.select("file", kept.alias(mark))

    known = F.coalesce(F.col("a.sha256"), F.col("a.rows_sha256")).isNotNull()
    status = (
        F.when(F.col("a").isNull(), F.lit("missing"))
        .when(F.col("e").isNull(), F.lit("extra"))
        .when(known & (F.col("a") == F.col("e")), F.lit("ok"))
        .otherwise(F.lit("changed"))
    )
    return side(actual, "a").join(side(expected, "e"), "file", "full_outer").select("file", status.alias("status"))


def read_verified(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read one published table; refuse when any of its files differs from the manifest. Other tables are not read."""
    expected = spark.read.parquet(f"{path}/manifest").filter(F.col("file").startswith(f"{name}/"))
    actual = manifest(spark, f"{path}/data/{name}").withColumn("file", F.concat(F.lit(f"{name}/"), "file"))
    bad = verify_manifest(actual, expected).filter("status <> 'ok'")
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"published files do not match the manifest: {first[0]['file']} is {first[0]['status']}")
    table = spark.read.parquet(f"{path}/data/{name}")
    known = spark.read.parquet(f"{path}/lineage").filter(F.col("dataset") == name).collect()  # one row for each column
    marks = {r["column"]: {**table.schema[r["column"]].metadata, LINEAGE: r["origins"]} for r in known}
    return table.withColumns({c: F.col(f"`{c}`").alias(c, metadata=m) for c, m in marks.items()})


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows on each side, rows found on one side only, and whether both hold the same rows.

    Both sides are read once for their digest trees. Equal trees settle it; else only rows of buckets that differ are
    compared, however large the tables.
    """
    rest, counts = [a, b], [df.agg(F.count("*")) for df in (a, b)]
    if a.columns == b.columns:
        trees = [digest_tree(df) for df in (a, b)]
        counts = [of.level(0).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint")) for of in trees]
        buckets = staged(differing_buckets(*trees), "buckets")
        if buckets.isEmpty():
            none = F.lit(0).cast("bigint")
            sides = a.sparkSession.range(1).select(counts[0].scalar().alias("rows_a"), counts[1].scalar().alias("rows_b"))
            return sides.select("rows_a", "rows_b", none.alias("only_a"), none.alias("only_b"), F.lit(True).alias("same"))
        rest = [rest_of(df, of, buckets) for df, of in zip((a, b), trees)]
    only_a, only_b = (x.exceptAll(y).agg(F.count("*").alias("n")).scalar() for x, y in (rest, rest[::-1]))
    counted = a.sparkSession.range(1).select(counts[0].scalar().alias("rows_a"), counts[1].scalar().alias("rows_b"), only_a.alias("only_a"), only_b.alias("only_b"))
    return counted.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two stored fingerprints of one table (see ``functions.digests.fingerprint``)."""
    return before.select(F.col("digest").alias("before")).join(
        after.select(F.col("digest").alias("after")), F.col("before") == F.col("after"), "full_outer"
    ).select((F.col("before").eqNullSafe(F.col("after"))).alias("unchanged"))


def currency(cases: DataFrame, as_of: Column) -> DataFrame:
    """How recent the data is: latest case day next to the as-of day."""
    return cases.agg(F.max("case_day").alias("latest_case_day")).select("latest_case_day", as_of.alias("as_of"))


def append_actions(actions: DataFrame, path: str, batch: str) -> None:
    """Add one batch to the action log, one folder per batch and day so that later reads can prune.

    A batch that is appended again replaces what it wrote before, so a retry neither doubles nor loses rows.
    """
    rows = with_lineage(actions.withColumn("day", F.to_date("ts")))
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


__all__ = [
    "Export", "append_actions", "currency", "fingerprint", "manifest", "publish", "read_verified", "same_content",
    "unchanged", "verify_manifest",
]
