"""Views limited by role, purpose and group scope, and removal of identities.

``accounts`` columns: account_id, role, purposes array<string>, groups array<int>. Joins are left to Spark's
own size checks: a small account side is broadcast, a large one is not.
"""

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F


def pseudonym(column: str, key: str) -> Column:
    """A keyed digest. The ids are few enough to try them all, so the key alone protects them: keep it out of code and data."""
    inner = F.sha2(F.concat_ws("#", F.lit(key), F.col(column).cast("string")), 256)
    return F.sha2(F.concat_ws("#", F.lit(key), inner), 256)


def pseudonymise(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, pseudonym(column, key))


def scope_of(accounts: DataFrame, account_id: str, matrix: DataFrame, purpose: str) -> DataFrame:
    """Groups that an account may see for a purpose: it has to hold the purpose, and its role to allow it.

    ``matrix``: the (role, purpose) pairs that may be.
    """
    own = accounts.filter(F.col("account_id") == account_id).filter(F.array_contains("purposes", purpose))
    allowed = matrix.filter(F.col("purpose") == purpose).select("role")
    return own.join(allowed, "role", "left_semi").select(F.explode("groups").alias("group_id")).distinct()


def authorised(df: DataFrame, account_id: str, accounts: DataFrame, matrix: DataFrame, purpose: str) -> DataFrame:
    """Rows of the groups in the account's scope."""
    return df.join(scope_of(accounts, account_id, matrix, purpose), "group_id", "left_semi")


def reidentify(
    df: DataFrame, identities: DataFrame, account_id: str, accounts: DataFrame, matrix: DataFrame, purpose: str
) -> DataFrame:
    """Put identities back, only on rows that the account may see."""
    return authorised(df, account_id, accounts, matrix, purpose).join(identities, "pseudonym")


def strip_ids(df: DataFrame, id_columns: list[str]) -> DataFrame:
    return df.drop(*id_columns)


def effective_purpose(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """A declared purpose counts only if the stored account holds it; declaring never widens reach."""
    held = F.coalesce(F.array_contains("purposes", F.col("declared")), F.lit(False))
    return requests.join(accounts.select("account_id", "purposes"), "account_id", "left").select(
        *requests.columns,
        F.when(held, F.col("declared")).alias("effective"),
        F.when(held, F.lit("granted")).otherwise(F.lit("refused")).alias("outcome"),
    )


def lookup(requests: DataFrame, scoped: DataFrame) -> DataFrame:
    """Join against the *already scoped* rows: out of scope and nonexistent give the same answer."""
    hit = scoped.select("entity_id", F.lit(True).alias("_hit")).distinct()
    return requests.join(hit, "entity_id", "left").select(
        *requests.columns, F.when(F.col("_hit"), F.lit("found")).otherwise(F.lit("not_found")).alias("answer")
    )


# shapes of identifiers in free text: pattern, replacement, and lower-case texts of which every match contains one; a row
# whose lower-cased text has none is passed over without running the pattern. Dates stay, as they tell when and not who: the first two steps
# take their hyphens out of the reach of the number pattern, the last two put them back.
_YEAR, _MONTH, _DAY = "((?:19|20)[0-9]{2})", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
_HELD = "\ue000"
REDACTIONS = [
    (rf"\b{_YEAR}-{_MONTH}-{_DAY}\b", f"$1{_HELD}$2{_HELD}$3", ["-"]),
    (rf"\b{_DAY}-{_MONTH}-{_YEAR}\b", f"$1{_HELD}$2{_HELD}$3", ["-"]),
    # the look-behind keeps the search from starting again inside each word
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]", ["@"]),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[ip]", ["."]),
    (r"(?i)\bauthorization\s*:\s*(basic|bearer)\s+[A-Za-z0-9._~+/=-]+", "[secret]", ["authorization"]),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}", "[secret]", ["bearer"]),
    (r"(?i)\b(token|secret|password|passwd|pwd|(api|access|secret)[-_ ]?key)\b[\"']?\s*[=:]\s*[\"']?[^\s\"',;]+[\"']?", "[secret]", ["token", "secret", "passw", "pwd", "key"]),
    (r"\b(AKIA|ASIA)[A-Z0-9]{16}\b", "[secret]", ["akia", "asia"]),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "[secret]", ["eyj"]),
    (r"\b(gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})", "[secret]", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-"]),
    (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[number]", ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9"]),
    (f"{_YEAR}{_HELD}{_MONTH}{_HELD}{_DAY}", "$1-$2-$3", [_HELD]),
    (f"{_DAY}{_HELD}{_MONTH}{_HELD}{_YEAR}", "$1-$2-$3", [_HELD]),
]


def redact(df: DataFrame, column: str, patterns: list[tuple[str, str, list[str]]] = REDACTIONS) -> DataFrame:
    """Each pattern's matches replaced, in order. A pattern runs only on rows that hold what all of its matches hold."""
    rows = df.withColumn("_low", F.lower(F.col(column)))
    for pattern, replacement, needs in patterns:
        # what a pattern looks for is no part of an earlier replacement, but for the mark that holds dates
        seen = F.col(column if needs == [_HELD] else "_low")
        hit = functools.reduce(operator.or_, [seen.contains(n) for n in needs])
        rows = rows.withColumn(column, F.when(hit, F.regexp_replace(F.col(column), pattern, replacement)).otherwise(F.col(column)))
    return rows.drop("_low")


def filter_queue(
    queue: DataFrame,
    search: str | None = None,
    groups: list[int] | None = None,
    levels: list[str] | None = None,
    states: list[str] | None = None,
    changes: list[str] | None = None,
    first: str | None = None,
    last: str | None = None,
) -> DataFrame:
    """Queue rows by search text, group, level, state, change and case day; unset filters do nothing."""
    if search is not None:
        queue = queue.filter(F.col("case_id").contains(search) | F.col("entity_id").cast("string").contains(search))
    for column, wanted in (("group_id", groups), ("level", levels), ("state", states), ("trend", changes)):
        if wanted is not None:
            queue = queue.filter(F.col(column).isin(wanted))
    if first is not None:
        queue = queue.filter(F.col("case_day") >= F.lit(first).cast("date"))
    if last is not None:
        queue = queue.filter(F.col("case_day") <= F.lit(last).cast("date"))
    return queue


def directory(roster: DataFrame, account_id: str, accounts: DataFrame, matrix: DataFrame, purpose: str) -> DataFrame:
    return authorised(roster, account_id, accounts, matrix, purpose).select("entity_id", "group_id")


def role_matrix(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(pairs, "role string, purpose string")


def invalid_accounts(accounts: DataFrame, matrix: DataFrame) -> DataFrame:
    """Role and purpose pairs that the matrix does not allow."""
    pairs = accounts.select("account_id", "role", F.explode("purposes").alias("purpose"))
    return pairs.join(matrix, ["role", "purpose"], "left_anti").select("account_id", "role", "purpose")


def enforce_aggregate_only(df: DataFrame, purpose: str, person_columns: tuple[str, ...] = ("entity_id", "case_id")):
    """For the aggregate purpose: no individual rows, and no individual columns in the schema either."""
    if purpose != "aggregate":
        return df
    return df.drop(*[c for c in person_columns if c in df.columns]).filter(F.lit(False))


def search_groups(groups: DataFrame, text: str) -> DataFrame:
    """Aggregate search: names of groups only; no individual table is read."""
    return groups.filter(F.col("group_name").contains(text)).select("group_id", "group_name")


def scope_counts(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows visible per account. Counted per group first, so the join sees groups, not rows."""
    per_group = df.groupBy("group_id").agg(F.count("*").alias("_n"))
    scope = accounts.select("account_id", F.explode_outer("groups").alias("group_id"))
    return (
        scope.join(per_group, "group_id", "left")
        .groupBy("account_id")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("visible"))
    )
