"""Exact ranking metrics. Input rows: strategy, row_id (unique), score, label (0/1).

Rows are counted per distinct score first; prefix sums then run over range-split chunks, never over one global window.
"""

from pyspark.sql import DataFrame, functions as F

from steadyline.functions.ordered import Ordered
from steadyline.operators.selection import among_strongest, cut_points


def by_strategy(scored: DataFrame, strategies: list[str]) -> DataFrame:
    wide = scored.select("row_id", "label", *[F.col(s).cast("double").alias(s) for s in strategies])
    return wide.unpivot(["row_id", "label"], strategies, "strategy", "score")


def _totals(ranked: DataFrame) -> DataFrame:
    """One row per strategy, so its size is the number of strategies compared and it may be broadcast."""
    return ranked.groupBy("strategy").agg(F.sum("label").alias("_pos"), F.count("*").alias("_all"))


def sweep(ranked: DataFrame) -> DataFrame:
    """One row per strategy and threshold: what flagging every score at or above it would give."""
    groups = ranked.groupBy("strategy", "score").agg(
        F.sum("label").alias("positives"), F.count("*").alias("rows")
    )
    run = Ordered(groups, ["strategy"], [F.desc("score")], "sweep")
    cumulated = run.running_sums({"hits": "positives", "flagged": "rows"})
    precision = F.col("hits") / F.col("flagged")
    recall = F.when(F.col("_pos") > 0, F.col("hits") / F.col("_pos"))
    f1 = F.when(F.col("flagged") + F.col("_pos") > 0, 2 * F.col("hits") / (F.col("flagged") + F.col("_pos")))
    return cumulated.join(F.broadcast(_totals(ranked)), "strategy").select(
        "strategy",
        F.col("score").alias("threshold"),
        "positives",
        "rows",
        "hits",
        "flagged",
        F.col("_pos").alias("all_positives"),
        F.col("_all").alias("all_rows"),
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(f1, 6).alias("f1"),
        F.round(F.col("flagged") / F.col("_all"), 6).alias("flag_rate"),
    )


def roc_auc(swept: DataFrame) -> DataFrame:
    """Share of positive/negative pairs in the right order, ties counted half; NULL with only one class."""
    exact = "decimal(38,0)"
    negatives = (F.col("rows") - F.col("positives")).cast(exact)
    twice_right = negatives * (2 * F.col("hits") - F.col("positives")).cast("decimal(20,0)")
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return (
        swept.groupBy("strategy")
        .agg(
            F.sum(twice_right.cast(exact)).cast("double").alias("s"),
            F.max("all_positives").cast("double").alias("p"),
            F.max("all_rows").cast("double").alias("n"),
        )
        .select("strategy", F.round(F.when(pairs > 0, F.col("s") / (2 * pairs)), 6).alias("auc"))
    )


def average_precision(swept: DataFrame) -> DataFrame:
    """Precision at each threshold weighted by the recall gained there (a step sum, not a trapezoid)."""
    gain = F.col("positives") / F.col("all_positives") * (F.col("hits") / F.col("flagged"))
    return swept.groupBy("strategy").agg(F.round(F.sum(F.when(F.col("all_positives") > 0, gain)), 6).alias("average_precision"))


def precision_at(ranked: DataFrame, percents: list[int]) -> DataFrame:
    """Precision among the strongest ceil(p % of all rows), ties broken by row_id. Rows are neither sorted nor shuffled."""
    totals = _totals(ranked).select("strategy", F.col("_all").alias("_n"))
    cut = {p: F.floor((p * F.col("_n") + 99) / 100).cast("bigint") for p in percents}
    limits = totals.select("strategy", F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), k.alias("k")) for p, k in cut.items()])).alias("c")).select("strategy", "c.*")
    points = cut_points(ranked, limits, "strategy", "score", "row_id").withColumnsRenamed({"score": "_s", "row_id": "_t"})
    # one row for each strategy with all of its cuts
    placed = limits.join(points, ["strategy", "k"]).groupBy("strategy").agg(
        *[F.max(F.when(F.col("percent") == p, F.struct("k", "_s", "_t"))).alias(f"c{p}") for p in percents]
    )
    within = {p: among_strongest("score", "row_id", f"c{p}._s", f"c{p}._t") for p in percents}
    sums = ranked.join(F.broadcast(placed), "strategy").groupBy("strategy").agg(*[
        F.struct(F.lit(p).alias("percent"), F.max(f"c{p}.k").alias("k"), F.coalesce(F.sum(F.when(within[p], F.col("label"))), F.lit(0)).alias("hits")).alias(f"h{p}")
        for p in percents
    ])
    cuts = sums.select("strategy", F.explode(F.array(*[F.col(f"h{p}") for p in percents])).alias("c")).select("strategy", "c.*")
    return cuts.withColumn("precision", F.round(F.col("hits") / F.col("k"), 6))


def compare(at: DataFrame, percents: list[int]) -> DataFrame:
    """Strategies as rows, review capacities as columns."""
    table = at.groupBy("strategy").pivot("percent", percents).agg(F.first("precision"))
    return table.select("strategy", *[F.col(str(p)).alias(f"top_{p}") for p in percents])


def f1_at(ranked: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Precision, recall and F1 when flagging scores at or above each strategy's threshold; one aggregation."""
    cut = F.lit(None).cast("double")
    for strategy, value in thresholds.items():
        cut = F.when(F.col("strategy") == strategy, F.lit(float(value))).otherwise(cut)
    counts = (
        ranked.withColumn("threshold", cut)
        .filter(F.col("threshold").isNotNull())
        .groupBy("strategy", "threshold")
        .agg(
            F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 1)).alias("tp"),
            F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 0)).alias("fp"),
            F.count_if((F.col("score") < F.col("threshold")) & (F.col("label") == 1)).alias("fn"),
        )
    )

    def share(top, bottom):
        return F.round(F.when(bottom > 0, top / bottom), 6)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}
    )


def select_threshold(swept: DataFrame, floor: float) -> DataFrame:
    """All candidates with ``meets_floor``, and the chosen one: highest recall at or above the precision floor.

    Call it with the sweep of the validation window, the one closest to use.
    """
    meets = F.col("precision") >= floor
    best = (
        swept.filter(meets).groupBy("strategy").agg(F.max(F.struct("recall", "threshold")).alias("_best"))
    )
    return swept.join(best, "strategy", "left").select(
        "strategy",
        "threshold",
        "precision",
        "recall",
        "flag_rate",
        meets.alias("meets_floor"),
        F.coalesce(F.col("_best.threshold") == F.col("threshold"), F.lit(False)).alias("chosen"),
    )
