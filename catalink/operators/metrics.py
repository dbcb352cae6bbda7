"""Link quality, ranking quality, precision-recall and ROC curves.

Curves have one point per distinct score. Scores are counted with a map-side combine and summed up
over score ranges, so no task sees all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from catalink.operators.ordered import running_sums

RECALL_LEVELS = (0.01, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3)


def scalar(df: DataFrame):
    """The single value of a one-row, one-column result."""
    return df.first()[0]


def long_metrics(row: DataFrame) -> DataFrame:
    """One-row metrics as (metric, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in row.columns])
    return row.select(F.inline(pairs))


def scored_ranks(ranks: DataFrame, rank: str = "rank", confidence: str = "confidence") -> DataFrame:
    """(label, score): label 1 for rank 0, score as a share of the largest confidence."""
    largest = scalar(ranks.agg(F.max(confidence)))
    return ranks.select(
        F.when(F.col(rank) == 0, 1.0).otherwise(0.0).alias("label"),
        F.round(F.col(confidence) / F.lit(largest), 9).alias("score"))


def curve(scored: DataFrame) -> DataFrame:
    """One row per distinct score: tp, fp, recall, precision, fpr of all rows down to it, and the
    same just above it as recall_before, precision_before, fpr_before."""
    counts = scored.groupBy("score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
    points = running_sums(counts, [F.desc("score")], {"tp": "pos", "taken": "n"})
    all_pos, total = points.agg(F.sum("pos"), F.sum("n")).first()
    all_pos, total = all_pos or 0, total or 0

    def columns(tp: Column, taken: Column, end: str, start: float | None = None) -> list[Column]:
        precision = F.try_divide(tp, taken)
        return [_share(tp, all_pos).alias(f"recall{end}"),
                (precision if start is None else F.coalesce(precision, F.lit(start)))
                .alias(f"precision{end}"),
                _share(taken - tp, total - all_pos).alias(f"fpr{end}")]

    return points.select(
        "score", "tp", (F.col("taken") - F.col("tp")).alias("fp"),
        *columns(F.col("tp"), F.col("taken"), ""),
        *columns(F.col("tp") - F.col("pos"), F.col("taken") - F.col("n"), "_before", 1.0))


def _share(part: Column, whole: int) -> Column:
    return part / F.lit(whole) if whole else F.lit(0.0)


def areas(points: DataFrame) -> DataFrame:
    """(auprc, auroc) of a curve by trapezoids.

    The precision-recall curve starts at (0, 1); the ROC curve starts at (0, 0) and ends
    at (1, 1).
    """
    strips = points.select(
        ((F.col("recall") - F.col("recall_before"))
         * (F.col("precision") + F.col("precision_before")) / 2).alias("pr"),
        ((F.col("fpr") - F.col("fpr_before"))
         * (F.col("recall") + F.col("recall_before")) / 2).alias("roc"),
        "fpr", "recall")
    # The closing strip runs from the last point to (1, 1).
    return strips.agg(
        F.coalesce(F.sum("pr"), F.lit(0.0)).alias("auprc"),
        (F.coalesce(F.sum("roc"), F.lit(0.0))
         + (1 - F.max("fpr")) * (1 + F.max("recall")) / 2).alias("auroc"))


def link_quality(links: DataFrame, rank: str = "rank", confidence: str = "confidence",
                 item: str = "item_id") -> DataFrame:
    """(metric, value) rows describing a set of links."""
    right = F.col(rank) == 0
    counts = links.agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(right).alias("n_right"),
        F.count_if(~right).alias("n_wrong"),
        F.avg(F.when(right, F.col(confidence))).alias("mean_confidence_right"),
        F.avg(F.when(~right, F.col(confidence))).alias("mean_confidence_wrong"),
        F.avg(confidence).alias("mean_confidence"),
        F.try_divide(F.count_if(right).cast("double"), F.count_if(~right)).alias("odds"),
        F.try_divide(F.count_if(right).cast("double"), F.count(F.lit(1))).alias("accuracy"))
    per_item = links.groupBy(item).agg(F.max(right.cast("int")).alias("hit")).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("hit").alias("n_items_right"),
        F.avg("hit").alias("share_items_right"))
    curve_areas = areas(curve(scored_ranks(links, rank, confidence)))
    return reduce(DataFrame.unionByName, map(long_metrics, (counts, per_item, curve_areas)))


def ranking_quality(ranks: DataFrame, rank: str = "rank", confidence: str = "confidence",
                    levels: tuple[float, ...] = RECALL_LEVELS) -> DataFrame:
    """(metric, value): exact matches, recall within a share of the results, confidence stats."""
    total = scalar(ranks.agg(F.count(F.lit(1))))
    right = F.col(rank) == 0
    row = ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("n_exact"),
        F.coalesce(F.avg(F.when(right, F.col(confidence))), F.lit(0.0)).alias("mean_right"),
        F.coalesce(F.avg(F.when(~right, F.col(confidence))), F.lit(0.0)).alias("mean_wrong"),
        *mean_and_deviation(F.col(confidence)),
        *[F.count_if(F.col(rank) <= F.lit(level * total)).alias(f"within_{level:g}")
          for level in levels],
        *[F.try_divide(F.count_if(F.col(rank) <= F.lit(level * total)).cast("double"),
                       F.count(F.lit(1))).alias(f"recall_{level:g}") for level in levels])
    return long_metrics(row)


def mean_and_deviation(value: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation, both 0 over no rows."""
    return (F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("stddev"))


def accepted(links: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    """Links whose confidence, as a share of the largest, is strictly above ``threshold``."""
    largest = scalar(links.agg(F.max(confidence)))
    return links.where(F.round(F.col(confidence) / F.lit(largest), 9) > threshold)


def acceptance_summary(links: DataFrame, threshold: float, rank: str = "rank",
                       confidence: str = "confidence") -> DataFrame:
    """One row: right and wrong among the accepted and among all links, with accuracies."""
    largest = scalar(links.agg(F.max(confidence)))
    taken = F.round(F.col(confidence) / F.lit(largest), 9) > threshold
    right = F.col(rank) == 0
    return links.agg(
        F.count_if(taken & right).alias("taken_right"),
        F.count_if(taken & ~right).alias("taken_wrong"),
        F.count_if(right).alias("all_right"),
        F.count_if(~right).alias("all_wrong"),
        F.try_divide(F.count_if(taken & right).cast("double"), F.count_if(taken))
        .alias("taken_accuracy"),
        F.try_divide(F.count_if(right).cast("double"), F.count(F.lit(1))).alias("all_accuracy"))


def fan_out(links: DataFrame, key: str) -> DataFrame:
    """(n_links, n_keys): how many keys hold how many links."""
    sizes = links.groupBy(key).agg(F.count(F.lit(1)).alias("n_links"))
    return sizes.groupBy("n_links").agg(F.count(F.lit(1)).alias("n_keys"))


def class_balance(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def lowest_threshold(links: DataFrame, goal: float, rank: str = "rank",
                     confidence: str = "confidence") -> DataFrame:
    """One row: the lowest confidence whose links from it upwards reach ``goal`` precision,
    with the number of links it keeps; null when none does."""
    reached = curve(scored_ranks(links, rank, confidence)).where(F.col("precision") >= goal)
    largest = scalar(links.agg(F.max(confidence)))
    return reached.agg((F.min("score") * F.lit(largest)).alias("threshold"),
                       F.max(F.col("tp") + F.col("fp")).alias("n_kept"))
