"""Quality of predictions (subject_id, y, p).

Curves work on distinct scores: equal scores collapse by partial aggregation first,
and the cumulative counts come from range partitions, not from one sorted task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.ordering import running_totals

SMOOTH = 1e-5
BCE_CLIP = 1e-4


def confusion(df: DataFrame) -> DataFrame:
    """Counts by observed class and half-even rounded score."""
    return df.groupBy(F.col("y").cast("int").alias("y"), F.rint("p").cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _hits(predicted: Column) -> dict[str, Column]:
    y = F.col("y")
    return {
        "tp": F.count_if((y == 1) & (predicted == 1)),
        "fp": F.count_if((y == 0) & (predicted == 1)),
        "tn": F.count_if((y == 0) & (predicted == 0)),
        "fn": F.count_if((y == 1) & (predicted == 0)),
    }


def classification_metrics(df: DataFrame) -> DataFrame:
    """Sensitivity, specificity, F1 and accuracy at rint(p)."""
    counts = df.agg(*[c.alias(n) for n, c in _hits(F.rint("p")).items()])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def smoothed_metrics(df: DataFrame) -> DataFrame:
    """Sensitivity and specificity with a small constant in the denominator, scores clipped to [0, 1]."""
    p = F.rint(F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0)))
    y = F.col("y")
    sums = df.agg(
        F.sum(y * p).alias("tp"), F.sum(y).alias("pos"),
        F.sum((1 - y) * (1 - p)).alias("tn"), F.sum(1 - y).alias("neg"),
    )
    return sums.select(
        (F.col("tp") / (F.col("pos") + SMOOTH)).alias("sensitivity"),
        (F.col("tn") / (F.col("neg") + SMOOTH)).alias("specificity"),
    )


def score_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at or above every distinct score, with the group totals."""
    by = list(by)
    scores = df.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    running = running_totals(scores, [F.desc("p")], {"tp": F.col("pos"), "fp": F.col("neg")}, by=by)
    totals = scores.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if by:
        return running.join(totals, by)
    # A plain number below 2^31 would become an int, whose products overflow.
    n_pos, n_neg = (F.lit(n or 0).cast("long") for n in totals.first())
    return running.withColumn("n_pos", n_pos).withColumn("n_neg", n_neg)


def roc_curve(df: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct threshold."""
    return score_counts(df).select(
        F.col("p").alias("threshold"),
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
    )


def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve: the share of ordered pairs, ties counting half. Null for one class."""
    # Positives at a score beat the negatives strictly below it.
    beaten = F.col("pos") * (F.col("n_neg") - F.col("fp") + F.col("neg") / 2)
    pairs = F.max("n_pos").cast("double") * F.max("n_neg")
    counts = score_counts(df, by)
    grouped = counts.groupBy(*by) if by else counts.groupBy()
    return grouped.agg(F.try_divide(F.sum(beaten), pairs).alias("auc"))


def youden_threshold(df: DataFrame) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on a tie."""
    gain = F.col("tpr") - F.col("fpr")
    return (
        roc_curve(df)
        .agg(F.max(F.struct(gain.alias("gain"), "threshold")).alias("b"))
        .select("b.threshold", "b.gain")
    )


def pr_curve(df: DataFrame) -> DataFrame:
    """Precision and recall at every distinct threshold, with each step's part of the average precision."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return score_counts(df).select(
        F.col("p").alias("threshold"),
        precision.alias("precision"),
        F.try_divide("tp", "n_pos").alias("recall"),
        F.try_divide(precision * F.col("pos"), F.col("n_pos")).alias("ap_step"),
    )


def average_precision(df: DataFrame) -> DataFrame:
    return pr_curve(df).agg(F.sum("ap_step").alias("average_precision"))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    flagged = F.rint("p").cast("int")
    rows = df.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), F.col("y").cast("int").alias("y"), flagged.alias("f")
    )
    is_y, is_f = F.col("y") == F.col("label"), F.col("f") == F.col("label")
    counts = rows.groupBy("label").agg(
        F.count_if(is_y & is_f).alias("tp"), F.count_if(is_f).alias("called"), F.count_if(is_y).alias("support")
    )
    return counts.select(
        "label",
        F.try_divide("tp", "called").alias("precision"),
        F.try_divide("tp", "support").alias("recall"),
        F.try_divide(2 * F.col("tp"), F.col("called") + F.col("support")).alias("f1"),
        "support",
    )


def regression_metrics(df: DataFrame) -> DataFrame:
    """Mean squared error, explained variance and R2."""
    e = F.col("y") - F.col("p")
    stats = df.agg(F.avg(e * e).alias("mse"), F.var_pop(e).alias("ve"), F.var_pop("y").alias("vy"))
    return stats.select(
        "mse",
        (1 - F.try_divide("ve", "vy")).alias("explained_variance"),
        (1 - F.try_divide("mse", "vy")).alias("r2"),
    )


def bce_term(y: Column, p: Column, positive_weight: float) -> Column:
    """Weighted cross-entropy of one row; label and score are clipped to [1e-4, 1]."""

    def clip(c: Column) -> Column:
        return F.least(F.greatest(c.cast("double"), F.lit(BCE_CLIP)), F.lit(1.0))

    y, p = clip(y), clip(p)
    return -(y * F.log(p + BCE_CLIP) * positive_weight) - (1 - y) * F.log(1 - p + BCE_CLIP)


def weighted_bce(df: DataFrame, positive_weight: float = 1.0) -> DataFrame:
    return df.agg(F.avg(bce_term(F.col("y"), F.col("p"), positive_weight)).alias("loss"))


def mse(df: DataFrame) -> DataFrame:
    e = F.col("y") - F.col("p")
    return df.agg(F.avg(e * e).alias("loss"))
