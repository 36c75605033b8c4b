"""Metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import metrics as m
from locusframe.plans.registry import query, r9, sql9
from locusframe.plans.views import Views


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*[F.col(c) if c in exact else r9(c).alias(c) for c in df.columns])


COUNTS = """
    k AS (SELECT CAST(count(*) FILTER (y = 1 AND round_even(p, 0) = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND round_even(p, 0) = 1) AS DOUBLE) AS fp,
                 CAST(count(*) FILTER (y = 0 AND round_even(p, 0) = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 1 AND round_even(p, 0) = 0) AS DOUBLE) AS fn FROM prediction)"""
CURVE = """
    s AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM prediction GROUP BY p),
    c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
                 sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s)"""


@query("prediction", "SELECT y, CAST(round_even(p, 0) AS INT) AS predicted, count(*) AS n FROM prediction GROUP BY 1, 2")
def confusion(v: Views) -> DataFrame:
    return m.confusion(v.prediction)


@query("prediction", f"WITH {CURVE} SELECT p AS threshold, {sql9('fp / nn')} AS fpr, {sql9('tp / np')} AS tpr FROM c")
def roc_curve(v: Views) -> DataFrame:
    return rounded(m.roc_curve(v.prediction), "threshold")


@query("prediction", f"""
    WITH r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS r FROM prediction),
    s AS (SELECT sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM r)
    SELECT {sql9('(s - np * (np + 1) / 2.0e0) / (np * nn)')} AS auc FROM s""")
def auc(v: Views) -> DataFrame:
    return rounded(m.auc(v.prediction))


@query("prediction", f"""WITH {COUNTS}
    SELECT {sql9('tp / (tp + fn)')} AS sensitivity, {sql9('tn / (tn + fp)')} AS specificity, {sql9('2 * tp / (2 * tp + fp + fn)')} AS f1,
           {sql9('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy FROM k""")
def classification_metrics(v: Views) -> DataFrame:
    return rounded(m.classification_metrics(v.prediction))


@query("prediction", f"WITH {COUNTS} SELECT {sql9('tp / (tp + fn + 1e-5)')} AS sensitivity, {sql9('tn / (tn + fp + 1e-5)')} AS specificity FROM k")
def smoothed_metrics(v: Views) -> DataFrame:
    return rounded(m.smoothed_metrics(v.prediction))


@query("prediction", f"""WITH {CURVE}
    SELECT p AS threshold, {sql9('tp / np - fp / nn')} AS gain FROM c ORDER BY tp / np - fp / nn DESC, p DESC LIMIT 1""")
def youden_threshold(v: Views) -> DataFrame:
    return rounded(m.youden_threshold(v.prediction), "threshold")


@query("prediction", f"""WITH {CURVE} SELECT p AS threshold, {sql9('tp / (tp + fp)')} AS precision, {sql9('tp / np')} AS recall FROM c""")
def pr_curve(v: Views) -> DataFrame:
    return rounded(m.pr_curve(v.prediction).drop("ap_step"), "threshold")


@query("prediction", f"WITH {CURVE} SELECT {sql9('sum(tp / (tp + fp) * pos / np)')} AS average_precision FROM c")
def average_precision(v: Views) -> DataFrame:
    return rounded(m.average_precision(v.prediction))


@query("prediction", f"""
    WITH l AS (SELECT unnest([0, 1]) AS label, y, CAST(round_even(p, 0) AS INT) AS f FROM prediction),
    k AS (SELECT label, count(*) FILTER (y = label AND f = label) AS tp, count(*) FILTER (f = label) AS called, count(*) FILTER (y = label) AS support
          FROM l GROUP BY label)
    SELECT label, {sql9('tp / called')} AS precision, {sql9('tp / support')} AS recall, {sql9('2 * tp / (called + support)')} AS f1, support FROM k""")
def class_report(v: Views) -> DataFrame:
    return rounded(m.class_report(v.prediction), "label", "support")


@query("prediction", f"""
    WITH e AS (SELECT avg((y - p) * (y - p)) AS mse, var_pop(y - p) AS ve, var_pop(y) AS vy FROM prediction)
    SELECT {sql9('mse')} AS mse, {sql9('1 - ve / vy')} AS explained_variance, {sql9('1 - mse / vy')} AS r2 FROM e""")
def regression_metrics(v: Views) -> DataFrame:
    return rounded(m.regression_metrics(v.prediction))


@query("prediction", f"""
    WITH k AS (SELECT least(greatest(y, 1e-4), 1.0e0) AS y, least(greatest(p, 1e-4), 1.0e0) AS p FROM prediction)
    SELECT {sql9('avg(-y * ln(p + 1e-4) * 2.5e0 - (1 - y) * ln(1 - p + 1e-4))')} AS loss FROM k""")
def weighted_cross_entropy(v: Views) -> DataFrame:
    return rounded(m.weighted_bce(v.prediction, positive_weight=2.5))


@query("prediction", f"SELECT {sql9('avg((y - p) * (y - p))')} AS loss FROM prediction")
def mean_squared_error(v: Views) -> DataFrame:
    return rounded(m.mse(v.prediction))
