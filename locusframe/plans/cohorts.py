"""Cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import cohort as c
from locusframe.plans.registry import query, r6, sql6, sql_order
from locusframe.plans.views import Views


@query("subject", """
    SELECT count(*) FILTER (set_id = 1) AS n_train, count(*) FILTER (set_id = 2) AS n_validation, count(*) FILTER (set_id = 3) AS n_test,
           CAST(2 AS BIGINT) AS n_covariates FROM subject""")
def cohort_summary(v: Views) -> DataFrame:
    return c.cohort_summary(v.subject)


@query("subject", f"SELECT {sql6('avg(label_reg)')} AS mean_label, min(label_reg) < 0 AS has_negative FROM subject WHERE set_id = 1")
def label_properties(v: Views) -> DataFrame:
    return c.label_properties(v.subject, "label_reg").withColumn("mean_label", r6("mean_label"))


@query("subject", "SELECT subject_id, label_reg AS label FROM subject WHERE set_id = 3")
def labels_of_a_set(v: Views) -> DataFrame:
    return c.set_labels(v.subject, 3, "label_reg")


@query("", f"""
    SELECT n_cases, n_controls, {sql6('n_cases / n_controls')} AS ratio
    FROM (SELECT count(*) FILTER (c_acctbal > 7000) AS n_cases, count(*) FILTER (NOT c_acctbal > 7000) AS n_controls FROM customer)""")
def class_balance(v: Views) -> DataFrame:
    labelled = c.binarise_label(v.table("customer"), F.col("c_acctbal") > 7000)
    return c.class_balance(labelled).withColumn("ratio", r6("ratio"))


@query("prediction", f"""
    WITH r AS (SELECT subject_id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_order('subject_id', 3)}, subject_id) - 1 AS r,
                      count(*) OVER (PARTITION BY y) AS n FROM prediction)
    SELECT subject_id, y AS label, CASE WHEN r < round_even(0.6e0 * n, 0) THEN 1 WHEN r < round_even(0.8e0 * n, 0) THEN 2 ELSE 3 END AS set_id FROM r""")
def stratified_split(v: Views) -> DataFrame:
    return c.stratified_split(v.prediction.select("subject_id", F.col("y").alias("label")), seed=3)


@query("prediction", f"""
    SELECT subject_id FROM prediction ORDER BY {sql_order('subject_id', 9)}, subject_id LIMIT 100""")
def evaluation_sample(v: Views) -> DataFrame:
    return c.sample_n(v.prediction.select("subject_id"), 100, seed=9)


@query("prediction", f"""
    WITH r AS (SELECT subject_id, row_number() OVER (ORDER BY {sql_order('subject_id', 5)}, subject_id) - 1 AS r,
                      count(*) OVER () AS n FROM prediction)
    SELECT subject_id, (r - 64) // 32 AS batch FROM r WHERE r >= 64 AND r < 128""")
def shuffled_batches(v: Views) -> DataFrame:
    """Second short epoch over one permutation: batches two and three of the shuffle."""
    return c.assign_batches(v.prediction.select("subject_id"), 32, epoch_size=50, epoch=1, seed=5)


@query("prediction", "SELECT subject_id, (row_number() OVER (ORDER BY subject_id) - 1) // 64 AS batch FROM prediction")
def ordered_batches(v: Views) -> DataFrame:
    return c.assign_batches(v.prediction.select("subject_id"), 64, shuffle=False)


@query("prediction", "SELECT subject_id, p FROM prediction ORDER BY p DESC, subject_id LIMIT 10")
def top_hits(v: Views) -> DataFrame:
    return c.top_hits(v.prediction, 10, "p", "subject_id").select("subject_id", "p")


@query("prediction", """
    SELECT subject_id, p, rank FROM (SELECT subject_id, p, row_number() OVER (ORDER BY p DESC, subject_id) - 1 AS rank FROM prediction)
    WHERE rank >= 20 AND rank < 60""")
def rank_slice(v: Views) -> DataFrame:
    return c.rank_slice(v.prediction.select("subject_id", "p"), "p", "subject_id", 20, 60)
