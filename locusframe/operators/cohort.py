"""Subjects: summaries, splits, samples, mini-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators.ordering import number_rows, seeded_order


def cohort_summary(subjects: DataFrame) -> DataFrame:
    """Sizes of the three sets and the number of covariate columns."""
    covs = [c for c in subjects.columns if c.startswith("cov_")]
    return subjects.agg(
        F.count_if(F.col("set_id") == 1).alias("n_train"),
        F.count_if(F.col("set_id") == 2).alias("n_validation"),
        F.count_if(F.col("set_id") == 3).alias("n_test"),
        F.lit(len(covs)).cast("long").alias("n_covariates"),
    )


def label_properties(subjects: DataFrame, label: str = "label") -> DataFrame:
    """Mean training label and whether any training label is negative."""
    return subjects.filter(F.col("set_id") == 1).agg(
        F.avg(label).alias("mean_label"), (F.min(label) < 0).alias("has_negative")
    )


def set_labels(subjects: DataFrame, set_id: int, label: str = "label") -> DataFrame:
    return subjects.filter(F.col("set_id") == set_id).select("subject_id", F.col(label).alias("label"))


def binarise_label(df: DataFrame, condition: Column) -> DataFrame:
    """Add a 0/1 label from a condition."""
    return df.withColumn("label", condition.cast("int"))


def class_balance(df: DataFrame) -> DataFrame:
    """Class sizes of a 0/1 label and cases per control."""
    cases, controls = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(
        cases.alias("n_cases"),
        controls.alias("n_controls"),
        F.try_divide(cases, controls).alias("ratio"),
    )


def stratified_split(df: DataFrame, fractions: tuple[float, float] = (0.6, 0.2), seed: int = 0) -> DataFrame:
    """Set 1/2/3 by label: the first share of a seeded shuffle, the second, the rest."""
    ranked = number_rows(
        df.withColumn("_key", seeded_order("subject_id", seed)), ["_key", "subject_id"], "_rank", by=["label"]
    )
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    first = F.rint(F.col("_n") * F.lit(fractions[0]))
    second = F.rint(F.col("_n") * F.lit(fractions[0] + fractions[1]))
    return ranked.join(sizes, "label").select(
        *df.columns,
        F.when(F.col("_rank") < first, 1).when(F.col("_rank") < second, 2).otherwise(3).alias("set_id"),
    )


def sample_n(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The `n` subjects first in a seeded shuffle."""
    return (
        df.withColumn("_key", seeded_order("subject_id", seed))
        .orderBy("_key", "subject_id")
        .limit(n)
        .select(*df.columns)
    )


def assign_batches(
    df: DataFrame,
    batch_size: int,
    epoch_size: int | None = None,
    epoch: int = 0,
    seed: int = 0,
    shuffle: bool = True,
    n_rows: int | None = None,
) -> DataFrame:
    """Batch number of each row of one epoch.

    With shuffling, consecutive short epochs walk one permutation in steps of whole
    batches; once fewer than `epoch_size` rows are left a new permutation starts.
    """
    if not shuffle:
        numbered = number_rows(df, ["subject_id"], "_rank")
        return numbered.select(*df.columns, F.floor(F.col("_rank") / batch_size).cast("long").alias("batch"))
    n = n_rows if n_rows is not None else df.count()
    size = epoch_size or n
    stride = -(-size // batch_size) * batch_size
    # A permutation serves as many epochs as it has whole epoch sizes.
    per_round = max(1, n // size)
    start = (epoch % per_round) * stride
    ranked = number_rows(
        df.withColumn("_key", seeded_order("subject_id", seed + epoch // per_round)), ["_key", "subject_id"], "_rank"
    )
    at = F.col("_rank") - start
    return ranked.filter((at >= 0) & (at < stride)).select(
        *df.columns, F.floor(at / batch_size).cast("long").alias("batch")
    )


def top_hits(df: DataFrame, k: int, by: str, ties: str) -> DataFrame:
    """The k rows with the largest value."""
    return df.orderBy(F.desc(by), ties).limit(k)


def rank_slice(df: DataFrame, by: str, ties: str, start: int, end: int) -> DataFrame:
    """Rows ranked [start, end) by descending value."""
    ranked = number_rows(df, [F.desc(by), F.asc(ties)], "rank")
    return ranked.filter((F.col("rank") >= start) & (F.col("rank") < end))


def attach_genotype(subjects: DataFrame, geno: DataFrame, chunked: bool = False) -> DataFrame:
    """Cells of the subjects' genotype rows; several matrices are told apart by chunk_id."""
    keys = ["chunk_id", "genotype_row"] if chunked else ["genotype_row"]
    return subjects.join(geno, keys)
