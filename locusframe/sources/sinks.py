"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.genotype import to_subject_major, to_variant_major

RESULT_BUCKETS = 16


def write_genotype(geno: DataFrame, path: str, layout: str = "long", tile: int = 4096) -> None:
    """Compressed matrix as long cells or in tiles, sorted by the row side so that scans prune on it."""
    if layout == "long":
        df, keys = geno, ["variant_id", "subject_id"]
    elif layout == "variant":
        df, keys = to_variant_major(geno, tile), ["variant_id", "tile"]
    elif layout == "subject":
        df, keys = to_subject_major(geno, tile), ["subject_id", "tile"]
    else:
        raise ValueError(f"unknown layout {layout}")
    # Both keys: one variant or subject may fill several files.
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def write_annovar_input(df: DataFrame, path: str) -> None:
    """Tab-separated without a header."""
    df.write.csv(path, sep="\t", header=False)


def write_results(results: DataFrame, path: str, split_phenotype: bool = False) -> None:
    """Append association results; with `split_phenotype` one folder per phenotype.

    A phenotype is spread over several files, so one with most of the hits is no single task's work.
    """
    if not split_phenotype:
        results.write.mode("append").parquet(path)
        return
    spread = F.pmod(F.xxhash64("RSID"), F.lit(RESULT_BUCKETS))
    results.repartition("phenotype", spread).write.mode("append").partitionBy("phenotype").parquet(path)


def save_stats(cohort: DataFrame, variants: DataFrame, path: str) -> None:
    """Sufficient statistics, partitioned by study."""
    cohort.write.mode("append").partitionBy("study").parquet(f"{path}/cohort")
    variants.write.mode("append").partitionBy("study").parquet(f"{path}/variants")


def load_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cohort"), spark.read.parquet(f"{path}/variants")
