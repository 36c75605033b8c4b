"""Text lines with their place in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.ordering import number_rows


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block, at): splits are read in parallel; (file, block, at) sorts them in file order."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def first_line(spark: SparkSession, path: str) -> str:
    row = read_lines(spark, path).filter("block = 0").orderBy("at").limit(1).first()
    if row is None:
        raise ValueError(f"{path} is empty")
    return row.value


def numbered_lines(spark: SparkSession, path: str | list[str], out: str) -> DataFrame:
    """(value, <out>) with consecutive line numbers from 0 over all files in order of their paths."""
    lines = read_lines(spark, path).filter(F.length(F.trim("value")) > 0)
    return number_rows(lines, ["file", "block", "at"], out).select("value", out)
