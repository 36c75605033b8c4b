"""Imputed dosages: .dose files with one line per individual, .info files with the variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.ordering import number_rows
from locusframe.sources.lines import read_lines

# Whitespace-separated columns of .info (from 0) and the values before the dosages in .dose.
INFO_COLUMNS = {"variant_id": 0, "allele1": 1, "allele2": 2, "maf": 4, "rsq": 6}
DOSE_LEADING = 2


def _base(file: Column) -> Column:
    """File name without extensions pairs a .dose with its .info; either may be a folder of part files."""
    return F.regexp_replace(file, r"\.(dose|info)(\.gz)?(/[^/]*)?$", "")


def read_info(spark: SparkSession, folder: str) -> DataFrame:
    """(base, position, variant_id, allele1, allele2, maf, rsq); position counts within a file."""
    lines = read_lines(spark, f"{folder.rstrip('/')}/*.info*").withColumn("base", _base(F.col("file")))
    numbered = number_rows(lines, ["file", "block", "at"], "line", by=["base"])
    part = F.split(F.trim("value"), r"\s+")
    c = INFO_COLUMNS
    return numbered.filter("line > 0").select(
        "base",
        (F.col("line") - 1).alias("position"),
        *[part[c[n]].alias(n) for n in ("variant_id", "allele1", "allele2")],
        *[part[c[n]].try_cast("double").alias(n) for n in ("maf", "rsq")],
    )


def read_minimac(spark: SparkSession, folder: str) -> DataFrame:
    """Cells (variant_id, family, individual, dosage) of all file pairs."""
    lines = read_lines(spark, f"{folder.rstrip('/')}/*.dose*").withColumn("base", _base(F.col("file")))
    part = F.split(F.trim("value"), r"\s+")
    who = F.split(part[0], "->")
    cells = lines.select(
        "base",
        who[0].alias("family"),
        F.coalesce(F.get(who, F.lit(1)), who[0]).alias("individual"),
        F.posexplode(F.slice(part, DOSE_LEADING + 1, F.size(part))).alias("position", "dosage"),
    )
    names = read_info(spark, folder).select("base", "position", "variant_id")
    return cells.withColumn("position", F.col("position").cast("long")).join(names, ["base", "position"]).select(
        "variant_id", "family", "individual", F.col("dosage").try_cast("double").alias("dosage")
    )
