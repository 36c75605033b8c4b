"""String columns: gene names and list-in-string cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is cut from an annotated gene name, in this order.
GENE_NAME_CUTS = [r",.*", r"\(.*\)", r"\(.*", r";.*"]


def clean_gene(name: Column) -> Column:
    """Bare gene name: first of a list, without distances or other brackets."""
    for pattern in GENE_NAME_CUTS:
        name = F.regexp_replace(name, pattern, "")
    return name


def chromosome_code(name: Column) -> Column:
    """Chromosome as a number: a leading chr is dropped, X Y XY MT (or M) are 23 to 26; null for other names."""
    bare = F.upper(F.regexp_replace(name, "(?i)^chr", ""))
    coded = F.when(bare == "X", 23).when(bare == "Y", 24).when(bare == "XY", 25).when(bare.isin("MT", "M"), 26)
    return coded.otherwise(bare.try_cast("int"))


def explode_columns(df: DataFrame, columns: Sequence[str], separator: str = ",") -> DataFrame:
    """One row per element of parallel list columns; shorter lists are filled with null."""
    lists = [F.transform(F.split(F.col(c), separator), lambda x: F.trim(x)).alias(c) for c in columns]
    others = [c for c in df.columns if c not in columns]
    zipped = df.select(*others, *lists).select(*others, F.explode(F.arrays_zip(*columns)).alias("_e"))
    return zipped.select(*[F.col(f"_e.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
