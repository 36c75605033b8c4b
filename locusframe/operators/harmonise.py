"""Aligning variants, names and individuals of several sources.

Variant tables hold variant_id, chr, bp, allele1, allele2.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH_KEYS = {"pos": ["chr", "bp"], "rsid": ["variant_id"]}
MATCH_COLUMNS = {k: [*dict.fromkeys([*v, "chr", "bp", "allele1", "allele2"])] for k, v in MATCH_KEYS.items()}


def orientations(variants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and allele pair a study can offer: (keys, allele1, allele2, order, matched_id).

    A study variant offers its alleles straight (order 0) and swapped (order 1). Copies
    collapse to the preferred one before any join, so a position listed very often on
    both sides does not multiply.
    """
    ways = F.array(
        F.struct("allele1", "allele2", F.lit(0).alias("order")),
        F.struct(F.col("allele2").alias("allele1"), F.col("allele1").alias("allele2"), F.lit(1).alias("order")),
    )
    return (
        variants.select(*keys, F.col("variant_id").alias("matched_id"), F.explode(ways).alias("w"))
        .groupBy(*keys, "w.allele1", "w.allele2")
        .agg(F.min(F.struct("w.order", "matched_id")).alias("best"))
        .select(*keys, "allele1", "allele2", "best.*")
    )


def harmonise(variants: DataFrame, reference: DataFrame, on: str = "pos") -> DataFrame:
    """One study variant per matched reference row with its flip sign.

    A straight match wins over a swapped one; remaining ties go to the smallest id.
    """
    keys = MATCH_KEYS[on]
    ref = reference.select(F.col("variant_id").alias("reference_id"), *MATCH_COLUMNS[on])
    return ref.join(orientations(variants, keys), [*keys, "allele1", "allele2"]).select(
        F.col("matched_id").alias("variant_id"),
        "reference_id",
        "chr",
        "bp",
        F.when(F.col("order") == 0, 1).otherwise(-1).alias("flip"),
    )


def position_from_id(variants: DataFrame, column: str = "variant_id") -> DataFrame:
    """chr and bp from `chr:bp…` ids where 0 < chr < 23, else null."""
    parts = F.split(F.regexp_replace(F.col(column), "^chr", ""), ":")
    chr_ = F.expr("try_cast(try_element_at(_p, 1) AS INT)")
    bp = F.expr("try_cast(try_element_at(_p, 2) AS BIGINT)")
    valid = (F.col("_c") > 0) & (F.col("_c") < 23) & F.col("_b").isNotNull()
    return (
        variants.withColumn("_p", parts)
        .withColumn("_c", chr_)
        .withColumn("_b", bp)
        .withColumn("chr", F.when(valid, F.col("_c")))
        .withColumn("bp", F.when(valid, F.col("_b")))
        .drop("_p", "_c", "_b")
    )


def mismatches(variants: DataFrame, reference: DataFrame, on: str = "pos") -> DataFrame:
    """Study variants that match no reference row."""
    return variants.join(harmonise(variants, reference, on).select("variant_id"), "variant_id", "left_anti")


def flipped(variants: DataFrame, reference: DataFrame, on: str = "pos") -> DataFrame:
    """Study variants whose alleles are swapped against the reference."""
    swapped = harmonise(variants, reference, on).filter("flip = -1").select("variant_id")
    return variants.join(swapped, "variant_id", "left_semi")


def harmonise_summary(variants: DataFrame, reference: DataFrame, on: str = "pos") -> DataFrame:
    """Counts of common, reference-only and study-only (excluded) variants."""
    matched = harmonise(variants, reference, on)
    tagged = reduce(
        DataFrame.unionByName,
        [
            matched.select(F.lit("m").alias("side")),
            reference.select(F.lit("r").alias("side")),
            variants.select(F.lit("v").alias("side")),
            matched.select("variant_id").distinct().select(F.lit("u").alias("side")),
        ],
    )

    def rows(side: str):
        return F.count_if(F.col("side") == side)

    return tagged.agg(
        rows("m").alias("common"),
        (rows("r") - rows("m")).alias("reference_only"),
        (rows("v") - rows("u")).alias("excluded"),
    )


def restrict(
    df: DataFrame,
    include: DataFrame | None = None,
    exclude: DataFrame | None = None,
    on: Sequence[str] = ("variant_id",),
) -> DataFrame:
    """Rows in the include list and not in the exclude list, matched by id or by (chr, bp)."""
    keys = list(on)
    if include is not None:
        df = df.join(include.select(*keys), keys, "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(*keys), keys, "left_anti")
    return df


def restrict_traits(traits: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    return restrict(traits, include, exclude, on=["trait"])


def common_values(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Values of `column` that occur in every table (variants, individuals, trait names)."""
    tagged = [t.select(column, F.lit(i).alias("_table")).distinct() for i, t in enumerate(tables)]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_tables"))
        .filter(F.col("_tables") == len(tables))
        .select(column)
    )


def common_variants(maps: Sequence[DataFrame]) -> DataFrame:
    """Reference variants mapped in every study."""
    return common_values(maps, "reference_id")


def common_subjects(*tables: DataFrame | None) -> DataFrame:
    """Individuals of all given tables; any of them may be absent."""
    return common_values([t for t in tables if t is not None], "subject_id")


def common_names(tables: Sequence[DataFrame], column: str = "trait") -> DataFrame:
    return common_values(tables, column)


def merge_studies(genotypes: Sequence[DataFrame], maps: Sequence[DataFrame]) -> DataFrame:
    """Cells of several studies on the common reference variants, flipped, with a study column."""
    common = common_variants(maps)
    parts = []
    for study, (geno, mapping) in enumerate(zip(genotypes, maps)):
        used = mapping.join(common, "reference_id", "left_semi").select("variant_id", "reference_id", "flip")
        value = F.when(F.col("flip") == -1, 2 - F.col("dosage")).otherwise(F.col("dosage"))
        parts.append(
            geno.join(used, "variant_id").select(
                F.lit(study).alias("study"), "subject_id", F.col("reference_id").alias("variant_id"), value.alias("dosage")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def merge_traits(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows (study, subject_id, trait, value) of several studies on their common traits."""
    common = common_names(tables)
    parts = [t.select(F.lit(i).alias("study"), "subject_id", "trait", "value") for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts).join(common, "trait", "left_semi")


def allele_dictionary(variants: DataFrame) -> DataFrame:
    """Distinct alleles of both columns with a 64-bit key."""
    alleles = variants.select(F.explode(F.array("allele1", "allele2")).alias("allele")).distinct()
    return alleles.select(F.xxhash64("allele").alias("key"), "allele")


def encode_alleles(variants: DataFrame) -> DataFrame:
    """Replace both alleles by their keys."""
    return variants.withColumn("allele1", F.xxhash64("allele1")).withColumn("allele2", F.xxhash64("allele2"))


def decode_alleles(variants: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace allele keys by strings; unknown keys become null."""
    for column in ("allele1", "allele2"):
        names = dictionary.select(F.col("key").alias(column), F.col("allele").alias("_allele"))
        variants = variants.join(names, column, "left").withColumn(column, F.col("_allele")).drop("_allele")
    return variants


def annotate_results(results: DataFrame, variants: DataFrame) -> DataFrame:
    """Add variant columns to a result table; MAF becomes AF_coded, the counted allele's frequency."""
    info = variants.select(F.col("variant_id").alias("RSID"), "chr", "bp", "allele1", "allele2")
    return results.withColumnRenamed("MAF", "AF_coded").join(info, "RSID")


def annovar_input(variants: DataFrame) -> DataFrame:
    """Columns of the annotator's input: chr, bp twice, both alleles, row index."""
    return variants.select(
        "chr", F.col("bp").alias("bps"), F.col("bp").alias("bpe"), "allele1", "allele2",
        F.col("variant_row").alias("index_col"),
    )
