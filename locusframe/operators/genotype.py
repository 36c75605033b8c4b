"""Genotype preparation on long tables (subject_id, variant_id, dosage).

A missing call is a null dosage. Per-variant figures are partial aggregates that
are joined back, never windows over a variant, so a variant holding a large part
of all cells is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.ordering import number_rows

TILE = 4096


def merge_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Append variant shards in order: shift each shard's variant_row, round half-even to int."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)])
    # One row per input shard, so the unpartitioned window is bounded by the argument list.
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_shard")
        .agg((F.max("variant_row") + 1).alias("_n"))
        .select("_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return tagged.join(offsets, "_shard").select(
        "subject_id",
        (F.col("variant_row") + F.col("_offset")).cast("long").alias("variant_row"),
        F.rint("dosage").cast("int").alias("dosage"),
    )


def impute_mean(geno: DataFrame, rounded: bool = True) -> DataFrame:
    """Fill missing calls with the variant mean; a variant without any call stays null."""
    means = geno.groupBy("variant_id").agg(F.avg("dosage").alias("_mean"))
    filled = F.coalesce(F.col("dosage").cast("double"), F.col("_mean"))
    value = F.rint(filled).cast("int") if rounded else filled
    return geno.join(means, "variant_id").select("subject_id", "variant_id", value.alias("dosage"))


def variant_std(geno: DataFrame) -> DataFrame:
    """Population standard deviation after mean imputation.

    An imputed cell adds nothing to the squared deviations, so the deviation of the
    calls only has to be scaled by the share of called cells.
    """
    called = F.count("dosage")
    return geno.groupBy("variant_id").agg(
        (F.stddev_pop("dosage") * F.sqrt(called / F.count(F.lit(1)))).alias("std")
    )


def select_variants(df: DataFrame, flags: DataFrame, n_variants: int | None = None) -> DataFrame:
    """Keep the variants flagged true and renumber them from 0 in id order (`variant_row`)."""
    if n_variants is not None and flags.count() != n_variants:
        raise ValueError("the selection vector and the genotype matrix differ in length")
    kept = number_rows(flags.filter("keep").select("variant_id"), ["variant_id"], "variant_row")
    columns = [c for c in df.columns if c != "variant_row"]
    return df.select(*columns).join(kept, "variant_id").select(*columns, "variant_row")


def remove_subjects(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("subject_id"), "subject_id", "left_anti")


def allele_frequency(geno: DataFrame) -> DataFrame:
    """Frequency of the counted allele, half the mean dosage."""
    return geno.groupBy("variant_id").agg((F.avg("dosage") / 2).alias("af"))


def frequency_kept(af: Column, threshold: float) -> Column:
    """Both alleles above the threshold and not exactly balanced; no filter at 0."""
    if threshold == 0:
        return F.lit(True)
    return (af > threshold) & (af < 1 - threshold) & (af != 0.5)


def maf_filter(geno: DataFrame, threshold: float) -> DataFrame:
    """Cells of the variants whose allele frequency passes the threshold."""
    if threshold == 0:
        return geno
    kept = allele_frequency(geno).filter(frequency_kept(F.col("af"), threshold))
    return geno.join(kept.select("variant_id"), "variant_id", "left_semi")


def one_hot(geno: DataFrame) -> DataFrame:
    """Three-class indicator of the dosage; a missing call is all zero."""
    classes = [F.coalesce((F.col("dosage") == k).cast("int"), F.lit(0)) for k in (0, 1, 2)]
    return geno.select("subject_id", "variant_id", F.array(*classes).alias("classes"))


def interaction(geno: DataFrame, factor: DataFrame) -> DataFrame:
    """Dosage times a per-subject factor (subject_id, factor)."""
    return geno.join(factor, "subject_id").select(
        "subject_id", "variant_id", (F.col("dosage") * F.col("factor")).alias("dosage")
    )


def flip_dosage(geno: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keep mapped variants (variant_id, flip); count the other allele where flip = -1."""
    value = F.when(F.col("flip") == -1, 2 - F.col("dosage")).otherwise(F.col("dosage"))
    return geno.join(mapping.select("variant_id", "flip"), "variant_id").select(
        "subject_id", "variant_id", value.alias("dosage")
    )


def autosomal(variants: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Variants on chromosomes 1-22 with the required annotation columns filled."""
    kept = variants.filter(F.col("chr") < 23)
    return kept.dropna(subset=list(required)) if required else kept


def label_by_rules(geno: DataFrame, rules: DataFrame) -> DataFrame:
    """Label 1 where every (variant_id, value) of any rule (rule_id, variant_id, value) holds."""
    sizes = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_size"))
    met = (
        geno.join(rules, "variant_id")
        .groupBy("subject_id", "rule_id")
        .agg(F.count_if(F.col("dosage") == F.col("value")).alias("_met"))
        .join(sizes, "rule_id")
        .groupBy("subject_id")
        .agg(F.max((F.col("_met") == F.col("_size")).cast("int")).alias("label"))
    )
    return (
        geno.select("subject_id").distinct()
        .join(met, "subject_id", "left")
        .select("subject_id", F.coalesce("label", F.lit(0)).alias("label"))
    )


def to_subject_major(geno: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows per subject and tile of `tile` variants: (subject_id, tile, variant_ids, dosages).

    A row holds at most `tile` cells, so neither a subject with many calls nor a wide
    matrix can outgrow a task. Missing calls keep their place as nulls.
    """
    return _tiled(geno, "subject_id", "variant_id", "variant_ids", tile)


def to_variant_major(geno: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows per variant and tile of `tile` subjects: (variant_id, tile, subject_ids, dosages)."""
    return _tiled(geno, "variant_id", "subject_id", "subject_ids", tile)


def _tiled(geno: DataFrame, row: str, column: str, names: str, tile: int) -> DataFrame:
    cells = F.col("_cells")

    def last(cell: Column, at: Column) -> Column:
        return (at == F.size(cells) - 1) | ~F.get(cells, at + 1)[column].eqNullSafe(cell[column])

    return (
        # Equal copies of a cell collapse before the only shuffle; of unequal ones the largest call stays, sorted last.
        geno.groupBy(row, F.floor(F.col(column) / tile).cast("long").alias("tile"))
        .agg(F.array_sort(F.collect_set(F.struct(column, "dosage"))).alias("_cells"))
        .select(row, "tile", F.filter(cells, last).alias("_cells"))
        .select(row, "tile", F.col(f"_cells.{column}").alias(names), F.col("_cells.dosage").alias("dosages"))
    )


def from_tiles(tiles: DataFrame, row: str = "subject_id", column: str = "variant_id", names: str = "variant_ids") -> DataFrame:
    """Long cells of a tiled matrix."""
    return tiles.select(row, F.explode(F.arrays_zip(names, "dosages")).alias("_c")).select(
        row, F.col(f"_c.{names}").alias(column), F.col("_c.dosages").alias("dosage")
    )


def checksum(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sums of all dosages of two layouts and whether they agree."""
    tagged = left.select(F.lit("l").alias("side"), "dosage").unionByName(
        right.select(F.lit("r").alias("side"), "dosage")
    )

    def total(side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("dosage"))), F.lit(0)).cast("double")

    return tagged.agg(total("l").alias("left_sum"), total("r").alias("right_sum")).withColumn(
        "equal", F.col("left_sum") == F.col("right_sum")
    )


def audit(geno: DataFrame, variants: DataFrame, subjects: DataFrame) -> DataFrame:
    """Row counts of a converted data set: tables, matrix sides, and whether they agree."""

    def side(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.select(F.lit(name).alias("side"), F.col(column).cast("string").alias("id"))

    parts = [
        side(geno, "matrix_variants", "variant_id").distinct(),
        side(geno, "matrix_subjects", "subject_id").distinct(),
        side(variants, "variants", "variant_id"),
        side(subjects, "subjects", "subject_id"),
    ]
    names = ["matrix_variants", "matrix_subjects", "variants", "subjects"]
    return (
        reduce(DataFrame.unionByName, parts)
        .agg(*[F.count_if(F.col("side") == n).alias(n) for n in names])
        .withColumn(
            "consistent",
            (F.col("variants") == F.col("matrix_variants")) & (F.col("subjects") == F.col("matrix_subjects")),
        )
    )
