"""VCF text: samples, variants and dosages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.text import chromosome_code
from locusframe.operators.genotype import TILE
from locusframe.operators.ordering import number_rows
from locusframe.sources.lines import read_lines

# Fixed values of the format.
FIXED_COLUMNS = 9
FORMAT_COLUMN = 8
DOSAGE_FIELDS = ["GT", "DS", "EC"]


def read_vcf_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(subject_row, individual) of the header line, which all files must share."""
    names = _header(spark, path).split("\t")[FIXED_COLUMNS:]
    return spark.createDataFrame(list(enumerate(names)), "subject_row long, individual string")


def _header(spark: SparkSession, path: str | list[str]) -> str:
    """The samples line; refused if files list other samples or another order."""
    lines = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).distinct().limit(2).collect()
    if not lines:
        raise ValueError("there is no header line")
    if len(lines) > 1:
        raise ValueError("the files list different samples or another order of samples")
    return lines[0].value


def _records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = read_lines(spark, path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    return lines.withColumn("part", F.split("value", "\t")).drop("value")


def read_vcf_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variants in file order with QUAL, FILTER and INFO; dosages count allele1, the reference allele."""
    p = F.col("part")
    variants = _records(spark, path).select(
        "file", "block", "at",
        chromosome_code(p[0]).alias("chr"), p[1].try_cast("long").alias("bp"), p[2].alias("variant_id"),
        p[3].alias("allele1"), p[4].alias("allele2"), p[5].alias("qual"), p[6].alias("filter"), p[7].alias("info"),
    )
    return number_rows(variants, ["file", "block", "at"], "variant_row").drop("file", "block", "at").withColumn(
        "counted_allele", F.col("allele1")
    )


def declared_field(spark: SparkSession, path: str | list[str]) -> str:
    """The last of GT, DS and EC that the header declares."""
    header = read_lines(spark, path).filter(F.col("value").startswith("##FORMAT=<ID="))
    named = header.select("block", "at", F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("field"))
    row = named.filter(F.col("field").isin(DOSAGE_FIELDS)).orderBy(F.desc("block"), F.desc("at")).first()
    if row is None:
        raise ValueError("the header declares none of GT, DS and EC")
    return row.field


def dosage_of(value: Column, field: str) -> Column:
    """Dosage of the reference allele: 2 minus the other alleles, each counted once; null if missing.

    A haploid call has one allele to subtract.
    """
    if field == "GT":
        alleles = F.split(value, r"[/|]")
        first = F.least(alleles[0].try_cast("int"), F.lit(1))
        haploid = F.size(alleles) == 1
        second = F.when(haploid, 0).otherwise(F.least(F.get(alleles, F.lit(1)).try_cast("int"), F.lit(1)))
        # least() skips nulls, a missing allele must not.
        called = alleles[0].try_cast("int").isNotNull() & (haploid | F.get(alleles, F.lit(1)).try_cast("int").isNotNull())
        return F.when(called, (2 - (first + second)).cast("double"))
    return 2 - value.try_cast("double")


def read_vcf_dosage(spark: SparkSession, path: str | list[str], field: str | None = None) -> DataFrame:
    """Cells (variant_id, chr, bp, subject_row, dosage)."""
    _header(spark, path)
    field = field or declared_field(spark, path)
    p = F.col("part")
    place = F.array_position(F.split(p[FORMAT_COLUMN], ":"), field)
    cells = _records(spark, path).select(
        p[2].alias("variant_id"),
        chromosome_code(p[0]).alias("chr"),
        p[1].try_cast("long").alias("bp"),
        place.cast("int").alias("place"),
        F.posexplode(F.slice(p, FIXED_COLUMNS + 1, F.size(p))).alias("subject_row", "sample"),
    )
    value = F.get(F.split("sample", ":"), F.col("place") - 1)
    return cells.select(
        "variant_id", "chr", "bp", F.col("subject_row").cast("long").alias("subject_row"), dosage_of(value, field).alias("dosage")
    )


def read_vcf_tiles(spark: SparkSession, path: str | list[str], field: str | None = None, tile: int = TILE) -> DataFrame:
    """Tiles (variant_id, tile, subject_ids, dosages), ids being file rows; no cell becomes a row of its own."""
    _header(spark, path)
    field = field or declared_field(spark, path)
    numbered = number_rows(_records(spark, path), ["file", "block", "at"], "variant_id")
    p = F.col("part")
    place = F.array_position(F.split(p[FORMAT_COLUMN], ":"), field).cast("int")
    samples = F.slice(p, FIXED_COLUMNS + 1, F.size(p))
    dosages = F.transform(samples, lambda c: dosage_of(F.get(F.split(c, ":"), place - 1), field))
    last = F.floor((F.size("dosages") - 1) / tile).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda t: F.slice("dosages", t * tile + 1, F.lit(tile)))
    tiles = numbered.select("variant_id", dosages.alias("dosages")).select(
        "variant_id", F.posexplode(parts).alias("tile", "dosages")
    )
    first = F.col("tile").cast("long") * tile
    ids = F.sequence(first, first + F.size("dosages") - 1)
    return tiles.select("variant_id", F.col("tile").cast("long").alias("tile"), ids.alias("subject_ids"), "dosages")
