"""Delimited tables: traits, subjects, topologies, annotations, pathways, reference panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.topology import node_columns
from locusframe.sources.lines import first_line, numbered_lines

# Required columns of the input tables.
SUBJECT_COLUMNS = ["patient_id", "labels", "genotype_row", "set"]
REFERENCE_COLUMNS = ["ID", "allele1", "allele2", "CHR", "bp"]
ANNOTATION_SCHEMA = (
    "region string, gene string, chr int, bps long, bpe long, mutation1 string, mutation2 string, index_col int"
)


def _require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} has no column {', '.join(missing)}")


def read_wide_traits(spark: SparkSession, path: str) -> DataFrame:
    """Wide numeric table, tab or else space separated, first column the individual."""
    header = first_line(spark, path)
    sep = "\t" if "\t" in header else " "
    named = header.split(sep)
    if len(set(named)) < len(named):  # the CSV reader would rename them
        raise ValueError("column names must be unique")
    df = spark.read.csv(path, sep=sep, header=True)
    id_, *names = df.columns
    return df.select(F.col(f"`{id_}`").alias("subject_id"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])


def to_long_traits(wide: DataFrame) -> DataFrame:
    """(subject_id, trait, value)."""
    names = [c for c in wide.columns if c != "subject_id"]
    return wide.unpivot(["subject_id"], [F.col(f"`{c}`") for c in names], "trait", "value")


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    return to_long_traits(read_wide_traits(spark, path))


def duplicate_cells(traits: DataFrame) -> DataFrame:
    """(subject_id, trait, n) that occur more than once: repeated individuals or names."""
    return traits.groupBy("subject_id", "trait").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def validate_traits(traits: DataFrame) -> DataFrame:
    """The traits, refused if an individual or a name repeats."""
    if not duplicate_cells(traits).isEmpty():
        raise ValueError("individuals and trait names must be unique")
    return traits


def check_subjects(df: DataFrame, regression: bool) -> DataFrame:
    """Subjects with the required columns and labels that fit the kind of problem."""
    _require(df, SUBJECT_COLUMNS, "the subjects table")
    label = F.col("labels").try_cast("double")
    other, unread = df.agg(F.count_if(~label.isin(0.0, 1.0)), F.count_if(label.isNull())).first()
    if unread:
        raise ValueError(f"{unread} subjects have no label that is a number")
    if regression and other == 0:
        raise ValueError("regression needs labels other than 0 and 1")
    if not regression and other > 0:
        raise ValueError("classification needs labels 0 and 1")
    covs = [c for c in df.columns if c.startswith("cov_")]
    chunk = ["chunk_id"] if "chunk_id" in df.columns else []
    return df.select(
        F.col("patient_id").alias("subject_id"),
        F.col("labels").cast("double").alias("label"),
        F.col("genotype_row").cast("long").alias("genotype_row"),
        F.col("set").cast("int").alias("set_id"),
        *chunk,
        *[F.col(c).cast("double").alias(c) for c in covs],
    )


def read_subjects(spark: SparkSession, path: str, regression: bool = False) -> DataFrame:
    """Cohort table: subject_id, label, genotype_row, set_id, cov_*, chunk_id if present."""
    return check_subjects(spark.read.csv(path, header=True), regression)


def check_topology(df: DataFrame) -> DataFrame:
    """Path rows with node columns as numbers, names trimmed, in order of the nodes."""
    nodes = node_columns(df)
    if len(nodes) < 2:
        raise ValueError("a topology needs layer0_node and layer1_node")
    names = [c for c in df.columns if c.startswith("layer") and c.endswith("_name")]
    chromosome = [F.col("chr").cast("int").alias("chr")] if "chr" in df.columns else []
    ordered = [c for c in df.columns if c in nodes or c in names]
    columns = [F.col(c).cast("long").alias(c) if c in nodes else F.trim(c).alias(c) for c in ordered]
    return df.select(*chromosome, *columns).orderBy(*nodes)


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    return check_topology(spark.read.csv(path, header=True))


def read_variant_function(spark: SparkSession, path: str) -> DataFrame:
    """Annotator output: eight tab-separated columns without a header."""
    return spark.read.csv(path, sep="\t", schema=ANNOTATION_SCHEMA)


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Pathway hierarchy: hsaid, local, mid, global with their ids."""
    df = spark.read.csv(path, header=True)
    ids = ["hsaid", "local_id", "mid_id", "global_id"]
    return df.select(*[F.col(c).cast("int").alias(c) for c in ids], "local", "mid", "global")


def read_pathways(spark: SparkSession, path: str) -> DataFrame:
    """Pathway gene lists in listing order: listed, source, external_id, hgnc_symbol_ids."""
    header = first_line(spark, path).split("\t")
    part = F.split("value", "\t")
    wanted = ["source", "external_id", "hgnc_symbol_ids"]
    lines = numbered_lines(spark, path, "listed").filter("listed > 0")
    return lines.select("listed", *[part[header.index(c)].alias(c) for c in wanted])


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reference panel: variant_id, chr, bp, allele1, allele2 from a space-separated table."""
    df = spark.read.csv(path, sep=" ", header=True)
    _require(df, REFERENCE_COLUMNS, "the reference panel")
    return df.select(
        F.col("ID").alias("variant_id"), F.col("CHR").cast("int").alias("chr"), F.col("bp").cast("long").alias("bp"),
        "allele1", "allele2",
    )
