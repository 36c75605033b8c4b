"""Binary PLINK filesets: .fam individuals, .bim variants, .bed genotypes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from locusframe.operators.genotype import TILE
from locusframe.functions.text import chromosome_code
from locusframe.sources.lines import numbered_lines

# Fixed values of the .bed format.
MAGIC = b"\x6c\x1b"
VARIANT_MAJOR = b"\x01"
HEADER_BYTES = 3
SAMPLES_PER_BYTE = 4
# Dosage of allele 2 for the two-bit codes 0, 1, 2, 3; 1 means missing.
CODE_DOSAGE = [0, None, 1, 2]

BYTES_PER_PARTITION = 32 << 20
BYTES_PER_BATCH = 1 << 20


def read_fam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Individuals in file order: subject_row, family, individual, paternal, maternal, sex, label."""
    part = F.split(F.trim("value"), r"\s+")
    whole = [part[i].try_cast("int").alias(n) for i, n in enumerate(["paternal", "maternal", "sex", "label"], 2)]
    return numbered_lines(spark, path, "subject_row").select(
        "subject_row", part[0].alias("family"), part[1].alias("individual"), *whole
    )


def read_bim(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Variants in matrix row order: variant_row, chr, variant_id, distance, bp, allele1, allele2."""
    part = F.split(F.trim("value"), r"\s+")
    return numbered_lines(spark, path, "variant_row").select(
        "variant_row",
        chromosome_code(part[0]).alias("chr"),
        part[1].alias("variant_id"),
        part[2].try_cast("double").alias("distance"),
        part[3].try_cast("long").alias("bp"),
        part[4].alias("allele1"),
        part[5].alias("allele2"),
    )


@dataclass
class VariantRange(InputPartition):
    start: int
    end: int


class BedReader(DataSourceReader):
    """Reads variant ranges of one .bed file; a batch holds about a megabyte of packed calls."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.subjects = int(options["subjects"])
        self.variants = int(options["variants"])
        self.tile = int(options.get("tile", TILE))
        self.row_bytes = -(-self.subjects // SAMPLES_PER_BYTE)

    def _open(self):
        system, path = fs.FileSystem.from_uri(self.path)
        return system.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        with self._open() as f:
            head, size = f.read(HEADER_BYTES), f.size()
        if head[:2] != MAGIC:
            raise ValueError(f"{self.path} is not a .bed file")
        if head[2:3] != VARIANT_MAJOR:
            raise ValueError(f"{self.path} is not stored variant by variant")
        if size != HEADER_BYTES + self.variants * self.row_bytes:
            raise ValueError(f"{self.path} does not hold {self.variants} variants of {self.subjects} individuals")
        step = max(1, BYTES_PER_PARTITION // self.row_bytes)
        return [VariantRange(i, min(i + step, self.variants)) for i in range(0, self.variants, step)]

    def read(self, partition: VariantRange) -> Iterator[pa.RecordBatch]:
        codes = np.array([-1 if d is None else d for d in CODE_DOSAGE], dtype=np.int8)
        shifts = np.arange(0, 2 * SAMPLES_PER_BYTE, 2, dtype=np.uint8)
        step = max(1, BYTES_PER_BATCH // self.row_bytes)
        tiles = range(0, self.subjects, self.tile)
        with self._open() as f:
            for start in range(partition.start, partition.end, step):
                end = min(start + step, partition.end)
                f.seek(HEADER_BYTES + start * self.row_bytes)
                packed = np.frombuffer(f.read((end - start) * self.row_bytes), np.uint8)
                pairs = (packed[:, None] >> shifts) & 3
                calls = codes[pairs].reshape(end - start, -1)[:, : self.subjects]
                for t in tiles:
                    part = calls[:, t : t + self.tile]
                    width = part.shape[1]
                    flat = np.ascontiguousarray(part).ravel()
                    values = pa.array(flat, pa.int8(), mask=flat < 0)
                    offsets = pa.array(np.arange(0, len(flat) + 1, width), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(start, end), pa.int64()),
                            pa.array(np.full(end - start, t // self.tile), pa.int64()),
                            pa.ListArray.from_arrays(offsets, values),
                        ],
                        names=["variant_id", "tile", "dosages"],
                    )


class BedSource(DataSource):
    """Options: path (with its scheme), subjects, variants, tile."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "variant_id long, tile long, dosages array<tinyint>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BedReader(dict(self.options))


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme and host that Spark's own readers take for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def read_bed(spark: SparkSession, prefix: str, tile: int = TILE) -> DataFrame:
    """Tiles (variant_id, tile, subject_ids, dosages) of a fileset, ids being file rows.

    The layout of `to_variant_major`: association and training read it without a shuffle.
    """
    spark.dataSource.register(BedSource)
    subjects = spark.read.text(f"{prefix}.fam").filter(F.length(F.trim("value")) > 0).count()
    variants = spark.read.text(f"{prefix}.bim").filter(F.length(F.trim("value")) > 0).count()
    tiles = (
        spark.read.format("bed").option("path", qualified(spark, f"{prefix}.bed")).option("subjects", subjects)
        .option("variants", variants).option("tile", tile).load()
    )
    first = F.col("tile") * tile
    ids = F.sequence(first, first + F.size("dosages") - 1)
    return tiles.select("variant_id", "tile", ids.alias("subject_ids"), "dosages")


def same_individuals(left: DataFrame, right: DataFrame) -> bool:
    """Whether two filesets list the same individuals in the same rows."""
    columns = ["subject_row", "family", "individual"]
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def read_filesets(spark: SparkSession, prefixes: list[str], tile: int = TILE) -> DataFrame:
    """Tiles of several filesets of the same individuals, their variants numbered one after the other."""
    individuals = read_fam(spark, f"{prefixes[0]}.fam")
    parts, offset = [], 0
    for prefix in prefixes:
        if prefix != prefixes[0] and not same_individuals(individuals, read_fam(spark, f"{prefix}.fam")):
            raise ValueError(f"{prefix} lists other individuals than {prefixes[0]}")
        tiles = read_bed(spark, prefix, tile)
        parts.append(tiles.withColumn("variant_id", F.col("variant_id") + offset))
        offset += spark.read.text(f"{prefix}.bim").filter(F.length(F.trim("value")) > 0).count()
    return reduce(DataFrame.unionByName, parts)
