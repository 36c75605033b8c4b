"""Genotype preparation on the tiled layout, for dense matrices.

A variant-major row (variant_id, tile, subject_ids, dosages) holds at most a tile of
subjects. These operators touch the calls once, in Arrow batches, and exchange one
short row per variant instead of one row per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.arrays import changes, combined, flat_lists, list_sums, pieces, to_lists
from locusframe.operators.genotype import frequency_kept


def _tile_counts(tiles: DataFrame) -> DataFrame:
    """(variant_id, cells, called, total, squares) per row of the layout."""
    kind = tiles.schema["variant_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, value, valid = flat_lists(combined(batch, "dosages"))
            sums = [list_sums(counts, v) for v in (valid.astype(float), value, value * value)]
            arrays = [combined(batch, "variant_id"), pa.array(counts.astype(float)), *[pa.array(s) for s in sums]]
            yield pa.RecordBatch.from_arrays(arrays, names=["variant_id", "cells", "called", "total", "squares"])

    schema = f"variant_id {kind}, cells double, called double, total double, squares double"
    return tiles.select("variant_id", "dosages").mapInArrow(count, schema)


def variant_counts(tiles: DataFrame) -> DataFrame:
    """Per variant: cells, called, mean, af and the deviation after mean imputation."""
    sums = [F.sum(c).alias(c) for c in ("cells", "called", "total", "squares")]
    mean = F.try_divide("total", "called")
    # Imputed cells add nothing to the squared deviations.
    spread = F.sqrt(F.greatest(F.col("squares") - mean * F.col("total"), F.lit(0.0)) / F.col("cells"))
    return _tile_counts(tiles).groupBy("variant_id").agg(*sums).select(
        "variant_id",
        F.col("cells").cast("long").alias("cells"),
        F.col("called").cast("long").alias("called"),
        mean.alias("mean"),
        (mean / 2).alias("af"),
        F.when(F.col("called") > 0, spread).alias("std"),
    )


def impute_mean(tiles: DataFrame, rounded: bool = True) -> DataFrame:
    """Fill missing calls with the variant mean; dosages become tinyint if rounded, else double."""
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    names = ["variant_id", "tile", "subject_ids", "dosages"]
    kinds["dosages"] = "array<tinyint>" if rounded else "array<double>"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, value, valid = flat_lists(combined(batch, "dosages"))
            mean = np.repeat(np.asarray(combined(batch, "mean").to_numpy(zero_copy_only=False), float), counts)
            value = np.where(valid, value, mean)
            empty = np.isnan(value)
            filled = np.rint(value) if rounded else value
            kind = pa.int8() if rounded else pa.float64()
            flat = pa.array(np.where(empty, 0, filled).astype(kind.to_pandas_dtype()), kind, mask=empty)
            kept = [combined(batch, c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*kept, to_lists(counts, flat)], names=names)

    means = variant_counts(tiles).select("variant_id", "mean")
    joined = tiles.join(means, "variant_id").select(*names, "mean")
    return joined.mapInArrow(fill, ", ".join(f"{c} {kinds[c]}" for c in names))


def flip_dosage(tiles: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keep mapped variants (variant_id, flip); count the other allele where flip = -1."""
    kind = tiles.schema["dosages"].dataType
    other = F.transform("dosages", lambda d: 2 - d).cast(kind)
    return tiles.join(mapping.select("variant_id", "flip"), "variant_id").select(
        "variant_id", "tile", "subject_ids", F.when(F.col("flip") == -1, other).otherwise(F.col("dosages")).alias("dosages")
    )


def maf_filter(tiles: DataFrame, threshold: float) -> DataFrame:
    """Rows of the variants whose allele frequency passes the threshold."""
    kept = variant_counts(tiles).filter(frequency_kept(F.col("af"), threshold)).select("variant_id")
    return tiles.join(kept, "variant_id", "left_semi")


def transpose(tiles: DataFrame, tile: int) -> DataFrame:
    """Variant-major tiles to subject-major ones: (subject_id, tile, variant_ids, dosages).

    The unit of exchange is a square of `tile` variants by `tile` subjects, turned inside
    one task; cells never travel one by one. A task gets its squares one after the other
    and turns as many at once as hold the cells of a full one, so that a sparse matrix,
    with few cells in each of many squares, costs by its cells.
    """
    subject, variant = (tiles.schema[c].dataType for c in ("subject_ids", "variant_id"))
    dosages = tiles.schema["dosages"].dataType.simpleString()
    schema = (
        f"subject_id {subject.elementType.simpleString()}, tile long, "
        f"variant_ids array<{variant.simpleString()}>, dosages {dosages}"
    )

    def squares(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        return changes(combined(rows, "tile"), combined(rows, "_block"))

    def turn(rows: pa.Table) -> pa.RecordBatch:
        lists, subjects = combined(rows, "dosages"), combined(rows, "subject_ids").flatten()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), counts)
        square = np.searchsorted(squares(rows), row, side="right")
        # The variants of a square come in order, which these stable sorts keep.
        order = np.lexsort((np.asarray(subjects.fill_null(0)), np.asarray(subjects.is_null()), square))
        subjects, square = subjects.take(pa.array(order)), square[order]
        starts = changes(pa.array(square), subjects)
        sizes = np.diff(np.append(starts, len(order)))
        picked = pa.array(row[order])
        return pa.RecordBatch.from_arrays(
            [
                subjects.take(pa.array(starts)),
                combined(rows, "_block").take(pa.array(row[order][starts])),
                to_lists(sizes, combined(rows, "variant_id").take(picked)),
                to_lists(sizes, lists.flatten().take(pa.array(order))),
            ],
            names=["subject_id", "tile", "variant_ids", "dosages"],
        )

    def turn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in pieces(batch, "dosages", tile * tile):
                rows = pa.Table.from_batches([*(held.to_batches() if held else []), piece])
                # The last square may go on in the next piece.
                last = int(squares(rows)[-1]) if len(rows) else 0
                if last:
                    yield turn(rows.slice(0, last))
                held = rows.slice(last)
        if held:
            yield turn(held)

    blocks = tiles.withColumn("_block", F.floor(F.col("variant_id") / tile).cast("long"))
    keys = ["tile", "_block"]
    sorted_squares = blocks.repartition(*keys).sortWithinPartitions(*keys, "variant_id")
    return sorted_squares.mapInArrow(turn_all, schema)
