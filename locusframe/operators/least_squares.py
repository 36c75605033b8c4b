"""Least squares of one target on the columns of many groups at once, with the rank of each group.

Tall-skinny QR: rows of a group are cut into blocks, each block is reduced to its triangular factor,
and factors are stacked and reduced again in a tree until one is left. Its singular values tell the
rank, and the part of the target that lies in the span of the columns. A group with more columns than
rows is factored by its transpose. No block, factor or message is larger than a few times
min(rows, columns) squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import materialise

#: Largest min(rows, columns) of a group: a factor then has 134 MB.
WIDEST = 4096
#: Rows of a block, at least.
BLOCK = 512
#: Factors that one task of the tree stacks.
FAN_IN = 4

_FACTOR = "group long, block long, width int, factor binary"


def _reduced(matrix: np.ndarray) -> bytes:
    if matrix.shape[0] > matrix.shape[1]:
        matrix = np.linalg.qr(matrix, mode="r")
    return np.ascontiguousarray(matrix, np.float64).tobytes()


def _factor_row(key, width: int, factor: bytes) -> pa.Table:
    return pa.table({"group": [key[0].as_py()], "block": [key[1].as_py()], "width": pa.array([width], pa.int32()), "factor": pa.array([factor], pa.binary())})


def _block_factor(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
    """Triangular factor of the rows of a block; `place` is the column, unlisted cells are 0."""
    width = cells["width"][0].as_py()
    _, row = np.unique(cells["unit"].to_numpy(), return_inverse=True)
    matrix = np.zeros((row.max() + 1, width))
    matrix[row, cells["place"].to_numpy()] = cells["value"].to_numpy()
    return _factor_row(key, width, _reduced(matrix))


def _stacked_factor(key: tuple[pa.Scalar, ...], factors: pa.Table) -> pa.Table:
    width = factors["width"][0].as_py()
    return _factor_row(key, width, _reduced(np.vstack([np.frombuffer(f, np.float64).reshape(-1, width) for f in factors["factor"].to_pylist()])))


def factors(cells: DataFrame, blocks: Column) -> DataFrame:
    """(group, width, factor): R of each group's matrix. `cells` is (group, unit, place, value, width)."""
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("unit"), blocks))
    found = materialise(dealt.groupBy("group", "block").applyInArrow(_block_factor, _FACTOR))
    while (found.agg(F.max("block")).first()[0] or 0) > 0:
        above = found.withColumn("block", F.floor(F.col("block") / FAN_IN))
        found = materialise(above.groupBy("group", "block").applyInArrow(_stacked_factor, _FACTOR))
    return found.select("group", "width", "factor")


def _span(singular: np.ndarray, size: int) -> np.ndarray:
    """Which singular values are not rounding."""
    return singular > (singular.max(initial=0.0) * size * np.finfo(float).eps)


def _tall_fit(rows: int):
    """Rank and explained sum of squares from R of [columns, target]."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for group, width, factor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = np.frombuffer(factor, np.float64).reshape(-1, width)
                u, s, _ = np.linalg.svd(r[:, :-1], full_matrices=False)
                held = _span(s, max(rows, width))
                out[0].append(group), out[1].append(int(held.sum())), out[2].append(float(np.sum((u[:, held].T @ r[:, -1]) ** 2)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["group", "rank", "explained"])

    return run


def _wide_fit(target: np.ndarray):
    """Rank and explained sum of squares from R of the transposed columns."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for group, width, factor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = np.frombuffer(factor, np.float64).reshape(-1, width)
                _, s, v = np.linalg.svd(r, full_matrices=False)
                held = _span(s, max(len(target), width))
                out[0].append(group), out[1].append(int(held.sum())), out[2].append(float(np.sum((v[held] @ target) ** 2)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["group", "rank", "explained"])

    return run


def joint_least_squares(cells: DataFrame, target: DataFrame) -> tuple[DataFrame, int, float]:
    """(group, columns, rank, explained) of each group, the number of rows, and the target's sum of squares.

    `cells` is (group, row, column, value), a cell at most once, unlisted ones 0; `target` is (row, y).
    Rows without a target, and cells of them, do not count. rank and explained are null where both
    rows and columns exceed WIDEST.
    """
    target = materialise(target.select("row", F.col("y").cast("double").alias("y")).where("y IS NOT NULL"))
    rows, total = target.agg(F.count("*"), F.sum(F.col("y") * F.col("y"))).first()
    total = float(total or 0.0)
    cells = cells.join(target, "row")
    place = F.row_number().over(Window.partitionBy("group").orderBy("column")) - 1
    columns = cells.select("group", "column").distinct().withColumn("place", place)
    sizes = columns.groupBy("group").agg(F.count("*").alias("columns"))
    placed = materialise(cells.join(columns, ["group", "column"]).join(sizes, "group"))
    tall = placed.where((F.col("columns") <= rows) & (F.col("columns") <= WIDEST))
    width = (F.col("columns") + 1).cast("int")
    blocks = F.greatest(F.lit(1), F.floor(F.lit(rows) / F.greatest(F.lit(BLOCK), 2 * F.col("width"))))
    own = tall.select("group", F.col("row").alias("unit"), F.col("place").cast("int").alias("place"), F.col("value").cast("double").alias("value"), width.alias("width"))
    targets = tall.select("group", F.col("row").alias("unit"), F.col("columns").cast("int").alias("place"), F.col("y").alias("value"), width.alias("width")).distinct()
    fit = "group long, rank long, explained double"
    found = factors(own.unionByName(targets), blocks).select("group", "width", "factor").mapInArrow(_tall_fit(rows), fit)
    if rows <= WIDEST:  # then at most WIDEST targets come to the driver
        order = sorted(target.collect(), key=lambda r: r.row)
        numbered = target.sparkSession.createDataFrame([(r.row, i) for i, r in enumerate(order)], f"row {target.schema['row'].dataType.simpleString()}, at int")
        wide = placed.where(F.col("columns") > rows).join(numbered, "row")
        turned = wide.select("group", F.col("column").alias("unit"), F.col("at").alias("place"), F.col("value").cast("double").alias("value"), F.lit(rows).cast("int").alias("width"), "columns")
        by_columns = F.greatest(F.lit(1), F.floor(F.col("columns") / F.greatest(F.lit(BLOCK), 2 * F.col("width"))))
        found = found.unionByName(factors(turned, by_columns).select("group", "width", "factor").mapInArrow(_wide_fit(np.array([r.y for r in order])), fit))
    return sizes.join(found, "group", "left"), rows, total
