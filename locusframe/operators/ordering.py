"""Global ranks and running totals that never sort the table in one task.

`row_number() over (order by …)` without a partition pulls every row into one
task. Here the rows are range-partitioned, numbered inside each partition and
shifted by the sizes of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import materialise

# monotonically_increasing_id() keeps the row position in the low 33 bits.
_ROW_BITS = 33


def _part_offsets(parts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over the partition numbers (one row per partition and key)."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(
        *keys,
        "_part",
        *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    out: str = "row_no",
    by: Sequence[str] = (),
    start: int = 0,
) -> DataFrame:
    """Add consecutive numbers from `start` in the given order, restarting per `by` group.

    `order` must be unique inside a group for a reproducible result. A group of
    any size is spread over as many range partitions as it needs.
    """
    by = list(by)
    keys = [*by, *order]
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    held = (
        materialise(ranged)
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    # One number per range partition comes to the driver and goes back as a constant.
    sizes = {r._part: r.n for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    offsets = F.expr(f"array({', '.join(f'{s}L' for s in starts)})")
    placed = held.withColumn("_at", F.col("_row") + offsets[F.col("_part").cast("int")])
    if by:
        group = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by]
        first = placed.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.min("_at").alias("_first"))
        placed = placed.join(first, group).withColumn("_at", F.col("_at") - F.col("_first"))
    return placed.select(*df.columns, (F.col("_at") + F.lit(start)).cast("long").alias(out))


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    totals: dict[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums `totals[name]` in the given order, per `by` group."""
    by = list(by)
    names = list(totals)
    ranged = (
        df.select("*", *[totals[n].alias(f"_v_{n}") for n in names])
        .repartitionByRange(*by, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    held = materialise(ranged)
    keys = [*by, "_part"]
    parts = held.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        held.join(_part_offsets(parts, by, names), keys)
        .select(
            *df.columns,
            *[(F.sum(f"_v_{n}").over(upto) + F.col(f"_before_{n}")).alias(n) for n in names],
        )
    )


def index_values(df: DataFrame, column: str, out: str, start: int = 0) -> DataFrame:
    """Distinct values of `column` with their sorted position."""
    return number_rows(df.select(column).distinct(), [column], out, start=start)


def seeded_order(column: str | Column, seed: int) -> Column:
    """Reproducible pseudo-random key below 2^32 of an integer id.

    A product with the seed added only turns the ring of ids, so two rounds of
    shift, exclusive or and product follow it; all steps stay below 2^63.
    """
    id_ = F.col(column) if isinstance(column, str) else column
    key = (F.pmod(id_.cast("long"), F.lit(2147483647)) * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)
    for _ in range(2):
        key = key.bitwiseXOR(F.shiftright(key, 15)) * F.lit(1540483477) % F.lit(4294967296)
    return key
