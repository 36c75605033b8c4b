"""Arrow list columns as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def combined(rows: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = rows.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of every list, all values as doubles with 0 for missing, which are present).

    A value stored as not-a-number is missing like a null.
    """
    flat = lists.flatten()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    value = np.asarray(flat.fill_null(0)).astype(float)
    valid = np.asarray(flat.is_valid()) & ~np.isnan(value)
    return counts, np.where(valid, value, 0.0), valid


def list_sums(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of every list."""
    return np.bincount(np.repeat(np.arange(len(counts)), counts), weights=values, minlength=len(counts))


def to_lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of the given lengths over flat values."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def pieces(rows: pa.RecordBatch, lists: str, cells: int) -> Iterator[pa.RecordBatch]:
    """Slices of `rows` whose lists hold about `cells` values: fewer than twice as many, or one row."""
    counts = combined(rows, lists).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(counts, dtype=np.int64) // cells
    starts = np.append(0, np.flatnonzero(np.diff(part)) + 1)
    for start, end in zip(starts, [*starts[1:], len(counts)], strict=True):
        yield rows.slice(start, end - start)


def changes(*columns: pa.Array) -> np.ndarray:
    """Positions where numbers differ from the row before, with the first position; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        missing, value = np.asarray(column.is_null()), np.asarray(column.fill_null(0))
        new[1:] |= (missing[1:] != missing[:-1]) | (value[1:] != value[:-1])
    return np.flatnonzero(new)
