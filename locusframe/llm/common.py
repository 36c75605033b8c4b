"""Text and join helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. `lower` does the same, faster, where a text is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def within(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than one above."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, marked for broadcast if it has at most `rows` rows; else an ordinary join side."""
    return F.broadcast(df) if within(df, rows) else df


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def slices(batches, rows: int = 400):
    """Arrow batches cut to `rows` rows, so that a task holds few long texts and results at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back() -> None:
    """Return freed memory to the system: a Python worker serves many tasks and else holds the most that any one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def tidy(task):
    """The Arrow task function `task`, giving memory back after each partition."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        give_back()

    return run


def prepare(spark: SparkSession) -> None:
    """Make checkpoint() write to the shared folder, and let few long texts cross to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
