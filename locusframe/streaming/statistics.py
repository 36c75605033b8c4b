"""Pooling sufficient statistics while studies and workers deliver them.

Statistics add up, so a running grouped sum over the arriving files replaces
waiting until every part is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving_statistics(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Stream over the parquet files of `folder`, each read once."""
    return spark.readStream.schema(schema).parquet(folder)


def pooled_statistics(arriving: DataFrame) -> DataFrame:
    """Running sums per variant and how many parts (study, variant) have arrived."""
    columns = [c for c in arriving.columns if c not in ("study", "variant_id")]
    return arriving.groupBy("variant_id").agg(
        *[F.sum(c).alias(c) for c in columns], F.count(F.lit(1)).alias("studies")
    )


def pool_arrived(arriving: DataFrame, target: str, checkpoint: str) -> None:
    """Fold everything that has arrived into the table folder `target`, then stop.

    Every run rewrites the pooled table of its last micro-batch under a batch number.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        pooled_statistics(arriving).writeStream.outputMode("complete").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def latest_pool(spark: SparkSession, target: str) -> DataFrame:
    """The newest pooled table."""
    pools = spark.read.parquet(target)
    newest = pools.agg(F.max("batch")).first()[0]
    return pools.filter(F.col("batch") == newest).drop("batch")
