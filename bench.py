"""Headline timings as one JSON line: BENCH_SF_DIR (tables), BENCH_CPUS (local cores)."""

from __future__ import annotations

import json
import os
import sys
import time

# One core per task: the tasks are the parallelism, not the matrix library.
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import association, genotype
from locusframe.plans import QUERIES
from locusframe.plans.views import Views
from locusframe.session import materialise, tune

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
TILE = 4096
TRAITS = 1000
COVARIATES = ["c0", "c1", "c2"]

HEADLINE = [
    "gwas_dense", "gwas_sparse", "meta_analysis", "impute_mean_rounded", "allele_frequency", "to_subject_major",
    "harmonise_position", "merge_studies", "gene_topology", "layer_forward", "predict", "auc", "connection_weights",
    "importance_rollup", "interaction_profile", "strongest_interactions",
]


def wide_study(v: Views) -> tuple[DataFrame, DataFrame, list[str]]:
    """All parts as variants, the embedded subjects, and 1 000 traits mixed from pairs of coordinates."""
    n = v.table("embeddings").count()
    lines, orders = v.table("lineitem"), v.table("orders")
    cells = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy((F.col("o_custkey") % n).alias("subject_id"), F.col("l_partkey").alias("variant_id"))
        .agg((F.sum("l_linenumber") % 3).cast("tinyint").alias("dosage"))
    )
    mixes = [f"double(embedding[{t % 64}]) * {t // 64 + 1} + double(embedding[{(t + t // 64) % 64}]) AS y{t}" for t in range(TRAITS)]
    covs = ["double(vec_id % 7) AS c0", "double(vec_id * 37 % 11) AS c1", "double(label) AS c2"]
    design = v.table("embeddings").selectExpr("vec_id AS subject_id", *covs, *mixes)
    traits = [f"y{t}" for t in range(TRAITS)]
    packed = association.pack_design(design, COVARIATES, traits)
    return materialise(genotype.to_variant_major(cells, TILE)), packed, traits


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = tune(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.perf_counter()
        run(make())
        timings[name] = round(time.perf_counter() - start, 3)

    # Matrix and traits are prepared beforehand, like converted files.
    tiles, design, traits = wide_study(Views(spark, FOLDER))
    n_variants = tiles.count()
    timed("warm_up", lambda: tiles.mapInArrow(lambda batches: batches, tiles.schema))
    timed(
        "gwas_1000_traits",
        lambda: association.gwas_tiles(
            tiles, design, COVARIATES, traits, TILE, sparse=True, threshold=0.0, n_variants=n_variants
        ),
    )
    rate = n_variants * TRAITS / timings["gwas_1000_traits"]
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, FOLDER))
    timings.pop("warm_up")
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "tests_per_sec": round(rate),
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
