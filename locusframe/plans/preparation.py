"""Genotype preparation queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import genotype as g
from locusframe.operators import tiles as t
from locusframe.plans.registry import query, r6, sql6
from locusframe.plans.views import Views
from locusframe.session import intermediates
from locusframe.sources import sinks


@query("genotype", """
    SELECT subject_id, CAST(variant_id AS BIGINT) AS variant_row, CAST(round_even(dosage * 0.75e0, 0) AS INT) AS dosage FROM genotype""")
def merge_shards(v: Views) -> DataFrame:
    cells = v.genotype.select("subject_id", F.col("variant_id").alias("variant_row"), (F.col("dosage") * 0.75).alias("dosage"))
    first = cells.filter("variant_row < 32")
    second = cells.filter("variant_row >= 32").withColumn("variant_row", F.col("variant_row") - 32)
    return g.merge_shards([first, second])


@query("genotype_missing", """
    SELECT subject_id, variant_id,
           CAST(round_even(coalesce(dosage, avg(dosage) OVER (PARTITION BY variant_id)), 0) AS INT) AS dosage FROM genotype_missing""")
def impute_mean_rounded(v: Views) -> DataFrame:
    return g.impute_mean(v.genotype_missing)


@query("genotype_missing", f"""
    SELECT subject_id, variant_id,
           {sql6("coalesce(CAST(dosage AS DOUBLE), avg(dosage) OVER (PARTITION BY variant_id))")} AS dosage FROM genotype_missing""")
def impute_mean_exact(v: Views) -> DataFrame:
    return g.impute_mean(v.genotype_missing, rounded=False).withColumn("dosage", r6("dosage"))


@query("genotype_missing", f"""
    SELECT variant_id, {sql6("stddev_pop(x)")} AS std
    FROM (SELECT variant_id, coalesce(CAST(dosage AS DOUBLE), avg(dosage) OVER (PARTITION BY variant_id)) AS x FROM genotype_missing)
    GROUP BY variant_id""")
def variant_std(v: Views) -> DataFrame:
    return g.variant_std(v.genotype_missing).select("variant_id", r6("std").alias("std"))


@query("genotype", """
    SELECT subject_id, variant_id, dosage, dense_rank() OVER (ORDER BY variant_id) - 1 AS variant_row
    FROM genotype WHERE variant_id % 3 <> 1""")
def select_variants_matrix(v: Views) -> DataFrame:
    flags = v.genotype.select("variant_id").distinct().withColumn("keep", F.col("variant_id") % 3 != 1)
    return g.select_variants(v.genotype, flags, n_variants=v.genotype.select("variant_id").distinct().count())


@query("variant", """
    SELECT variant_id, chr, bp, allele1, allele2, row_number() OVER (ORDER BY variant_id) - 1 AS variant_row
    FROM variant WHERE bp % 4 <> 0""")
def select_variants_table(v: Views) -> DataFrame:
    flags = v.variant.select("variant_id", (F.col("bp") % 4 != 0).alias("keep"))
    return g.select_variants(v.variant, flags, n_variants=v.variant.count())


@query("genotype_sparse customer_design", """
    SELECT subject_id, variant_id, dosage FROM genotype_sparse
    WHERE subject_id NOT IN (SELECT subject_id FROM customer_design WHERE balance < 0)""")
def remove_subjects(v: Views) -> DataFrame:
    return g.remove_subjects(v.genotype_sparse, v.customer_design.filter("balance < 0"))


@query("genotype_sparse", f"SELECT variant_id, {sql6('avg(dosage) / 2')} AS af FROM genotype_sparse GROUP BY variant_id")
def allele_frequency(v: Views) -> DataFrame:
    return g.allele_frequency(v.genotype_sparse).select("variant_id", r6("af").alias("af"))


@query("genotype_sparse", """
    SELECT s.* FROM genotype_sparse s JOIN (SELECT variant_id, avg(dosage) / 2 AS af FROM genotype_sparse GROUP BY variant_id) f
    USING (variant_id) WHERE af > 0.4e0 AND af < 0.6e0 AND af <> 0.5e0""")
def maf_filter(v: Views) -> DataFrame:
    return g.maf_filter(v.genotype_sparse, 0.4)


@query("genotype_missing", """
    SELECT subject_id, variant_id, CAST(coalesce(dosage = 0, false) AS INT) AS class_0,
           CAST(coalesce(dosage = 1, false) AS INT) AS class_1, CAST(coalesce(dosage = 2, false) AS INT) AS class_2 FROM genotype_missing""")
def one_hot(v: Views) -> DataFrame:
    hot = g.one_hot(v.genotype_missing)
    return hot.select("subject_id", "variant_id", *[F.col("classes")[k].alias(f"class_{k}") for k in (0, 1, 2)])


@query("genotype subject", """
    SELECT subject_id, variant_id, dosage * cov_1 AS dosage FROM genotype JOIN subject USING (subject_id)""")
def genotype_interaction(v: Views) -> DataFrame:
    return g.interaction(v.genotype, v.subject.select("subject_id", F.col("cov_1").alias("factor")))


@query("genotype", """
    SELECT subject_id, variant_id, CASE WHEN variant_id % 4 = 0 THEN 2 - dosage ELSE dosage END AS dosage
    FROM genotype WHERE variant_id % 5 <> 0""")
def flip_dosage(v: Views) -> DataFrame:
    mapping = v.genotype.select("variant_id").distinct().filter("variant_id % 5 <> 0")
    return g.flip_dosage(v.genotype, mapping.withColumn("flip", F.when(F.col("variant_id") % 4 == 0, -1).otherwise(1)))


@query("variant", "SELECT * FROM variant WHERE chr < 23 AND bp IS NOT NULL")
def autosomal_variants(v: Views) -> DataFrame:
    return g.autosomal(v.variant, required=["bp"])


@query("genotype", """
    SELECT subject_id, CAST(max(CASE WHEN (v0 = 2 AND v1 = 0) OR (v2 = 1 AND v3 = 1 AND v4 <> 0) THEN 1 ELSE 0 END) AS INT) AS label
    FROM (SELECT subject_id, max(dosage) FILTER (variant_id = 0) AS v0, max(dosage) FILTER (variant_id = 1) AS v1,
                 max(dosage) FILTER (variant_id = 2) AS v2, max(dosage) FILTER (variant_id = 3) AS v3,
                 max(dosage) FILTER (variant_id = 4) AS v4 FROM genotype GROUP BY subject_id)
    GROUP BY subject_id""")
def label_by_rules(v: Views) -> DataFrame:
    rules = [(0, 0, 2), (0, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (2, 2, 1), (2, 3, 1), (2, 4, 2)]
    return g.label_by_rules(v.genotype, v.spark.createDataFrame(rules, "rule_id int, variant_id int, value int"))


@query("genotype_sparse", """
    SELECT subject_id, variant_id // 512 AS tile, string_agg(variant_id, ',' ORDER BY variant_id) AS variants,
           string_agg(dosage, ',' ORDER BY variant_id) AS dosages FROM genotype_sparse GROUP BY 1, 2""")
def to_subject_major(v: Views) -> DataFrame:
    return g.to_subject_major(v.genotype_sparse, tile=512).select(
        "subject_id", "tile", F.array_join("variant_ids", ",").alias("variants"), F.array_join("dosages", ",").alias("dosages")
    )


@query("genotype_missing", f"""
    SELECT variant_id, count(*) AS cells, count(dosage) AS called, {sql6('avg(dosage)')} AS mean, {sql6('avg(dosage) / 2')} AS af,
           {sql6('stddev_pop(dosage) * sqrt(count(dosage) / count(*))')} AS std FROM genotype_missing GROUP BY variant_id""")
def tile_variant_counts(v: Views) -> DataFrame:
    counts = t.variant_counts(g.to_variant_major(v.genotype_missing, tile=128))
    return counts.select("variant_id", "cells", "called", *[r6(c).alias(c) for c in ("mean", "af", "std")])


@query("genotype_missing", """
    SELECT subject_id, variant_id,
           CAST(round_even(coalesce(dosage, avg(dosage) OVER (PARTITION BY variant_id)), 0) AS INT) AS dosage FROM genotype_missing""")
def tile_impute_mean(v: Views) -> DataFrame:
    filled = t.impute_mean(g.to_variant_major(v.genotype_missing, tile=128))
    cells = g.from_tiles(filled, "variant_id", "subject_id", "subject_ids")
    return cells.select("subject_id", "variant_id", F.col("dosage").cast("int").alias("dosage"))


@query("genotype_missing", """
    SELECT variant_id, subject_id, CASE WHEN variant_id % 4 = 0 THEN 2 - dosage ELSE dosage END AS dosage
    FROM genotype_missing JOIN (SELECT variant_id, avg(dosage) / 2 AS af FROM genotype_missing GROUP BY variant_id) USING (variant_id)
    WHERE af > 0.48e0 AND af < 0.52e0 AND af <> 0.5e0""")
def tile_filter_and_flip(v: Views) -> DataFrame:
    kept = t.maf_filter(g.to_variant_major(v.genotype_missing, tile=128), 0.48)
    mapping = v.genotype.select("variant_id").distinct().withColumn("flip", F.when(F.col("variant_id") % 4 == 0, -1).otherwise(1))
    return g.from_tiles(t.flip_dosage(kept, mapping), "variant_id", "subject_id", "subject_ids")


@query("genotype_sparse", """
    SELECT subject_id, variant_id // 512 AS tile, string_agg(variant_id, ',' ORDER BY variant_id) AS variants,
           string_agg(dosage, ',' ORDER BY variant_id) AS dosages FROM genotype_sparse GROUP BY 1, 2""")
def tile_transpose(v: Views) -> DataFrame:
    turned = t.transpose(g.to_variant_major(v.genotype_sparse, tile=512), 512)
    return turned.select(
        "subject_id", "tile", F.array_join("variant_ids", ",").alias("variants"), F.array_join("dosages", ",").alias("dosages")
    )


@query("genotype_sparse", """
    SELECT variant_id, subject_id // 512 AS tile, string_agg(subject_id, ',' ORDER BY subject_id) AS subjects,
           string_agg(dosage, ',' ORDER BY subject_id) AS dosages FROM genotype_sparse GROUP BY 1, 2""")
def to_variant_major(v: Views) -> DataFrame:
    return g.to_variant_major(v.genotype_sparse, tile=512).select(
        "variant_id", "tile", F.array_join("subject_ids", ",").alias("subjects"), F.array_join("dosages", ",").alias("dosages")
    )


@query("genotype_missing", "SELECT CAST(sum(dosage) AS DOUBLE) AS left_sum, CAST(sum(dosage) AS DOUBLE) AS right_sum, true AS equal FROM genotype_missing")
def layout_checksum(v: Views) -> DataFrame:
    return g.checksum(v.genotype_missing, g.from_tiles(g.to_subject_major(v.genotype_missing)))


@query("genotype_sparse variant customer_design", """
    SELECT mv AS matrix_variants, ms AS matrix_subjects, vs AS variants, ss AS subjects, vs = mv AND ss = ms AS consistent
    FROM (SELECT (SELECT count(DISTINCT variant_id) FROM genotype_sparse) AS mv,
                 (SELECT count(DISTINCT subject_id) FROM genotype_sparse) AS ms,
                 (SELECT count(*) FROM variant) AS vs, (SELECT count(*) FROM customer_design) AS ss)""")
def conversion_audit(v: Views) -> DataFrame:
    return g.audit(v.genotype_sparse, v.variant, v.customer_design)


@query("genotype_sparse", "SELECT subject_id, variant_id, dosage FROM genotype_sparse")
def genotype_written_in_tiles(v: Views) -> DataFrame:
    path = f"{intermediates(v.spark)}/{uuid.uuid4().hex}"
    sinks.write_genotype(v.genotype_sparse, path, layout="subject", tile=512)
    return g.from_tiles(v.spark.read.parquet(path)).select("subject_id", "variant_id", "dosage")
