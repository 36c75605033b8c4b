"""Genotype tables derived from the given tables, in Spark and in SQL for the checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.ordering import index_values
from locusframe.session import materialise

TRAITS = ["label_reg", "cov_2", "label_bin"]


class Views:
    """The derived tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def genotype(self) -> DataFrame:
        """Dense cells from the embedding coordinates."""
        cells = self.table("embeddings").select(
            F.col("vec_id").alias("subject_id"), F.posexplode("embedding").alias("variant_id", "x")
        )
        x = F.col("x").cast("double")
        return cells.select(
            "subject_id", "variant_id", F.when(x < -0.05, 0).when(x < 0.05, 1).otherwise(2).alias("dosage")
        )

    @cached_property
    def genotype_missing(self) -> DataFrame:
        gap = (F.col("subject_id") * 31 + F.col("variant_id") * 17) % 101 == 0
        return self.genotype.withColumn("dosage", F.when(~gap, F.col("dosage")))

    @cached_property
    def genotype_sparse(self) -> DataFrame:
        """Large cells from orders: customers by parts."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("subject_id"), F.col("l_partkey").alias("variant_id"))
            .agg((F.sum("l_linenumber") % 3).cast("int").alias("dosage"))
        )

    @cached_property
    def variant(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS variant_row",
            "p_partkey % 22 + 1 AS chr",
            "p_partkey * 1000 + p_size AS bp",
            "concat('rs', p_partkey) AS variant_id",
            "substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS allele1",
            "substr('ACGT', CAST((p_partkey + 1 + p_size % 3) % 4 + 1 AS INT), 1) AS allele2",
        )

    @cached_property
    def refpanel(self) -> DataFrame:
        return self.variant.filter("variant_row % 10 <> 0").selectExpr(
            "variant_id",
            "chr",
            "bp",
            "CASE WHEN variant_row % 3 = 0 THEN allele2 ELSE allele1 END AS allele1",
            "CASE WHEN variant_row % 3 = 0 THEN allele1 WHEN variant_row % 7 = 0 THEN 'N' ELSE allele2 END AS allele2",
        )

    @cached_property
    def topology(self) -> DataFrame:
        """Paths variant (part) -> gene (brand) -> pathway."""
        part = self.table("part")
        genes = index_values(part, "p_brand", "layer1_node").withColumnRenamed("p_brand", "layer1_name")
        return part.join(genes, F.col("p_brand") == F.col("layer1_name")).select(
            F.col("p_partkey").alias("layer0_node"),
            F.concat(F.lit("rs"), "p_partkey").alias("layer0_name"),
            "layer1_node",
            "layer1_name",
            (F.col("layer1_node") % 6).alias("layer2_node"),
            F.concat(F.lit("path"), F.col("layer1_node") % 6).alias("layer2_name"),
        )

    @cached_property
    def w0(self) -> DataFrame:
        return self.topology.select(
            F.lit(0).alias("layer"),
            F.col("layer0_node").alias("src"),
            F.col("layer1_node").alias("dst"),
            ((F.col("layer0_node") * 7919 % 2001 - 1000) / 1000.0).alias("w"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        """Edge weights of all layers of `topology` and into the score."""
        genes = self.topology.select("layer1_node", "layer2_node").distinct()
        w1 = genes.select(
            F.lit(1).alias("layer"),
            F.col("layer1_node").alias("src"),
            F.col("layer2_node").alias("dst"),
            ((F.col("layer1_node") * 37 % 19 - 9) / 10.0).alias("w"),
        )
        w2 = genes.select("layer2_node").distinct().select(
            F.lit(2).alias("layer"),
            F.col("layer2_node").alias("src"),
            F.lit(0).cast("long").alias("dst"),
            ((F.col("layer2_node") * 5 % 7 - 2.5) / 4.0).alias("w"),
        )
        return materialise(self.w0.unionByName(w1).unionByName(w2))

    @cached_property
    def bias(self) -> DataFrame:
        nodes = self.weights.select("layer", F.col("dst").alias("node")).distinct()
        return nodes.withColumn("b", (F.col("node") % 5 - 2) / 10.0)

    @cached_property
    def small_topology(self) -> DataFrame:
        """Paths over the coordinates of the dense genotype."""
        nodes = self.genotype.select("variant_id").distinct().select(F.col("variant_id").cast("long").alias("layer0_node"))
        return nodes.select(
            "layer0_node",
            F.expr("layer0_node % 8").alias("layer1_node"),
            F.expr("layer0_node % 8 % 2").alias("layer2_node"),
        )

    @cached_property
    def small_weights(self) -> DataFrame:
        paths = self.small_topology
        w0 = paths.selectExpr("0 AS layer", "layer0_node AS src", "layer1_node AS dst", "(layer0_node * 29 % 41 - 20) / 50.0e0 AS w")
        w1 = paths.selectExpr("1 AS layer", "layer1_node AS src", "layer2_node AS dst", "(layer1_node * 3 % 7 - 2.5e0) / 5.0e0 AS w").distinct()
        w2 = paths.selectExpr("2 AS layer", "layer2_node AS src", "CAST(0 AS BIGINT) AS dst", "layer2_node * 0.8e0 - 0.3e0 AS w").distinct()
        return materialise(w0.unionByName(w1).unionByName(w2))

    @cached_property
    def small_bias(self) -> DataFrame:
        nodes = self.small_weights.select("layer", F.col("dst").alias("node")).distinct()
        return materialise(nodes.withColumn("b", (F.col("node") % 3 - 1) / 10.0))

    @cached_property
    def prediction(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS subject_id",
            "c_nationkey % 2 AS y",
            "round(1.0e0 / (1.0e0 + exp(-(c_acctbal - 4500.0e0) / 2000.0e0)), 6) AS p",
        )

    @cached_property
    def subject(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS subject_id",
            "vec_id AS genotype_row",
            "CAST(label AS DOUBLE) AS label_reg",
            "CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label_bin",
            "CAST(vec_id % 7 AS DOUBLE) AS cov_1",
            "CAST(vec_id * 37 % 11 AS DOUBLE) AS cov_2",
            "CASE WHEN vec_id % 10 < 6 THEN 1 WHEN vec_id % 10 < 8 THEN 2 ELSE 3 END AS set_id",
            "vec_id % 3 AS study",
        )

    @cached_property
    def trait(self) -> DataFrame:
        """Long traits of `subject`."""
        return self.subject.withColumn("label_bin", F.col("label_bin").cast("double")).unpivot(
            ["subject_id"], TRAITS, "trait", "value"
        )

    @cached_property
    def customer_design(self) -> DataFrame:
        """Design rows for the sparse genotype."""
        return self.table("customer").selectExpr(
            "c_custkey AS subject_id",
            "CAST(c_nationkey AS DOUBLE) AS nation",
            "c_acctbal AS balance",
            "CAST(c_custkey % 13 AS DOUBLE) AS score",
        )

    @cached_property
    def annotation(self) -> DataFrame:
        """Annotator rows with decorated gene names."""
        return self.table("part").selectExpr(
            "'intronic' AS region",
            "CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '(dist=', p_size, '),OTHER') WHEN 1 THEN 'NONE'"
            " WHEN 2 THEN concat(p_brand, ';X') WHEN 3 THEN concat(p_brand, ',Y') ELSE p_brand END AS gene",
            "CAST(p_partkey % 22 + 1 AS INT) AS chr",
            "p_partkey * 1000 + p_size AS bps",
            "p_partkey * 1000 + p_size AS bpe",
            "'A' AS mutation1",
            "'C' AS mutation2",
            "CAST(p_partkey AS INT) AS index_col",
        )

    @cached_property
    def pathways(self) -> DataFrame:
        """Gene lists by part size; a size has at most the 25 brands."""
        return (
            self.table("part").groupBy("p_size").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("hgnc_symbol_ids"))
            .selectExpr(
                "CASE WHEN p_size % 7 = 0 THEN 'Other' ELSE 'KEGG' END AS source",
                "CASE WHEN p_size % 11 = 0 THEN 'unknown' ELSE concat('path:hsa', lpad(CAST(p_size AS STRING), 5, '0')) END AS external_id",
                "hgnc_symbol_ids",
            )
        )

    @cached_property
    def hierarchy(self) -> DataFrame:
        return self.table("part").filter("p_size % 13 <> 0").select("p_size").distinct().selectExpr(
            "p_size AS hsaid",
            "concat('local', p_size) AS local",
            "p_size - 1 AS local_id",
            "p_size % 7 AS mid_id",
            "p_size % 7 % 3 AS global_id",
        )


# name -> (views it needs, SQL)
VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "genotype": ([], """
        SELECT subject_id, variant_id, CASE WHEN x < -0.05e0 THEN 0 WHEN x < 0.05e0 THEN 1 ELSE 2 END AS dosage
        FROM (SELECT vec_id AS subject_id, unnest(range(len(embedding)))::INT AS variant_id,
                     unnest(embedding)::DOUBLE AS x FROM embeddings)"""),
    "genotype_missing": (["genotype"], """
        SELECT subject_id, variant_id,
               CASE WHEN (subject_id * 31 + variant_id * 17) % 101 = 0 THEN NULL ELSE dosage END AS dosage FROM genotype"""),
    "genotype_sparse": ([], """
        SELECT o_custkey AS subject_id, l_partkey AS variant_id, CAST(sum(l_linenumber) % 3 AS INT) AS dosage
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey"""),
    "variant": ([], """
        SELECT p_partkey AS variant_row, p_partkey % 22 + 1 AS chr, p_partkey * 1000 + p_size AS bp,
               concat('rs', p_partkey) AS variant_id, substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS allele1,
               substr('ACGT', CAST((p_partkey + 1 + p_size % 3) % 4 + 1 AS INT), 1) AS allele2 FROM part"""),
    "refpanel": (["variant"], """
        SELECT variant_id, chr, bp, CASE WHEN variant_row % 3 = 0 THEN allele2 ELSE allele1 END AS allele1,
               CASE WHEN variant_row % 3 = 0 THEN allele1 WHEN variant_row % 7 = 0 THEN 'N' ELSE allele2 END AS allele2
        FROM variant WHERE variant_row % 10 <> 0"""),
    "topology": ([], """
        SELECT p_partkey AS layer0_node, concat('rs', p_partkey) AS layer0_name,
               dense_rank() OVER (ORDER BY p_brand) - 1 AS layer1_node, p_brand AS layer1_name,
               (dense_rank() OVER (ORDER BY p_brand) - 1) % 6 AS layer2_node,
               concat('path', (dense_rank() OVER (ORDER BY p_brand) - 1) % 6) AS layer2_name FROM part"""),
    "weights": (["topology"], """
        SELECT 0 AS layer, layer0_node AS src, layer1_node AS dst, (layer0_node * 7919 % 2001 - 1000) / 1000.0e0 AS w FROM topology
        UNION ALL SELECT DISTINCT 1, layer1_node, layer2_node, (layer1_node * 37 % 19 - 9) / 10.0e0 FROM topology
        UNION ALL SELECT DISTINCT 2, layer2_node, 0, (layer2_node * 5 % 7 - 2.5e0) / 4.0e0 FROM topology"""),
    "bias": (["weights"], """
        SELECT layer, dst AS node, (dst % 5 - 2) / 10.0e0 AS b FROM (SELECT DISTINCT layer, dst FROM weights)"""),
    "small_topology": (["genotype"], """
        SELECT variant_id AS layer0_node, variant_id % 8 AS layer1_node, variant_id % 8 % 2 AS layer2_node
        FROM (SELECT DISTINCT variant_id FROM genotype)"""),
    "small_weights": (["small_topology"], """
        SELECT 0 AS layer, layer0_node AS src, layer1_node AS dst, (layer0_node * 29 % 41 - 20) / 50.0e0 AS w FROM small_topology
        UNION ALL SELECT DISTINCT 1, layer1_node, layer2_node, (layer1_node * 3 % 7 - 2.5e0) / 5.0e0 FROM small_topology
        UNION ALL SELECT DISTINCT 2, layer2_node, 0, layer2_node * 0.8e0 - 0.3e0 FROM small_topology"""),
    "small_bias": (["small_weights"], """
        SELECT layer, dst AS node, (dst % 3 - 1) / 10.0e0 AS b FROM (SELECT DISTINCT layer, dst FROM small_weights)"""),
    "prediction": ([], """
        SELECT c_custkey AS subject_id, c_nationkey % 2 AS y,
               round(1.0e0 / (1.0e0 + exp(-(c_acctbal - 4500.0e0) / 2000.0e0)), 6) AS p FROM customer"""),
    "subject": ([], """
        SELECT vec_id AS subject_id, vec_id AS genotype_row, CAST(label AS DOUBLE) AS label_reg,
               CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label_bin, CAST(vec_id % 7 AS DOUBLE) AS cov_1,
               CAST(vec_id * 37 % 11 AS DOUBLE) AS cov_2,
               CASE WHEN vec_id % 10 < 6 THEN 1 WHEN vec_id % 10 < 8 THEN 2 ELSE 3 END AS set_id, vec_id % 3 AS study
        FROM embeddings"""),
    "trait": (["subject"], """
        SELECT subject_id, 'label_reg' AS trait, label_reg AS value FROM subject
        UNION ALL SELECT subject_id, 'cov_2', cov_2 FROM subject
        UNION ALL SELECT subject_id, 'label_bin', CAST(label_bin AS DOUBLE) FROM subject"""),
    "customer_design": ([], """
        SELECT c_custkey AS subject_id, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance,
               CAST(c_custkey % 13 AS DOUBLE) AS score FROM customer"""),
    "annotation": ([], """
        SELECT 'intronic' AS region,
               CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '(dist=', p_size, '),OTHER') WHEN 1 THEN 'NONE'
                    WHEN 2 THEN concat(p_brand, ';X') WHEN 3 THEN concat(p_brand, ',Y') ELSE p_brand END AS gene,
               CAST(p_partkey % 22 + 1 AS INT) AS chr, p_partkey * 1000 + p_size AS bps, CAST(p_partkey AS INT) AS index_col
        FROM part"""),
    "pathways": ([], """
        SELECT CASE WHEN p_size % 7 = 0 THEN 'Other' ELSE 'KEGG' END AS source,
               CASE WHEN p_size % 11 = 0 THEN 'unknown' ELSE concat('path:hsa', lpad(CAST(p_size AS VARCHAR), 5, '0')) END AS external_id,
               string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS hgnc_symbol_ids FROM part GROUP BY p_size"""),
    "hierarchy": ([], """
        SELECT p_size AS hsaid, concat('local', p_size) AS local, p_size - 1 AS local_id, p_size % 7 AS mid_id,
               p_size % 7 % 3 AS global_id FROM (SELECT DISTINCT p_size FROM part WHERE p_size % 13 <> 0)"""),
}
