"""Building and checking the layered topology variant -> gene -> pathway.

Path tables hold one row per input-to-output path with layer<k>_node and
layer<k>_name columns; edge tables hold (layer, src, dst).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.text import clean_gene
from locusframe.operators.ordering import number_rows

# Fixed values of the annotation and pathway tables.
UNANNOTATED = "NONE"
PATHWAY_SOURCE = "KEGG"
PATHWAY_ID_PREFIX = "path:hsa"


def annotated(annotation: DataFrame) -> DataFrame:
    """Rows with a gene, its name cleaned."""
    return annotation.withColumn("gene", clean_gene(F.col("gene"))).filter(
        F.col("gene").isNotNull() & (F.col("gene") != UNANNOTATED)
    )


def number_genes(annotation: DataFrame) -> DataFrame:
    """(gene, chr, bps, gene_id): genes numbered by the position of their first-listed variant."""
    first = F.min_by(F.struct("chr", "bps"), "index_col").alias("_f")
    genes = annotated(annotation).groupBy("gene").agg(first).select("gene", "_f.chr", "_f.bps")
    return number_rows(genes, ["chr", "bps", "gene"], "gene_id")


def gene_topology(annotation: DataFrame) -> DataFrame:
    """Path rows variant -> gene, the variant's node being its row in the genotype matrix."""
    genes = number_genes(annotation).select("gene", "gene_id")
    return annotated(annotation).join(genes, "gene").select(
        "chr",
        F.col("index_col").cast("long").alias("layer0_node"),
        F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(":"), F.col("bps").cast("string")).alias("layer0_name"),
        F.col("gene_id").alias("layer1_node"),
        F.col("gene").alias("layer1_name"),
    )


def node_columns(paths: DataFrame) -> list[str]:
    """layer0_node, layer1_node, … in order; the depth is read from the names."""
    found = [c for c in paths.columns if re.fullmatch(r"layer\d+_node", c)]
    return sorted(found, key=lambda c: int(re.search(r"\d+", c).group()))


def edges_from_columns(paths: DataFrame, src: str, dst: str) -> DataFrame:
    return paths.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).distinct()


def topology_edges(paths: DataFrame, layer: int | None = None) -> DataFrame:
    """Distinct edges (layer, src, dst) between adjacent node columns, all layers in one scan."""
    nodes = node_columns(paths)
    pairs = [
        F.struct(F.lit(i).alias("layer"), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))
        for i, (a, b) in enumerate(zip(nodes, nodes[1:]))
        if layer is None or layer == i
    ]
    return paths.select(F.explode(F.array(*pairs)).alias("e")).select("e.*").distinct()


def pathway_membership(pathways: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(gene, hsaid, local, local_id, n_genes): genes listed for the known pathways.

    Pathways are numbered in listing order where the table carries it (`listed`).
    """
    place = F.col("listed") if "listed" in pathways.columns else F.lit(0)
    hsaid = F.expr(f"try_cast(regexp_replace(external_id, '^{PATHWAY_ID_PREFIX}', '') AS INT)")
    genes = F.split("hgnc_symbol_ids", ",")
    listed = pathways.filter(F.col("source") == PATHWAY_SOURCE).select(
        hsaid.alias("hsaid"), genes.alias("genes"), F.size(genes).alias("n_genes"), place.alias("listed")
    )
    known = listed.groupBy("hsaid").agg(F.min("listed").alias("listed")).join(hierarchy.select("hsaid", "local"), "hsaid")
    local = number_rows(known, ["listed", "hsaid"], "local_id").drop("listed")
    members = listed.join(local, "hsaid").select(F.explode("genes").alias("gene"), "hsaid", "local", "local_id", "n_genes")
    return members.withColumn("gene", F.trim("gene"))


def pathway_edges(genes: DataFrame, pathways: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Distinct edges gene_id -> local_id for the study's genes (gene, gene_id)."""
    members = pathway_membership(pathways, hierarchy)
    return members.join(genes.select("gene", "gene_id"), "gene").select(
        F.col("gene_id").alias("src"), F.col("local_id").alias("dst")
    ).distinct()


def hierarchy_edges(hierarchy: DataFrame) -> DataFrame:
    """Edges pathway -> mid (layer 0) and mid -> global (layer 1)."""
    pairs = F.array(
        F.struct(F.lit(0).alias("layer"), F.col("local_id").cast("long").alias("src"), F.col("mid_id").cast("long").alias("dst")),
        F.struct(F.lit(1).alias("layer"), F.col("mid_id").cast("long").alias("src"), F.col("global_id").cast("long").alias("dst")),
    )
    return hierarchy.select(F.explode(pairs).alias("e")).select("e.*").distinct()


def layer_sizes(edges: DataFrame) -> DataFrame:
    """Widths of every edge layer: n_edges, n_in, n_out."""
    return edges.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_edges"),
        (F.max("src") + 1).cast("long").alias("n_in"),
        (F.max("dst") + 1).cast("long").alias("n_out"),
    )


def order_layers(edges: DataFrame) -> DataFrame:
    """Layers by falling input width with their place and whether they fit the layer before."""
    # One row per layer of the network.
    by_size = Window.orderBy(F.desc("n_in"), "layer")
    return (
        layer_sizes(edges)
        .withColumn("place", (F.row_number().over(by_size) - 1).cast("long"))
        .withColumn("fits", F.coalesce(F.lag("n_out").over(by_size) == F.col("n_in"), F.lit(True)))
    )


def gene_boundaries(genes: DataFrame) -> DataFrame:
    """Last gene number of every chromosome."""
    return genes.groupBy("chr").agg(F.max("gene_id").alias("last_gene"))


def compact_edges(edges: DataFrame) -> DataFrame:
    """Edges over the used inputs only, renumbered from 0 in order."""
    used = number_rows(edges.select("src").distinct(), ["src"], "new_src")
    return edges.join(used, "src").select("src", "new_src", "dst")
