"""Topology queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.text import clean_gene, explode_columns
from locusframe.operators import topology as t
from locusframe.plans.registry import query
from locusframe.plans.views import Views
from locusframe.sources import tables

CLEAN = r"""
    cleaned AS (
        SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(gene, ',.*', ''), '\(.*\)', ''), '\(.*', ''), ';.*', '') AS name
        FROM annotation),
    known AS (SELECT * FROM cleaned WHERE name <> 'NONE'),
    firsts AS (SELECT * FROM (SELECT name, chr, bps, row_number() OVER (PARTITION BY name ORDER BY index_col) AS rn FROM known) WHERE rn = 1),
    genes AS (SELECT name AS gene, chr, bps, row_number() OVER (ORDER BY chr, bps, name) - 1 AS gene_id FROM firsts)"""


@query("annotation", f"WITH {CLEAN} SELECT index_col, name FROM cleaned")
def clean_gene_names(v: Views) -> DataFrame:
    return v.annotation.select("index_col", clean_gene(F.col("gene")).alias("name"))


@query("annotation", f"WITH {CLEAN} SELECT gene, chr, bps, gene_id FROM genes")
def number_genes(v: Views) -> DataFrame:
    return t.number_genes(v.annotation)


@query("annotation", f"""WITH {CLEAN}
    SELECT k.chr, CAST(index_col AS BIGINT) AS layer0_node, concat('chr', k.chr, ':', k.bps) AS layer0_name, gene_id AS layer1_node,
           name AS layer1_name FROM known k JOIN genes g ON g.gene = name""")
def gene_topology(v: Views) -> DataFrame:
    return t.gene_topology(v.annotation)


@query("annotation", f"""WITH {CLEAN}
    SELECT DISTINCT CAST(index_col AS BIGINT) AS src, gene_id AS dst FROM known k JOIN genes g ON g.gene = name""")
def variant_gene_edges(v: Views) -> DataFrame:
    return t.topology_edges(t.gene_topology(v.annotation), layer=0).select("src", "dst")


MEMBERS = """
    listed AS (SELECT TRY_CAST(replace(external_id, 'path:hsa', '') AS INT) AS hsaid, hgnc_symbol_ids FROM pathways WHERE source = 'KEGG'),
    matched AS (SELECT hsaid, local, hgnc_symbol_ids, row_number() OVER (ORDER BY hsaid) - 1 AS local_id FROM listed JOIN hierarchy USING (hsaid)),
    members AS (SELECT unnest(string_split(hgnc_symbol_ids, ',')) AS gene, hsaid, local, local_id,
                       CAST(len(string_split(hgnc_symbol_ids, ',')) AS INT) AS n_genes FROM matched)"""


@query("pathways hierarchy", f"WITH {MEMBERS} SELECT gene, hsaid, local, local_id, n_genes FROM members")
def pathway_membership(v: Views) -> DataFrame:
    return t.pathway_membership(v.pathways, v.hierarchy)


@query("annotation pathways hierarchy", f"WITH {CLEAN}, {MEMBERS} SELECT DISTINCT gene_id AS src, local_id AS dst FROM members JOIN genes USING (gene)")
def gene_pathway_edges(v: Views) -> DataFrame:
    return t.pathway_edges(t.number_genes(v.annotation), v.pathways, v.hierarchy)


@query("pathways hierarchy", f"WITH {MEMBERS} SELECT DISTINCT local, n_genes FROM members")
def pathway_gene_counts(v: Views) -> DataFrame:
    return t.pathway_membership(v.pathways, v.hierarchy).select("local", "n_genes").distinct()


@query("hierarchy", """
    SELECT DISTINCT 0 AS layer, CAST(local_id AS BIGINT) AS src, CAST(mid_id AS BIGINT) AS dst FROM hierarchy
    UNION SELECT 1, mid_id, global_id FROM hierarchy""")
def hierarchy_edges(v: Views) -> DataFrame:
    return t.hierarchy_edges(v.hierarchy)


EDGES = """
    edges AS (SELECT DISTINCT 0 AS layer, layer0_node AS src, layer1_node AS dst FROM topology
              UNION SELECT 1, layer1_node, layer2_node FROM topology)"""


@query("topology", f"WITH {EDGES} SELECT * FROM edges")
def topology_edges(v: Views) -> DataFrame:
    return t.topology_edges(v.topology)


@query("topology", "SELECT DISTINCT layer0_node AS src, layer2_node AS dst FROM topology")
def edges_from_columns(v: Views) -> DataFrame:
    return t.edges_from_columns(v.topology, "layer0_node", "layer2_node")


@query("topology", f"""WITH {EDGES},
    sizes AS (SELECT layer, count(*) AS n_edges, max(src) + 1 AS n_in, max(dst) + 1 AS n_out FROM edges GROUP BY layer)
    SELECT layer, n_edges, n_in, n_out, row_number() OVER (ORDER BY n_in DESC, layer) - 1 AS place,
           coalesce(lag(n_out) OVER (ORDER BY n_in DESC, layer) = n_in, true) AS fits FROM sizes""")
def order_layers(v: Views) -> DataFrame:
    return t.order_layers(t.topology_edges(v.topology))


@query("annotation", f"WITH {CLEAN} SELECT chr, max(gene_id) AS last_gene FROM genes GROUP BY chr")
def gene_boundaries(v: Views) -> DataFrame:
    return t.gene_boundaries(t.number_genes(v.annotation))


@query("annotation", f"""WITH {CLEAN},
    edges AS (SELECT DISTINCT CAST(index_col AS BIGINT) AS src, gene_id AS dst FROM known k JOIN genes g ON g.gene = name)
    SELECT src, dense_rank() OVER (ORDER BY src) - 1 AS new_src, dst FROM edges""")
def compact_edges(v: Views) -> DataFrame:
    return t.compact_edges(t.topology_edges(t.gene_topology(v.annotation)))


@query("", """
    SELECT p_partkey, trim(unnest(string_split(p_type || ' , ' || p_brand, ','))) AS a, trim(unnest(string_split(p_brand || ',' || p_name, ','))) AS b FROM part""")
def explode_parallel_lists(v: Views) -> DataFrame:
    lists = v.table("part").selectExpr("p_partkey", "concat(p_type, ' , ', p_brand) AS a", "concat(p_brand, ',', p_name) AS b")
    return explode_columns(lists, ["a", "b"])


@query("topology", "SELECT layer0_node, layer0_name, layer1_node, layer1_name, layer2_node, layer2_name FROM topology")
def checked_topology(v: Views) -> DataFrame:
    raw = v.topology.select(*[F.col(c).cast("string").alias(c) for c in v.topology.columns])
    return tables.check_topology(raw.withColumn("layer1_name", F.concat("layer1_name", F.lit("   "))))
