"""Formats: the given tables written as files in the shared folder and read back by this package's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.operators import association as a
from locusframe.operators import harmonise as h
from locusframe.operators.genotype import from_tiles
from locusframe.plans.associations import DENSE_CELLS, PHENOTYPES, rounded, single_covariate
from locusframe.plans.registry import query
from locusframe.plans.views import Views
from locusframe.session import intermediates
from locusframe.sources import minimac, plink, sinks, tables, vcf


def new_path(v: Views) -> str:
    return f"{intermediates(v.spark)}/{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, order: str, line: Column, path: str) -> str:
    """A folder of text files whose lines, file by file, follow `order`."""
    lines.orderBy(order).select(line.alias("value")).write.text(path)
    return path


@query("subject", """
    SELECT row_number() OVER (ORDER BY subject_id) - 1 AS subject_row, 'fam' || set_id AS family, 'id' || subject_id AS individual, 0 AS paternal,
           0 AS maternal, CAST(subject_id % 2 + 1 AS INT) AS sex, CASE WHEN set_id = 3 THEN -9 ELSE label_bin + 1 END AS label FROM subject""")
def fam_file(v: Views) -> DataFrame:
    """Individuals in the order of the file, read from tabs and spaces."""
    line = F.expr("concat('fam', set_id, '\\t', 'id', subject_id, ' 0 0  ', subject_id % 2 + 1, '\\t', CASE WHEN set_id = 3 THEN -9 ELSE label_bin + 1 END)")
    return plink.read_fam(v.spark, write_lines(v.subject, "subject_id", line, new_path(v)))


@query("variant", """
    SELECT row_number() OVER (ORDER BY variant_row) - 1 AS variant_row, CAST(CASE chr WHEN 22 THEN 23 WHEN 21 THEN 26 ELSE chr END AS INT) AS chr,
           variant_id, 0.5e0 AS distance, CAST(bp AS BIGINT) AS bp, allele1, allele2 FROM variant""")
def bim_file(v: Views) -> DataFrame:
    """Variants in the order of the file, chromosomes by number or name."""
    line = F.expr("concat_ws('\\t', CASE chr WHEN 22 THEN 'X' WHEN 21 THEN 'chrMT' ELSE concat('chr', chr) END, variant_id, '0.5', bp, allele1, allele2)")
    return plink.read_bim(v.spark, write_lines(v.variant, "variant_row", line, new_path(v)))


def vcf_folder(v: Views) -> str:
    """The genotype with missing calls as VCF text: a variant a line, subjects by id; the reference allele is counted."""
    call = F.expr("CASE dosage WHEN 2 THEN '0/0' WHEN 1 THEN '0|1' WHEN 0 THEN '1/1' ELSE './.' END")
    calls = F.transform(F.sort_array(F.collect_list(F.struct("subject_id", call.alias("c")))), lambda x: F.concat(F.lit("7:"), x["c"]))
    fixed = F.expr("concat_ws('\\t', variant_id % 22 + 1, variant_id * 100 + 1, concat('rs', variant_id), 'A', 'G', '.', 'PASS', '.', 'GQ:GT')")
    records = v.genotype_missing.groupBy("variant_id").agg(F.array_join(calls, "\t").alias("calls")).select(
        F.col("variant_id").cast("long").alias("k"), F.concat_ws("\t", fixed, "calls").alias("line")
    )
    names = F.array_join(F.transform(F.array_sort(F.collect_list("subject_id")), lambda s: F.concat(F.lit("id"), s)), "\t")
    titles = F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT")
    header = v.subject.agg(F.lit(-1).cast("long").alias("k"), F.concat_ws("\t", titles, names).alias("line"))
    declared = v.spark.range(1).select(F.lit(-2).cast("long").alias("k"), F.lit("##FORMAT=<ID=GT,Number=1,Type=String>").alias("line"))
    return write_lines(records.unionByName(header).unionByName(declared), "k", F.col("line"), new_path(v))


SUBJECT_ROWS = "(SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS subject_row FROM subject)"
VARIANT_ROWS = "(SELECT variant_id, row_number() OVER (ORDER BY variant_id) - 1 AS variant_row FROM (SELECT DISTINCT variant_id FROM genotype_missing))"


@query("genotype_missing subject", f"""
    SELECT 'rs' || variant_id AS variant_id, CAST(variant_id % 22 + 1 AS INT) AS chr, CAST(variant_id * 100 + 1 AS BIGINT) AS bp, subject_row,
           CAST(dosage AS DOUBLE) AS dosage FROM genotype_missing JOIN {SUBJECT_ROWS} USING (subject_id)""")
def vcf_dosages(v: Views) -> DataFrame:
    return vcf.read_vcf_dosage(v.spark, vcf_folder(v))


@query("genotype_missing subject", f"""
    SELECT variant_row AS variant_id, subject_row AS subject_id, CAST(dosage AS DOUBLE) AS dosage
    FROM genotype_missing JOIN {SUBJECT_ROWS} USING (subject_id) JOIN {VARIANT_ROWS} USING (variant_id)""")
def vcf_tiles(v: Views) -> DataFrame:
    """Tiles of 100 subjects, their cells named by file rows."""
    tiles = vcf.read_vcf_tiles(v.spark, vcf_folder(v), tile=100)
    return from_tiles(tiles, "variant_id", "subject_id", "subject_ids").select("variant_id", "subject_id", "dosage")


@query("genotype_missing", f"""
    SELECT variant_row, CAST(variant_id % 22 + 1 AS INT) AS chr, CAST(variant_id * 100 + 1 AS BIGINT) AS bp, 'rs' || variant_id AS variant_id, 'A' AS allele1,
           'G' AS allele2, '.' AS qual, 'PASS' AS filter, '.' AS info, 'A' AS counted_allele FROM {VARIANT_ROWS}""")
def vcf_variants(v: Views) -> DataFrame:
    return vcf.read_vcf_variants(v.spark, vcf_folder(v))


@query("subject", f"SELECT subject_row, 'id' || subject_id AS individual FROM {SUBJECT_ROWS}")
def vcf_samples(v: Views) -> DataFrame:
    return vcf.read_vcf_samples(v.spark, vcf_folder(v))


@query("genotype", """
    SELECT 'rs' || variant_id AS variant_id, 'fam' || subject_id % 5 AS family, 'id' || subject_id AS individual, dosage + 0.25e0 * (subject_id % 2) AS dosage FROM genotype""")
def minimac_dosages(v: Views) -> DataFrame:
    """Two pairs of a .dose and an .info, odd and even variants."""
    path = new_path(v)
    for part in range(2):
        own = v.genotype.where(F.col("variant_id") % 2 == part)
        doses = F.transform(F.sort_array(F.collect_list(F.struct("variant_id", "dosage"))), lambda c: c["dosage"] + F.col("subject_id") % 2 * 0.25)
        line = F.concat_ws(" ", F.expr("concat('fam', subject_id % 5, '->id', subject_id)"), F.lit("DOSE"), F.array_join(doses.cast("array<string>"), " "))
        own.groupBy("subject_id").agg(line.alias("value")).select("value").write.text(f"{path}/part{part}.dose")
        rows = own.select(F.col("variant_id").alias("k")).distinct().withColumn("line", F.expr("concat('rs', k, ' A G 0.7 0.3 0.9 0.8')"))
        title = v.spark.range(1).select(F.lit(-1).alias("k"), F.lit("SNP Al1 Al2 Freq1 MAF Quality Rsq").alias("line"))
        write_lines(rows.unionByName(title), "k", F.col("line"), f"{path}/part{part}.info")
    return minimac.read_minimac(v.spark, path)


@query("subject", """
    SELECT CAST(subject_id AS VARCHAR) AS subject_id, unnest(['label_reg', 'cov_2']) AS trait, unnest([CASE WHEN set_id < 3 THEN label_reg END, cov_2]) AS value FROM subject""")
def traits_file(v: Views) -> DataFrame:
    """A wide table with missing values, unpivoted."""
    path = new_path(v)
    v.subject.selectExpr("subject_id AS id", "CASE WHEN set_id < 3 THEN CAST(label_reg AS STRING) ELSE 'NA' END AS label_reg", "cov_2").write.csv(path, sep="\t", header=True)
    return tables.read_traits(v.spark, path)


@query("subject", "SELECT 'p' || subject_id AS subject_id, CAST(label_bin AS DOUBLE) AS label, subject_id AS genotype_row, set_id, cov_1, cov_2 FROM subject")
def subjects_file(v: Views) -> DataFrame:
    path = new_path(v)
    columns = ["concat('p', subject_id) AS patient_id", "label_bin AS labels", "genotype_row", "set_id AS set", "cov_1", "cov_2"]
    v.subject.selectExpr(*columns).write.csv(path, header=True)
    return tables.read_subjects(v.spark, path)


@query("topology", "SELECT layer0_node, layer0_name, CAST(layer1_node AS BIGINT) AS layer1_node, layer1_name, CAST(layer2_node AS BIGINT) AS layer2_node, layer2_name FROM topology")
def topology_file(v: Views) -> DataFrame:
    path = new_path(v)
    v.topology.write.csv(path, header=True)
    return tables.read_topology(v.spark, path)


@query("annotation", """
    SELECT region, gene, chr, bps, bps AS bpe, 'A' AS mutation1, 'C' AS mutation2, index_col FROM annotation""")
def annotation_file(v: Views) -> DataFrame:
    path = new_path(v)
    v.annotation.select("region", "gene", "chr", "bps", "bpe", "mutation1", "mutation2", "index_col").write.csv(path, sep="\t")
    return tables.read_variant_function(v.spark, path)


@query("hierarchy", """
    SELECT hsaid, CAST(local_id AS INT) AS local_id, CAST(mid_id AS INT) AS mid_id, CAST(global_id AS INT) AS global_id, local,
           'mid' || mid_id AS mid, 'global' || global_id AS global FROM hierarchy""")
def hierarchy_file(v: Views) -> DataFrame:
    path = new_path(v)
    v.hierarchy.selectExpr("*", "concat('mid', mid_id) AS mid", "concat('global', global_id) AS global").write.csv(path, header=True)
    return tables.read_hierarchy(v.spark, path)


@query("pathways", """
    SELECT row_number() OVER (ORDER BY hgnc_symbol_ids, source, external_id) AS listed, source, external_id, hgnc_symbol_ids FROM pathways""")
def pathways_file(v: Views) -> DataFrame:
    """Gene lists in the order of the file; its columns in another order."""
    lines = v.pathways.selectExpr("concat(hgnc_symbol_ids, '|', source, '|', external_id) AS k", "concat_ws('\\t', external_id, hgnc_symbol_ids, 'x', source) AS line")
    title = v.spark.range(1).selectExpr("'' AS k", "concat_ws('\\t', 'external_id', 'hgnc_symbol_ids', 'pathway', 'source') AS line")
    return tables.read_pathways(v.spark, write_lines(lines.unionByName(title), "k", F.col("line"), new_path(v)))


@query("refpanel", "SELECT variant_id, CAST(chr AS INT) AS chr, CAST(bp AS BIGINT) AS bp, allele1, allele2 FROM refpanel")
def reference_file(v: Views) -> DataFrame:
    path = new_path(v)
    v.refpanel.selectExpr("variant_id AS ID", "allele1", "allele2", "chr AS CHR", "bp").write.csv(path, sep=" ", header=True)
    return tables.read_reference(v.spark, path)


@query("variant", "SELECT concat_ws(chr(9), chr, bp, bp, allele1, allele2, variant_row) AS line FROM variant")
def annovar_file(v: Views) -> DataFrame:
    """Lines of the annotator's input."""
    path = new_path(v)
    sinks.write_annovar_input(h.annovar_input(v.variant), path)
    return v.spark.read.text(path).select(F.col("value").alias("line"))


@query("genotype subject trait", f"WITH {single_covariate(DENSE_CELLS)} SELECT * FROM result")
def results_by_phenotype(v: Views) -> DataFrame:
    """Results of two runs appended to one folder per phenotype."""
    path = new_path(v)
    for part in range(2):
        found = rounded(a.gwas(v.genotype.where(F.col("variant_id") % 2 == part), v.subject, ["cov_1"], PHENOTYPES))
        sinks.write_results(found.withColumnsRenamed({"variant_id": "RSID", "trait": "phenotype"}), path, split_phenotype=True)
    back = v.spark.read.parquet(path)
    return back.select(F.col("RSID").alias("variant_id"), F.col("phenotype").alias("trait"), "af", "beta", "se", "t_stat", "df")
