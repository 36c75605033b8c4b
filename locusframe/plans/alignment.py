"""Harmonisation and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import cohort, harmonise as h
from locusframe.plans.registry import query
from locusframe.plans.views import Views
from locusframe.sources import tables

# Matched rows of one key: straight before swapped, then the smallest id.
MATCHED = """
    matched AS (
        SELECT * FROM (
            SELECT v.variant_id, r.variant_id AS reference_id, r.chr, r.bp,
                   CASE WHEN v.allele1 = r.allele1 AND v.allele2 = r.allele2 THEN 1 ELSE -1 END AS flip,
                   row_number() OVER (PARTITION BY r.variant_id, r.chr, r.bp, r.allele1, r.allele2
                       ORDER BY CASE WHEN v.allele1 = r.allele1 AND v.allele2 = r.allele2 THEN 0 ELSE 1 END, v.variant_id) AS rn
            FROM variant v JOIN refpanel r ON {on}
             AND ((v.allele1 = r.allele1 AND v.allele2 = r.allele2) OR (v.allele1 = r.allele2 AND v.allele2 = r.allele1)))
        WHERE rn = 1)"""
BY_POSITION = MATCHED.format(on="v.chr = r.chr AND v.bp = r.bp")
BY_ID = MATCHED.format(on="v.variant_id = r.variant_id")


@query("variant refpanel", f"WITH {BY_POSITION} SELECT variant_id, reference_id, chr, bp, flip FROM matched")
def harmonise_position(v: Views) -> DataFrame:
    return h.harmonise(v.variant, v.refpanel, on="pos")


@query("variant refpanel", f"WITH {BY_ID} SELECT variant_id, reference_id, chr, bp, flip FROM matched")
def harmonise_rsid(v: Views) -> DataFrame:
    return h.harmonise(v.variant, v.refpanel, on="rsid")


@query("variant", """
    SELECT variant_id, CASE WHEN chr BETWEEN 1 AND 22 THEN CAST(chr AS INT) END AS chr, CASE WHEN chr BETWEEN 1 AND 22 THEN bp END AS bp
    FROM (SELECT concat(chr + 2, ':', bp, ':', allele1) AS variant_id, chr + 2 AS chr, bp FROM variant)""")
def position_from_id(v: Views) -> DataFrame:
    ids = v.variant.selectExpr("concat(chr + 2, ':', bp, ':', allele1) AS variant_id")
    return h.position_from_id(ids).select("variant_id", "chr", "bp")


@query("variant refpanel", f"WITH {BY_POSITION} SELECT * FROM variant WHERE variant_id NOT IN (SELECT variant_id FROM matched)")
def mismatches(v: Views) -> DataFrame:
    return h.mismatches(v.variant, v.refpanel)


@query("variant refpanel", f"WITH {BY_POSITION} SELECT * FROM variant WHERE variant_id IN (SELECT variant_id FROM matched WHERE flip = -1)")
def flipped_variants(v: Views) -> DataFrame:
    return h.flipped(v.variant, v.refpanel)


@query("variant refpanel", f"""WITH {BY_POSITION}
    SELECT (SELECT count(*) FROM matched) AS common,
           (SELECT count(*) FROM refpanel) - (SELECT count(*) FROM matched) AS reference_only,
           (SELECT count(*) FROM variant WHERE variant_id NOT IN (SELECT variant_id FROM matched)) AS excluded""")
def harmonise_summary(v: Views) -> DataFrame:
    return h.harmonise_summary(v.variant, v.refpanel)


@query("variant refpanel", """
    SELECT * FROM variant WHERE variant_id IN (SELECT variant_id FROM refpanel)
    AND variant_id NOT IN (SELECT variant_id FROM refpanel WHERE allele2 = 'N')""")
def restrict_variants(v: Views) -> DataFrame:
    return h.restrict(v.variant, include=v.refpanel, exclude=v.refpanel.filter("allele2 = 'N'"))


@query("variant refpanel", "SELECT v.* FROM variant v WHERE NOT EXISTS (SELECT 1 FROM refpanel r WHERE r.chr = v.chr AND r.bp = v.bp)")
def restrict_variants_by_position(v: Views) -> DataFrame:
    return h.restrict(v.variant, exclude=v.refpanel, on=["chr", "bp"])


@query("trait", "SELECT * FROM trait WHERE trait IN ('label_reg', 'cov_2') AND trait <> 'cov_2'")
def restrict_traits(v: Views) -> DataFrame:
    names = v.trait.select("trait").distinct()
    return h.restrict_traits(v.trait, names.filter("trait <> 'label_bin'"), names.filter("trait = 'cov_2'"))


def study_maps(v: Views) -> list[DataFrame]:
    """Maps of three studies that lack different variants."""
    matched = h.harmonise(v.variant, v.refpanel)
    number = F.substring("variant_id", 3, 20).cast("long")
    return [matched.filter(number % (11 + s) != s) for s in range(3)]


STUDY_MAPS = BY_POSITION + """,
    common AS (SELECT reference_id FROM matched WHERE CAST(substr(variant_id, 3) AS BIGINT) % 11 <> 0
               AND CAST(substr(variant_id, 3) AS BIGINT) % 12 <> 1 AND CAST(substr(variant_id, 3) AS BIGINT) % 13 <> 2)"""


@query("variant refpanel", f"WITH {STUDY_MAPS} SELECT reference_id FROM common")
def common_variants(v: Views) -> DataFrame:
    return h.common_variants(study_maps(v))


@query("genotype_sparse customer_design subject", """
    SELECT subject_id FROM genotype_sparse INTERSECT SELECT subject_id FROM customer_design INTERSECT SELECT subject_id FROM subject""")
def common_subjects(v: Views) -> DataFrame:
    return h.common_subjects(v.genotype_sparse, v.customer_design, v.subject)


@query("genotype_sparse subject", "SELECT subject_id FROM genotype_sparse INTERSECT SELECT subject_id FROM subject")
def common_subjects_without_covariates(v: Views) -> DataFrame:
    return h.common_subjects(v.genotype_sparse, v.subject, None)


@query("trait", "SELECT DISTINCT trait FROM trait WHERE trait <> 'cov_2'")
def common_names(v: Views) -> DataFrame:
    return h.common_names([v.trait, v.trait.filter("trait <> 'cov_2'")])


@query("variant refpanel genotype_sparse", f"""WITH {STUDY_MAPS}
    SELECT CAST(subject_id % 3 AS INT) AS study, subject_id, reference_id AS variant_id,
           CASE WHEN flip = -1 THEN 2 - dosage ELSE dosage END AS dosage
    FROM (SELECT subject_id, concat('rs', variant_id) AS variant_id, dosage FROM genotype_sparse)
    JOIN matched USING (variant_id) WHERE reference_id IN (SELECT reference_id FROM common)""")
def merge_studies(v: Views) -> DataFrame:
    cells = v.genotype_sparse.withColumn("variant_id", F.concat(F.lit("rs"), "variant_id"))
    return h.merge_studies([cells.filter(F.col("subject_id") % 3 == s) for s in range(3)], study_maps(v))


@query("trait", "SELECT CAST(subject_id % 2 AS INT) AS study, subject_id, trait, value FROM trait WHERE trait <> 'cov_2'")
def merge_traits(v: Views) -> DataFrame:
    even = v.trait.filter("subject_id % 2 = 0")
    return h.merge_traits([even, v.trait.filter("subject_id % 2 = 1 AND trait <> 'cov_2'")])


@query("genotype subject", "SELECT s.subject_id, label_bin, set_id, variant_id, dosage FROM subject s JOIN genotype g ON g.subject_id = s.genotype_row")
def attach_genotype(v: Views) -> DataFrame:
    subjects = v.subject.select("subject_id", "genotype_row", "label_bin", "set_id")
    cells = v.genotype.withColumnRenamed("subject_id", "genotype_row")
    return cohort.attach_genotype(subjects, cells).select("subject_id", "label_bin", "set_id", "variant_id", "dosage")


@query("genotype subject", """
    SELECT s.subject_id, s.subject_id % 4 AS chunk_id, variant_id, dosage FROM subject s JOIN genotype g ON g.subject_id = s.subject_id""")
def attach_genotype_chunks(v: Views) -> DataFrame:
    subjects = v.subject.selectExpr("subject_id", "subject_id % 4 AS chunk_id", "subject_id DIV 4 AS genotype_row")
    cells = v.genotype.selectExpr("subject_id % 4 AS chunk_id", "subject_id DIV 4 AS genotype_row", "variant_id", "dosage")
    return cohort.attach_genotype(subjects, cells, chunked=True).select("subject_id", "chunk_id", "variant_id", "dosage")


@query("variant", "SELECT DISTINCT allele1 AS allele FROM variant UNION SELECT DISTINCT allele2 FROM variant")
def allele_dictionary(v: Views) -> DataFrame:
    return h.allele_dictionary(v.variant).select("allele")


@query("variant", "SELECT variant_id, allele1, allele2 FROM variant")
def alleles_encoded_and_decoded(v: Views) -> DataFrame:
    coded = h.encode_alleles(v.variant)
    return h.decode_alleles(coded, h.allele_dictionary(v.variant)).select("variant_id", "allele1", "allele2")


@query("variant genotype_sparse", """
    SELECT RSID, round(f, 6) + 0.0e0 AS AF_coded, chr, bp, allele1, allele2
    FROM (SELECT concat('rs', variant_id) AS RSID, avg(dosage) / 2 AS f FROM genotype_sparse GROUP BY variant_id)
    JOIN variant ON variant_id = RSID""")
def annotate_results(v: Views) -> DataFrame:
    results = v.genotype_sparse.groupBy(F.concat(F.lit("rs"), "variant_id").alias("RSID")).agg(
        (F.round(F.avg("dosage") / 2, 6) + F.lit(0.0)).alias("MAF")
    )
    return h.annotate_results(results, v.variant)


@query("variant", "SELECT chr, bp AS bps, bp AS bpe, allele1, allele2, variant_row AS index_col FROM variant")
def annovar_input(v: Views) -> DataFrame:
    return h.annovar_input(v.variant)


@query("trait", "SELECT * FROM trait")
def wide_traits_to_long(v: Views) -> DataFrame:
    wide = v.subject.select("subject_id", "label_reg", "cov_2", F.col("label_bin").cast("double").alias("label_bin"))
    return tables.to_long_traits(wide)


@query("trait subject", """
    SELECT subject_id, trait, count(*) AS n FROM (SELECT * FROM trait UNION ALL SELECT subject_id, 'cov_2', cov_2 FROM subject WHERE set_id = 3)
    GROUP BY subject_id, trait HAVING count(*) > 1""")
def repeated_trait_cells(v: Views) -> DataFrame:
    again = v.subject.filter("set_id = 3").selectExpr("subject_id", "'cov_2' AS trait", "cov_2 AS value")
    return tables.duplicate_cells(v.trait.unionByName(again))


@query("subject", """
    SELECT subject_id, CAST(label_bin AS DOUBLE) AS label, genotype_row, set_id, cov_1, cov_2 FROM subject""")
def checked_subjects(v: Views) -> DataFrame:
    raw = v.subject.selectExpr("subject_id AS patient_id", "label_bin AS labels", "genotype_row", "set_id AS set", "cov_1", "cov_2", "study")
    return tables.check_subjects(raw, regression=False)
