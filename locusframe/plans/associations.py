"""Association and meta-analysis queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import association as a
from locusframe.operators import genotype as g
from locusframe.plans.registry import query, r6, sql6, sql_order
from locusframe.plans.views import Views
from locusframe.session import intermediates, materialise
from locusframe.sources import sinks
from locusframe.streaming import statistics

PHENOTYPES = ["label_reg", "cov_2"]


def rounded(results: DataFrame) -> DataFrame:
    return results.select(
        "variant_id", "trait", *[r6(c).alias(c) for c in ("af", "beta", "se", "t_stat")], "df"
    )


def single_covariate(cells: str, keys: str = "variant_id, trait", n: str = "count(*)", k: int = 3) -> str:
    """Closed form for one covariate over rows (variant_id, trait, g, c, y) with centred sums."""
    return f"""
    sums AS (
        SELECT {keys}, {n} AS n, avg(g) / 2 AS af, covar_pop(g, g) * count(*) AS gg, covar_pop(c, c) * count(*) AS cc,
               covar_pop(y, y) * count(*) AS yy, covar_pop(g, c) * count(*) AS gc, covar_pop(g, y) * count(*) AS gy,
               covar_pop(c, y) * count(*) AS cy
        FROM ({cells}) GROUP BY {keys}),
    solved AS (
        SELECT *, (gy * cc - gc * cy) / nullif(gg * cc - gc * gc, 0) AS beta,
               (cy * gg - gc * gy) / nullif(gg * cc - gc * gc, 0) AS gamma, cc / nullif(gg * cc - gc * gc, 0) AS m FROM sums),
    tested AS (
        SELECT *, sqrt(abs(yy - beta * gy - gamma * cy) / (n - {k}) * m) AS se, CAST(n - {k} AS BIGINT) AS df FROM solved),
    result AS (
        SELECT {keys}, {sql6('af')} AS af, {sql6('beta')} AS beta, {sql6('se')} AS se, {sql6('beta / nullif(se, 0)')} AS t_stat, df FROM tested)"""


DENSE_CELLS = """
    SELECT variant_id, trait, CAST(dosage AS DOUBLE) AS g, cov_1 AS c, value AS y
    FROM genotype JOIN subject USING (subject_id) JOIN trait USING (subject_id) WHERE trait <> 'label_bin'"""
IMPUTED_CELLS = DENSE_CELLS.replace("CAST(dosage AS DOUBLE)", "x").replace("FROM genotype ", """
    FROM (SELECT subject_id, variant_id, coalesce(CAST(dosage AS DOUBLE), avg(dosage) OVER (PARTITION BY variant_id)) AS x
          FROM genotype_missing) """)


@query("subject", f"""
    SELECT i, j, {sql6('v')} AS v FROM (
        SELECT 'intercept' AS i, 'intercept' AS j, count(*) AS v FROM subject
        UNION ALL SELECT 'intercept', 'cov_1', sum(cov_1) FROM subject UNION ALL SELECT 'cov_1', 'intercept', sum(cov_1) FROM subject
        UNION ALL SELECT 'intercept', 'cov_2', sum(cov_2) FROM subject UNION ALL SELECT 'cov_2', 'intercept', sum(cov_2) FROM subject
        UNION ALL SELECT 'cov_1', 'cov_2', sum(cov_1 * cov_2) FROM subject UNION ALL SELECT 'cov_2', 'cov_1', sum(cov_1 * cov_2) FROM subject
        UNION ALL SELECT 'cov_1', 'cov_1', sum(cov_1 * cov_1) FROM subject UNION ALL SELECT 'cov_2', 'cov_2', sum(cov_2 * cov_2) FROM subject)""")
def gram_cov(v: Views) -> DataFrame:
    return a.gram_cov(v.subject, ["cov_1", "cov_2"]).withColumn("v", r6("v"))


@query("genotype_sparse customer_design", f"""
    SELECT s.variant_id, {sql6('sum(dosage)')} AS g, {sql6('sum(dosage * nation)')} AS gx_nation,
           {sql6('sum(dosage * dosage)')} AS gg
    FROM genotype_sparse s JOIN customer_design USING (subject_id) GROUP BY s.variant_id""")
def gram_test(v: Views) -> DataFrame:
    stats = a.gram_test(v.genotype_sparse, v.customer_design, ["nation"], sparse=True)
    return stats.select("variant_id", *[r6(c).alias(c) for c in ("g", "gx_nation", "gg")])


@query("subject", f"""
    SELECT i, trait, {sql6('v')} AS v FROM (
        SELECT 'intercept' AS i, 'label_reg' AS trait, sum(label_reg) AS v FROM subject
        UNION ALL SELECT 'cov_1', 'label_reg', sum(cov_1 * label_reg) FROM subject
        UNION ALL SELECT 'intercept', 'cov_2', sum(cov_2) FROM subject
        UNION ALL SELECT 'cov_1', 'cov_2', sum(cov_1 * cov_2) FROM subject)""")
def cross_cov(v: Views) -> DataFrame:
    return a.cross_cov(v.subject, ["cov_1"], PHENOTYPES).withColumn("v", r6("v"))


@query("trait", f"SELECT trait, {sql6('sum(value * value)')} AS v FROM trait WHERE trait <> 'label_bin' GROUP BY trait")
def trait_ss(v: Views) -> DataFrame:
    return a.trait_ss(v.subject, PHENOTYPES).withColumn("v", r6("v"))


@query("genotype trait", f"""
    SELECT variant_id, trait, {sql6('sum(dosage * value)')} AS v FROM genotype JOIN trait USING (subject_id)
    WHERE trait <> 'label_bin' GROUP BY variant_id, trait""")
def cross_gen(v: Views) -> DataFrame:
    return a.cross_gen(v.genotype, v.subject, PHENOTYPES).withColumn("v", r6("v"))


@query("genotype subject", f"""
    WITH s AS (
        SELECT variant_id, CAST(count(*) AS DOUBLE) AS n, sum(cov_1) AS c, sum(cov_1 * cov_1) AS cc, CAST(sum(dosage) AS DOUBLE) AS g,
               CAST(sum(dosage * dosage) AS DOUBLE) AS gg, sum(dosage * cov_1) AS gc FROM genotype JOIN subject USING (subject_id) GROUP BY variant_id),
    d AS (SELECT *, n * (cc * gg - gc * gc) - c * (c * gg - gc * g) + g * (c * gc - cc * g) AS det FROM s)
    SELECT variant_id, i, j, {sql6('v')} AS v FROM (
        SELECT variant_id, 0 AS i, 0 AS j, (cc * gg - gc * gc) / det AS v FROM d
        UNION ALL SELECT variant_id, 0, 1, (g * gc - c * gg) / det FROM d UNION ALL SELECT variant_id, 1, 0, (g * gc - c * gg) / det FROM d
        UNION ALL SELECT variant_id, 0, 2, (c * gc - g * cc) / det FROM d UNION ALL SELECT variant_id, 2, 0, (c * gc - g * cc) / det FROM d
        UNION ALL SELECT variant_id, 1, 1, (n * gg - g * g) / det FROM d
        UNION ALL SELECT variant_id, 1, 2, (c * g - n * gc) / det FROM d UNION ALL SELECT variant_id, 2, 1, (c * g - n * gc) / det FROM d
        UNION ALL SELECT variant_id, 2, 2, (n * cc - c * c) / det FROM d)""")
def bordered_inverse(v: Views) -> DataFrame:
    design = materialise(v.subject.select("subject_id", "cov_1"))
    model = a.read_model(a.cohort_stats(design, ["cov_1"], []), ["cov_1"], [])
    variants = a.variant_stats(v.genotype, design, ["cov_1"], [])
    return a.bordered_inverse(variants, model).withColumn("v", r6("v"))


@query("genotype subject trait", f"WITH {single_covariate(DENSE_CELLS)} SELECT * FROM result")
def gwas_dense(v: Views) -> DataFrame:
    return rounded(a.gwas(v.genotype, v.subject, ["cov_1"], PHENOTYPES))


@query("genotype_missing subject trait", f"WITH {single_covariate(IMPUTED_CELLS)} SELECT * FROM result")
def gwas_imputed(v: Views) -> DataFrame:
    return rounded(a.gwas(v.genotype_missing, v.subject, ["cov_1"], PHENOTYPES))


@query("genotype subject trait", f"WITH {single_covariate(DENSE_CELLS)} SELECT * FROM result WHERE af > 0.49e0 AND af < 0.51e0 AND af <> 0.5e0")
def gwas_frequency_filtered(v: Views) -> DataFrame:
    return rounded(a.gwas(v.genotype, v.subject, ["cov_1"], PHENOTYPES, maf=0.49))


@query("genotype subject trait", f"WITH {single_covariate(DENSE_CELLS)} SELECT * FROM result WHERE abs(t_stat) > 1")
def gwas_significant(v: Views) -> DataFrame:
    return rounded(a.gwas(v.genotype, v.subject, ["cov_1"], PHENOTYPES, threshold=1.0))


@query("genotype subject trait", f"""WITH {single_covariate(DENSE_CELLS.replace("CAST(dosage AS DOUBLE)", "dosage * cov_2").replace("trait <> 'label_bin'", "trait = 'label_reg'"))}
    SELECT * FROM result""")
def gwas_interaction(v: Views) -> DataFrame:
    return rounded(a.gwas(v.genotype, v.subject, ["cov_1"], ["label_reg"], factor="cov_2"))


@query("genotype subject", f"""
    WITH c AS (SELECT variant_id, dosage, cov_1, cov_2, label_reg AS y FROM genotype JOIN subject USING (subject_id)),
    s AS (
        SELECT variant_id, count(*) AS n, avg(dosage) / 2 AS af, covar_pop(dosage, dosage) * count(*) AS gg, covar_pop(y, y) * count(*) AS yy,
               covar_pop(dosage, y) * count(*) AS gy, covar_pop(cov_1, cov_1) * count(*) AS aa, covar_pop(cov_2, cov_2) * count(*) AS bb,
               covar_pop(cov_1, cov_2) * count(*) AS ab, covar_pop(dosage, cov_1) * count(*) AS ga, covar_pop(dosage, cov_2) * count(*) AS gb,
               covar_pop(y, cov_1) * count(*) AS ya, covar_pop(y, cov_2) * count(*) AS yb FROM c GROUP BY variant_id),
    p AS (
        SELECT *, gg - (ga * ga * bb - 2 * ga * gb * ab + gb * gb * aa) / (aa * bb - ab * ab) AS rgg,
               gy - (ga * ya * bb - (ga * yb + gb * ya) * ab + gb * yb * aa) / (aa * bb - ab * ab) AS rgy,
               yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab) AS ryy FROM s),
    q AS (SELECT *, rgy / rgg AS beta, sqrt((ryy - rgy * rgy / rgg) / ((n - 4) * rgg)) AS se FROM p)
    SELECT variant_id, 'label_reg' AS trait, {sql6('af')} AS af, {sql6('beta')} AS beta, {sql6('se')} AS se,
           {sql6('beta / se')} AS t_stat, CAST(n - 4 AS BIGINT) AS df FROM q""")
def gwas_two_covariates(v: Views) -> DataFrame:
    return rounded(a.gwas(v.genotype, v.subject, ["cov_1", "cov_2"], ["label_reg"]))


SPARSE_SUMS = f"""
    m AS (SELECT count(*) AS n, avg(nation) AS mc, avg(balance) AS mb, avg(score) AS ms FROM customer_design),
    d AS (SELECT subject_id, nation - mc AS c, balance - mb AS balance, score - ms AS score, n FROM customer_design, m),
    k AS (SELECT sum(c * c) AS cc, sum(c * balance) AS cb, sum(c * score) AS cs, sum(balance * balance) AS bb, sum(score * score) AS ss FROM d),
    v AS (SELECT variant_id, max(n) AS n, sum(dosage) AS g, sum(dosage * dosage) AS g2, sum(dosage * c) AS gc,
                 sum(dosage * balance) AS gb, sum(dosage * score) AS gs FROM genotype_sparse JOIN d USING (subject_id) GROUP BY variant_id),
    w AS (
        SELECT variant_id, 'balance' AS trait, n, g / (2.0e0 * n) AS af, g2 - g * g / CAST(n AS DOUBLE) AS gg, gc, gb AS gy, cb AS cy, bb AS yy, cc FROM v, k
        UNION ALL SELECT variant_id, 'score', n, g / (2.0e0 * n), g2 - g * g / CAST(n AS DOUBLE), gc, gs, cs, ss, cc FROM v, k),
    q AS (SELECT *, nullif(gg - gc * gc / cc, 0) AS rgg, gy - gc * cy / cc AS rgy, yy - cy * cy / cc AS ryy FROM w),
    t AS (SELECT *, rgy / rgg AS beta, sqrt((ryy - rgy * rgy / rgg) / ((n - 3) * rgg)) AS se FROM q WHERE rgg > 1e-9)
    SELECT variant_id, trait, {sql6('af')} AS af, {sql6('beta')} AS beta, {sql6('se')} AS se, {sql6('beta / se')} AS t_stat,
           CAST(n - 3 AS BIGINT) AS df FROM t WHERE abs(beta / se) > 0"""


@query("genotype_sparse customer_design", f"WITH {SPARSE_SUMS}")
def gwas_sparse(v: Views) -> DataFrame:
    """Cells that are not listed count as dosage 0."""
    found = a.gwas(v.genotype_sparse, v.customer_design, ["nation"], ["balance", "score"], sparse=True, threshold=0.0)
    return rounded(found)


@query("genotype_sparse customer_design", f"WITH {SPARSE_SUMS}")
def gwas_sparse_tiles(v: Views) -> DataFrame:
    """The same tests by blocked matrix products over tiles of subjects."""
    tiles = materialise(g.to_variant_major(v.genotype_sparse, tile=512))
    return rounded(a.gwas_tiles(tiles, v.customer_design, ["nation"], ["balance", "score"], tile=512, sparse=True, threshold=0.0))


@query("genotype_missing subject trait", f"WITH {single_covariate(IMPUTED_CELLS)} SELECT * FROM result")
def gwas_imputed_tiles(v: Views) -> DataFrame:
    tiles = g.to_variant_major(v.genotype_missing, tile=128)
    return rounded(a.gwas_tiles(tiles, v.subject, ["cov_1"], PHENOTYPES, tile=128, traits_per_pass=1))


@query("genotype subject trait", f"""WITH {single_covariate(DENSE_CELLS)},
    back AS (SELECT variant_id, trait, af, se, beta / nullif(se, 0) AS t, beta FROM tested)
    SELECT variant_id AS RSID, {sql6('t')} AS t_stat, trait AS phenotype, {sql6('se')} AS SE, {sql6('af')} AS MAF, {sql6('beta')} AS BETA FROM back""")
def gwas_summary(v: Views) -> DataFrame:
    table = a.summarise(a.gwas(v.genotype, v.subject, ["cov_1"], PHENOTYPES))
    return table.select("RSID", "phenotype", *[r6(c).alias(c) for c in ("t_stat", "SE", "MAF", "BETA")])


@query("genotype subject trait", f"""
    WITH {single_covariate(DENSE_CELLS)},
    exact AS (SELECT variant_id, trait, beta / nullif(se, 0) AS t, df FROM tested),
    angles AS (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM exact),
    dfs AS (SELECT DISTINCT df FROM tested),
    -- Terms of the finite series of the t distribution: powers k of the cosine, even or odd as df is not.
    powers AS (SELECT df, unnest(range(df % 2, df - 1, 2)) AS k FROM dfs),
    terms AS (SELECT df, k, exp(sum(CASE WHEN k > df % 2 THEN ln((k - 1.0e0) / k) ELSE 0 END) OVER (PARTITION BY df ORDER BY k)) AS c FROM powers),
    series AS (SELECT variant_id, trait, any_value(t) AS t, any_value(a) AS a, df, sum(c * pow(cos(a), k)) AS s
               FROM angles JOIN terms USING (df) GROUP BY variant_id, trait, df)
    SELECT variant_id AS RSID, trait AS phenotype, {sql6('t')} AS t_stat,
           {sql6('CASE WHEN df % 2 = 0 THEN 1 - sin(a) * s ELSE 1 - 2 / pi() * (a + sin(a) * s) END')} AS p_value FROM series""")
def gwas_p_values(v: Views) -> DataFrame:
    """Two-sided Student p-values of every test; the SQL sums the finite series for whole degrees of freedom."""
    table = a.summarise(a.gwas(v.genotype, v.subject, ["cov_1"], PHENOTYPES))
    return table.select("RSID", "phenotype", r6("t_stat").alias("t_stat"), r6("p_value").alias("p_value"))


@query("genotype subject", f"""
    WITH ranked AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) AS r FROM subject),
    shuffled AS (SELECT label_reg, row_number() OVER (ORDER BY {sql_order('subject_id', 7)}, subject_id) AS r FROM subject),
    given AS (SELECT subject_id, label_reg AS y FROM ranked JOIN shuffled USING (r)),
    {single_covariate("SELECT variant_id, 'label_reg' AS trait, CAST(dosage AS DOUBLE) AS g, cov_1 AS c, y FROM genotype JOIN subject USING (subject_id) JOIN given USING (subject_id)")}
    SELECT * FROM result""")
def gwas_permuted(v: Views) -> DataFrame:
    design = v.subject.select("subject_id", "cov_1", "label_reg")
    return rounded(a.gwas(v.genotype, a.permute_traits(design, ["label_reg"], seed=7), ["cov_1"], ["label_reg"]))


# ---------------------------------------------------------------- studies


@query("genotype subject", f"""
    SELECT study, variant_id, n, {sql6('g')} AS g, {sql6('gg')} AS gg, {sql6('gc')} AS gx_cov_1, {sql6('gy')} AS gy_label_reg
    FROM (SELECT study, variant_id, count(*) AS n, sum(dosage) AS g, sum(dosage * dosage) AS gg, sum(dosage * cov_1) AS gc,
                 sum(dosage * label_reg) AS gy FROM genotype JOIN subject USING (subject_id) GROUP BY study, variant_id)""")
def partial_derivatives(v: Views) -> DataFrame:
    _, variants = a.partial_derivatives(v.genotype, v.subject, ["cov_1"], ["label_reg"])
    return variants.select("study", "variant_id", "n", *[r6(c).alias(c) for c in ("g", "gg", "gx_cov_1", "gy_label_reg")])


def study_stats(v: Views) -> tuple[DataFrame, DataFrame]:
    cohort, variants = a.partial_derivatives(v.genotype, v.subject, ["cov_1"], PHENOTYPES)
    return materialise(cohort), materialise(variants)


@query("genotype subject trait", f"WITH {single_covariate(DENSE_CELLS)} SELECT * FROM result")
def meta_analysis(v: Views) -> DataFrame:
    """Pooled statistics of three studies equal the joint regression."""
    cohort, variants = study_stats(v)
    return rounded(a.meta_analyse(cohort, variants, ["cov_1"], PHENOTYPES))


@query("genotype subject trait", f"WITH {single_covariate(DENSE_CELLS)} SELECT * FROM result")
def meta_from_shards(v: Views) -> DataFrame:
    """Statistics computed by two workers over disjoint variants, appended, saved and loaded."""
    halves = [v.genotype.filter("variant_id % 2 = 0"), v.genotype.filter("variant_id % 2 = 1")]
    parts = [a.partial_derivatives(half, v.subject, ["cov_1"], PHENOTYPES) for half in halves]
    path = f"{intermediates(v.spark)}/{uuid.uuid4().hex}"
    sinks.save_stats(parts[0][0], a.merge_stats([p[1] for p in parts]), path)
    cohort, variants = sinks.load_stats(v.spark, path)
    return rounded(a.meta_analyse(cohort, variants, ["cov_1"], PHENOTYPES))


@query("genotype subject", f"""
    WITH c AS (
        SELECT variant_id, dosage - avg(dosage) OVER w AS g, cov_1 - avg(cov_1) OVER w AS c, label_reg - avg(label_reg) OVER w AS y, dosage
        FROM genotype JOIN subject USING (subject_id) WINDOW w AS (PARTITION BY variant_id, study)),
    s AS (SELECT variant_id, count(*) AS n, avg(dosage) / 2 AS af, sum(g * g) AS gg, sum(c * c) AS cc, sum(y * y) AS yy, sum(g * c) AS gc,
                 sum(g * y) AS gy, sum(c * y) AS cy FROM c GROUP BY variant_id),
    q AS (SELECT *, gg - gc * gc / cc AS rgg, gy - gc * cy / cc AS rgy, yy - cy * cy / cc AS ryy FROM s),
    t AS (SELECT *, rgy / rgg AS beta, sqrt((ryy - rgy * rgy / rgg) / ((n - 5) * rgg)) AS se FROM q)
    SELECT variant_id, 'label_reg' AS trait, {sql6('af')} AS af, {sql6('beta')} AS beta, {sql6('se')} AS se, {sql6('beta / se')} AS t_stat,
           CAST(n - 5 AS BIGINT) AS df FROM t""")
def meta_study_intercepts(v: Views) -> DataFrame:
    """An intercept per study removes the study means."""
    design, names = a.with_study_intercepts(v.subject, [0, 1, 2])
    covs = [*names, "cov_1"]
    cohort, variants = a.partial_derivatives(v.genotype, design, covs, ["label_reg"])
    return rounded(a.meta_analyse(materialise(cohort), materialise(variants), covs, ["label_reg"]))


@query("genotype subject", f"SELECT variant_id, {sql6('avg(dosage) / 2')} AS af FROM genotype JOIN subject USING (subject_id) GROUP BY variant_id")
def meta_frequency(v: Views) -> DataFrame:
    _, variants = a.partial_derivatives(v.genotype, v.subject, ["cov_1"], [], full=False)
    return a.meta_frequency(variants).withColumn("af", r6("af"))


@query("genotype_sparse", f"""
    SELECT variant_id, {sql6('stddev_pop(af)')} AS af_std
    FROM (SELECT subject_id % 3 AS study, variant_id, sum(dosage) / (2.0e0 * count(*)) AS af FROM genotype_sparse GROUP BY 1, 2)
    GROUP BY variant_id HAVING stddev_pop(af) > 0.1e0""")
def frequency_conflicts(v: Views) -> DataFrame:
    per_study = v.genotype_sparse.groupBy((F.col("subject_id") % 3).alias("study"), "variant_id").agg(
        F.sum("dosage").alias("g"), F.count(F.lit(1)).alias("n")
    )
    return a.frequency_conflicts(per_study).withColumn("af_std", r6("af_std"))


@query("subject", f"""
    SELECT study, figure, i, j, {sql6('value')} AS value FROM (
        SELECT study, 'gram' AS figure, 'intercept' AS i, 'intercept' AS j, 1.0e0 AS value FROM subject GROUP BY study
        UNION ALL SELECT study, 'gram', 'intercept', 'cov_1', avg(cov_1) FROM subject GROUP BY study
        UNION ALL SELECT study, 'gram', 'cov_1', 'intercept', avg(cov_1) FROM subject GROUP BY study
        UNION ALL SELECT study, 'gram', 'cov_1', 'cov_1', avg(cov_1 * cov_1) FROM subject GROUP BY study
        UNION ALL SELECT study, 'trait_mean', 'intercept', 'label_reg', avg(label_reg) FROM subject GROUP BY study)""")
def stats_report(v: Views) -> DataFrame:
    cohort = a.cohort_stats(v.subject, ["cov_1"], ["label_reg"], by=["study"])
    return a.stats_report(materialise(cohort)).withColumn("value", r6("value"))


@query("genotype trait", """
    SELECT variant_id, trait, round(sum(dosage * value), 3) + 0.0e0 AS v FROM genotype JOIN trait USING (subject_id)
    WHERE trait <> 'label_bin' GROUP BY variant_id, trait""")
def masked_cross_products(v: Views) -> DataFrame:
    """Masking both sides leaves the cross products; the masks cost some digits."""
    traits = v.trait.filter("trait <> 'label_bin'")
    cells, values = a.encode_pair(v.genotype, traits, v.subject, seed=11)
    found = a.masked_cross(materialise(cells), materialise(values), PHENOTYPES)
    return found.withColumn("v", F.round("v", 3) + F.lit(0.0))


@query("genotype subject", f"SELECT variant_id, {sql6('avg(dosage) / 2')} AS af, CAST(3 AS BIGINT) AS studies FROM genotype JOIN subject USING (subject_id) GROUP BY variant_id")
def statistics_stream(v: Views) -> DataFrame:
    """Statistics pooled by a stream over files that arrive study by study."""
    _, variants = a.partial_derivatives(v.genotype, v.subject, ["cov_1"], ["label_reg"])
    root = f"{intermediates(v.spark)}/{uuid.uuid4().hex}"
    variants.repartition("study").write.parquet(f"{root}/in")
    arriving = statistics.arriving_statistics(v.spark, f"{root}/in", variants.schema)
    statistics.pool_arrived(arriving, f"{root}/out", f"{root}/state")
    pooled = statistics.latest_pool(v.spark, f"{root}/out")
    return pooled.select("variant_id", r6(F.col("g") / (2 * F.col("n"))).alias("af"), "studies")
