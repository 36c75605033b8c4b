"""Cases that an earlier version answered wrongly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions.text import chromosome_code, clean_gene
from locusframe.operators import association, interpret, tiles
from locusframe.operators.genotype import to_subject_major, to_variant_major
from locusframe.sources import tables, vcf


def test_decimal_labels_and_missing_labels(spark):
    rows = [("a", "170.5", 0, 1), ("b", "1", 1, 1)]
    names = "patient_id string, labels string, genotype_row int, set int"
    assert [r.label for r in tables.check_subjects(spark.createDataFrame(rows, names), True).orderBy("subject_id").collect()] == [170.5, 1.0]
    with pytest.raises(ValueError):
        tables.check_subjects(spark.createDataFrame(rows, names), False)
    with pytest.raises(ValueError):
        tables.check_subjects(spark.createDataFrame([*rows, ("c", None, 2, 1)], names), True)


def test_repeated_trait_names_are_refused(spark, tmp_path):
    (tmp_path / "t.txt").write_text("id y y\na 1 2\n")
    with pytest.raises(ValueError):
        tables.read_wide_traits(spark, str(tmp_path / "t.txt"))


def test_chromosome_names(spark):
    names = ["1", "chr1", "X", "chrY", "XY", "MT", "un"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(chromosome_code(F.col("n"))).collect()] == [1, 1, 23, 24, 25, 26, None]


def test_gene_name_with_two_brackets(spark):
    df = spark.createDataFrame([("A(x)B(y)C",)], "n string")
    assert df.select(clean_gene(F.col("n"))).first()[0] == "AC"


def _vcf(samples, calls):
    head = "##FORMAT=<ID=GT,Number=1>\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])
    return head + "\n" + "\t".join(["chrX", "5", "v1", "A", "C", ".", ".", ".", "GT", *calls]) + "\n"


def test_vcf_of_other_samples_is_refused_and_haploid_calls_are_read(spark, tmp_path):
    for name, samples in (("a", ["A", "B"]), ("b", ["B", "A"])):
        (tmp_path / f"{name}.vcf").write_text(_vcf(samples, ["1", "0/1"]))
    with pytest.raises(ValueError):
        vcf.read_vcf_dosage(spark, str(tmp_path / "*.vcf"))
    rows = vcf.read_vcf_dosage(spark, str(tmp_path / "a.vcf")).orderBy("subject_row").collect()
    assert [(r.chr, r.dosage) for r in rows] == [(23, 1.0), (23, 1.0)]


def test_equal_strengths_have_no_auc(spark):
    ranking = spark.createDataFrame([("1 2 ", 1.0), ("1 3 ", 1.0)], "coord string, strength double")
    causal = spark.createDataFrame([(1,), (2,)], "variant_id long")
    assert interpret.epistasis_auc(ranking, causal, 10).first().auc == 0.0


def test_separated_labels_have_no_logit(spark):
    acts = spark.createDataFrame([(s, 0, float(s - 5)) for s in range(11)], "subject_id long, node long, value double")
    labels = spark.createDataFrame([(s, float(s > 5)) for s in range(11)], "subject_id long, y double")
    row = interpret.univariate_logit(acts, labels).first()
    assert row.beta is None and row.pseudo_r2 is None


def test_a_missing_call_is_imputed_before_masking(spark):
    rng = np.random.default_rng(3)
    dosage, trait = rng.integers(0, 3, 30).astype(float), rng.normal(size=30)
    geno = spark.createDataFrame([(s, 7, None if s == 4 else float(dosage[s])) for s in range(30)], "subject_id long, variant_id long, dosage double")
    traits = spark.createDataFrame([(s, "y", float(trait[s])) for s in range(30)], "subject_id long, trait string, value double")
    masked = association.encode_pair(geno, traits, geno.select("subject_id"), 1)
    dosage[4] = np.delete(dosage, 4).mean()
    assert association.masked_cross(*masked, ["y"]).first().v == pytest.approx(dosage @ trait, rel=1e-6)


def test_tiles_take_one_shuffle_and_the_largest_copy(spark):
    rows = [(1, 0, None), (1, 0, 1.0), (1, 0, 2.0), (1, 0, 2.0), (1, 1, None), (1, 1, None), (1, 5, 0.0), (2, 3, 1.0)]
    geno = spark.createDataFrame(rows, "subject_id long, variant_id long, dosage double")
    tiles = to_subject_major(geno, 4)
    planned = tiles._jdf.queryExecution().executedPlan().toString()  # before it runs, a plan shows each exchange once
    assert planned.count("Exchange hashpartitioning") == 1, planned
    found = {(r.subject_id, r.tile): (r.variant_ids, r.dosages) for r in tiles.collect()}
    assert found == {(1, 0): ([0, 1], [2.0, None]), (1, 1): ([5], [0.0]), (2, 0): ([3], [1.0])}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_sparse_squares_are_turned_together(spark, batch):
    """Many squares of few cells, some cut by a batch, missing calls and missing ids among them."""
    cells = [(s, s * 7 % 11 + 40 * (s % 3), None if s % 5 == 0 else s % 3) for s in range(60)]
    cells += [(s, v, 2) for s in range(4) for v in range(200, 208)] + [(None, 3, 1), (None, 201, 1), (5, None, 1), (9, None, None)]
    geno = spark.createDataFrame(cells, "subject_id long, variant_id long, dosage int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        turned = tiles.transpose(to_variant_major(geno, 4), 4)
        # One call for each square would cost by their number, which grows with the square of the sides.
        assert "FlatMapGroupsInArrow" not in turned._jdf.queryExecution().toString()
        found = [tuple(r) for r in turned.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = [tuple(r) for r in to_subject_major(geno, 4).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def _sparse_study(spark):
    """400 variants listed once or twice in each of few tiles of 16 of 300 subjects, some missing or of no one."""
    rng = np.random.default_rng(8)
    cells = {(int(s), int(v)): None if rng.random() < 0.1 else int(rng.integers(1, 3)) for v in range(400) for s in rng.integers(0, 310, 12)}
    rows = [(s, v, d) for (s, v), d in cells.items()] + [(s, None, 1) for s in range(0, 300, 30)] + [(None, 3, 2), (None, None, 2)]
    geno = spark.createDataFrame(rows, "subject_id long, variant_id long, dosage int")
    design = [(s, float(c), float(y)) for s, c, y in zip(range(300), rng.normal(5, 2, 300), rng.normal(9, 3, 300), strict=True)]
    return geno, spark.createDataFrame(design, "subject_id long, c double, y double")


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_sparse_tiles_multiply_listed_cells_alone(spark, monkeypatch, limit):
    """Dense blocks cost by variants times subjects; neither way of joining the design may make them here."""
    geno, design = _sparse_study(spark)
    monkeypatch.setattr(association, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(association, "CELLS_PER_LISTED", 4)  # the tiles are narrow
    monkeypatch.setattr(association, "_block_products", None)
    left = association.gwas(geno, design, ["c"], ["y"], sparse=True).toPandas()
    right = association.gwas_tiles(to_variant_major(geno, 16), design, ["c"], ["y"], tile=16, sparse=True, variants_per_group=20).toPandas()
    left, right = (d.sort_values("variant_id", na_position="last").reset_index(drop=True) for d in (left, right))
    assert left["variant_id"].equals(right["variant_id"]) and right["variant_id"].isna().sum() == 1
    names = ["af", "beta", "se", "t_stat", "df"]
    assert np.allclose(left[names].astype(float), right[names].astype(float), equal_nan=True)


def test_design_rows_are_copied_by_the_cells_of_their_tile(spark, monkeypatch):
    geno, design = _sparse_study(spark)
    monkeypatch.setattr(association, "BROADCAST_BYTES", 0)
    handed = spark.sparkContext.accumulator(0)
    products = association._design_tile

    def counted(ids, values, tile):
        handed.add(len(ids))
        return products(ids, values, tile)

    monkeypatch.setattr(association, "_design_tile", counted)
    few = to_variant_major(geno.filter("subject_id < 32 or variant_id = 0"), 16)
    association.gwas_tiles(few, design, ["c"], ["y"], tile=16, sparse=True, variants_per_group=20, n_variants=400).count()
    rows = few.count()
    assert 0 < handed.value <= 300 + 16 * (rows // 20 + 1)
