"""Readers and writers on small files."""

import numpy as np
import pytest

from locusframe.operators.genotype import from_tiles
from locusframe.sources import minimac, plink, sinks, tables, vcf

FAM = "fam{0}\tid{0}\t0\t0\t1\t{1}\n"
BIM = "1\tsnp{0}\t0\t{1}\tA\tC\n"


def write_fileset(folder, dosages):
    """`dosages` variants × individuals with -1 for missing."""
    codes = {0: 0, -1: 1, 1: 2, 2: 3}
    n = dosages.shape[1]
    (folder / "x.fam").write_text("".join(FAM.format(i, i % 2 + 1) for i in range(n)))
    (folder / "x.bim").write_text("".join(BIM.format(i, 100 + i) for i in range(len(dosages))))
    rows = b"\x6c\x1b\x01"
    for row in dosages:
        for start in range(0, n, 4):
            rows += bytes([sum(codes[int(d)] << (2 * k) for k, d in enumerate(row[start : start + 4]))])
    (folder / "x.bed").write_bytes(rows)
    return str(folder / "x")


def test_bed_known_bytes(spark, tmp_path):
    """Two variants, two individuals: 0f decodes to 2, 2 and 0a to 1, 1."""
    (tmp_path / "t.fam").write_text(FAM.format(0, 1) + FAM.format(1, 2))
    (tmp_path / "t.bim").write_text(BIM.format(0, 1) + BIM.format(1, 2))
    (tmp_path / "t.bed").write_bytes(b"\x6c\x1b\x01\x0f\x0a")
    rows = plink.read_bed(spark, str(tmp_path / "t")).orderBy("variant_id").collect()
    assert [list(r.dosages) for r in rows] == [[2, 2], [1, 1]]


def test_bed_round_trip_in_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plink, "BYTES_PER_PARTITION", 60)
    monkeypatch.setattr(plink, "BYTES_PER_BATCH", 16)
    dosages = np.random.default_rng(1).integers(-1, 3, (37, 23))
    tiles = plink.read_bed(spark, write_fileset(tmp_path, dosages), tile=8)
    cells = from_tiles(tiles, "variant_id", "subject_id", "subject_ids").collect()
    assert len(cells) == 37 * 23
    for c in cells:
        expected = dosages[c.variant_id, c.subject_id]
        assert c.dosage == (None if expected < 0 else expected)


@pytest.mark.parametrize("head", [b"\x00\x1b\x01", b"\x6c\x1b\x00"])
def test_bed_refuses_other_files(spark, tmp_path, head):
    prefix = write_fileset(tmp_path, np.zeros((2, 2), int))
    (tmp_path / "x.bed").write_bytes(head + b"\x0f\x0a")
    with pytest.raises(Exception, match="not"):
        plink.read_bed(spark, prefix).count()


def test_bed_refuses_wrong_size(spark, tmp_path):
    prefix = write_fileset(tmp_path, np.zeros((2, 2), int))
    (tmp_path / "x.bed").write_bytes(b"\x6c\x1b\x01\x0f")
    with pytest.raises(Exception, match="does not hold"):
        plink.read_bed(spark, prefix).count()


def test_fam_and_bim(spark, tmp_path):
    prefix = write_fileset(tmp_path, np.zeros((3, 5), int))
    fam = plink.read_fam(spark, f"{prefix}.fam").orderBy("subject_row").collect()
    assert [(r.subject_row, r.individual, r.label) for r in fam] == [(i, f"id{i}", i % 2 + 1) for i in range(5)]
    bim = plink.read_bim(spark, f"{prefix}.bim").orderBy("variant_row").collect()
    assert [(r.variant_row, r.variant_id, r.bp, r.allele1) for r in bim] == [(i, f"snp{i}", 100 + i, "A") for i in range(3)]
    frame = plink.read_fam(spark, f"{prefix}.fam")
    assert plink.same_individuals(frame, frame)
    assert not plink.same_individuals(frame, frame.filter("subject_row > 0"))


def test_filesets_are_chained(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).mkdir()
    a = write_fileset(tmp_path / "a", np.full((2, 3), 1))
    b = write_fileset(tmp_path / "b", np.full((1, 3), 2))
    rows = plink.read_filesets(spark, [a, b]).orderBy("variant_id").collect()
    assert [(r.variant_id, list(r.dosages)) for r in rows] == [(0, [1, 1, 1]), (1, [1, 1, 1]), (2, [2, 2, 2])]
    with pytest.raises(ValueError):
        plink.read_filesets(spark, [a, write_fileset(tmp_path / "c", np.zeros((1, 4), int))])


def test_fam_with_spaces(spark, tmp_path):
    (tmp_path / "s.fam").write_text("f1 a 0 0 1 2\nf2 b 0 0 2 -9\n")
    rows = plink.read_fam(spark, str(tmp_path / "s.fam")).orderBy("subject_row").collect()
    assert [(r.family, r.individual, r.sex, r.label) for r in rows] == [("f1", "a", 1, 2), ("f2", "b", 2, -9)]


VCF = """##fileformat=VCFv4.2
##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\ts4
1\t100\trs1\tA\tG\t.\tPASS\t.\tGT:DS\t0/0:0.1\t0|1:1.2\t1/1:2.0\t./.:.
1\t200\trs2\tC\tT,G\t.\tPASS\t.\tDS:GT\t0.5:0/2\t1.5:2|2\t.:1/0\t0.0:0/.
"""


def test_vcf(spark, tmp_path):
    path = str(tmp_path / "a.vcf")
    (tmp_path / "a.vcf").write_text(VCF)
    assert vcf.declared_field(spark, path) == "GT"
    assert [r.individual for r in vcf.read_vcf_samples(spark, path).orderBy("subject_row").collect()] == ["s1", "s2", "s3", "s4"]
    variants = vcf.read_vcf_variants(spark, path).orderBy("variant_row").collect()
    assert [(r.variant_row, r.variant_id, r.bp, r.counted_allele) for r in variants] == [(0, "rs1", 100, "A"), (1, "rs2", 200, "C")]

    def dosages(field):
        rows = vcf.read_vcf_dosage(spark, path, field).orderBy("variant_id", "subject_row").collect()
        return [r.dosage for r in rows]

    assert dosages(None) == [2, 1, 0, None, 1, 0, 1, None]
    for width in (3, 4):
        cells = from_tiles(vcf.read_vcf_tiles(spark, path, tile=width), "variant_id", "subject_id", "subject_ids")
        assert [r.dosage for r in cells.orderBy("variant_id", "subject_id").collect()] == dosages(None)
    assert dosages("DS") == pytest.approx([1.9, 0.8, 0.0, None, 1.5, 0.5, None, 2.0])


def test_minimac(spark, tmp_path):
    for chunk, names in (("c1", ["rs1", "rs2"]), ("c2", ["rs3"])):
        lines = ["SNP Al1 Al2 Freq1 MAF Quality Rsq"] + [f"{n} A C 0.7 0.3 0.9 0.8" for n in names]
        (tmp_path / f"{chunk}.info").write_text("\n".join(lines) + "\n")
        rows = [f"f{i}->i{i} DOSE " + " ".join(f"{(i + k) % 3}.25" for k in range(len(names))) for i in range(3)]
        (tmp_path / f"{chunk}.dose").write_text("\n".join(rows) + "\n")
    info = minimac.read_info(spark, str(tmp_path)).orderBy("variant_id").collect()
    assert [(r.variant_id, r.position, r.maf, r.rsq) for r in info] == [("rs1", 0, 0.3, 0.8), ("rs2", 1, 0.3, 0.8), ("rs3", 0, 0.3, 0.8)]
    cells = {(r.variant_id, r.individual): r.dosage for r in minimac.read_minimac(spark, str(tmp_path)).collect()}
    assert len(cells) == 9
    assert cells["rs2", "i1"] == 2.25 and cells["rs3", "i2"] == 2.25


@pytest.mark.parametrize("sep", ["\t", " "])
def test_traits(spark, tmp_path, sep):
    (tmp_path / "t.txt").write_text(sep.join(["id", "height", "bmi"]) + "\n" + sep.join(["a", "1.5", "20"]) + "\n" + sep.join(["b", "1.7", "NA"]) + "\n")
    rows = tables.read_traits(spark, str(tmp_path / "t.txt")).collect()
    assert {(r.subject_id, r.trait): r.value for r in rows} == {("a", "height"): 1.5, ("a", "bmi"): 20.0, ("b", "height"): 1.7, ("b", "bmi"): None}


def test_traits_must_be_unique(spark):
    good = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "subject_id string, trait string, value double")
    assert tables.validate_traits(good).count() == 2
    with pytest.raises(ValueError):
        tables.validate_traits(good.unionByName(good))


def test_subjects(spark, tmp_path):
    path = tmp_path / "subjects.csv"
    path.write_text("patient_id,labels,genotype_row,set,cov_age\np1,0,0,1,30\np2,1,1,2,40\n")
    df = tables.read_subjects(spark, str(path))
    assert df.columns == ["subject_id", "label", "genotype_row", "set_id", "cov_age"]
    with pytest.raises(ValueError):
        tables.read_subjects(spark, str(path), regression=True)
    path.write_text("patient_id,labels,set\np1,0,1\n")
    with pytest.raises(ValueError, match="genotype_row"):
        tables.read_subjects(spark, str(path))


def test_reference_and_pathways(spark, tmp_path):
    (tmp_path / "r.txt").write_text("ID allele1 allele2 CHR bp\nrs1 A C 1 100\n")
    assert tables.read_reference(spark, str(tmp_path / "r.txt")).first().asDict() == {
        "variant_id": "rs1", "chr": 1, "bp": 100, "allele1": "A", "allele2": "C"
    }
    (tmp_path / "p.tab").write_text("pathway\texternal_id\tsource\thgnc_symbol_ids\nP\tpath:hsa00010\tKEGG\tG1,G2\nQ\tx\tOther\tG3\n")
    rows = tables.read_pathways(spark, str(tmp_path / "p.tab")).orderBy("listed").collect()
    assert [(r.source, r.external_id, r.hgnc_symbol_ids) for r in rows] == [("KEGG", "path:hsa00010", "G1,G2"), ("Other", "x", "G3")]


def test_result_and_annotator_writers(spark, tmp_path):
    results = spark.createDataFrame([("rs1", "a", 1.0), ("rs2", "b", 2.0), ("rs3", "a", 3.0)], "RSID string, phenotype string, t_stat double")
    sinks.write_results(results, str(tmp_path / "one"))
    sinks.write_results(results, str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 6
    sinks.write_results(results, str(tmp_path / "split"), split_phenotype=True)
    assert spark.read.parquet(str(tmp_path / "split" / "phenotype=a")).count() == 2
    sinks.write_annovar_input(results, str(tmp_path / "a"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "a")).collect())[0] == "rs1\ta\t1.0"


def test_topology_reader_needs_two_layers(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",chr,layer0_node,layer0_name,layer1_node,layer1_name\n0,1,5,s5 ,1,G1\n1,1,2,s2,0,G0 \n")
    rows = tables.read_topology(spark, str(tmp_path / "t.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, 2, "s2", 0, "G0"), (1, 5, "s5", 1, "G1")]
    (tmp_path / "u.csv").write_text("layer0_node,layer0_name\n1,a\n")
    with pytest.raises(ValueError):
        tables.read_topology(spark, str(tmp_path / "u.csv"))
