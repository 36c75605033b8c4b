"""Operators against brute force in numpy and plain Python."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.functions.tails import normal_p, student_p
from locusframe.functions.text import clean_gene
from locusframe.operators import association as a
from locusframe.operators import least_squares as ls
from locusframe.operators import cohort, genotype, harmonise, interpret, metrics, network, ordering, topology


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


# ---------------------------------------------------------------- ordering


def test_number_rows_matches_sorting(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "x": rng.integers(0, 40, 500), "id": np.arange(500)})
    # Two thirds of the rows share one key.
    pdf.loc[:330, "k"] = 1
    df = frame(spark, pdf).repartition(7)
    found = ordering.number_rows(df, [F.desc("x"), F.asc("id")], "n").toPandas().set_index("id")["n"]
    expected = pdf.sort_values(["x", "id"], ascending=[False, True]).reset_index(drop=True)
    assert all(found[i] == n for n, i in enumerate(expected["id"]))
    by = ordering.number_rows(df, ["x", "id"], "n", by=["k"], start=1).toPandas().set_index("id")["n"]
    ranked = pdf.sort_values(["x", "id"]).groupby("k").cumcount() + 1
    assert all(by[i] == n for i, n in zip(ranked.index, ranked))


def test_number_rows_of_nothing(spark):
    df = spark.createDataFrame([], "k string, x int")
    assert ordering.number_rows(df, ["x"], "n").count() == 0
    assert ordering.number_rows(df, ["x"], "n", by=["k"]).count() == 0


def test_number_rows_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, x int")
    rows = ordering.number_rows(df, ["x"], "n", by=["k"]).collect()
    assert {r.x: r.n for r in rows} == {1: 0, 2: 1, 3: 0}


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 300), "x": rng.permutation(300), "v": rng.integers(0, 9, 300)})
    df = frame(spark, pdf).repartition(5)
    found = ordering.running_totals(df, ["x"], {"s": F.col("v")}, by=["g"]).toPandas().set_index("x")["s"]
    expected = pdf.sort_values("x").assign(s=lambda d: d.groupby("g")["v"].cumsum())
    assert all(found[x] == s for x, s in zip(expected["x"], expected["s"]))


# ---------------------------------------------------------------- genotypes


def test_all_missing_variant_stays_null(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (1, 2, 2), (2, 2, None)], "subject_id long, variant_id long, dosage int")
    rows = {(r.subject_id, r.variant_id): r.dosage for r in genotype.impute_mean(df).collect()}
    assert rows == {(1, 1): None, (2, 1): None, (1, 2): 2, (2, 2): 2}


def test_impute_rounds_half_to_even(spark):
    cells = [(1, 1, 0), (2, 1, 1), (3, 1, None), (1, 2, 1), (2, 2, 2), (3, 2, None)]
    df = spark.createDataFrame(cells, "subject_id long, variant_id long, dosage int")
    rows = {(r.subject_id, r.variant_id): r.dosage for r in genotype.impute_mean(df).collect()}
    assert rows[3, 1] == 0 and rows[3, 2] == 2


def test_selection_vector_length_is_checked(spark):
    df = spark.createDataFrame([(1, 1, 0)], "subject_id long, variant_id long, dosage int")
    flags = spark.createDataFrame([(1, True), (2, False)], "variant_id long, keep boolean")
    with pytest.raises(ValueError):
        genotype.select_variants(df, flags, n_variants=1)


def test_tiles_collapse_copies_and_bound_rows(spark):
    cells = [(1, v, v % 3) for v in range(50)] * 3
    df = spark.createDataFrame(cells, "subject_id long, variant_id long, dosage int")
    tiles = genotype.to_subject_major(df, tile=16).collect()
    assert sorted((r.tile, len(r.dosages)) for r in tiles) == [(0, 16), (1, 16), (2, 16), (3, 2)]


# ---------------------------------------------------------------- association


def simulated(spark, n=60, variants=12, traits=2, covs=2, missing=0.0, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (variants, n)).astype(float)
    g[rng.random(g.shape) < missing] = np.nan
    c = rng.normal(5, 2, (n, covs))
    y = rng.normal(100, 3, (n, traits)) + c[:, :1]
    cells = pd.DataFrame([(s, v, g[v, s]) for v in range(variants) for s in range(n)], columns=["subject_id", "variant_id", "dosage"])
    geno = frame(spark, cells).withColumn("dosage", F.when(~F.isnan("dosage"), F.col("dosage").cast("int")))
    design = pd.DataFrame({"subject_id": np.arange(n)})
    for i in range(covs):
        design[f"c{i}"] = c[:, i]
    for i in range(traits):
        design[f"y{i}"] = y[:, i]
    return g, c, y, geno, frame(spark, design)


def least_squares(g, c, y):
    """beta, se, t of the last column by the textbook formula."""
    g = np.where(np.isnan(g), np.nanmean(g), g)
    x = np.column_stack([np.ones(len(g)), c, g])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    rss = ((y - x @ beta) ** 2).sum()
    se = math.sqrt(rss / (len(y) - x.shape[1]) * inverse[-1, -1])
    return beta[-1], se, beta[-1] / se


@pytest.mark.parametrize("covs", [0, 1, 4])
@pytest.mark.parametrize("missing", [0.0, 0.1])
def test_gwas_equals_least_squares(spark, covs, missing):
    g, c, y, geno, design = simulated(spark, covs=max(covs, 1), missing=missing)
    c = c[:, :covs]
    names = [f"c{i}" for i in range(covs)]
    rows = a.gwas(geno, design, names, ["y0", "y1"]).collect()
    assert len(rows) == 24
    for r in rows:
        expected = least_squares(g[r.variant_id], c, y[:, int(r.trait[1])])
        assert (r.beta, r.se, r.t_stat) == pytest.approx(expected, rel=1e-8)
        assert r.df == 60 - covs - 2


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("width", [16, 64])
@pytest.mark.parametrize("missing", [0.0, 0.1])
def test_tiles_equal_long_path(spark, monkeypatch, limit, width, missing):
    """Both ways of bringing tiles and design together, with subjects on one side only."""
    monkeypatch.setattr(a, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(a, "ROWS_PER_PRODUCT", 3)
    _, _, _, geno, design = simulated(spark, missing=missing)
    design = design.filter("subject_id <> 7")
    others = design.limit(3).withColumn("subject_id", F.col("subject_id") + 60)
    tiles = genotype.to_variant_major(geno, tile=width)
    subjects = geno.select("subject_id").distinct()
    left = a.gwas(geno, design, ["c0", "c1"], ["y0", "y1"]).toPandas().sort_values(["variant_id", "trait"])
    right = a.gwas_tiles(
        tiles, design.unionByName(others), ["c0", "c1"], ["y0", "y1"], tile=width, variants_per_group=5, traits_per_pass=1,
        subjects=subjects,
    ).toPandas()
    right = right.sort_values(["variant_id", "trait"])
    assert np.allclose(left[["af", "beta", "se", "t_stat"]], right[["af", "beta", "se", "t_stat"]])


def test_singular_variant_has_no_statistic(spark):
    _, _, _, geno, design = simulated(spark)
    constant = geno.withColumn("dosage", F.when(F.col("variant_id") == 0, 1).otherwise(F.col("dosage")))
    results = a.gwas(constant, design, ["c0"], ["y0"])
    row = results.filter("variant_id = 0").first()
    assert row.beta is None and row.se is None and row.t_stat is None
    assert a.significant(results).filter("variant_id = 0").count() == 0


def test_interaction_factor_may_be_a_covariate(spark):
    g, c, y, geno, design = simulated(spark, covs=1)
    for r in a.gwas(geno, design, ["c0"], ["y0"], factor="c0").collect():
        expected = least_squares(g[r.variant_id] * c[:, 0], c, y[:, 0])
        assert (r.beta, r.se, r.t_stat) == pytest.approx(expected, rel=1e-7)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_meta_equals_joint_regression_for_any_split(spark, seed):
    _, _, _, geno, design = simulated(spark, seed=seed)
    design = design.withColumn("study", (F.col("subject_id") * (seed + 3) % 7 % 3).cast("int"))
    cohort_part, variants = a.partial_derivatives(geno, design, ["c0"], ["y0"])
    meta = a.meta_analyse(cohort_part, variants, ["c0"], ["y0"]).toPandas().sort_values("variant_id")
    joint = a.gwas(geno, design, ["c0"], ["y0"]).toPandas().sort_values("variant_id")
    assert np.abs(meta[["beta", "se"]].to_numpy() - joint[["beta", "se"]].to_numpy()).max() < 1e-6


def test_meta_keeps_only_common_variants(spark):
    _, _, _, geno, design = simulated(spark)
    design = design.withColumn("study", F.col("subject_id") % 2)
    geno = geno.join(design.select("subject_id", "study"), "subject_id").filter("study = 0 OR variant_id > 3").drop("study")
    cohort_part, variants = a.partial_derivatives(geno, design, ["c0"], ["y0"])
    found = a.meta_analyse(cohort_part, variants, ["c0"], ["y0"])
    assert sorted(r.variant_id for r in found.collect()) == list(range(4, 12))


def test_masking_hides_and_keeps_products(spark):
    _, _, _, geno, design = simulated(spark, n=300)
    traits = design.unpivot(["subject_id"], ["y0", "y1"], "trait", "value")
    cells, values = a.encode_pair(geno, traits, design, seed=5)
    masked = {(r.variant_id, r.trait): r.v for r in a.masked_cross(cells, values, ["y0", "y1"]).collect()}
    plain = {(r.variant_id, r.trait): r.v for r in a.cross_gen(geno, design, ["y0", "y1"]).collect()}
    assert masked.keys() == plain.keys()
    assert all(masked[k] == pytest.approx(plain[k], rel=1e-7) for k in plain)
    assert cells.filter("dosage <= 2").count() < cells.count() / 10


def test_student_tail_known_quantiles():
    # Two-sided 5 % and 1 % points of the t distribution.
    for df, t, p in [(1, 12.706204736, 0.05), (2, 4.302652730, 0.05), (5, 2.570581836, 0.05), (10, 2.228138852, 0.05),
                     (30, 2.042272456, 0.05), (100, 1.983971519, 0.05), (10, 3.169272673, 0.01), (1000, 2.580754698, 0.01)]:
        assert student_p(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=1e-7)
    assert student_p(np.array([0.0]), np.array([7]))[0] == 1.0
    # One degree of freedom has the Cauchy tail, two a closed form; both far out.
    for t in (1e-6, 0.3, 3.0, 50.0, 1e4):
        assert student_p(np.array([t]), np.array([1]))[0] == pytest.approx(2 / math.pi * math.atan2(1, t), rel=1e-9)
        assert student_p(np.array([t]), np.array([2]))[0] == pytest.approx(
            2 / ((t * t + 2) * (1 + t / math.sqrt(t * t + 2))), rel=1e-8)
    assert student_p(np.array([2.0]), np.array([1e7]))[0] == pytest.approx(normal_p(np.array([2.0]))[0], rel=1e-5)


def test_p_values_in_summary(spark):
    _, _, _, geno, design = simulated(spark)
    for r in a.summarise(a.gwas(geno, design, ["c0"], ["y0"])).collect():
        assert r.p_value == pytest.approx(student_p(np.array([r.t_stat]), np.array([57]))[0])
        assert r.BETA == pytest.approx(r.t_stat * r.SE)
    for r in a.summarise(a.gwas(geno, design, ["c0"], ["y0"]), normal=True).collect():
        assert r.p_value == pytest.approx(math.erfc(abs(r.t_stat) / math.sqrt(2)))


# ---------------------------------------------------------------- harmonisation


def test_straight_match_wins_over_swapped(spark):
    columns = "variant_id string, chr int, bp long, allele1 string, allele2 string"
    study = spark.createDataFrame([("a", 1, 10, "C", "A"), ("b", 1, 10, "A", "C"), ("c", 1, 20, "T", "G"), ("d", 1, 30, "A", "G")], columns)
    ref = spark.createDataFrame([("r1", 1, 10, "A", "C"), ("r2", 1, 20, "G", "T"), ("r3", 1, 30, "A", "T")], columns)
    found = {r.reference_id: (r.variant_id, r.flip) for r in harmonise.harmonise(study, ref).collect()}
    assert found == {"r1": ("b", 1), "r2": ("c", -1)}
    copies = harmonise.harmonise(study.unionByName(study), ref.unionByName(ref))
    assert copies.count() == 4 and copies.distinct().count() == 2
    assert sorted(r.variant_id for r in harmonise.mismatches(study, ref).collect()) == ["a", "d"]


# ---------------------------------------------------------------- topology


def test_gene_names(spark):
    names = ["RBFOX1(dist=346)", "A,B", "NONE(dist=NONE),C(dist=4)", "D;E", "F(x;y)", "G"]
    df = spark.createDataFrame([(n,) for n in names], "gene string")
    assert [r[0] for r in df.select(clean_gene(F.col("gene"))).collect()] == ["RBFOX1", "A", "NONE", "D", "F", "G"]


def test_genes_are_numbered_by_first_listed_variant(spark):
    rows = [("G2", 1, 50, 0), ("G1(dist=3)", 1, 40, 1), ("G2", 1, 10, 2), ("NONE", 1, 5, 3), ("G3", 1, 45, 4), (None, 2, 1, 5)]
    annotation = spark.createDataFrame(rows, "gene string, chr int, bps long, index_col int")
    assert {r.gene: r.gene_id for r in topology.number_genes(annotation).collect()} == {"G1": 0, "G3": 1, "G2": 2}
    paths = {r.layer0_node: (r.layer0_name, r.layer1_node) for r in topology.gene_topology(annotation).collect()}
    assert paths == {0: ("chr1:50", 2), 1: ("chr1:40", 0), 2: ("chr1:10", 2), 4: ("chr1:45", 1)}


def test_order_layers_reports_a_misfit(spark):
    edges = spark.createDataFrame([(0, 5, 2), (1, 2, 1), (2, 3, 0)], "layer int, src long, dst long")
    rows = {r.layer: (r.place, r.fits) for r in topology.order_layers(edges).collect()}
    assert rows == {0: (0, True), 2: (1, False), 1: (2, False)}


# ---------------------------------------------------------------- cohort and metrics


def test_epochs_walk_one_permutation_then_reshuffle(spark):
    df = spark.range(100).withColumnRenamed("id", "subject_id")

    def epoch(e):
        rows = cohort.assign_batches(df, 10, epoch_size=30, epoch=e, seed=1).collect()
        assert {r.batch for r in rows} == {0, 1, 2}
        return {r.subject_id for r in rows}

    first, second, third, fourth = (epoch(e) for e in range(4))
    assert not first & second and not second & third and not first & third
    assert fourth != first


def auc_brute(y, p):
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, b in itertools.product(p[y == 1], p[y == 0])]
    return sum(pairs) / len(pairs)


def test_auc_with_ties_per_group(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"run": rng.integers(0, 3, 300), "y": rng.integers(0, 2, 300), "p": np.round(rng.random(300), 1)})
    rows = {r.run: r.auc for r in metrics.auc(frame(spark, pdf), by=["run"]).collect()}
    for run, part in pdf.groupby("run"):
        assert rows[run] == pytest.approx(auc_brute(part["y"].to_numpy(), part["p"].to_numpy()))
    assert metrics.auc(frame(spark, pdf.assign(y=1))).first().auc is None


@pytest.mark.parametrize("by", [[], ["run"]])
def test_auc_of_more_pairs_than_an_int_holds(spark, by):
    """Positives score 1, 3, .. 9, negatives 0, 2, .. 8, 50 000 of each."""
    rows = spark.range(100_000).selectExpr("1 AS run", "int(id % 2) AS y", "double(id % 10) AS p")
    assert metrics.auc(rows, by=by).first().auc == pytest.approx(0.6)


def test_auc_of_more_pairs_than_a_long_holds(spark, monkeypatch):
    schema = "p double, pos long, neg long, tp long, fp long, n_pos long, n_neg long"
    n = 4_000_000_000
    counts = spark.createDataFrame([(1.0, n, 0, n, 0, n, n), (0.0, 0, n, n, n, n, n)], schema)
    monkeypatch.setattr(metrics, "score_counts", lambda df, by: counts)
    assert metrics.auc(None).first().auc == pytest.approx(1.0)


# ---------------------------------------------------------------- networks


def dense_network(spark, kinds=("tanh", "tanh", "sigmoid"), seed=0):
    """6 inputs, 3 genes, 2 pathways, one score; some genes feed both pathways."""
    rng = np.random.default_rng(seed)
    edges = [(0, s, s % 3) for s in range(6)] + [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 2, 1)] + [(2, 0, 0), (2, 1, 0)]
    w = rng.normal(0, 0.7, len(edges))
    bias = [(0, k) for k in range(3)] + [(1, k) for k in range(2)] + [(2, 0)]
    b = rng.normal(0, 0.3, len(bias))
    net = network.Network(
        spark.createDataFrame([(*e, float(x)) for e, x in zip(edges, w)], "layer int, src long, dst long, w double"),
        spark.createDataFrame([(*k, float(x)) for k, x in zip(bias, b)], "layer int, node long, b double"),
        list(kinds),
    )
    shapes = [(6, 3), (3, 2), (2, 1)]
    matrices = [np.zeros(s) for s in shapes]
    for (layer, s, d), x in zip(edges, w):
        matrices[layer][s, d] = x
    offsets = [np.zeros(s[1]) for s in shapes]
    for (layer, d), x in zip(bias, b):
        offsets[layer][d] = x
    return net, matrices, offsets


def forward(x, matrices, offsets, kinds=("tanh", "tanh", "sigmoid")):
    act = {"tanh": np.tanh, "relu": lambda z: np.maximum(z, 0), "linear": lambda z: z, "sigmoid": lambda z: 1 / (1 + np.exp(-z))}
    for m, o, k in zip(matrices, offsets, kinds):
        x = act[k](x @ m + o)
    return x[:, 0]


def cells_of(spark, x):
    rows = [(s, v, int(x[s, v])) for s in range(x.shape[0]) for v in range(x.shape[1])]
    return spark.createDataFrame(rows, "subject_id long, variant_id long, dosage int")


def test_predict_equals_matrix_product(spark):
    net, matrices, offsets = dense_network(spark)
    x = np.random.default_rng(2).integers(0, 3, (20, 6))
    rows = {r.subject_id: r.p for r in network.predict(net, network.as_nodes(cells_of(spark, x))).collect()}
    assert [rows[s] for s in range(20)] == pytest.approx(list(forward(x, matrices, offsets)))


def test_predict_gives_unlisted_cells_their_zeros(spark):
    """Also subjects, nodes and whole branches without a listed cell, with normalised layers."""
    net, matrices, offsets = dense_network(spark)
    x = np.random.default_rng(2).integers(0, 3, (20, 6)) * (np.random.default_rng(3).random((20, 6)) < 0.3)
    x[4] = x[5] = 0
    listed, everyone = cells_of(spark, x).where("dosage <> 0"), spark.range(20).toDF("subject_id")
    rows = {r.subject_id: r.p for r in network.predict(net, network.as_nodes(listed), everyone).collect()}
    assert [rows[s] for s in range(20)] == pytest.approx(list(forward(x, matrices, offsets)))
    net.moments = net.edges.where("layer < 2").selectExpr("layer", "dst AS node", "0.1 * (dst + 1) AS mean", "0.5 + 0.25 * dst AS variance").distinct()
    dense = {r.subject_id: r.p for r in network.predict(net, network.as_nodes(cells_of(spark, x))).collect()}
    assert {r.subject_id: r.p for r in network.predict(net, network.as_nodes(listed), everyone).collect()} == pytest.approx(dense)


# ---------------------------------------------------------------- interpretation


def test_top_interactions_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"src": np.arange(60), "dst": rng.integers(0, 4, 60)})
    # Small integers make many equal strengths; one gene holds half of the inputs.
    pdf.loc[:30, "dst"] = 0
    pdf["w"] = rng.integers(-4, 5, 60).astype(float)
    down = pd.DataFrame({"node": [0, 1, 2, 3], "down": [1.0, 2.0, 1.0, 0.0]})
    pairs = []
    for gene, part in pdf.groupby("dst"):
        part = part.assign(size=part["w"].abs()).sort_values(["size", "src"], ascending=[False, True]).reset_index(drop=True)
        for i, j in itertools.combinations(range(len(part)), 2):
            pairs.append((part["size"][j] * down["down"][gene], gene, j, i, part["src"][i], part["src"][j]))
    pairs.sort(key=lambda p: (-p[0], *p[1:4]))
    weights, downs = frame(spark, pdf), frame(spark, down)
    for k in (1, 7, 40, 300):
        found = interpret.top_interactions(weights, downs, k).collect()
        assert sorted((r.gene, r.src_a, r.src_b, r.strength) for r in found) == sorted((p[1], p[4], p[5], p[0]) for p in pairs[:k])
    profile = interpret.interaction_profile(weights, downs)
    assert profile.agg(F.sum("partners")).first()[0] == len(pairs)
    assert profile.agg(F.sum(F.col("partners") * F.col("strength"))).first()[0] == pytest.approx(sum(p[0] for p in pairs))


@pytest.mark.parametrize("widest", [4096, 20])
def test_joint_fit_equals_least_squares(spark, monkeypatch, widest):
    """Copies, sums, constants at 0 and linked columns cost no degree of freedom; 60 columns meet 40 rows."""
    monkeypatch.setattr(ls, "WIDEST", widest)
    monkeypatch.setattr(ls, "BLOCK", 3)  # several blocks, and a tree of several levels
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(40, 80)), rng.normal(size=40)
    x[:, 6], x[:, 7], x[:, 8], x[:, 9] = x[:, 5], 0, x[:, 0] + x[:, 1], 3
    x[:, 60:] = x[:, 10:13] @ rng.normal(size=(3, 20))
    parents = [[0, 1, 2], [3], [2, 4], [5, 6], [0, 1, 5, 6, 7, 8, 9], [7], list(range(60)), list(range(60, 80)), list(range(10, 13)) + list(range(60, 77))]
    edges = [(s, d) for d, held in enumerate(parents) for s in held]
    acts = spark.createDataFrame([(s, v, float(x[s, v])) for s in range(40) for v in range(80) if x[s, v]], "subject_id long, node long, value double")
    labels = spark.createDataFrame([(s, float(y[s])) for s in range(40)] + [(99, 5.0)], "subject_id long, y double")
    found = interpret.joint_fit(acts, labels, spark.createDataFrame(edges + edges[:3], "src long, dst long"))
    rows = {r.dst: (r.children, r.rank, r.r2) for r in found.collect()}
    for dst, held in enumerate(parents):
        part = x[:, [s for s in held if x[:, s].any()]]
        if not part.shape[1]:
            assert dst not in rows
            continue
        k = np.linalg.matrix_rank(part)
        rss = ((y - part @ np.linalg.lstsq(part, y, rcond=None)[0]) ** 2).sum()
        adjusted = pytest.approx(1 - 40 / (40 - k) * rss / (y @ y), rel=1e-6) if k < 40 else None
        assert rows[dst] == ((part.shape[1], k, adjusted) if part.shape[1] <= widest or widest > 40 else (part.shape[1], None, None)), dst


def test_univariate_logit_finds_the_maximum(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, 200).astype(float) - 1
    y = (rng.random(200) < 1 / (1 + np.exp(-0.8 * x))).astype(float)
    acts = spark.createDataFrame([(s, 0, float(x[s])) for s in range(200)], "subject_id long, node long, value double")
    labels = spark.createDataFrame([(s, float(y[s])) for s in range(200)], "subject_id long, y double")
    row = interpret.univariate_logit(acts, labels).first()

    def ll(b):
        p = 1 / (1 + np.exp(-b * x))
        return (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    grid = np.linspace(-3, 3, 6001)
    best = max(grid, key=ll)
    assert row.beta == pytest.approx(best, abs=2e-3)
    null = y.sum() * np.log(y.mean()) + (200 - y.sum()) * np.log(1 - y.mean())
    assert row.pseudo_r2 == pytest.approx(1 - ll(row.beta) / null)


def brute_attributions(x, base, matrices, offsets):
    """Midpoint path integral with central differences."""
    out = np.zeros(x.shape)
    for step in range(interpret.PATH_STEPS):
        alpha = (step + 0.5) / interpret.PATH_STEPS
        point = base + alpha * (x - base)
        for j in range(x.shape[1]):
            h = np.zeros(x.shape[1])
            h[j] = 1e-5
            out[:, j] += (forward(point + h, matrices, offsets) - forward(point - h, matrices, offsets)) / 2e-5
    return (x - base) * out / interpret.PATH_STEPS


def attribution_case(spark):
    net, matrices, offsets = dense_network(spark)
    x = np.random.default_rng(8).integers(0, 3, (12, 6))
    ids = spark.range(12).withColumnRenamed("id", "subject_id")
    return net, matrices, offsets, x, cells_of(spark, x), ids.filter("subject_id < 7"), ids.filter("subject_id >= 7")


def test_attributions_equal_path_integral(spark):
    net, matrices, offsets, x, geno, cases, background = attribution_case(spark)
    base = x[7:].mean(axis=0)
    expected = np.abs(brute_attributions(x[:7].astype(float), base, matrices, offsets)).max(axis=0)
    found = {r.variant_id: r.attribution for r in interpret.attributions(net, geno, cases, background).collect()}
    assert [found[v] for v in range(6)] == pytest.approx(list(expected), rel=1e-4)


def test_perturbation_effects_equal_brute_force(spark):
    net, matrices, offsets, x, geno, cases, background = attribution_case(spark)
    base = x[7:].mean(axis=0)
    targets = spark.createDataFrame([(1,), (4,)], "variant_id long")
    found = {r.target: r for r in interpret.dfim(net, geno, cases, background, targets).collect()}
    for target in (1, 4):
        attributions = []
        for setting in (0, 1, 2):
            moved = x[:7].astype(float)
            moved[:, target] = setting
            attributions.append(brute_attributions(moved, base, matrices, offsets))
        change = np.max([np.abs(attributions[i] - attributions[j]).mean(axis=0) for i, j in ((0, 1), (0, 2), (1, 2))], axis=0)
        assert found[target].own == pytest.approx(change[target], rel=1e-4)
        change[target] = 0
        assert found[target].other == pytest.approx(change.max(), rel=1e-3)
        assert found[target].other_variant == int(change.argmax())


def test_path_interactions_cover_the_ranked_slice(spark):
    net, matrices, offsets, x, geno, cases, background = attribution_case(spark)
    rows = interpret.path_interactions(net, geno, cases, background, 1, 3).collect()
    ranked = [r.variant_id for r in interpret.attributions(net, geno, cases, background).orderBy(F.desc("attribution")).collect()]
    assert {r.target for r in rows} == set(ranked[1:3])
    base = x[7:].mean(axis=0)
    for target in ranked[1:3]:
        both = []
        for setting in (0, 2):
            moved = x[:7].astype(float)
            moved[:, target] = setting
            both.append(brute_attributions(moved, base, matrices, offsets))
        expected = np.abs((both[1] - both[0]) / 2).max(axis=0)
        found = {r.variant_id: r.interaction for r in rows if r.target == target}
        assert [found[v] for v in range(6)] == pytest.approx(list(expected), rel=1e-3, abs=1e-9)
