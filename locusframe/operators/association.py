"""High-dimensional association and meta-analysis from additive sufficient statistics.

`design` holds one row per subject: subject_id, covariate columns, trait columns.
For covariates C (intercept first), genotype g and trait y all tests need only

    C'C, C'y, y'y           once per cohort            (`cohort_stats`)
    C'g, g'g, g'y           once per variant           (`variant_stats`)

which add up over studies. The tested coefficient is the last one of the bordered
normal matrix; with H = (C'C)^-1 its Schur complement gives

    s = g'g - g'C H C'g      beta = (g'y - g'C H C'y) / s
    RSS = y'y - y'C H C'y - beta^2 s      SE = sqrt(RSS / (DF s))

so after one grouped sum per variant everything is a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.arrays import combined, flat_lists, pieces, to_lists
from locusframe.functions.tails import p_value
from locusframe.operators.genotype import frequency_kept, impute_mean
from locusframe.operators.ordering import number_rows, seeded_order
from locusframe.session import materialise

ONE = "intercept"
# A genotype that the covariates explain up to this share has no unique coefficient.
SINGULAR = 1e-10


# ---------------------------------------------------------------- cohort side


def align_subjects(geno: DataFrame, design: DataFrame) -> DataFrame:
    """Design rows of the subjects that have genotypes."""
    return design.join(geno.select("subject_id").distinct(), "subject_id", "left_semi")


def _long(df: DataFrame, keys: Sequence[str], columns: dict[tuple, str]) -> DataFrame:
    """One row (kind, i, j, v) per summed column of `df`; `columns` is bounded by the model."""
    cells = [
        F.struct(
            F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).cast("double").alias("v")
        )
        for (kind, i, j), c in columns.items()
    ]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def _x(name: str) -> Column:
    return F.lit(1.0) if name == ONE else F.col(name).cast("double")


def cohort_stats(
    design: DataFrame, covs: Sequence[str], traits: Sequence[str], by: Sequence[str] = (), intercept: bool = True
) -> DataFrame:
    """Rows (…by, kind, i, j, v): 'acov' C'C, 'bcov' C'Y, 'c' y'y.

    One scan of the design with map-side sums; the result has (k+1)k + kP + P rows
    per study whatever the number of subjects.
    """
    names = [ONE, *covs] if intercept else list(covs)
    products = {("acov", a, b): _x(a) * _x(b) for a in names for b in names}
    products |= {("bcov", a, t): _x(a) * _x(t) for a in names for t in traits}
    products |= {("c", t, t): _x(t) * _x(t) for t in traits}
    columns = {key: f"s{n}" for n, key in enumerate(products)}
    sums = [F.sum(products[key]).alias(c) for key, c in columns.items()]
    grouped = design.groupBy(*by).agg(*sums) if by else design.agg(*sums)
    return _long(grouped, by, columns)


def gram_cov(design: DataFrame, covs: Sequence[str], intercept: bool = True) -> DataFrame:
    """C'C as rows (i, j, v)."""
    return cohort_stats(design, covs, [], intercept=intercept).filter("kind = 'acov'").select("i", "j", "v")


def cross_cov(design: DataFrame, covs: Sequence[str], traits: Sequence[str], intercept: bool = True) -> DataFrame:
    """C'Y as rows (i, trait, v)."""
    rows = cohort_stats(design, covs, traits, intercept=intercept).filter("kind = 'bcov'")
    return rows.select("i", F.col("j").alias("trait"), "v")


def trait_ss(design: DataFrame, traits: Sequence[str]) -> DataFrame:
    """y'y per trait."""
    rows = cohort_stats(design, [], traits).filter("kind = 'c'")
    return rows.select(F.col("i").alias("trait"), "v")


# ---------------------------------------------------------------- variant side


def variant_stats(
    geno: DataFrame,
    design: DataFrame,
    covs: Sequence[str],
    traits: Sequence[str],
    by: Sequence[str] = (),
    sparse: bool = False,
) -> DataFrame:
    """Per variant (and study): n, g, gg, gx_<cov>, gy_<trait> with missing calls mean-imputed.

    The genotype cells are joined to the design once and summed with map-side
    combining, so only one row per variant and task is exchanged afterwards, and a
    variant or subject holding many cells is no single task's work. Imputation is
    algebraic: filling m cells with the mean adds mean * (sum of x over those cells).

    With `sparse`, cells that are not listed are dosage 0 rather than missing.
    """
    cells = _cell_sums(geno, design, [*covs, *traits], by, sparse)
    return _impute_sums(cells, design, covs, traits, by, sparse)


def _cell_sums(geno: DataFrame, design: DataFrame, others: Sequence[str], by: Sequence[str], sparse: bool) -> DataFrame:
    """Sums over the listed cells: _called, _cells, _g, _gg and per column x _g_x, _m_x."""
    g = F.col("dosage").cast("double")
    called = F.col("dosage").isNotNull()
    sums = [
        F.count("dosage").alias("_called"),
        F.count(F.lit(1)).alias("_cells"),
        F.sum(g).alias("_g"),
        F.sum(g * g).alias("_gg"),
    ]
    for x in others:
        sums.append(F.sum(g * _x(x)).alias(f"_g_{x}"))
        # Sum of x over the called cells (sparse: over the explicitly missing ones).
        sums.append(F.sum(F.when(~called if sparse else called, _x(x))).alias(f"_m_{x}"))
    return geno.join(design, "subject_id").groupBy(*by, "variant_id").agg(*sums)


def _impute_sums(
    cells: DataFrame, design: DataFrame, covs: Sequence[str], traits: Sequence[str], by: Sequence[str], sparse: bool
) -> DataFrame:
    """Sums after mean imputation, from the sums over the listed cells."""
    totals = design.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(_x(x)).alias(f"_t_{x}") for x in [*covs, *traits]]
    )
    # One row per study.
    joined = cells.join(totals, list(by)) if by else _with_row(cells, totals)
    n = F.col("n")
    missing = (F.col("_cells") - F.col("_called")) if sparse else (n - F.col("_called"))
    mean = F.try_divide(F.coalesce("_g", F.lit(0.0)), n - missing)

    def filled(x: str) -> Column:
        seen = F.coalesce(f"_m_{x}", F.lit(0.0))
        return F.coalesce(f"_g_{x}", F.lit(0.0)) + mean * (seen if sparse else F.col(f"_t_{x}") - seen)

    return joined.select(
        *by,
        "variant_id",
        "n",
        (mean * n).alias("g"),
        (F.coalesce("_gg", F.lit(0.0)) + missing * mean * mean).alias("gg"),
        *[filled(c).alias(f"gx_{c}") for c in covs],
        *[filled(t).alias(f"gy_{t}") for t in traits],
    )


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate as constants."""
    values = one_row.first().asDict()
    return df.select("*", *[F.lit(v).alias(k) for k, v in values.items()])


def gram_test(geno: DataFrame, design: DataFrame, covs: Sequence[str], sparse: bool = False) -> DataFrame:
    """Per variant [sum g, g'C, sum g^2] as columns g, gx_<cov>, gg."""
    return variant_stats(geno, design, covs, [], sparse=sparse)


def cross_gen(geno: DataFrame, design: DataFrame, traits: Sequence[str], sparse: bool = False) -> DataFrame:
    """g'y as rows (variant_id, trait, v)."""
    wide = variant_stats(geno, design, [], traits, sparse=sparse)
    cells = [F.struct(F.lit(t).alias("trait"), F.col(f"gy_{t}").alias("v")) for t in traits]
    return wide.select("variant_id", F.explode(F.array(*cells)).alias("c")).select("variant_id", "c.*")


# ---------------------------------------------------------------- solving


@dataclass
class Model:
    """The cohort side of a solved model: a few numbers per covariate and trait."""

    n: int
    covs: list[str]
    traits: list[str]
    inverse: np.ndarray
    cross: dict[str, np.ndarray]
    residual_ss: dict[str, float]

    @property
    def df(self) -> int:
        return self.n - len(self.covs) - 1


def read_model(stats: DataFrame, covs: Sequence[str], traits: Sequence[str], n: int | None = None) -> Model:
    """Bring the cohort statistics, at most (k+1)k + kP + P numbers, to the driver and invert C'C."""
    rows = {(r.kind, r.i, r.j): r.v for r in stats.collect()}
    names = [ONE, *covs] if ("acov", ONE, ONE) in rows else list(covs)
    inverse = np.linalg.inv(np.array([[rows["acov", a, b] for b in names] for a in names]))
    cross = {t: np.array([rows["bcov", a, t] for a in names]) for t in traits}
    rest = {t: rows["c", t, t] - float(cross[t] @ inverse @ cross[t]) for t in traits}
    count = n if n is not None else int(round(rows["acov", ONE, ONE]))
    return Model(count, names, list(traits), inverse, cross, rest)


def _weighted(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)])


def _gx(model: Model) -> list[Column]:
    return [F.col("g") if c == ONE else F.col(f"gx_{c}") for c in model.covs]


def with_projection(variants: DataFrame, model: Model) -> DataFrame:
    """Add u = H C'g (u_0, u_1, …) and the Schur complement s, null where singular."""
    gx = _gx(model)
    us = [_weighted(gx, row).alias(f"u_{i}") for i, row in enumerate(model.inverse)]
    fit = reduce(lambda a, b: a + b, [F.col(f"u_{i}") * c for i, c in enumerate(gx)])
    s = F.col("gg") - fit
    return variants.select("*", *us).withColumn("s", F.when(s > F.col("gg") * SINGULAR, s))


def bordered_inverse(variants: DataFrame, model: Model) -> DataFrame:
    """Inverse of [[C'C, C'g], [g'C, g'g]] per variant as rows (variant_id, i, j, v); none if singular."""
    k = len(model.covs)
    cells = []
    for i in range(k + 1):
        for j in range(k + 1):
            if i < k and j < k:
                v = F.lit(float(model.inverse[i, j])) + F.col(f"u_{i}") * F.col(f"u_{j}") / F.col("s")
            elif i == k and j == k:
                v = 1 / F.col("s")
            else:
                v = -F.col(f"u_{min(i, j)}") / F.col("s")
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v")))
    return (
        with_projection(variants, model)
        .filter(F.col("s").isNotNull())
        .select("variant_id", F.explode(F.array(*cells)).alias("c"))
        .select("variant_id", "c.*")
    )


def assoc_from_stats(variants: DataFrame, model: Model) -> DataFrame:
    """One row per variant and trait: variant_id, trait, af, beta, se, t_stat, df."""
    spark = variants.sparkSession
    constants = spark.createDataFrame(
        [(i, t, model.cross[t].tolist(), model.residual_ss[t]) for i, t in enumerate(model.traits)],
        "pos int, trait string, cross array<double>, rest double",
    )
    k = len(model.covs)
    gys = F.array(*[F.col(f"gy_{t}") for t in model.traits])
    tests = (
        with_projection(variants, model)
        .select("variant_id", "n", "g", "s", *[f"u_{i}" for i in range(k)], F.posexplode(gys).alias("pos", "gy"))
        # One row per trait, just made from the model on the driver.
        .join(F.broadcast(constants), "pos")
    )
    s = F.col("s")
    explained = reduce(lambda a, b: a + b, [F.col(f"u_{i}") * F.col("cross")[i] for i in range(k)])
    beta = F.try_divide(F.col("gy") - explained, s)
    tests = tests.select("variant_id", "trait", F.try_divide("g", 2 * F.col("n")).alias("af"), beta.alias("beta"), "s", "rest")
    se = F.sqrt(F.abs(F.col("rest") - F.col("beta") * F.col("beta") * s) / (F.lit(model.df) * s))
    return tests.withColumn("se", se).select(
        "variant_id",
        "trait",
        "af",
        "beta",
        "se",
        F.try_divide("beta", "se").alias("t_stat"),
        F.lit(model.df).cast("long").alias("df"),
    )


def centred(design: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract cohort means; with an intercept in the model no test changes, but fewer digits cancel."""
    means = design.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return design.select(
        *[c for c in design.columns if c not in columns],
        *[(F.col(c).cast("double") - F.lit(means[c])).alias(c) for c in columns],
    )


def gwas(
    geno: DataFrame,
    design: DataFrame,
    covs: Sequence[str],
    traits: Sequence[str],
    maf: float = 0.0,
    threshold: float | None = None,
    factor: str | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Test every variant against every trait.

    Subjects are those in both tables. `factor` names a design column that multiplies
    the tested genotype. `threshold` keeps |t| above it.
    """
    columns = list(dict.fromkeys([*covs, *traits]))
    keep = ["subject_id", *columns, *([factor] if factor and factor not in columns else [])]
    aligned = design.select(*keep).dropna()
    if not sparse:
        aligned = align_subjects(geno, aligned)
    # Used by the means, the cohort sums and the cell join.
    aligned = materialise(aligned)
    cells = geno
    if factor:
        cells = geno.join(aligned.select("subject_id", F.col(factor).alias("_factor")), "subject_id").select(
            "subject_id", "variant_id", (F.col("dosage") * F.col("_factor")).alias("dosage")
        )
    aligned = centred(aligned, columns)
    model = read_model(cohort_stats(aligned, covs, traits), covs, traits)
    variants = variant_stats(cells, aligned.select("subject_id", *columns), covs, traits, sparse=sparse)
    if maf:
        variants = variants.filter(frequency_kept(F.col("g") / (2 * F.col("n")), maf))
    results = assoc_from_stats(variants, model)
    return results if threshold is None else significant(results, threshold)


def significant(results: DataFrame, threshold: float = 0.0) -> DataFrame:
    """|t| above the threshold; drops tests without a statistic."""
    return results.filter(F.abs("t_stat") > threshold)


def summarise(results: DataFrame, normal: bool = False) -> DataFrame:
    """Result table: RSID, p_value, t_stat, phenotype, SE, MAF, BETA = t * SE."""
    p = p_value(F.col("t_stat"), None if normal else F.col("df"))
    return results.select(
        F.col("variant_id").alias("RSID"),
        p.alias("p_value"),
        "t_stat",
        F.col("trait").alias("phenotype"),
        F.col("se").alias("SE"),
        F.col("af").alias("MAF"),
        (F.col("t_stat") * F.col("se")).alias("BETA"),
    )


def permute_traits(design: DataFrame, traits: Sequence[str], seed: int) -> DataFrame:
    """Give the trait values of a seeded shuffle to the subjects in id order."""
    fixed = [c for c in design.columns if c not in traits]
    target = number_rows(design.select(*fixed), ["subject_id"], "_rank")
    source = number_rows(
        design.select("subject_id", *traits).withColumn("_key", seeded_order("subject_id", seed)),
        ["_key", "subject_id"],
        "_rank",
    ).select("_rank", *traits)
    return target.join(source, "_rank").select(*design.columns)


# ---------------------------------------------------------------- meta-analysis


def with_study_intercepts(design: DataFrame, studies: Sequence, column: str = "study") -> tuple[DataFrame, list[str]]:
    """One 0/1 covariate per study but the last (`studies` is the short list of taking part)."""
    names = [f"study_{s}" for s in studies[:-1]]
    flags = [(F.col(column) == s).cast("double").alias(n) for s, n in zip(studies, names)]
    return design.select("*", *flags), names


def partial_derivatives(
    geno: DataFrame, design: DataFrame, covs: Sequence[str], traits: Sequence[str], study: str = "study", full: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(cohort statistics, variant statistics) of every study in one pass; g'Y only if `full`."""
    cohort = cohort_stats(design, covs, traits, by=[study])
    variants = variant_stats(geno, design.select("subject_id", study, *covs, *traits), covs, traits if full else [], by=[study])
    return cohort, variants


def merge_stats(parts: Sequence[DataFrame]) -> DataFrame:
    """Statistics of worker shards; their variants are disjoint, so rows are appended."""
    return reduce(DataFrame.unionByName, parts)


def pool_variants(variants: DataFrame, n_studies: int, study: str = "study") -> DataFrame:
    """Sum variant statistics over studies, keeping variants that every study has."""
    columns = [c for c in variants.columns if c not in (study, "variant_id")]
    return (
        variants.groupBy("variant_id")
        .agg(*[F.sum(c).alias(c) for c in columns], F.count_distinct(F.col(study)).alias("_studies"))
        .filter(F.col("_studies") == n_studies)
        .drop("_studies")
    )


def pool_cohorts(cohort: DataFrame, n_studies: int) -> DataFrame:
    """Sum cohort statistics over studies, keeping the names that every study has."""
    return (
        cohort.groupBy("kind", "i", "j")
        .agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("_have"))
        .filter(F.col("_have") == n_studies)
        .drop("_have")
    )


def meta_analyse(
    cohort: DataFrame, variants: DataFrame, covs: Sequence[str], traits: Sequence[str], study: str = "study"
) -> DataFrame:
    """Pooled association over all studies from their sufficient statistics."""
    n_studies = cohort.select(study).distinct().count()
    model = read_model(pool_cohorts(cohort, n_studies), covs, traits)
    return assoc_from_stats(pool_variants(variants, n_studies, study), model)


def meta_frequency(variants: DataFrame) -> DataFrame:
    """Size-weighted frequency of the counted allele over studies."""
    return variants.groupBy("variant_id").agg((F.sum("g") / (2 * F.sum("n"))).alias("af"))


def frequency_conflicts(variants: DataFrame, limit: float = 0.1) -> DataFrame:
    """Variants whose frequency differs between studies by more than `limit` (population deviation)."""
    return (
        variants.groupBy("variant_id")
        .agg(F.stddev_pop(F.col("g") / (2 * F.col("n"))).alias("af_std"))
        .filter(F.col("af_std") > limit)
    )


def stats_report(cohort: DataFrame, study: str = "study") -> DataFrame:
    """Comparable figures per study: C'C over n, and the mean of every trait."""
    n = cohort.filter((F.col("kind") == "acov") & (F.col("i") == ONE) & (F.col("j") == ONE)).select(
        study, F.col("v").alias("_n")
    )
    kept = cohort.filter((F.col("kind") == "acov") | ((F.col("kind") == "bcov") & (F.col("i") == ONE)))
    return kept.join(n, study).select(
        study,
        F.when(F.col("kind") == "acov", "gram").otherwise("trait_mean").alias("figure"),
        "i",
        "j",
        (F.col("v") / F.col("_n")).alias("value"),
    )


# ---------------------------------------------------------------- masked exchange


BLOCK = 256


def _mask(block: int, size: int, seed: int) -> np.ndarray:
    """Invertible matrix of a subject block, the same in every task: digits 1-9, redrawn if singular."""
    rng = np.random.default_rng([seed, block])
    while True:
        mask = rng.integers(1, 10, (size, size)).astype(float)
        if np.linalg.cond(mask) < 1e8:
            return mask


def encode_pair(geno: DataFrame, traits: DataFrame, subjects: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Mask genotypes and traits so that sum(dosage * value) per variant and trait is unchanged.

    Subjects are cut into blocks of 256; block b is multiplied by its own matrix F_b
    (genotypes) and F_b^-1 (traits). A task sees one block of subjects by one tile of
    256 variants or traits. `traits` is long (subject_id, trait, value). Missing calls take
    the variant's mean first, as in the open analysis; one would spoil its whole block.
    """
    geno = impute_mean(geno, rounded=False)
    placed = number_rows(subjects.select("subject_id").distinct(), ["subject_id"], "_at")
    placed = placed.withColumn("block", F.floor(F.col("_at") / BLOCK).cast("long")).withColumn(
        "place", (F.col("_at") % BLOCK).cast("int")
    )
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("size"))
    placed = materialise(placed.join(sizes, "block").select("subject_id", "block", "place", "size"))

    def encoder(name: str, value: str, inverse: bool):
        def encode(pdf: pd.DataFrame) -> pd.DataFrame:
            block, size = int(pdf["block"].iloc[0]), int(pdf["size"].iloc[0])
            mask = _mask(block, size, seed)
            if inverse:
                mask = np.linalg.inv(mask).T
            names, rows = np.unique(pdf[name].to_numpy(), return_inverse=True)
            cells = np.zeros((len(names), size))
            cells[rows, pdf["place"].to_numpy()] = pdf[value].to_numpy(float)
            coded = cells @ mask
            return pd.DataFrame(
                {
                    "block": np.int64(block),
                    "place": np.tile(np.arange(size, dtype=np.int32), len(names)),
                    name: np.repeat(names, size),
                    value: coded.ravel(),
                }
            )

        return encode

    def coded(df: DataFrame, name: str, value: str, inverse: bool) -> DataFrame:
        kind = df.schema[name].dataType.simpleString()
        tile = F.pmod(F.xxhash64(name), F.lit(1 << 20)) if kind == "string" else F.floor(F.col(name) / BLOCK)
        return (
            df.join(placed, "subject_id")
            .withColumn("_tile", tile)
            .groupBy("block", "_tile")
            .applyInPandas(encoder(name, value, inverse), f"block long, place int, {name} {kind}, {value} double")
        )

    return coded(geno, "variant_id", "dosage", False), coded(traits, "trait", "value", True)


def masked_cross(geno: DataFrame, traits: DataFrame, trait_names: Sequence[str]) -> DataFrame:
    """g'y from a masked pair: rows (variant_id, trait, v)."""
    values = [F.max(F.when(F.col("trait") == t, F.col("value"))).alias(t) for t in trait_names]
    wide = traits.groupBy("block", "place").agg(*values)
    sums = [F.sum(F.col("dosage") * F.col(t)).alias(t) for t in trait_names]
    summed = geno.join(wide, ["block", "place"]).groupBy("variant_id").agg(*sums)
    return summed.unpivot(["variant_id"], list(trait_names), "trait", "v")


# ---------------------------------------------------------------- dense tiles

# A design up to this size travels to every task; beyond it tiles and design rows meet in a shuffle.
BROADCAST_BYTES = 128 << 20
# Variants multiplied at once, which bounds the dense working matrix.
ROWS_PER_PRODUCT = 512
# A product by listed cells costs as many dense ones per cell, and a dense block as many rows more.
CELLS_PER_LISTED, ROWS_PER_BLOCK = 32, 64
# Cells multiplied at once by the listed cells.
CELLS_PER_PRODUCT = 1 << 21
# A matrix up to this size is spread over all cores first; a larger one has enough file splits.
SPREAD_CELLS = 1 << 30
# Variants whose sums over all subject tiles are added up and tested together.
VARIANTS_PER_SOLVE = 64


def _packed(tiles: DataFrame, tile: int) -> DataFrame:
    """Tiles for the product: the dosages, and where they lie in the tile.

    A gapless run of subjects is told by its first place alone, so a dense tile carries
    nothing but its dosages.
    """
    ids = F.col("subject_ids")
    gapless = F.element_at(ids, -1) - F.element_at(ids, 1) + 1 == F.size(ids)
    return tiles.filter(F.size("dosages") > 0).select(
        F.col("variant_id").cast("long").alias("variant_id"),
        F.col("tile").cast("long").alias("tile"),
        (F.element_at(ids, 1) % tile).cast("int").alias("first"),
        F.when(~gapless, F.transform(ids, lambda i: (i % tile).cast("int"))).alias("places"),
        "dosages",
    )


@dataclass
class TileSums:
    """Sums per variant over the listed cells; gx and seen have one column per design column."""

    variant: pa.Array
    called: np.ndarray
    cells: np.ndarray
    g: np.ndarray
    gg: np.ndarray
    gx: np.ndarray
    seen: np.ndarray

    SCHEMA = "variant_id long, called double, cells double, g double, gg double, gx array<double>, seen array<double>"

    def to_arrow(self) -> pa.Table:
        def lists(matrix: np.ndarray) -> pa.Array:
            return to_lists(np.full(len(matrix), matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))

        flat = [pa.array(v.astype(float)) for v in (self.called, self.cells, self.g, self.gg)]
        names = ["variant_id", "called", "cells", "g", "gg", "gx", "seen"]
        return pa.Table.from_arrays([self.variant, *flat, lists(self.gx), lists(self.seen)], names=names)

    @staticmethod
    def added(rows: pa.Table) -> "TileSums":
        """Sums over the subject tiles of every variant."""
        variants = combined(rows, "variant_id").dictionary_encode(null_encoding="encode")
        variant, at = variants.dictionary, np.asarray(variants.indices)

        def add(name: str) -> np.ndarray:
            column = combined(rows, name)
            parts = np.asarray(column.flatten()).reshape(len(rows), -1) if name in ("gx", "seen") else column.to_numpy()
            out = np.zeros((len(variant), *parts.shape[1:]))
            np.add.at(out, at, parts)
            return out

        return TileSums(variant, *[add(c) for c in ("called", "cells", "g", "gg", "gx", "seen")])


def _places(rows: pa.Table, counts: np.ndarray) -> np.ndarray:
    """Place in its tile of every cell."""
    places = combined(rows, "places")
    start = np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(rows["first"].to_numpy(), counts) + np.arange(len(start)) - start
    at[np.repeat(np.asarray(places.is_valid()), counts)] = np.asarray(places.flatten())
    return at


def _few_cells(rows: pa.Table, tile: int, blocks: int = 1) -> bool:
    """Whether rows of `blocks` subject tiles cost less by their cells than as dense matrices."""
    cells = len(combined(rows, "dosages").flatten())
    return cells * CELLS_PER_LISTED < (len(rows) + ROWS_PER_BLOCK * (blocks - 1)) * tile


def _listed_products(rows: pa.Table, x: np.ndarray, at: np.ndarray, known: np.ndarray, sparse: bool) -> TileSums:
    """The sums of `_block_products` by the listed cells alone; `at` is the design row of a cell, if `known`."""
    n = len(rows)
    counts, value, valid = flat_lists(combined(rows, "dosages"))
    row, at, value, valid = (v[known] for v in (np.repeat(np.arange(n), counts), at, value, valid))
    marked = ~valid if sparse else valid

    def total(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v, minlength=n)

    def products(v: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        if v.any():
            for j in range(x.shape[1]):
                out[:, j] = total(v * x[at, j])
        return out

    cells = np.bincount(row, minlength=n)
    return TileSums(
        combined(rows, "variant_id"), total(valid), cells, total(value), total(value * value), products(value), products(marked)
    )


def _block_products(rows: pa.Table, x: np.ndarray, present: np.ndarray, sparse: bool) -> TileSums:
    """Sums of the variants of one subject tile, x being its design rows."""
    tile, n = len(x), len(rows)
    counts, value, valid = flat_lists(combined(rows, "dosages"))
    first = rows["first"].to_numpy()
    places = combined(rows, "places")
    dosage, listed, called = np.zeros((n, tile)), np.zeros((n, tile), bool), np.zeros((n, tile), bool)
    if places.null_count == n and (counts == counts[0]).all() and (first == first[0]).all():
        columns, shape = slice(first[0], first[0] + counts[0]), (n, counts[0])
        dosage[:, columns], listed[:, columns] = value.reshape(shape), True
        called[:, columns] = valid.reshape(shape)
    else:
        row, at = np.repeat(np.arange(n), counts), _places(rows, counts)
        dosage[row, at], listed[row, at], called[row, at] = value, True, valid
    # Only the taken stretch of the tile takes part in the products.
    last = int(np.flatnonzero(present)[-1]) + 1
    x, present, dosage = x[:last], present[:last], dosage[:, :last]
    listed, called = listed[:, :last] & present, called[:, :last] & present
    if not present.all():
        dosage = dosage * present
    marked = listed & ~called if sparse else called
    if not marked.any():
        seen = np.zeros((n, x.shape[1]))
    elif (marked == present).all():
        # Nothing missing: the marked sums are the tile's column sums.
        seen = np.broadcast_to(x.sum(axis=0), (n, x.shape[1]))
    else:
        seen = marked.astype(float) @ x
    squares = np.einsum("ij,ij->i", dosage, dosage)
    return TileSums(
        combined(rows, "variant_id"), called.sum(axis=1), listed.sum(axis=1), dosage.sum(axis=1), squares, dosage @ x, seen
    )


@dataclass
class TileModel:
    """What a task needs to test the variants it has summed: numbers per covariate and trait only."""

    n: int
    k: int
    traits: list[str]
    means: np.ndarray
    inverse: np.ndarray
    cross: np.ndarray
    rest: np.ndarray
    sparse: bool
    maf: float
    threshold: float | None

    SCHEMA = "variant_id long, trait string, af double, beta double, se double, t_stat double, df long"

    def test(self, sums: TileSums) -> pa.Table:
        """Results of every variant and trait, missing calls filled with the variant mean.

        The design is centred, so its totals over all subjects are zero.
        """
        with np.errstate(divide="ignore", invalid="ignore"):
            missing = sums.cells - sums.called if self.sparse else self.n - sums.called
            mean = sums.g / (self.n - missing)
            products = sums.gx + mean[:, None] * (sums.seen if self.sparse else -sums.seen)
            gg = sums.gg + missing * mean**2
            af = mean / 2
            gc = np.column_stack([mean * self.n, products[:, : self.k]])
            u = gc @ self.inverse
            s = gg - (u * gc).sum(axis=1)
            s[~(s > gg * SINGULAR)] = np.nan
            beta = (products[:, self.k :] - u @ self.cross) / s[:, None]
            df = self.n - self.k - 2
            se = np.sqrt(np.abs(self.rest - beta**2 * s[:, None]) / (df * s[:, None]))
            t = beta / se
        t[se == 0] = np.nan
        keep = np.ones(t.shape, bool)
        if self.maf:
            keep &= ((af > self.maf) & (af < 1 - self.maf) & (af != 0.5))[:, None]
        if self.threshold is not None:
            keep &= np.abs(t) > self.threshold
        row, column = np.nonzero(keep)
        numbers = [pa.array(v, from_pandas=True) for v in (af[row], beta[keep], se[keep], t[keep])]
        names = pa.array(self.traits, pa.string()).take(pa.array(column))
        columns = [sums.variant.take(pa.array(row)), names, *numbers, pa.array(np.full(len(row), df))]
        return pa.Table.from_arrays(columns, names=["variant_id", "trait", "af", "beta", "se", "t_stat", "df"])


def _matrix(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The design columns x of some rows."""
    return np.asarray(combined(rows, "x").flatten()).reshape(len(rows), -1)


def _design_products(design: DataFrame, k: int, means: np.ndarray | None) -> np.ndarray:
    """Without means the column sums; with them C'[C, Y] and y'y of the centred columns, flattened.

    A task folds its rows into one row of sums, so the driver adds as many short rows as there are tasks.
    """

    def fold(batches):
        total = 0.0
        for batch in batches:
            x = _matrix(batch)
            if means is None:
                part = np.append(x.sum(axis=0), len(x))
            else:
                x = x - means
                part = np.append((x[:, :k].T @ x).ravel(), np.einsum("ij,ij->j", x[:, k:], x[:, k:]))
            total = total + part
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return sum(np.array(r.v) for r in design.mapInArrow(fold, "v array<double>").collect())


def _tile_model(design: DataFrame, covs: Sequence[str], traits: Sequence[str], **options) -> TileModel:
    k, p = len(covs), len(traits)
    sums = _design_products(design, k, None)
    n, means = int(sums[-1]), sums[:-1] / sums[-1]
    flat = _design_products(design, k, means)
    products, yy = flat[: k * (k + p)].reshape(k, k + p), flat[k * (k + p) :]
    # Centred columns are orthogonal to the intercept.
    gram, cross = np.zeros((k + 1, k + 1)), np.zeros((k + 1, p))
    gram[0, 0], gram[1:, 1:], cross[1:] = n, products[:, :k], products[:, k:]
    inverse = np.linalg.inv(gram)
    rest = yy - np.einsum("ij,ij->j", cross, inverse @ cross)
    return TileModel(n, k, list(traits), means, inverse, cross, rest, **options)


def _design_tile(ids: np.ndarray, values: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(design rows by place in the tile, which places are taken)."""
    x, present = np.zeros((tile, values.shape[1])), np.zeros(tile, bool)
    x[ids % tile], present[ids % tile] = values, True
    return x, present


def _tile_products(rows: pa.Table, x: np.ndarray, present: np.ndarray, sparse: bool):
    """Sums of rows of one subject tile, x being its design rows."""
    if _few_cells(rows, len(x)):
        at = _places(rows, combined(rows, "dosages").value_lengths().to_numpy())
        yield _listed_products(rows, x, at, present[at], sparse)
        return
    for start in range(0, len(rows), ROWS_PER_PRODUCT):
        yield _block_products(rows.slice(start, ROWS_PER_PRODUCT), x, present, sparse)


def _tile_pass(packed: DataFrame, design: DataFrame, model: TileModel, tile: int, n_variants: int, per_group: int) -> DataFrame:
    """Results of one pass over the tiles for the traits of `model`; `design` is (subject_id, x)."""
    means, sparse, width = model.means, model.sparse, len(model.means)
    last = design.agg(F.min("subject_id"), F.max("subject_id")).first()
    one_tile = last[0] // tile == last[1] // tile
    schema = TileModel.SCHEMA if one_tile else TileSums.SCHEMA

    def finish(sums: TileSums) -> pa.Table:
        return model.test(sums) if one_tile else sums.to_arrow()

    if model.n * (width + 1) * 8 <= BROADCAST_BYTES:
        table = design.toArrow()
        order = np.argsort(table["subject_id"].to_numpy(), kind="stable")
        ids, values = table["subject_id"].to_numpy()[order], _matrix(table)[order] - means
        shared = design.sparkSession.sparkContext.broadcast((ids, values))

        def by_batch(batches):
            ids, values = shared.value
            for batch in batches:
                for piece in pieces(batch, "dosages", CELLS_PER_PRODUCT):
                    for sums in by_piece(pa.Table.from_batches([piece]), ids, values):
                        yield from finish(sums).to_batches()

        def by_piece(rows, ids, values):
            tile_of = rows["tile"].to_numpy()
            blocks = np.unique(tile_of)
            low, high = (np.searchsorted(ids, edge * tile) for edge in (blocks, blocks + 1))
            taken = low < high  # not so for tiles without design rows and for a null subject
            if not taken.all():
                rows = rows.filter(pa.array(np.isin(tile_of, blocks[taken])))
                tile_of, blocks, low, high = rows["tile"].to_numpy(), blocks[taken], low[taken], high[taken]
            if len(rows) and _few_cells(rows, tile, len(blocks)):
                counts = combined(rows, "dosages").value_lengths().to_numpy()
                subject = np.repeat(tile_of, counts) * tile + _places(rows, counts)
                at = np.searchsorted(ids, subject, side="right") - 1
                yield _listed_products(rows, values, at, (at >= 0) & (ids[at] == subject), sparse)
                return
            for t, start, end in zip(blocks, low, high, strict=True):
                x, present = _design_tile(ids[start:end], values[start:end], tile)
                yield from _tile_products(rows.filter(pa.array(tile_of == t)), x, present, sparse)

        if n_variants * model.n <= SPREAD_CELLS:
            packed = packed.repartition(2 * design.sparkSession.sparkContext.defaultParallelism, "variant_id")
        parts = packed.mapInArrow(by_batch, schema)
    else:
        empty = (model.test if one_tile else TileSums.to_arrow)(
            TileSums(pa.array([], pa.int64()), *[np.zeros(0)] * 4, np.zeros((0, width)), np.zeros((0, width)))
        )

        def by_group(left: pa.Table, right: pa.Table) -> pa.Table:
            if len(left) == 0 or len(right) == 0:
                return empty
            x, present = _design_tile(right["subject_id"].to_numpy(), _matrix(right) - means, tile)
            return pa.concat_tables(finish(sums) for sums in _tile_products(left, x, present, sparse))

        # A subject tile has as many groups as its rows fill, so the copies of its design rows grow with those.
        rows_of = packed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / per_group).cast("int").alias("_groups"))
        rows_of = F.broadcast(materialise(rows_of))  # one short row for each tile of subjects
        left = packed.join(rows_of, "tile").withColumn("_group", F.pmod(F.xxhash64("variant_id"), "_groups").cast("int"))
        right = (
            design.withColumn("tile", F.floor(F.col("subject_id") / tile).cast("long")).join(rows_of, "tile")
            .select("subject_id", "x", "tile", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"))
        )
        parts = left.groupBy("tile", "_group").cogroup(right.groupBy("tile", "_group")).applyInArrow(by_group, schema)
    if one_tile:
        return parts
    # A handful of variants per group: their sums over all subject tiles are a few megabytes.
    groups = max(1, n_variants // VARIANTS_PER_SOLVE)
    return (
        parts.groupBy(F.pmod(F.xxhash64("variant_id"), F.lit(groups)))
        .applyInArrow(lambda rows: model.test(TileSums.added(rows)), TileModel.SCHEMA)
    )


def pack_design(design: DataFrame, covs: Sequence[str], traits: Sequence[str]) -> DataFrame:
    """(subject_id, x): covariates and traits of complete subjects as one array, written once for many runs."""
    x = F.array(*[f"`{c}`" for c in [*covs, *traits]]).cast("array<double>")
    rows = design.select("subject_id", x.alias("x")).filter(~F.exists("x", lambda v: v.isNull()))
    return materialise(rows)


def gwas_tiles(
    tiles: DataFrame,
    design: DataFrame,
    covs: Sequence[str],
    traits: Sequence[str],
    tile: int,
    maf: float = 0.0,
    threshold: float | None = None,
    sparse: bool = False,
    n_variants: int | None = None,
    subjects: DataFrame | None = None,
    variants_per_group: int = 4096,
    traits_per_pass: int = 1024,
) -> DataFrame:
    """`gwas` over the tiled layout (variant_id, tile, subject_ids, dosages) of dense matrices.

    If the design is small (its row count times its width is checked) every task gets it
    and the genotypes do not move. Otherwise tiles and design rows meet in groups of one
    subject tile by one part of the variants, whose memory the sizes fix. Traits are
    handled `traits_per_pass` at a time; `n_variants` saves counting them. `design` is wide
    or already packed by `pack_design` in the order of `covs` and `traits`. `subjects`
    names the individuals of the matrix where the design has others too; without it a
    design row that no tile lists counts as missing everywhere (sparse: as dosage 0).
    """
    rows = design if design.columns == ["subject_id", "x"] else pack_design(design, covs, traits)
    if subjects is not None:
        rows = materialise(rows.join(subjects.select("subject_id"), "subject_id", "left_semi"))
    if n_variants is None:
        n_variants = tiles.select("variant_id").distinct().count()
    packed, kind = _packed(tiles, tile), tiles.schema["variant_id"].dataType
    passes = []
    for first in range(0, len(traits), traits_per_pass):
        some = list(traits[first : first + traits_per_pass])
        used = rows
        if len(some) < len(traits):
            x = F.concat(F.slice("x", 1, len(covs)), F.slice("x", len(covs) + first + 1, len(some)))
            used = rows.select("subject_id", x.alias("x"))
        model = _tile_model(used, covs, some, sparse=sparse, maf=maf, threshold=threshold)
        passes.append(_tile_pass(packed, used, model, tile, n_variants, variants_per_group))
    return merge_stats(passes).withColumn("variant_id", F.col("variant_id").cast(kind))
