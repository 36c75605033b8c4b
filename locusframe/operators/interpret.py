"""Weights, importances and interactions of a fitted topology network."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.activations import activate, slope
from locusframe.operators.cohort import rank_slice
from locusframe.operators.least_squares import joint_least_squares
from locusframe.operators.metrics import auc
from locusframe.operators.network import Network, layer_forward
from locusframe.operators.ordering import number_rows
from locusframe.operators.topology import node_columns
from locusframe.session import materialise

# ---------------------------------------------------------------- path tables


def connection_weights(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """Distinct path rows with the weight of every layer, weights_<k>, and their product.

    `weights` (layer, src, dst, w) holds one edge layer per adjacent pair of node
    columns plus, as the last layer, the weights from the last nodes into the score.
    """
    nodes = node_columns(paths)
    names = [c.replace("_node", "_name") for c in nodes]
    keep = [c for c in ["chr", *[x for pair in zip(nodes, names) for x in pair]] if c in paths.columns]
    table = paths.select(*keep).distinct()
    for i, node in enumerate(nodes):
        layer = weights.filter(F.col("layer") == i)
        edge = [F.col(node) == F.col("src")]
        if i + 1 < len(nodes):
            edge.append(F.col(nodes[i + 1]) == F.col("dst"))
        table = table.join(layer.select("src", "dst", F.col("w").alias(f"weights_{i}")), edge).drop("src", "dst")
    return table.withColumn("raw_importance", raw_importance(table))


def weight_columns(cw: DataFrame) -> list[str]:
    return sorted((c for c in cw.columns if c.startswith("weights_")), key=lambda c: int(c.split("_")[1]))


def raw_importance(cw: DataFrame) -> Column:
    """Product of the weights along a path."""
    return reduce(lambda a, b: a * b, [F.col(c) for c in weight_columns(cw)])


def input_importance(weights: DataFrame) -> DataFrame:
    """Weight products from every input to the score, one row per path and filter, with its share in percent.

    `weights` (layer, src, dst, filter, w); a layer's filters multiply with the filters before it.
    """
    layers = [r[0] for r in weights.select("layer").distinct().orderBy("layer").collect()]
    table = None
    for i in layers:
        layer = weights.filter(F.col("layer") == i).select(
            F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("filter").alias("_f"), "w"
        )
        count = layer.agg(F.max("_f")).first()[0] + 1
        if table is None:
            table = layer.select(
                F.col("_src").alias("input"), F.col("_dst").alias("node"), F.col("_f").alias("filter"), F.col("w").alias("importance")
            )
        else:
            table = table.join(layer, F.col("node") == F.col("_src")).select(
                "input",
                F.col("_dst").alias("node"),
                (F.col("filter") * count + F.col("_f")).alias("filter"),
                (F.col("importance") * F.col("w")).alias("importance"),
            )
    totals = table.groupBy("filter").agg(F.sum(F.abs("importance")).alias("_total"))
    return table.join(totals, "filter").select(
        "input", "filter", "importance", F.try_divide(100 * F.abs("importance"), F.col("_total")).alias("percentage")
    )


def path_shares(cw: DataFrame) -> DataFrame:
    """Path rows with `share`, their part of the summed absolute importance in percent."""
    total = cw.agg(F.sum(F.abs("raw_importance"))).first()[0]
    return cw.withColumn("share", F.try_divide(100 * F.abs("raw_importance"), F.lit(total)))


def importance_rollup(cw: DataFrame, levels: list[int], threshold: float = 0.01) -> DataFrame:
    """Share of every node at every level (level, name, share) above the threshold, in one aggregation."""
    cells = [F.struct(F.lit(i).alias("level"), F.col(f"layer{i}_name").alias("name")) for i in levels]
    return (
        path_shares(cw)
        .select("share", F.explode(F.array(*cells)).alias("c"))
        .groupBy("c.level", "c.name")
        .agg(F.sum("share").alias("share"))
        .filter(F.col("share") > threshold)
    )


def layer_weight_table(cw: DataFrame, layer: int) -> DataFrame:
    """Distinct edges of a layer by (chr, node) with running position and relative weight."""
    nodes = node_columns(cw)
    columns = [c for c in ["chr", f"layer{layer}_node", f"layer{layer}_name"] if c in cw.columns]
    if layer + 1 < len(nodes):
        columns += [f"layer{layer + 1}_node", f"layer{layer + 1}_name"]
    edges = cw.select(*columns, F.col(f"weights_{layer}").alias("w")).distinct()
    if layer + 1 == len(nodes):
        edges = edges.withColumn(f"layer{layer + 1}_node", F.lit(0).cast("long"))
        edges = edges.withColumn(f"layer{layer + 1}_name", F.lit("end_node"))
    order = [c for c in ["chr", f"layer{layer}_node"] if c in edges.columns] + [f"layer{layer + 1}_node"]
    top = edges.agg(F.max(F.abs("w"))).first()[0]
    return number_rows(edges, order, "pos").withColumn("plot_weight", F.try_divide(F.abs("w"), F.lit(top)))


def manhattan_table(cw: DataFrame) -> DataFrame:
    """Paths in genomic order with position and importance relative to the largest."""
    nodes = node_columns(cw)
    order = (["chr"] if "chr" in cw.columns else []) + nodes
    top = cw.agg(F.max(F.abs("raw_importance"))).first()[0]
    kept = cw.select(*order, *[n.replace("_node", "_name") for n in nodes], "raw_importance")
    return number_rows(kept, order, "pos").withColumn(
        "relative", F.try_divide(F.abs("raw_importance"), F.lit(top))
    )


def group_bounds(table: DataFrame, group: str = "chr", exclusive: bool = True) -> DataFrame:
    """End of every group along `pos`, its start (the end before) and the middle for a label."""
    ends = table.groupBy(group).agg((F.max("pos") + (1 if exclusive else 0)).alias("end"))
    # One row per chromosome or gene; still numbered without a one-task sort.
    placed = number_rows(ends, ["end"], "_at")
    before = placed.select((F.col("_at") + 1).alias("_at"), F.col("end").alias("start"))
    joined = placed.join(before, "_at", "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    return joined.select(group, "start", "end", ((F.col("start") + F.col("end")) / 2).alias("middle"))


# ---------------------------------------------------------------- interactions


def downstream_weight(weights: DataFrame, layer: int) -> DataFrame:
    """(node, down): absolute weight products from the output nodes of `layer` to the score, summed over paths."""
    last = weights.agg(F.max("layer")).first()[0]
    down = weights.filter(F.col("layer") == last).groupBy(F.col("src").alias("node")).agg(F.sum(F.abs("w")).alias("down"))
    for i in range(last - 1, layer, -1):
        edges = weights.filter(F.col("layer") == i).select("src", F.col("dst").alias("node"), "w")
        down = edges.join(down, "node").groupBy(F.col("src").alias("node")).agg(F.sum(F.abs("w") * F.col("down")).alias("down"))
    return down


def smallest_fan_in(weights: DataFrame) -> int:
    return weights.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]


def interaction_profile(weights: DataFrame, down: DataFrame, n: int | None = None) -> DataFrame:
    """All pair strengths of every gene in linear size: (gene, src, rank, strength, partners).

    A pair's strength is the smaller of two |w| times the gene's downstream weight. In
    falling |w| (ties by src), input b has that strength with each of the `rank - 1`
    inputs before it, so one row stands for all these pairs. `n` keeps the n largest
    inputs per gene.
    """
    ranked = number_rows(
        weights.select(F.col("dst").alias("gene"), "src", F.abs("w").alias("size")),
        [F.desc("size"), F.asc("src")],
        "rank",
        by=["gene"],
        start=1,
    )
    if n is not None:
        ranked = ranked.filter(F.col("rank") <= n)
    return ranked.join(down.withColumnRenamed("node", "gene"), "gene").select(
        "gene",
        "src",
        "rank",
        (F.col("size") * F.col("down")).alias("strength"),
        (F.col("rank") - 1).alias("partners"),
    )


def top_interactions(weights: DataFrame, down: DataFrame, k: int, n: int | None = None) -> DataFrame:
    """The k strongest pairs (gene, src_a, src_b, strength) over all genes; src_a has the larger |w|.

    Exact without listing all pairs: a gene's k first pairs lie among its first m inputs,
    m(m-1)/2 >= k (pairs are ordered by strength, then gene, rank and partner), so every
    gene offers at most m inputs, whatever its size.
    """
    m = 2
    while m * (m - 1) // 2 < k:
        m += 1
    limit = m if n is None else min(m, n)
    by_size = Window.partitionBy("gene").orderBy(F.desc("size"), F.asc("src"))
    first = (
        weights.select(F.col("dst").alias("gene"), "src", F.abs("w").alias("size"))
        .withColumn("rank", F.row_number().over(by_size))
        .filter(F.col("rank") <= limit)
        .join(down.withColumnRenamed("node", "gene"), "gene")
        .withColumn("strength", F.col("size") * F.col("down"))
    )
    # The k strongest (gene, b) rows already hold k pairs or more.
    later = first.filter(F.col("rank") > 1).orderBy(F.desc("strength"), "gene", "rank").limit(k)
    partner = first.select("gene", F.col("src").alias("src_a"), F.col("rank").alias("rank_a"))
    return (
        later.withColumnRenamed("src", "src_b")
        .join(partner, "gene")
        .filter(F.col("rank_a") < F.col("rank"))
        .orderBy(F.desc("strength"), "gene", "rank", "rank_a")
        .limit(k)
        .select("gene", "src_a", "src_b", "strength")
    )


def epistasis_auc(ranking: DataFrame, causal: DataFrame, k: int, run: str | None = None) -> DataFrame:
    """AUC of the first k pairs (coord 'a b ', strength) against pairs of two different causal inputs; 0 for one class."""
    pair = F.split(F.trim("coord"), r"\s+")
    parsed = ranking.withColumn("_a", pair[0].cast("long")).withColumn("_b", pair[1].cast("long"))
    order = [F.desc("strength"), F.asc("coord")]
    if run is None:
        first, by = parsed.orderBy(*order).limit(k), []
    else:
        # The rank filter is applied before the exchange too, so a run sends at most k rows per task.
        ranked = parsed.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
        first, by = ranked.filter(F.col("_k") <= k).drop("_k"), [run]
    known = causal.select(F.col("variant_id").alias("_id")).distinct()
    for side in ("_a", "_b"):
        hit = known.withColumnRenamed("_id", side).withColumn(f"_hit{side}", F.lit(True))
        first = first.join(hit, side, "left")
    both = F.col("_hit_a").isNotNull() & F.col("_hit_b").isNotNull() & (F.col("_a") != F.col("_b"))
    scored = first.select(*by, both.cast("int").alias("y"), F.col("strength").alias("p"))
    # Equal strengths rank nothing: 0 as well.
    spread = scored.groupBy(*by).agg((F.min("p") < F.max("p")).alias("_ranked"))
    value = F.when(F.col("_ranked"), F.coalesce("auc", F.lit(0.0))).otherwise(0.0).alias("auc")
    found = auc(scored, by=by)
    joined = found.join(spread, by) if by else found.join(F.broadcast(spread))  # one row each without runs
    return joined.select(*[value if c == "auc" else c for c in found.columns])


# ---------------------------------------------------------------- predictors of the label


def univariate_fit(acts: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, r2): adjusted R2 of y on one predictor without intercept; null for a constant predictor."""
    x, y = F.col("value"), F.col("y")
    sums = acts.join(labels, "subject_id").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x * y).alias("xy"),
        F.sum(x * x).alias("xx"),
        F.sum(y * y).alias("yy"),
        (F.min("value") == F.max("value")).alias("constant"),
    )
    r2 = F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy"))
    adjusted = 1 - F.col("n") / (F.col("n") - 1) * (1 - r2)
    return sums.select("node", F.when(~F.col("constant"), adjusted).alias("r2"))


def rlipp(edges: DataFrame, child_fits: DataFrame, parent_fits: DataFrame) -> DataFrame:
    """Gain of every parent over its child: (parent - child) / child, 0 where the parent fit is negative."""
    child = child_fits.select(F.col("node").alias("src"), F.col("r2").alias("child_r2"))
    parent = parent_fits.select(F.col("node").alias("dst"), F.col("r2").alias("parent_r2"))
    gain = F.try_divide(F.col("parent_r2") - F.col("child_r2"), F.col("child_r2"))
    return edges.join(child, "src").join(parent, "dst").select(
        "src", "dst", F.when(F.col("parent_r2") < 0, 0.0).otherwise(gain).alias("rlipp")
    )


def joint_fit(acts: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, children, rank, r2): adjusted R2 of y on all children of a parent jointly, no intercept.

    Degrees of freedom go by the rank of the children, so copies, sums and constants at 0 among them
    cost none. Null where the children leave no degree of freedom, and where rank is (see
    joint_least_squares).
    """
    cells = acts.join(edges.select(F.col("src").alias("node"), "dst").distinct(), "node")
    cells = cells.select(F.col("dst").cast("long").alias("group"), F.col("subject_id").alias("row"), F.col("node").alias("column"), F.col("value").cast("double").alias("value"))
    target = labels.join(acts.select("subject_id").distinct(), "subject_id", "left_semi").select(F.col("subject_id").alias("row"), "y")
    fits, n, yy = joint_least_squares(cells, target)
    spare = F.lit(n) - F.col("rank")
    return fits.select(
        F.col("group").alias("dst"), F.col("columns").alias("children"), "rank",
        F.when(spare > 0, 1 - F.lit(n) / spare * (1 - F.try_divide(F.col("explained"), F.lit(yy)))).alias("r2"),
    )


def rlipp_joint(edges: DataFrame, children: DataFrame, parents: DataFrame, labels: DataFrame) -> DataFrame:
    """RLIPP of every parent against the joint fit of its children (values per subject and node)."""
    joint = joint_fit(children, labels, edges).select("dst", F.col("r2").alias("child_r2"))
    parent = univariate_fit(parents, labels).select(F.col("node").alias("dst"), F.col("r2").alias("parent_r2"))
    gain = F.try_divide(F.col("parent_r2") - F.col("child_r2"), F.col("child_r2"))
    return joint.join(parent, "dst").select(
        "dst", "parent_r2", "child_r2", F.when(F.col("parent_r2") < 0, 0.0).otherwise(gain).alias("rlipp")
    )


def univariate_logit(acts: DataFrame, labels: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(node, beta, pseudo_r2): logistic fit of y on one predictor without intercept, McFadden's R2.

    Newton steps for all nodes at once over counts per (node, value, y), shortened so that they
    always converge, until every node has. The null model is the intercept-only one. Where the
    sign of the predictor separates the labels there is no maximum: beta and pseudo_r2 are null.
    """
    counts = materialise(
        acts.join(labels, "subject_id").groupBy("node", F.col("value").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    side = F.col("x") * (2 * F.col("y") - 1)
    separate = (F.min(side) >= 0) | (F.max(side) <= 0)
    betas = materialise(
        counts.groupBy("node").agg(separate.alias("separate"), F.max(F.abs("x")).alias("reach"))
        .select("node", "separate", "reach", F.when(F.col("separate"), None).otherwise(0.0).cast("double").alias("beta"))
    )
    p = 1 / (1 + F.exp(-F.col("beta") * F.col("x")))
    for rounds in count():
        sums = counts.join(betas.where("NOT separate"), "node").groupBy("node", "beta", "reach").agg(
            F.sum(F.col("n") * F.col("x") * (F.col("y") - p)).alias("slope"),
            F.sum(F.col("n") * F.col("x") * F.col("x") * p * (1 - p)).alias("curve"),
        )
        newton = F.coalesce(F.try_divide("slope", "curve"), F.lit(0.0))
        step = F.signum(newton) * F.log1p(F.col("reach") * F.abs(newton)) / F.col("reach")
        moved = materialise(sums.select("node", "reach", (F.col("beta") + step).alias("beta"), (F.abs(step) / (1 + F.abs("beta"))).alias("step")))
        betas = betas.where("separate").unionByName(moved.select("node", F.lit(False).alias("separate"), "reach", "beta"))
        if (moved.agg(F.max("step")).first()[0] or 0.0) < tolerance:
            break
        if rounds == 1000:
            raise RuntimeError("the logistic fits do not converge")
    fitted = F.col("n") * (F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    per_node = counts.join(betas, "node").groupBy("node", "beta").agg(
        F.sum(fitted).alias("ll"),
        F.sum(F.col("n") * F.col("y")).alias("pos"),
        F.sum("n").alias("total"),
        (F.min("x") == F.max("x")).alias("constant"),
    )
    share = F.col("pos") / F.col("total")
    null = F.col("pos") * F.log(share) + (F.col("total") - F.col("pos")) * F.log(1 - share)
    return per_node.select("node", "beta", F.when(~F.col("constant"), 1 - F.try_divide(F.col("ll"), null)).alias("pseudo_r2"))


# ---------------------------------------------------------------- attributions

PATH_STEPS = 8


def _upper_slopes(net: Network, z: DataFrame, keys: list[str]) -> DataFrame:
    """Derivative of the score by the first layer's sums: rows (keys, node, d) from (keys, node, z).

    `keys` identify an evaluation; all layers above the first one are small per evaluation.
    """
    sums, values = [z], z
    one = F.struct(*keys).alias("subject_id")
    for i, kind in enumerate(net.kinds[:-1]):
        acts = values.select(one, "node", activate(F.col("z"), kind).alias("value"))
        weights, bias = net.layer(i + 1)
        values = layer_forward(acts, weights, bias).select("subject_id.*", "node", F.col("value").alias("z"))
        sums.append(values)
    delta = values.select(*keys, "node", slope(F.col("z"), net.kinds[-1]).alias("d"))
    for i in range(net.depth - 1, 0, -1):
        weights, _ = net.layer(i)
        back = (
            delta.withColumnRenamed("node", "dst").join(weights, "dst")
            .groupBy(*keys, F.col("src").alias("node")).agg(F.sum(F.col("d") * F.col("w")).alias("d"))
        )
        delta = back.join(sums[i - 1], [*keys, "node"]).select(
            *keys, "node", (F.col("d") * slope(F.col("z"), net.kinds[i - 1])).alias("d")
        )
    return delta


def _path_slopes(net: Network, z: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Mean derivative by the first layer's sums along the straight path from the background.

    The first layer is linear, so a path between inputs is a path between its sums and the
    genotypes are not read again for the points in between (midpoints of equal steps).
    """
    steps = F.explode(F.array(*[F.lit((s + 0.5) / PATH_STEPS) for s in range(PATH_STEPS)]))
    points = (
        z.join(base.select("node", F.col("z").alias("_b")), "node").withColumn("alpha", steps)
        .select(*keys, "alpha", "node", (F.col("_b") + F.col("alpha") * (F.col("z") - F.col("_b"))).alias("z"))
    )
    return _upper_slopes(net, points, [*keys, "alpha"]).groupBy(*keys, "node").agg(F.avg("d").alias("d"))


def background_mean(geno: DataFrame, background: DataFrame) -> DataFrame:
    """(variant_id, base): mean dosage of the background subjects."""
    return geno.join(background.select("subject_id"), "subject_id", "left_semi").groupBy("variant_id").agg(F.avg("dosage").alias("base"))


def _first_sums(net: Network, geno: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    weights, bias = net.layer(0)
    x = geno.select("subject_id", F.col("variant_id").cast("long").alias("node"), F.col("dosage").cast("double").alias("value"))
    z = layer_forward(x, weights, bias).withColumnRenamed("value", "z")
    # The background is one more subject.
    b = base.select(F.lit(0).alias("subject_id"), F.col("variant_id").cast("long").alias("node"), F.col("base").alias("value"))
    return z, layer_forward(b, weights, bias).select("node", F.col("value").alias("z"))


def subject_attributions(net: Network, geno: DataFrame, base: DataFrame) -> DataFrame:
    """(subject_id, variant_id, value): integrated-gradient attribution of the score to every input.

    The attributions of a subject add up to its score minus the background's.
    """
    z, b = _first_sums(net, geno, base)
    d = _path_slopes(net, z, b, ["subject_id"])
    weights, _ = net.layer(0)
    per_input = F.sum((F.col("dosage") - F.col("base")) * F.col("w") * F.col("d"))
    return (
        geno.join(base, "variant_id").join(weights.select(F.col("src").alias("variant_id"), F.col("dst").alias("node"), "w"), "variant_id")
        .join(d, ["subject_id", "node"])
        .groupBy("subject_id", "variant_id").agg(per_input.alias("value"))
    )


def attributions(net: Network, geno: DataFrame, cases: DataFrame, background: DataFrame) -> DataFrame:
    """Largest absolute attribution of every variant over the cases."""
    base = materialise(background_mean(geno, background))
    tested = geno.join(cases.select("subject_id"), "subject_id", "left_semi")
    return subject_attributions(net, tested, base).groupBy("variant_id").agg(F.max(F.abs("value")).alias("attribution"))


def _perturbed(net: Network, geno: DataFrame, base: DataFrame, variants: DataFrame, settings: tuple[int, ...]) -> DataFrame:
    """Attributions under settings: (target, setting, subject_id, variant_id, value).

    Setting variant i changes the first sums by (setting - x_i) w_i, so the genotypes are
    summed once for all settings.
    """
    z, b = _first_sums(net, geno, base)
    weights, _ = net.layer(0)
    w = weights.select(F.col("src").alias("variant_id"), F.col("dst").alias("node"), "w")
    chosen = F.explode(F.array(*[F.lit(s) for s in settings])).alias("setting")
    targets = geno.join(variants.select("variant_id"), "variant_id", "left_semi").select(
        F.col("variant_id").alias("target"), "subject_id", F.col("dosage").alias("own"), chosen
    )
    shift = targets.join(w.withColumnRenamed("variant_id", "target"), "target").select(
        "target", "setting", "subject_id", "node", ((F.col("setting") - F.col("own")) * F.col("w")).alias("shift")
    )
    keys = ["target", "setting", "subject_id"]
    moved = (
        targets.join(z, "subject_id").join(shift, [*keys, "node"], "left")
        .select(*keys, "node", (F.col("z") + F.coalesce("shift", F.lit(0.0))).alias("z"))
    )
    d = _path_slopes(net, moved, b, keys)
    x = F.when(F.col("variant_id") == F.col("target"), F.col("setting")).otherwise(F.col("dosage"))
    return (
        geno.join(base, "variant_id").join(w, "variant_id").join(d, ["subject_id", "node"])
        .groupBy(*keys, "variant_id").agg(F.sum((x - F.col("base")) * F.col("w") * F.col("d")).alias("value"))
    )


def dfim(net: Network, geno: DataFrame, cases: DataFrame, background: DataFrame, variants: DataFrame) -> DataFrame:
    """Effect of setting a variant to 0, 1, 2 on the attributions: (target, own, other, other_variant).

    Per pair of settings the mean absolute change over the subjects, then the largest pair:
    the variant's own change, the largest change of another variant, and which one.
    """
    base = materialise(background_mean(geno, background))
    tested = geno.join(cases.select("subject_id"), "subject_id", "left_semi")
    values = [F.max(F.when(F.col("setting") == s, F.col("value"))).alias(f"v{s}") for s in (0, 1, 2)]
    wide = _perturbed(net, tested, base, variants, (0, 1, 2)).groupBy("target", "subject_id", "variant_id").agg(*values)
    changes = [F.avg(F.abs(F.col(f"v{a}") - F.col(f"v{b}"))) for a, b in ((0, 1), (0, 2), (1, 2))]
    change = wide.groupBy("target", "variant_id").agg(F.greatest(*changes).alias("change"))
    own = F.col("variant_id") == F.col("target")
    other = F.max(F.when(~own, F.struct("change", (-F.col("variant_id")).alias("v")))).alias("_o")
    return change.groupBy("target").agg(F.max(F.when(own, F.col("change"))).alias("own"), other).select(
        "target", "own", F.col("_o.change").alias("other"), (-F.col("_o.v")).alias("other_variant")
    )


def path_interactions(
    net: Network, geno: DataFrame, cases: DataFrame, background: DataFrame, start: int, end: int
) -> DataFrame:
    """Interactions of the variants ranked [start, end) by attribution: (target, variant_id, interaction).

    The change of every other variant's attribution between settings 0 and 2 of the target,
    halved; the largest absolute value over the subjects.
    """
    ranked = attributions(net, geno, cases, background)
    chosen = rank_slice(ranked, "attribution", "variant_id", start, end)
    base = materialise(background_mean(geno, background))
    tested = geno.join(cases.select("subject_id"), "subject_id", "left_semi")
    signed = F.when(F.col("setting") == 2, F.col("value")).otherwise(-F.col("value"))
    return (
        _perturbed(net, tested, base, chosen, (0, 2))
        .groupBy("target", "subject_id", "variant_id").agg((F.sum(signed) / 2).alias("change"))
        .groupBy("target", "variant_id").agg(F.max(F.abs("change")).alias("interaction"))
    )
