"""Training a network on a topology, data-parallel over subjects.

Weights, optimiser state and gradients are relations keyed by (layer, src, dst); a
step is one Spark job that writes the next parameter table. Only losses reach the
driver. Genotype cells are laid out by subject once, so the forward sums and the
gradients of every step start without moving them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.activations import activate, hidden_kind, output_kind, slope
from locusframe.operators.cohort import assign_batches
from locusframe.operators.metrics import BCE_CLIP, bce_term
from locusframe.operators.network import (
    EPSILON,
    Network,
    as_nodes,
    covariate_nodes,
    layer_forward,
    node_moments,
    normalise,
    predict,
)
from locusframe.operators.ordering import seeded_order
from locusframe.session import materialise

BIAS = -1
KEYS = ["layer", "src", "dst"]


@dataclass
class Params:
    """Settings of a training run; the defaults are fixed values."""

    learning_rate: float = 0.001
    epochs: int = 1000
    patience: int = 50
    min_delta: float = 1e-4
    plateau: int = 5
    plateau_factor: float = 0.2
    l1: float = 0.01
    l1_activity: float = 0.01
    positive_weight: float = 1.0
    batch_size: int | None = None
    epoch_size: int | None = None
    regression: bool = False
    normalise: bool = True
    seed: int = 0


@dataclass
class Fit:
    network: Network
    parameters: DataFrame
    history: list[dict] = field(default_factory=list)
    best_epoch: int = -1
    state: dict = field(default_factory=dict)


def with_output(edges: DataFrame, covariates: int = 0) -> tuple[DataFrame, int]:
    """Add the dense layer into node 0 and, with covariates, the layer that mixes them in; returns the depth."""
    last = edges.agg(F.max("layer")).first()[0]
    dense = edges.filter(F.col("layer") == last).select(
        F.lit(last + 1).alias("layer"), F.col("dst").alias("src"), F.lit(0).cast("long").alias("dst")
    ).distinct()
    parts, depth = [edges.select(*KEYS), dense], last + 2
    if covariates:
        nodes = edges.sparkSession.range(covariates + 1)
        parts.append(nodes.select(F.lit(last + 2).alias("layer"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))
        depth += 1
    return reduce(DataFrame.unionByName, parts), depth


def initial_parameters(edges: DataFrame, seed: int, output_bias: float = 0.0) -> DataFrame:
    """Edge weights uniform within ±sqrt(6 / (fan-in + 1)) by a seeded hash, biases 0, optimiser state 0."""
    fan = edges.groupBy("layer", "dst").agg(F.count(F.lit(1)).alias("fan"))
    key = F.col("src") * 1009 + F.col("dst") * 31 + F.col("layer")
    unit = seeded_order(key, seed + 1) / F.lit(4294967296.0) * 2 - 1
    weights = edges.join(fan, ["layer", "dst"]).select(*KEYS, (unit * F.sqrt(F.lit(6.0) / (F.col("fan") + 1))).alias("w"))
    top = edges.agg(F.max("layer")).first()[0]
    start = F.when(F.col("layer") == top, F.lit(output_bias)).otherwise(F.lit(0.0))
    bias = fan.select("layer", F.lit(BIAS).cast("long").alias("src"), "dst", start.alias("w"))
    return weights.unionByName(bias).select(*KEYS, "w", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))


def as_network(parameters: DataFrame, kinds: list[str], covariates: list[str], moments: DataFrame | None = None) -> Network:
    edges = parameters.filter(F.col("src") != BIAS).select(*KEYS, "w")
    bias = parameters.filter(F.col("src") == BIAS).select("layer", F.col("dst").alias("node"), F.col("w").alias("b"))
    return Network(edges, bias, kinds, covariates, moments)


def _loss_slope(p: Column, y: Column, params: Params) -> Column:
    """Derivative of the row loss by the score."""
    if params.regression:
        return 2 * (p - y)

    def clip(c: Column) -> Column:
        return F.least(F.greatest(c.cast("double"), F.lit(BCE_CLIP)), F.lit(1.0))

    y, q = clip(y), clip(p)
    inside = ((p > BCE_CLIP) & (p < 1)).cast("double")
    return inside * (-y / (q + BCE_CLIP) * params.positive_weight + (1 - y) / (1 - q + BCE_CLIP))


def row_loss(p: Column, y: Column, params: Params) -> Column:
    if params.regression:
        return (p - y) * (p - y)
    return bce_term(y, p, params.positive_weight)


def _moments(values: DataFrame) -> DataFrame:
    """(node, mean, scale) over the subjects of a batch."""
    return values.groupBy("node").agg(
        F.avg("value").alias("mean"), F.sqrt(F.var_pop("value") + EPSILON).alias("scale")
    )


def _scaled(values: DataFrame, moments: DataFrame) -> DataFrame:
    shifted = (F.col("value") - F.col("mean")) / F.col("scale")
    return values.join(moments, "node").select("subject_id", "node", shifted.alias("value"), "scale")


def _forward(net: Network, x: DataFrame, subjects: DataFrame, params: Params) -> tuple[list[DataFrame], list[DataFrame]]:
    """(inputs, sums z) of every layer; each layer's sums are one written table, so plans stay flat."""
    inputs, sums = [x], []
    for i, kind in enumerate(net.kinds):
        z = materialise(layer_forward(inputs[i], *net.layer(i)).withColumnRenamed("value", "z"))
        sums.append(z)
        if i == net.depth - 1:
            break
        a = z.select("subject_id", "node", activate(F.col("z"), kind).alias("value"))
        if net.covariates and i == net.depth - 2:
            a = a.unionByName(covariate_nodes(subjects, net.covariates))
        inputs.append(_scaled(a, materialise(_moments(a))) if params.normalise else a)
    return inputs, sums


def _gradients(net: Network, x: DataFrame, subjects: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(gradients (layer, src, dst, g), mean loss) over `subjects`."""
    n = subjects.count()
    inputs, sums = _forward(net, x, subjects, params)
    p = activate(F.col("z"), net.kinds[-1])
    scored = sums[-1].join(subjects.select("subject_id", "label"), "subject_id")
    loss = scored.agg(F.avg(row_loss(p, F.col("label"), params)).alias("loss"))
    penalty = params.l1_activity / n
    last = _loss_slope(p, F.col("label"), params) / n * slope(F.col("z"), net.kinds[-1])
    delta = materialise(scored.select("subject_id", "node", (last + F.signum("z") * penalty).alias("d")))
    grads = []
    for i in range(net.depth - 1, -1, -1):
        weights, _ = net.layer(i)
        edges = weights.select(F.col("src").alias("node"), "dst", "w")
        out = delta.select("subject_id", F.col("node").alias("dst"), "d")
        cells = inputs[i].join(edges, "node").join(out, ["subject_id", "dst"])
        per_edge = cells.groupBy("node", "dst").agg(F.sum(F.col("value") * F.col("d")).alias("g"))
        grads.append(per_edge.select(F.lit(i).alias("layer"), F.col("node").alias("src"), "dst", "g"))
        per_node = out.groupBy("dst").agg(F.sum("d").alias("g"))
        grads.append(per_node.select(F.lit(i).alias("layer"), F.lit(BIAS).cast("long").alias("src"), "dst", "g"))
        if i == 0:
            break
        back = out.join(edges, "dst").groupBy("subject_id", "node").agg(F.sum(F.col("d") * F.col("w")).alias("d"))
        if params.normalise:
            back = _through_normalisation(materialise(back), inputs[i], n)
        kind = net.kinds[i - 1]
        # Covariate nodes have no sum below them and drop out here.
        below = F.col("d") * slope(F.col("z"), kind) + F.signum("z") * penalty
        delta = materialise(back.join(sums[i - 1], ["subject_id", "node"]).select("subject_id", "node", below.alias("d")))
    return reduce(DataFrame.unionByName, grads), loss


def _through_normalisation(back: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """Gradient before normalisation: (d - mean d - x mean(d x)) / scale per node."""
    joined = back.join(x, ["subject_id", "node"])
    means = joined.groupBy("node").agg(
        (F.sum("d") / n).alias("_d"), (F.sum(F.col("d") * F.col("value")) / n).alias("_dx")
    )
    inner = (F.col("d") - F.col("_d") - F.col("value") * F.col("_dx")) / F.col("scale")
    return joined.join(means, "node").select("subject_id", "node", inner.alias("d"))


def _adam(parameters: DataFrame, grads: DataFrame, step: int, rate: float, params: Params, first_dense: int = 0) -> DataFrame:
    """Adam update (decay 0.9 and 0.999) with the L1 slope on the edge weights of dense layers."""
    b1, b2, eps = 0.9, 0.999, 1e-7
    l1 = F.when((F.col("src") != BIAS) & (F.col("layer") >= first_dense), F.signum("w") * F.lit(params.l1)).otherwise(F.lit(0.0))
    g = F.coalesce("g", F.lit(0.0)) + l1
    moved = parameters.join(grads, KEYS, "left").select(
        *KEYS, "w", (F.col("m") * b1 + g * (1 - b1)).alias("m"), (F.col("v") * b2 + g * g * (1 - b2)).alias("v")
    )
    size = rate * (1 - b2**step) ** 0.5 / (1 - b1**step)
    return moved.select(*KEYS, (F.col("w") - F.lit(size) * F.col("m") / (F.sqrt("v") + eps)).alias("w"), "m", "v")


def training_moments(net: Network, x: DataFrame, subjects: DataFrame) -> DataFrame:
    """Moments (layer, node, mean, variance) of every layer's outputs over the training subjects."""
    values, found = x, []
    for i, kind in enumerate(net.kinds[:-1]):
        out = layer_forward(values, *net.layer(i)).withColumn("value", activate(F.col("value"), kind))
        if net.covariates and i == net.depth - 2:
            out = out.unionByName(covariate_nodes(subjects, net.covariates))
        out = materialise(out)
        moments = materialise(node_moments(out))
        found.append(moments.withColumn("layer", F.lit(i)))
        values = normalise(out, moments)
    return reduce(DataFrame.unionByName, found)


def fit_topology_net(
    geno: DataFrame,
    train: DataFrame,
    validation: DataFrame,
    edges: DataFrame,
    params: Params | None = None,
    covariates: list[str] | None = None,
    add_output: bool = True,
    resume: Fit | None = None,
) -> Fit:
    """Fit edge weights by Adam with early stopping on the validation loss; the best weights are kept.

    `train` and `validation` hold subject_id, label and the covariates. `geno` lists
    every cell of their subjects. Without a batch size, an epoch is one full pass.
    """
    params, covs = params or Params(), list(covariates or [])
    if add_output:
        edges, depth = with_output(edges, len(covs))
        first_dense = depth - 1 - bool(covs)  # layers of the topology carry no weight penalty
    else:
        first_dense = 0
        depth = edges.agg(F.max("layer")).first()[0] + 1
    edges = materialise(edges)
    facts = train.agg(F.avg("label"), F.min("label"), F.count(F.lit(1))).first()
    out = output_kind(params.regression, facts[1] < 0)
    kinds = [hidden_kind(params.regression)] * (depth - 1) + [out]
    if covs:
        kinds[-2] = out
    bias = float(facts[0]) if params.regression else 0.0
    parameters = resume.parameters if resume else materialise(initial_parameters(edges, params.seed, bias))
    # Cells by subject: the layer sums of a step need no exchange of the genotypes.
    x = as_nodes(geno).repartition("subject_id").persist()
    train, validation = materialise(train), materialise(validation)
    x_validation = x.join(validation.select("subject_id"), "subject_id", "left_semi")
    x_train = x.join(train.select("subject_id"), "subject_id", "left_semi")

    rate, best, since_best, since_drop, step = params.learning_rate, float("inf"), 0, 0, 0
    fit = resume or Fit(as_network(parameters, kinds, covs), parameters)
    first = len(fit.history)
    for epoch in range(first, first + params.epochs):
        losses = []
        for batch_subjects, cells in _batches(train, x_train, epoch, params, facts[2]):
            step += 1
            grads, loss = _gradients(as_network(parameters, kinds, covs), cells, batch_subjects, params)
            parameters = materialise(_adam(parameters, grads, step, rate, params, first_dense))
            losses.append(loss.first()[0])
        net = as_network(parameters, kinds, covs)
        if params.normalise and depth > 1:
            net.moments = training_moments(net, x_train, train)
        scores = predict(net, x_validation, validation).join(validation, "subject_id")
        val_loss = scores.agg(F.avg(row_loss(F.col("p"), F.col("label"), params))).first()[0]
        fit.history.append({"epoch": epoch, "loss": sum(losses) / len(losses), "val_loss": val_loss, "rate": rate})
        if val_loss < best - params.min_delta:
            best, since_best, since_drop = val_loss, 0, 0
            fit.network, fit.parameters, fit.best_epoch = net, parameters, epoch
        else:
            since_best, since_drop = since_best + 1, since_drop + 1
            if since_drop >= params.plateau:
                rate, since_drop = rate * params.plateau_factor, 0
            if since_best >= params.patience:
                break
    x.unpersist()
    return fit


def _batches(train: DataFrame, x: DataFrame, epoch: int, params: Params, n: int):
    """Subjects and cells of every batch of an epoch.

    The cells are written by batch once per epoch, so a step reads its own batch only.
    """
    if params.batch_size is None or params.batch_size >= n:
        yield train, x
        return
    planned = materialise(
        assign_batches(train, params.batch_size, params.epoch_size, epoch, params.seed, n_rows=n)
    )
    cells = materialise(x.join(planned.select("subject_id", "batch"), "subject_id"), "batch")
    for b in range(planned.agg(F.max("batch")).first()[0] + 1):
        here = F.col("batch") == b
        yield planned.filter(here).drop("batch"), cells.filter(here).drop("batch")


def dense_edges(variants: DataFrame) -> DataFrame:
    """Every variant straight into the score: the layer of the linear baselines."""
    return variants.select(
        F.lit(0).alias("layer"), F.col("variant_id").cast("long").alias("src"), F.lit(0).cast("long").alias("dst")
    ).distinct()


def fit_lasso(geno: DataFrame, train: DataFrame, validation: DataFrame, params: Params | None = None) -> Fit:
    """L1-penalised logistic or linear model on all variants: a network of one dense layer."""
    return fit_topology_net(geno, train, validation, dense_edges(geno), params, add_output=False)


def fit_gene_l1(geno: DataFrame, train: DataFrame, validation: DataFrame, edges: DataFrame, params: Params | None = None) -> Fit:
    """One gene layer with L1 on its weights, then the score."""
    return fit_topology_net(geno, train, validation, edges.filter("layer = 0"), params)


def fit_logistic(geno: DataFrame, train: DataFrame, validation: DataFrame, params: Params | None = None) -> DataFrame:
    """Unpenalised logistic comparator: (variant_id, coefficient) by falling size."""
    params = params or Params(epochs=100)
    params = Params(**{**params.__dict__, "l1": 0.0, "l1_activity": 0.0, "regression": False})
    fit = fit_lasso(geno, train, validation, params)
    ranked = fit.network.edges.select(F.col("src").alias("variant_id"), F.col("w").alias("coefficient"))
    return ranked.orderBy(F.desc(F.abs("coefficient")), "variant_id")
