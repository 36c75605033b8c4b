"""Scoring with a sparse layered network stored as relations.

Values travel as (subject_id, node, value). Weights are edges
(layer, src, dst, w) and biases (layer, node, b), optionally with a filter column.
A layer is one join on the source node and one grouped sum with map-side combining,
so neither a node with very many inputs nor a wide layer needs to fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.activations import activate

EPSILON = 1e-6
SCORE_NODE = 0


def as_nodes(geno: DataFrame) -> DataFrame:
    """Genotype cells as input values."""
    return geno.select("subject_id", F.col("variant_id").cast("long").alias("node"), F.col("dosage").cast("double").alias("value"))


def layer_forward(x: DataFrame, weights: DataFrame, bias: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """out[dst] = sum over src of x[src] * w, plus b; per filter if the weights have one.

    Without `subjects`, rows are the subjects and nodes with a listed input. With them, unlisted inputs are 0 and
    every subject has a row in every node.
    """
    if subjects is not None:
        rest = unlisted_forward(None, weights, bias)
        return filled(listed_forward(x, None, weights, rest), rest, subjects)
    keys = ["dst", "filter"] if "filter" in weights.columns else ["dst"]
    summed = (
        x.join(weights.select(F.col("src").alias("node"), *keys, "w"), "node")
        .groupBy("subject_id", *keys)
        .agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        .withColumnRenamed("dst", "node")
    )
    if bias is None:
        return summed
    on = ["node", *keys[1:]]
    return summed.join(bias.select(*on, "b"), on, "left").select(
        "subject_id", *on, (F.col("value") + F.coalesce("b", F.lit(0.0))).alias("value")
    )


def unlisted_forward(rest: DataFrame | None, weights: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """(node, value) of a subject without any listed input: one row a node, whatever the number of subjects.

    `rest` holds such a subject's values in the source nodes; nodes not in it are 0.
    """
    keys = ["node", "filter"] if "filter" in weights.columns else ["node"]
    edges = weights.withColumnsRenamed({"dst": "node"})
    if rest is None:
        values = edges.select(*keys).distinct().withColumn("value", F.lit(0.0))
    else:
        sources = rest.select(F.col("node").alias("src"), F.col("value").alias("_rest"))
        values = edges.join(sources, "src", "left").groupBy(*keys).agg(F.coalesce(F.sum(F.col("_rest") * F.col("w")), F.lit(0.0)).alias("value"))
    if bias is None:
        return values
    return values.join(bias.select(*keys, "b"), keys, "left").select(*keys, (F.col("value") + F.coalesce("b", F.lit(0.0))).alias("value"))


def listed_forward(x: DataFrame, rest: DataFrame | None, weights: DataFrame, rest_out: DataFrame) -> DataFrame:
    """Values of the subjects and nodes with a listed input: `rest_out` plus what the listed inputs differ from `rest`."""
    keys = ["node", "filter"] if "filter" in weights.columns else ["node"]
    # The value that a source has unlisted goes with its edges, so cells meet weights in one join.
    edges = weights.withColumnsRenamed({"dst": "node"}).select("src", *keys, "w")
    if rest is None:
        edges = edges.withColumn("_rest", F.lit(0.0))
    else:
        edges = edges.join(rest.select(F.col("node").alias("src"), F.col("value").alias("_rest")), "src", "left").fillna(0.0, ["_rest"])
    moved = (
        x.select("subject_id", F.col("node").alias("src"), F.col("value").alias("_x")).join(edges, "src")
        .groupBy("subject_id", *keys).agg(F.coalesce(F.sum((F.col("_x") - F.col("_rest")) * F.col("w")), F.lit(0.0)).alias("_moved"))
    )
    return moved.join(rest_out, keys).select("subject_id", *keys, (F.col("value") + F.col("_moved")).alias("value"))


def filled(listed: DataFrame, rest: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every subject's value in every node: the listed one, else `rest`. The rows are as many as the answer's."""
    keys = [c for c in rest.columns if c != "value"]
    grid = subjects.select("subject_id").distinct().join(rest.withColumnRenamed("value", "_rest"))
    return grid.join(listed, ["subject_id", *keys], "left").select("subject_id", *keys, F.coalesce("value", "_rest").alias("value"))


def node_layer(x: DataFrame, weights: DataFrame) -> DataFrame:
    """Per-node weights over filters: value[node] = sum over filter of x[node, filter] * w[node, filter]."""
    return (
        x.join(weights.select("node", "filter", "w"), ["node", "filter"])
        .groupBy("subject_id", "node")
        .agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    )


def apply_activation(x: DataFrame, kind: str) -> DataFrame:
    return x.withColumn("value", activate(F.col("value"), kind))


def node_moments(x: DataFrame) -> DataFrame:
    """Mean and population variance of every node over the subjects."""
    return x.groupBy("node").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def normalise(x: DataFrame, moments: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(value - mean) / sqrt(variance + epsilon) per node."""
    scaled = (F.col("value") - F.col("mean")) / F.sqrt(F.col("variance") + epsilon)
    return x.join(moments, "node").withColumn("value", scaled).drop("mean", "variance")


def update_moments(running: DataFrame, current: DataFrame, momentum: float = 0.99) -> DataFrame:
    """Exponentially weighted moments; a node seen for the first time starts at mean 0, variance 1."""
    now = current.select("node", F.col("mean").alias("_m"), F.col("variance").alias("_v"))
    return now.join(running, "node", "left").select(
        "node",
        (F.coalesce("mean", F.lit(0.0)) * momentum + F.col("_m") * (1 - momentum)).alias("mean"),
        (F.coalesce("variance", F.lit(1.0)) * momentum + F.col("_v") * (1 - momentum)).alias("variance"),
    )


def normalise_connected(x: DataFrame, edges: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Normalise every input by the moments of the nodes it feeds.

    A node's moments run over all values of its connected inputs; an input is shifted by
    the sum of the means and scaled by the sum of the variances of its nodes.
    """
    per_input = x.groupBy("node").agg(
        F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    )
    mean = F.sum("s") / F.sum("n")
    per_node = (
        per_input.join(edges.select(F.col("src").alias("node"), "dst"), "node")
        .groupBy("dst")
        .agg(mean.alias("mean"), (F.sum("ss") / F.sum("n") - mean * mean).alias("variance"))
    )
    per_source = (
        edges.select("src", "dst").join(per_node, "dst").groupBy(F.col("src").alias("node"))
        .agg(F.sum("mean").alias("mean"), F.sum("variance").alias("variance"))
    )
    return normalise(x, per_source, epsilon)


def dense_output(x: DataFrame, weights: DataFrame, b: float = 0.0) -> DataFrame:
    """One score per subject from all nodes (node, w)."""
    return (
        x.join(weights.select("node", "w"), "node")
        .groupBy("subject_id")
        .agg((F.sum(F.col("value") * F.col("w")) + F.lit(b)).alias("score"))
    )


def covariate_head(
    scores: DataFrame, covs: DataFrame, weights: dict[str, float], b: float, kind: str, moments: dict | None = None
) -> DataFrame:
    """Activate the score, append covariates, optionally normalise, weigh, activate again.

    `weights` and `moments` are keyed by 'score' and the covariate column names.
    """
    joined = scores.join(covs, "subject_id").withColumn("score", activate(F.col("score"), kind))
    total = F.lit(b)
    for name, w in weights.items():
        value = F.col(name).cast("double")
        if moments:
            mean, variance = moments[name]
            value = (value - F.lit(mean)) / F.sqrt(F.lit(variance) + EPSILON)
        total = total + value * F.lit(w)
    return joined.select("subject_id", activate(total, kind).alias("score"))


def one_hot_layer(geno: DataFrame, weights: DataFrame) -> DataFrame:
    """One weight per variant and genotype class: (variant_id, dosage, w) picks the input value."""
    return geno.join(weights, ["variant_id", "dosage"]).select(
        "subject_id", F.col("variant_id").cast("long").alias("node"), F.col("w").alias("value")
    )


def linear_one_hot(weights: DataFrame) -> DataFrame:
    """Class weights w, w+1, w+2 for dosages 0, 1, 2 from one weight per variant."""
    return weights.select("variant_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("dosage"), "w").withColumn(
        "w", F.col("w") + F.col("dosage")
    )


def l1_penalty(weights: DataFrame, l1: float) -> DataFrame:
    return weights.agg((F.sum(F.abs("w")) * F.lit(l1)).alias("penalty"))


@dataclass
class Network:
    """A weighted topology: edges (layer, src, dst, w), bias (layer, node, b), one activation per layer.

    The last layer ends in node 0. Where `covariates` are named, they enter the last
    layer as the nodes 1, 2, … next to the score. `moments` (layer, node, mean,
    variance) normalise the output of a layer if given.
    """

    edges: DataFrame
    bias: DataFrame
    kinds: list[str]
    covariates: list[str] = field(default_factory=list)
    moments: DataFrame | None = None

    @property
    def depth(self) -> int:
        return len(self.kinds)

    def layer(self, i: int) -> tuple[DataFrame, DataFrame]:
        return (
            self.edges.filter(F.col("layer") == i).select("src", "dst", "w"),
            self.bias.filter(F.col("layer") == i).select("node", "b"),
        )


def covariate_nodes(subjects: DataFrame, names: list[str]) -> DataFrame:
    """Covariates as extra inputs of the last layer, numbered from 1."""
    cells = [F.struct(F.lit(i).cast("long").alias("node"), F.col(c).cast("double").alias("value")) for i, c in enumerate(names, 1)]
    return subjects.select("subject_id", F.explode(F.array(*cells)).alias("c")).select("subject_id", "c.*")


def next_input(net: Network, i: int, values: DataFrame, subjects: DataFrame | None) -> DataFrame:
    """Outputs of layer i as inputs of layer i + 1: normalised if asked, joined by covariates."""
    if net.covariates and i == net.depth - 2:
        values = values.unionByName(covariate_nodes(subjects, net.covariates))
    if net.moments is not None and i < net.depth - 1:
        moments = net.moments.filter(F.col("layer") == i).select("node", "mean", "variance")
        values = normalise(values, moments)
    return values


def predict(net: Network, x: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Scores (subject_id, p) of input values (subject_id, node, value); unlisted inputs are 0.

    Every subject of `subjects`, or else of `x`, has a score. Nodes that no listed input reaches hold one value
    for all subjects, which goes through the layers once; only what differs from it is a row of a subject.
    """
    values, rest = x, None
    everyone = subjects if subjects is not None else x
    for i, kind in enumerate(net.kinds):
        weights, bias = net.layer(i)
        rest_out = unlisted_forward(rest, weights, bias)
        values = apply_activation(listed_forward(values, rest, weights, rest_out), kind)
        rest = apply_activation(rest_out, kind)
        if i < net.depth - 1:
            values = next_input(net, i, values, subjects)
            if net.moments is not None:
                rest = normalise(_with_covariates(rest, net, i), net.moments.filter(F.col("layer") == i).select("node", "mean", "variance"))
    score = F.col("node") == SCORE_NODE
    return filled(values.filter(score), rest.filter(score), everyone).select("subject_id", F.col("value").alias("p"))


def _with_covariates(rest: DataFrame, net: Network, i: int) -> DataFrame:
    """The covariates as nodes at 0, where the next layer reads them."""
    if not net.covariates or i != net.depth - 2:
        return rest
    nodes = [F.lit(c).cast("long") for c in range(1, len(net.covariates) + 1)]
    zeros = rest.sparkSession.range(1).select(F.explode(F.array(*nodes)).alias("node"), F.lit(0.0).alias("value"))
    return rest.select("node", "value").unionByName(zeros)


def activation_importance(acts: DataFrame, weights: DataFrame) -> DataFrame:
    """|w| times the deviation of the node's activation, scaled to a maximum of 1."""
    spread = acts.groupBy("node").agg(F.stddev_pop("value").alias("std"))
    scored = weights.join(spread, "node").select("node", F.abs(F.col("w") * F.col("std")).alias("importance"))
    top = scored.agg(F.max("importance")).first()[0]
    return scored.withColumn("relative", F.try_divide("importance", F.lit(top)))
