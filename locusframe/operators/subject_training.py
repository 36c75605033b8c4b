"""Training a network on a topology with subjects kept in place.

Each subject's inputs are one row of a written table. A pass is one Spark job: tasks read their
subjects, run the layers on blocks of them as array arithmetic, and return sums over their subjects,
which are added up chunk by chunk. A step is one pass without normalisation, and else one for the
moments of every hidden layer, one for the means its gradient needs, and one for the gradient; no
genotype is moved, and nothing is written per step. Weights and the optimiser's state are arrays of
at most EDGES entries that travel to the tasks; `training.fit_topology_net` holds larger networks
as tables.

Unlisted cells are 0: every subject has a value in every node, its bias if nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.activations import hidden_kind, output_kind
from locusframe.operators.cohort import assign_batches
from locusframe.operators.metrics import BCE_CLIP
from locusframe.operators.network import EPSILON
from locusframe.operators.training import BIAS, Fit, Params, as_network, fit_topology_net, initial_parameters, with_output
from locusframe.session import materialise

#: Parameters (24 bytes each with the optimiser's state) that the driver keeps and tasks receive.
EDGES = 20_000_000
#: Cells (subjects x edges) that a task works on at once.
CELLS = 4_000_000
#: Sums that travel in one row.
CHUNK = 1 << 20


@dataclass
class Layer:
    """Edges of a layer by (node, input); inputs are numbered, the last number stands for an input that never has a value."""

    src: np.ndarray
    dst: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    kind: str
    by_src: np.ndarray
    src_starts: np.ndarray
    sources: np.ndarray
    w: np.ndarray
    b: np.ndarray


@dataclass
class Model:
    layers: list[Layer]
    inputs: np.ndarray
    covariates: int = 0
    normalise: bool = False
    moments: list = field(default_factory=list)  # (mean, scale) of the inputs of layer 1, 2, …
    means: dict = field(default_factory=dict)  # layer -> means its normalisation's gradient needs

    @property
    def depth(self) -> int:
        return len(self.layers)


def _act(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "tanh":
        return np.tanh(z)
    if kind == "relu":
        return np.maximum(z, 0)
    if kind == "sigmoid":
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-z))
    return z


def _slope(z: np.ndarray, kind: str) -> np.ndarray:
    if kind == "tanh":
        return 1 - np.tanh(z) ** 2
    if kind == "relu":
        return (z > 0).astype(float)
    if kind == "sigmoid":
        p = _act(z, kind)
        return p * (1 - p)
    return np.ones_like(z)


def _loss(p: np.ndarray, y: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row, and its derivative by the score."""
    if params.regression:
        return (p - y) ** 2, 2 * (p - y)
    y, q = np.clip(y, BCE_CLIP, 1), np.clip(p, BCE_CLIP, 1)
    inside = (p > BCE_CLIP) & (p < 1)
    loss = -y * np.log(q + BCE_CLIP) * params.positive_weight - (1 - y) * np.log(1 - q + BCE_CLIP)
    return loss, inside * (-y / (q + BCE_CLIP) * params.positive_weight + (1 - y) / (1 - q + BCE_CLIP))


def _sums(cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(cells, starts, axis=1)


def forward(model: Model, x: np.ndarray, covariates: np.ndarray, layers: int) -> tuple[list, list]:
    """Inputs and sums of the first `layers` layers, one row a subject; and the next layer's inputs before normalisation."""
    inputs, sums = [x], []
    for i, layer in enumerate(model.layers[:layers]):
        wide = np.hstack([inputs[i], np.zeros((len(x), 1))])
        z = _sums(wide[:, layer.src] * layer.w, layer.starts) + layer.b
        sums.append(z)
        if i == model.depth - 1:
            break
        a = _act(z, layer.kind)
        if model.covariates and i == model.depth - 2:
            a = np.hstack([a, covariates])
        if model.normalise and i < len(model.moments):
            mean, scale = model.moments[i]
            a = (a - mean) / scale
        inputs.append(a)
    return inputs, sums


def backward(model: Model, inputs: list, sums: list, y: np.ndarray, n: int, params: Params, down_to: int = 0):
    """Gradient sums of all parameters, and the loss; with `down_to`, the sums that normalising that layer's inputs needs."""
    p = _act(sums[-1][:, 0], model.layers[-1].kind)
    loss, slope = _loss(p, y, params)
    penalty = params.l1_activity / n
    d = (slope / n)[:, None] * _slope(sums[-1], model.layers[-1].kind) + np.sign(sums[-1]) * penalty
    gradients = []
    for i in range(model.depth - 1, -1, -1):
        layer = model.layers[i]
        cells = d[:, layer.dst]
        if not down_to:
            wide = np.hstack([inputs[i], np.zeros((len(y), 1))])
            gradients.append(np.concatenate([np.einsum("be,be->e", wide[:, layer.src], cells), d.sum(0)]))
        if i == 0:
            break
        back = np.zeros((len(y), inputs[i].shape[1] + 1))
        back[:, layer.sources] = _sums((cells * layer.w)[:, layer.by_src], layer.src_starts)
        back = back[:, :-1]
        if model.normalise:
            if i == down_to:
                return np.concatenate([back.sum(0), (back * inputs[i]).sum(0)])
            mean, product = model.means[i]
            back = (back - mean - inputs[i] * product) / model.moments[i - 1][1]
        z = sums[i - 1]
        d = back[:, : z.shape[1]] * _slope(z, model.layers[i - 1].kind) + np.sign(z) * penalty
    return np.concatenate([*gradients[::-1], [loss.sum()]])


def _blocks(model: Model, batches):
    """Subjects, inputs, covariates and labels of a few subjects at a time."""
    widest = max(len(model.inputs), *(len(layer.src) for layer in model.layers))
    rows = max(1, CELLS // widest)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            lengths = part["node"].value_lengths().to_numpy(zero_copy_only=False)
            nodes = part["node"].flatten().to_numpy()
            at = np.searchsorted(model.inputs, nodes)
            known = (at < len(model.inputs)) & (model.inputs[np.minimum(at, len(model.inputs) - 1)] == nodes)
            x = np.zeros((part.num_rows, len(model.inputs)))
            np.add.at(x, (np.repeat(np.arange(part.num_rows), lengths)[known], at[known]), part["value"].flatten().to_numpy(zero_copy_only=False)[known])
            covariates = part["covariates"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield part["subject_id"], x, covariates, part["label"].to_numpy(zero_copy_only=False)


_SUMS = "chunk long, values binary"


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, np.float64) for v in rows["values"].to_pylist())
    return pa.table({"chunk": [key[0].as_py()], "values": pa.array([total.tobytes()], pa.binary())})


def _total(rows: DataFrame, model: Model, sums) -> np.ndarray:
    """`sums(model, x, covariates, y)` added up over the subjects of `rows`: one Spark job."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = None
        for _, x, covariates, y in _blocks(shared.value, batches):
            found = sums(shared.value, x, covariates, y)
            total = found if total is None else total + found
        if total is not None:
            starts = range(0, len(total), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int64()), pa.array([total[s : s + CHUNK].tobytes() for s in starts], pa.binary())], names=["chunk", "values"])

    found = rows.mapInArrow(run, _SUMS).groupBy("chunk").applyInArrow(_added, _SUMS).toArrow().sort_by("chunk")
    shared.destroy()
    return np.concatenate([np.frombuffer(v, np.float64) for v in found["values"].to_pylist()])


def _moments(rows: DataFrame, model: Model, n: int) -> list:
    """(mean, scale) of every hidden layer's outputs over `rows`, from the first on."""
    model.moments = []
    for i in range(model.depth - 1):

        def sums(m, x, covariates, y, i=i):
            a = forward(m, x, covariates, i + 1)[0][-1]
            return np.concatenate([a.sum(0), (a * a).sum(0)])

        first, second = np.split(_total(rows, model, sums) / n, 2)
        model.moments.append((first, np.sqrt(np.maximum(second - first**2, 0) + EPSILON)))
    return model.moments


def gradient(rows: DataFrame, model: Model, n: int, params: Params) -> tuple[np.ndarray, float]:
    """Gradient of all parameters, layer by layer weights then biases, and the mean loss over `rows`.

    The moments of `model` must be those of `rows`.
    """
    model.means = {}
    if model.normalise:
        for i in range(model.depth - 1, 0, -1):

            def sums(m, x, covariates, y, i=i):
                return backward(m, *forward(m, x, covariates, m.depth), y, n, params, i)

            model.means[i] = tuple(np.split(_total(rows, model, sums) / n, 2))
    found = _total(rows, model, lambda m, x, covariates, y: backward(m, *forward(m, x, covariates, m.depth), y, n, params))
    return found[:-1], found[-1] / n


def mean_loss(rows: DataFrame, model: Model, params: Params) -> float:
    def sums(m, x, covariates, y):
        p = _act(forward(m, x, covariates, m.depth)[1][-1][:, 0], m.layers[-1].kind)
        return np.array([_loss(p, y, params)[0].sum(), len(y)])

    loss, n = _total(rows, model, sums)
    return loss / n


def subject_rows(geno: DataFrame, subjects: DataFrame, covariates: list[str]) -> DataFrame:
    """One written row a subject: subject_id, label, covariates, and its listed inputs."""
    inputs = geno.select("subject_id", F.struct(F.col("variant_id").cast("long").alias("node"), F.col("dosage").cast("double").alias("value")).alias("c"))
    kept = inputs.where("c.value IS NOT NULL").join(subjects.select("subject_id"), "subject_id", "left_semi").groupBy("subject_id").agg(F.collect_list("c").alias("c"))
    values = [F.col(c).cast("double") for c in covariates]
    listed = F.array(*values) if values else F.array().cast("array<double>")
    rows = subjects.select("subject_id", F.col("label").cast("double").alias("label"), listed.alias("covariates")).join(kept, "subject_id", "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return materialise(rows.select(
        "subject_id", "label", "covariates", F.coalesce("c.node", empty("bigint")).alias("node"), F.coalesce("c.value", empty("double")).alias("value"),
    ))


def build(parameters: DataFrame, kinds: list[str], covariates: int, normalise: bool) -> tuple[Model, list[np.ndarray]]:
    """The network as arrays, and its parameters (w, m, v), each layer by layer: weights, then biases."""
    table = parameters.toArrow().to_pandas().sort_values(["layer", "dst", "src"])
    layers, flat, inputs = [], [], None
    for i, kind in enumerate(kinds):
        own = table[table["layer"] == i]
        edges, bias = own[own["src"] != BIAS], own[own["src"] == BIAS]
        nodes, starts = np.unique(edges["dst"].to_numpy(), return_index=True)
        bias = bias.set_index("dst").reindex(nodes).fillna(0.0)
        if i == 0:
            known = inputs = np.unique(edges["src"].to_numpy())
        else:
            known = layers[-1].nodes
            if covariates and i == len(kinds) - 1:
                known = np.concatenate([known, np.arange(1, covariates + 1)])
        order = np.argsort(known, kind="stable")
        at = np.minimum(np.searchsorted(known[order], edges["src"].to_numpy()), len(known) - 1)
        src = np.where(known[order][at] == edges["src"].to_numpy(), order[at], len(known))
        by_src = np.argsort(src, kind="stable")
        sources, src_starts = np.unique(src[by_src], return_index=True)
        dst = np.searchsorted(nodes, edges["dst"].to_numpy())
        layers.append(Layer(src, dst, starts, nodes, kind, by_src, src_starts, sources, np.zeros(len(src)), np.zeros(len(nodes))))
        flat.append([np.concatenate([edges[c].to_numpy(), bias[c].to_numpy()]) for c in ("w", "m", "v")])
    return Model(layers, inputs, covariates, normalise), [np.concatenate([f[c] for f in flat]) for c in range(3)]


def assign(model: Model, w: np.ndarray) -> None:
    at = 0
    for layer in model.layers:
        layer.w = w[at : at + len(layer.src)]
        layer.b = w[at + len(layer.src) : at + len(layer.src) + len(layer.nodes)]
        at += len(layer.src) + len(layer.nodes)


def _penalised(model: Model, first_dense: int) -> np.ndarray:
    """Which parameters carry the L1 penalty: weights of dense layers."""
    return np.concatenate([np.repeat([i >= first_dense, False], [len(x.src), len(x.nodes)]) for i, x in enumerate(model.layers)])


def _table(model: Model, state: list[np.ndarray], spark) -> DataFrame:
    """Parameters (layer, src, dst, w, m, v) as a written table."""
    known, columns = model.inputs, {c: [] for c in ("layer", "src", "dst")}
    for i, layer in enumerate(model.layers):
        if i:
            known = model.layers[i - 1].nodes
            if model.covariates and i == model.depth - 1:
                known = np.concatenate([known, np.arange(1, model.covariates + 1)])
        columns["layer"].append(np.full(len(layer.src) + len(layer.nodes), i, np.int32))
        columns["src"].append(np.concatenate([np.append(known, BIAS - 1)[layer.src], np.full(len(layer.nodes), BIAS)]))
        columns["dst"].append(np.concatenate([layer.nodes[layer.dst], layer.nodes]))
    arrays = {c: pa.array(np.concatenate(v)) for c, v in columns.items()} | {c: pa.array(v) for c, v in zip(("w", "m", "v"), state, strict=True)}
    return materialise(spark.createDataFrame(pa.table(arrays)))


def fit_by_subject(
    geno: DataFrame, train: DataFrame, validation: DataFrame, edges: DataFrame, params: Params | None = None,
    covariates: list[str] | None = None, add_output: bool = True, resume: Fit | None = None,
) -> Fit:
    """As `fit_topology_net`, by passes over subjects kept in place. `resume` goes on with the optimiser's state,
    step, rate and best loss. Networks of more than EDGES parameters are fitted as tables."""
    params, covs, spark = params or Params(), list(covariates or []), geno.sparkSession
    if edges.count() > EDGES:
        return fit_topology_net(geno, train, validation, edges, params, covs, add_output, resume)
    if add_output:
        whole, depth = with_output(edges, len(covs))
        first_dense = depth - 1 - bool(covs)
    else:
        whole, depth, first_dense = edges, edges.agg(F.max("layer")).first()[0] + 1, 0
    facts = train.agg(F.avg("label"), F.min("label"), F.count(F.lit(1))).first()
    out = output_kind(params.regression, facts[1] < 0)
    kinds = [hidden_kind(params.regression)] * (depth - 1) + [out]
    if covs:
        kinds[-2] = out
    start = resume.parameters if resume else initial_parameters(whole, params.seed, float(facts[0]) if params.regression else 0.0)
    normalise = params.normalise and depth > 1
    model, (w, m, v) = build(start, kinds, len(covs), normalise)
    # One table for both sets; each is read from its own part of it.
    rows, held_out, n = subject_rows(geno, train, covs), subject_rows(geno, validation, covs), facts[2]
    penalised = _penalised(model, first_dense) * params.l1

    fit = resume or Fit(as_network(start, kinds, covs), start)
    run = dict(fit.state) or {"step": 0, "rate": params.learning_rate, "best": float("inf"), "since_best": 0, "since_drop": 0}
    best, moments, first = None, None, len(fit.history)
    for epoch in range(first, first + params.epochs):
        losses = []
        for batch, size in _batches(train, rows, epoch, params, n):
            assign(model, w)
            if normalise:
                # Of the whole set they are those that the epoch before ended with.
                model.moments = moments if moments is not None and batch is rows else _moments(batch, model, size)
            g, loss = gradient(batch, model, size, params)
            run["step"] += 1
            g = g + np.sign(w) * penalised
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - run["rate"] * (1 - 0.999 ** run["step"]) ** 0.5 / (1 - 0.9 ** run["step"]) * m / (np.sqrt(v) + 1e-7)
            losses.append(loss)
        assign(model, w)
        if normalise:
            moments = _moments(rows, model, n)
        val_loss = mean_loss(held_out, model, params)
        fit.history.append({"epoch": epoch, "loss": float(np.mean(losses)), "val_loss": float(val_loss), "rate": run["rate"]})
        if val_loss < run["best"] - params.min_delta:
            run |= {"best": float(val_loss), "since_best": 0, "since_drop": 0}
            best, fit.best_epoch = ((w, m, v), moments), epoch
        else:
            run["since_best"] += 1
            run["since_drop"] += 1
            if run["since_drop"] >= params.plateau:
                run |= {"rate": run["rate"] * params.plateau_factor, "since_drop": 0}
            if run["since_best"] >= params.patience:
                break
    fit.state = run
    if best is not None:
        fit.parameters = _table(model, best[0], spark)
        fit.network = as_network(fit.parameters, kinds, covs, _moment_table(model, best[1], spark) if normalise else None)
    return fit


def _moment_table(model: Model, moments: list, spark) -> DataFrame:
    rows = []
    for i, (mean, scale) in enumerate(moments):
        nodes = model.layers[i].nodes
        if model.covariates and i == model.depth - 2:
            nodes = np.concatenate([nodes, np.arange(1, model.covariates + 1)])
        rows += [(i, int(a), float(b), float(c * c - EPSILON)) for a, b, c in zip(nodes, mean, scale, strict=True)]
    return materialise(spark.createDataFrame(rows, "layer int, node long, mean double, variance double"))


def _batches(train: DataFrame, rows: DataFrame, epoch: int, params: Params, n: int):
    """Rows of every batch of an epoch, and their number."""
    if params.batch_size is None or params.batch_size >= n:
        yield rows, n
        return
    planned = assign_batches(train, params.batch_size, params.epoch_size, epoch, params.seed, n_rows=n).select("subject_id", "batch")
    dealt = materialise(rows.join(planned, "subject_id"), "batch")
    sizes = {r.batch: r.n for r in dealt.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    for b in sorted(sizes):
        yield dealt.where(F.col("batch") == b).drop("batch"), sizes[b]
