"""Gradients and fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import metrics, network
from locusframe.operators import subject_training as st
from locusframe.operators import training as t
from test_operators import cells_of


def problem(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, 6))
    y = ((x[:, 0] + x[:, 3] - x[:, 1]) + rng.normal(0, 0.3, n) > 1).astype(float)
    rows = [(s, float(y[s]), float(s % 5)) for s in range(n)]
    subjects = spark.createDataFrame(rows, "subject_id long, label double, cov_1 double")
    edges = spark.createDataFrame([(0, s, s % 3) for s in range(6)] + [(1, s, s % 2) for s in range(3)], "layer int, src long, dst long")
    return cells_of(spark, x), subjects, edges


def total_loss(net, x, subjects, params):
    """Objective whose gradient `_gradients` returns, by the forward pass alone."""
    inputs, sums = t._forward(net, x, subjects, params)
    p = network.activate(F.col("z"), net.kinds[-1])
    scored = sums[-1].join(subjects, "subject_id")
    loss = scored.agg(F.avg(t.row_loss(p, F.col("label"), params))).first()[0]
    n = subjects.count()
    return loss + sum(params.l1_activity / n * z.agg(F.sum(F.abs("z"))).first()[0] for z in sums)


@pytest.mark.parametrize("normalise", [False, True])
def test_gradients_equal_finite_differences(spark, normalise):
    geno, subjects, edges = problem(spark, n=12)
    params = t.Params(normalise=normalise, l1_activity=0.02, positive_weight=1.5)
    edges, depth = t.with_output(edges, covariates=1)
    kinds = ["tanh"] * (depth - 2) + ["sigmoid", "sigmoid"]
    start = t.materialise(t.initial_parameters(edges, seed=3).withColumn("w", F.col("w") + 0.05))
    x = network.as_nodes(geno)
    grads, _ = t._gradients(t.as_network(start, kinds, ["cov_1"]), x, subjects, params)
    found = {(r.layer, r.src, r.dst): r.g for r in grads.collect()}
    for key in [(0, 0, 0), (1, 1, 1), (2, 0, 0), (3, 1, 0)]:
        here = (F.col("layer") == key[0]) & (F.col("src") == key[1]) & (F.col("dst") == key[2])

        def at(h):
            moved = t.materialise(start.withColumn("w", F.when(here, F.col("w") + h).otherwise(F.col("w"))))
            return total_loss(t.as_network(moved, kinds, ["cov_1"]), x, subjects, params)

        slope = (at(1e-4) - at(-1e-4)) / 2e-4
        assert found[key] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_training_lowers_the_loss_and_keeps_the_best(spark):
    geno, subjects, edges = problem(spark)
    train, validation = subjects.filter("subject_id < 28"), subjects.filter("subject_id >= 28")
    params = t.Params(learning_rate=0.1, epochs=6, l1=0.0, l1_activity=0.0, normalise=False)
    fit = t.fit_topology_net(geno, train, validation, edges.filter("layer = 0"), params)
    losses = [h["loss"] for h in fit.history]
    assert losses[-1] < losses[0]
    best = min(range(len(fit.history)), key=lambda e: fit.history[e]["val_loss"])
    assert fit.history[fit.best_epoch]["val_loss"] <= fit.history[best]["val_loss"] + 2 * params.min_delta
    again = t.fit_topology_net(geno, train, validation, edges.filter("layer = 0"), t.Params(**{**params.__dict__, "epochs": 1}), resume=fit)
    assert again.history[-1]["epoch"] == 6


def test_mini_batches_and_early_stop(spark):
    geno, subjects, edges = problem(spark, n=24)
    train, validation = subjects.filter("subject_id < 16"), subjects.filter("subject_id >= 16")
    params = t.Params(learning_rate=0.0, epochs=9, batch_size=8, patience=2, normalise=False)
    fit = t.fit_lasso(geno, train, validation, params)
    # Nothing moves at rate 0: the first epoch is the best and two more are waited for.
    assert len(fit.history) == 3 and fit.best_epoch == 0


def adam_by_hand(x, y, w, b, rate, epochs, l1):
    """Full-batch Adam on the clipped cross-entropy of a logistic model."""
    theta, clip = np.append(w, b), 1e-4
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    design = np.column_stack([x, np.ones(len(x))])
    target = np.clip(y, clip, 1)
    for step in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-design @ theta))
        q = np.clip(p, clip, 1)
        d = ((p > clip) & (p < 1)) * (-target / (q + clip) + (1 - target) / (1 - q + clip)) * p * (1 - p) / len(y)
        g = design.T @ d + np.append(l1 * np.sign(theta[:-1]), 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-7)
    return theta


@pytest.mark.parametrize("l1", [0.0, 0.05])
def test_linear_baselines_follow_adam(spark, l1):
    geno, subjects, _ = problem(spark)
    params = t.Params(learning_rate=0.02, epochs=4, l1=l1, l1_activity=0.0)
    start = t.initial_parameters(t.dense_edges(geno), params.seed).collect()
    w = [r.w for r in sorted((r for r in start if r.src != t.BIAS), key=lambda r: r.src)]
    cells = geno.toPandas().pivot(index="subject_id", columns="variant_id", values="dosage").to_numpy(float)
    y = subjects.orderBy("subject_id").toPandas()["label"].to_numpy()
    expected = adam_by_hand(cells, y, w, 0.0, 0.02, 4, l1)
    # The last epoch has the lowest loss here, so its weights are the ones kept.
    if l1:
        fit = t.fit_lasso(geno, subjects, subjects, params)
        assert fit.best_epoch == 3
        found = {r.src: r.w for r in fit.network.edges.collect()}
    else:
        ranked = t.fit_logistic(geno, subjects, subjects, params).collect()
        assert [abs(r.coefficient) for r in ranked] == sorted((abs(r.coefficient) for r in ranked), reverse=True)
        found = {r.variant_id: r.coefficient for r in ranked}
    assert [found[v] for v in range(6)] == pytest.approx(list(expected[:-1]), rel=1e-6)


def test_regression_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.5)], "y double, p double")
    assert metrics.mse(df).first().loss == pytest.approx(0.625)


@pytest.mark.parametrize("normalise,covariates", [(False, []), (True, ["cov_1"])])
def test_passes_over_subjects_equal_tables(spark, normalise, covariates):
    """One and two steps of both trainers give the same weights, losses and scores."""
    geno, subjects, edges = problem(spark, n=24)
    train, validation = subjects.filter("subject_id < 16"), subjects.filter("subject_id >= 16")
    params = t.Params(learning_rate=0.03, epochs=2, l1=0.02, l1_activity=0.01, positive_weight=1.5, normalise=normalise)
    one = t.fit_topology_net(geno, train, validation, edges, params, covariates)
    two = st.fit_by_subject(geno, train, validation, edges, params, covariates)
    for key in ("loss", "val_loss"):
        assert [h[key] for h in two.history] == pytest.approx([h[key] for h in one.history], rel=1e-9)
    weights = lambda f: {(r.layer, r.src, r.dst): r.w for r in f.parameters.collect()}
    assert two.best_epoch == one.best_epoch and weights(two) == pytest.approx(weights(one), rel=1e-7, abs=1e-12)
    scores = [{r.subject_id: r.p for r in network.predict(f.network, network.as_nodes(geno), validation).join(validation, "subject_id").collect()} for f in (one, two)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-7)


def test_a_resumed_fit_goes_on_where_it_stopped(spark):
    geno, subjects, edges = problem(spark)
    params = lambda n: t.Params(learning_rate=0.05, epochs=n, l1=0.0, l1_activity=0.0, normalise=False)
    whole = st.fit_by_subject(geno, subjects, subjects, edges, params(6))
    part = st.fit_by_subject(geno, subjects, subjects, edges, params(4))
    assert part.best_epoch == 3
    again = st.fit_by_subject(geno, subjects, subjects, edges, params(2), resume=part)
    assert [h["loss"] for h in again.history] == pytest.approx([h["loss"] for h in whole.history], rel=1e-9)
    assert again.state == pytest.approx(whole.state)


def test_a_separable_problem_is_learnt_until_it_stops_getting_better(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (200, 12))
    x[:, 11] = 0  # never listed
    y = (x[:, 0] + x[:, 1] - x[:, 5] > 1).astype(float)
    cells = cells_of(spark, x).where("dosage <> 0")  # unlisted cells are 0
    subjects = spark.createDataFrame([(s, float(y[s])) for s in range(200)], "subject_id long, label double")
    edges = spark.createDataFrame([(0, s, s % 4) for s in range(12)] + [(1, s, s % 2) for s in range(4)], "layer int, src long, dst long")
    params = t.Params(learning_rate=0.2, epochs=60, patience=3, min_delta=2e-2, l1=0.0, l1_activity=0.0)
    train, validation = subjects.filter("subject_id < 140"), subjects.filter("subject_id >= 140")
    fit = st.fit_by_subject(cells, train, validation, edges, params)
    rows = st.subject_rows(cells, validation, [])
    model, (w, _, _) = st.build(fit.parameters, fit.network.kinds, 0, True)
    st.assign(model, w)
    moments = {(r.layer, r.node): (r["mean"], r.variance) for r in fit.network.moments.collect()}
    model.moments = [tuple(np.array([(m, (q + network.EPSILON) ** 0.5) for m, q in [moments[i, v] for v in layer.nodes]]).T) for i, layer in enumerate(model.layers[:-1])]
    scored = []
    for ids, inputs, covariates, label in st._blocks(model, rows.toArrow().to_batches()):
        scored += zip(st._act(st.forward(model, inputs, covariates, model.depth)[1][-1][:, 0], "sigmoid"), label, strict=True)
    positive, negative = [p for p, q in scored if q], [p for p, q in scored if not q]
    assert len(scored) == 60 and np.mean([a > b for a in positive for b in negative]) > 0.95
    assert len(fit.history) < 60
