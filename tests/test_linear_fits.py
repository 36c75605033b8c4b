"""Linear models against optima found by arrays."""

import numpy as np
import pytest

from locusframe.operators import linear_fits as lf
from test_operators import cells_of


def problem(spark, n=60, seed=1, p=8):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, p))
    x[:, 6] = x[:, 0]  # a copy
    x[:, 7] = 0  # without variation, never listed
    age = np.arange(n) % 5
    y = x[:, 0] - x[:, 3] + 0.5 * age + rng.normal(0, 1.5, n)
    cells = cells_of(spark, x).where("dosage <> 0 OR subject_id = 0")
    subjects = lambda y: spark.createDataFrame([(s, float(y[s]), float(age[s])) for s in range(n)], "subject_id long, label double, age double")
    return x.astype(float), age.astype(float), y, cells, subjects


@pytest.mark.parametrize("regression,gram", [(True, 2048), (False, 2048), (True, 0)])
def test_lasso_is_at_its_optimum(spark, monkeypatch, regression, gram):
    monkeypatch.setattr(lf, "GRAM", gram)
    monkeypatch.setattr(lf, "PATH", 2)
    x, age, y, cells, subjects = problem(spark)
    y = y if regression else (y > np.median(y)).astype(float)
    tolerance, l1 = (1e-9 if gram else 1e-4), 0.3 if regression else 0.08
    rows = lf.fit_lasso(cells, subjects(y), l1, ["age"], regression=regression, tolerance=tolerance).collect()
    w = np.array([r.w for r in sorted((r for r in rows if r.src is not None), key=lambda r: r.src)])
    intercept = next(r.w for r in rows if r.src is None)
    assert len(w) == 8 and w[7] == 0 and max(r.kkt for r in rows) < 2 * tolerance
    scaled = np.column_stack([(x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), (age - age.mean()) / age.std(), np.ones(len(y))])
    v, penalty = np.zeros(10), np.array([l1] * 8 + [0, 0])
    for _ in range(20_000):
        z = scaled @ v
        g = scaled.T @ ((z if regression else 1 / (1 + np.exp(-z))) - y) / len(y)
        moved = v - 0.2 * g
        v = np.sign(moved) * np.maximum(np.abs(moved) - 0.2 * penalty, 0)
    # Weights of copies may be shared in any way, their sum not.
    joined = lambda u: [u[0] + u[6], *u[1:6]]
    assert joined(w) == pytest.approx(joined(v), abs=1e-6 if gram else 1e-3)
    assert intercept == pytest.approx(v[9], abs=1e-6 if gram else 1e-3)


def test_lasso_beyond_the_largest_penalty_keeps_nothing(spark):
    _, _, y, cells, subjects = problem(spark)
    assert all(r.w == 0 for r in lf.fit_lasso(cells, subjects(y), 50.0, regression=True).collect() if r.src is not None)


def test_logistic_comparator_is_ranked_by_sign(spark):
    x, age, y, cells, subjects = problem(spark, n=120)
    y = (y > np.median(y)).astype(float)
    rows = lf.fit_logistic(cells.where("variant_id < 6"), subjects(y), ["age"]).collect()
    found = [r.coefficient for r in rows]
    assert found == sorted(found, reverse=True)
    design, w = np.column_stack([x[:, :6], age, np.ones(len(y))]), np.zeros(8)
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve(design.T @ (design * (q * (1 - q))[:, None]), design.T @ (y - q))
    assert {r.variant_id: r.coefficient for r in rows} == pytest.approx(dict(enumerate(w[:6])), abs=1e-6)


@pytest.mark.parametrize("ties", [False, True])
def test_separated_labels_have_no_fit(spark, ties):
    """Also where a plane separates them but for subjects that lie on it with either label."""
    x = np.array([[0], [0], [1], [1], [2], [2]])
    y = [0, 0, 0, 1, 1, 1] if ties else [0, 0, 0, 0, 1, 1]
    subjects = spark.createDataFrame([(s, float(v)) for s, v in enumerate(y)], "subject_id long, label double")
    assert [r.coefficient for r in lf.fit_logistic(cells_of(spark, x), subjects).collect()] == [None]


def test_without_subjects_there_are_no_rows(spark):
    _, _, y, cells, subjects = problem(spark)
    none = subjects(y).where("subject_id < 0")
    assert lf.fit_lasso(cells, none, 0.1).collect() == [] and lf.fit_logistic(cells, none).collect() == []
