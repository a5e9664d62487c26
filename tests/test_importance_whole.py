"""Permutation importance fits its model on all training rows, in one task or by parts, against plain Python."""

import datetime as dt
import hashlib

import numpy as np
import pytest

from tidemark.operators import ml
from tidemark.operators.learners import Estimator

DAY = dt.date(2000, 1, 1)


def matrix(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns a, b (with gaps) and c (one value), and outcomes."""
    draw = np.random.default_rng(7)
    x = np.stack([draw.normal(size=n), np.where(draw.random(n) < 0.1, np.nan, np.rint(draw.normal(size=n) * 40)), np.full(n, 0.1)], 1)
    return x, (x[:, 0] + np.nan_to_num(x[:, 1]) / 60 + draw.normal(size=n) > 0).astype(np.int64)


def table(spark, x: np.ndarray, y: np.ndarray, a_day: int):
    rows = [(i, DAY + dt.timedelta(i // a_day), int(k), *(None if np.isnan(v) else float(v) for v in row)) for i, (k, row) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, date date, y int, a double, b double, c double")


def area(y: np.ndarray, p: np.ndarray) -> float:
    levels, at = np.unique(p, return_inverse=True)
    pos, neg = np.bincount(at, y, len(levels)), np.bincount(at, 1 - y, len(levels))
    return float((pos * (neg.cumsum() - neg / 2)).sum() / pos.sum() / neg.sum())


def test_model_is_fitted_on_all_training_rows(spark):
    n, a_day = 130_000, 40
    x, y = matrix(n)
    got = ml.permutation_importance(table(spark, x, y, a_day), ["a", "b", "c"], repeats=1, rounds=2).collect()
    cut = int(n * 0.8)
    train = np.arange(n) // a_day < cut // a_day - 10
    assert train.sum() > 100_000
    model = Estimator("gbm", x[train], y[train].astype(float), 2)
    test, label = x[cut:], y[cut:]
    want = {}
    for j, f in enumerate("abc"):
        order = sorted(range(cut, n), key=lambda i: hashlib.md5(f"42|{f}|1|{i}".encode()).hexdigest())
        mixed = test.copy()
        mixed[:, j] = x[order, j]
        want[f] = area(label, model.score(test)) - area(label, model.score(mixed))
    assert {r.feature: r.auc_drop for r in got} == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", ["gbm", "logistic"])
def test_parts_give_the_model_of_one_task(spark, kind):
    x, y = matrix(700)
    rows, names = table(spark, x, y, 1), ["a", "b", "c"]
    want = Estimator(kind, x, y.astype(float), ml.KEPT + 2)
    got, again = (ml._fitted_by_parts(rows.repartition(k), names, kind, ml.KEPT + 2, 700) for k in (1, 5))
    assert got.score(x) == pytest.approx(want.score(x), abs=1e-6)
    assert again.score(x) == pytest.approx(got.score(x), abs=1e-12)
    if kind == "gbm":
        assert [[[z.tolist() for z in split] for split in splits] for splits, _ in got.model.trees] == [[[z.tolist() for z in split] for split in splits] for splits, _ in want.model.trees]
        assert all((a[1] == b[1]).all() for a, b in zip(got.model.trees, again.model.trees))


def test_a_column_without_values_has_no_edges_to_split(spark):
    x, y = matrix(60)
    x[:, 1] = np.nan
    got = ml._fitted_by_parts(table(spark, x, y, 1), ["a", "b", "c"], "gbm", 1, 60)
    assert got.score(x) == pytest.approx(Estimator("gbm", x, y.astype(float), 1).score(x), abs=1e-6)
