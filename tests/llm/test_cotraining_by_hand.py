"""Co-training rounds written out row by row, on a few rows, against the operator."""

import math
import random

import numpy as np
import pytest

from voxloom.llm import cotraining as ct
from voxloom.llm._linear import Dense, fit, folds

WIDTH = {"content": 3, "metadata": 2}


def made(seed, n):
    """Rows of two views that both follow the label, each with noise of its own."""
    rng = random.Random(seed)
    y = [i % 2 for i in range(n)]
    rng.shuffle(y)
    return {v: np.array([[(2 * label - 1) * 1.5 + rng.gauss(0, 1.0) for _ in range(w)] for label in y]) for v, w in WIDTH.items()}, np.array(y, float)


def logistic(row, model):
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(row, model[0])) + model[1])))


def by_hand(labelled, y, pool):
    """Weights, calibrated scores of the labelled rows, and the labels that each view has been given, in the end."""
    fold = folds(len(y), ct.CALIBRATION)
    learn, check = [i for i in range(len(y)) if fold[i]], [i for i in range(len(y)) if not fold[i]]
    scaled, rest = {}, {}
    for v in ct.VIEWS:
        columns = [[labelled[v][i][k] for i in learn] for k in range(WIDTH[v])]
        mean = [sum(c) / len(c) for c in columns]
        sd = [math.sqrt(sum((x - m) ** 2 for x in c) / len(c)) + 1e-3 for c, m in zip(columns, mean)]
        scale = lambda row: [min(5, max(-5, (x - m) / s)) for x, m, s in zip(row, mean, sd)]  # noqa: B023, E731
        scaled[v], rest[v] = [scale(r) for r in labelled[v]], [scale(r) for r in pool[v]]
    given = {v: {} for v in ct.VIEWS}
    for round_ in range(ct.ROUNDS + 1):
        model = {}
        for v in ct.VIEWS:
            rows = [(scaled[v][i], y[i], 1.0) for i in learn] + [(rest[v][i], label, ct.PSEUDO_WEIGHT) for i, label in given[v].items()]
            model[v] = fit(Dense(np.array([r[0] for r in rows])), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), ct.L2)
        told = {}
        for to, by in (ct.VIEWS, ct.VIEWS[::-1]):
            new = {i: logistic(rest[by][i], model[by]) for i in range(len(rest[by])) if i not in given[to]}
            most = max(1, int(ct.GIVEN_A_ROUND * len(rest[by])))
            sure = [i for i in sorted(new, key=lambda i: -new[i])[:most] if new[i] >= ct.CONFIDENT]
            unsure = [i for i in sorted(new, key=lambda i: new[i])[:most] if new[i] <= 1 - ct.CONFIDENT]
            told[to] = given[to] | dict.fromkeys(sure, 1.0) | dict.fromkeys(unsure, 0.0)
        given = told
    odds = {}
    for v in ct.VIEWS:
        margin = [sum(a * b for a, b in zip(r, model[v][0])) + model[v][1] for r in scaled[v]]
        size = max(sum(abs(margin[i]) for i in check) / len(check), 1e-9)
        slope, shift = fit(Dense(np.array([[margin[i] / size] for i in check])), y[check], l2=0.1, steps=400)
        odds[v] = [min(8, max(-8, max(slope[0], 1e-3) / size * m + shift)) for m in margin]
    both = list(zip(odds["content"], odds["metadata"]))
    together = fit(Dense(np.array([both[i] for i in check])), y[check], l2=0.05, steps=400)
    return model, given, [logistic(r, together) for r in both]


@pytest.mark.parametrize("seed", range(4))
def test_rounds_by_hand(seed, monkeypatch):
    labelled, y = made(seed, 50)
    pool, truth = made(seed + 100, 60)
    exchanged = []
    pseudo = ct.Model.pseudo

    def noted(self, view, rows, before):
        found = pseudo(self, view, rows, before)
        exchanged.append((view, dict(zip(found[0].tolist(), found[1].tolist()))))
        return found

    monkeypatch.setattr(ct.Model, "pseudo", noted)
    model = ct.Model(labelled, y, pool)
    weights, given, scores = by_hand(labelled, y, pool)
    last = dict(exchanged[-2:])
    assert len(exchanged) == 2 * (ct.ROUNDS + 1) and last == {"metadata": given["content"], "content": given["metadata"]}
    for v in ct.VIEWS:
        assert np.allclose(model.weights[v][0], weights[v][0], atol=1e-6) and abs(model.weights[v][1] - weights[v][1]) < 1e-6
    assert np.allclose(model.score(labelled)["score"], scores, atol=1e-6)
    assert len(given["content"]) > 6 and np.mean([truth[i] == label for i, label in given["content"].items()]) > 0.8
    good = [s for s, label, f in zip(scores, y, folds(len(y), ct.CALIBRATION)) if label and not f]
    assert model.kept_from == pytest.approx(min(ct.KEPT_FROM, float(np.quantile(good, ct.MAX_GOOD_LOST))), abs=1e-6)
