"""Composition search and sweeps."""

import math
from itertools import combinations

import numpy as np
import pytest

from marquetry.operators import composition, models, moments, pricing, sweeps


def brute(matrix, prices, items, cost=0.0):
    w = np.array([sum(min(r[i], prices[i]) for i in items) for r in matrix])
    lost = np.array([sum(prices[i] - cost for i in items if r[i] >= prices[i]) for r in matrix])
    best = max(((w >= b) * (b - cost * len(items) - lost)).mean() for b in w)
    return max(0.0, best)


def test_exhaustive_search_equals_brute_force(spark):
    matrix = np.random.default_rng(1).integers(1, 9, (12, 4)).astype(float)
    panel = sweeps.panel_frame(spark, matrix)
    prices = {r["item_id"]: r["price"] for r in pricing.component_prices(panel).collect()}
    want = {c: brute(matrix, prices, c) for k in (2, 3) for c in combinations(range(4), k)}
    found = composition.exhaustive(panel, 3)
    assert found["gain"] == pytest.approx(max(want.values()))
    rows = composition.scan_compositions(panel, pricing.component_prices(panel), list(want)).collect()
    assert [r["gain"] for r in sorted(rows, key=lambda r: r["composition"])] == pytest.approx(list(want.values()))
    local = composition.local_search(panel, [(0, 1), (2, 3)], 3)
    assert local["gain"] <= found["gain"] + 1e-9
    if found["gain"] > 0:
        again = composition.assess(panel, pricing.component_prices(panel), found["items"], found["price"]).first()
        assert again["gain"] == pytest.approx(found["gain"])


def test_hand_example(spark):
    panel = sweeps.panel_frame(spark, np.array([[10.0, 2.0], [2.0, 10.0]]))
    assert composition.exhaustive(panel, 2) == {"items": (0, 1), "price": 12.0, "gain": 2.0, "certificate": "exhaustive"}
    alone = composition.scan_compositions(panel, pricing.component_prices(panel), [(0, 1)], beside_components=False).first()
    assert (alone["price"], alone["gain"]) == (12.0, 2.0)


def test_sweeps(spark):
    rows = sweeps.distribution_sweep(spark, ("gamma", "normal"), (0.0, 0.5), users=60, items=3).collect()
    assert len(rows) == 3 and all(r["separate"] > 0 for r in rows)
    price, profit = sweeps.probit_optimum(2.0, 1.0)
    assert profit >= max((p * (1 - 0.5 * math.erfc(-(p - 2) / math.sqrt(2)))) for p in np.linspace(0, 5, 400)) - 1e-6 and 1 < price < 2
    assert all(0.9 < r["ratio"] <= 1 + 1e-9 for r in sweeps.closed_form_against_probit([3.0], [0.5, 1.0]))
    scores = sweeps.panel_frame(spark, moments.panel("normal", 30, 3, 1)).withColumnRenamed("v", "score")
    got = {(r["scale"], r["shift"]): r for r in sweeps.knob_sweep(scores, 0.0, 1.0, [(1.0, 0.0), (2.0, 0.0), (1.0, -2.0)]).collect()}
    assert got[2.0, 0.0]["separate"] == pytest.approx(2 * got[1.0, 0.0]["separate"])
    assert got[1.0, -2.0]["floored"] > got[1.0, 0.0]["floored"]


def test_ml_als_is_another_estimator(spark):
    edges = spark.createDataFrame([(u, i, 3.0) for u in range(6) for i in range(u % 3, 8, 2)], "user_id long, item_id long, confidence double")
    model = sweeps.ml_als(edges, 2, 0.1, 2)
    assert model.userFactors.count() == 6 == models.fit_als(edges, 2, 0.1, 1)[0].count()
