"""Menus of a price grid and shrunk moments against NumPy."""

from itertools import product

import numpy as np
import pytest

from marquetry.operators import grids, moments, pricing, statistics, sweeps


def rows_of(spark, matrix):
    return sweeps.panel_frame(spark, matrix)


def tops(matrix, sizes):
    return np.cumsum(-np.sort(-matrix, axis=1), axis=1)[:, [s - 1 for s in sizes]]


def loop(matrix, sizes, points, cost):
    w = tops(matrix, sizes)
    costs = np.array(pricing.size_costs(cost, sizes))
    best = None
    for k, prices in enumerate(product(*[np.linspace(0.0, u, points) for u in w.max(axis=0)])):
        got = round(moments.realised_profit(w, np.array(prices), sizes, costs), 9)
        if best is None or got > best[0]:
            best = got, k, prices
    return best


@pytest.mark.parametrize(("sizes", "points", "cost", "whole"), [((1, 2, 3), 7, 0.3, False), ((3, 1), 9, 0.0, False), ((1, 2, 4), 6, [0.5, 0.6, 2.0], True), ((2,), 11, 0.1, False)])
def test_grid_equals_a_loop_over_all_menus(spark, monkeypatch, sizes, points, cost, whole):
    monkeypatch.setattr(grids, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(grids, "PREFIXES_PER_PACK", 3)
    monkeypatch.setattr(grids, "CHOICES", 200)
    matrix = np.random.default_rng(len(sizes) + points).gamma(2.0, 1.0, (45, 4))
    if whole:
        matrix = np.round(matrix)  # many ties, of users and of menus
    judged = []
    got = grids.price_grid(rows_of(spark, matrix), sizes, points, cost, judged=judged).collect()
    profit, number, prices = loop(matrix, sizes, points, cost)
    assert [r["size"] for r in got] == list(sizes)
    assert {r["menu"] for r in got} == {number} and [r["price"] for r in got] == pytest.approx(prices, abs=1e-12)
    assert got[0]["profit"] == pytest.approx(profit, abs=1e-9)
    assert judged[0] == points and len(judged) == len(sizes) and sum(judged[1:]) <= sum(points ** (k + 1) for k in range(1, len(sizes)))


def test_bounds_leave_out_most_of_a_grid(spark):
    matrix = np.random.default_rng(8).gamma(2.0, 1.0, (300, 4))
    judged = []
    got = grids.price_grid(rows_of(spark, matrix), (1, 2, 4), 40, 0.2, judged=judged).first()
    assert judged[-1] < 40**3 / 2
    w = tops(matrix, (1, 2, 4))
    costs = np.array([0.2, 0.4, 0.8])
    for prices in np.random.default_rng(1).integers(0, 40, (300, 3)):
        menu = np.array([np.linspace(0.0, u, 40)[k] for u, k in zip(w.max(axis=0), prices, strict=True)])
        assert moments.realised_profit(w, menu, (1, 2, 4), costs) <= got["profit"] + 1e-9


def test_grid_edges(spark):
    panel = rows_of(spark, np.array([[2.0, 1.0]]))
    assert grids.price_grid(panel.limit(0), (1, 2), 5).count() == 0
    for sizes, points in (((1, 1), 5), ((1,), 1), (tuple(range(1, 13)), 40)):
        with pytest.raises(ValueError):
            grids.price_grid(panel, sizes, points)
    # A size that no user has is never bought.
    got = {r["size"]: r for r in grids.price_grid(panel, (1, 2, 9), 3).collect()}
    assert got[9]["price"] == 0.0 and got[1]["profit"] == pytest.approx(loop(np.array([[2.0, 1.0]]), (1, 2), 3, 0.0)[0])


@pytest.mark.parametrize("about", [None, (2.0, 4.0, 7.0)])
def test_shrunk_moments_equal_numpy(spark, about):
    matrix = np.random.default_rng(5).gamma(2.0, 1.0, (60, 5))
    sizes = (1, 2, 5)
    w = tops(matrix, sizes)
    panel = rows_of(spark, matrix)
    few = spark.createDataFrame([(1000, "0", 9.0), (1001, "0", 1.0), (1001, "1", 4.0)], "user_id long, item_id string, v double")  # without a fifth value
    got = {(r["size_a"], r["size_b"]): r for r in pricing.shrunk_moments(panel.selectExpr("user_id", "cast(item_id as string) item_id", "v").unionByName(few), sizes, about=about).collect()}
    want, _ = moments.covariance(w, "ledoit_wolf")
    sample = np.cov(w, rowvar=False)
    assert len(got) == 6
    for (a, b), r in got.items():
        i, j = sizes.index(a), sizes.index(b)
        assert r["sigma"] == pytest.approx(sample[i, j]) and r["shrunk"] == pytest.approx(want[i, j], rel=1e-8)
        assert (r["omega_a"], r["omega_b"]) == pytest.approx((w[:, i].mean(), w[:, j].mean())) and 0 < r["weight"] < 1


def test_shrunk_moments_of_small_panels(spark):
    assert pricing.shrunk_moments(rows_of(spark, np.array([[1.0, 2.0]])), (1, 2)).count() == 0
    same = pricing.shrunk_moments(rows_of(spark, np.ones((5, 2))), (1, 2)).collect()
    assert all(r["sigma"] == pytest.approx(0) and r["shrunk"] == pytest.approx(0) for r in same)
    one = pricing.shrunk_moments(rows_of(spark, np.arange(8.0).reshape(4, 2)), (1,)).first()
    assert one["shrunk"] == pytest.approx(np.arange(1.0, 8.0, 2.0).var())


def test_calibrated_panel_follows_the_line(spark):
    scores = spark.createDataFrame([(1, 1, 2.0), (1, 2, -3.0), (2, 1, 0.5)], "user_id long, item_id long, score double")
    line = spark.createDataFrame([(1.0, 2.0, 0.3)], "a double, b double, sigma double")
    values = lambda **k: {(r["user_id"], r["item_id"]): r["v"] for r in pricing.calibrated_panel(scores, line, **k).collect()}
    assert values() == {(1, 1): 5.0, (1, 2): 0.0, (2, 1): 2.0} and values(floor=False)[1, 2] == -5.0
    items = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "mean_score double, price double")
    fit = statistics.normalised_calibration(items).first()
    assert (fit["a"], fit["b"]) == pytest.approx((1.0, 2.0))
