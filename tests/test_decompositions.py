"""Singular vectors and non-negative factors of edges against NumPy on the dense matrix."""

import numpy as np
import pytest

from marquetry.functions.contracts import ContractError
from marquetry.operators import models


def matrix(seed=2, shape=(30, 14)):
    rng = np.random.default_rng(seed)
    dense = rng.random(shape) * (rng.random(shape) < 0.5)
    dense[0, 0] = 2.0
    return dense


def edges_of(spark, dense):
    rows = [(100 + u, 7 * i, float(x)) for (u, i), x in np.ndenumerate(dense) if x]
    return spark.createDataFrame(rows, "user_id long, item_id long, confidence double").repartition(3)


def test_singular_values_and_vectors_equal_numpy(spark):
    dense = matrix()
    values, items, users = models.truncated_svd(edges_of(spark, dense), 3, rounds=60, tolerance=1e-12)
    left, want, right = np.linalg.svd(dense)
    assert values == pytest.approx(want[:3], rel=1e-6)
    v = np.stack([r["vec"] for r in items.orderBy("id").collect()])
    u = np.stack([r["vec"] for r in users.orderBy("id").collect()])
    assert v.T @ v == pytest.approx(np.eye(3), abs=1e-8) and u.T @ u == pytest.approx(np.eye(3), abs=1e-8)
    ids = [r["id"] for r in users.orderBy("id").select("id").collect()]
    rows = dense[[i - 100 for i in ids]]
    cols = rows[:, [r["id"] // 7 for r in items.orderBy("id").select("id").collect()]]
    assert np.abs(cols @ v - u * values).max() < 1e-6
    assert np.linalg.norm(cols - (u * values) @ v.T) == pytest.approx(np.sqrt((want[3:] ** 2).sum()), rel=1e-6)


def test_iteration_ends_when_values_stand_still(spark, monkeypatch):
    calls = []
    real = models.orthonormal
    monkeypatch.setattr(models, "orthonormal", lambda t, s: calls.append(1) or real(t, s))
    values, _, _ = models.truncated_svd(edges_of(spark, np.diag([5.0, 3.0, 1e-3])), 2, rounds=50, tolerance=1e-6)
    assert values == pytest.approx([5.0, 3.0]) and len(calls) < 12


def test_a_rank_below_k_is_an_error(spark):
    with pytest.raises(ValueError, match="no 3 singular values"):
        models.truncated_svd(edges_of(spark, np.ones((4, 5))), 3)


def test_orthonormal_blocks_span_the_same_space(spark):
    rng = np.random.default_rng(4)
    tall = rng.normal(size=(40, 3)) @ np.diag([1e3, 1.0, 1e-1])
    tall = np.concatenate([tall, tall[:, :1] - 2 * tall[:, 1:2]], axis=1)  # and a column that depends on others
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(tall)], "id long, vec array<double>")
    found, width = models.orthonormal(table, lambda df: df.checkpoint())
    q = np.stack([r["vec"] for r in found.orderBy("id").collect()])
    assert width == 3 and q.T @ q == pytest.approx(np.eye(3), abs=1e-12)
    assert np.abs(q @ (q.T @ tall) - tall).max() < 1e-6


def test_non_negative_factors_equal_numpy(spark):
    dense, losses = matrix(5, (18, 9)), []
    edges = edges_of(spark, dense)
    users, items = models.fit_nmf_edges(edges, 3, rounds=6, seed=1, losses=losses)
    start = lambda key, i: 0.1 + np.random.default_rng(models.namespaced_seed(1, "nmf", key, i)).random(3)
    kept_u, kept_i = [u for u in range(18) if dense[u].any()], [i for i in range(9) if dense[:, i].any()]
    d = dense[np.ix_(kept_u, kept_i)]
    w, h = np.stack([start("user_id", 100 + u) for u in kept_u]), np.stack([start("item_id", 7 * i) for i in kept_i])
    for turn in range(6):
        h = h * (d.T @ w) / np.maximum(h @ (w.T @ w), 1e-12)
        w = w * (d @ h) / np.maximum(w @ (h.T @ h), 1e-12)
        assert losses[turn] == pytest.approx(((d - w @ h.T) ** 2).sum(), rel=1e-9)
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:], strict=False))
    got = {r["id"]: r["vec"] for r in users.collect()}
    assert all(got[100 + u] == pytest.approx(w[k], rel=1e-9) for k, u in enumerate(kept_u))
    assert {r["id"] for r in items.collect()} == {7 * i for i in kept_i}


def test_negative_entries_are_an_error(spark):
    with pytest.raises(Exception) as found:
        models.fit_nmf_edges(spark.createDataFrame([(1, 1, -1.0)], "user_id long, item_id long, confidence double"), 2, rounds=1)
    assert isinstance(found.value, ContractError) or "not negative" in str(found.value)


def test_sums_over_mapped_vectors_shuffle_no_edges(spark, monkeypatch):
    """Mapped and joined sums agree, also for keys that tasks share; only the joined form shuffles edges."""
    edges, written = edges_of(spark, matrix(5)), []

    def save(df):
        written.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    laid = models.dealt_by(edges, "item_id", save)
    vectors = spark.createDataFrame([(100 + u, [float(u), 1.0 / (1 + u)]) for u in range(30)], "id long, vec array<double>").localCheckpoint()
    written.clear()
    got = {r["id"]: r["vec"] for r in models._weighted_sums(laid, "user_id", "item_id", vectors, 2, save).collect()}
    assert len(written) == 1 and "Join" not in written[0] and "Aggregate" not in written[0]
    monkeypatch.setattr(models.arrays, "mounted", lambda spark: None)
    want = {r["id"]: r["vec"] for r in models._weighted_sums(laid, "user_id", "item_id", vectors, 2, save).collect()}
    assert got.keys() == want.keys()
    for key, vec in want.items():
        assert got[key] == pytest.approx(vec, rel=1e-12)


def test_als_rounds_shuffle_no_edge_and_equal_joined_ones(spark, monkeypatch):
    """Stretches of a few edges cut keys; a half step is one job over mapped vectors, with the vectors of joined tables."""
    from marquetry.operators import rounds

    monkeypatch.setattr(rounds, "EDGES_PER_STRETCH", 7)
    rows = [(100 + u, 7 * i, 1.0 + (u * i) % 5) for u in range(9) for i in range(0, 40, 1 + u % 4)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, confidence double").repartition(3)
    by_user, by_item = rounds.sides(edges, lambda df: df.localCheckpoint())
    assert by_user.cut and by_user.n == 9 and by_item.n == 40
    calls, real = [], models.half_step
    monkeypatch.setattr(models, "half_step", lambda *a: calls.append(1) or real(*a))
    near = [{r["id"]: r["vec"] for r in side.collect()} for side in models.fit_als(edges, 3, 0.2, 3, 5)]
    assert not calls
    monkeypatch.setattr(models, "MAX_FIXED_BYTES", 0)
    far = [{r["id"]: r["vec"] for r in side.collect()} for side in models.fit_als(edges, 3, 0.2, 3, 5)]
    assert len(calls) == 6
    for a, b in zip(near, far, strict=True):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-3, abs=1e-5) for k in a)


@pytest.mark.parametrize("fit", ["svd", "nmf"])
def test_rounds_save_no_table(spark, monkeypatch, fit):
    """Tables are saved before the first round and after the last only; cut keys give the sums of whole ones."""
    from marquetry.operators import rounds as mapped_rounds

    monkeypatch.setattr(mapped_rounds, "EDGES_PER_STRETCH", 5)
    edges, counts, found = edges_of(spark, matrix()), [], []
    for turns in (1, 3):
        saved, losses = [], []
        save = lambda df: saved.append(1) or df.localCheckpoint()  # noqa: E731,B023
        if fit == "svd":
            found.append(models.truncated_svd(edges, 2, rounds=turns, tolerance=0.0, save=save)[0])
        else:
            models.fit_nmf_edges(edges, 2, rounds=turns, seed=3, save=save, losses=losses)
            found.append(np.array(losses))
        counts.append(len(saved))
    assert counts[0] == counts[1]
    monkeypatch.setattr(models, "MAX_FIXED_BYTES", 0)
    if fit == "svd":
        assert found[1] == pytest.approx(models.truncated_svd(edges, 2, rounds=3, tolerance=0.0)[0], rel=1e-9)
    else:
        models.fit_nmf_edges(edges, 2, rounds=3, seed=3, losses=(far := []))
        assert found[1] == pytest.approx(np.array(far), rel=1e-9)
