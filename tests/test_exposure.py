"""Mergeable top-k boundaries, inclusion, coverage and concentration of factor models against a plain cross join."""

import random

import numpy as np
import pytest

from marquetry.operators import exposure


def brute(users, items, excluded, k):
    """Per user: the boundary and each item's chance, by sorting all candidates."""
    edges, chances = {}, {}
    for u, vec in users:
        scored = [(sum(a * b for a, b in zip(vec, v, strict=True)) + bias, i) for i, v, bias in items if (u, i) not in excluded]
        if not scored:
            continue
        selected = min(k, len(scored))
        threshold = sorted((s for s, _ in scored), reverse=True)[selected - 1]
        above, tied = sum(s > threshold for s, _ in scored), sum(s == threshold for s, _ in scored)
        p = (selected - above) / tied
        edges[u] = (len(scored), selected, threshold, above, tied, p)
        for s, i in scored:
            if s >= threshold:
                chances[u, i] = 1.0 if s > threshold else p
    return edges, chances


def tables(spark, seed, n_users=23, n_items=41, biased=True):
    rng = random.Random(seed)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]  # noqa: E731  whole numbers: many exact ties
    users = [(u * 3, vec()) for u in range(n_users)]
    items = [(i * 2 + 1, vec(), float(rng.randint(0, 1)) if biased else 0.0) for i in range(n_items)]
    excluded = {(u, i) for u, _ in users for i, _, _ in items if rng.random() < 0.2} | {(users[0][0], i) for i, _, _ in items} | {(users[1][0], i) for i, _, _ in items[3:]}
    u = spark.createDataFrame(users, "user_id long, vec array<float>")
    i = spark.createDataFrame(items, "item_id long, vec array<float>, bias float")
    return users, items, excluded, (u, i if biased else i.drop("bias"), spark.createDataFrame(sorted(excluded) + [(users[2][0], 999_999)], "user_id long, item_id long"))


@pytest.mark.parametrize("k", [1, 7, 60])
@pytest.mark.parametrize("per_block", [4, 8192])
def test_boundaries_and_exposure_equal_a_cross_join(spark, monkeypatch, k, per_block):
    monkeypatch.setattr(exposure, "ITEMS_PER_BLOCK", per_block)
    monkeypatch.setattr(exposure, "USERS_PER_BLOCK", 5 if per_block == 4 else 1024)
    monkeypatch.setattr(exposure, "BLOCKS_PER_TURN", 3)
    users, items, excluded, frames = tables(spark, k, biased=k != 7)
    edges, chances = brute(users, items, excluded, k)
    found = exposure.top_k_boundaries(*frames, k).collect()
    got = {r["user_id"]: tuple(r)[1:] for r in found}
    assert len(found) == len(got) and got == edges
    assert users[0][0] not in got  # nothing is left for it
    shown = exposure.factor_exposure(*frames, k)
    rows = {r["item_id"]: (r["exposure"], r["missed"]) for r in shown.collect()}
    by_item = {}
    for (_, i), p in chances.items():
        by_item.setdefault(i, []).append(p)
    assert rows.keys() == by_item.keys()
    for i, p in by_item.items():
        assert rows[i] == pytest.approx((sum(p), np.prod([1 - x for x in p])))
    want = sum(1 - np.prod([1 - x for x in p]) for p in by_item.values())
    assert exposure.exposure_coverage(shown, len(items)).first()["coverage"] == pytest.approx(want / len(items))
    top = [items[j][0] for j in range(0, len(items), 5)]
    share = sum(p for (_, i), p in chances.items() if i in top) / sum(chances.values())
    marked = spark.createDataFrame([(i,) for i in top + top], "item_id long")
    assert exposure.exposure_concentration(shown, marked).first()[0] == pytest.approx(share)


def test_levels_merge_in_any_order():
    rng = np.random.default_rng(1)
    for k in (1, 5, 40):
        scores = rng.integers(0, 30, 500).astype(float)
        whole = exposure.TopLevels(k)
        whole.update(scores)
        for _ in range(20):
            parts = np.split(rng.permutation(scores), np.sort(rng.integers(0, 500, 6)))
            tops = []
            for p in parts:
                tops.append(exposure.TopLevels(k))
                tops[-1].update(p)
            while len(tops) > 1:
                a = tops.pop(int(rng.integers(len(tops))))
                tops[int(rng.integers(len(tops)))].merge(a)
            assert tops[0].boundary() == whole.boundary() and tops[0].candidates == 500
            assert tops[0].counts.sum() - tops[0].counts[-1] < k  # no level more than needed


def test_levels_refuse_what_they_cannot_rank():
    with pytest.raises(ValueError, match="positive"):
        exposure.TopLevels(0)
    with pytest.raises(ValueError, match="no candidates"):
        exposure.TopLevels(3).boundary()
    with pytest.raises(ValueError, match="finite"):
        exposure.TopLevels(3).update(np.array([1.0, np.nan]))


def test_exposure_of_nobody(spark):
    _, _, _, (users, items, excluded) = tables(spark, 3)
    assert exposure.top_k_boundaries(users.limit(0), items, excluded, 5).collect() == []
    shown = exposure.factor_exposure(users.limit(0), items, excluded, 5)
    assert exposure.exposure_coverage(shown, 41).first()["coverage"] == 0.0
    assert exposure.exposure_concentration(shown, items).first()[0] is None


@pytest.mark.parametrize("biased", [True, False])
def test_a_mounted_catalogue_is_mapped_and_another_joined(spark, monkeypatch, biased):
    """Both ways give the same; where the folder is mounted no block of users is joined to blocks of items."""
    _, _, _, frames = tables(spark, 11, biased=biased)
    rows = lambda df: sorted(map(tuple, df.collect()))
    with monkeypatch.context() as m:
        m.setattr(exposure.arrays, "mounted", lambda spark: None)
        m.setattr(exposure, "ITEMS_PER_BLOCK", 6)
        edges, shown = rows(exposure.top_k_boundaries(*frames, 5)), rows(exposure.factor_exposure(*frames, 5))
    monkeypatch.setattr(exposure, "_blocks", None)
    assert rows(exposure.top_k_boundaries(*frames, 5)) == edges
    found = rows(exposure.factor_exposure(*frames, 5))
    assert [r[0] for r in found] == [r[0] for r in shown]
    assert np.array([r[1:] for r in found]) == pytest.approx(np.array([r[1:] for r in shown]))


def test_a_sweep_over_blocks_finds_the_levels_of_single_users():
    """Products of matrices and exact sums together give the levels of factor-by-factor scores, near ties included."""
    rng = np.random.default_rng(4)
    users = rng.standard_normal((37, 16)).astype(np.float32)
    items = np.repeat(rng.standard_normal((60, 16)).astype(np.float32), 5, axis=0)[rng.permutation(300)]
    items[::7] *= np.float32(1 + 1e-7)
    bias, low = np.zeros(300, np.float32), exposure._Tops(37, 9)
    slack = exposure._slack(users, *exposure._extent(items, bias))
    for a in range(0, 300, 32):
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        for u, _, scores in exposure._reaching(users, items[a : a + 32], bias[a : a + 32], none, low.floor, slack, 9):
            low.add(u, scores)
    for u in range(37):
        top = exposure.TopLevels(9)
        top.update(exposure._paired(np.repeat(users[u : u + 1], 300, axis=0), items, bias))
        assert top.levels.tolist() == low.levels[low.who == u].tolist() and top.counts.tolist() == low.counts[low.who == u].tolist()


@pytest.mark.parametrize("kept", [1 << 20, 3])
def test_exposure_takes_one_pass_over_mapped_items(spark, monkeypatch, kept):
    """No boundaries are made first; with too many ties to keep, users meet the catalogue again."""
    monkeypatch.setattr(exposure, "top_k_boundaries", lambda *a: (_ for _ in ()).throw(AssertionError("a pass of its own")))
    monkeypatch.setattr(exposure, "BLOCK", 7)
    users, items, excluded, frames = tables(spark, 3)
    _, chances = brute(users, items, excluded, 5)
    monkeypatch.setattr(exposure, "MAX_KEPT", kept)
    found = exposure.factor_exposure(*frames, 5).collect()
    want = {}
    for (_, i), p in chances.items():
        a, b = want.get(i, (0.0, 1.0))
        want[i] = (a + p, b * (1 - p))
    assert {r["item_id"] for r in found} == set(want)
    for r in found:
        assert (r["exposure"], r["missed"]) == pytest.approx(want[r["item_id"]])


@pytest.mark.parametrize("kept", [1 << 20, 3])
def test_kept_pairs_and_a_second_meeting_agree(monkeypatch, kept):
    monkeypatch.setattr(exposure, "MAX_KEPT", kept)
    rng = np.random.default_rng(5)
    scores, calls = rng.integers(0, 4, (6, 30)).astype(np.float32), []

    def sweep(low, k=0):
        calls.append(k)
        for a in range(0, 30, 10):
            u, i = np.nonzero(scores[:, a : a + 10] >= low[:, None])
            yield u, i + a, scores[u, i + a]

    sums = np.zeros(30), np.ones(30)
    exposure._swept_once(sweep, np.arange(6), np.full(6, 30), 5, sums)
    edge = np.sort(scores, axis=1)[:, -5]
    above, tied = (scores > edge[:, None]).sum(axis=1), (scores == edge[:, None]).sum(axis=1)
    p = np.where(scores > edge[:, None], 1.0, np.where(scores == edge[:, None], ((5 - above) / tied)[:, None], 0.0))
    assert sums[0] == pytest.approx(p.sum(axis=0)) and sums[1] == pytest.approx((1 - p).prod(axis=0))
    assert calls == ([5] if kept > 3 else [5, 0])


def test_counts_use_the_same_pages_again(monkeypatch):
    """A block's scores are written where the last one's were, and counts are those of single sums with ties and hidden items."""
    import pandas as pd

    from marquetry.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK", 16)
    rng, made, real = np.random.default_rng(2), [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: made.append(k["out"].__array_interface__["data"][0]) or real(*a, **k))
    vectors = rng.integers(-2, 3, (50, 4)).astype(np.float32)  # the last is the bias

    class Held:
        n, width = 50, 4
        ids, rows = staticmethod(lambda: np.arange(50)), staticmethod(lambda: vectors)

    users, hidden = rng.integers(-2, 3, (9, 3)).astype(np.float32), [rng.choice(50, 5, replace=False) for _ in range(9)]
    aims = [int(next(x for x in range(50) if x not in h)) for h in hidden]
    part = pd.DataFrame({"user_id": range(9), "target_item_id": aims, "vec": list(users), "hidden": hidden})
    got = pd.concat(ranking._counted(iter([part]), Held, 3))
    assert len(made) == 4 and len(set(made)) == 1
    scores = users @ vectors[:, :3].T + vectors[:, 3]
    for u, (aim, lost) in enumerate(zip(aims, hidden, strict=True)):
        rest = np.delete(scores[u], lost)
        assert (got["strictly_above"].iloc[u], got["tied_block_size"].iloc[u]) == ((rest > scores[u, aim]).sum(), (rest == scores[u, aim]).sum())
