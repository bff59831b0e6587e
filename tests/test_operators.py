"""Golden values, permutation invariance and independent recomputation of the operators."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquetry.functions import contracts, hashing, scalars
from marquetry.operators import bundles, evaluation, features, interactions, models, moments, prefix, pricing, ranking, splits, statistics


def one(df):
    return df.first().asDict()


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


EDGE = "user_id long, item_id long, playtime_forever double, playtime_2weeks double"


def test_canonical_edges_take_fieldwise_maxima(spark):
    rows = [(20, 200, 0.0, 0.0), (10, 300, 8.0, 1.0), (10, 100, -0.0, 0.0), (20, 200, 5.0, 2.0), (10, 300, 3.0, 4.0)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = values(interactions.canonical_edges(spark.createDataFrame(rows, EDGE)), *interactions.KEYS, *interactions.PLAY)
        assert got == [(10, 100, 0.0, 0.0), (10, 300, 8.0, 4.0), (20, 200, 5.0, 2.0)]


def test_load_audit(spark):
    rows = [("10", "100", 1.0, 0.0), ("10", "100", 5.0, 2.0), ("20", "200", 0.0, 0.0), ("", "300", 1.0, 0.0), ("user-x", "300", 1.0, 0.0), ("30", "", 1.0, 0.0), ("40", "04", 1.0, 0.0), ("bad", "", 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "user_id string, item_id string, playtime_forever double, playtime_2weeks double")
    edges, audit = interactions.load_interactions(frame)
    assert values(edges, *interactions.KEYS, *interactions.PLAY) == [(10, 100, 5.0, 2.0), (20, 200, 0.0, 0.0)]
    a = one(audit)
    assert (a["source_rows"], a["eligible_rows"]) == (8, 3)
    assert [a[f"excluded_{r}"] for r in interactions.REASONS] == [1, 2, 1, 1]
    assert [a[f"flag_{r}"] for r in interactions.REASONS] == [1, 2, 2, 1]
    bad = frame.union(spark.createDataFrame([("", "", float("nan"), 0.0)], frame.schema))
    with pytest.raises(contracts.ContractError):
        interactions.load_interactions(bad)


@pytest.mark.parametrize(("text", "ok"), [("0", True), ("10", True), ("02", False), ("-1", False), ("2.0", False), ("10\n", False), ("9223372036854775807", True), ("9223372036854775808", False), ("٣", False), ("", False), (None, False)])
def test_id_rule(spark, text, ok):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(contracts.is_valid_id(F.col("t"))).first()[0] is ok


def test_flatten_libraries(spark):
    schema = "user_id string, steam_id string, items array<struct<item_id:string,playtime_forever:double,playtime_2weeks:double>>"
    rows = [("20", None, [("3", 1.0, 4.0), ("2", 5.0, 0.0)]), ("", "20", [("3", 7.0, 2.0)]), ("10", None, [("9", 0.0, None)]), ("11", None, [])]
    frame = spark.createDataFrame(rows, schema)
    flat = interactions.flatten_libraries(frame)
    edges = interactions.canonical_edges(flat.select(*[F.col(c).cast("long").alias(c) for c in interactions.KEYS], *interactions.PLAY))
    assert values(edges, *interactions.KEYS, *interactions.PLAY) == [(10, 9, 0.0, 0.0), (20, 2, 5.0, 0.0), (20, 3, 7.0, 4.0)]
    d = one(interactions.source_diagnostics(frame))
    assert (d["records"], d["empty_records"], d["raw_rows"], d["edges"], d["duplicate_excess"], d["users"]) == (4, 1, 4, 3, 1, 2)


def test_stable_hash_equals_the_driver(spark):
    rows = [(3, 'a"b\\c'), (12, "tab\tnew\nline"), (0, "é日")]
    frame = spark.createDataFrame(rows, "i long, s string")
    h = hashing.stable_hash("space", hashing.id_json(F.col("i")), F.col("i").cast("string"), hashing.json_string(F.col("s")), "x", 7)
    for (i, s), r in zip(rows, frame.select(h.alias("h")).collect(), strict=True):
        assert int(r["h"], 16) == hashing.stable_hash_uint64("space", str(i), i, s, "x", 7)
    payload = b"".join(len(p).to_bytes(8, "big") + p for p in (b'"n"\n', b"3\n"))
    assert hashing.stable_hash_uint64("n", 3) == int.from_bytes(hashlib.sha256(payload).digest()[:8], "big")
    assert hashing.stable_hash_uint64("n", 3) != hashing.stable_hash_uint64("n", "3")


def test_hamilton_quotas(spark):
    counts = spark.createDataFrame([(0, 3), (1, 3), (2, 4)], "b long, n long")
    assert values(splits.hamilton_quotas(counts, "b", 5), "b", "quota") == [(0, 2), (1, 1), (2, 2)]
    assert splits.driver_quotas({0: 3, 1: 3, 2: 4}, 5) == {0: 2, 1: 1, 2: 2}
    with pytest.raises(contracts.ContractError):
        splits.hamilton_quotas(counts, "b", 11)


def test_outer_split(spark):
    sizes = {5: 10, 10: 11, 25: 9, 50: 5, 100: 6, 200: 10, 4: 4}
    rows, user = [], 1
    for activity, n in sizes.items():
        for _ in range(n):
            rows.append((user, activity))
            user += 1
    first = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = values(splits.outer_split(spark.createDataFrame(rows, "user_id long, raw_ownership_count long")), "user_id", "activity_band", "split", "assignment_hash")
        first = first or got
        assert got == first
    held = {}
    for _, band, split, _ in first:
        held.setdefault(band, []).append(split)
    for k, n in enumerate((10, 11, 9, 5, 6, 10)):
        assert held[k].count("assessment") == n // 5
    assert held[-1] == ["excluded_low_activity"] * 4


def serial_split(edges, before, after, required, namespace):
    """The scan that the rounds must equal."""
    support = {}
    for _, i in edges:
        support[i] = support.get(i, 0) + 1
    room = {i: n - after for i, n in support.items() if n >= before}
    own = {}
    for u, i in edges:
        if i in room:
            own.setdefault(u, []).append(i)
    h = lambda *x: hashing.stable_hash_uint64(namespace, *map(str, x))
    roles = {}
    for u in sorted((u for u in own if len(own[u]) >= required), key=lambda u: (h("user", u), u)):
        for first in sorted(own[u], key=lambda i: (h("test", u, i), i)):
            if room[first] <= 0:
                continue
            rest = [i for i in sorted(own[u], key=lambda i: (h("validation", u, i), i)) if i != first and room[i] > 0]
            if rest:
                roles[u, first], roles[u, rest[0]] = "test", "validation"
                room[first] -= 1
                room[rest[0]] -= 1
                break
    return roles


@pytest.mark.parametrize(("before", "after"), [(5, 3), (4, 4), (6, 5), (5, 4)])
def test_nested_split_equals_the_scan(spark, before, after):
    rng = random.Random(before * 10 + after)
    edges = sorted({(u, rng.randint(100, 112)) for u in range(1, 31) for _ in range(7)}) + [(1, 999)]
    frame = spark.createDataFrame(edges, "user_id long, item_id long").repartition(3)
    got = {(r["user_id"], r["item_id"]): r for r in splits.nested_split(frame, before, after).collect()}
    want = serial_split(edges, before, after, 3, "edge-split") if any(True for _ in edges) else {}
    assert {k: r["role"] for k, r in got.items() if r["role"] in ("test", "validation")} == want
    assert got[1, 999]["role"] == "excluded_nonwarm_item" and got[1, 999]["item_training_support_after"] is None
    able = {u for u, _ in want}
    for (u, _), r in got.items():
        assert r["evaluable_user"] == (u in able)
        assert r["item_training_support_after"] is None or r["item_training_support_after"] >= after


def test_pseudo_cold_cohort(spark):
    rows, item = [], 1
    for low in (10, 25):
        for genre, n in (("Action", 60), ("Indie", 36), ("Strategy", 24)):
            for _ in range(n):
                rows.append((item, low + item % 3, genre))
                item += 1
    rows.append((item, 12, " "))
    got = splits.pseudo_cold_items(spark.createDataFrame(rows, "item_id long, design_training_support long, primary_genre string"), [(10, 20), (25, 35)], 10).collect()
    assert len(got) == 20 == len({r["item_id"] for r in got})
    assert sorted(r["primary_genre"] for r in got) == ["Action"] * 10 + ["Indie"] * 6 + ["Strategy"] * 4


def test_tie_metrics(spark):
    frame = spark.createDataFrame([(8, 4), (0, 100), (20, 3)], "strictly_above long, tied_block_size long")
    r = ranking.tie_metrics(frame).orderBy("strictly_above").collect()
    assert r[1]["recall_at_10"] == 0.5 and r[1]["recall_at_20"] == 1 and r[1]["expected_rank"] == 10.5
    assert r[1]["ndcg_at_10"] == pytest.approx((1 / math.log2(10) + 1 / math.log2(11)) / 4)
    assert r[0]["recall_at_10"] == pytest.approx(0.1)
    assert r[2]["recall_at_10"] == 0 == r[2]["ndcg_at_10"]


def test_top_k_inclusion_shares_the_boundary(spark):
    rows = [(1, k, s) for k, s in enumerate([5.0, 4.0, 4.0, 4.0, 1.0])] + [(2, k, 1.0) for k in range(4)]
    frame = spark.createDataFrame(rows, "user_id long, item_id long, score double")
    got = {(r["user_id"], r["item_id"]): r["inclusion"] for r in ranking.top_k_inclusion(frame, 3).collect()}
    assert got[1, 0] == 1 and all(got[1, k] == pytest.approx(2 / 3) for k in (1, 2, 3)) and (1, 4) not in got
    assert all(got[2, k] == pytest.approx(0.75) for k in range(4))


def test_coverage_and_concentration(spark):
    rows = [(1, 0, 1.0), (1, 1, 0.5), (1, 2, 0.5), (2, 1, 1.0), (2, 3, 1.0)]
    frame = spark.createDataFrame(rows, "user_id long, item_id long, inclusion double")
    c = one(ranking.expected_coverage(frame, 4))
    assert c["expected_items"] == pytest.approx(3.5) and c["coverage"] == pytest.approx(0.875)
    top = spark.createDataFrame([(0,), (1,)], "item_id long")
    assert one(ranking.concentration(frame, top))["concentration"] == pytest.approx(0.625)


def test_item_score_ties_equal_the_cross_join(spark):
    rng = random.Random(4)
    scores = spark.createDataFrame([(i, float(rng.randint(0, 4))) for i in range(30)], "item_id long, score double")
    targets, hidden = [], []
    for u in range(12):
        items = rng.sample(range(30), 6)
        targets.append((u, items[0]))
        hidden += [(u, i) for i in items[1:]]
    t, h = spark.createDataFrame(targets, "user_id long, target_item_id long"), spark.createDataFrame(hidden, "user_id long, item_id long")
    pairs = ranking.candidates(t, scores, h).join(scores, "item_id")
    columns = ("user_id", "target_item_id", "strictly_above", "tied_block_size")
    assert values(ranking.item_score_ties(scores, t, h), *columns) == values(ranking.tie_counts(pairs, t), *columns)
    whole = values(ranking.top_k_inclusion(pairs, 5), "user_id", "item_id", "inclusion")
    assert whole == values(ranking.item_top_k_inclusion(scores, t.select("user_id"), h, 5), "user_id", "item_id", "inclusion")
    with pytest.raises(contracts.ContractError):
        ranking.tie_counts(pairs.where("score > 10 or item_id > 5").union(pairs), t).count()


def test_factor_tie_counts_equal_scores(spark):
    rng = np.random.default_rng(1)
    items = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(25)]
    users = [(u, [float(x) for x in rng.integers(0, 3, 4)]) for u in range(7)]
    targets = [(u, int(rng.integers(25))) for u in range(7)]
    hidden = [(u, i) for u, t in targets for i in range(0, 25, 6) if i != t]
    f = lambda rows, names: spark.createDataFrame(rows, names)
    t, h = f(targets, "user_id long, target_item_id long"), f(hidden, "user_id long, item_id long")
    got = ranking.factor_tie_counts(f(users, "user_id long, vec array<float>"), f(items, "item_id long, vec array<float>"), t, h, 3)
    scores = f([(u, i, float(np.dot(a, b))) for u, a in users for i, b in items if (u, i) not in set(hidden)], "user_id long, item_id long, score double")
    columns = ("user_id", "target_item_id", "strictly_above", "tied_block_size")
    assert values(got, *columns) == values(ranking.tie_counts(scores, t), *columns)
    assert all(len(r["shown"]) == 3 for r in got.collect())


def test_midrank_and_zscore(spark):
    frame = spark.createDataFrame([(1, k, s) for k, s in enumerate([2.0, 1.0, 2.0, 5.0])] + [(2, k, 7.0) for k in range(3)], "user_id long, item_id long, score double")
    got = {(r["user_id"], r["item_id"]): r["midrank"] for r in ranking.within_user_midrank(frame).collect()}
    assert [got[1, k] for k in range(4)] == [0.5, 0.125, 0.5, 0.875] and got[2, 0] == 0.5
    z = {(r["user_id"], r["item_id"]): r["zscore"] for r in ranking.user_zscore(frame).collect()}
    assert z[1, 1] == 0 and z[1, 3] > 0 and z[2, 0] == 0


def test_selection_admission_and_bootstrap(spark):
    board = spark.createDataFrame([("a", "x", s, 0.5, 0.5, 10, 2) for s in (1, 2)] + [("a", "y", s, 0.5, 0.6, 99, 4) for s in (1, 2)], "family string, configuration_id string, training_seed long, mean_ndcg_at_20 double, mean_recall_at_20 double, parameter_count long, factors int")
    assert one(evaluation.select_configuration(board, 2))["configuration_id"] == "y"
    with pytest.raises(contracts.ContractError):
        evaluation.select_configuration(board.where("training_seed = 1"), 2)
    b = evaluation.bootstrap_interval([0.1] * 50)
    assert b["lower"] == pytest.approx(0.1) == b["upper"]
    small, large = (evaluation.bootstrap_interval(np.linspace(-1, 1, 101), budget=n) for n in (1 << 12, 1 << 26))
    assert small == large and small["lower"] < 0 < small["upper"]
    bad, good = {"ndcg_lower": -0.1, "recall_difference": 0, "mean_ndcg": 0.2}, {"ndcg_lower": 0.0, "recall_difference": -0.01, "mean_ndcg": 0.1}
    assert evaluation.admission({"p": bad, "q": good}) == {"families": ["q"], "override": False}
    assert evaluation.admission({"p": bad}) == {"families": ["p"], "override": True}


def test_features(spark):
    rows = [(10, ["RPG", "Action", "Action"]), (20, None), (100, ["Design &amp;  Illustration"])]
    frame = spark.createDataFrame(rows, "item_id long, labels array<string>")
    got = values(features.label_features(frame, clean=True), "item_id", "feature_name", "weight")
    assert got == [(10, "genre::Action", 0.5), (10, "genre::RPG", 0.5), (100, "genre::Design & Illustration", 1.0)]
    assert features.validate_features(features.item_features(frame)).count() == 6
    assert scalars.normalize_label(" ﬁne&nbsp;x ") == "fine x"


def test_prices(spark):
    cases = [("$73.86", 73.86), ("Free To Play", 0.0), ("", 0.0), ("-5", 5.0), ("N/A", None), (None, None)]
    frame = spark.createDataFrame(cases, "t string, want double").withColumn("got", scalars.parse_price(F.col("t")))
    assert all(r["got"] == r["want"] for r in frame.collect())
    rates = spark.createDataFrame([("10%", 0.1), ("1%", 1.0), ("0.25", 0.25), ("x", None)], "t string, want double").withColumn("got", scalars.parse_discount(F.col("t")))
    assert all(r["got"] == r["want"] for r in rates.collect())


def test_confidence_and_links(spark):
    frame = spark.createDataFrame([(0.0,), (10.0,), (1e9,)], "t double")
    got = [r[0] for r in frame.select(scalars.observed_confidence(F.col("t"), 20.0, 4.0, 3.0)).collect()]
    assert got == pytest.approx([21, 21 + 4 * math.log1p(10), 33])
    back = spark.createDataFrame([(0.1,), (0.5,), (0.93,)], "r double").select("r", scalars.normal_cdf(scalars.probit("r")).alias("p"), scalars.logistic(scalars.logit(F.col("r"))).alias("l"))
    assert all(r["p"] == pytest.approx(r["r"]) and r["l"] == pytest.approx(r["r"]) for r in back.collect())


def test_bundle_containment(spark):
    edges = spark.createDataFrame([(1, 10, 2.0, 0.0), (1, 11, 4.0, 0.0), (2, 10, 1.0, 0.0)], EDGE)
    items = spark.createDataFrame([(7, 10), (7, 11), (8, 10), (9, 10), (9, None), (6, 99)], "bundle_id long, item_id long")
    got = {r["bundle_id"]: r for r in bundles.demand_proxy(edges, items).collect()}
    assert (got[7]["users_own_all"], got[7]["users_own_any"], got[7]["avg_playtime_overlap"]) == (1, 2, 3.5)
    assert (got[8]["users_own_all"], got[9]["users_own_all"], got[9]["n_bundle_items"]) == (2, 0, 2)
    assert (got[6]["items_in_panel"], got[6]["panel_coverage"], got[6]["avg_playtime_overlap"]) == (0, 0.0, None)
    assert values(bundles.user_candidates(edges, items), "user_id", "bundle_id") == [(1, 7), (1, 8), (2, 8)]
    assert values(bundles.overlap_pairs(items), "first", "second", "shared_items") == [(7, 8, 1), (7, 9, 1), (8, 9, 1)]


def test_attribution_shares_ties(spark):
    items = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 50)], "bundle_id long, item_id long")
    candidates = spark.createDataFrame([(u, b) for u in (1, 2) for b in (1, 2)] + [(1, 3)], "user_id long, bundle_id long")
    comps = bundles.user_components(candidates, items)
    assert values(comps, "user_id", "component") == [(1, [1, 2]), (1, [3]), (2, [1, 2])]
    cents = spark.createDataFrame([(1, 150), (2, 150), (3, 500)], "bundle_id long, cents long")
    solo = spark.createDataFrame([(10, 100), (11, 100), (12, 100), (50, 100)], "item_id long, cents long")
    got = {r["bundle_id"]: r for r in bundles.mincost_attribution(comps, items, cents, solo).collect()}
    assert got[1]["mincost_attributed_count"] == pytest.approx(1.0) and got[2]["candidate_users_with_overlap"] == 2
    assert got[3]["mincost_attributed_count"] == 0 and 0 < got[3]["soft_tau_2"] < 0.5


def test_cover_equals_enumeration():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randint(1, 6)
        sets = [rng.sample(range(7), rng.randint(1, 4)) for _ in range(n)]
        solo, prices = {i: rng.choice([100, 200, 300]) for i in range(7)}, [rng.choice([100, 250, 400]) for _ in range(n)]
        every = {i for s in sets for i in s}
        costs = {}
        for m in range(1 << n):
            got = {i for k in range(n) if m >> k & 1 for i in sets[k]}
            costs[m] = sum(prices[k] for k in range(n) if m >> k & 1) + sum(solo[i] for i in every - got)
        low = min(costs.values())
        best = [m for m, c in costs.items() if c == low]
        w = {m: math.exp(-(c - low) / 100 / 0.5) for m, c in costs.items()}
        hard, soft, count = bundles.cover_shares(prices, sets, solo, [0.5])
        assert count == len(best) and low == bundles.brute_cover(prices, sets, solo)
        for k in range(n):
            assert hard[k] == pytest.approx(sum(m >> k & 1 for m in best) / len(best))
            assert soft[0.5][k] == pytest.approx(sum(v for m, v in w.items() if m >> k & 1) / sum(w.values()))


def test_audit(spark):
    catalogue = spark.createDataFrame([(i, "P", d) for i, d in ((1, "D1"), (2, "D1"), (3, "D2"), (4, "D2"))], "item_id long, publisher string, developer string")
    parts = [(20, i, "0" if i == 1 else "2.5") for i in (1, 2, 3, 4)] + [(20, 77, "1"), (3, 1, "1"), (3, 78, " "), (3, None, None), (11, 79, "1"), (11, 80, "2")]
    got = {r["bundle_id"]: r for r in bundles.bundle_audit(spark.createDataFrame(parts, "bundle_id long, item_id long, price string"), catalogue).collect()}
    a = got[20]
    assert (a["n_items"], a["n_items_in_catalogue"], a["catalogue_coverage"], a["mechanism_class"], a["confidence"]) == (5, 4, 0.8, "B_SBA_like", "high")
    assert a["publisher_coherent"] and not a["developer_coherent"]
    assert (got[3]["n_missing_item_id"], got[3]["mechanism_class"], got[3]["confidence"]) == (1, "E_unclear", "low")
    assert got[11]["evidence"].startswith("no components found")


def test_table_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "k long, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", None), (4, "z", 2)], "k long, s string, n int")
    assert values(bundles.table_diff(a, b, "k"), "k", "status", "fields") == [(2, "changed", "s,n"), (3, "missing", ""), (4, "extra", "")]


def panel(spark, matrix):
    return spark.createDataFrame([(u, i, float(v)) for u, row in enumerate(matrix) for i, v in enumerate(row)], "user_id long, item_id long, v double")


def test_panel_golden_values(spark):
    p = panel(spark, [[3, 1, 2], [5, 0, 1]])
    assert values(pricing.top_sums(p, [1, 2, 3]), "user_id", "size", "w") == [(0, 1, 3.0), (0, 2, 5.0), (0, 3, 6.0), (1, 1, 5.0), (1, 2, 6.0), (1, 3, 6.0)]
    m = {(r["size_a"], r["size_b"]): r for r in pricing.moments(p, [1, 2, 3]).collect()}
    w = np.array([[3, 5, 6], [5, 6, 6]], float)
    for a in range(3):
        for b in range(a, 3):
            assert m[a + 1, b + 1]["sigma"] == pytest.approx(np.cov(w.T, ddof=1)[a, b])
    assert one(pricing.evaluate_menu(panel(spark, [[10, 1], [3, 2], [1, 0.5]]), [4, 7], [1, 2]))["profit"] == pytest.approx(4 / 3)
    assert one(pricing.user_choices(pricing.top_sums(panel(spark, [[6, 2]]), [1, 2]), pricing.menu_table(p, [2, 4], [1, 2])))["price"] == 2
    v = panel(spark, [[4, 6], [2, 1]])
    assert one(pricing.separate_selling(v))["profit"] == 5 and one(pricing.pure_bundling(v))["profit"] == 5 and one(pricing.pure_bundling(v, 4))["profit"] == 3
    assert pricing.size_costs(0.5, [1, 2, 4]) == [0.5, 1, 2]


def test_fixed_bundle_by_hand(spark):
    p = panel(spark, [[10, 2], [2, 10]])
    prices = pricing.component_prices(p)
    assert one(pricing.separate_selling(p))["profit"] == 10
    scan = one(pricing.fixed_bundle_scan(pricing.bundle_thresholds(p, prices, p.select("item_id").distinct())))
    assert (scan["price"], scan["buyers"], scan["gain"]) == (12.0, 2, 2.0)


def test_menu_search_equals_numpy(spark):
    rng = np.random.default_rng(3)
    matrix = rng.gamma(2.0, 1.0, (40, 3))
    sums = np.cumsum(-np.sort(-matrix, axis=1), axis=1)
    menus = [[1.0, 2.0, 3.0], [2.0, 3.5, 4.5], [5.0, 5.0, 5.0]]
    got = {r["menu"]: r["profit"] for r in pricing.menu_search(panel(spark, matrix), menus, [1, 2, 3], 0.2).collect()}
    for k, menu in enumerate(menus):
        assert got[k] == pytest.approx(moments.realised_profit(sums, np.array(menu), [1, 2, 3], np.array([0.2, 0.4, 0.6])))
    found = moments.search_menu(sums, [1, 2, 3], 0.2, start=menus[0], rounds=30)
    assert found["profit"] >= got[0]


def test_cross_moment_optimum():
    omega, sigma = [4.0, 6.5], np.array([[1.0, 0.8], [0.8, 2.0]])
    model = moments.CrossMoment(omega, sigma, [1, 2], 0.5)
    best = model.optimum()
    grid = model.brute_force(60)
    assert best["profit"] >= grid["profit"] - 1e-6 and best["roundtrip"] < 1e-3
    assert best["profit"] == pytest.approx(grid["profit"], rel=2e-2)
    assert model.softmax_optimum()["profit"] == pytest.approx(best["profit"], rel=1e-4)
    alone = moments.CrossMoment([4.0], np.array([[1.0]]), [1], 0.5)
    assert alone.demand([3.0])[0] == pytest.approx(moments.single_demand(4.0, 1.0, 3.0), abs=1e-5)
    assert alone.single_size()["best"]["profit"] == pytest.approx(alone.optimum()["profit"], rel=1e-6)
    with pytest.raises(moments.NumericalError):
        moments.CrossMoment([1.0, 1.0], np.array([[1.0, 2.0], [2.0, 1.0]]), [1, 2])
    for method in ("sample", "ridge", "ledoit_wolf"):
        c, info = moments.covariance(np.random.default_rng(0).normal(size=(60, 3)), method)
        assert np.linalg.eigvalsh(c).min() > 0 and info["m"] == 3


def test_least_squares_equals_dense(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=80) * (1 + np.abs(x[:, 0]))
    frame = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    fit = statistics.ols(frame, "y", ["a", "b"])
    design = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    inverse = np.linalg.inv(design.T @ design)
    residual = y - design @ beta
    lever = np.einsum("ij,jk,ik->i", design, inverse, design)
    robust = inverse @ (design.T * (residual / (1 - lever)) ** 2) @ design @ inverse
    assert fit["beta"] == pytest.approx(beta) and fit["se"] == pytest.approx(np.sqrt(np.diag(robust)))
    assert fit["r2"] == pytest.approx(1 - (residual**2).sum() / ((y - y.mean()) ** 2).sum())


def test_calibrations(spark):
    q = [float(k) for k in range(8)]
    exact = one(statistics.quantile_calibration(spark.createDataFrame([(k, 5 + 30 * k) for k in q], "quantile double, price double")))
    assert exact["a"] == pytest.approx(5) and exact["b"] == pytest.approx(30) and exact["valid"]
    scores = spark.createDataFrame([(g, float(k)) for g in range(3) for k in range(100)], "item_id long, score double")
    rates = spark.createDataFrame([(0, 0.1), (1, 0.5), (2, 0.9)], "item_id long, rate double")
    got = dict(values(statistics.group_quantiles(scores, rates), "item_id", "quantile"))
    assert [got[k] for k in range(3)] == pytest.approx([np.quantile(np.arange(100), 1 - r) for r in (0.1, 0.5, 0.9)])
    rng = np.random.default_rng(5)
    rows = [(float(s), float(p), 1 / (1 + math.exp(-(1 + 2 * s - p) / 0.7))) for s, p in zip(rng.normal(size=30), rng.uniform(0, 3, 30), strict=True)]
    fit = statistics.aggregate_calibration(spark.createDataFrame(rows, "mean_score double, price double, obs_rate double"), 10**9, "logit")
    assert (fit["a"], fit["b"], fit["sigma"]) == pytest.approx((1, 2, 0.7), rel=1e-4)
    rank = one(statistics.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 9.0)], "x double, y double"), "x", "y"))
    assert rank["spearman"] == pytest.approx(0.8660254)


def test_als_normal_equations_and_descent(spark):
    owned = [[1, 0, 1, 0], [0, 1, 0, 0], [1, 0, 0, 1]]
    rows = [(u, i, 3.0 + u) for u, r in enumerate(owned) for i, x in enumerate(r) if x]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, confidence double")
    items = models.initial_factors(edges, "item_id", 2, 7, 0.5)
    users = models.half_step(edges, "user_id", "item_id", items, 0.3)
    v = {r["id"]: np.array(r["vec"], float) for r in items.collect()}
    for r in users.collect():
        c = np.array([3.0 + r["id"] if owned[r["id"]][i] else 1.0 for i in range(4)])
        p = np.array(owned[r["id"]], float)
        f = np.array([v[i] for i in range(4)])
        want = np.linalg.solve((f.T * c) @ f + 0.3 * np.eye(2), f.T @ (c * p))
        assert np.array(r["vec"]) == pytest.approx(want, rel=1e-4)
    losses = []
    for n in (1, 3):
        u, i = models.fit_als(edges, 2, 0.3, n, 7)
        losses.append(models.als_objective(edges, u, i, 0.3))
    assert losses[1] <= losses[0] + 1e-6
    assert {r["id"] for r in models.fold_in_als(edges.where("user_id = 0"), i).collect()} == {0}


def test_als_beyond_the_fixed_side_limit(spark, monkeypatch):
    rows = [(u, i, 2.0) for u in range(6) for i in range(u % 3, 8, 2)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, confidence double")
    items = models.initial_factors(edges, "item_id", 3, 1, 0.5)
    near = {r["id"]: r["vec"] for r in models.half_step(edges, "user_id", "item_id", items, 0.1).collect()}
    monkeypatch.setattr(models, "MAX_FIXED_BYTES", 0)
    for r in models.half_step(edges, "user_id", "item_id", items, 0.1).collect():
        assert r["vec"] == pytest.approx(near[r["id"]], rel=1e-4)


def test_bpr_gradient_and_fold_in():
    rng = np.random.default_rng(1)
    p, q, b = rng.normal(size=(3, 2)), rng.normal(size=(4, 2)), rng.normal(size=4)
    triples = np.array([[0, 1, 2], [1, 0, 3], [2, 2, 1]])
    loss, gp, gq, gb = models.bpr_gradient(p, q, b, triples, 0.01)
    for x, g in ((p, gp), (q, gq), (b, gb)):
        k = (0,) * x.ndim
        x[k] += 1e-6
        up = models.bpr_gradient(p, q, b, triples, 0.01)[0]
        x[k] -= 1e-6
        assert (up - loss) / 1e-6 == pytest.approx(g[k], abs=1e-4)
    loss, gp, gq, gb = models.bpr_gradient(p, q, b, triples, 0.0)
    sums = models.bpr_sums(p, q, b, triples)
    for mine, mean in zip(sums, (loss, gp, gq, gb), strict=True):
        assert np.asarray(mine) / 3 == pytest.approx(np.asarray(mean))
    negatives = models.fold_in_negatives([0, 1], 4, "c", 9)
    assert not set(negatives) & {0, 1} and negatives == models.fold_in_negatives([0, 1], 4, "c", 9)
    x = models.fold_in_bpr([0, 1], negatives, q, b, 0.1)
    assert np.abs(x).max() < 100


@pytest.mark.parametrize("small", [False, True])
def test_bpr_fit_equals_numpy(spark, monkeypatch, small):
    if small:  # many groups, whose gradients are summed in two steps, and ranges of few items
        for name, value in (("EDGES_PER_TURN", 4), ("FAN", 2), ("ITEMS_PER_RANGE", 2)):
            monkeypatch.setattr(models, name, value)
    rng = np.random.default_rng(6)
    rows = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 12, 60), rng.integers(0, 9, 60), strict=True)})
    edges = spark.createDataFrame([(10 * u, 100 + i) for u, i in rows], "user_id long, item_id long")
    labels = [(100 + i, f"genre::{i % 3}", 0.5) for i in range(9)]
    features_ = spark.createDataFrame(labels, "item_id long, feature_name string, weight double")
    losses = []
    users, items = models.fit_bpr(edges, features_, 4, 0.01, 0.1, epochs=3, rounds=1, save=lambda df: df.checkpoint(), losses=losses)
    # The same rounds in one process, group by group with the same draws, by scattered sums.
    group = {r["user_id"]: r["g"] for r in edges.select("user_id", F.pmod(F.xxhash64("user_id", F.lit(5)), F.lit(max(len(rows) // models.EDGES_PER_TURN, spark.sparkContext.defaultParallelism))).alias("g")).collect()}
    ids = sorted({100 + i for _, i in rows})
    seed, n = 104_729, len(rows)
    q, bias = np.stack([0.01 * np.random.default_rng(models.namespaced_seed(seed, "item", i)).standard_normal(4) for i in ids]), np.zeros(len(ids))
    f = 0.01 * np.random.default_rng(models.namespaced_seed(seed, "features")).standard_normal((3, 4))
    w = np.array([[0.5 * (i % 3 == k) for k in range(3)] for i in range(9) if 100 + i in ids])
    names = sorted({10 * u for u, _ in rows})
    p = np.stack([0.01 * np.random.default_rng(models.namespaced_seed(seed, "user", u)).standard_normal(4) for u in names])
    seen = [np.full_like(x, 1e-8) for x in (p, q, bias, f)]
    for turn in range(3):
        triples = []
        for g in sorted(set(group.values())):
            own = [(10 * u, 100 + i) for u, i in rows if group[10 * u] == g]
            mine = sorted({u for u, _ in own})
            u, i = np.array([mine.index(a) for a, _ in own]), np.array([ids.index(b) for _, b in own])
            j = models._own_draws(u, i, len(ids), models.namespaced_seed(seed, "draws", turn, g))
            assert not {(a, b) for a, b in zip(u.tolist(), j.tolist(), strict=True)} & set(zip(u.tolist(), i.tolist(), strict=True))
            triples += [(names.index(mine[a]), b, c) for a, b, c in zip(u, i, j, strict=True)]
        loss, gp, gv, gb = models.bpr_gradient(p, q + w @ f, bias, np.array(triples), 0.0)
        assert losses[turn] == pytest.approx(loss, rel=1e-5)
        for x, g, s in zip((p, q, bias, f), (gp, gv, gb, w.T @ gv), seen, strict=True):
            g = g + 0.01 * x
            s += g * g
            x -= 0.1 * g / np.sqrt(s)
    got = {r["id"]: r["vec"] for r in users.collect()}
    assert all(got[u] == pytest.approx(p[k], rel=1e-3, abs=1e-5) for k, u in enumerate(names))
    for r in items.collect():
        k = ids.index(r["item_id"])
        assert r["vec"] == pytest.approx((q + w @ f)[k], rel=1e-3, abs=1e-5) and r["bias"] == pytest.approx(bias[k], rel=1e-3, abs=1e-5)
    folded = models.fold_in_bpr_users(edges.where("user_id < 30"), items).collect()
    assert {r["id"] for r in folded} == {u for u in names if u < 30}


def test_pulls_of_a_round_are_small(tmp_path):
    """An edge or draw gives a few bytes to its item's range, not a vector; an item with many edges in a group gives one sum."""
    n_items, k, rng = 3000, 16, np.random.default_rng(5)
    pairs = np.unique(np.r_[rng.integers(0, 200 * n_items, 4000), np.arange(200) * n_items + 7])
    u, i = pairs // n_items, pairs % n_items
    rule = models._Pairwise(len(u), n_items, k, 0.0, 0.1, 1.0, 3, 4, 2)
    p, v = (rng.normal(size=(n, w)).astype(np.float32) for n, w in ((200, k), (n_items, k + 1)))
    out = rule.pulls(0, u, i, 0, v, p, np.full(p.shape, 1e-8), str(tmp_path))
    rows = out[out["kind"] == "pull"]
    assert rows["c"].tolist() == [0, 1, 2, 3] and sum(len(x) for x in rows["heavy"]) == 2  # item 7 alone
    assert sum(len(x) for c in ("light", "users", "gained") for x in rows[c]) <= 8 * 2 * len(u)
    triples = np.stack([u, i, rule.draws(u, i, 0, 0)], axis=1)
    _, _, want, bias = models.bpr_sums(p.astype(float), v[:, :k].astype(float), v[:, k].astype(float), triples)
    got = np.zeros((n_items, k + 1))
    for r in rows.itertuples():
        first = rule.bounds(r.c)[0]
        got[first + np.frombuffer(r.heavy, np.uint16)] += np.frombuffer(r.sums, np.float32).reshape(-1, k + 1)
        gained, mine = np.frombuffer(r.gained, np.float32), p[np.frombuffer(r.users, np.uint8)]
        np.add.at(got, first + np.frombuffer(r.light, np.uint16).astype(int), np.c_[mine * gained[:, None], gained])
    assert np.allclose(got, np.c_[want, bias], rtol=1e-3, atol=1e-4)


def test_mapped_and_joined_fits_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = sorted({(int(u), int(i)) for u, i in rng.integers(0, 12, (60, 2))})
    edges = spark.createDataFrame(rows, "user_id long, item_id long")
    labels = spark.createDataFrame([(i, f"genre::{i % 3}", 0.5) for i in range(0, 12, 2)], "item_id long, feature_name string, weight double")
    made = []
    for most in (models.MAX_MAPPED_BYTES, 0):
        monkeypatch.setattr(models, "MAX_MAPPED_BYTES", most)
        users, items, names = models.fit_bpr_parts(edges, labels, 3, epochs=1, rounds=2)
        made.append([{r[0]: list(r[1]) + list(r[2:]) for r in t.collect()} for t in (users, items, names)])
    for mapped, joined in zip(*made, strict=True):
        assert mapped.keys() == joined.keys() and all(mapped[k] == pytest.approx(joined[k], rel=1e-3, abs=1e-5) for k in mapped)


def test_als_cuts_keys_over_tasks(spark):
    """A popular item's edges lie in several tasks; partial sums give the same factors."""
    rows = [(u, 0, 2.0 + u % 3) for u in range(300)] + [(u, 1 + u % 5, 3.0) for u in range(300)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, confidence double")
    users = models.initial_factors(edges, "user_id", 3, 1, 0.5)
    laid = models.dealt_by(edges, "item_id", lambda df: df)
    assert laid.rdd.getNumPartitions() > 1
    v = {r["id"]: np.array(r["vec"], float) for r in users.collect()}
    gram = sum(np.outer(x, x) for x in v.values())
    for r in models.half_step(laid, "item_id", "user_id", users, 0.1).collect():
        own = [(u, c) for u, i, c in rows if i == r["id"]]
        left = gram + 0.1 * np.eye(3) + sum((c - 1) * np.outer(v[u], v[u]) for u, c in own)
        assert r["vec"] == pytest.approx(np.linalg.solve(left, sum(c * v[u] for u, c in own)), rel=1e-4)


def test_json_strings_escape_every_control_character(spark):
    every = "".join(map(chr, range(32))) + '"\\é'
    frame = spark.createDataFrame([(every,), ("plain",)], "t string")
    got = [r[0] for r in frame.select(hashing.json_string(F.col("t"))).collect()]
    assert [f"{g}\n".encode() for g in got] == [hashing.canonical_json_bytes(every), hashing.canonical_json_bytes("plain")]


def test_numbers_and_quantiles_by_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.randint(0, 50), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "g long, v long, k long").repartition(5)
    got = {r["k"]: r["_nth"] for r in prefix.nth_within(frame, ["g"], [F.col("v"), F.col("k")]).collect()}
    for g in range(4):
        own = sorted((v, k) for a, v, k in rows if a == g)
        assert [got[k] for _, k in own] == list(range(1, len(own) + 1))
    cut = one(prefix.quantiles(frame, "v", {"a": 0.1, "b": 0.5, "c": 0.95}))
    want = np.quantile([v for _, v, _ in rows], [0.1, 0.5, 0.95])
    assert [cut["a"], cut["b"], cut["c"]] == pytest.approx(list(want))
    assert one(prefix.quantiles(frame.limit(0), "v", {"a": 0.5})) == {"a": None}


def test_blocks_of_items_give_the_same_counts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vec = rng.integers(-3, 4, (40, 3)).astype(float)  # many ties, exact in single precision
    items = spark.createDataFrame([(i, [float(x) for x in v], 0.5 * (i % 2)) for i, v in enumerate(vec)], "item_id long, vec array<float>, bias float")
    users = spark.createDataFrame([(u, [float(x) for x in rng.integers(-3, 4, 3)]) for u in range(25)], "user_id long, vec array<float>")
    targets = spark.createDataFrame([(u, u % 40) for u in range(25)], "user_id long, target_item_id long")
    hidden = spark.createDataFrame([(u, (u * 7 + k) % 40) for u in range(25) for k in range(u % 4)], "user_id long, item_id long")
    whole = ranking.factor_tie_counts(users, items, targets, hidden, 5).collect()
    monkeypatch.setattr(ranking, "MAX_CATALOGUE_BYTES", 100)
    monkeypatch.setattr(ranking, "USERS_PER_BLOCK", 8)
    blocks = ranking.factor_tie_counts(users, items, targets, hidden, 5).collect()
    key = lambda r: (r["user_id"], r["target_item_id"], r["strictly_above"], r["tied_block_size"], tuple(r["shown"]))
    assert sorted(map(key, whole)) == sorted(map(key, blocks))


def test_hashed_triples_reject_owned_items(spark):
    edges = spark.createDataFrame([(u, i) for u in range(5) for i in range(u, u + 4)], "user_id long, item_id long")
    items = spark.createDataFrame([(i,) for i in range(12)], "item_id long")
    got = models.hashed_triples(edges, items, 2).collect()
    owned = {(r["user_id"], r["item_id"]) for r in edges.collect()}
    assert len(got) == 40 and all((r["user_id"], r["negative"]) not in owned for r in got)


def test_svd_and_nmf(spark):
    rng = np.random.default_rng(2)
    dense = rng.random((12, 6)) * (rng.random((12, 6)) < 0.6)
    rows = [(u, i, float(dense[u, i])) for u in range(12) for i in range(6) if dense[u, i]]
    values_, _, _ = models.truncated_svd(spark.createDataFrame(rows, "user_id long, item_id long, confidence double"), 2, rounds=12)
    assert values_ == pytest.approx(np.linalg.svd(dense)[1][:2], rel=1e-3)
    w, h = models.fit_nmf(dense, 6)
    assert (w >= 0).all() and np.abs(w @ h - dense).max() < 0.3


def test_feature_sum(spark):
    features_ = spark.createDataFrame([(1, "item::1", 1.0), (1, "genre::a", 0.5), (2, "item::2", 1.0)], "item_id long, feature_name string, weight double")
    factors = spark.createDataFrame([("item::1", [1.0, 2.0]), ("item::2", [3.0, 4.0]), ("genre::a", [10.0, 20.0])], "feature_name string, vec array<double>")
    got = dict(values(models.feature_sum_items(features_, factors, rho=2.0), "item_id", "vec"))
    assert got == {1: [11.0, 22.0], 2: [3.0, 4.0]}


def test_deciles_keep_equal_values_together(spark):
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate([1] * 50 + list(range(2, 52)))], "k long, v double")
    got = interactions.deciles(frame, "v").collect()
    assert len({r["decile"] for r in got if r["v"] == 1}) == 1
    assert max(r["decile"] for r in got) > 3


@pytest.fixture
def nothing_collected(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("collected")))


def test_als_keeps_factors_off_the_driver(spark, nothing_collected):
    rows = [(u, i, 2.0) for u in range(9) for i in range(u % 3, 8, 2)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, confidence double")
    users, items = models.fit_als(edges, 3, 0.1, 1, 1)
    assert users.count() == 9 and items.count() == 8
    assert models.fold_in_als(edges.where("user_id < 2"), items).count() == 2


def test_counts_without_what_is_shown(spark, nothing_collected, monkeypatch):
    """Blocks of a few items, ties between equal vectors in different ones, and hidden items."""
    monkeypatch.setattr(ranking, "BLOCK", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(10, 3)).astype(np.float32)
    pool = [(100 + i, vectors[i % 10].tolist(), float(i % 10)) for i in range(30)]
    users = [(u, rng.normal(size=3).astype(np.float32).tolist()) for u in range(8)]
    aims, lost = [(u, 100 + 3 * u) for u in range(8)], [(u, 100 + i) for u in range(8) for i in range(u, 30, 4)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = ranking.factor_tie_counts(frame(users, "user_id long, vec array<float>"), frame(pool, "item_id long, vec array<float>, bias float"), frame(aims, "user_id long, target_item_id long"), frame(lost, "user_id long, item_id long"), k=0).collect()
    assert len(got) == 8
    for r in got:
        u, aim = r["user_id"], r["target_item_id"] - 100
        score = lambda i: float(np.dot(users[u][1], pool[i][1]) + pool[i][2])
        left = [i for i in range(30) if i == aim or (u, 100 + i) not in lost]
        assert r["tied_block_size"] == sum(i % 10 == aim % 10 for i in left)
        assert r["strictly_above"] == sum(i % 10 != aim % 10 and score(i) > score(aim) for i in left)


def test_pairwise_fit_keeps_items_off_the_driver(spark, nothing_collected):
    rows = [(u, i) for u in range(9) for i in range(u % 3, 8, 2)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long")
    labels = spark.createDataFrame([(i, f"genre::{i % 3}", 0.5) for i in range(8)], "item_id long, feature_name string, weight double")
    for named in (None, labels):
        users, items = models.fit_bpr(edges, named, 3, epochs=1)
        assert users.count() == 9 and items.count() == 8
        folded = models.fold_in_bpr_users(edges.where("user_id < 4"), items)
        assert folded.rdd.getNumPartitions() > 1 and folded.count() == 4


def test_inner_products_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist(), k % 2) for k in range(15)] + [(20, None, 0), (21, [1.0, None, 2.0, 1.0], 0), (22, [1.0, 2.0], 0), (23, [], 1), (24, [float("inf"), 0.0, 0.0, 0.0], 1), (3, [1.0] * 4, 1), (None, [1.0] * 4, 1), (30, [1.0] * 4, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r[0], r[1], r[2]) for r in ranking.inner_products(table, "label", "vec_id", "embedding").collect()), key=repr)
    want = []
    for i, a, x in rows:
        for j, b, y in rows:
            if x == y and x is not None and None not in (i, j) and i != j:
                each = [float(p) * float(q) for p, q in zip(a or [], b or [], strict=False) if p is not None and q is not None]
                want.append((i, j, sum(each) if each else None))
    assert repr(got) == repr(sorted(want, key=repr))
    values = np.array([0.0000005, -0.0000005, 2.5e-6, 1.0000015, -1.2345675, 1e-9, -1e-9, 1e12 + 0.1, np.inf, 1e300])
    rounded = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert ranking.rounded_half_up(values, 6).tolist() == rounded


def test_als_keys_of_few_edges_are_solved_together(monkeypatch):
    """Keys that a batch holds whole go by their number of edges, in the same terms as the normal equations; cut ones go on over batches."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 14, 40)
    rows = pd.DataFrame({"user_id": np.repeat(np.arange(40), sizes), "item_id": rng.integers(0, 30, sizes.sum()), "confidence": 1 + 20 * rng.random(sizes.sum()), "_n": np.repeat(sizes, sizes)})
    factors, calls = rng.standard_normal((30, 8)), []
    gram = factors.T @ factors
    solve = models.solve_batch
    monkeypatch.setattr(models, "solve_batch", lambda a, b: calls.extend(b) or solve(a, b))
    found = pd.concat(models._summed(iter([rows[a : a + 50] for a in range(0, len(rows), 50)]), "user_id", lambda pdf: factors[pdf["item_id"].to_numpy()], 0.1, gram)).set_index("id")["vec"]
    assert sorted(found.index) == list(range(40)) and len(calls) < 0.7 * 40
    for key, own in rows.groupby("user_id"):
        want, _ = models.solve_spd(*models.normal_equation(factors[own["item_id"]], own["confidence"].to_numpy(), 0.1, gram))
        assert found[key] == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_the_holdout_deals_edges_by_user_once(spark):
    """Choices are made where a user's edges lie: edges are not joined to tables by user or by pair, and columns to keep go along."""
    rows = [(u, i, float(u + i)) for u in range(30) for i in range(20) if (u * 7 + i * 3) % 4]
    plans = []

    def save(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return spark.createDataFrame(df.collect(), df.schema)

    frame = spark.createDataFrame(rows, "user_id long, item_id long, played double")
    out = splits.nested_split(frame, 2, 1, save=save, keep=["played"])
    assert sum(p.count("Join") for p in plans) == 1  # the items' support
    found = {(r["user_id"], r["item_id"]): r for r in out.collect()}
    assert {k: r["played"] for k, r in found.items()} == {(u, i): p for u, i, p in rows}
    for u in range(30):
        roles = [r["role"] for (x, _), r in found.items() if x == u]
        assert roles.count("test") == roles.count("validation") == 1


def test_containment_counts_a_null_user_and_makes_no_row_for_each_owner(spark):
    edges = spark.createDataFrame([(u, i, 1.0) for u in (1, 2, None) for i in (1, 2)] + [(3, 2, 4.0)], "user_id long, item_id long, playtime_forever double")
    held = spark.createDataFrame([(7, 1), (7, 2), (7, 2), (8, 2), (8, None), (9, 5), (10, None)], "bundle_id long, item_id long")
    got = {r["bundle_id"]: tuple(r)[1:] for r in bundles.demand_proxy(edges, held).collect()}
    assert got == {7: (2, 2, 1.0, 3, 4, 2.5), 8: (2, 1, 0.5, 0, 4, 1.75), 9: (1, 0, 0.0, 0, 0, None), 10: (1, 0, 0.0, 0, 0, None)}
    found = bundles.user_candidates(edges, held)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 7), (2, 7), (None, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("collect_list") >= 2


def test_pairs_of_bundles_are_dealt_by_their_number(spark, monkeypatch):
    """A task counts so many pairs however many there are: one item in 60 bundles makes 1,770 of them."""
    monkeypatch.setattr(bundles, "PAIRS_PER_TASK", 100)
    out = bundles.overlap_pairs(spark.createDataFrame([(b, i) for b in range(60) for i in (1, 2 + b % 2)], "bundle_id long, item_id long"))
    assert out.rdd.getNumPartitions() == 26  # of 2,640 pairs with repeats
    assert {r["shared_items"] for r in out.collect()} == {1, 2} and out.count() == 1770


def test_inner_products_shuffle_no_block(spark, monkeypatch):
    """Pairs of blocks come from the saved table's splits: the plan that scores them has no exchange, and a pair is worked out once for both orders."""
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 4)
    table = spark.range(60).select(F.col("id").alias("vec_id"), (F.col("id") % 2).alias("label"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("embedding"))
    scores = ranking.inner_products(table, "label", "vec_id", "embedding")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {(r[0], r[1]): r[2] for r in scores.collect()}
    assert scores.count() == len(got) == 2 * 30 * 29
    assert all(got[j, i] == s == 0.25 * i * j + 1 for (i, j), s in got.items())


def test_attribution_solves_only_overlapping_bundles_in_python(spark):
    """Components of one bundle are worked out by expressions, of equal results; sets without shared items, null users and items included."""
    rng = random.Random(7)
    held = {b: set(rng.sample(range(70), rng.randint(1, 3))) for b in range(40)}
    sets = [sorted(rng.sample(range(41), rng.randint(1, 6))) for _ in range(25)]  # bundle 40 has no known item
    users = dict(enumerate([*sets, *sets[:5], [3]])) | {None: [0, 1, 2]}
    prices, solo = {b: rng.choice([100, 200, 310, 90_000]) for b in range(41)}, {i: rng.choice([50, 100, 200]) for i in range(70)}
    want: dict = {}
    for own in users.values():
        parts: list[set] = []
        for b in (b for b in own if b in held):
            near = [p for p in parts if any(held[x] & held[b] for x in p)]
            parts = [p for p in parts if p not in near] + [{b}.union(*near)]
        for part in map(sorted, parts):
            hard, soft, _ = bundles.cover_shares([prices[b] for b in part], [sorted(held[b]) for b in part], solo, (0.5, 1.0, 2.0))
            for k, b in enumerate(part):
                row = want.setdefault(b, [0, 0, 0.0, 0.0, 0.0, 0.0])
                for at, v in enumerate([1, int(len(part) > 1), hard[k], *(soft[t][k] for t in (0.5, 1.0, 2.0))]):
                    row[at] += v
    assert any(r[1] for r in want.values()) and any(r[0] > r[1] for r in want.values())
    items = spark.createDataFrame([(b, i) for b, s in held.items() for i in s] + [(0, min(held[0])), (1, None), (40, None)], "bundle_id long, item_id long")
    candidates = spark.createDataFrame([(u, b) for u, own in users.items() for b in own], "user_id long, bundle_id long")
    cents, alone = spark.createDataFrame(list(prices.items()), "bundle_id long, cents long"), spark.createDataFrame(list(solo.items()), "item_id long, cents long")
    for components in (bundles.user_components(candidates, items), bundles.counted_components(candidates, items)):
        out = bundles.mincost_attribution(components, items, cents, alone)
        got = {r[0]: list(r[1:]) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[b] == pytest.approx(want[b], abs=1e-12) for b in want)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        single, several = plan.split("ArrowEvalPython")  # one call of Python, and it is below the filter of larger components
        assert "Union" in single and "> 1)" in several and "= 1)" not in several
    with pytest.raises(Exception, match="has no price"):
        bundles.mincost_attribution(components, items, cents.withColumn("cents", F.when(F.col("bundle_id") != 3, F.col("cents"))), alone).collect()
