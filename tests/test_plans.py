"""Named queries against their SQL at the smallest size, and runs over the evaluation DAG."""

import collections
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marquetry.functions.contracts import ContractError
from marquetry.operators import pricing, ranking
from marquetry.plans import catalogue, evaluate, monitor, orchestrate, pipeline
from marquetry.sources.scratch import saver

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def cells(row):
    return tuple(round(v, 5) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    frame = catalogue.queries()[name](spark, str(FOLDER))
    columns = sorted(frame.columns)
    got = collections.Counter(cells(r[c] for c in columns) for r in frame.collect())
    found = database.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = collections.Counter(cells(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grids():
    grid = orchestrate.als_grid([64, 32], [0.05, 0.1], [20], [{"id": "own", "alpha_p": 0, "tau": 1}])
    assert [c["configuration_id"] for c in grid][0] == "als__k032__reg0p05__ao20__own" and len(grid) == 4
    assert len(orchestrate.bpr_grid([32], [1e-4], [0.05, 0.1])) == 2
    good = {"split": {"design_fraction": 0.8, "assessment_fraction": 0.2, "activity_bands": [5, 10], "minimum_activity": 5}, "seeds": [1, 2], "warm": {"before": 5, "after": 3, "required": 3}}
    assert len(orchestrate.validate_protocol(good)["protocol_id"]) == 64
    with pytest.raises(ContractError):
        orchestrate.validate_protocol(good | {"seeds": [1, 1]})


def test_runs_resume_and_gate(spark, tmp_path):
    ready = evaluate.prepare(spark, str(FOLDER))
    calls = []

    def fit(r, config, seed):
        calls.append(seed)
        return orchestrate.fit_popularity(r, config, seed)

    grid = [{"configuration_id": "only"}]
    rows = orchestrate.run_grid(spark, str(tmp_path), ready, grid, [1, 2], "popularity", fit, "p")
    again = orchestrate.run_grid(spark, str(tmp_path), ready, grid, [1, 2], "popularity", fit, "p")
    assert calls == [1, 2] and again.count() == rows.count()
    save = saver(spark)
    als = orchestrate.run_grid(spark, str(tmp_path), ready, orchestrate.als_grid([4], [0.1], [20], [{"id": "own", "alpha_p": 0, "tau": 1}], 1), [1], "als", lambda r, c, s: orchestrate.fit_als_counts(r, c, s, save), "p")
    assert orchestrate.leaderboard(als).count() == 1
    verdict = orchestrate.gate(als, rows, ["als"])
    assert set(verdict) == {"families", "override", "results"}
    assert orchestrate.seed_contrasts(als, rows).count() == 1


def test_cold_production_and_utilities(spark):
    ready = evaluate.prepare(spark, str(FOLDER))
    scores = evaluate.item_scores(ready, "popularity")
    cold = scores.select("item_id").limit(30)
    assert orchestrate.pseudo_cold(ready, cold, scores).count() > 0
    fresh = ready.trained.where("user_id % 10 = 0")
    users, items, folded = orchestrate.production(ready, fresh, 4, 0.1, 20.0, 1, 1, saver(spark))
    assert users.count() and items.count() and folded.count() == fresh.select("user_id").distinct().count()
    pairs = ready.trained.select("user_id", "item_id", ready.trained["playtime_forever"].alias("score"))
    parameters, diagnostics = orchestrate.freeze_utilities(pairs)
    assert parameters.count() == 1 and diagnostics.count() == 4


def test_pushdown(spark):
    plan = catalogue.queries()["canonical_edges"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "CartesianProduct" not in plan


def test_monitor_stops_a_run(spark):
    with monitor.Monitor(spark, interval=0.05) as m:
        spark.range(10).count()
    assert m.peak > 0 and m.table().count() == len(m.samples) >= 2
    with pytest.raises(monitor.OverBudget), monitor.Monitor(spark, max_bytes=1, interval=0.05):
        spark.range(10).count()


def test_whole_run_resumes(spark, tmp_path):
    grids = {"popularity": [{"configuration_id": "popularity"}], "bpr": orchestrate.bpr_grid([4], [1e-4], [0.1], epochs=1)}
    first = pipeline.run(spark, str(FOLDER), str(tmp_path), grids, [1])
    again = pipeline.run(spark, str(FOLDER), str(tmp_path), grids, [1])
    assert first["result"] == again["result"] and first["verdict"]["families"] == again["verdict"]["families"]
    assert {r["table"] for r in again["evidence"].collect()} == {"leaderboard", "selected", "segments"}
    with pytest.raises(ContractError):
        pipeline.EstimatorSpec("nothing", (("configuration_id", "x"),), (1,))
    a, b = pipeline.specs(grids, [1]), pipeline.specs(grids, [2])
    assert len(a) == 2 and a[0].spec_id != b[0].spec_id


def test_menu_by_evolution_is_no_worse_than_its_start(spark):
    panel = spark.createDataFrame([(u, f"i{k}", float((u * 7 + k * 3) % 11)) for u in range(40) for k in range(4)], "user_id long, item_id string, v double")
    start = [6.0, 12.0, 18.0]
    base = pricing.menu_search(panel, [start], (1, 2, 3), 0.5).first()["profit"]
    prices, profit = pricing.optimise_menu(panel, (1, 2, 3), 0.5, rounds=4, population=8, start=start)
    assert profit >= base and prices == sorted(prices)
    assert pricing.menu_search(panel, [prices], (1, 2, 3), 0.5).first()["profit"] == pytest.approx(profit)


def test_families_share_their_joins(spark):
    """All families at once give the rows of each alone, and exclusions are joined once."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    scores = frame([(i, float(i % 3), float(i % 4)) for i in range(12)], "item_id long, a double, b double")
    targets, lost = frame([(u, u) for u in range(10)], "user_id long, target_item_id long"), frame([(u, i) for u in range(9) for i in range(u % 2, 12, 3)], "user_id long, item_id long")
    rows = ranking.family_score_ties(scores, ["a", "b"], targets, lost)
    got = {(r["family"], r["user_id"]): (r["strictly_above"], r["tied_block_size"]) for r in rows.collect()}
    for f in ("a", "b"):
        alone = ranking.item_score_ties(scores.select("item_id", F.col(f).alias("score")), targets, lost).collect()
        assert {(f, r["user_id"]): (r["strictly_above"], r["tied_block_size"]) for r in alone} == {k: v for k, v in got.items() if k[0] == f}
