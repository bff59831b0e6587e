"""Components: right on chains and random graphs, and no round is made of what is settled."""

import numpy as np
import pytest

from marquetry.llm import components as stars


def _expected(rows):
    root = {x: x for r in rows for x in r}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in rows:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("rows", [[(k, k + 1) for k in range(40)], np.random.default_rng(3).integers(0, 90, (60, 2)).tolist(), [(1, 9), (9, 1), (9, 4)]])
def test_components(spark, rows):
    rows = [(int(u), int(v)) for u, v in rows if u != v]
    got = stars.components(spark.createDataFrame(rows, "u long, v long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == _expected(rows)


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    real = stars.materialize
    monkeypatch.setattr(stars, "materialize", lambda df, tag: written.append(tag) or real(df, tag))
    rows = [(10 * h + k, 10 * h) for h in range(5) for k in range(1, 9)]
    got = {r["node"]: r["root"] for r in stars.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == _expected(rows) and written == ["edges", "least"]
