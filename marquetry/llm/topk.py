"""Exact top-k inner-product search: ball-tree branch and bound per shard, with the kth score so far shared across shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.llm.common import materialize

LEAF = 128
#: Rows of a shard and queries of a block, so large that few blocks repeat a shard's rows; queries are asked ASKED at a time.
ROWS_PER_SHARD = 65_536
MIN_SHARDS = 16
QUERIES_PER_BLOCK = 65_536
ASKED = 4096
#: Shares of the shards that have been asked after each wave but the last; the first wave asks one shard for each query.
WAVES = (0.25,)


class BallTree:
    """Balls over the rows of `vectors`, halved along the line between two far rows until LEAF rows are left."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self.parents: list[int] = []
        self.leaves: list[tuple[int, int, int]] = []  # (node, first, end)
        todo = [(0, len(vectors), -1)] if len(vectors) else []
        while todo:
            a, b, parent = todo.pop()
            rows = vectors[self.order[a:b]]
            center = rows.mean(axis=0)
            away = ((rows - center) ** 2).sum(axis=1)
            node = len(self.radii)
            self.centers.append(center)
            self.radii.append(float(np.sqrt(away.max())))
            self.parents.append(parent)
            if b - a <= leaf:
                self.leaves.append((node, a, b))
                continue
            one = rows[away.argmax()]
            two = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            part = np.argpartition(rows @ (two - one), half)  # equal rows are halved too
            self.order[a:b] = self.order[a:b][part]
            todo += [(a, a + half, node), (a + half, b, node)]

    def bounds(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product with any row of each leaf, -inf where the query's floor rules out a ball around it.

        The tree is descended level by level; below a ball that no query's floor lets pass nothing is worked out.
        """
        out = np.full((len(queries), len(self.radii)), -np.inf)
        norms, centers, radii = np.linalg.norm(queries, axis=1), np.array(self.centers), np.array(self.radii)
        level = np.array([k for k, parent in enumerate(self.parents) if parent < 0], dtype=np.int64)
        children: dict[int, list[int]] = {}
        for k, parent in enumerate(self.parents):
            children.setdefault(parent, []).append(k)
        while len(level):
            bound = queries @ centers[level].T + norms[:, None] * radii[level]
            bound += 1e-9 * (1 + np.abs(bound))  # rounding
            above = np.array([self.parents[k] for k in level.tolist()])
            inside = above >= 0
            bound[:, inside] = np.minimum(bound[:, inside], out[:, above[inside]])  # a ball's bound caps those inside it
            bound[bound < floors[:, None]] = -np.inf
            out[:, level] = bound
            alive = level[np.isfinite(bound).any(axis=0)]
            level = np.array([c for k in alive.tolist() for c in children.get(k, ())], dtype=np.int64)
        return out[:, [n for n, _, _ in self.leaves]]


class Shard:
    """A shard's rows under a ball tree; components are whole numbers, held in doubles where sums fit."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.tree = BallTree(vectors.astype(np.float64), leaf)
        order = self.tree.order
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.widest = float(np.abs(vectors).max(initial=0))
        self.doubles = self.vectors.astype(np.float64)

    def search(self, own: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query index, row, id, score) of the k best rows per query that reach its floor, ties to smaller ids, then rows; its own row left out.

        Each query opens leaves by falling bound and stops below its kth score so far, or its floor. Queries at the same
        leaf in a round share one matrix product.
        """
        exact = max(self.widest, float(np.abs(queries).max(initial=0))) ** 2 * max(queries.shape[1], 1) < 2.0**53
        rows = self.doubles if exact else self.vectors
        asked = queries.astype(rows.dtype)
        bounds = self.tree.bounds(queries.astype(np.float64), floors)
        turn = np.argsort(-bounds, axis=1, kind="stable")
        kth = np.maximum(floors.astype(np.float64), np.finfo(np.float64).min)  # so that leaves ruled out never reach it
        none = np.empty(0, np.int64)
        best = none, none, none, none
        active = np.arange(len(own))
        for step in range(len(self.tree.leaves)):
            active = active[bounds[active, turn[active, step]] >= kth[active]]
            if not len(active):
                break
            at = turn[active, step]
            by_leaf = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.r_[True, at[by_leaf][1:] != at[by_leaf][:-1]])
            found = [best]
            for members in np.split(active[by_leaf], starts[1:]):
                _, a, b = self.tree.leaves[turn[members[0], step]]
                scores = asked[members] @ rows[a:b].T
                q, r = np.nonzero((scores >= kth[members][:, None]) & (self.rows[a:b] != own[members][:, None]))
                found.append((members[q], self.rows[a + r], self.ids[a + r], scores[q, r].astype(np.int64)))
            if sum(len(x[0]) for x in found[1:]):
                q, r, i, s = (np.concatenate([x[c] for x in found]) for c in range(4))
                order = np.lexsort((r, i, -s, q))
                q, r, i, s = q[order], r[order], i[order], s[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
                best = q[nth < k], r[nth < k], i[nth < k], s[nth < k]
                full = nth == k - 1
                kth[q[full]] = np.maximum(kth[q[full]], s[full])
        return best


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null, or one is not finite."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(wide, lambda x: F.floor(x * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, rows_per_shard: int = ROWS_PER_SHARD, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The k rows of greatest inner product for each query row: query_id, rank (from 1), id_col, score.

    Components become floor(scale * x). Ties go to the smaller id; the query's own row is left out; fewer rows
    than k return all. Null ids and vectors that are null or hold null or non-finite components take no part. Vectors of
    another length than the query's are not compared with it. Rows that repeat an id count each, and each of them that
    is a query is asked apart. Components so large that a score might not fit 64 bits are an error. An empty table gives an empty result; other columns, whatever their names, are not looked at.

    Rows are dealt into shards of about rows_per_shard by a hash of their number and queries into blocks; every shard meets
    every block once, so each task holds one of both and no pair of rows is ever a row of a plan. A first wave asks each
    query in one shard only; its kth score there is the floor that the second wave starts from in a quarter of the others, and
    what that raises it to the floor of the third in the rest. Rows are repeated for each block of queries_per_block and
    queries for each shard: the search is quadratic by contract (queries are a share of rows), and both sizes are chosen for
    a task's memory (a row is 8 bytes a component).
    """
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    rows = materialize(rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    widest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    n, asked, most, dim = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(widest, F.lit(0.0)), F.coalesce(F.max("dim"), F.lit(0))).first()
    if most * most * dim >= 2.0**63:
        raise ValueError(f"a component of {most:.3g} in {dim} dimensions may take scores beyond 64 bits")
    shards = max(MIN_SHARDS, -(-n // rows_per_shard))
    blocks = max(1, -(-asked // queries_per_block))
    hashed = lambda c, seed, m: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = materialize(rows.where("asks").select("row", "id", "dim", "v", hashed("row", 7, blocks).alias("block"), hashed("row", 11, shards).alias("home")), "queries")
    dealt = rows.select("row", "id", "dim", "v", hashed("row", 13, shards).alias("shard"))
    if blocks > 1:
        dealt = dealt.withColumn("block", each(blocks))
    else:
        dealt = dealt.withColumn("block", F.lit(0))

    def visit(asking: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "query_id", "row", "id", "score"]
        if not len(asking) or not len(pool):
            return pd.DataFrame(columns=columns)
        shard, out = Shard(pool["row"].to_numpy(), pool["id"].to_numpy(), np.stack(pool["v"])), []
        for a in range(0, len(asking), ASKED):
            part = asking.iloc[a : a + ASKED]
            q, r, i, s = shard.search(part["row"].to_numpy(), np.stack(part["v"]), part["floor"].fillna(-np.inf).to_numpy(), k)
            out.append(pd.DataFrame({"query": part["row"].to_numpy()[q], "query_id": part["id"].to_numpy()[q], "row": r, "id": i, "score": s}))
        return pd.concat(out, ignore_index=True)

    made, key = "query long, query_id long, row long, id long, score long", ["dim", "shard", "block"]
    pools = dealt.groupBy(*key)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row"))

    def wave(asking: DataFrame, best: DataFrame | None) -> DataFrame:
        """The k best so far, after the asked shards."""
        found = asking.select("row", "id", "dim", "v", "shard", "block", "floor").groupBy(*key).cogroup(pools).applyInPandas(visit, made)
        both = found if best is None else best.union(found)
        return both.withColumn("rank", nth).where(F.col("rank") <= k).drop("rank")

    best = materialize(wave(queries.withColumns({"shard": F.col("home"), "floor": F.lit(None).cast("double")}), None), "near")
    edges = [0, *sorted({round(shards * w) for w in WAVES}), shards]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        floors = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)
        turn = F.pmod(F.col("shard") - F.col("home"), F.lit(shards))  # shards after the home one, in order
        away = queries.join(floors, queries["row"] == floors["query"], "left").withColumn("shard", each(shards)).where((turn > 0) & (turn >= lo) & (turn < hi))
        best = wave(away, best)
        if hi < shards:
            best = materialize(best, "nearer")
    return best.withColumn("rank", nth).select("query_id", "rank", F.col("id").alias(id_col), "score")
