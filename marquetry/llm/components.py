"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import discard, materialize


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each batch as stars around its least nodes, which connect the same nodes in one step."""
    for batch in batches:
        ids, at = np.unique(batch[["u", "v"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        root = ids[_roots(len(ids), at[:, 0], at[:, 1])]
        yield pd.DataFrame({"u": ids, "v": root})[root != ids]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs to (node, root): the least node of its component, for every node on an edge.

    Minima are partial aggregates and are joined back by key, so a hub with many edges is split by adaptive
    execution and never gathered in one task. Each round is written to the shared folder. Ends in about log(longest path)
    rounds, when all edges are stars: the minima of a round show that before it is made.
    """
    edges = materialize(edges.where("u <> v").select("u", "v").mapInPandas(_contracted, "u long, v long").distinct(), "edges")
    while True:
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
        # Minima are written before they are joined: a join right on top of its aggregate's partitioning cannot be split.
        up, down = F.count_if(F.col("b") < F.col("a")), F.count_if(F.col("b") > F.col("a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), ((up > 1) | ((up > 0) & (down > 0))).alias("loose"))
        least = materialize(least.select("a", F.least("a", "m").alias("m"), "loose"), "least")
        if least.where("loose").isEmpty():  # every node is either a root or one edge below one
            discard(least)
            break
        # An edge gives one row; equal rows go with the distinct of the round.
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lower.select("u", "m")).distinct()
        before, edges = edges, materialize(small, "edges")
        for used in (before, large, least, lower):
            discard(used)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
