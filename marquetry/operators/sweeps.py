"""Sensitivity and robustness tables: policies across panels, distributions and calibration knobs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators import moments, pricing


def panel_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A seeded synthetic matrix as a panel (user_id, item_id, v)."""
    users, items = np.indices(matrix.shape)
    return spark.createDataFrame(pd.DataFrame({"user_id": users.ravel(), "item_id": items.ravel(), "v": matrix.ravel()}), "user_id long, item_id long, v double")


def probit_optimum(mean: float, deviation: float, cost: float = 0.0, steps: int = 200) -> tuple[float, float]:
    """(price, profit) of one product with normal values, by golden section; demand is 1 - cdf."""
    dist = NormalDist(mean, deviation)
    profit = lambda p: (p - cost) * (1 - dist.cdf(p))
    a, b, g = cost, mean + 6 * deviation, (math.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = b - g * (b - a), a + g * (b - a)
        a, b = (a, y) if profit(x) >= profit(y) else (x, b)
    return (a + b) / 2, profit((a + b) / 2)


def closed_form_against_probit(means: Sequence[float], deviations: Sequence[float], cost: float = 0.0) -> list[dict]:
    """Per mean and deviation the moment-based single price and its profit under normal values, against the optimum."""
    out = []
    for m in means:
        for s in deviations:
            row = moments.CrossMoment([m], np.array([[s * s]]), [1], cost).single_size()["best"]
            price, best = probit_optimum(m, s, cost)
            out.append({"mean": m, "deviation": s, "moment_price": row["price"], "probit_price": price, "ratio": (row["price"] - cost) * (1 - NormalDist(m, s).cdf(row["price"])) / best if best else math.nan})
    return out


def policy_row(spark: SparkSession, matrix: np.ndarray, sizes: Sequence[int], cost: float = 0.0) -> dict:
    """Separate, pure-bundle and moment-menu profits of a panel and their ratios."""
    panel = panel_frame(spark, matrix)
    separate = pricing.separate_selling(panel, cost).first()[0]
    pure = pricing.pure_bundling(panel, cost * matrix.shape[1]).first()["profit"]
    sums = np.cumsum(-np.sort(-matrix, axis=1), axis=1)[:, [s - 1 for s in sizes]]
    sigma, _ = moments.covariance(sums, "ledoit_wolf")
    menu = moments.CrossMoment(sums.mean(axis=0), sigma, sizes, cost).optimum()["prices"]
    realised = pricing.evaluate_menu(panel, [float(p) for p in menu], sizes, cost).first()["profit"]
    return {"separate": separate, "pure": pure, "menu": realised, "menu_over_separate": realised / separate if separate else math.nan, "pure_over_separate": pure / separate if separate else math.nan}


def distribution_sweep(spark: SparkSession, kinds: Sequence[str] = ("gamma", "uniform", "normal"), rhos: Sequence[float] = (0.0,), users: int = 400, items: int = 4, seed: int = 1) -> DataFrame:
    """(kind, rho, policies...) over synthetic panels; dependence applies to normal ones."""
    rows = [{"kind": k, "rho": float(r)} | policy_row(spark, moments.panel(k, users, items, seed, r), [1, items]) for k in kinds for r in (rhos if k == "normal" else (0.0,))]
    return spark.createDataFrame(pd.DataFrame(rows))


def knob_sweep(scores: DataFrame, a: float, b: float, knobs: Sequence[tuple[float, float]], cost: float = 0.0) -> DataFrame:
    """(scale, shift, floored, separate) of valuations max(0, a + shift + scale * b * score) for each knob, in one job.

    scores: user_id, item_id, score. floored is the share of values at the floor; separate the profit of best item prices.
    """
    spark = scores.sparkSession
    table = F.broadcast(spark.createDataFrame([(float(s), float(t)) for s, t in knobs], "scale double, shift double"))  # the knobs
    users = scores.select("user_id").distinct().count()
    value = F.lit(float(a)) + F.col("shift") + F.col("scale") * F.lit(float(b)) * F.col("score")
    rows = scores.crossJoin(table).select("scale", "shift", "item_id", F.greatest(value, F.lit(0.0)).alias("v"), (value < 0).cast("double").alias("_low"))
    floored = rows.groupBy("scale", "shift").agg(F.avg("_low").alias("floored"))
    best = pricing.price_scan(rows, ["scale", "shift", "item_id"], "v", cost, users)
    return floored.join(best.groupBy("scale", "shift").agg(F.sum("profit").alias("separate")), ["scale", "shift"])


def bundle_scores(item_scores: DataFrame, bundle_items: DataFrame) -> DataFrame:
    """(bundle_id, mean_score) from (item_id, score): for rank concordance with demand."""
    return bundle_items.join(item_scores, "item_id").groupBy("bundle_id").agg(F.avg("score").alias("mean_score"))


def ml_als(edges: DataFrame, factors: int, ridge: float, iterations: int, seed: int = 1):
    """Spark ML's implicit ALS, whose ridge grows with each row's edges: another estimator than `models.fit_als`."""
    from pyspark.ml.recommendation import ALS

    rated = edges.select(F.col("user_id").cast("int").alias("user"), F.col("item_id").cast("int").alias("item"), (F.col("confidence") - 1).cast("float").alias("rating"))
    return ALS(rank=factors, regParam=ridge, maxIter=iterations, implicitPrefs=True, alpha=1.0, seed=seed, userCol="user", itemCol="item").fit(rated)
