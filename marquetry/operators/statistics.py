"""Regressions, correlations and calibrations from aggregates; small linear algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.functions.scalars import clip_rate, logistic, logit, normal_cdf, probit
from marquetry.operators.prefix import running_sums, running_sums_within


def gram(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(X'X, X'y, y'y, sum y, n) with an intercept first, in one aggregate pass."""
    columns = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    k = len(columns)
    sums = [F.sum(columns[i] * columns[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y)) for c in columns] + [F.sum(F.col(y) * F.col(y)), F.count("*")]
    row = list(df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = row[: k * (k + 1) // 2]
    a = a + np.triu(a, 1).T
    b = np.array(row[k * (k + 1) // 2 : k * (k + 1) // 2 + k], dtype=float)
    return a, b, float(row[-2]), float(b[0]), int(row[-1])


def ols(df: DataFrame, y: str, xs: Sequence[str], robust: bool = True) -> dict:
    """Least squares with an intercept: coefficients, standard errors (HC3 unless robust is off), t, normal p, R squared, n.

    Rows with a null or non-finite value are left out. HC3 takes a second pass for leverages; only k x k sums are collected.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (y, *xs)]
    keep = finite[0]
    for f in finite[1:]:
        keep = keep & f
    df = df.where(keep)
    a, b, yy, sy, n = gram(df, y, xs)
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rss = yy - 2 * beta @ b + beta @ a @ beta
    tss = yy - sy * sy / n
    if robust:
        columns = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
        k = len(columns)
        fitted = sum((F.lit(float(c)) * x for c, x in zip(beta, columns, strict=True)), F.lit(0.0))
        lever = sum((F.lit(float(inverse[i, j])) * columns[i] * columns[j] for i in range(k) for j in range(k)), F.lit(0.0))
        u = (F.col(y) - fitted) / (1.0 - lever)
        row = df.agg(*[F.sum(u * u * columns[i] * columns[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        meat = np.zeros((k, k))
        meat[np.triu_indices(k)] = list(row)
        meat = meat + np.triu(meat, 1).T
        variance = inverse @ meat @ inverse
    else:
        variance = inverse * rss / (n - len(beta))
    se = np.sqrt(np.diag(variance))
    t = beta / se
    p = [math.erfc(abs(v) / math.sqrt(2)) for v in t]
    return {"names": ["const", *xs], "beta": beta, "se": se, "t": t, "p": p, "r2": 1 - rss / tss, "n": n, "low": beta - 1.959963984540054 * se, "high": beta + 1.959963984540054 * se}


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks of a column, ties shared. Levels are counted first and summed up by ranges."""
    levels = df.groupBy(column).agg(F.count("*").alias("_n"))
    levels = running_sums(levels, F.col(column).asc(), {"_below": "_n"}, before=True)
    return df.join(levels.withColumn(name, F.col("_below") + (F.col("_n") + 1) / 2.0).drop("_n", "_below"), column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation and pairs."""
    ranked = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("pairs"))


def aggregate_calibration(items: DataFrame, n_users: int, link: str = "probit") -> dict:
    """(a, b, sigma) from link(obs_rate) on mean_score and price; valid only with a negative price slope. items: mean_score, price, obs_rate."""
    rate = clip_rate(F.col("obs_rate"), n_users)
    z = {"logit": logit, "probit": probit}[link](rate)
    fit = ols(items.withColumn("_z", z), "_z", ["mean_score", "price"], robust=False)
    if fit["n"] < 4:
        raise ValueError("at least 4 priced items are needed")
    g0, gs, gp = (float(v) for v in fit["beta"])
    valid = gp < 0
    nan = math.nan
    return {"a": -g0 / gp if valid else nan, "b": -gs / gp if valid else nan, "sigma": -1 / gp if valid else nan, "valid": valid, "r2": fit["r2"], "gamma": (g0, gs, gp), "se": tuple(map(float, fit["se"])), "n_games": fit["n"]}


def group_quantiles(scores: DataFrame, rates: DataFrame, key: str = "item_id", score: str = "score") -> DataFrame:
    """(key, quantile): per group the linear quantile of scores at 1 - rate, which differs by group.

    rates: key, rate. Scores are counted by level and summed up by ranges; the two neighbours are picked by their numbers, so no
    group is collected or sorted in one task.
    """
    levels = scores.groupBy(key, score).agg(F.count("*").alias("_m"))
    levels = running_sums_within(levels, [key], [F.col(score)], {"_upto": "_m"})
    sizes = scores.groupBy(key).agg(F.count("*").alias("_n")).join(rates.select(key, "rate"), key)
    rows = levels.join(sizes.select(key, ((1 - F.col("rate")) * (F.col("_n") - 1)).alias("_at")), key)
    low = F.floor("_at") + 1
    ends = rows.groupBy(key, "_at").agg(F.min(F.when(F.col("_upto") >= low, F.col(score))).alias("_a"), F.min(F.when(F.col("_upto") >= low + 1, F.col(score))).alias("_b"))
    return ends.select(key, (F.col("_a") + (F.coalesce("_b", "_a") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))


def quantile_calibration(anchors: DataFrame) -> DataFrame:
    """One row: price = a + b * quantile over items (quantile, price): a, b, R squared, residual deviation (n - 2), valid if b > 0."""
    out = anchors.agg(F.regr_intercept("price", "quantile").alias("a"), F.regr_slope("price", "quantile").alias("b"), F.regr_r2("price", "quantile").alias("r2"), F.regr_syy("price", "quantile").alias("_syy"), F.count("*").alias("n_games"))
    sigma = F.sqrt(F.col("_syy") * (1 - F.col("r2")) / (F.col("n_games") - 2))
    return out.select("a", "b", "r2", F.when(F.col("b") > 0, sigma).alias("sigma"), (F.col("b") > 0).alias("valid"), "n_games")


def normalised_calibration(items: DataFrame, b_scale: float = 1.0, a_shift: float = 0.0) -> DataFrame:
    """One row: b matches the population deviations of mean_score and price, a their medians; a stated scale, not an estimate."""
    out = items.agg(F.stddev_pop("price").alias("_sp"), F.stddev_pop("mean_score").alias("_ss"), F.median("price").alias("_mp"), F.median("mean_score").alias("_ms"))
    b = F.lit(float(b_scale)) * F.col("_sp") / F.col("_ss")
    return out.select((F.col("_mp") - b * F.col("_ms") + F.lit(float(a_shift))).alias("a"), b.alias("b"), F.col("_sp").alias("sigma"))


def predicted_rates(scores: DataFrame, prices: DataFrame, a: float, b: float, sigma: float, link: str = "probit") -> DataFrame:
    """(item_id, rate): mean over users of link((a + b * score - price) / sigma)."""
    z = (F.lit(float(a)) + F.lit(float(b)) * F.col("score") - F.col("price")) / F.lit(float(sigma))
    p = normal_cdf(z) if link == "probit" else logistic(z)
    return scores.join(prices, "item_id").groupBy("item_id").agg(F.avg(p).alias("rate"))


def refine_calibration(scores: DataFrame, items: DataFrame, start: tuple[float, float, float], link: str = "logit", steps: int = 50, tolerance: float = 1e-10) -> dict:
    """Damped Gauss-Newton on squared errors of predicted rates, from (a, b, sigma); items: item_id, price, obs_rate.

    Each step is one aggregate over the scores with numeric derivatives; only 3 x 3 sums reach the driver.
    """
    x = np.array([start[0], start[1], math.log(start[2])])
    joined = scores.join(items, "item_id")
    cdf = normal_cdf if link == "probit" else logistic

    def fit(points: list[np.ndarray]) -> np.ndarray:
        columns = []
        for k, p in enumerate(points):
            z = (F.lit(float(p[0])) + F.lit(float(p[1])) * F.col("score") - F.col("price")) / F.lit(math.exp(float(p[2])))
            columns.append(F.avg(cdf(z)).alias(f"r{k}"))
        rows = joined.groupBy("item_id", "obs_rate").agg(*columns)
        r = [F.col(f"r{k}") - F.col("obs_rate") for k in range(len(points))]
        h = 1e-5
        if len(points) == 1:
            return np.array([rows.agg(F.sum(r[0] * r[0])).first()[0]])
        j = [(F.col(f"r{k + 1}") - F.col("r0")) / h for k in range(3)]
        sums = [F.sum(r[0] * r[0])] + [F.sum(a * r[0]) for a in j] + [F.sum(j[a] * j[b]) for a in range(3) for b in range(3)]
        return np.array(list(rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()), dtype=float)

    damping = 1e-3
    for _ in range(steps):
        s = fit([x, *(x + 1e-5 * np.eye(3)[k] for k in range(3))])
        value, gradient, hessian = s[0], s[1:4], s[4:].reshape(3, 3)
        while damping < 1e8:
            step = np.linalg.solve(hessian + damping * np.diag(np.diag(hessian) + 1e-12), -gradient)
            if fit([x + step])[0] < value:
                damping = max(damping / 10, 1e-9)
                break
            damping *= 10
        else:
            break
        x = x + step
        if np.abs(step).max() < tolerance:
            break
    return {"a": float(x[0]), "b": float(x[1]), "sigma": math.exp(float(x[2])), "loss": float(fit([x])[0])}
