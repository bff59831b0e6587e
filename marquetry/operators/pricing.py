"""Prices over valuation panels (user_id, item_id, v): top sums, menus, benchmarks and fixed-bundle scans, as windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.prefix import running_sums, running_sums_within


def size_costs(cost: float | Sequence[float], sizes: Sequence[int]) -> list[float]:
    """Total cost per size: a number is the cost of one item, a list must give a total for each size."""
    if isinstance(cost, (int, float)):
        return [float(cost) * s for s in sizes]
    if len(cost) != len(sizes):
        raise ValueError(f"{len(cost)} costs for {len(sizes)} sizes")
    return [float(c) for c in cost]


def top_sums(panel: DataFrame, sizes: Sequence[int], floor: bool = False) -> DataFrame:
    """(user_id, size, w): the sum of each user's `size` greatest values, floored at 0 first if floor; sizes beyond a user's items are left out."""
    rows = panel.withColumn("v", F.greatest("v", F.lit(0.0))) if floor else panel
    order = Window.partitionBy("user_id").orderBy(F.desc("v"), "item_id")
    rows = rows.withColumn("size", F.row_number().over(order)).withColumn("w", F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("size").isin([int(s) for s in sizes])).select("user_id", "size", "w")


def menu_table(panel: DataFrame, prices: Sequence[float], sizes: Sequence[int], cost: float | Sequence[float] = 0.0) -> DataFrame:
    rows = [(int(s), float(p), c) for s, p, c in zip(sizes, prices, size_costs(cost, sizes), strict=True)]
    return F.broadcast(panel.sparkSession.createDataFrame(rows, "size int, price double, cost double"))  # one row per size


def user_choices(sums: DataFrame, menu: DataFrame) -> DataFrame:
    """(user_id, size, price, margin) of each user's choice; null where no offer leaves more than 1e-12.

    Among offers within 1e-12 of the best surplus the lower price wins, then the smaller size. Two aggregates, no sort.
    """
    rows = sums.join(menu, "size").withColumn("surplus", F.col("w") - F.col("price"))
    best = Window.partitionBy("user_id")
    rows = rows.withColumn("_best", F.max("surplus").over(best))
    near = F.when((F.col("surplus") >= F.col("_best") - 1e-12) & (F.col("_best") > 1e-12), F.struct("price", "size", (F.col("price") - F.col("cost")).alias("margin")))
    out = rows.groupBy("user_id").agg(F.min(near).alias("_pick"))
    return out.select("user_id", F.col("_pick.size").alias("size"), F.col("_pick.price").alias("price"), F.col("_pick.margin").alias("margin"))


def evaluate_menu(panel: DataFrame, prices: Sequence[float], sizes: Sequence[int], cost: float | Sequence[float] = 0.0, floor: bool = True) -> DataFrame:
    """One row: users, buyers, mean profit per user and outside share of a size-price menu."""
    picks = user_choices(top_sums(panel, sizes, floor), menu_table(panel, prices, sizes, cost))
    return picks.agg(F.count("*").alias("users"), F.count("size").alias("buyers"), F.avg(F.coalesce("margin", F.lit(0.0))).alias("profit"), (1 - F.count("size") / F.count("*")).alias("outside_share"))


def choice_shares(panel: DataFrame, prices: Sequence[float], sizes: Sequence[int], cost: float | Sequence[float] = 0.0, floor: bool = True) -> DataFrame:
    """(size, users, share) of realised choices; size 0 is the outside option."""
    picks = user_choices(top_sums(panel, sizes, floor), menu_table(panel, prices, sizes, cost))
    counts = picks.groupBy(F.coalesce("size", F.lit(0)).alias("size")).agg(F.count("*").alias("users"))
    return counts.withColumn("share", F.col("users") / F.sum("users").over(Window.partitionBy()))  # as many rows as sizes


def price_scan(values: DataFrame, by: Sequence[str], value: str, cost: float = 0.0, users: int | None = None) -> DataFrame:
    """Per group the best price at an observed value: by, price, buyers, profit per user; nulls and 0 for no sale.

    Values are counted by level first, so a tied block is never split; levels are summed up by ranges, so a large group is dealt out. Ties of
    profit go to the smallest price. `users` is the panel's size, or the group's rows.
    """
    levels = values.groupBy(*by, F.col(value).alias("price")).agg(F.count("*").alias("_n"))
    levels = running_sums_within(levels, by, [-F.col("price")], {"buyers": "_n"})
    if users:
        levels = levels.withColumn("_users", F.lit(users))
    else:
        levels = levels.join(values.groupBy(*by).agg(F.count("*").alias("_users")), list(by))
    levels = levels.withColumn("profit", (F.col("price") - F.lit(float(cost))) * F.col("buyers") / F.col("_users"))
    best = levels.groupBy(*by).agg(F.max_by(F.struct("price", "buyers", "profit"), F.struct("profit", -F.col("price"))).alias("_b"))
    sold = F.col("_b.profit") > 0
    return best.select(*by, F.when(sold, F.col("_b.price")).alias("price"), F.when(sold, F.col("_b.buyers")).otherwise(F.lit(0)).alias("buyers"), F.when(sold, F.col("_b.profit")).otherwise(F.lit(0.0)).alias("profit"))


def component_prices(panel: DataFrame, cost: float = 0.0) -> DataFrame:
    """Best separate price of each item."""
    users = panel.select("user_id").distinct().count()
    return price_scan(panel, ["item_id"], "v", cost, users)


def separate_selling(panel: DataFrame, cost: float = 0.0) -> DataFrame:
    """One row: profit per user of the best separate prices."""
    return component_prices(panel, cost).agg(F.sum("profit").alias("profit"))


def pure_bundling(panel: DataFrame, cost: float = 0.0) -> DataFrame:
    """One row: the best price of the bundle of all items at total cost `cost`."""
    sums = panel.groupBy("user_id").agg(F.sum("v").alias("w"))
    levels = running_sums(sums.groupBy(F.col("w").alias("price")).agg(F.count("*").alias("_n")), F.desc("price"), {"buyers": "_n"})
    users = levels.agg(F.sum("_n")).first()[0] or 1
    levels = levels.withColumn("profit", (F.col("price") - F.lit(float(cost))) * F.col("buyers") / F.lit(users))
    best = levels.agg(F.max_by(F.struct("price", "buyers", "profit"), F.struct("profit", -F.col("price"))).alias("_b"))
    sold = F.col("_b.profit") > 0
    return best.select(F.when(sold, F.col("_b.price")).alias("price"), F.when(sold, F.col("_b.buyers")).otherwise(F.lit(0)).alias("buyers"), F.when(sold, F.col("_b.profit")).otherwise(F.lit(0.0)).alias("profit"))


def bundle_thresholds(panel: DataFrame, prices: DataFrame, bundle: DataFrame, item_cost: float = 0.0) -> DataFrame:
    """(user_id, w, displaced) for a bundle (item_id) sold beside its components at `prices` (item_id, price; null for no sale).

    w: sum of min(v, price), the bundle price at which the user is indifferent; displaced: margin of components it buys.
    An item that is not sold adds its whole value to w and displaces nothing.
    """
    inside = panel.join(bundle.select("item_id").distinct(), "item_id", "left_semi").join(prices.select("item_id", "price"), "item_id")
    capped = F.when(F.col("price").isNull(), F.col("v")).otherwise(F.least("v", "price"))
    margin = F.when(F.coalesce(F.col("v") >= F.col("price"), F.lit(False)), F.col("price") - F.lit(float(item_cost))).otherwise(F.lit(0.0))
    return inside.groupBy("user_id").agg(F.sum(capped).alias("w"), F.sum(margin).alias("displaced"))


def fixed_bundle_scan(thresholds: DataFrame, bundle_cost: float = 0.0, users: int | None = None, digits: int = 9) -> DataFrame:
    """One row: the best bundle price over complete tied blocks, buyers and gain per user over component prices.

    gain = (buyers * (price - cost) - displaced margins) / users at each distinct w; null price and 0 gain if none is
    positive; equal gains go to the smallest price. Thresholds tie after rounding to `digits`.
    """
    rounded = thresholds.withColumn("price", F.round("w", digits))
    levels = rounded.groupBy("price").agg(F.count("*").alias("_n"), F.sum("displaced").alias("_d"))
    levels = running_sums(levels, F.desc("price"), {"buyers": "_n", "_lost": "_d"})
    total = users or levels.agg(F.sum("_n")).first()[0] or 1
    levels = levels.withColumn("gain", F.round((F.col("buyers") * (F.col("price") - F.lit(float(bundle_cost))) - F.col("_lost")) / F.lit(total), digits))
    best = levels.agg(F.max_by(F.struct("price", "buyers", "gain"), F.struct("gain", -F.col("price"))).alias("_b"))
    sold = F.col("_b.gain") > 0
    return best.select(F.when(sold, F.col("_b.price")).alias("price"), F.when(sold, F.col("_b.buyers")).otherwise(F.lit(0)).alias("buyers"), F.when(sold, F.col("_b.gain")).otherwise(F.lit(0.0)).alias("gain"))


def menu_search(panel: DataFrame, menus: Sequence[Sequence[float]], sizes: Sequence[int], cost: float | Sequence[float] = 0.0, floor: bool = True) -> DataFrame:
    """(menu, profit) of many menus in one job: top sums once, a small broadcast table of menus, one aggregate per user and menu."""
    costs = size_costs(cost, sizes)
    rows = [(k, int(s), float(p), c) for k, prices in enumerate(menus) for s, p, c in zip(sizes, prices, costs, strict=True)]
    table = F.broadcast(panel.sparkSession.createDataFrame(rows, "menu int, size int, price double, cost double"))
    offers = top_sums(panel, sizes, floor).join(table, "size").withColumn("surplus", F.col("w") - F.col("price"))
    # Best surplus first, near-ties resolved among the few offers of one user and menu.
    gathered = offers.groupBy("menu", "user_id").agg(F.collect_list(F.struct("price", "size", "surplus", "cost")).alias("o"))
    best = F.aggregate("o", F.lit(float("-inf")), lambda m, x: F.greatest(m, x["surplus"]))
    gathered = gathered.withColumn("_best", best)
    near = F.array_min(F.filter("o", lambda x: x["surplus"] >= F.col("_best") - 1e-12))
    margin = F.when(F.col("_best") > 1e-12, near["price"] - near["cost"]).otherwise(F.lit(0.0))
    return gathered.groupBy("menu").agg(F.avg(margin).alias("profit"))


def optimise_menu(panel: DataFrame, sizes: Sequence[int], cost: float | Sequence[float] = 0.0, rounds: int = 20, population: int = 16, seed: int = 0, start: Sequence[float] | None = None, floor: bool = True) -> tuple[list[float], float]:
    """(prices, profit) of a size menu by differential evolution; all candidates of a round are one `menu_search`.

    Prices start between 0 and the greatest top sum of their size, and are kept in order of size. Every round makes for each menu
    a mutant from the best and two others and keeps the better one, so profit never falls.
    """
    import numpy as np

    sums = panel.sparkSession.createDataFrame([(int(s),) for s in sizes], "size int").join(top_sums(panel, sizes, floor), "size").groupBy("size").agg(F.max("w").alias("top"))
    tops = {r["size"]: float(r["top"]) for r in sums.collect()}  # one row per size
    high = np.array([tops.get(int(s), 0.0) for s in sizes])
    rng = np.random.default_rng(seed)
    menus = np.sort(rng.random((population, len(sizes))), axis=1) * high
    if start is not None:
        menus[0] = start

    def profits(rows: np.ndarray) -> np.ndarray:
        got = {r["menu"]: r["profit"] for r in menu_search(panel, np.maximum.accumulate(rows, axis=1).tolist(), sizes, cost, floor).collect()}  # one row per menu
        return np.array([got.get(k, 0.0) for k in range(len(rows))])

    value = profits(menus)
    for _ in range(rounds):
        one, two = (rng.integers(0, population, population) for _ in range(2))
        mutant = menus + 0.7 * (menus[value.argmax()] - menus) + 0.6 * (menus[one] - menus[two])
        cross = rng.random(menus.shape) < 0.8
        mutant = np.clip(np.where(cross, mutant, menus), 0.0, high)
        made = profits(mutant)
        better = made > value
        menus[better], value[better] = mutant[better], made[better]
    best = int(value.argmax())
    return np.maximum.accumulate(menus[best]).tolist(), float(value[best])


def moments(panel: DataFrame, sizes: Sequence[int], floor: bool = False) -> DataFrame:
    """(size_a, size_b, omega_a, omega_b, sigma): means and sample covariances of top sums, for size_a <= size_b."""
    w = top_sums(panel, sizes, floor)
    other = w.select("user_id", F.col("size").alias("size_b"), F.col("w").alias("w_b"))
    both = w.withColumnRenamed("size", "size_a").join(other, "user_id").where("size_a <= size_b")
    return both.groupBy("size_a", "size_b").agg(F.avg("w").alias("omega_a"), F.avg("w_b").alias("omega_b"), F.covar_samp("w", "w_b").alias("sigma"))


def shrunk_moments(panel: DataFrame, sizes: Sequence[int], floor: bool = False, about: Sequence[float] | None = None) -> DataFrame:
    """(size_a, size_b, omega_a, omega_b, sigma, shrunk, weight) for size_a <= size_b, over users that have every size.

    sigma is the sample covariance of top sums and shrunk the Ledoit-Wolf one, (1 - weight) S + weight * mean variance * I with S over
    n. One aggregate gives both: sums of y, y y', |y|^2 y and |y|^4, where y is what a user's sums exceed `about` (0 unless given;
    a rough centre keeps digits where means are large against deviations). These merge in any order; the weight's noise term needs
    no more of the fourth moments than the mean of |y - mean|^4. One row of sums reaches the driver. Fewer than two users give no rows.
    """
    import numpy as np

    m = len(sizes)
    centre = [float(c) for c in about] if about is not None else [0.0] * m
    names = [f"w{k}" for k in range(m)]
    wide = top_sums(panel, sizes, floor).groupBy("user_id").agg(*[F.max(F.when(F.col("size") == int(s), F.col("w") - F.lit(c))).alias(n) for n, s, c in zip(names, sizes, centre, strict=True)]).dropna(subset=names)
    square = sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    got = wide.withColumn("_q", square).agg(
        F.count("*").alias("n"), F.sum(F.col("_q") * F.col("_q")).alias("q"),
        *[F.sum(c).alias(f"s{k}") for k, c in enumerate(names)], *[F.sum(F.col("_q") * F.col(c)).alias(f"t{k}") for k, c in enumerate(names)],
        *[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"p{a}_{b}") for a, b in pairs],
    ).first()
    made = "size_a int, size_b int, omega_a double, omega_b double, sigma double, shrunk double, weight double"
    n = got["n"]
    if n < 2:
        return panel.sparkSession.createDataFrame([], made)
    mean, third = (np.array([got[f"{c}{k}"] for k in range(m)]) / n for c in "st")
    raw = np.array([[got[f"p{min(a, b)}_{max(a, b)}"] for b in range(m)] for a in range(m)]) / n
    s = raw - np.outer(mean, mean)
    size = mean @ mean
    fourth = got["q"] / n - 4 * third @ mean + 4 * mean @ raw @ mean + 2 * np.trace(raw) * size - 3 * size * size
    target = np.trace(s) / m
    distance = ((s - target * np.eye(m)) ** 2).sum() / m
    noise = max(0.0, fourth - (s**2).sum()) / (n * m)
    weight = 0.0 if distance <= 0 else float(min(noise, distance) / distance)
    shrunk = (1 - weight) * s + weight * target * np.eye(m)
    omega = mean + np.array(centre)
    rows = [(int(sizes[a]), int(sizes[b]), float(omega[a]), float(omega[b]), float(s[a, b] * n / (n - 1)), float(shrunk[a, b]), weight) for a, b in pairs]
    return panel.sparkSession.createDataFrame(rows, made)


def calibrated_panel(scores: DataFrame, calibration: DataFrame, floor: bool = True) -> DataFrame:
    """(user_id, item_id, v): scores (user_id, item_id, score) as values a + b * score of a one-row calibration (a, b), floored at 0 if floor."""
    line = F.broadcast(calibration.select(F.col("a").alias("_a"), F.col("b").alias("_b")))  # one row
    v = F.col("_a") + F.col("_b") * F.col("score")
    return scores.crossJoin(line).select("user_id", "item_id", (F.greatest(v, F.lit(0.0)) if floor else v).alias("v"))
