"""Which items to bundle: many compositions scanned in one job, exhaustive enumeration, local search, frozen-policy assessment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.pricing import component_prices


def scan_compositions(panel: DataFrame, prices: DataFrame, compositions: Sequence[Sequence], item_cost: float = 0.0, beside_components: bool = True, digits: int = 9) -> DataFrame:
    """(composition, price, buyers, gain) of the best bundle price of each composition (its position in the list).

    Beside components, a user's threshold is the sum of min(v, price) and the margins of components it would buy are
    displaced; alone (no components inside the bundle are sold), it is the sum of v, and every component margin of the
    items is displaced for all users, buyers or not. Complete tied blocks only; no positive gain gives a null price.
    """
    spark = panel.sparkSession
    kind = dict(panel.dtypes)["item_id"]
    rows = [(k, i) for k, c in enumerate(compositions) for i in dict.fromkeys(c)]
    table = F.broadcast(spark.createDataFrame(rows, f"composition int, item_id {'long' if kind in ('bigint', 'int') else 'string'}"))  # the list of compositions
    users = panel.select("user_id").distinct().count()
    margin = F.when(F.coalesce(F.col("v") >= F.col("price"), F.lit(False)), F.col("price") - F.lit(float(item_cost))).otherwise(F.lit(0.0))
    capped = F.when(F.col("price").isNull(), F.col("v")).otherwise(F.least("v", "price")) if beside_components else F.col("v")
    each = panel.join(prices.select("item_id", "price"), "item_id").join(table, "item_id")
    per_user = each.groupBy("composition", "user_id").agg(F.round(F.sum(capped), digits).alias("w"), F.sum(margin).alias("_a"), F.count("*").alias("_k"))
    levels = per_user.groupBy("composition", "w").agg(F.count("*").alias("_n"), F.sum("_a").alias("_d"), F.max("_k").alias("_k"))
    group = Window.partitionBy("composition")
    above = group.orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumns({"buyers": F.sum("_n").over(above), "_lost": F.sum("_d").over(above if beside_components else group), "_size": F.max("_k").over(group)})
    gain = F.round((F.col("buyers") * (F.col("w") - F.col("_size") * F.lit(float(item_cost))) - F.col("_lost")) / F.lit(max(users, 1)), digits)
    best = levels.withColumn("gain", gain).groupBy("composition").agg(F.max_by(F.struct(F.col("w").alias("price"), "buyers", "gain"), F.struct("gain", -F.col("w"))).alias("_b"))
    sold = F.col("_b.gain") > 0
    return best.select("composition", F.when(sold, F.col("_b.price")).alias("price"), F.when(sold, F.col("_b.buyers")).otherwise(F.lit(0)).alias("buyers"), F.when(sold, F.col("_b.gain")).otherwise(F.lit(0.0)).alias("gain"))


def enumerate_compositions(items: Iterable, largest: int) -> list[tuple]:
    """All sets of two to `largest` items; single ones cannot beat component prices."""
    pool = sorted(items)
    return [c for k in range(2, largest + 1) for c in combinations(pool, k)]


def _best(panel: DataFrame, prices: DataFrame, compositions: list[tuple], item_cost: float) -> tuple:
    """(gain, composition, price): ties to fewer items, then to the smaller ids."""
    rows = scan_compositions(panel, prices, compositions, item_cost).collect()  # one row per composition of a chosen list
    found = [(r["gain"], compositions[r["composition"]], r["price"]) for r in rows]
    return min(found, key=lambda f: (-f[0], len(f[1]), f[1]), default=(0.0, (), None))


def exhaustive(panel: DataFrame, largest: int, item_cost: float = 0.0) -> dict:
    """The certified best bundle beside best component prices, over all compositions of a small pool."""
    prices = component_prices(panel, item_cost)
    pool = [r[0] for r in panel.select("item_id").distinct().orderBy("item_id").toLocalIterator()]
    gain, items, price = _best(panel, prices, enumerate_compositions(pool, largest), item_cost)
    return {"items": items if gain > 0 else (), "price": price, "gain": gain, "certificate": "exhaustive"}


def local_search(panel: DataFrame, starts: Sequence[Sequence], largest: int, item_cost: float = 0.0, rounds: int = 20) -> dict:
    """The best of add, drop and swap moves from several starts; each round scans all neighbours in one job."""
    prices = component_prices(panel, item_cost)
    pool = [r[0] for r in panel.select("item_id").distinct().orderBy("item_id").toLocalIterator()]
    best = (0.0, (), None)
    for start in starts:
        here = _best(panel, prices, [tuple(sorted(start))], item_cost)
        for _ in range(rounds):
            own = set(here[1])
            moves = [own | {i} for i in pool if i not in own and len(own) < largest] + [own - {i} for i in own if len(own) > 2] + [own - {i} | {j} for i in own for j in pool if j not in own]
            options = sorted({tuple(sorted(m)) for m in moves if len(m) >= 2})
            found = _best(panel, prices, options, item_cost) if options else here
            if found[0] <= here[0]:
                break
            here = found
        if here[0] > best[0]:
            best = here
    return {"items": best[1], "price": best[2], "gain": best[0], "certificate": "local"}


def assess(panel: DataFrame, prices: DataFrame, items: Sequence, bundle_price: float, item_cost: float = 0.0) -> DataFrame:
    """One row: gain per user of a frozen bundle and frozen component prices on another panel."""
    spark = panel.sparkSession
    kind = dict(panel.dtypes)["item_id"]
    bundle = F.broadcast(spark.createDataFrame([(i,) for i in items], f"item_id {'long' if kind in ('bigint', 'int') else 'string'}"))
    inside = panel.join(bundle, "item_id", "left_semi").join(prices.select("item_id", "price"), "item_id")
    capped = F.when(F.col("price").isNull(), F.col("v")).otherwise(F.least("v", "price"))
    margin = F.when(F.coalesce(F.col("v") >= F.col("price"), F.lit(False)), F.col("price") - F.lit(float(item_cost))).otherwise(F.lit(0.0))
    per_user = inside.groupBy("user_id").agg(F.sum(capped).alias("w"), F.sum(margin).alias("_a"))
    takes = F.col("w") >= F.lit(float(bundle_price))
    gain = F.when(takes, F.lit(float(bundle_price) - item_cost * len(items)) - F.col("_a")).otherwise(F.lit(0.0))
    return per_user.agg(F.count("*").alias("users"), F.count_if(takes).alias("buyers"), F.avg(gain).alias("gain"))
