"""The best size menu on a whole grid of prices: menus are numbers that tasks decode, and bounds leave out whole prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.operators.pricing import size_costs, top_sums
from marquetry.sources.scratch import discard, saver

#: Distinct rows of top sums in a block of users, and prefixes that a block judges at once.
ROWS_PER_BLOCK = 4096
PREFIXES_PER_PACK = 32
#: Choices (users times menus) that a task holds at once.
CHOICES = 1_000_000
#: Profits that differ by less are ties, which go to the menu of the smallest number.
DIGITS = 9


@dataclass(frozen=True)
class _Grid:
    """Prices of each size from 0 to the greatest sum; a menu's number has one digit per size, the first size the highest."""

    tops: tuple[float, ...]
    costs: tuple[float, ...]
    sizes: tuple[int, ...]
    points: int

    def unit(self, at: int) -> int:
        return self.points ** (len(self.sizes) - 1 - at)

    def prices(self, numbers: np.ndarray, at: int) -> np.ndarray:
        return np.linspace(0.0, self.tops[at], self.points)[numbers // self.unit(at) % self.points]

    def judged(self, w: np.ndarray, n: np.ndarray, numbers: np.ndarray, fixed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, values) summed over users: the most that menus with these fixed prices can earn, and what they earn alone.

        A user who takes a fixed offer takes one of the best surplus among them; one who takes a size still open keeps at least that
        surplus, so it pays no more than its value of the size less what it would have kept.
        """
        best = np.full((len(w), len(numbers)), -np.inf)
        prices = {a: self.prices(numbers, a) for a in fixed}
        for a, price in prices.items():
            np.maximum(best, w[:, a, None] - price, out=best)
        rest = np.max([np.zeros(len(w)), *[w[:, a] - self.costs[a] for a in range(len(self.sizes)) if a not in fixed]], axis=0)
        cap = np.maximum(0.0, rest[:, None] - np.maximum(best, 0.0))
        lowest, margin = np.full(best.shape, np.inf), np.zeros(best.shape)
        for a in sorted(fixed, key=lambda a: self.sizes[a]):
            near = (w[:, a, None] - prices[a] >= best - 1e-12) & (best > 1e-12)
            np.maximum(cap, np.where(near, prices[a] - self.costs[a], 0.0), out=cap)
            taken = near & (prices[a] < lowest)
            lowest = np.where(taken, prices[a], lowest)
            margin = np.where(taken, prices[a] - self.costs[a], margin)
        return n @ cap, n @ margin

    def judge(self, fixed: Sequence[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Prefixes with each price of the size that comes next, against one block of users a row."""
        at = fixed[-1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for numbers, w, n in zip(batch["numbers"], batch["w"], batch["n"], strict=True):
                    w, n = np.frombuffer(w).reshape(-1, len(self.sizes)), np.frombuffer(n)
                    tried = (np.asarray(numbers)[:, None] + np.arange(self.points) * self.unit(at)).reshape(-1)
                    for part in np.array_split(tried, max(1, -(-len(tried) * len(w) // CHOICES))):
                        bound, value = self.judged(w, n, part, fixed)
                        yield pd.DataFrame({"number": part, "bound": bound, "value": value})

        return run


def _blocks(panel: DataFrame, sizes: Sequence[int], floor: bool, save) -> tuple[DataFrame, int, int, list[float]]:
    """(blocks of weighted top sums, their number, users, greatest sums). Users of equal sums are one row; a missing size is never bought."""
    sums = [F.max(F.when(F.col("size") == int(s), F.col("w"))).alias(f"w{k}") for k, s in enumerate(sizes)]
    names = [f"w{k}" for k in range(len(sizes))]
    rows = save(top_sums(panel, sizes, floor).groupBy("user_id").agg(*sums).groupBy(*names).agg(F.count("*").alias("n")))
    got = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("users"), *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names]).first()
    count = max(1, -(-got["rows"] // ROWS_PER_BLOCK))

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(names, ignore_index=True)
        w = block[names].astype("float64").fillna(-np.inf).to_numpy()
        return pd.DataFrame({"block": [block["block"].iloc[0]], "w": [np.ascontiguousarray(w).tobytes()], "n": [block["n"].to_numpy(dtype=np.float64).tobytes()]})

    packed = save(rows.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(count)).cast("int")).groupBy("block").applyInPandas(pack, "block int, w binary, n binary"))
    discard(rows)
    return packed, count, int(got["users"]), [float(got[c]) for c in names]


def price_grid(panel: DataFrame, sizes: Sequence[int], points: int = 40, cost: float | Sequence[float] = 0.0, floor: bool = True, save=None, judged: list | None = None) -> DataFrame:
    """(size, price, profit, menu) of the most profitable menu among all with `points` prices a size, from 0 to its greatest sum.

    Choices are those of `pricing.user_choices`; profit is a mean over users, equal to DIGITS places is a tie, and ties go to
    the smallest number (the first size's price the slowest). An empty panel gives no rows.

    Branch and bound by sizes, the largest first: prefixes of a size more are judged by blocks of users, a sum of bounds and one
    of profits (with the open sizes at their top price, which nobody pays) per prefix are merged, and prefixes whose bound is
    under the best profit go. Prefixes are a table of numbers, dealt into packs; the driver sees the best profit of each level.
    judged receives the number of prefixes of every level.
    """
    spark = panel.sparkSession
    save = save or saver(spark)
    if points < 2 or points ** len(sizes) >= 2**63 or len(set(sizes)) != len(sizes):
        raise ValueError("a grid needs two points a size, distinct sizes, and fewer than 2^63 menus")
    blocks, count, users, tops = _blocks(panel, sizes, floor, save)
    made = "size int, price double, profit double, menu long"
    if not users:
        return spark.createDataFrame([], made)
    grid = _Grid(tuple(tops), tuple(size_costs(cost, sizes)), tuple(int(s) for s in sizes), points)
    order = sorted(range(len(sizes)), key=lambda a: -grid.sizes[a])
    tasks = 2 * spark.sparkContext.defaultParallelism
    levels, best = spark.range(1).select(F.col("id").alias("number")), 0.0
    for depth in range(1, len(sizes) + 1):
        number = max(1, -(-levels.count() // PREFIXES_PER_PACK))
        packs = levels.groupBy(F.pmod(F.xxhash64("number"), F.lit(number)).alias("pack"))
        packs = packs.agg(F.array_sort(F.collect_list("number")).alias("numbers"))  # about PREFIXES_PER_PACK
        pairs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(blocks, "block").repartition(tasks)
        each = pairs.select("numbers", "w", "n").mapInPandas(grid.judge(order[:depth]), "number long, bound double, value double")
        summed = save(each.groupBy("number").agg(F.sum("bound").alias("bound"), F.sum("value").alias("value")))
        got = summed.agg(F.count("*").alias("n"), F.max("value").alias("value"), F.max_by("number", F.struct(F.round(F.col("value") / users, DIGITS), -F.col("number"))).alias("number")).first()
        best = max(best, got["value"])
        if judged is not None:
            judged.append(got["n"])
        levels = summed.where((F.col("bound") - best) / users >= -(10.0**-DIGITS)).select("number")
    menu = int(got["number"])
    price = [float(grid.prices(np.array([menu]), a)[0]) for a in range(len(sizes))]
    profit = float(summed.where(F.col("number") == menu).first()["value"]) / users
    return spark.createDataFrame([(s, p, profit, menu) for s, p in zip(grid.sizes, price, strict=True)], made)
