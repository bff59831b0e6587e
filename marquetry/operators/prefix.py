"""Running sums over a whole table in order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.sources.scratch import saver

#: Rows of a task of a wide shuffle, so that it sorts in memory, and rows of a table of ids and counts that is broadcast.
ROWS_PER_TASK = 500_000
ROWS_BESIDE = 1_500_000


def dealt_parts(df: DataFrame) -> int:
    """Tasks for a shuffle of the rows of a saved or read table: their share stays the same however large it is."""
    return int(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK)))


def beside(df: DataFrame) -> DataFrame:
    """A saved table of ids and counts for a join: broadcast after a look at its size, else joined by key."""
    return F.broadcast(df) if df.count() <= ROWS_BESIDE else df


def running_sums(df: DataFrame, order: Column, sums: dict[str, str], before: bool = False) -> DataFrame:
    """df with a running sum per entry of sums (new name: column) in the given order, up to each row, or before it.

    Rows are range-partitioned and saved with their range's number; each range sums on its own and adds the totals of the
    ranges before it. Only these totals, one row per range, meet in one task. Rows of equal order must not exist.
    """
    ranged = saver(df.sparkSession)(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = ranged.join(F.broadcast(starts), "_range")  # one row per range
    made = {n: F.col(f"_s_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}
    return out.withColumns(made).drop("_range", *[f"_s_{n}" for n in sums])


def running_sums_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """`running_sums` that start anew in each group, of columns that are not negative: a group of any size is dealt over ranges.

    Groups and order together must tell rows apart; group columns must not be null.
    """
    keys = [F.col(g) for g in groups]
    out = running_sums(df, F.struct(*keys, *[o.alias(f"_o{k}") for k, o in enumerate(order)]), sums)
    firsts = out.groupBy(*groups).agg(*[F.min(F.col(n) - F.col(c)).alias(f"_f_{n}") for n, c in sums.items()])
    out = out.join(firsts, list(groups))
    return out.withColumns({n: F.col(n) - F.col(f"_f_{n}") for n in sums}).drop(*[f"_f_{n}" for n in sums])


def nth_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "_nth") -> DataFrame:
    """df with each row's number in its group, from 1."""
    return running_sums_within(df.withColumn("_one", F.lit(1).cast("long")), groups, order, {name: "_one"}).drop("_one")


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact linear quantiles (name: share) of a column's values that are not null; null for none.

    Values are counted by level and levels summed up by ranges, so that no task sees the whole column.
    """
    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    levels = running_sums(levels, F.col("_v"), {"_upto": "_n"})
    total = F.broadcast(levels.agg(F.sum("_n").alias("_all")))  # one row
    at = {n: F.lit(float(q)) * (F.col("_all") - 1) for n, q in shares.items()}
    value = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    ends = levels.crossJoin(total).groupBy("_all").agg(*[value(F.floor(p)).alias(f"_a{k}") for k, p in enumerate(at.values())], *[value(F.ceil(p)).alias(f"_b{k}") for k, p in enumerate(at.values())])
    made = [(F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (p - F.floor(p))).alias(n) for k, (n, p) in enumerate(at.items())]
    return ends.select(*made).groupBy().agg(*[F.max(n).alias(n) for n in shares])
