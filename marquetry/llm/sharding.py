"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, subdivided where overfull."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.llm.common import materialize

MAX_RANGES = 8192
ROWS_PER_RANGE = 1024
SAMPLES_PER_RANGE = 32
OVERFULL = 4
NAMES = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def splitters(sized: DataFrame, total: int, n_ranges: int) -> np.ndarray:
    """Quantile boundaries of _s_key under the weight _s_size, from a deterministic sample.

    A row is drawn with a chance in proportion to its size, decided by a hash of key and checksum, so that a
    recomputed task draws the same rows. About SAMPLES_PER_RANGE * n_ranges keys reach the driver, whatever the
    input. A key that fills a whole quantile gets a range of its own.
    """
    unit = F.pmod(F.xxhash64("_s_key", "_s_crc", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sized.where(F.col("_s_key").isNotNull() & (unit < F.col("_s_size") * F.lit(SAMPLES_PER_RANGE * n_ranges / max(total, 1))))
    keys = np.sort(np.array([r[0] for r in drawn.select("_s_key").toLocalIterator()], dtype=np.int64))
    if not len(keys):
        return keys
    cuts, times = np.unique(keys[(np.arange(1, n_ranges) * len(keys)) // n_ranges], return_counts=True)
    return np.union1d(cuts, cuts[(times > 1) & (cuts < np.iinfo(np.int64).max)] + 1)


def subdivisions(ranged: DataFrame, crowded: dict[int, int], share: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Boundaries (keys, checksums, numbers) inside each crowded range: quantiles of a sample of its rows, by hash.

    About SAMPLES_PER_RANGE rows for each part that a range is cut into reach the driver.
    """
    unit = F.pmod(F.xxhash64("_s_key", "_s_crc", "_s_number", F.lit(19)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = ranged.where(F.col("_s_range").isin(list(crowded)) & (unit < F.lit(SAMPLES_PER_RANGE / share)))
    found: dict[int, list[tuple[int, int, int]]] = {r: [] for r in crowded}
    for r, *row in drawn.select("_s_range", F.coalesce("_s_key", F.lit(0).cast("long")), "_s_crc", "_s_number").toLocalIterator():
        found[r].append(tuple(row))
    out = {}
    for r, rows in found.items():
        rows.sort()
        parts = crowded[r] // share + 1
        picked = sorted({rows[k * len(rows) // parts] for k in range(1, parts)}) if rows else []
        out[r] = tuple(np.array([x[c] for x in picked], dtype=np.int64) for c in range(3))
    return out


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows into n_shards runs of key_col of near equal bytes; text_col is replaced by size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: a row's size is its text's UTF-8 bytes plus 1; its shard is n_shards * (bytes before it + half its
    size) div all bytes, with rows ordered by key (null first), then checksum. So each boundary is off by half a
    row at most. Slots count from 0 without gaps in each shard. A null text has size 1 and checksum 0. Rows of equal
    key and text are interchangeable; each gets a slot of its own. An empty table gives an empty result.

    No task sees the whole order: splitters cut the keys into ranges; a range with over OVERFULL times its share of
    rows is subdivided at quantiles of a sample of its own rows by key, checksum and number, so that clustered keys, one key
    or one text that fills a range are cut as well; every range adds the totals of the ranges before it. Only these totals
    meet in one task, at most MAX_RANGES of them besides subdivisions. The splitters decide which task orders a row; the
    totals make shard boundaries exact, so they are those of the whole order, whatever the sample.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in NAMES and (c != text_col or c == key_col)]
    sized = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(key_col).cast("long").alias("_s_key"),
        (F.octet_length(text) + 1).cast("long").alias("_s_size"),
        F.crc32(text.cast("binary")).alias("_s_crc"),
        F.monotonically_increasing_id().alias("_s_number"),  # kept once written; tells equal rows apart
    )
    sized = materialize(sized, "sized")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("_s_size"), F.lit(0))).first()
    n_ranges = int(min(MAX_RANGES, max(64, n // ROWS_PER_RANGE)))
    cuts = splitters(sized, total, n_ranges)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(cuts, keys.to_numpy(dtype=np.int64), side="right") + 1).astype(np.int32))

    # Range 0 holds null keys, which never reach Python: they would turn a batch into floating point numbers.
    ranged = sized.withColumn("_s_range", F.when(F.col("_s_key").isNull(), F.lit(0)).otherwise(range_of(F.coalesce("_s_key", F.lit(0).cast("long")))))
    share = max(n // (len(cuts) + 1), 64)
    crowded = {r: rows for r, rows in ranged.groupBy("_s_range").agg(F.count("*").alias("n")).where(F.col("n") > OVERFULL * share).toLocalIterator()}
    within = subdivisions(ranged, crowded, share) if crowded else {}

    @F.pandas_udf("int")
    def sub_of(ranges: pd.Series, keys: pd.Series, crcs: pd.Series, numbers: pd.Series) -> pd.Series:
        """How many of its range's boundaries stand before each row, by one sort of rows and boundaries."""
        out = np.zeros(len(ranges), dtype=np.int32)
        for r in np.unique(ranges):
            if r in within:
                mine, cut = np.flatnonzero(ranges == r), within[r]
                order = np.lexsort([np.concatenate([c, x.to_numpy()[mine]]) for c, x in zip(cut[::-1], (numbers, crcs, keys), strict=True)])
                passed = np.cumsum(order < len(cut[0]))
                rows = order >= len(cut[0])
                out[mine[order[rows] - len(cut[0])]] = passed[rows]
        return pd.Series(out)

    zero = F.lit(0).cast("long")
    sub = F.when(F.col("_s_range").isin(list(within)), sub_of("_s_range", F.coalesce("_s_key", zero), "_s_crc", "_s_number")).otherwise(F.lit(0)) if within else F.lit(0)
    part = ["_s_range", "_s_sub"]
    ranged = ranged.withColumn("_s_sub", sub)
    totals = ranged.groupBy(*part).agg(F.sum("_s_size").alias("_s_bytes"), F.count("*").alias("_s_rows"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*part, *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(b) for a, b in (("_s_bytes", "_s_start"), ("_s_rows", "_s_first"))])
    inside = Window.partitionBy(*part).orderBy(F.col("_s_key").asc_nulls_first(), "_s_crc", "_s_number").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({"_s_cum": F.coalesce(F.sum("_s_size").over(inside), F.lit(0)), "_s_nth": F.count("*").over(inside)})
    placed = placed.join(F.broadcast(starts), part)  # bounded by MAX_RANGES and the subdivisions
    shard = F.expr(f"({n_shards} * (2 * (_s_start + _s_cum) + _s_size)) div {2 * max(total, 1)}")
    placed = placed.select(*keep, "_s_size", "_s_crc", F.least(shard, F.lit(n_shards - 1)).cast("int").alias("_s_shard"), (F.col("_s_first") + F.col("_s_nth")).alias("_s_rank"))
    placed = materialize(placed, "placed")
    firsts = placed.groupBy("_s_shard").agg(F.min("_s_rank").alias("_s_zero"))
    return placed.join(F.broadcast(firsts), "_s_shard").select(  # one row per shard
        *[F.col(f"`{c}`") for c in keep],
        F.col("_s_size").alias("size"),
        F.col("_s_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_s_shard").alias("shard"),
        (F.col("_s_rank") - F.col("_s_zero")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
