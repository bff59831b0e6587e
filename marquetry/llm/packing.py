"""Variable-capacity best-fit packing of token runs into sequences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.llm.common import WORD, materialize

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides one per token of capacity: what each sequence costs whatever its length.
OVERHEAD = 0
BUCKETS = 1024
#: Ranks are joined to their bins by blocks of so many; the plan is broadcast up to so many rows, else shuffled.
BLOCK = 1 << 20
MAX_BROADCAST_RUNS = 200_000


class Supply:
    """Items by length that are not yet promised to an open bin, and what the next bin would be filled with."""

    def __init__(self, histogram: dict[int, int]):
        self.free = {n: c for n, c in histogram.items() if n > 0 and c > 0}
        self.lengths = sorted(self.free)

    def set(self, length: int, count: int) -> None:
        known = self.free.get(length, 0) > 0
        self.free[length] = count
        if count > 0 and not known:
            insort(self.lengths, length)
        elif count <= 0 and known:
            self.lengths.pop(bisect_left(self.lengths, length))

    def filling(self, length: int, capacity: int) -> dict[int, int]:
        """What a bin of the capacity that opens for an item of `length` would hold: again and again the longest that fits."""
        room, found = capacity, {}
        k = bisect_right(self.lengths, min(length, room)) - 1
        while k >= 0:
            n = self.lengths[k]
            found[n] = min(self.free[n], room // n)
            room -= found[n] * n
            k = bisect_right(self.lengths, room, 0, k) - 1
        return found

    def opening(self, length: int, capacities: tuple[int, ...], overhead: float) -> tuple[int, dict[int, int]]:
        """The capacity of least cost per token it would hold, downsized to that, and its filling; ties to the smaller one."""
        best = None
        for capacity in capacities:
            if capacity < length:
                continue
            held = self.filling(length, capacity)
            used = sum(n * k for n, k in held.items())
            cost = (next(c for c in capacities if c >= used) + overhead) / used
            if best is None or cost < best[0]:
                best = cost, capacity, held
        return best[1:]

    def promise(self, held: dict[int, int], times: int) -> None:
        for n, k in held.items():
            self.set(n, self.free[n] - k * times)


@dataclass
class Run:
    """`count` items of `length`, ranks from `rank`, go `per_bin` to a bin into the bins from `bin`, at `offset` in each."""

    length: int
    rank: int
    count: int
    per_bin: int
    bin: int
    offset: int
    capacity: int = 0


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, opened: list[tuple[int, int]] | None = None) -> list[Run]:
    """Best-fit decreasing over a histogram of lengths with bins of several capacities, each run of bins with its final capacity.

    Items go longest first, each into the open bin with the least room that holds it (ties to the bin opened first).
    Where none does, a bin is opened. Its capacity is chosen among all permitted ones by what the items still to come
    would fill it with: the least (capacity + overhead) per token held, after downsizing. That filling is promised to the bin, so
    later openings reckon with the rest only; as many bins open at once as there are items for. At last each bin gets
    the smallest capacity that holds its contents. Bins of one history are kept as one group, so the work follows the
    number of different lengths, which the largest capacity bounds, not the number of items. opened, if given, receives
    (bins, capacity) of each opening.
    """
    capacities = tuple(sorted(capacities))
    runs: list[Run] = []
    open_bins: list[tuple[int, int, int, int]] = []  # (room, first bin, bins, used), sorted
    next_bin = 0
    supply = Supply(histogram)
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(open_bins, (length,))
            if k < len(open_bins):
                room, first, bins, used = open_bins.pop(k)
            else:
                supply.set(length, left)  # some may be promised to bins that others filled
                room, held = supply.opening(length, capacities, overhead)
                bins = max(1, min(left // held[length], *(supply.free[n] // c for n, c in held.items())))
                supply.promise(held, bins)
                first, used = next_bin, 0
                next_bin += bins
                if opened is not None:
                    opened.append((bins, room))
            each = room // length
            full = min(bins, left // each)
            if full:
                runs.append(Run(length, rank, full * each, each, first, used))
                insort(open_bins, (room - each * length, first, full, used + each * length))
                rank, left = rank + full * each, left - full * each
            rest = bins - full
            if rest and left:  # fewer than `each` are left, for one more bin
                runs.append(Run(length, rank, left, left, first + full, used))
                insort(open_bins, (room - left * length, first + full, 1, used + left * length))
                rest, left, full = rest - 1, 0, full + 1
            if rest:
                insort(open_bins, (room, first + full, rest, used))
        supply.set(length, 0)
    sizes: list[tuple[int, int, int]] = []  # (first bin, end, final capacity), neighbours of one capacity merged
    for first, bins, used in sorted((first, bins, used) for _, first, bins, used in open_bins):
        size = next(c for c in capacities if c >= used)
        if sizes and sizes[-1][2] == size:
            sizes[-1] = (sizes[-1][0], first + bins, size)
        else:
            sizes.append((first, first + bins, size))
    begins = [a for a, _, _ in sizes]
    out: list[Run] = []
    for r in runs:
        b, end = r.bin, r.bin + -(-r.count // r.per_bin)
        while b < end:
            _, stop, size = sizes[bisect_right(begins, b) - 1]
            stop = min(stop, end)
            skip = (b - r.bin) * r.per_bin
            out.append(Run(r.length, r.rank + skip, min(r.count, (stop - r.bin) * r.per_bin) - skip, r.per_bin, b, r.offset, size))
            b = stop
    return out


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: Column | None = None, key_col: str = "doc_id", text_col: str = "text", overhead: float = OVERHEAD) -> DataFrame:
    """Pack each text's tokens into sequences of the permitted capacities; one row per piece.

    `length` counts a text's tokens (words between white space unless given). Texts longer than the largest capacity
    are cut into pieces of that capacity and a remainder, so every token has a place. An empty table gives an empty
    result; columns of docs that bear the new names are replaced. Adds piece (from 0), start and
    length in tokens, bin_id, bin_capacity (after downsizing) and bin_offset; text_col is dropped. Null and empty texts
    have one piece of length 0 that takes no room: null bin_id, bin_capacity and bin_offset. Pieces of equal length are
    placed by bucket of their key's hash, then key and piece (null first); rows equal in both still get places of their own.

    The driver sees only the histogram of lengths (as many rows as the largest capacity) and plans bins for it. Rows
    find their rank among equals in BUCKETS buckets per length, so a length that a third of the rows share is dealt out.
    """
    names = ("piece", "start", "length", "bin_id", "bin_capacity", "bin_offset")
    top = max(capacities)
    tokens = length if length is not None else F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD))
    keep = [c for c in docs.columns if c not in names and (c != text_col or c == key_col)]
    pieces = materialize(docs.select(*[F.col(f"`{c}`") for c in keep], tokens.cast("long").alias("_p_n")), "lengths")
    last = F.greatest(F.ceil(F.col("_p_n") / top) - 1, F.lit(0)).cast("long")
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("start", F.col("piece") * top).withColumn("length", F.least(F.lit(top).cast("long"), F.col("_p_n") - F.col("start")))
    pieces = pieces.withColumn("_p_bucket", F.pmod(F.xxhash64(F.col(key_col), "piece"), F.lit(BUCKETS)).cast("int"))
    totals = materialize(pieces.groupBy("length", "_p_bucket").count(), "totals")
    histogram = {int(r[0]): int(r[1]) for r in totals.groupBy("length").agg(F.sum("count")).toLocalIterator()}
    runs = plan_bins(histogram, tuple(capacities), overhead)

    by_length = Window.partitionBy("length").orderBy("_p_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("length", "_p_bucket", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("_p_first"))
    nth = F.row_number().over(Window.partitionBy("length", "_p_bucket").orderBy(F.col(key_col), "piece")) - 1
    ranked = pieces.withColumn("_p_nth", nth).join(firsts, ["length", "_p_bucket"])
    ranked = ranked.withColumn("_p_rank", F.col("_p_first") + F.col("_p_nth"))
    ranked = ranked.withColumn("_p_block", F.expr(f"_p_rank div {BLOCK}"))

    rows = [(r.length, b, r.rank, r.rank + r.count, r.per_bin, r.bin, r.offset, r.capacity) for r in runs for b in range(r.rank // BLOCK, (r.rank + r.count - 1) // BLOCK + 1)]
    names = ("length", "_p_block", "_p_from", "_p_to", "_p_each", "_p_bin", "_p_offset", "bin_capacity")
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    plan = pa.table({n: pa.array(c, pa.int32() if n == "bin_capacity" else pa.int64()) for n, c in zip(names, columns, strict=True)})
    places = docs.sparkSession.createDataFrame(plan)  # by Arrow, so that no task runs Python
    if len(rows) <= MAX_BROADCAST_RUNS:
        places = F.broadcast(places)
    inside = (ranked["length"] == places["length"]) & (ranked["_p_block"] == places["_p_block"]) & (F.col("_p_rank") >= F.col("_p_from")) & (F.col("_p_rank") < F.col("_p_to"))
    at = F.col("_p_rank") - F.col("_p_from")
    return ranked.join(places, inside, "left").select(
        *[F.col(f"`{c}`") for c in keep],
        "piece",
        "start",
        ranked["length"],
        (F.col("_p_bin") + F.expr("(_p_rank - _p_from) div _p_each")).alias("bin_id"),
        "bin_capacity",
        (F.col("_p_offset") + F.pmod(at, F.col("_p_each")) * ranked["length"]).alias("bin_offset"),
    )
