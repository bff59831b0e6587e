"""Edges laid out once for the rounds of a factor model whose vectors are files of the shared folder that tasks map.

A round over one side is one job without a shuffle: a task takes stretches of that side's edges, works out the vectors of the keys
it sees whole, writes them to a file and returns its name and their k x k Gram sum. Keys that stretches share, at most two a
stretch, come back as sums, which the driver adds up and finishes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.sources import arrays
from marquetry.sources.scratch import discard

#: Edges of a stretch, and edges that a task takes up at once.
EDGES_PER_STRETCH = 400_000
AT_ONCE = 65_536

_STRETCH = "first long, here binary, at binary, confidence binary"
_WROTE = "first long, n long, file string, gram binary, extra double, cut array<struct<k: long, sums: binary>>"


@dataclass(frozen=True)
class Vectors:
    """Rows of one side by their number, with their Gram matrix and what the round summed beside them."""

    held: arrays.Mapped
    gram: np.ndarray
    extra: float = 0.0


@dataclass(frozen=True)
class Side:
    """One side's keys by ascending id and its edges in stretches; cut: numbers of keys that stretches share."""

    ids: arrays.Mapped
    laid: DataFrame
    cut: frozenset

    @property
    def n(self) -> int:
        return self.ids.n

    def drop(self) -> None:
        discard(self.laid)
        self.ids.drop()


def sides(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> tuple[Side, Side]:
    """(users, items) of edges (user_id, item_id, confidence)."""
    ids, made = {}, []
    for key in ("user_id", "item_id"):
        names = save(edges.select(F.col(key).cast("long").alias("id")).distinct())
        ids[key] = arrays.mapped(names, "id", names.count(), 0)[0]
        discard(names)
    parts = int(max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // EDGES_PER_STRETCH))
    for key, other in (("user_id", "item_id"), ("item_id", "user_id")):
        rows = edges.select(F.col(key).cast("long"), F.col(other).cast("long"), F.col("confidence").cast("double")).repartitionByRange(parts, key, other).sortWithinPartitions(key, other)
        laid = save(rows.mapInPandas(_packer(ids[key], ids[other], key, other), _STRETCH))
        ends = sorted((r[0], r[0] + r[1] // 4 - 1) for r in laid.select("first", F.length("here")).collect())  # one row for each stretch
        cut = frozenset(b for (_, b), (a, _) in zip(ends, ends[1:], strict=False) if a == b)
        made.append(Side(ids[key], laid, cut))
    return made[0], made[1]


def _packer(own: arrays.Mapped, ends: arrays.Mapped, key: str, other: str) -> Callable:
    def packed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts)
        keys = np.searchsorted(own.ids(), rows[key].to_numpy())
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        here = np.diff(np.r_[starts, len(keys)]).astype(np.int32)
        at = np.searchsorted(ends.ids(), rows[other].to_numpy()).astype(np.int32)
        return pd.DataFrame({"first": [keys[0]], "here": [here.tobytes()], "at": [at.tobytes()], "confidence": [rows["confidence"].to_numpy(dtype=np.float64).tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n >= EDGES_PER_STRETCH:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return pack


def chunks(here: np.ndarray, size: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of keys with about so many edges; a key of more stands alone."""
    ends, a = np.cumsum(here), 0
    while a < len(here):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, b
        a = b


def swept(side: Side, folder: str, width: int, dtype: str, whole: Callable, partial: Callable, finish: Callable) -> Vectors:
    """New vectors of a side.

    whole(first, here, at, confidence) gives the rows of keys that are all there, numbered from first, and a number to be summed;
    partial(at, confidence) the flat sums of some of a key's edges; finish(number, sums) the row of a key whose sums are added up,
    and its number.
    """

    shared = side.cut

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (row for batch in batches for row in batch.itertuples()):
            here, at, c = np.frombuffer(row.here, np.int32), np.frombuffer(row.at, np.int32), np.frombuffer(row.confidence, np.float64)
            starts = np.r_[0, np.cumsum(here)]
            lo = int(row.first in shared)
            hi = len(here) - int(len(here) > lo and row.first + len(here) - 1 in shared)
            rows, gram, extra = np.empty((hi - lo, width), dtype), np.zeros((width, width)), 0.0
            for a, b in chunks(here[lo:hi]):
                a, b = a + lo, b + lo
                e = slice(starts[a], starts[b])
                made, more = whole(row.first + a, here[a:b], at[e], c[e])
                rows[a - lo : b - lo] = made
                wide = rows[a - lo : b - lo].astype(np.float64)
                gram += wide.T @ wide
                extra += more
            cut = [{"k": int(row.first + x), "sums": np.asarray(partial(at[starts[x] : starts[x + 1]], c[starts[x] : starts[x + 1]])).tobytes()} for x in [*range(lo), *range(hi, len(here))]]
            yield pd.DataFrame({"first": [row.first + lo], "n": [hi - lo], "file": [arrays.part(folder, rows)], "gram": [gram.tobytes()], "extra": [extra], "cut": [cut]})

    wrote = side.laid.mapInPandas(visit, _WROTE).collect()  # one row for each stretch
    pieces = [(r["first"], r["n"], r["file"]) for r in wrote]
    gram = sum((np.frombuffer(r["gram"]).reshape(width, width) for r in sorted(wrote, key=lambda r: r["first"])), np.zeros((width, width)))
    extra, sums = sum(r["extra"] for r in wrote), {}
    for r in sorted(wrote, key=lambda r: r["first"]):
        for x in r["cut"]:
            sums[x["k"]] = sums.get(x["k"], 0.0) + np.frombuffer(x["sums"])
    for k, total in sums.items():
        row, more = finish(k, total)
        row = np.asarray(row).astype(dtype)
        pieces.append((k, 1, arrays.part(folder, row)))
        gram, extra = gram + np.outer(row.astype(np.float64), row.astype(np.float64)), extra + more
    # An empty file may begin where another does.
    held = arrays.strung(folder, [name for _, _, name in sorted(pieces)], width, dtype)
    if held.n != side.n:
        raise ValueError("keys are missing from a round")
    return Vectors(held, gram, float(extra))


def dense(spark: SparkSession, n: int, folder: str, width: int, dtype: str, make: Callable[[int, int], np.ndarray]) -> Vectors:
    """Vectors that tasks make by ranges of numbers, make(from, up to)."""
    tasks = int(max(spark.sparkContext.defaultParallelism, n * width * np.dtype(dtype).itemsize // arrays.BYTES_PER_TASK))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in (k for batch in batches for k in batch["id"].tolist()):
            rows = np.asarray(make(k * n // tasks, (k + 1) * n // tasks)).astype(dtype).reshape(-1, width)
            wide = rows.astype(np.float64)
            yield pd.DataFrame({"first": [k], "n": [len(rows)], "file": [arrays.part(folder, rows)], "gram": [(wide.T @ wide).tobytes()], "extra": [0.0], "cut": [[]]})

    wrote = sorted(spark.range(0, tasks, 1, tasks).mapInPandas(visit, _WROTE).collect(), key=lambda r: r["first"])  # one row for each task
    gram = sum((np.frombuffer(r["gram"]).reshape(width, width) for r in wrote), np.zeros((width, width)))
    return Vectors(arrays.strung(folder, [r["file"] for r in wrote], width, dtype), gram)


def table(spark: SparkSession, ids: arrays.Mapped, held: arrays.Mapped, save: Callable[[DataFrame], DataFrame], kind: str = "float", turn: np.ndarray | None = None) -> DataFrame:
    """(id, vec) of a side's vectors, each times a small matrix if given."""
    tasks = int(max(spark.sparkContext.defaultParallelism, held.n * held.width * np.dtype(held.dtype).itemsize // arrays.BYTES_PER_TASK))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k in (k for batch in batches for k in batch["id"].tolist()):
            end = (k + 1) * held.n // tasks
            for a in range(k * held.n // tasks, end, AT_ONCE):
                own = slice(a, min(end, a + AT_ONCE))
                rows = np.array(held.rows()[own])
                yield pd.DataFrame({"id": np.array(ids.ids()[own]), "vec": list(rows if turn is None else rows @ turn)})

    return save(spark.range(0, tasks, 1, tasks).mapInPandas(read, f"id long, vec array<{kind}>"))
