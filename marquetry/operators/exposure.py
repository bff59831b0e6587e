"""What users of a factor model are shown: mergeable top-k boundaries over blocks of items, fractional inclusion, coverage, concentration.

A task scores some users at once against blocks of items one after another and keeps, for each user, only as many levels of scores
as k needs. A product of matrices finds the pairs that may matter; only these are summed factor by factor, so that equal vectors
tie wherever they stand. The same pass gives each item's exposure, or a second one where boundaries are wanted alone. Tasks map the catalogue from the shared folder; where that is not
mounted, users and items are packed into blocks that are joined. No user-item pair is ever a row, whatever k and the size of
the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.contracts import assert_contract
from marquetry.operators.ranking import BLOCK, PAIRS_PER_TASK, _paired
from marquetry.sources import arrays
from marquetry.sources.scratch import saver

#: Items and users of a block, blocks of items that one task takes up for a block of users, and users that are scored at once.
ITEMS_PER_BLOCK = 8192
USERS_PER_BLOCK = 1024
BLOCKS_PER_TURN = 16
AT_ONCE = 128
#: Pairs that may be among the first places, kept by a task for users that are scored at once.
MAX_KEPT = 1 << 20


@dataclass
class TopLevels:
    """The highest levels of scores seen so far with their counts, no more of them than the first k places need.

    The kth place only moves up as scores are added, so a level below it is never needed again. Levels of parts, merged in any
    order, are those of the whole.
    """

    k: int
    candidates: int = 0
    levels: np.ndarray = field(default_factory=lambda: np.empty(0))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("k must be positive")

    def update(self, scores: np.ndarray) -> None:
        """Add the scores of candidates, finite ones."""
        if not np.isfinite(scores).all():
            raise ValueError("scores must be finite")
        self.candidates += len(scores)
        if len(scores) > self.k:
            scores = scores[scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]]
        self._add(*np.unique(scores.astype(np.float64), return_counts=True))

    def merge(self, other: TopLevels) -> None:
        self.candidates += other.candidates
        self._add(other.levels, other.counts)

    def _add(self, levels: np.ndarray, counts: np.ndarray) -> None:
        every, at = np.unique(np.concatenate([self.levels, levels]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([self.counts, counts]), len(every)).astype(np.int64)[::-1]
        needed = np.cumsum(sums) - sums < self.k
        self.levels, self.counts = every[::-1][needed], sums[needed]

    def boundary(self) -> tuple[float, int, int, float]:
        """(score of the last place, candidates above it, candidates at it, chance of each of these to be among the first k)."""
        if not self.candidates:
            raise ValueError("there are no candidates")
        selected = min(self.k, self.candidates)
        before = np.cumsum(self.counts) - self.counts
        last = int(np.flatnonzero(before < selected)[-1])
        return float(self.levels[last]), int(before[last]), int(self.counts[last]), float((selected - before[last]) / self.counts[last])


class _Tops:
    """`TopLevels` of many users as flat arrays by user and falling score; floor: what a score must reach to be needed."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf, np.float32)
        self.who, self.levels, self.counts = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64)

    def add(self, who: np.ndarray, scores: np.ndarray) -> None:
        if not len(who):
            return
        who, levels = np.concatenate([self.who, who]), np.concatenate([self.levels, scores])
        order = np.lexsort((-levels, who))
        who, levels, counts = who[order], levels[order], np.concatenate([self.counts, np.ones(len(scores), np.int64)])[order]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (levels[1:] != levels[:-1])])
        who, levels, counts = who[first], levels[first], np.add.reduceat(counts, first)
        above = self.above(who, counts)
        kept = above < self.k
        self.who, self.levels, self.counts, above = who[kept], levels[kept], counts[kept], above[kept]
        last = above + self.counts >= self.k  # one level of a user at most
        self.floor[self.who[last]] = self.levels[last]

    @staticmethod
    def above(who: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Candidates of the same user on higher levels."""
        before, start = np.cumsum(counts) - counts, np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        return before - np.repeat(before[start], np.diff(np.r_[start, len(who)]))

    def boundaries(self, names: np.ndarray, candidates: np.ndarray) -> pd.DataFrame:
        """Rows of `top_k_boundaries` of users that have candidates."""
        above = self.above(self.who, self.counts) if len(self.who) else self.counts
        selected = np.minimum(candidates, self.k)[self.who]
        last = above + self.counts >= selected
        last &= above < selected
        who, above, tied, selected = self.who[last], above[last], self.counts[last], selected[last]
        return pd.DataFrame({"user_id": names[who], "candidate_count": candidates[who], "selected_count": selected, "threshold": self.levels[last].astype(np.float64), "strictly_above": above, "tied_block_size": tied, "inclusion": (selected - above) / tied})


def _slack(users: np.ndarray, longest: float, bias: float) -> np.ndarray:
    """For each user what two sums of the same products can differ by, given the longest item and the greatest bias."""
    most = np.sqrt(np.einsum("ij,ij->i", users, users, dtype=np.float64)) * longest + bias
    if not (most < np.finfo(np.float32).max).all():
        raise ValueError("scores must be finite")
    return ((users.shape[1] + 4) * 2.0**-22 * most).astype(np.float32)


def _extent(items: np.ndarray, bias: np.ndarray) -> tuple[float, float]:
    return np.sqrt(np.einsum("ij,ij->i", items, items, dtype=np.float64).max(initial=0.0)), float(np.abs(bias).max(initial=0.0))


def _reaching(users: np.ndarray, items: np.ndarray, bias: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], low: np.ndarray, slack: np.ndarray, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(user, item, score) of all pairs of a block, hidden ones (user, item) apart, whose score is at least the user's `low`.

    With k, pairs that k others of the block surpass may be left out where `low` says nothing yet.
    """
    scores = users @ items.T
    if bias.any():
        scores += bias
    scores[hidden] = -np.inf
    if k and k < len(items) and (new := np.flatnonzero(np.isneginf(low))).size:
        low = low.copy()
        low[new] = np.partition(scores[new], len(items) - k, axis=1)[:, len(items) - k] - slack[new]
    flat = np.flatnonzero(scores >= np.maximum(low - slack, np.finfo(np.float32).min)[:, None])
    for x in range(0, len(flat), 1 << 16):
        u, i = np.divmod(flat[x : x + (1 << 16)], len(items))
        exact = _paired(users[u], items[i], bias[i])
        enough = exact >= low[u]
        yield u[enough], i[enough], exact[enough]


def _hidden(lists: Sequence, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(user, place) of hidden items that are among ids, by place."""
    lists = [np.asarray(h if h is not None else [], dtype=np.int64) for h in lists]
    who, what = np.repeat(np.arange(len(lists)), [len(h) for h in lists]), np.concatenate([np.empty(0, np.int64), *lists])
    at = np.searchsorted(ids, what)
    there = ids[np.minimum(at, len(ids) - 1)] == what
    who, at = who[there], at[there]
    order = np.argsort(at, kind="stable")
    return who[order], at[order]


def _catalogue(held: arrays.Mapped) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]], tuple[float, float]]:
    """Ids, blocks (first place, vectors, biases) and extent of a mapped catalogue with biases."""
    rows = held.rows()
    blocks = [(a, rows[a : a + BLOCK, :-1], rows[a : a + BLOCK, -1]) for a in range(0, held.n, BLOCK)]
    each = [_extent(np.asarray(m), np.asarray(b)) for _, m, b in blocks]
    return held.ids(), blocks, (max(x for x, _ in each), max(x for _, x in each))


def _swept(part: pd.DataFrame, ids: np.ndarray, blocks: Sequence[tuple], extent: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], Callable]:
    """Vectors of some users, their slack and hidden items, and a function that runs `_reaching` over all blocks, given `low` of now and k."""
    users = np.stack(part["vec"]).astype(np.float32)
    slack, (who, at) = _slack(users, *extent), _hidden(part["hidden"], ids)

    def sweep(low: np.ndarray, k: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, matrix, bias in blocks:
            lo, hi = np.searchsorted(at, [a, a + len(matrix)])
            for u, i, score in _reaching(users, np.asarray(matrix), np.asarray(bias), (who[lo:hi], at[lo:hi] - a), low, slack, k):
                yield u, i + a, score

    return users, slack, (who, at), sweep


def _mapped(items: DataFrame) -> arrays.Mapped | None:
    """The catalogue (item_id, vec, bias) as files that tasks map; None where the shared folder is not mounted or nothing is there."""
    if arrays.mounted(items.sparkSession) is None or not (n := items.count()):
        return None
    return arrays.mapped(items, "item_id", n, len(items.select("vec").first()[0]))[0]  # stays, as the result is read lazily


def _dealt(users: DataFrame, held: arrays.Mapped) -> DataFrame:
    return users.repartition(int(max(2 * users.sparkSession.sparkContext.defaultParallelism, users.count() * held.n // PAIRS_PER_TASK)))


def _packed(rows: DataFrame, key: str, per_block: int, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """(block, ids, vecs and the other columns as arrays): rows dealt into blocks of about per_block by a hash of their key."""
    blocks = max(1, -(-rows.count() // per_block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    made = F.array_sort(F.collect_list(F.struct(key, *columns)))
    return dealt.groupBy("block").agg(made.alias("rows")), blocks


def _blocks(users: DataFrame, items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every block of users beside every block of items, those of one turn in one task and in order."""
    asked, parts = _packed(users, "user_id", USERS_PER_BLOCK, columns)
    held, blocks = _packed(items.select("item_id", "vec", "bias"), "item_id", ITEMS_PER_BLOCK, ["vec", "bias"])
    asked = asked.select(F.col("block").alias("part"), F.col("rows").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    turns = parts * -(-blocks // BLOCKS_PER_TURN)
    joined = asked.join(held, "block").withColumn("turn", F.expr(f"block div {BLOCKS_PER_TURN}"))
    return joined.repartition(int(turns), "part", "turn").sortWithinPartitions("part", "block")


def _met(row: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]:
    """(first user, candidates of each, item ids, sweep of `_swept`) of the block pair in a row, some users at once."""
    users, items = row["asked"], row["rows"]
    ids = np.array([i["item_id"] for i in items], dtype=np.int64)
    matrix, bias = np.stack([i["vec"] for i in items]).astype(np.float32), np.array([i["bias"] for i in items], dtype=np.float32)
    extent = _extent(matrix, bias)
    for a in range(0, len(users), AT_ONCE):
        part = pd.DataFrame({c: [u[c] for u in users[a : a + AT_ONCE]] for c in ("vec", "hidden")})
        _, _, (who, _), sweep = _swept(part, ids, [(0, matrix, bias)], extent)
        yield a, len(ids) - np.bincount(who, minlength=len(part)), ids, sweep


def _asking(users: DataFrame, excluded: DataFrame) -> DataFrame:
    """(user_id, vec, hidden): users with the items that are no candidates of theirs, their own edges."""
    hidden = excluded.groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("long"))).alias("hidden"))
    return users.select(F.col("user_id").cast("long"), "vec").join(hidden, "user_id", "left")


def _with_bias(items: DataFrame) -> DataFrame:
    bias = F.col("bias").cast("float") if "bias" in items.columns else F.lit(0.0).cast("float")
    return items.select(F.col("item_id").cast("long"), "vec", bias.alias("bias"))


def top_k_boundaries(users: DataFrame, items: DataFrame, excluded: DataFrame, k: int = 20) -> DataFrame:
    """Where each user's first k end: user_id, candidate_count, selected_count, threshold, strictly_above, tied_block_size, inclusion.

    users: user_id, vec; items: item_id, vec and optional bias, the whole catalogue; excluded: user_id, item_id that are no candidates
    of the user. Scores are single-precision sums, factor by factor, so that equal vectors tie wherever they stand; exact equality
    counts as a tie, and `inclusion` is the chance of each candidate at the threshold under a random order of ties. A user with
    fewer candidates than k has all of them selected; one without any has no row.
    """
    if k < 1:
        raise ValueError("k must be positive")

    asking, items = _asking(users, excluded), _with_bias(items)
    held = _mapped(items)
    if held is not None:

        def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, blocks, extent = _catalogue(held)
            for batch in batches:
                for a in range(0, len(batch), AT_ONCE):
                    part = batch.iloc[a : a + AT_ONCE]
                    tops = _Tops(len(part), k)
                    _, _, (who, _), sweep = _swept(part, ids, blocks, extent)
                    for u, _, scores in sweep(tops.floor, k):
                        tops.add(u, scores)
                    yield tops.boundaries(part["user_id"].to_numpy(), held.n - np.bincount(who, minlength=len(part)))

        return _dealt(asking, held).mapInPandas(ended, "user_id long, candidate_count long, selected_count long, threshold double, strictly_above long, tied_block_size long, inclusion double")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                for a, candidates, _, sweep in _met(row):
                    tops = _Tops(len(candidates), k)
                    for u, _, scores in sweep(tops.floor, k):
                        tops.add(u, scores)
                    cuts = np.searchsorted(tops.who, np.arange(1, len(candidates)))
                    names = [u["user_id"] for u in row["asked"][a : a + len(candidates)]]
                    yield pd.DataFrame({"user_id": names, "candidates": candidates, "levels": np.split(tops.levels.astype(np.float64), cuts), "counts": np.split(tops.counts, cuts)})

    pairs = _blocks(asking, items, ["vec", "hidden"])
    parts = saver(items.sparkSession)(pairs.mapInPandas(found, "user_id long, candidates long, levels array<double>, counts array<long>"))
    counts = parts.groupBy("user_id").agg(F.sum("candidates").alias("candidate_count"))
    levels = parts.select("user_id", F.explode(F.arrays_zip("levels", "counts")).alias("x")).groupBy("user_id", F.col("x.levels").alias("threshold")).agg(F.sum("x.counts").alias("tied_block_size"))
    before = Window.partitionBy("user_id").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, -1)  # at most k levels a turn
    levels = levels.withColumn("strictly_above", F.coalesce(F.sum("tied_block_size").over(before), F.lit(0)))
    out = levels.join(counts, "user_id").withColumn("selected_count", F.least("candidate_count", F.lit(k)))
    out = out.where("strictly_above < selected_count and strictly_above + tied_block_size >= selected_count")
    inclusion = (F.col("selected_count") - F.col("strictly_above")) / F.col("tied_block_size")
    return out.select("user_id", "candidate_count", "selected_count", "threshold", "strictly_above", "tied_block_size", inclusion.alias("inclusion"))


def item_exposure(users: DataFrame, items: DataFrame, excluded: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(item_id, exposure, missed) of items that some user may be shown: the expected number of users, and the chance that none is.

    boundaries: as `top_k_boundaries` gives them for the same users, items and exclusions. A task sums over its users before
    anything is shuffled.
    """
    aimed = _asking(users, excluded).join(boundaries.select("user_id", "threshold", "inclusion"), "user_id")

    items = _with_bias(items)
    mapped = _mapped(items)

    def shown(ids: np.ndarray, exposure: np.ndarray, missed: np.ndarray) -> pd.DataFrame:
        some = exposure > 0
        return pd.DataFrame({"item_id": ids[some], "exposure": exposure[some], "missed": missed[some]})

    def gained(sweep: Callable, edge: np.ndarray, share: np.ndarray, exposure: np.ndarray, missed: np.ndarray) -> None:
        for u, i, scores in sweep(edge):
            p = np.where(scores > edge[u], 1.0, share[u])
            np.add.at(exposure, i, p)
            np.multiply.at(missed, i, 1 - p)

    if mapped is not None:

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, blocks, extent = _catalogue(mapped)
            exposure, missed = np.zeros(len(ids)), np.ones(len(ids))
            for batch in batches:
                for a in range(0, len(batch), AT_ONCE):
                    part = batch.iloc[a : a + AT_ONCE]
                    gained(_swept(part, ids, blocks, extent)[-1], part["threshold"].to_numpy(dtype=np.float32), part["inclusion"].to_numpy(), exposure, missed)
            yield shown(np.asarray(ids), exposure, missed)

        parts = _dealt(aimed, mapped).mapInPandas(summed, "item_id long, exposure double, missed double")
        return parts.groupBy("item_id").agg(F.sum("exposure").alias("exposure"), F.product("missed").alias("missed"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, row in batch.iterrows():
                edge = np.array([u["threshold"] for u in row["asked"]]).astype(np.float32)
                share = np.array([u["inclusion"] for u in row["asked"]])
                for a, candidates, ids, sweep in _met(row):
                    _, exposure, missed = held.setdefault(row["block"], (ids, np.zeros(len(ids)), np.ones(len(ids))))
                    gained(sweep, edge[a : a + len(candidates)], share[a : a + len(candidates)], exposure, missed)
        for each in held.values():
            yield shown(*each)

    pairs = _blocks(aimed, items, ["vec", "hidden", "threshold", "inclusion"])
    parts = pairs.mapInPandas(found, "item_id long, exposure double, missed double")
    return parts.groupBy("item_id").agg(F.sum("exposure").alias("exposure"), F.product("missed").alias("missed"))


def exposure_coverage(exposure: DataFrame, n_items: int) -> DataFrame:
    """One row: expected distinct items shown, and their share of the catalogue."""
    if n_items < 1:
        raise ValueError("a catalogue has items")
    exposure = assert_contract(exposure, {"chance": F.col("missed").between(0.0, 1.0)})
    return exposure.agg(F.coalesce(F.sum(1 - F.col("missed")), F.lit(0.0)).alias("expected_items")).withColumn("coverage", F.col("expected_items") / F.lit(float(n_items)))


def exposure_concentration(exposure: DataFrame, top_items: DataFrame) -> DataFrame:
    """One row: the share of all exposure that falls on the top items; null if nothing is shown."""
    marked = exposure.join(top_items.select("item_id").distinct().withColumn("top", F.lit(True)), "item_id", "left")
    return marked.agg(F.try_divide(F.coalesce(F.sum(F.when(F.col("top"), F.col("exposure"))), F.lit(0.0)), F.sum("exposure")).alias("concentration"))


def _swept_once(sweep: Callable, names: np.ndarray, candidates: np.ndarray, k: int, sums: tuple[np.ndarray, np.ndarray]) -> None:
    """Both passes over some users at once: pairs that reach the floor of their time are kept until the last places are known.

    Where ties make these too many, users meet the catalogue again instead.
    """
    tops, kept, n = _Tops(len(names), k), [], 0
    for u, i, scores in sweep(tops.floor, k):
        tops.add(u, scores)
        if kept is None:
            continue
        kept.append((u, i, scores))
        n += len(u)
        if n > MAX_KEPT:
            u, i, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
            some = scores >= tops.floor[u]
            kept, n = [(u[some], i[some], scores[some])], int(some.sum())
            if n > MAX_KEPT // 2:
                kept = None
    ends = tops.boundaries(np.arange(len(names)), candidates)
    edge, share = np.full(len(names), np.inf, np.float32), np.zeros(len(names))
    edge[ends["user_id"]], share[ends["user_id"]] = ends["threshold"].to_numpy(dtype=np.float32), ends["inclusion"]
    for u, i, scores in sweep(edge) if kept is None else kept:
        some = scores >= edge[u]
        u, i, scores = u[some], i[some], scores[some]
        p = np.where(scores > edge[u], 1.0, share[u])
        np.add.at(sums[0], i, p)
        np.multiply.at(sums[1], i, 1 - p)


def factor_exposure(users: DataFrame, items: DataFrame, excluded: DataFrame, k: int = 20, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`item_exposure` of the first k of every user: in one pass over users and items where tasks map the catalogue, else in two."""
    save = save or saver(items.sparkSession)
    if k >= 1 and (held := _mapped(_with_bias(items))) is not None:

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, blocks, extent = _catalogue(held)
            sums = np.zeros(len(ids)), np.ones(len(ids))
            for batch in batches:
                for a in range(0, len(batch), AT_ONCE):
                    part = batch.iloc[a : a + AT_ONCE]
                    _, _, (who, _), sweep = _swept(part, ids, blocks, extent)
                    _swept_once(sweep, part["user_id"].to_numpy(), held.n - np.bincount(who, minlength=len(part)), k, sums)
            some = sums[0] > 0
            yield pd.DataFrame({"item_id": np.asarray(ids)[some], "exposure": sums[0][some], "missed": sums[1][some]})

        parts = _dealt(_asking(users, excluded), held).mapInPandas(summed, "item_id long, exposure double, missed double")
        return save(parts.groupBy("item_id").agg(F.sum("exposure").alias("exposure"), F.product("missed").alias("missed")))  # read more than once
    return save(item_exposure(users, items, excluded, save(top_k_boundaries(users, items, excluded, k))))
