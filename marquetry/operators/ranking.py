"""Full-catalogue ranking with exact ties: counts above and equal, fractional top-k, coverage, concentration."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.contracts import assert_contract, is_finite
from marquetry.functions.scalars import expected_ndcg, expected_rank, expected_recall
from marquetry.operators.prefix import quantiles, running_sums
from marquetry.sources import arrays
from marquetry.sources.scratch import saver

KS = (10, 20)
#: Items of consecutive ranks that users are joined to at once.
STEP = 64
#: Bytes of item factors that are scored by one product, and users of a block beyond that.
MAX_CATALOGUE_BYTES = 256 << 20
USERS_PER_BLOCK = 4096
#: Items that a block of users is scored against at once where only counts are wanted, and user-item pairs a task is meant for.
BLOCK = 8192
#: Vectors of a block of which all pairs are scored.
ROWS_PER_BLOCK = 2048
PAIRS_PER_TASK = 4_000_000_000


def candidates(users: DataFrame, catalogue: DataFrame, *excluded: DataFrame) -> DataFrame:
    """All (user_id, item_id) of users and catalogue but the excluded pairs. For small samples and tests: it makes every pair."""
    pairs = users.select("user_id").crossJoin(F.broadcast(catalogue.select("item_id")))
    for held in excluded:
        pairs = pairs.join(held.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return pairs


def tie_counts(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Per user the candidates strictly above and tied with its target (itself included) by exact equality.

    scores: user_id, item_id, score; targets: user_id, target_item_id. Counting replaces sorting: one partial aggregate
    per user. A target that is not a candidate exactly once is an error.
    """
    scores = assert_contract(scores, {"finite": is_finite(F.col("score"))})
    own = scores.join(targets, "user_id").where("item_id = target_item_id").select("user_id", "target_item_id", F.col("score").alias("_target"))
    joined = scores.join(own, "user_id")
    out = joined.groupBy("user_id", "target_item_id").agg(
        F.count_if(F.col("score") > F.col("_target")).alias("strictly_above"),
        F.count_if(F.col("score") == F.col("_target")).alias("tied_block_size"),
        F.count_if(F.col("item_id") == F.col("target_item_id")).alias("_self"),
    )
    return assert_contract(out, {"target counted once": F.col("_self") == 1}).drop("_self")


def item_score_ties(item_scores: DataFrame, targets: DataFrame, excluded: DataFrame) -> DataFrame:
    """`tie_counts` where a score depends on the item alone, without user-item pairs.

    item_scores: item_id, score over the whole catalogue; targets: user_id, target_item_id, any number per user; excluded:
    user_id, item_id that are no candidates of the user (training items and other held-out ones; a target itself is always one).
    The catalogue is reduced to one row per distinct score, with counts above; each user then subtracts what it excludes. The
    work follows edges, times the targets of a user.
    """
    levels = item_scores.groupBy("score").agg(F.count("*").alias("_at"))
    levels = running_sums(levels, F.desc("score"), {"_above": "_at"}, before=True)
    scored = item_scores.select("item_id", "score")
    own = targets.join(scored.withColumnRenamed("item_id", "target_item_id"), "target_item_id").join(levels, "score")
    lost = excluded.select("user_id", "item_id").join(scored, "item_id").withColumnRenamed("score", "_lost").select("user_id", "item_id", "_lost")
    own = own.withColumnRenamed("score", "_target").select("user_id", "target_item_id", "_target", "_at", "_above")
    lost = lost.join(own.select("user_id", "target_item_id", "_target"), "user_id").where("item_id <> target_item_id").groupBy("user_id", "target_item_id")
    lost = lost.agg(F.count_if(F.col("_lost") > F.col("_target")).alias("_lost_above"), F.count_if(F.col("_lost") == F.col("_target")).alias("_lost_at"))
    out = own.join(lost, ["user_id", "target_item_id"], "left")
    return out.select("user_id", "target_item_id", (F.col("_above") - F.coalesce("_lost_above", F.lit(0))).alias("strictly_above"), (F.col("_at") - F.coalesce("_lost_at", F.lit(0))).alias("tied_block_size"))


def family_score_ties(item_scores: DataFrame, families: Sequence[str], targets: DataFrame, excluded: DataFrame) -> DataFrame:
    """`item_score_ties` of several families (columns of item_scores) in one pass over the exclusions: its rows with their family."""
    scored = item_scores.select("item_id", *[F.col(f).alias(f"_s{k}") for k, f in enumerate(families)])
    aims = [F.col(f"_s{k}").alias(f"_t{k}") for k in range(len(families))]
    own = targets.join(scored.select(F.col("item_id").alias("target_item_id"), *aims), "target_item_id")
    for k in range(len(families)):
        levels = scored.groupBy(F.col(f"_s{k}").alias(f"_t{k}")).agg(F.count("*").alias(f"_at{k}"))
        own = own.join(running_sums(levels, F.desc(f"_t{k}"), {f"_above{k}": f"_at{k}"}, before=True), f"_t{k}")
    lost = excluded.select("user_id", "item_id").join(scored, "item_id").join(own.select("user_id", "target_item_id", *[f"_t{k}" for k in range(len(families))]), "user_id")
    beyond = [F.count_if(F.col(f"_s{k}") > F.col(f"_t{k}")).alias(f"_lost_above{k}") for k in range(len(families))]
    equal = [F.count_if(F.col(f"_s{k}") == F.col(f"_t{k}")).alias(f"_lost_at{k}") for k in range(len(families))]
    lost = lost.where("item_id <> target_item_id").groupBy("user_id", "target_item_id").agg(*beyond, *equal)
    out = own.join(lost, ["user_id", "target_item_id"], "left")
    left = lambda what, k: F.col(f"_{what}{k}") - F.coalesce(f"_lost_{what}{k}", F.lit(0))
    each = [F.struct(left("above", k).alias("strictly_above"), left("at", k).alias("tied_block_size"), F.lit(f).alias("family")) for k, f in enumerate(families)]
    return out.select("user_id", "target_item_id", F.explode(F.array(*each)).alias("_f")).select("user_id", "target_item_id", "_f.*")


def tie_metrics(counts: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """expected_rank, recall_at_k and ndcg_at_k of each row's strictly_above and tied_block_size."""
    above, tied = F.col("strictly_above"), F.col("tied_block_size")
    out = counts.withColumn("expected_rank", expected_rank(above, tied))
    for k in ks:
        out = out.withColumn(f"recall_at_{k}", expected_recall(above, tied, k)).withColumn(f"ndcg_at_{k}", expected_ndcg(above, tied, k))
    return out


def top_k_inclusion(scores: DataFrame, k: int, user: str = "user_id") -> DataFrame:
    """Chance of each candidate to be in its user's first k under a random order of ties (inclusion); zero ones are left out.

    The boundary level shares what room is left. Ranks are computed over distinct score levels per user.
    """
    levels = scores.groupBy(user, "score").agg(F.count("*").alias("_block"))
    before = Window.partitionBy(user).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_above", F.coalesce(F.sum("_block").over(before), F.lit(0))).where(F.col("_above") < k)
    p = F.least(F.lit(1.0), (F.lit(k) - F.col("_above")) / F.col("_block"))
    return scores.join(levels, [user, "score"]).withColumn("inclusion", p).drop("_block", "_above")


def item_top_k_inclusion(item_scores: DataFrame, users: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """`top_k_inclusion` where a score depends on the item alone: (user_id, item_id, inclusion) without all pairs.

    A user needs only the k + (its own exclusions) best items and the ties of the last of them. Items are numbered by
    falling score and users meet them by steps of STEP numbers, so the pairs made follow k and each user's own edges.
    """
    ranked = running_sums(item_scores.select("item_id", "score").withColumn("_one", F.lit(1).cast("long")), F.struct((-F.col("score")).alias("_o"), "item_id"), {"_nth": "_one"}).drop("_one")
    ends = ranked.groupBy("score").agg(F.max("_nth").alias("_end"))
    ranked = saver(ranked.sparkSession)(ranked.join(ends, "score"))
    n = ranked.count()
    owned = excluded.groupBy("user_id").agg(F.count("*").alias("_own"))
    need = users.select("user_id").distinct().join(owned, "user_id", "left").withColumn("_nth", F.least(F.coalesce("_own", F.lit(0)) + k, F.lit(n)))
    need = need.join(ranked.select("_nth", "_end"), "_nth").select("user_id", "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_end div {STEP}"))).alias("_step"))
    heads = ranked.withColumn("_step", F.expr(f"_nth div {STEP}")).select("item_id", "score", "_nth", "_step")
    pairs = need.join(heads, "_step").where("_nth <= _end").select("user_id", "item_id", "score")
    return top_k_inclusion(pairs.join(excluded.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"), k)


def expected_coverage(inclusion: DataFrame, n_items: int) -> DataFrame:
    """One row: expected distinct items shown, sum of 1 - prod(1 - p), and as a share of the catalogue."""
    each = inclusion.groupBy("item_id").agg((1 - F.product(1 - F.col("inclusion"))).alias("_shown"))
    return each.agg(F.coalesce(F.sum("_shown"), F.lit(0.0)).alias("expected_items")).withColumn("coverage", F.col("expected_items") / F.lit(float(n_items)))


def concentration(inclusion: DataFrame, top_items: DataFrame) -> DataFrame:
    """One row: share of all exposure that falls on the top items."""
    marked = inclusion.join(F.broadcast(top_items.select("item_id").distinct().withColumn("_top", F.lit(1))), "item_id", "left")
    return marked.agg((F.coalesce(F.sum(F.when(F.col("_top") == 1, F.col("inclusion"))), F.lit(0.0)) / F.sum("inclusion")).alias("concentration"))


def factor_tie_counts(users: DataFrame, items: DataFrame, targets: DataFrame, excluded: DataFrame, k: int = 20) -> DataFrame:
    """Tie counts of factor scores by dense blocks: user_id, target_item_id, strictly_above, tied_block_size, shown (k items).

    users: user_id, vec; items: item_id, vec and optional bias, the whole catalogue. Tasks map the catalogue from the shared
    folder. With k = 0 nothing is shown and scores are counted block by block (`_counted`), whatever the size. Otherwise, up
    to MAX_CATALOGUE_BYTES, a task scores users against all items by one product; larger catalogues, or a folder that is not
    mounted, are dealt into blocks (`_counts_by_blocks`). Scores are single-precision; exact equality counts as a tie. No
    user-item pair is ever a row. One target per user.
    """
    n, width = items.count(), len(items.select("vec").first()[0])
    columns = ["item_id", "vec"] + ["bias"] * ("bias" in items.columns)
    hidden = excluded.groupBy("user_id").agg(F.collect_set("item_id").alias("hidden"))  # a user's own edges
    rows = users.join(targets, "user_id").join(hidden, "user_id", "left").select("user_id", "vec", "target_item_id", "hidden")
    spark = items.sparkSession
    if arrays.mounted(spark) is None or (k and n * width * 4 > MAX_CATALOGUE_BYTES):
        out = _counts_by_blocks(rows, items.select(*columns), max(k, 1), max(1, -(-n * width * 4 // MAX_CATALOGUE_BYTES)))
        return out if k else out.withColumn("shown", F.array().cast("array<long>"))
    held, _ = arrays.mapped(items.select(*columns), "item_id", n, width)  # stays, as the result is read lazily
    made = "user_id long, target_item_id long, strictly_above long, tied_block_size long, shown array<long>"
    rows = rows.repartition(int(max(2 * spark.sparkContext.defaultParallelism, targets.count() * n // PAIRS_PER_TASK)))
    if not k:
        return rows.mapInPandas(lambda batches: _counted(batches, held, width), made)

    def count(batches):
        ids, matrix = held.ids(), held.rows()[:, :width]
        bias = held.rows()[:, width] if held.width > width else np.zeros(n, np.float32)
        step = max(1, min(128, (16 << 20) // n))
        for batch in batches:
            out = []
            for a in range(0, len(batch), step):
                part = batch.iloc[a : a + step]
                block = np.stack(part["vec"]).astype(np.float32) @ matrix.T + bias
                for scores, user, target, hide in zip(block, part["user_id"], part["target_item_id"], part["hidden"], strict=True):
                    mine = np.searchsorted(ids, target)
                    if hide is not None and len(hide):
                        at = np.searchsorted(ids, hide)
                        at = at[(at < n) & (ids[np.minimum(at, n - 1)] == hide) & (at != mine)]
                        scores[at] = -np.inf
                    top = np.argpartition(-scores, min(k, n - 1))[:k] if k < n else np.arange(n)
                    at_least = np.flatnonzero(scores >= scores[top].min())  # with the ties of the last place
                    shown = at_least[np.argsort(-scores[at_least], kind="stable")][:k]
                    out.append((user, target, int((scores > scores[mine]).sum()), int((scores == scores[mine]).sum()), ids[shown].tolist()))
            yield pd.DataFrame(out, columns=["user_id", "target_item_id", "strictly_above", "tied_block_size", "shown"])

    return rows.mapInPandas(count, made)


def _paired(a: np.ndarray, b: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Single-precision scores of rows of a with rows of b, summed factor by factor as `_scored` does."""
    out = np.zeros(len(a), dtype=np.float32)
    for f in range(a.shape[1]):
        out += a[:, f] * b[:, f]
    return out + bias


def _counted(batches: Iterator[pd.DataFrame], held: arrays.Mapped, width: int) -> Iterator[pd.DataFrame]:
    """Counts of `factor_tie_counts` without what is shown: users meet the catalogue in blocks that fit a processor's cache.

    A product of matrices decides all scores that differ from the target's by more than both sums can err; the others are
    summed factor by factor, as the target's own, so that equal vectors tie wherever they stand.
    """
    ids, table, n = held.ids(), held.rows(), held.n
    biased = held.width > width
    longest = bound = np.float32(0)
    for a in range(0, n, BLOCK):
        rows = np.asarray(table[a : a + BLOCK])
        longest = max(longest, np.sqrt(np.einsum("ij,ij->i", rows[:, :width], rows[:, :width], dtype=np.float64).max()))
        bound = max(bound, np.abs(rows[:, width]).max() if biased else 0)
    spare = [np.empty(128 * BLOCK, kind) for kind in (np.float32, bool, bool)]  # used again and again, as fresh pages cost as much as the product
    for batch in batches:
        for start in range(0, len(batch), 128):
            part = batch.iloc[start : start + 128]
            users = np.stack(part["vec"]).astype(np.float32)
            lifted = np.concatenate([users, np.ones((len(users), 1), np.float32)], axis=1) if biased else users  # the bias is one more product
            target = part["target_item_id"].to_numpy()
            aim = np.searchsorted(ids, target)
            if n == 0 or (aim >= n).any() or (ids[np.minimum(aim, n - 1)] != target).any():
                raise ValueError("a target is not in the catalogue")
            own = np.asarray(table[aim])
            mine = _paired(users, own[:, :width], own[:, width] if biased else np.float32(0))
            slack = ((width + 4) * 2.0**-22 * (np.sqrt(np.einsum("ij,ij->i", users, users, dtype=np.float64)) * longest + bound)).astype(np.float32)
            lists = [np.asarray(h if h is not None else [], dtype=np.int64) for h in part["hidden"]]
            who, what = np.repeat(np.arange(len(part)), [len(h) for h in lists]), np.concatenate(lists)
            at = np.searchsorted(ids, what)
            there = (at < n) & (ids[np.minimum(at, n - 1)] == what) & (at != aim[who])
            who, at = who[there], at[there]
            order = np.argsort(at, kind="stable")
            who, at = who[order], at[order]
            high, low = (mine + slack)[:, None], (mine - slack)[:, None]
            above, tied = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for a in range(0, n, BLOCK):
                rows = np.asarray(table[a : a + BLOCK])
                scores, over, near = (x[: len(part) * len(rows)].reshape(len(part), len(rows)) for x in spare)
                np.matmul(lifted, rows.T, out=scores)
                lo, hi = np.searchsorted(at, [a, a + BLOCK])
                scores[who[lo:hi], at[lo:hi] - a] = -np.inf
                np.greater(scores, high, out=over)
                np.greater_equal(scores, low, out=near)
                sure = np.array([np.count_nonzero(row) for row in over])  # by rows, as a count along an axis makes numbers of all marks
                above += sure
                some = np.flatnonzero(np.array([np.count_nonzero(row) for row in near]) > sure)
                if not len(some):
                    continue
                flat = np.flatnonzero(near[some] & ~over[some])
                for x in range(0, len(flat), 1 << 16):
                    u, i = np.divmod(flat[x : x + (1 << 16)], len(rows))
                    u = some[u]
                    exact = _paired(users[u], rows[i, :width], rows[i, width] if biased else np.float32(0))
                    above += np.bincount(u[exact > mine[u]], minlength=len(part))
                    tied += np.bincount(u[exact == mine[u]], minlength=len(part))
            yield pd.DataFrame({"user_id": part["user_id"].to_numpy(), "target_item_id": target, "strictly_above": above, "tied_block_size": tied, "shown": [[]] * len(part)})


def _scored(users: np.ndarray, items: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Single-precision scores, summed factor by factor: the same bits whatever block an item stands in."""
    out = np.zeros((len(users), len(items)), dtype=np.float32)
    for f in range(users.shape[1]):
        out += users[:, f, None] * items[None, :, f]
    return out + bias


def _counts_by_blocks(rows: DataFrame, items: DataFrame, k: int, blocks: int) -> DataFrame:
    """`factor_tie_counts` for a catalogue of any size: items and users in blocks, each pair of blocks one task.

    A user's row carries its target's score, worked out alone in the same order of sums. A block returns counts and its k best;
    both are merged by user.
    """
    if "bias" not in items.columns:
        items = items.withColumn("bias", F.lit(0.0).cast("float"))
    save = saver(items.sparkSession)
    target = items.select(F.col("item_id").alias("target_item_id"), F.col("vec").alias("_vec"), F.col("bias").alias("_bias"))

    @F.pandas_udf("float")
    def own(vec: pd.Series, other: pd.Series, bias: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=np.float32)
        a, b = np.stack(vec).astype(np.float32), np.stack(other).astype(np.float32)
        out = np.zeros(len(a), dtype=np.float32)
        for f in range(a.shape[1]):
            out += a[:, f] * b[:, f]
        return pd.Series(out + bias.to_numpy(dtype=np.float32))

    aimed = save(rows.join(target, "target_item_id").withColumn("mine", own("vec", "_vec", "_bias")).drop("_vec", "_bias"))
    parts = max(1, aimed.count() // USERS_PER_BLOCK)
    asked = aimed.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
    held = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(int(blocks))).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def count(users: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        columns = ["user_id", "target_item_id", "above", "tied", "best"]
        if not len(users) or not len(pool):
            return pd.DataFrame(columns=columns)
        pool = pool.sort_values("item_id", ignore_index=True)
        ids, matrix, bias = pool["item_id"].to_numpy(), np.stack(pool["vec"]).astype(np.float32), pool["bias"].to_numpy(dtype=np.float32)
        out = []
        for a in range(0, len(users), 128):
            part = users.iloc[a : a + 128]
            for scores, user, aim, mine, hide in zip(_scored(np.stack(part["vec"]).astype(np.float32), matrix, bias), part["user_id"], part["target_item_id"], part["mine"], part["hidden"], strict=True):
                if hide is not None and len(hide):
                    scores[np.isin(ids, hide) & (ids != aim)] = -np.inf
                best = np.argsort(-scores, kind="stable")[:k]
                out.append((user, aim, int((scores > mine).sum()), int((scores == mine).sum()), [{"score": -float(scores[x]), "item": int(ids[x])} for x in best]))
        return pd.DataFrame(out, columns=columns)

    each = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(count, "user_id long, target_item_id long, above long, tied long, best array<struct<score:double,item:long>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)  # k for each block of items
    merged = each.groupBy("user_id", "target_item_id").agg(F.sum("above").alias("strictly_above"), F.sum("tied").alias("tied_block_size"), best.alias("_best"))
    return merged.select("user_id", "target_item_id", "strictly_above", "tied_block_size", F.transform("_best", lambda x: x["item"]).alias("shown"))


def inner_products(rows: DataFrame, group: str, key: str, vec: str, digits: int | None = None) -> DataFrame:
    """(user_id, item_id, score) of all pairs of rows of a group with different keys: inner products in double precision.

    Rows are packed into saved blocks once and each unordered pair of blocks is one row of a Cartesian product of the saved
    table's splits: no block is shuffled, so that bytes written grow as the rows and not as their pairs. Scores are summed
    component by component, so their bits depend neither on the blocks nor on the order of the two, and serve both orders.
    A component that either vector lacks adds nothing; a pair that shares none has a null score. With digits, scores are
    rounded half up as decimals, as F.round does.
    """
    schema = "grp string, block string, ids binary, vecs binary, held binary, width int"

    def rows_of(column: pa.Array) -> list:
        """A vector for each row: an array, or a list where components are null."""
        flat, sizes = pc.list_flatten(column), pc.fill_null(pc.list_value_length(column), 0).to_numpy()
        if flat.null_count:
            return column.to_pylist()
        return np.split(flat.to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict = {}

        def packed(label, parts: list) -> pa.RecordBatch:
            ids, vectors = [i for i, _ in parts], [[] if v is None else v for _, v in parts]
            width = max(map(len, vectors))
            values, held = np.zeros((len(ids), width)), np.zeros((len(ids), width), dtype=bool)
            for r, v in enumerate(vectors):
                there = np.array([x is not None for x in v], dtype=bool) if isinstance(v, list) else slice(None)
                held[r, : len(v)] = there if isinstance(v, list) else True
                values[r, : len(v)][there] = [x for x in v if x is not None] if isinstance(v, list) else v
            row = {"grp": label, "block": uuid.uuid4().hex, "ids": np.array(ids, np.int64).tobytes(), "vecs": values.tobytes(), "held": None if held.all() else held.tobytes(), "width": width}
            return pa.RecordBatch.from_pylist([row], made)

        made = pa.schema([("grp", pa.string()), ("block", pa.string()), ("ids", pa.binary()), ("vecs", pa.binary()), ("held", pa.binary()), ("width", pa.int32())])
        for batch in batches:
            for label, i, v in zip(batch.column("grp").to_pylist(), batch.column("id").to_pylist(), rows_of(batch.column("vec")) if batch.num_rows else [], strict=True):
                waiting.setdefault(label, []).append((i, v))
                if len(waiting[label]) == ROWS_PER_BLOCK:
                    yield packed(label, waiting.pop(label))
        for label, parts in waiting.items():
            yield packed(label, parts)

    def matrix(ids: bytes, vecs: bytes, held: bytes | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        own = np.frombuffer(ids, np.int64)
        return own, np.frombuffer(vecs).reshape(len(own), width), None if held is None else np.frombuffer(held, dtype=bool).reshape(len(own), width)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first, second = (batch.column(f"block_{s}")[r].as_py() for s in "ab")
                (i, a, mine), (j, b, other) = (matrix(*[batch.column(f"{c}_{s}")[r].as_py() for c in ("ids", "vecs", "held", "width")]) for s in "ab")
                right = np.ascontiguousarray(b.T)
                shared = bool(len(np.intersect1d(i, j)))
                for at in range(0, len(i), 32):
                    out = np.zeros((len(i[at : at + 32]), len(j)))
                    buffer, count = np.empty_like(out), None if mine is None and other is None and a.shape[1] == b.shape[1] and a.shape[1] else np.zeros(out.shape, dtype=np.int32)
                    for f in range(min(a.shape[1], b.shape[1])):
                        with np.errstate(invalid="ignore", over="ignore"):
                            np.multiply(a[at : at + 32, f, None], right[f], out=buffer)
                        if count is not None:
                            both = np.ones(out.shape, dtype=bool)
                            both &= True if mine is None else mine[at : at + 32, f, None]
                            both &= True if other is None else other[:, f]
                            buffer[~both] = 0.0
                            count += both
                        out += buffer
                    keep = slice(None) if not shared else (i[at : at + 32, None] != j).reshape(-1)
                    values = out.reshape(-1)[keep]
                    own, met = pa.array(np.repeat(i[at : at + 32], len(j))[keep]), pa.array(np.tile(j, len(out))[keep])
                    scores = pa.array(values if digits is None else rounded_half_up(values, digits), mask=None if count is None else (count == 0).reshape(-1)[keep])
                    yield pa.RecordBatch.from_arrays([own, met, scores], names=["user_id", "item_id", "score"])
                    if first != second:
                        yield pa.RecordBatch.from_arrays([met, own, scores], names=["user_id", "item_id", "score"])

    table = rows.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("id"), F.col(vec).alias("vec")).where("grp is not null and id is not null")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, table.count() // (8 * ROWS_PER_BLOCK))
    blocks = saver(rows.sparkSession)(table.repartitionByRange(int(parts), "grp", "id").mapInArrow(pack, schema))
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns])
    pairs = side("a").hint("shuffle_replicate_nl").join(side("b"), F.expr("grp_a = grp_b and block_a <= block_b")).drop("grp_a", "grp_b")
    return pairs.mapInArrow(score, "user_id long, item_id long, score double")


def rounded_half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Doubles rounded half up by their shortest decimal form; the few near a half, or large, go through decimals."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(values) * 10.0**digits
        whole = np.floor(size)
        out = np.copysign((whole + (size - whole >= 0.5)) / 10.0**digits, values) + 0.0
        rare = ~(np.abs(size - whole - 0.5) > 1e-4) | ~(size < 2.0**40)
    for k in np.flatnonzero(rare):
        x = float(values[k])
        out[k] = float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400))) + 0.0 if np.isfinite(x) else x
    return out


def plain_metrics(counts: DataFrame, candidates: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """hit_at_k (the target is among the first k whatever the order of ties) and auc (ties count half) of tie counts.

    candidates: user_id, candidates, the number of items a user's target is ranked among, itself included.
    """
    last = F.col("strictly_above") + F.col("tied_block_size")
    out = counts.join(candidates.select("user_id", "candidates"), "user_id")
    below = F.col("candidates") - last + (F.col("tied_block_size") - 1) / 2
    out = out.withColumn("auc", F.when(F.col("candidates") > 1, below / (F.col("candidates") - 1)))
    return out.withColumns({f"hit_at_{k}": (last <= k).cast("int") for k in ks})


def within_user_midrank(scores: DataFrame, user: str = "user_id", score: str = "score") -> DataFrame:
    """(lower + half of equal ones) / n of each score within its user."""
    w = Window.partitionBy(user)
    lower = F.rank().over(w.orderBy(score)) - 1
    tied = F.count("*").over(Window.partitionBy(user, score))
    return scores.withColumn("midrank", (lower + F.lit(0.5) * tied) / F.count("*").over(w))


def user_zscore(scores: DataFrame, user: str = "user_id", score: str = "score") -> DataFrame:
    """Positive part of (score - mean) / population deviation within the user, deviations floored at 1e-6, capped at 100."""
    w = Window.partitionBy(user)
    z = (F.col(score) - F.avg(score).over(w)) / F.greatest(F.stddev_pop(score).over(w), F.lit(1e-6))
    return scores.withColumn("zscore", F.least(F.greatest(z, F.lit(0.0)), F.lit(100.0)))


def global_parameters(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row of exact global parameters: min, linear quantiles and count."""
    shares = {"global_q05": 0.05, "global_q25": 0.25, "global_median": 0.5, "global_q75": 0.75, "global_q95": 0.95}
    out = scores.agg(F.min(score).alias("global_min"), F.count(score).alias("sample_count")).crossJoin(F.broadcast(quantiles(scores, score, shares)))  # one row each
    return out.select("global_min", *shares, "sample_count")


def masked(score: Column, is_candidate: Column, fill: float = float("-inf")) -> Column:
    return F.when(is_candidate, score).otherwise(F.lit(fill))
