"""Canonical user-item edges: deduplication, audits, exclusions, activity, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.contracts import ContractError, assert_contract, exclusion_reason, is_missing_id, is_valid_id, playtime_rule, positive_zero
from marquetry.functions.scalars import observed_confidence
from marquetry.operators import prefix
from marquetry.sources.scratch import discard, saver

KEYS = ("user_id", "item_id")
PLAY = ("playtime_forever", "playtime_2weeks")
REASONS = ("missing_user", "invalid_user", "missing_item", "invalid_item")


def canonical_edges(rows: DataFrame) -> DataFrame:
    """One edge per (user_id, item_id): each playtime is its own maximum over the rows of the pair.

    A partial aggregate before one shuffle on the pair. Edges of zero playtime stay.
    """
    return rows.groupBy(*KEYS).agg(*[F.max(positive_zero(F.coalesce(F.col(c), F.lit(0.0)))).alias(c) for c in PLAY])


def keep_first(rows: DataFrame, order: Column, *keys: str) -> DataFrame:
    """The first row of each key in the given order, by a minimum over structs: no window, so a hot key is pre-aggregated."""
    keys = keys or KEYS
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _audit(u: Column, i: Column) -> list[Column]:
    reason = exclusion_reason(u, i)
    flags = {"flag_missing_user": is_missing_id(u), "flag_invalid_user": ~is_missing_id(u) & ~is_valid_id(u), "flag_missing_item": is_missing_id(i), "flag_invalid_item": ~is_missing_id(i) & ~is_valid_id(i)}
    return [
        F.count("*").alias("source_rows"),
        F.count_if(reason.isNull()).alias("eligible_rows"),
        *[F.count_if(F.coalesce(reason == r, F.lit(False))).alias(f"excluded_{r}") for r in REASONS],
        *[F.count_if(f).alias(name) for name, f in flags.items()],
    ]


def load_audit(rows: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Counts of a raw text table in one pass: source rows, eligible rows, rows per first reason, and each flag alone."""
    return rows.agg(*_audit(F.col(user), F.col(item)))


def audited_scan(spark: SparkSession, path: str, save: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, audit) of a CSV of interactions with a header, read once: the audit is observed while eligible rows are written.

    Columns: user_id, item_id, playtime_forever, playtime_2weeks, blank playtimes count as 0. Bad ids are left out and counted as
    `load_audit` does. A line that does not fit the columns, or a playtime that is not finite or negative, is an error that names
    how many there are and the first such line in order of text; it holds on rows of bad ids too, and nothing is kept. The header must match. A
    source without rows gives no edges and an audit of zeros. The scan is one stage that writes, whose counts Spark takes once
    per finished task; edges are merged from what it wrote.
    """
    line = "_line"
    rows = spark.read.schema(f"user_id string, item_id string, playtime_forever double, playtime_2weeks double, {line} string").csv(path, header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=line)
    plays = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in PLAY}
    good = playtime_rule(plays[PLAY[0]]) & playtime_rule(plays[PLAY[1]])
    shown = F.coalesce(F.col(line), F.concat_ws(",", *[F.col(c).cast("string") for c in (*KEYS, *PLAY)]))
    broken = F.col(line).isNotNull() | ~good
    seen = Observation()
    watched = rows.observe(seen, *_audit(F.col("user_id"), F.col("item_id")), F.count_if(F.col(line).isNotNull()).alias("_unfit"), F.count_if(F.col(line).isNull() & ~good).alias("_plays"), F.min(F.when(broken, shown)).alias("_first"))
    eligible = watched.where(exclusion_reason(F.col("user_id"), F.col("item_id")).isNull() & ~broken)
    kept = (save or saver(spark))(eligible.select(*[F.col(c).cast("long").alias(c) for c in KEYS], *[v.alias(c) for c, v in plays.items()]))
    found = seen.get
    if found["_unfit"] or found["_plays"]:
        discard(kept)
        raise ContractError(f"of {found['source_rows']} rows: {found['_unfit']} do not fit the columns, {found['_plays']} have bad playtimes; the first: {found['_first'][:200]!r}")
    names = [n for n in found if not n.startswith("_")]
    audit = spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))
    return canonical_edges(kept), audit


def load_interactions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, audit) of a raw text table; bad playtimes are fatal on every row, also on excluded ones."""
    plays = {c: playtime_rule(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in PLAY}
    assert_contract(rows, plays)
    good = rows.where(exclusion_reason(F.col("user_id"), F.col("item_id")).isNull())
    typed = good.select(*[F.col(c).cast("long").alias(c) for c in KEYS], *[F.col(c).cast("double").alias(c) for c in PLAY])
    return canonical_edges(typed), load_audit(rows)


def flatten_libraries(records: DataFrame) -> DataFrame:
    """Rows of nested library records {user_id, steam_id, items: [{item_id, playtime...}]}; a blank user_id falls back to steam_id."""
    user = F.coalesce(F.nullif(F.col("user_id"), F.lit("")), F.col("steam_id"))
    each = records.select(user.alias("user_id"), F.explode("items").alias("item"))
    return each.select("user_id", F.col("item.item_id").alias("item_id"), *[F.coalesce(F.col(f"item.{c}"), F.lit(0.0)).alias(c) for c in PLAY])


def source_diagnostics(records: DataFrame) -> DataFrame:
    """One row: records, records without items, raw rows, edges, duplicate excess, users and items."""
    sizes = records.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.size("items"), F.lit(0)) <= 0).alias("empty_records"))
    rows = flatten_libraries(records)
    pairs = rows.groupBy(*KEYS).agg(F.count("*").alias("n"))
    edges = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), F.count("*").alias("edges"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))
    return sizes.crossJoin(edges).withColumn("duplicate_excess", F.col("raw_rows") - F.col("edges"))  # one row each


def support(edges: DataFrame, key: str, name: str) -> DataFrame:
    """Edges per user or item; as an item score this is popularity."""
    return edges.groupBy(key).agg(F.count("*").alias(name))


def distribution(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """One row: count, sum, zero count, min, linear quantiles, max and mean."""
    c = F.col(column).cast("double")
    quantiles = [("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
    cuts = F.broadcast(prefix.quantiles(df, column, dict(quantiles)))  # one row
    out = df.agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.count_if(c == 0).alias("zero_count"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean")).crossJoin(cuts)
    rounded = lambda x: F.round(x, digits)
    return out.select("n", rounded(F.col("total")).alias("total"), "zero_count", "least", *[rounded(F.col(name)).alias(name) for name, _ in quantiles], "most", rounded(F.col("mean")).alias("mean"))


def storage_bytes(edges: DataFrame) -> DataFrame:
    """One row comparing a compressed sparse layout of three 4-byte matrices with dense ones."""
    n = edges.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count("*").alias("edges"))
    sparse = 3 * (F.col("edges") * 8 + (F.col("users") + 1) * 4)
    dense = 3 * F.col("users") * F.col("items") * 4
    return n.select("users", "items", "edges", sparse.alias("sparse_bytes"), dense.alias("dense_bytes"), F.round(F.col("edges") / (F.col("users") * F.col("items")), 9).alias("density"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts of two id universes: each side, both, and either alone."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count("l").alias("left_ids"),
        F.count("r").alias("right_ids"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared_ids"),
        F.count_if(F.col("r").isNull()).alias("left_only"),
        F.count_if(F.col("l").isNull()).alias("right_only"),
    )


def remove_pairs(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Edges without the held-out pairs, each of which must exist exactly once."""
    pairs = held.select(*KEYS)
    n, distinct, present = pairs.count(), pairs.distinct().count(), pairs.join(edges, list(KEYS), "left_semi").count()
    if not n == distinct == present:
        raise ContractError(f"{n} held-out pairs: {distinct} distinct, {present} present")
    return edges.join(pairs, list(KEYS), "left_anti")


def restore_pairs(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Edges with held-out ones put back; a pair on both sides is an error."""
    columns = [*KEYS, *PLAY]
    return assert_contract(edges.select(*columns).unionByName(held.select(*columns)), {}, unique=KEYS)


def slice_edges(edges: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Edges of the given users and items."""
    for keys, name in ((users, "user_id"), (items, "item_id")):
        if keys is not None:
            edges = edges.join(keys.select(name).distinct(), name, "left_semi")
    return edges


def confidence(edges: DataFrame, alpha_o: float, alpha_p: float, tau: float) -> DataFrame:
    return edges.withColumn("confidence", observed_confidence(F.col("playtime_forever"), alpha_o, alpha_p, tau))


def deciles(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Buckets by quantile edges of the values (right-closed, equal edges merged), so equal values share a bucket."""
    edges = prefix.quantiles(df, column, {f"q{k}": k / buckets for k in range(buckets + 1)}).select(F.array(*[f"q{k}" for k in range(buckets + 1)]).alias("_edges"))
    cuts = F.array_sort(F.array_distinct(F.col("_edges")))
    placed = df.crossJoin(F.broadcast(edges.select(cuts.alias("_edges"))))  # one row of `buckets` + 1 numbers
    above = F.aggregate("_edges", F.lit(0), lambda n, e: n + F.when(e < F.col(column), F.lit(1)).otherwise(F.lit(0)))
    return placed.withColumn("decile", F.greatest(above - 1, F.lit(0))).drop("_edges")


def top_share(scores: DataFrame, score: str, key: str = "item_id", share: tuple[int, int] = (1, 100)) -> DataFrame:
    """The ceil(share * n) keys of greatest score, ties to the smaller key; the rank needs only the keys above the cut."""
    n = scores.count()
    k = -(-n * share[0] // share[1])
    return scores.orderBy(F.desc(score), key).limit(k)
