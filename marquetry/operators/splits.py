"""Deterministic splits and samples: hash-ordered, exact per stratum, independent of row order."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.contracts import ContractError, assert_contract
from marquetry.functions.hashing import canonical_json_bytes, id_json, json_string, stable_hash
from marquetry.functions.scalars import activity_band
from marquetry.operators.prefix import beside, dealt_parts, nth_within, running_sums

BANDS = (5, 10, 25, 50, 100, 200)


def outer_split(activity: DataFrame, bands: Sequence[int] = BANDS, assessment: str = "0.2", namespace: str = "outer-split") -> DataFrame:
    """Users (user_id, raw_ownership_count) into design, assessment and excluded_low_activity.

    In each activity band the first floor(share * size) users in hash order are for assessment; the share is an exact
    fraction of its text. Users below the first bound keep band -1 and an empty hash.
    """
    share = Fraction(assessment)
    band = activity_band(F.col("raw_ownership_count"), bands)
    rows = activity.select("user_id", "raw_ownership_count", band.cast("long").alias("activity_band"))
    hashed = F.when(F.col("activity_band") >= 0, stable_hash(namespace, F.col("activity_band").cast("string"), id_json(F.col("user_id")))).otherwise(F.lit(""))
    rows = rows.withColumn("assignment_hash", hashed)
    sizes = rows.groupBy("activity_band").agg(F.count("*").alias("_size"))
    rows = nth_within(rows, ["activity_band"], [F.col("assignment_hash"), F.col("user_id")])  # a band may hold most users
    rows = rows.join(F.broadcast(sizes), "activity_band")  # one row per band
    wanted = F.expr(f"(_size * {share.numerator}) div {share.denominator}")
    split = F.when(F.col("activity_band") < 0, "excluded_low_activity").when(F.col("_nth") <= wanted, "assessment").otherwise("design")
    return rows.select("user_id", "raw_ownership_count", "activity_band", split.alias("split"), "assignment_hash")


def hamilton_quotas(counts: DataFrame, stratum: str, target: int, within: Sequence[str] = ()) -> DataFrame:
    """Largest-remainder quotas of `target` over the strata's `n`, per group of `within`; ties by the stratum's JSON bytes.

    Adds quota. Integer arithmetic throughout; a target above the rows of a group is an error.
    """
    group = Window.partitionBy(*within)
    text = json_string(F.col(stratum)) if dict(counts.dtypes)[stratum] == "string" else F.col(stratum).cast("string")
    rows = counts.withColumn("_all", F.sum("n").over(group))
    rows = assert_contract(rows, {"target fits": F.col("_all") >= target})
    rows = rows.withColumn("_floor", F.expr(f"({target} * n) div _all")).withColumn("_left", F.pmod(F.lit(target) * F.col("n"), F.col("_all")))
    order = F.row_number().over(group.orderBy(F.desc("_left"), F.concat(text, F.lit("\n"))))
    rows = rows.withColumn("_spare", F.lit(target) - F.sum("_floor").over(group)).withColumn("_order", order)
    quota = F.col("_floor") + F.when(F.col("_order") <= F.col("_spare"), 1).otherwise(0)
    return rows.withColumn("quota", quota.cast("long")).drop("_all", "_floor", "_left", "_spare", "_order")


def take_quotas(rows: DataFrame, strata: Sequence[str], quotas: DataFrame, hashed: Column, key: str) -> DataFrame:
    """The first `quota` rows of each stratum in hash order, with selection_hash and quota."""
    rows = rows.join(quotas.select(*strata, "quota"), list(strata)).withColumn("selection_hash", hashed)
    return nth_within(rows, strata, [F.col("selection_hash"), F.col(key)]).where(F.col("_nth") <= F.col("quota")).drop("_nth")


def evaluation_sample(users: DataFrame, size: int, namespace: str = "evaluation-sample") -> DataFrame:
    """An exact sample of evaluable design users, proportional to activity bands (sample_stratum_quota)."""
    assert_contract(users, {"design": F.col("split") == "design", "evaluable": F.col("evaluable_user")}, unique=("user_id",))
    counts = users.groupBy("activity_band").agg(F.count("*").alias("n"))
    quotas = hamilton_quotas(counts, "activity_band", size)
    hashed = stable_hash(namespace, F.col("activity_band").cast("string"), id_json(F.col("user_id")))
    return take_quotas(users, ["activity_band"], quotas, hashed, "user_id").withColumnRenamed("quota", "sample_stratum_quota")


def pseudo_cold_items(items: DataFrame, bands: Sequence[tuple[int, int]], per_band: int, namespace: str = "pseudo-cold") -> DataFrame:
    """Per support band [low, high) exactly `per_band` items with a genre, proportional to primary genres.

    items: item_id, design_training_support, primary_genre. A band with too few items is an error.
    """
    genre = F.nullif(F.trim(F.col("primary_genre")), F.lit(""))
    rows = items.select("item_id", "design_training_support", genre.alias("primary_genre")).where("primary_genre is not null")
    index = F.lit(None).cast("int")
    for k, (low, high) in enumerate(bands):
        index = F.when((F.col("design_training_support") >= low) & (F.col("design_training_support") < high), F.lit(k)).otherwise(index)
    rows = rows.withColumn("support_band_index", index).where("support_band_index is not null")
    counts = rows.groupBy("support_band_index", "primary_genre").agg(F.count("*").alias("n"))
    quotas = hamilton_quotas(counts, "primary_genre", per_band, ["support_band_index"])
    hashed = stable_hash(namespace, F.col("support_band_index").cast("string"), json_string(F.col("primary_genre")), id_json(F.col("item_id")))
    out = take_quotas(rows, ["support_band_index", "primary_genre"], quotas, hashed, "item_id")
    bound = lambda j: F.get(F.array(*[F.lit(b[j]) for b in bands]), F.col("support_band_index"))
    return out.withColumns({"support_band_lower": bound(0), "support_band_upper_exclusive": bound(1)}).withColumnRenamed("quota", "genre_stratum_quota")


def _proposals(warm: DataFrame, namespace: str) -> DataFrame:
    """Each user's pair: the test item is its first item in test order, validation the first other one in validation order."""
    user = id_json(F.col("user_id"))
    hashed = {role: stable_hash(namespace, role, user, id_json(F.col("item_id"))) for role in ("test", "validation")}
    rows = warm.select("user_id", "item_id", *[h.alias(f"_{r}") for r, h in hashed.items()])
    first = rows.groupBy("user_id").agg(F.min(F.struct("_test", "item_id")).alias("_first"), F.min(F.struct("_validation", "item_id")).alias("_v1"))
    # The validation choice is the least but the test item: the least, or else the second least.
    second = rows.join(first.select("user_id", F.col("_first.item_id").alias("_taken")), "user_id").where(F.col("item_id") != F.col("_taken"))
    second = second.groupBy("user_id").agg(F.min(F.struct("_validation", "item_id")).alias("_second"))
    return first.join(second, "user_id").select("user_id", F.col("_first.item_id").alias("test"), F.col("_second.item_id").alias("validation"))


def nested_split(edges: DataFrame, before: int = 5, after: int = 3, required: int = 3, namespace: str = "edge-split", save=lambda df: df.checkpoint(), keep: Sequence[str] = ()) -> DataFrame:
    """Roles of design edges: one test and one validation item per evaluable user, the rest training.

    Items of at least `before` owners are warm; held-out edges must leave each warm item `after` owners in training.
    Users with `required` warm items choose in hash order, each the best pair of items with room left; both roles or
    neither. Adds role, is_warm_item, evaluable_user, user_split_status, item_support_before, item_training_support_after.

    The choice is a serial one, made in rounds. In a round every open user names the best pair among items with room.
    A user may settle if, for both items, the open users before it that own the item are fewer than the room, for
    they alone can take it first; the first open user always may. Where no item is over-demanded, all settle in the
    first round with their first choice. Each round is saved, by default as a checkpoint.

    Edges meet their item's support, are dealt by user once, and there get counts and choices from the user's own rows; only what
    is held out, two rows a user, is counted by item again. Columns of `keep` go along.
    """
    parts = dealt_parts(edges)
    supports = beside(save(edges.groupBy("item_id").agg(F.count("*").alias("item_support_before"))))
    rows = edges.select("user_id", "item_id", *keep).join(supports, "item_id").withColumn("is_warm_item", F.col("item_support_before") >= before)
    mine = Window.partitionBy("user_id")
    rows = rows.repartition(parts, "user_id").withColumn("_n", F.count_if("is_warm_item").over(mine))
    rows = rows.withColumn("_candidate", F.col("is_warm_item") & (F.col("_n") >= required))
    for role, free in (("test", F.col("_candidate")), ("validation", F.col("_candidate") & ~F.col("_test"))):
        order = F.when(free, stable_hash(namespace, role, id_json(F.col("user_id")), id_json(F.col("item_id"))))
        rows = rows.withColumn(f"_{role}", free & (F.row_number().over(mine.orderBy(F.asc_nulls_last(order), "item_id")) == 1))
    rows = save(rows)
    held = rows.where("_test or _validation")
    taken = save(held.groupBy("item_id").agg(F.count("*").alias("_taken"), F.max("item_support_before").alias("_support")))
    if not taken.where(F.col("_taken") > F.col("_support") - after).head(1):
        status = F.col("_n") >= max(required, 2)  # a user of one warm item has no second choice
        if required < 2:
            rows = rows.withColumns({"_test": F.col("_test") & status, "_validation": F.col("_validation") & status})
            taken = save(rows.where("_test or _validation").groupBy("item_id").agg(F.count("*").alias("_taken")))
        taken = taken.select("item_id", "_taken")
        out = rows.withColumns({"_role": F.when(F.col("_test"), "test").when(F.col("_validation"), "validation"), "_settled": status})
    else:
        settled = _serial_rounds(rows.where("_candidate").select("user_id", "item_id", (F.col("item_support_before") - after).alias("_room")), namespace, save)
        held = settled.select("user_id", F.explode(F.array(F.struct(F.lit("test").alias("role"), F.col("test").alias("item_id")), F.struct(F.lit("validation").alias("role"), F.col("validation").alias("item_id")))).alias("h"))
        held = held.select("user_id", F.col("h.item_id").alias("item_id"), F.col("h.role").alias("_role"))
        out = rows.join(held, ["user_id", "item_id"], "left").join(settled.select("user_id", F.lit(True).alias("_settled")), "user_id", "left")
        taken = save(held.groupBy("item_id").agg(F.count("*").alias("_taken")))
    out = out.join(beside(taken), "item_id", "left")
    evaluable = F.coalesce("_settled", F.lit(False))
    return out.select(
        "user_id",
        "item_id",
        F.when(~F.col("is_warm_item"), "excluded_nonwarm_item").otherwise(F.coalesce("_role", F.lit("training"))).alias("role"),
        "is_warm_item",
        evaluable.alias("evaluable_user"),
        F.when(evaluable, "evaluable").when(F.col("_n") >= required, "capacity_exhausted").otherwise("insufficient_warm_history").alias("user_split_status"),
        "item_support_before",
        F.when(F.col("is_warm_item"), F.col("item_support_before") - F.coalesce("_taken", F.lit(0))).alias("item_training_support_after"),
        *keep,
    )


def _serial_rounds(candidates: DataFrame, namespace: str, save) -> DataFrame:
    order = stable_hash(namespace, "user", id_json(F.col("user_id")))
    lists = save(candidates.withColumn("_turn", order))
    rooms = save(lists.select("item_id", "_room").distinct())
    settled = None
    while True:
        # A pair needs two items with room; users left with fewer are out.
        usable = lists.drop("_room").join(rooms.where("_room > 0"), "item_id")
        enough = usable.groupBy("user_id").agg(F.count("*").alias("_n")).where("_n >= 2").select("user_id")
        usable = usable.join(enough, "user_id", "left_semi")
        if not usable.head(1):
            break
        before = F.row_number().over(Window.partitionBy("item_id").orderBy("_turn", "user_id")) - 1
        ranked = usable.withColumn("_before", before)
        pick = _proposals(usable, namespace)
        safe = ranked.select("user_id", "item_id", (F.col("_before") < F.col("_room")).alias("_safe"))
        asked = pick.select("user_id", "test", "validation", F.explode(F.array("test", "validation")).alias("item_id")).join(safe, ["user_id", "item_id"])
        now = asked.groupBy("user_id", "test", "validation").agg(F.bool_and("_safe").alias("_ok")).where("_ok").drop("_ok")
        now = save(now)
        settled = now if settled is None else save(settled.unionByName(now))
        used = now.select(F.explode(F.array("test", "validation")).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("_used"))
        rooms = save(rooms.join(used, "item_id", "left").select("item_id", (F.col("_room") - F.coalesce("_used", F.lit(0))).alias("_room")))
        lists = save(usable.drop("_room").join(now.select("user_id"), "user_id", "left_anti").withColumn("_room", F.lit(0)))
    if settled is None:
        raise ContractError("no user has two items with room")
    return settled


def hashed_holdout(edges: DataFrame, per_user: int = 2, minimum: int = 5, namespace: str = "leave-out") -> DataFrame:
    """Leave `per_user` edges of each user with at least `minimum` out, in hash order (is_held)."""
    order = stable_hash(namespace, id_json(F.col("user_id")), id_json(F.col("item_id")))
    user = Window.partitionBy("user_id")
    rows = edges.withColumn("_n", F.count("*").over(user)).withColumn("_k", F.row_number().over(user.orderBy(order, "item_id")))
    return rows.withColumn("is_held", (F.col("_n") >= minimum) & (F.col("_k") <= per_user)).drop("_n", "_k")


def hashed_sample(rows: DataFrame, key: str, size: int, namespace: str = "user-sample") -> DataFrame:
    """`size` rows in hash order of an integer key: a seeded choice that does not depend on row order."""
    return rows.orderBy(stable_hash(namespace, id_json(F.col(key))), key).limit(size)


def driver_quotas(counts: dict, target: int) -> dict:
    """Hamilton quotas of a handful of strata on the driver."""
    total = sum(counts.values())
    if target > total:
        raise ContractError(f"{target} of {total} rows")
    quotas = {k: target * n // total for k, n in counts.items()} if total else dict.fromkeys(counts, 0)
    spare = target - sum(quotas.values())
    for k in sorted(counts, key=lambda k: (-(target * counts[k] % total), canonical_json_bytes(k)))[:spare] if total else ():
        quotas[k] += 1
    return quotas


def numbered(ids: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct ids with a number from 0 in their order."""
    ones = ids.select(key).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sums(ones, F.col(key), {name: "_one"}, before=True).drop("_one")
