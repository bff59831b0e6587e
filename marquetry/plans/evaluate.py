"""The evaluation DAG over the driver's tables: splits, training scores, exact-tie ranks, leaderboards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators import evaluation, interactions, ranking
from marquetry.plans import tables

FAMILIES = ("popularity", "volume")


@dataclass(frozen=True)
class Prepared:
    """What an evaluation reads: nested roles, training edges, test targets, and pairs that are no candidates."""

    roles: DataFrame
    trained: DataFrame
    targets: DataFrame
    hidden: DataFrame

    @property
    def warm(self) -> DataFrame:
        return self.roles.where("is_warm_item").select("item_id").distinct()


def prepare(spark: SparkSession, sf_dir: str) -> Prepared:
    roles = tables.nested(spark, sf_dir)
    return Prepared(
        roles,
        roles.where("role = 'training'").select("user_id", "item_id", "playtime_forever"),
        roles.where("role = 'test' and evaluable_user").select("user_id", F.col("item_id").alias("target_item_id")),
        roles.where("evaluable_user and role in ('training', 'validation') and is_warm_item").select("user_id", "item_id"),
    )


def item_scores(ready: Prepared, family: str) -> DataFrame:
    """(item_id, score) of every warm item; whole numbers, so that ties are exact whatever the order of sums."""
    value = F.count("playtime_forever") if family == "popularity" else F.coalesce(F.sum("playtime_forever"), F.lit(0.0))
    return ready.warm.join(ready.trained, "item_id", "left").groupBy("item_id").agg(value.cast("double").alias("score"))


def metric_rows(ready: Prepared, family: str) -> DataFrame:
    """Metrics per evaluable user for the test target against the warm catalogue less training and validation items."""
    counts = ranking.item_score_ties(item_scores(ready, family), ready.targets, ready.hidden)
    return ranking.tie_metrics(counts).withColumn("family", F.lit(family))


def described(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """Metric rows with what segments need: user activity and target support in training."""
    users = interactions.support(trained, "user_id", "user_activity")
    supports = interactions.support(trained, "item_id", "target_training_support").withColumnRenamed("item_id", "target_item_id")
    return rows.join(users, "user_id", "left").join(supports, "target_item_id", "left")


def both_families(ready: Prepared) -> DataFrame:
    """`metric_rows` of all families, with the joins of targets and exclusions made once."""
    value = {"popularity": F.count("playtime_forever"), "volume": F.coalesce(F.sum("playtime_forever"), F.lit(0.0))}
    scores = ready.warm.join(ready.trained, "item_id", "left").groupBy("item_id").agg(*[value[f].cast("double").alias(f) for f in FAMILIES])
    rows = ranking.tie_metrics(ranking.family_score_ties(scores, FAMILIES, ready.targets, ready.hidden))
    return rows.select(*[c for c in rows.columns if c != "family"], "family")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def popularity_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one leaderboard row of popularity."""
    return rounded(evaluation.leaderboard(metric_rows(prepare(spark, sf_dir), "popularity"), "family"))
