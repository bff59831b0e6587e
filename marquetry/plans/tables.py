"""The driver's tables seen as interactions, items, bundles and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators import interactions, splits
from marquetry.operators.prefix import beside, dealt_parts
from marquetry.sources.scratch import discard, published, saver

#: Parameters of the named queries.
BANDS = splits.BANDS
COLD_BANDS = ((10, 25), (25, 35), (35, 60))
SIZES = (1, 2, 3, 5)
MENU = (320.0, 520.0, 640.0, 800.0)
UNIT_COST = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as user-item rows: quantity and price stand for the two playtimes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("playtime_forever"), F.col("l_extendedprice").alias("playtime_2weeks"))
    lines = lines.repartition(dealt_parts(lines), "l_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.canonical_edges(raw(spark, sf_dir).repartition(dealt_parts(table(spark, sf_dir, "lineitem")), "user_id", "item_id"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.support(edges(spark, sf_dir), "user_id", "raw_ownership_count")


def outer(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """The outer split of users, from edges that are at hand or those of the tables: made once and published for all queries."""
    make = lambda: splits.outer_split(activity(spark, sf_dir) if every is None else interactions.support(every, "user_id", "raw_ownership_count"), BANDS)
    return published(spark, "outer", _edge_files(sf_dir), make)


def _edge_files(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem")]


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of design edges with their playtime: made once for a state of the tables and published for all queries."""

    steps = []

    def save(df: DataFrame) -> DataFrame:
        steps.append(saver(spark)(df))
        return steps[-1]

    def make() -> DataFrame:
        every = save(edges(spark, sf_dir).select("user_id", "item_id", "playtime_forever"))  # read for the users and for the roles
        design = outer(spark, sf_dir, every).where("split = 'design'").select("user_id")
        return splits.nested_split(save(every.join(beside(design), "user_id", "left_semi")), save=save, keep=["playtime_forever"])

    out = published(spark, "nested", _edge_files(sf_dir), make)
    for step in steps:
        discard(step)
    return out


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items, with the words of type, brand and name as labels."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("price"), F.array_distinct(F.concat(F.array("p_type", "p_brand"), F.split("p_name", " "))).alias("labels"), "p_type", "p_brand")


def bundle_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bundles of their distinct parts."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_partkey").alias("item_id"))
    return lines.repartition(dealt_parts(lines), "bundle_id", "item_id").distinct()


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bundles: list price of the parts, final price in whole cents after the mean discount, and the discount stated."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_partkey").alias("item_id"), "l_discount")
    lines = lines.repartition(dealt_parts(lines), "bundle_id").groupBy("bundle_id", "item_id").agg(F.min("l_discount").alias("_d"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_retailprice")
    sums = lines.join(beside(part), "item_id").groupBy("bundle_id").agg(F.round(F.sum("p_retailprice"), 2).alias("component_price_sum"), F.expr("((200 * sum(cast(round(_d * 100) as bigint)) + count(*)) div (2 * count(*))) / 10000.0D").alias("stated_discount"), F.max("_d").alias("_m"))
    return sums.select("bundle_id", (F.expr("(cast(round(component_price_sum * 100) as bigint) * (100 - cast(round(_m * 100) as bigint)) + 50) div 100") / F.lit(100.0)).alias("final_price"), "stated_discount", "component_price_sum")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' greatest event value per type as a valuation panel."""
    events = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    return events.groupBy("user_id", F.col("event_type").alias("item_id")).agg(F.max("value").alias("v"))


#: The same views in DuckDB SQL.
RAW_SQL = """raw as (select o_custkey as user_id, l_partkey as item_id, l_quantity as playtime_forever, l_extendedprice as playtime_2weeks, l_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey)"""
EDGES_SQL = RAW_SQL + """,
edges as (select user_id, item_id, max(playtime_forever) as playtime_forever, max(playtime_2weeks) as playtime_2weeks from raw group by 1, 2),
activity as (select user_id, count(*) as raw_ownership_count from edges group by 1)"""


def hash_sql(namespace: str, *fields: str) -> str:
    """The stable hash in SQL; fields are expressions of JSON text."""
    framed = [f"unhex(lpad(hex(octet_length(encode({f} || chr(10)))::bigint), 16, '0')) || encode({f} || chr(10))" for f in ("'\"" + namespace + "\"'", *fields)]
    return f"substr(sha256({' || '.join(framed)}), 1, 16)"


def id_sql(column: str) -> str:
    return f"('\"' || {column} || '\"')"


def literal_sql(text: str) -> str:
    return "'\"" + text + "\"'"


_BAND = "(" + " + ".join(f"(raw_ownership_count >= {b})::bigint" for b in BANDS) + " - 1)"
OUTER_SQL = EDGES_SQL + f""",
banded as (select *, {_BAND} as activity_band from activity),
hashed as (select *, case when activity_band >= 0 then {hash_sql("outer-split", "activity_band::varchar", id_sql("user_id"))} else '' end as assignment_hash from banded),
split_users as (
  select user_id, raw_ownership_count, activity_band,
    case when activity_band < 0 then 'excluded_low_activity'
      when row_number() over (partition by activity_band order by assignment_hash, user_id) <= count(*) over (partition by activity_band) // 5 then 'assessment' else 'design' end as split, assignment_hash
  from hashed)"""
NESTED_SQL = OUTER_SQL + f""",
design as (select e.user_id, e.item_id, e.playtime_forever, count(*) over (partition by e.item_id) as item_support_before from edges e join split_users s on s.user_id = e.user_id and s.split = 'design'),
flagged as (select *, item_support_before >= 5 as is_warm_item from design),
warm_counts as (select user_id, count(*) as n from flagged where is_warm_item group by 1),
warm as (select f.user_id, f.item_id, {hash_sql("edge-split", literal_sql("test"), id_sql("f.user_id"), id_sql("f.item_id"))} as ht, {hash_sql("edge-split", literal_sql("validation"), id_sql("f.user_id"), id_sql("f.item_id"))} as hv
  from flagged f join warm_counts w on w.user_id = f.user_id and w.n >= 3 where f.is_warm_item),
test_pick as (select user_id, item_id from warm qualify row_number() over (partition by user_id order by ht, item_id) = 1),
validation_pick as (select w.user_id, w.item_id from warm w join test_pick t on t.user_id = w.user_id and t.item_id <> w.item_id qualify row_number() over (partition by w.user_id order by w.hv, w.item_id) = 1),
nested as (
  select f.user_id, f.item_id,
    case when not f.is_warm_item then 'excluded_nonwarm_item' when t.item_id is not null then 'test' when v.item_id is not null then 'validation' else 'training' end as role,
    f.is_warm_item, coalesce(w.n >= 3, false) as evaluable_user, case when coalesce(w.n >= 3, false) then 'evaluable' else 'insufficient_warm_history' end as user_split_status, f.item_support_before,
    case when f.is_warm_item then f.item_support_before - sum((t.item_id is not null or v.item_id is not null)::bigint) over (partition by f.item_id) end::bigint as item_training_support_after,
    f.playtime_forever
  from flagged f left join warm_counts w on w.user_id = f.user_id left join test_pick t on t.user_id = f.user_id and t.item_id = f.item_id left join validation_pick v on v.user_id = f.user_id and v.item_id = f.item_id)"""
BUNDLES_SQL = """
bundle_items as (select distinct l_orderkey as bundle_id, l_partkey as item_id from lineitem),
bundle_lines as (select l_orderkey as bundle_id, l_partkey as item_id, min(l_discount) as d from lineitem group by 1, 2),
bundle_sums as (select bundle_id, round(sum(p_retailprice), 2) as component_price_sum, ((200 * sum(round(d * 100)::bigint) + count(*)) // (2 * count(*)))::bigint / 10000.0::double as stated_discount, max(d) as m from bundle_lines join part on p_partkey = item_id group by 1),
bundles as (select bundle_id, ((round(component_price_sum * 100)::bigint * (100 - round(m * 100)::bigint) + 50) // 100) / 100.0::double as final_price, stated_discount, component_price_sum from bundle_sums)"""
PANEL_SQL = "panel as (select user_id, event_type as item_id, max(value) as v from events where user_id is not null and value is not null group by 1, 2)"
