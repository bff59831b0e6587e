"""Named queries over the driver's tables, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions import hashing, scalars
from marquetry.operators import bundles, composition, evaluation, exposure, features, grids, interactions, models, pricing, ranking, splits, statistics, sweeps
from marquetry.plans import evaluate, orchestrate, tables
from marquetry.plans.evaluate import rounded
from marquetry.plans.tables import BUNDLES_SQL, EDGES_SQL, NESTED_SQL, OUTER_SQL, PANEL_SQL, RAW_SQL, hash_sql, id_sql
from marquetry.sources.scratch import saver, shared_folder

FLAGSHIP = "popularity_leaderboard"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def dense(column: str, table: str, where: str = "") -> str:
    """The distribution row in SQL."""
    q = lambda p: f"round(quantile_cont({column}::double, {p}), 6)"
    return f"select count({column}) as n, round(sum({column}::double), 6) as total, count(*) filter ({column} = 0) as zero_count, min({column})::double as least, {q(0.25)} as p25, {q(0.5)} as median, {q(0.75)} as p75, {q(0.9)} as p90, {q(0.95)} as p95, {q(0.99)} as p99, max({column})::double as most, round(avg({column}::double), 6) as mean from {table} {where}"


# ---- canonical edges and audits


@query(f"with {EDGES_SQL} select * from edges")
def canonical_edges(spark, d):
    return tables.edges(spark, d)


_BAD_USER = "case when l_orderkey % 97 = 0 and l_linenumber = 1 then '' when l_orderkey % 89 = 0 then '0' || o_custkey when l_orderkey % 83 = 0 then null when l_orderkey % 61 = 0 then o_custkey || '.0' else o_custkey::varchar end"
_BAD_ITEM = "case when l_orderkey % 79 = 0 then '' when l_orderkey % 73 = 0 then 'x' || l_partkey when l_orderkey % 71 = 0 then '9223372036854775808' else l_partkey::varchar end"
_MISSING = "({0} is null or {0} = '')"
_VALID = "coalesce(regexp_matches({0}, '^(0|[1-9][0-9]*)$') and (length({0}) < 19 or (length({0}) = 19 and {0} <= '9223372036854775807')), false)"


_AUDIT_COUNTS_SQL = f"""with t as (select {_BAD_USER} as u, {_BAD_ITEM} as i from orders join lineitem on o_orderkey = l_orderkey),
f as (select {_MISSING.format("u")} as mu, not {_MISSING.format("u")} and not {_VALID.format("u")} as iu, {_MISSING.format("i")} as mi, not {_MISSING.format("i")} and not {_VALID.format("i")} as ii from t)
select count(*) as source_rows, count(*) filter (not (mu or iu or mi or ii)) as eligible_rows, count(*) filter (mu) as excluded_missing_user, count(*) filter (iu) as excluded_invalid_user,
count(*) filter (not mu and not iu and mi) as excluded_missing_item, count(*) filter (not mu and not iu and ii) as excluded_invalid_item,
count(*) filter (mu) as flag_missing_user, count(*) filter (iu) as flag_invalid_user, count(*) filter (mi) as flag_missing_item, count(*) filter (ii) as flag_invalid_item from f"""


@query(_AUDIT_COUNTS_SQL)
def edge_load_audit(spark, d):
    """Audit of ids spoilt by rule in some rows: no row is left out."""
    rows = tables.raw(spark, d)
    key, u, i = F.col("l_orderkey"), F.col("user_id").cast("string"), F.col("item_id").cast("string")
    user = F.when((key % 97 == 0) & (F.col("l_linenumber") == 1), "").when(key % 89 == 0, F.concat(F.lit("0"), u)).when(key % 83 == 0, F.lit(None)).when(key % 61 == 0, F.concat(u, F.lit(".0"))).otherwise(u)
    item = F.when(key % 79 == 0, "").when(key % 73 == 0, F.concat(F.lit("x"), i)).when(key % 71 == 0, "9223372036854775808").otherwise(i)
    return interactions.load_audit(rows.select(user.alias("user_id"), item.alias("item_id")))


@query(f"with {RAW_SQL} select user_id, item_id, playtime_forever, playtime_2weeks from raw qualify row_number() over (partition by user_id, item_id order by l_orderkey, l_linenumber, playtime_forever, playtime_2weeks) = 1")
def keep_first_edges(spark, d):
    first = interactions.keep_first(tables.raw(spark, d), F.struct("l_orderkey", "l_linenumber", *interactions.PLAY))
    return first.select("user_id", "item_id", "playtime_forever", "playtime_2weeks")


@query(f"with {EDGES_SQL} {dense('raw_ownership_count', 'activity')}")
def user_activity_summary(spark, d):
    return interactions.distribution(tables.activity(spark, d), "raw_ownership_count")


@query(f"with {EDGES_SQL}, s as (select item_id, count(*) as support from edges group by 1) {dense('support', 's')}")
def item_support_summary(spark, d):
    return interactions.distribution(interactions.support(tables.edges(spark, d), "item_id", "support"), "support")


@query(f"with {EDGES_SQL} {dense('playtime_forever', 'edges')}")
def playtime_summary(spark, d):
    return interactions.distribution(tables.edges(spark, d), "playtime_forever")


@query(
    """with a as (select distinct p_partkey as k from part where p_size < 40), b as (select distinct l_partkey as k from lineitem where l_quantity >= 45)
select count(a.k) as left_ids, count(b.k) as right_ids, count(*) filter (a.k is not null and b.k is not null) as shared_ids, count(*) filter (b.k is null) as left_only, count(*) filter (a.k is null) as right_only from a full outer join b on a.k = b.k"""
)
def item_universe_reconciliation(spark, d):
    left = tables.table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("item_id"))
    right = tables.table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("item_id"))
    return interactions.reconcile(left, right, "item_id")


@query(f"with {EDGES_SQL}, n as (select count(distinct user_id) as users, count(distinct item_id) as items, count(*) as edges from edges) select users, items, edges, 3 * (edges * 8 + (users + 1) * 4) as sparse_bytes, 3 * users * items * 4 as dense_bytes, round(edges / (users * items)::double, 9) as density from n")
def storage_accounting(spark, d):
    return interactions.storage_bytes(tables.edges(spark, d))


@query(f"with {EDGES_SQL} select user_id, item_id, round(1 + 20 + 4 * least(ln(1 + playtime_forever), 3), 9) as confidence from edges")
def confidence_weights(spark, d):
    return rounded(interactions.confidence(tables.edges(spark, d), 20.0, 4.0, 3.0).select("user_id", "item_id", "confidence"), 9)


@query(f"""with {EDGES_SQL}, q as (select [quantile_cont(raw_ownership_count::double, k / 10.0) for k in range(11)] as e from activity),
c as (select list_sort(list_distinct(e)) as e from q)
select user_id, raw_ownership_count, greatest(len(list_filter(e, lambda x: x < raw_ownership_count)) - 1, 0)::int as decile from activity cross join c""".replace("[quantile_cont(raw_ownership_count::double, k / 10.0) for k in range(11)]", "[" + ", ".join(f"quantile_cont(raw_ownership_count::double, {k / 10})" for k in range(11)) + "]"))
def library_deciles(spark, d):
    return interactions.deciles(tables.activity(spark, d), "raw_ownership_count")


# ---- hashes and splits


@query(f"with {OUTER_SQL} select user_id, activity_band from split_users")
def activity_bands(spark, d):
    return tables.activity(spark, d).select("user_id", scalars.activity_band(F.col("raw_ownership_count"), tables.BANDS).cast("long").alias("activity_band"))


@query(f"select c_custkey, {hash_sql('demo', id_sql('c_custkey'), 'c_nationkey::varchar', id_sql('c_mktsegment'))} as stable_hash from customer")
def stable_hash_users(spark, d):
    h = hashing.stable_hash("demo", hashing.id_json(F.col("c_custkey")), F.col("c_nationkey").cast("string"), hashing.json_string(F.col("c_mktsegment")))
    return tables.table(spark, d, "customer").select("c_custkey", h.alias("stable_hash"))


@query(f"with {OUTER_SQL} select * from split_users")
def outer_user_split(spark, d):
    return tables.outer(spark, d)


@query(f"with {OUTER_SQL} select split, activity_band, count(*) as users, sum(raw_ownership_count)::bigint as edges from split_users group by 1, 2")
def outer_split_summary(spark, d):
    return tables.outer(spark, d).groupBy("split", "activity_band").agg(F.count("*").alias("users"), F.sum("raw_ownership_count").alias("edges"))




@query(
    f"""with {OUTER_SQL}, c as (select activity_band, count(*) as n from split_users where split = 'design' group by 1), t as (select sum(n)::bigint as total, (sum(n) // 3)::bigint as target from c),
f as (select activity_band, n, (target * n) // total as base, (target * n) % total as rest, target from c cross join t),
r as (select *, row_number() over (order by rest desc, activity_band::varchar || chr(10)) as k, target - sum(base) over () as spare from f)
select activity_band, n, (base + case when k <= spare then 1 else 0 end)::bigint as quota from r"""
)
def hamilton_quotas(spark, d):
    counts = tables.outer(spark, d).where("split = 'design'").groupBy("activity_band").agg(F.count("*").alias("n"))
    target = counts.agg(F.sum("n")).first()[0] // 3
    return splits.hamilton_quotas(counts, "activity_band", target)


@query(
    f"""with {NESTED_SQL}, u as (select distinct s.user_id, s.activity_band from split_users s join nested n on n.user_id = s.user_id where n.evaluable_user),
c as (select activity_band, count(*) as n from u group by 1), t as (select sum(n)::bigint as total, (sum(n) // 3)::bigint as target from c),
f as (select activity_band, n, (target * n) // total as base, (target * n) % total as rest, target from c cross join t),
r as (select *, row_number() over (order by rest desc, activity_band::varchar || chr(10)) as k, target - sum(base) over () as spare from f),
q as (select activity_band, (base + case when k <= spare then 1 else 0 end)::bigint as quota from r),
h as (select user_id, u.activity_band, quota, {hash_sql("evaluation-sample", "u.activity_band::varchar", id_sql("user_id"))} as selection_hash from u join q on q.activity_band = u.activity_band)
select user_id, activity_band, selection_hash, quota as sample_stratum_quota from h qualify row_number() over (partition by activity_band order by selection_hash, user_id) <= quota"""
)
def evaluation_user_sample(spark, d):
    able = tables.nested(spark, d).where("evaluable_user").select("user_id").distinct()
    users = tables.outer(spark, d).join(able, "user_id").withColumn("evaluable_user", F.lit(True))
    sample = splits.evaluation_sample(users, users.count() // 3)
    return sample.select("user_id", "activity_band", "selection_hash", "sample_stratum_quota")


@query(f"with {NESTED_SQL} select user_id, item_id, role, is_warm_item, evaluable_user, user_split_status, item_support_before, item_training_support_after from nested")
def nested_edge_split(spark, d):
    return tables.nested(spark, d).drop("playtime_forever")


@query(f"with {NESTED_SQL} select role, user_split_status, count(*) as edges, count(distinct user_id) as users, count(distinct item_id) as items from nested group by 1, 2")
def split_role_summary(spark, d):
    return tables.nested(spark, d).groupBy("role", "user_split_status").agg(F.count("*").alias("edges"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))


@query(f"with {NESTED_SQL} select user_id, count(*) filter (role = 'training') as training, count(*) filter (role = 'validation') as validation, count(*) filter (role = 'test') as test, count(*) filter (role = 'excluded_nonwarm_item') as excluded from nested group by 1")
def role_pivot(spark, d):
    names = ["training", "validation", "test", "excluded_nonwarm_item"]
    out = tables.nested(spark, d).groupBy("user_id").pivot("role", names).count().fillna(0)
    return out.withColumnRenamed("excluded_nonwarm_item", "excluded")


@query(f"with {NESTED_SQL} select user_id, item_id, playtime_forever from nested where role = 'training'")
def training_edges_antijoin(spark, d):
    roles = tables.nested(spark, d)
    warm = roles.where("is_warm_item").select("user_id", "item_id")
    design = tables.edges(spark, d).join(warm, ["user_id", "item_id"])
    held = roles.where("role in ('test', 'validation')")
    return interactions.remove_pairs(design, held).select("user_id", "item_id", "playtime_forever")


@query(f"with {NESTED_SQL} select user_id, item_id, playtime_forever from nested where is_warm_item")
def restored_edges(spark, d):
    roles = tables.nested(spark, d)
    whole = tables.edges(spark, d)
    part = lambda cond: whole.join(roles.where(cond).select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")
    return interactions.restore_pairs(part("role = 'training'"), part("role in ('test', 'validation')")).select("user_id", "item_id", "playtime_forever")


_COLD_CASE = "case " + " ".join(f"when s >= {a} and s < {b} then {k}" for k, (a, b) in enumerate(tables.COLD_BANDS)) + " end"


_COHORT_SQL = f"""{NESTED_SQL}, sup as (select item_id, count(*) as s from nested where role = 'training' group by 1),
i as (select item_id, s as design_training_support, p_type as primary_genre, {_COLD_CASE} as band from sup join part on p_partkey = item_id),
c as (select band, primary_genre, count(*) as n from i where band is not null group by 1, 2), t as (select *, sum(n) over (partition by band)::bigint as total from c),
f as (select *, (12 * n) // total as base, (12 * n) % total as rest from t),
r as (select *, row_number() over (partition by band order by rest desc, '"' || primary_genre || '"' || chr(10)) as k, 12 - sum(base) over (partition by band) as spare from f),
q as (select band, primary_genre, (base + case when k <= spare then 1 else 0 end)::bigint as quota from r),
h as (select i.*, quota, {hash_sql("pseudo-cold", "i.band::varchar", id_sql("i.primary_genre"), id_sql("i.item_id"))} as selection_hash from i join q on q.band = i.band and q.primary_genre = i.primary_genre),
cohort as (select item_id, design_training_support, primary_genre, selection_hash, band::int as support_band_index, quota as genre_stratum_quota from h qualify row_number() over (partition by band, primary_genre order by selection_hash, item_id) <= quota)"""


@query(f"with {_COHORT_SQL} select * from cohort")
def pseudo_cold_items(spark, d):
    support = interactions.support(tables.nested(spark, d).where("role = 'training'"), "item_id", "design_training_support")
    rows = support.join(tables.items(spark, d).select("item_id", F.col("p_type").alias("primary_genre")), "item_id")
    out = splits.pseudo_cold_items(rows, tables.COLD_BANDS, 12)
    return out.select("item_id", "design_training_support", "primary_genre", "selection_hash", "support_band_index", "genre_stratum_quota")


@query(f"with {EDGES_SQL} select user_id, item_id, {hash_sql('leave-out', id_sql('user_id'), id_sql('item_id'))} as h, count(*) over (partition by user_id) >= 5 and row_number() over (partition by user_id order by {hash_sql('leave-out', id_sql('user_id'), id_sql('item_id'))}, item_id) <= 2 as is_held from edges".replace(f"{hash_sql('leave-out', id_sql('user_id'), id_sql('item_id'))} as h, ", ""))
def leave_two_out(spark, d):
    return splits.hashed_holdout(tables.edges(spark, d).select("user_id", "item_id"))


# ---- features

_LABELS_SQL = "lab as (select p_partkey as item_id, list_distinct(list_concat([p_type, p_brand], string_split(p_name, ' '))) as labels from part)"


@query(f"with {_LABELS_SQL} select item_id, 'genre::' || unnest(labels) as feature_name, round(1.0::double / len(labels), 9) as weight from lab")
def genre_multihot(spark, d):
    return rounded(features.label_features(tables.items(spark, d)), 9)


@query(f"with {NESTED_SQL}, {_LABELS_SQL}, cat as (select distinct item_id from nested where is_warm_item), x as (select w.item_id is not null as warm, unnest(list_concat(['*'], labels)) as label from lab l left join cat w on w.item_id = l.item_id) select label, count(*) as items, count(*) filter (warm) as warm_items from x group by 1")
def feature_coverage(spark, d):
    warm = tables.nested(spark, d).where("is_warm_item").select("item_id").distinct()
    return features.coverage(tables.items(spark, d), warm)


@query("select p_partkey as item_id, list_min(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '')) as primary_label from part")
def primary_labels(spark, d):
    part = tables.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("item_id"), scalars.primary_label(F.replace("p_name", F.lit(" "), F.lit(","))).alias("primary_label"))


# ---- ranking

_SCORES_SQL = """
trained as (select user_id, item_id, playtime_forever from nested where role = 'training'),
warm_items as (select distinct item_id from nested where is_warm_item),
scores as (
  select 'popularity' as family, w.item_id, count(t.item_id)::double as score from warm_items w left join trained t on t.item_id = w.item_id group by 2
  union all select 'volume', w.item_id, coalesce(sum(t.playtime_forever), 0)::double from warm_items w left join trained t on t.item_id = w.item_id group by 2),
targets as (select user_id, item_id as target_item_id from nested where role = 'test' and evaluable_user),
hidden as (select user_id, item_id from nested where evaluable_user and role in ('training', 'validation') and is_warm_item)"""
_TIES_SQL = (
    NESTED_SQL
    + ","
    + _SCORES_SQL
    + """,
level_counts as (select family, score, count(*) as n from scores group by 1, 2),
targeted as (select t.user_id, t.target_item_id, s.family, s.score from targets t join scores s on s.item_id = t.target_item_id),
whole as (select a.user_id, a.target_item_id, a.family, a.score, sum(l.n) filter (l.score > a.score) as above, sum(l.n) filter (l.score = a.score) as tied from targeted a join level_counts l on l.family = a.family group by 1, 2, 3, 4),
lost as (select a.user_id, a.family, count(*) filter (s.score > a.score) as above, count(*) filter (s.score = a.score) as tied from targeted a join hidden h on h.user_id = a.user_id join scores s on s.item_id = h.item_id and s.family = a.family group by 1, 2),
ties as (select w.family, w.user_id, w.target_item_id, (coalesce(w.above, 0) - coalesce(l.above, 0))::bigint as g, (w.tied - coalesce(l.tied, 0))::bigint as e from whole w left join lost l on l.user_id = w.user_id and l.family = w.family),
"""
)


def _dcg_sql(n: str, k: int) -> str:
    values = ", ".join(repr(x) for x in scalars.dcg_prefix(k))
    return f"([{values}])[least({n}, {k}) + 1]"


_METRICS_SQL = _TIES_SQL + "metric_rows as (select family, user_id, target_item_id, g as strictly_above, e as tied_block_size, g + (e + 1) / 2.0::double as expected_rank, " + ", ".join(f"least(greatest({k} - g, 0), e)::double / e as recall_at_{k}, ({_dcg_sql('g + e', k)}::double - {_dcg_sql('g', k)}::double) / e as ndcg_at_{k}" for k in ranking.KS) + " from ties)"
_MEANS_SQL = ", ".join(f"round(avg({m}), 8) as mean_{m}" for m in evaluation.METRICS)


@query(f"with {NESTED_SQL}, {_SCORES_SQL} select item_id, score from scores where family = 'popularity'")
def popularity_scores(spark, d):
    return evaluate.item_scores(evaluate.prepare(spark, d), "popularity")


@query(f"with {NESTED_SQL}, {_SCORES_SQL} select item_id, score from scores where family = 'popularity' qualify row_number() over (order by score desc, item_id) <= (select (count(*) + 99) // 100 from warm_items)")
def top_one_percent_items(spark, d):
    return interactions.top_share(evaluate.item_scores(evaluate.prepare(spark, d), "popularity"), "score")


@query(f"with {NESTED_SQL}, {_SCORES_SQL}, n as (select count(*) as n from warm_items), h as (select user_id, count(*) as hidden from hidden group by 1) select t.user_id, (n - coalesce(hidden, 0))::bigint as candidates from targets t cross join n left join h on h.user_id = t.user_id")
def candidate_counts(spark, d):
    """Catalogue less exclusions per evaluable user, by counts."""
    ready = evaluate.prepare(spark, d)
    n = ready.warm.agg(F.count("*").alias("n"))
    hidden = ready.hidden.groupBy("user_id").agg(F.count("*").alias("hidden"))
    return ready.targets.select("user_id").join(hidden, "user_id", "left").crossJoin(F.broadcast(n)).select("user_id", (F.col("n") - F.coalesce("hidden", F.lit(0))).alias("candidates"))


@query(f"with {_METRICS_SQL} select family, user_id, target_item_id, strictly_above, tied_block_size, round(expected_rank, 8) as expected_rank, " + ", ".join(f"round({m}, 8) as {m}" for m in evaluation.METRICS if m != "expected_rank") + " from metric_rows")
def rank_targets(spark, d):
    return rounded(evaluate.both_families(evaluate.prepare(spark, d)))


@query(f"with {_METRICS_SQL} select family, count(*) as users, {_MEANS_SQL} from metric_rows where family = 'popularity' group by 1")
def popularity_leaderboard(spark, d):
    return evaluate.popularity_leaderboard(spark, d)


@query(f"with {_METRICS_SQL} select family, count(*) as users, {_MEANS_SQL} from metric_rows group by 1")
def leaderboard(spark, d):
    return rounded(evaluation.leaderboard(evaluate.both_families(evaluate.prepare(spark, d)), "family"))


@query(f"with {_METRICS_SQL}, m as (select family, avg(ndcg_at_20) as ndcg, avg(recall_at_20) as recall from metric_rows group by 1) select 'heuristic' as family, family as configuration_id, round(ndcg, 8) as ndcg, round(recall, 8) as recall, 0::bigint as parameter_count, 0 as factors from m qualify row_number() over (order by ndcg desc, recall desc, family) = 1")
def config_selection(spark, d):
    board = evaluation.leaderboard(evaluate.both_families(evaluate.prepare(spark, d)), "family").withColumnRenamed("family", "configuration_id")
    board = board.withColumns({"family": F.lit("heuristic"), "parameter_count": F.lit(0).cast("long"), "factors": F.lit(0)})
    return rounded(evaluation.select_configuration(board, 1))


_BAND_SQL = "(" + " + ".join("({0} >= %d)::int" % b for b in tables.BANDS) + " - 1)"


@query(
    f"with {_METRICS_SQL}, ua as (select user_id, count(*) as a from trained group by 1), ts as (select item_id, count(*) as s from trained group by 1), "
    f"x as (select m.*, {_BAND_SQL.format('a')} as band, {_BAND_SQL.format('coalesce(s, 0)')} as support from metric_rows m left join ua on ua.user_id = m.user_id left join ts on ts.item_id = m.target_item_id), "
    "y as (select *, 'activity' as dimension, band as segment_code from x union all select *, 'support', support from x union all select *, 'tied', (tied_block_size > 1)::int from x) "
    "select family, dimension, segment_code::int as segment_code, count(*) as users, round(avg(recall_at_20), 8) as mean_recall_at_20, round(avg(ndcg_at_20), 8) as mean_ndcg_at_20, round(avg(expected_rank), 8) as mean_expected_rank from y group by 1, 2, 3"
)
def segment_metrics(spark, d):
    ready = evaluate.prepare(spark, d)
    rows = evaluate.described(evaluate.both_families(ready), ready.trained).fillna(0, ["target_training_support"])
    codes = {"activity": evaluation.band_code("user_activity", tables.BANDS), "support": evaluation.band_code("target_training_support", tables.BANDS), "tied": (F.col("tied_block_size") > 1).cast("int")}
    return rounded(evaluation.segments(rows, ["family"], codes))


@query(f"with {_METRICS_SQL} select a.user_id, round(a.ndcg_at_20 - b.ndcg_at_20, 8) + 0.0::double as difference from metric_rows a join metric_rows b on a.user_id = b.user_id and a.family = 'volume' and b.family = 'popularity'")
def paired_metric_diff(spark, d):
    rows = saver(spark)(evaluate.both_families(evaluate.prepare(spark, d)))
    out = evaluation.paired_differences(rows.where("family = 'volume'"), rows.where("family = 'popularity'"), "ndcg_at_20")
    return out.select("user_id", (F.round("difference", 8) + F.lit(0.0)).alias("difference"))


_INCLUSION_SQL = (
    f"{NESTED_SQL}, {_SCORES_SQL}, pairs as (select t.user_id, s.item_id, s.score from targets t cross join scores s where s.family = 'popularity' and not exists (select 1 from hidden h where h.user_id = t.user_id and h.item_id = s.item_id)), "
    "placed as (select *, rank() over (partition by user_id order by score desc) as rk, count(*) over (partition by user_id, score) as c from pairs), "
    "inclusion as (select user_id, item_id, score, least(1.0::double, (20 - (rk - 1)) / c::double) as inclusion from placed where rk <= 20)"
)


def _inclusion(ready: evaluate.Prepared) -> DataFrame:
    return ranking.item_top_k_inclusion(evaluate.item_scores(ready, "popularity"), ready.targets, ready.hidden, 20)


@query(f"with {_INCLUSION_SQL} select user_id, item_id, score, round(inclusion, 9) as inclusion from inclusion")
def topk_inclusion(spark, d):
    return rounded(_inclusion(evaluate.prepare(spark, d)).select("user_id", "item_id", "score", "inclusion"), 9)


@query(f"with {_INCLUSION_SQL}, e as (select item_id, 1 - product(1 - inclusion) as shown from inclusion group by 1) select round(sum(shown), 6) as expected_items, round(sum(shown) / (select count(*) from warm_items), 6) as coverage from e")
def expected_coverage(spark, d):
    ready = evaluate.prepare(spark, d)
    return rounded(ranking.expected_coverage(_inclusion(ready), ready.warm.count()), 6)


@query(f"with {_INCLUSION_SQL}, top as (select item_id from scores where family = 'popularity' qualify row_number() over (order by score desc, item_id) <= (select (count(*) + 99) // 100 from warm_items)) select round(coalesce(sum(inclusion) filter (item_id in (select item_id from top)), 0) / sum(inclusion), 6) as concentration from inclusion")
def concentration(spark, d):
    ready = evaluate.prepare(spark, d)
    top = interactions.top_share(evaluate.item_scores(ready, "popularity"), "score")
    return rounded(ranking.concentration(_inclusion(ready), top), 6)


# ---- scores and utilities

_DOT_SQL = "pairs as (select a.vec_id as user_id, b.vec_id as item_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double)) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)"


def _vector_scores(spark, d, digits: int | None = None) -> DataFrame:
    """Inner products of vectors of one label: each label is a small catalogue of its own."""
    return ranking.inner_products(tables.table(spark, d, "embeddings"), "label", "vec_id", "embedding", digits)


@query(f"with {_DOT_SQL} select user_id, item_id, round(score, 6) as score from pairs")
def embedding_scores(spark, d):
    return _vector_scores(spark, d, 6)


@query("with v as (select user_id, event_id, value from events where value is not null) select user_id, event_id, round((rank() over (partition by user_id order by value) - 1 + 0.5::double * count(*) over (partition by user_id, value)) / count(*) over (partition by user_id), 9) as midrank from v")
def event_midrank(spark, d):
    rows = tables.table(spark, d, "events").where("value is not null").select("user_id", "event_id", F.col("value").alias("score"))
    return rounded(ranking.within_user_midrank(rows).select("user_id", "event_id", "midrank"), 9)


@query("with v as (select user_id, event_id, value from events where value is not null) select user_id, event_id, round(least(greatest((value - avg(value) over (partition by user_id)) / greatest(stddev_pop(value) over (partition by user_id), 1e-6), 0), 100), 6) as zscore from v")
def user_zscore(spark, d):
    rows = tables.table(spark, d, "events").where("value is not null").select("user_id", "event_id", F.col("value").alias("score"))
    return rounded(ranking.user_zscore(rows).select("user_id", "event_id", "zscore"), 6)


_PARAMETERS_SQL = "par as (select min(value) as lo, quantile_cont(value, 0.05) as q05, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75, quantile_cont(value, 0.95) as q95, count(value) as n from events)"


@query(f"with {_PARAMETERS_SQL} select round(lo, 8) as global_min, round(q05, 8) as global_q05, round(q25, 8) as global_q25, round(q50, 8) as global_median, round(q75, 8) as global_q75, round(q95, 8) as global_q95, n as sample_count from par")
def global_score_params(spark, d):
    return rounded(ranking.global_parameters(tables.table(spark, d, "events"), "value"))


@query(f"with {_PARAMETERS_SQL} select event_id, round(least(greatest((value - lo) / greatest(q95 - q05, 1e-6), 0), 1e6), 8) as shift_scale, round(ln(1 + exp(least(greatest((value - q50) / greatest(q75 - q25, 1e-6), -40), 40))), 8) as softplus from events cross join par where value is not null")
def pseudo_utilities(spark, d):
    events = tables.table(spark, d, "events").where("value is not null")
    p = F.broadcast(ranking.global_parameters(events, "value"))  # one row
    v = F.col("value")
    out = events.crossJoin(p).select("event_id", scalars.shift_scale(v, F.col("global_min"), F.col("global_q05"), F.col("global_q95")).alias("shift_scale"), scalars.robust_softplus(v, F.col("global_median"), F.col("global_q25"), F.col("global_q75")).alias("softplus"))
    return rounded(out)


# ---- bundles


@query(f"with {BUNDLES_SQL}, g as (select *, case when component_price_sum > 0 then 1 - final_price / component_price_sum end as r from bundles) select bundle_id, final_price, stated_discount, component_price_sum, round(component_price_sum - final_price, 6) as abs_discount, round(r, 6) as implied_discount_rate, round(r - stated_discount, 6) as discount_gap, coalesce(abs(r - stated_discount) > 0.05, false) as discount_mismatch from g")
def bundle_price_gaps(spark, d):
    return rounded(bundles.price_gaps(tables.bundles(spark, d)), 6)


_OVERLAP_SQL = BUNDLES_SQL + f", {EDGES_SQL}, sizes as (select bundle_id, count(*) as n from bundle_items group by 1), held as (select e.user_id, b.bundle_id, count(*) as owned, sum(playtime_forever) as played from edges e join bundle_items b on b.item_id = e.item_id group by 1, 2)"


@query(f"with {_OVERLAP_SQL}, seen as (select bundle_id, count(*) as k from bundle_items where item_id in (select item_id from edges) group by 1), u as (select h.bundle_id, count(*) filter (owned = n) as a, count(*) as o, sum(played) as p from held h join sizes s on s.bundle_id = h.bundle_id group by 1) select s.bundle_id, n as n_bundle_items, coalesce(k, 0) as items_in_panel, round(coalesce(k, 0) / n::double, 6) as panel_coverage, coalesce(a, 0) as users_own_all, coalesce(o, 0) as users_own_any, round(p / o, 6) as avg_playtime_overlap from sizes s left join seen using (bundle_id) left join u using (bundle_id)")
def bundle_demand_proxy(spark, d):
    return rounded(bundles.demand_proxy(tables.edges(spark, d), tables.bundle_items(spark, d)), 6)


@query(f"with {BUNDLES_SQL} select a.bundle_id as first, b.bundle_id as second, count(*) as shared_items from bundle_items a join bundle_items b on a.item_id = b.item_id and a.bundle_id < b.bundle_id group by 1, 2")
def bundle_overlap_pairs(spark, d):
    return bundles.overlap_pairs(tables.bundle_items(spark, d))


@query(f"with {BUNDLES_SQL} select item_id, count(*) as bundles from bundle_items group by 1 having count(*) >= 2")
def items_in_multiple(spark, d):
    return bundles.items_in_several(tables.bundle_items(spark, d))


@query(f"with {_OVERLAP_SQL} select h.user_id, h.bundle_id from held h join sizes s on s.bundle_id = h.bundle_id and s.n = h.owned")
def user_candidate_bundles(spark, d):
    return bundles.user_candidates(tables.edges(spark, d), tables.bundle_items(spark, d))


_COMPONENTS_SQL = """comp as (select l_orderkey as bundle_id, case when l_linenumber = 7 then null else l_partkey end as item_id, case when l_discount = 0 then '' when l_tax = 0 then null else l_extendedprice::varchar end as price from lineitem),
cat as (select p_partkey as item_id, p_brand as publisher, p_type as developer from part where p_size <= 45)"""
_AUDIT_SQL = f"""{_COMPONENTS_SQL},
agg as (select bundle_id, count(*) as n, count(cat.item_id) as c, count(*) filter (price is not null and trim(price) <> '') as p, count(distinct publisher) as pub, count(distinct developer) as dev, count(*) filter (comp.item_id is null) as miss from comp left join cat on cat.item_id = comp.item_id group by 1),
audit as (select bundle_id, n as n_items, c as n_items_in_catalogue, round(c / n::double, 6) as catalogue_coverage, round(p / n::double, 6) as standalone_price_coverage, pub as n_distinct_publishers, pub = 1 as publisher_coherent, dev = 1 as developer_coherent, miss as n_missing_item_id,
  case when c > 0 and p = n then 'B_SBA_like' else 'E_unclear' end as mechanism_class, case when c / n::double >= 0.8 then 'high' when c / n::double >= 0.5 then 'medium' else 'low' end as confidence,
  case when c = 0 and p = n then 'no components found in catalogue snapshot (likely catalogue incompleteness); standalone prices still shown'
    when c = 0 then 'no components found in catalogue snapshot; standalone-price evidence available for ' || p || '/' || n || ' components'
    when p = n and c / n::double >= 0.5 then c || '/' || n || ' components individually listed in catalogue; all show a standalone price'
    when p = n then c || '/' || n || ' components individually listed; standalone prices shown for all'
    else c || '/' || n || ' components individually listed; standalone prices shown for ' || p || '/' || n end as evidence from agg)"""


def _audit(spark, d) -> DataFrame:
    lines = tables.table(spark, d, "lineitem")
    item = F.when(F.col("l_linenumber") != 7, F.col("l_partkey"))
    price = F.when(F.col("l_discount") == 0, "").when(F.col("l_tax") != 0, F.col("l_extendedprice").cast("string"))
    part = tables.table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("developer"))
    return bundles.bundle_audit(lines.select(F.col("l_orderkey").alias("bundle_id"), item.alias("item_id"), price.alias("price")), part)


@query(f"with {_AUDIT_SQL} select * from audit")
def bundle_audit(spark, d):
    return rounded(_audit(spark, d), 6)


@query(f"with {_AUDIT_SQL} select count(*) as bundles, " + ", ".join(f"count(*) filter (mechanism_class = '{c}') as \"class_{c}\"" for c in ("B_SBA_like", "E_unclear")) + ", " + ", ".join(f"count(*) filter (confidence = '{c}') as confidence_{c}" for c in ("high", "medium", "low")) + ", count(*) filter (publisher_coherent) as publisher_coherent, count(*) filter (developer_coherent) as developer_coherent from audit")
def audit_summary(spark, d):
    return bundles.audit_summary(_audit(spark, d))


@query("with a as (select c_custkey as k, c_nationkey as n, round(c_acctbal, 0) as b from customer where c_custkey % 7 <> 3), b as (select c_custkey as k, case when c_custkey % 5 = 0 then c_nationkey + 1 else c_nationkey end as n, case when c_custkey % 6 = 0 then null else round(c_acctbal, 0) end as b from customer where c_custkey % 11 <> 4), j as (select coalesce(a.k, b.k) as k, case when b.k is null then 'missing' when a.k is null then 'extra' when a.n is distinct from b.n or a.b is distinct from b.b then 'changed' end as status, concat_ws(',', case when a.n is distinct from b.n then 'n' end, case when a.b is distinct from b.b then 'b' end) as f from a full outer join b on a.k = b.k) select k, status, case when status = 'changed' then f else '' end as fields from j where status is not null")
def audit_diff(spark, d):
    """Two versions of the customer table against each other by key."""
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.round("c_acctbal", 0).alias("b"))
    other = c.select("k", F.when(F.col("k") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("k") % 6 != 0, F.col("b")).alias("b"))
    return bundles.table_diff(c.where("k % 7 <> 3"), other.where("k % 11 <> 4"), "k")


@query(f"with {BUNDLES_SQL}, {EDGES_SQL}, p as (select item_id, count(*) as owners, avg(playtime_forever) as mean_playtime, median(playtime_forever) as median_playtime, sum(playtime_forever) as total_playtime, avg((playtime_forever > 0)::int) as share_played from edges group by 1), b as (select item_id, count(*) as n_bundles from bundle_items group by 1) select p_partkey as item_id, p_retailprice as price, coalesce(owners, 0) as owners, round(mean_playtime, 6) as mean_playtime, round(median_playtime, 6) as median_playtime, round(total_playtime, 6) as total_playtime, round(share_played, 6) as share_played, coalesce(n_bundles, 0) as n_bundles, owners is not null as in_edges, n_bundles is not null as in_bundles from part left join p on p.item_id = p_partkey left join b on b.item_id = p_partkey")
def item_features_table(spark, d):
    items = tables.items(spark, d).select("item_id", "price")
    return rounded(bundles.item_table(items, tables.edges(spark, d), tables.bundle_items(spark, d)), 6)


@query()
def mincost_attribution(spark, d):
    """Orders as bundles of parts, in cents: which of its orders a customer needs, and which parts would be cheaper alone."""
    items = saver(spark)(tables.bundle_items(spark, d))
    cents = tables.bundles(spark, d).select("bundle_id", scalars.to_cents(F.col("final_price")).alias("cents"))
    solo = tables.items(spark, d).select("item_id", scalars.to_cents(F.col("price")).alias("cents"))
    owned = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("bundle_id"))
    return rounded(bundles.mincost_attribution(bundles.counted_components(owned, items), items, cents, solo), 6)


# ---- panels and prices

_SUMS_SQL = PANEL_SQL + ", ranked as (select user_id, item_id, v, row_number() over w as size, sum(v) over (w rows unbounded preceding) as w from panel window w as (partition by user_id order by v desc, item_id)), sums as (select user_id, size, w from ranked where size in (" + ", ".join(map(str, tables.SIZES)) + "))"
_MENU_SQL = "menu(size, price, cost) as (values " + ", ".join(f"({s}, {p}::double, {tables.UNIT_COST * s}::double)" for s, p in zip(tables.SIZES, tables.MENU, strict=True)) + ")"
_CHOICE_SQL = _SUMS_SQL + ", " + _MENU_SQL + ", offers as (select user_id, m.size, m.price, m.price - m.cost as margin, w - m.price as surplus, max(w - m.price) over (partition by user_id) as best from sums s join menu m on m.size = s.size), picks as (select user_id, size, price, margin from offers where best > 1e-12 and surplus >= best - 1e-12 qualify row_number() over (partition by user_id order by price, size) = 1), users as (select distinct user_id from sums)"


@query(f"with {_SUMS_SQL} select user_id, size::int as size, round(w, 6) as w from sums")
def top_s_sums(spark, d):
    return rounded(pricing.top_sums(tables.panel(spark, d), tables.SIZES), 6)


@query(f"with {_CHOICE_SQL} select u.user_id, size::int as size, price, margin from users u left join picks p on p.user_id = u.user_id")
def user_choices(spark, d):
    panel = tables.panel(spark, d)
    return pricing.user_choices(pricing.top_sums(panel, tables.SIZES), pricing.menu_table(panel, tables.MENU, tables.SIZES, tables.UNIT_COST))


@query(f"with {_CHOICE_SQL} select count(*) as users, count(size) as buyers, round(avg(coalesce(margin, 0)), 6) as profit, round(1 - count(size) / count(*)::double, 6) as outside_share from users u left join picks p on p.user_id = u.user_id")
def menu_evaluation(spark, d):
    return rounded(pricing.evaluate_menu(tables.panel(spark, d), tables.MENU, tables.SIZES, tables.UNIT_COST), 6)


_SCAN_SQL = PANEL_SQL + ", n as (select count(distinct user_id) as n from panel), scan as (select item_id, v as price, count(*) over (partition by item_id order by v desc) as buyers from panel), gains as (select item_id, price, max(buyers) as buyers, (price - 10) * max(buyers) / n as profit from scan cross join n group by item_id, price, n), best as (select * from gains qualify row_number() over (partition by item_id order by profit desc, price) = 1)"


@query(f"with {_SCAN_SQL} select item_id, case when profit > 0 then price end as price, case when profit > 0 then buyers else 0 end as buyers, round(greatest(profit, 0), 6) as profit from best")
def component_prices(spark, d):
    return rounded(pricing.component_prices(tables.panel(spark, d), tables.UNIT_COST), 6)


@query(f"with {_SCAN_SQL} select round(sum(greatest(profit, 0)), 6) as profit from best")
def separate_selling(spark, d):
    return rounded(pricing.separate_selling(tables.panel(spark, d), tables.UNIT_COST), 6)


@query(f"with {PANEL_SQL}, s as (select user_id, round(sum(v), 9) as w from panel group by 1), g as (select w as price, (w - 50) * count(*) over (order by w desc) / (select count(*) from s) as profit, count(*) over (order by w desc) as buyers from s), b as (select * from g order by profit desc, price limit 1) select case when profit > 0 then round(price, 6) end as price, case when profit > 0 then buyers else 0 end as buyers, round(greatest(profit, 0), 6) as profit from b")
def pure_bundling(spark, d):
    return rounded(pricing.pure_bundling(tables.panel(spark, d), 5 * tables.UNIT_COST), 6)


@query(
    f"with {_SCAN_SQL}, cp as (select item_id, case when profit > 0 then price end as price from best), t as (select user_id, round(sum(case when cp.price is null then v else least(v, cp.price) end), 9) as w, sum(case when v >= cp.price then cp.price - 10 else 0 end) as a from panel p join cp on cp.item_id = p.item_id group by 1), "
    "l as (select w, count(*) as k, sum(a) as a from t group by 1), c as (select w, sum(k) over (order by w desc) as buyers, sum(a) over (order by w desc) as lost from l), g as (select w as price, buyers, round((buyers * (w - 50) - lost) / (select count(*) from t), 9) as gain from c), b as (select * from g order by gain desc, price limit 1) "
    "select case when gain > 0 then round(price, 6) end as price, (case when gain > 0 then buyers else 0 end)::bigint as buyers, round(greatest(gain, 0), 6) as gain from b"
)
def sba_bundle_price(spark, d):
    panel = tables.panel(spark, d)
    bundle = panel.select("item_id").distinct()
    thresholds = pricing.bundle_thresholds(panel, pricing.component_prices(panel, tables.UNIT_COST), bundle, tables.UNIT_COST)
    return rounded(pricing.fixed_bundle_scan(thresholds, 5 * tables.UNIT_COST), 6)


@query(f"with {_SUMS_SQL} select a.size::int as size_a, b.size::int as size_b, round(avg(a.w), 6) as omega_a, round(avg(b.w), 6) as omega_b, round(covar_samp(a.w, b.w), 4) as sigma from sums a join sums b on a.user_id = b.user_id and a.size <= b.size group by 1, 2")
def moments_omega_sigma(spark, d):
    out = rounded(pricing.moments(tables.panel(spark, d), tables.SIZES), 6)
    return out.withColumn("sigma", F.round("sigma", 4))


_WIDE_SQL = "wide as (select user_id, " + ", ".join(f"max(w) filter (size = {s}) as w{k}" for k, s in enumerate(tables.SIZES)) + " from sums group by 1)"


def _shrunk_sql(sums: str) -> str:
    """Ledoit-Wolf in two passes over the top sums of a chain of views."""
    m = range(len(tables.SIZES))
    pairs = [(a, b) for a in m for b in m]
    norm = " + ".join(f"x{k} * x{k}" for k in m)
    trace = "(" + " + ".join(f"s{k}_{k}" for k in m) + f") / {len(m)}"
    squares = " + ".join(f"s{a}_{b} * s{a}_{b}" for a, b in pairs)
    apart = " + ".join(f"(s{a}_{b} - {'target' if a == b else '0'}) ^ 2" for a, b in pairs)
    rows = " union all ".join(f"select {tables.SIZES[a]}::int as size_a, {tables.SIZES[b]}::int as size_b, round(m{a}, 5) as omega_a, round(m{b}, 5) as omega_b, round(s{a}_{b} * n / (n - 1), 3) as sigma, round((1 - weight) * s{a}_{b} + {'weight * target' if a == b else '0'}, 3) as shrunk, round(weight, 7) as weight from l" for a, b in pairs if a <= b)
    return (
        f"with {sums}, {_WIDE_SQL}, full_rows as (select * from wide where " + " and ".join(f"w{k} is not null" for k in m) + "), means as (select count(*) as n, " + ", ".join(f"avg(w{k}) as m{k}" for k in m) + " from full_rows), "
        "x as (select " + ", ".join(f"w{k} - m{k} as x{k}" for k in m) + " from full_rows cross join means), "
        "s as (select avg((" + norm + ") ^ 2) as fourth, " + ", ".join(f"avg(x{a} * x{b}) as s{a}_{b}" for a, b in pairs) + f" from x), t as (select *, {trace} as target, {squares} as squares from s cross join means), "
        f"d as (select *, ({apart}) / {len(m)} as distance, greatest(0, fourth - squares) / (n * {len(m)}) as noise from t), l as (select *, case when distance <= 0 then 0 else least(noise, distance) / distance end as weight from d) {rows}"
    )


def _shrunk(rows: DataFrame) -> DataFrame:
    digits = {"omega_a": 5, "omega_b": 5, "sigma": 3, "shrunk": 3, "weight": 7}
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(_shrunk_sql(_SUMS_SQL))
def moments_shrunk(spark, d):
    """Means, sample and Ledoit-Wolf covariances of top sums, and the weight of the shrinkage."""
    return _shrunk(pricing.shrunk_moments(tables.panel(spark, d), tables.SIZES))


_GRID_POINTS = 12


def _grid_sql(points: int) -> str:
    m = range(len(tables.SIZES))
    cost = [tables.UNIT_COST * s for s in tables.SIZES]
    price = lambda k: f"case when k{k}.k = {points - 1} then t{k} else k{k}.k * (t{k} / {points - 1}) end"
    number = " + ".join(f"k{k}.k * {points ** (len(m) - 1 - k)}" for k in m)
    near = lambda k: f"w{k} - p{k} >= best - 1e-12"
    return (
        f"with {_SUMS_SQL}, {_WIDE_SQL}, tops as (select " + ", ".join(f"max(w{k}) as t{k}" for k in m) + " from wide), "
        f"k as (select unnest(range({points}))::bigint as k), menus as (select {number} as menu, " + ", ".join(f"{price(k)} as p{k}" for k in m) + " from tops" + "".join(f" cross join k as k{k}" for k in m) + "), "
        "offers as (select *, greatest(" + ", ".join(f"w{k} - p{k}" for k in m) + ") as best from menus cross join wide), "
        "cheapest as (select *, case when best > 1e-12 then least(" + ", ".join(f"case when {near(k)} then p{k} end" for k in m) + ") end as pm from offers), "
        "margins as (select menu, case when pm is null then 0 else pm - case " + " ".join(f"when {near(k)} and p{k} = pm then {cost[k]}::double" for k in m) + " end end as margin from cheapest), "
        "profits as (select menu, avg(margin) as profit from margins group by 1), top as (select menu, profit from profits order by round(profit, 9) desc, menu limit 1), "
        "chosen as (select * from top join menus using (menu)) " + " union all ".join(f"select {s}::int as size, round(p{k}, 6) as price, round(profit, 6) as profit, menu::bigint as menu from chosen" for k, s in enumerate(tables.SIZES))
    )


@query(_grid_sql(_GRID_POINTS))
def price_grid(spark, d):
    """The best menu of a grid of 12 prices a size, by bounds."""
    return rounded(grids.price_grid(tables.panel(spark, d), tables.SIZES, _GRID_POINTS, tables.UNIT_COST), 6)


@query()
def price_grid_million(spark, d):
    """The best of 2,560,000 menus: 40 prices a size. Tested against a loop over all menus of smaller grids."""
    return grids.price_grid(tables.panel(spark, d), tables.SIZES, 40, tables.UNIT_COST)


@query(f"with {_SUMS_SQL}, {_MENU_SQL}, k(f) as (values (0.5::double), (0.75::double), (1.0::double), (1.25::double)), o as (select f, user_id, m.size, m.price * f as price, m.price * f - cost as margin, w - m.price * f as surplus, max(w - m.price * f) over (partition by f, user_id) as best from sums s join menu m on m.size = s.size cross join k), p as (select f, user_id, margin from o where best > 1e-12 and surplus >= best - 1e-12 qualify row_number() over (partition by f, user_id order by price, size) = 1) select case f when 0.5 then 0 when 0.75 then 1 when 1.0 then 2 else 3 end::int as menu, round(sum(margin) / (select count(distinct user_id) from sums), 6) as profit from p group by f")
def menu_search(spark, d):
    menus = [[p * f for p in tables.MENU] for f in (0.5, 0.75, 1.0, 1.25)]
    return rounded(pricing.menu_search(tables.panel(spark, d), menus, tables.SIZES, tables.UNIT_COST), 6)


_POOL = ("click", "error", "purchase", "signup", "view")
_COMPOSITIONS_SQL = "comps(composition, item_id) as (values " + ", ".join(f"({k}, '{i}')" for k, c in enumerate(composition.enumerate_compositions(_POOL, 3)) for i in c) + ")"


@query(
    f"with {_SCAN_SQL}, {_COMPOSITIONS_SQL}, cp as (select item_id, case when profit > 0 then price end as price from best), t as (select composition, user_id, round(sum(case when cp.price is null then v else least(v, cp.price) end), 9) as w, sum(case when v >= cp.price then cp.price - 10 else 0 end) as a, count(*) as k from panel p join cp on cp.item_id = p.item_id join comps c on c.item_id = p.item_id group by 1, 2), "
    "l as (select composition, w, count(*) as n, sum(a) as a, max(k) as k from t group by 1, 2), c as (select composition, w, sum(n) over (partition by composition order by w desc) as buyers, sum(a) over (partition by composition order by w desc) as lost, max(k) over (partition by composition) as size from l), "
    "g as (select composition, w as price, buyers, round((buyers * (w - size * 10) - lost) / n, 9) as gain from c cross join n), b as (select * from g qualify row_number() over (partition by composition order by gain desc, price) = 1) "
    "select composition::int as composition, case when gain > 0 then round(price, 6) end as price, (case when gain > 0 then buyers else 0 end)::bigint as buyers, round(greatest(gain, 0), 6) as gain from b"
)
def bundle_compositions(spark, d):
    """The best bundle price of every set of two or three event types, beside component prices."""
    panel = tables.panel(spark, d)
    return rounded(composition.scan_compositions(panel, pricing.component_prices(panel, tables.UNIT_COST), composition.enumerate_compositions(_POOL, 3), tables.UNIT_COST), 6)


@query(
    f"with {PANEL_SQL}, k(scale, shift) as (values (1.0::double, 0.0::double), (2.0::double, 0.0::double), (1.0::double, -40.0::double)), n as (select count(distinct user_id) as n from panel), x as (select scale, shift, item_id, greatest(shift + scale * v, 0) as v, (shift + scale * v < 0)::int as low from panel cross join k), f as (select scale, shift, avg(low) as floored from x group by 1, 2), "
    "s as (select scale, shift, item_id, v * count(*) over (partition by scale, shift, item_id order by v desc) / n as profit from x cross join n), b as (select scale, shift, item_id, max(profit) as profit from s group by 1, 2, 3) select f.scale, f.shift, round(floored, 6) as floored, round(sum(profit), 5) as separate from f join b on b.scale = f.scale and b.shift = f.shift group by 1, 2, 3"
)
def knob_sweep(spark, d):
    """Separate-selling profit and floored share under rescaled and shifted values."""
    out = sweeps.knob_sweep(tables.panel(spark, d).withColumnRenamed("v", "score"), 0.0, 1.0, [(1.0, 0.0), (2.0, 0.0), (1.0, -40.0)])
    return out.select("scale", "shift", F.round("floored", 6).alias("floored"), F.round("separate", 5).alias("separate"))


@query(f"with {BUNDLES_SQL}, {EDGES_SQL}, s as (select item_id, count(*)::double as score from edges group by 1) select bundle_id, round(avg(score), 6) as mean_score from bundle_items join s using (item_id) group by 1")
def bundle_scores(spark, d):
    return rounded(sweeps.bundle_scores(models.popularity(tables.edges(spark, d)), tables.bundle_items(spark, d)), 6)


# ---- statistics

_PRICED_SQL = EDGES_SQL + ", pop as (select item_id, count(*) as owners, avg(playtime_forever) as mean_score from edges group by 1), nu as (select count(distinct user_id) as n from edges), priced as (select item_id, mean_score, p_retailprice as price, owners / n::double as obs_rate, owners from pop join part on p_partkey = item_id cross join nu)"


def _priced(spark, d) -> DataFrame:
    edges = tables.edges(spark, d)
    users = edges.agg(F.countDistinct("user_id").alias("_n"))
    pop = edges.groupBy("item_id").agg(F.count("*").alias("owners"), F.avg("playtime_forever").alias("mean_score"))
    out = pop.join(tables.items(spark, d).select("item_id", "price"), "item_id").crossJoin(F.broadcast(users))
    return out.select("item_id", "mean_score", "price", (F.col("owners") / F.col("_n")).alias("obs_rate"), "owners")


def _one(spark, **values) -> DataFrame:
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'long' if isinstance(values[n], int) and not isinstance(values[n], bool) else 'boolean' if isinstance(values[n], bool) else 'double'}" for n in names))


@query(f"with {_PRICED_SQL} select round(corr(rp, ro), 6) as spearman, count(*) as pairs from (select (rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0)::double as rp, (rank() over (order by owners) + (count(*) over (partition by owners) - 1) / 2.0)::double as ro from priced)")
def spearman_price_popularity(spark, d):
    return rounded(statistics.spearman(_priced(spark, d), "price", "owners"), 6)


@query(f"with {_PRICED_SQL}, z as (select price, mean_score, ln(r / (1 - r)) as z from (select *, least(greatest(obs_rate, 0.5 / n), 1 - 0.5 / n) as r from priced cross join nu)), m as (select covar_pop(z, price) as zp, covar_pop(z, mean_score) as zs, covar_pop(price, mean_score) as ps, var_pop(price) as pp, var_pop(mean_score) as ss, count(*) as n from z) select round((zp * ss - zs * ps) / (pp * ss - ps * ps), 6) as gamma_p, round((zs * pp - zp * ps) / (pp * ss - ps * ps), 6) as gamma_s, (zp * ss - zs * ps) / (pp * ss - ps * ps) < 0 as valid, n as n_games from m")
def logit_calibration(spark, d):
    rows = _priced(spark, d)
    users = tables.edges(spark, d).select("user_id").distinct().count()
    fit = statistics.aggregate_calibration(rows, users, "logit")
    return rounded(_one(spark, gamma_p=fit["gamma"][2], gamma_s=fit["gamma"][1], valid=bool(fit["valid"]), n_games=fit["n_games"]), 6)


@query(f"with {_PRICED_SQL}, x as (select p.item_id, p.price, e.playtime_forever as s, (1 - obs_rate) * (count(*) over (partition by p.item_id) - 1) as h, row_number() over (partition by p.item_id order by e.playtime_forever) as k from priced p join edges e on e.item_id = p.item_id), q as (select item_id, price, max(s) filter (k = floor(h) + 1) as a, max(s) filter (k = floor(h) + 2) as b, max(h) as h from x group by 1, 2) select item_id, round(a + (coalesce(b, a) - a) * (h - floor(h)), 6) as quantile from q")
def censoring_quantiles(spark, d):
    scores = tables.edges(spark, d).select("item_id", F.col("playtime_forever").alias("score"))
    return rounded(statistics.group_quantiles(scores, _priced(spark, d).select("item_id", F.col("obs_rate").alias("rate"))), 6)


@query(f"with {_PRICED_SQL} select round(regr_intercept(price, mean_score), 4) as a, round(regr_slope(price, mean_score), 6) as b, round(regr_r2(price, mean_score), 6) as r2, case when regr_slope(price, mean_score) > 0 then round(sqrt(regr_syy(price, mean_score) * (1 - regr_r2(price, mean_score)) / (count(*) - 2)), 4) end as sigma, regr_slope(price, mean_score) > 0 as valid, count(*) as n_games from priced")
def quantile_anchor(spark, d):
    out = statistics.quantile_calibration(_priced(spark, d).select("price", F.col("mean_score").alias("quantile")))
    return out.select(F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), F.round("r2", 6).alias("r2"), F.round("sigma", 4).alias("sigma"), "valid", "n_games")


@query(f"with {_PRICED_SQL} select round(median(price) - stddev_pop(price) / stddev_pop(mean_score) * median(mean_score), 4) as a, round(stddev_pop(price) / stddev_pop(mean_score), 6) as b, round(stddev_pop(price), 4) as sigma from priced")
def normalisation(spark, d):
    out = statistics.normalised_calibration(_priced(spark, d))
    return out.select(F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), F.round("sigma", 4).alias("sigma"))


_VALUED_SQL = (
    _PRICED_SQL + ", line as (select median(price) - stddev_pop(price) / stddev_pop(mean_score) * median(mean_score) as a, stddev_pop(price) / stddev_pop(mean_score) as b from priced), "
    "valued as (select user_id, item_id, greatest(a + b * playtime_forever, 0) as v from edges cross join line), "
    "ranked as (select user_id, item_id, v, row_number() over w as size, sum(v) over (w rows unbounded preceding) as w from valued window w as (partition by user_id order by v desc, item_id)), "
    "sums as (select user_id, size, w from ranked where size in (" + ", ".join(map(str, tables.SIZES)) + "))"
)


@query(_shrunk_sql(_VALUED_SQL))
def calibrated_moments(spark, d):
    """From scores to moments: the scale set to prices, values of users' items, their top sums, and the shrunk covariance of these."""
    line = statistics.normalised_calibration(_priced(spark, d))
    scores = tables.edges(spark, d).select("user_id", "item_id", F.col("playtime_forever").alias("score"))
    return _shrunk(pricing.shrunk_moments(pricing.calibrated_panel(scores, line), tables.SIZES))


@query(f"with {_PRICED_SQL}, z as (select ln(1 + owners) as y, ln(price) as x from priced) select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 5) as intercept, round(regr_r2(y, x), 8) as r2, count(*) as n from z")
def ols_demand(spark, d):
    rows = _priced(spark, d).select(F.log1p("owners").alias("y"), F.log("price").alias("x"))
    fit = statistics.ols(rows, "y", ["x"])
    out = _one(spark, slope=float(fit["beta"][1]), intercept=float(fit["beta"][0]), r2=float(fit["r2"]), n=fit["n"])
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


@query()
def ols_robust(spark, d):
    """Coefficients with HC3 errors: tested against a dense computation."""
    rows = _priced(spark, d).select(F.log1p("owners").alias("y"), F.log("price").alias("log_price"), "mean_score")
    fit = statistics.ols(rows, "y", ["log_price", "mean_score"])
    data = [(n, float(b), float(s), float(t), float(p), float(lo), float(hi)) for n, b, s, t, p, lo, hi in zip(fit["names"], fit["beta"], fit["se"], fit["t"], fit["p"], fit["low"], fit["high"], strict=True)]
    return spark.createDataFrame(data, "term string, beta double, se double, t double, p double, low double, high double")


@query(f"with {PANEL_SQL} select item_id, round(skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) as skewness, round(avg(v), 6) as mean, count(*) as n from panel group by 1")
def panel_skewness(spark, d):
    return rounded(tables.panel(spark, d).groupBy("item_id").agg(F.skewness("v").alias("skewness"), F.avg("v").alias("mean"), F.count("*").alias("n")), 6)


# ---- text and sources


@query("with t as (select p_partkey as item_id, case p_size % 5 when 0 then '$' || p_retailprice::decimal(10, 2)::varchar when 1 then 'Free' when 2 then '' when 3 then 'N/A' else '-' || p_retailprice::decimal(10, 2)::varchar || ' USD' end as text, (p_size || '%') as rate from part) select item_id, case when trim(text) = '' or contains(lower(text), 'free') then 0 else try_cast(regexp_replace(text, '[^0-9.]', '', 'g') as double) end as price, case when try_cast(regexp_replace(rate, '[^0-9.]', '', 'g') as double) > 1 then try_cast(regexp_replace(rate, '[^0-9.]', '', 'g') as double) / 100 else try_cast(regexp_replace(rate, '[^0-9.]', '', 'g') as double) end as discount from t")
def parsed_prices(spark, d):
    part = tables.table(spark, d, "part")
    money = F.col("p_retailprice").cast("decimal(10,2)").cast("string")
    kind = F.col("p_size") % 5
    text = F.when(kind == 0, F.concat(F.lit("$"), money)).when(kind == 1, "Free").when(kind == 2, "").when(kind == 3, "N/A").otherwise(F.concat(F.lit("-"), money, F.lit(" USD")))
    return part.select(F.col("p_partkey").alias("item_id"), scalars.parse_price(text).alias("price"), scalars.parse_discount(F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("discount"))


@query()
def normalised_labels(spark, d):
    """Titles of pages as labels: entities resolved, NFKC, white space collapsed."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return tables.table(spark, d, "pages").select("page_id", scalars.normalized_label(title).alias("title"))


@query(f"with {EDGES_SQL} select user_id, count(*) as items, max(playtime_forever) as most from edges group by 1")
def literal_records(spark, d):
    """Libraries written as literal lines and read back by the parser."""
    from marquetry.sources import literal

    each = F.format_string("{'item_id': '%d', 'playtime_forever': %s, 'playtime_2weeks': None}", "item_id", F.col("playtime_forever").cast("string"))
    lines = tables.edges(spark, d).groupBy("user_id").agg(F.array_join(F.collect_list(each), ", ").alias("_i"))
    lines = lines.select(F.format_string("{u'user_id': u'%d', 'steam_id': None, 'items': [%s]}", "user_id", "_i").alias("value"))
    rows = interactions.flatten_libraries(literal.parse_literals(lines, literal.LIBRARY))
    return rows.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("items"), F.max("playtime_forever").alias("most"))


@query("select p_partkey as item_id, p_name, round(p_retailprice, 2) as price from part")
def csv_parts(spark, d):
    """Parts written as CSV with a header to the shared folder and read back under a schema."""
    from marquetry.sources import files

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name", F.round("p_retailprice", 2).alias("price")).write.option("header", True).csv(path)
    return files.read_csv(spark, path, "item_id long, p_name string, price double")


@query("select s_suppkey, s_name, s_nationkey from supplier")
def published_suppliers(spark, d):
    """Suppliers published with a manifest and loaded again, rows and digest checked."""
    from marquetry.sources import files

    folder = f"{shared_folder(spark)}/artefact-{uuid.uuid4().hex}"
    files.publish(spark, folder, {"suppliers": tables.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")})
    return files.load_published(spark, folder, "suppliers")


@query("select key, count(*) as rows from (select unnest(case when c_custkey % 3 = 0 then ['k', 'n'] when c_custkey % 3 = 1 then ['k', 'n', 'b'] else ['k'] end) as key from customer) group by 1")
def json_keys(spark, d):
    """Top-level keys of customers written as JSON of differing fields."""
    from marquetry.sources import files

    k = F.col("c_custkey")
    body = F.to_json(F.struct(k.alias("k"), F.when(k % 3 < 2, F.col("c_nationkey")).alias("n"), F.when(k % 3 == 1, F.col("c_acctbal")).alias("b")))
    return files.keys_of_json(tables.table(spark, d, "customer").select(body.alias("body")), "body")


@query(f"with {EDGES_SQL} select count(*) as records, 0::bigint as empty_records, sum(n)::bigint as raw_rows, sum(n)::bigint as edges, count(*) as users, (select count(distinct item_id) from edges) as items, 0::bigint as duplicate_excess from (select user_id, count(*) as n from edges group by 1)")
def library_diagnostics(spark, d):
    """Counts of nested library records made of the edges."""
    item = F.struct(F.col("item_id").cast("string").alias("item_id"), "playtime_forever", "playtime_2weeks")
    records = tables.edges(spark, d).groupBy("user_id").agg(F.collect_list(item).alias("items"))
    return interactions.source_diagnostics(records.select(F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("steam_id"), "items"))


_LOADED_SQL = f"""with t as (select {_BAD_USER} as u, {_BAD_ITEM} as i, l_quantity, l_extendedprice from orders join lineitem on o_orderkey = l_orderkey),
g as (select u::bigint as user_id, i::bigint as item_id, l_quantity, l_extendedprice from t where {_VALID.format("u")} and {_VALID.format("i")})
select user_id, item_id, max(l_quantity)::double as playtime_forever, max(l_extendedprice)::double as playtime_2weeks from g group by 1, 2"""


def _spoilt(spark, d) -> DataFrame:
    """Raw rows as text ids, some spoilt by rule."""
    rows = tables.raw(spark, d)
    key, u, i = F.col("l_orderkey"), F.col("user_id").cast("string"), F.col("item_id").cast("string")
    user = F.when((key % 97 == 0) & (F.col("l_linenumber") == 1), "").when(key % 89 == 0, F.concat(F.lit("0"), u)).when(key % 83 == 0, F.lit(None)).when(key % 61 == 0, F.concat(u, F.lit(".0"))).otherwise(u)
    item = F.when(key % 79 == 0, "").when(key % 73 == 0, F.concat(F.lit("x"), i)).when(key % 71 == 0, "9223372036854775808").otherwise(i)
    return rows.select(user.alias("user_id"), item.alias("item_id"), "playtime_forever", "playtime_2weeks")


@query(_LOADED_SQL)
def loaded_edges(spark, d):
    """Canonical edges of the rows whose ids are valid, from text with ids spoilt by rule."""
    return interactions.load_interactions(_spoilt(spark, d))[0]


def _scanned(spark, d) -> tuple[DataFrame, DataFrame]:
    """(edges, audit) of the spoilt rows written as CSV and read in one pass."""
    path = f"{shared_folder(spark)}/spoilt-{uuid.uuid4().hex}"
    _spoilt(spark, d).write.option("header", True).csv(path)
    return interactions.audited_scan(spark, path)


@query(_LOADED_SQL)
def scanned_edges(spark, d):
    """Edges of an audited scan of a CSV with spoilt ids."""
    return _scanned(spark, d)[0]


@query(_AUDIT_COUNTS_SQL)
def scan_audit(spark, d):
    """The audit that the same scan observes."""
    return _scanned(spark, d)[1]


@query(f"with {EDGES_SQL} select e.user_id, e.item_id, e.playtime_forever from edges e where user_id in (select c_custkey from customer where c_nationkey < 5) and item_id in (select p_partkey from part where p_size <= 10)")
def sliced_edges(spark, d):
    users = tables.table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    items = tables.table(spark, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("item_id"))
    return interactions.slice_edges(tables.edges(spark, d), users, items).select("user_id", "item_id", "playtime_forever")


@query(f"select c_custkey from customer order by {hash_sql('user-sample', id_sql('c_custkey'))}, c_custkey limit 100")
def hashed_customers(spark, d):
    """A seeded sample of 100 customers that does not depend on the order of rows."""
    return splits.hashed_sample(tables.table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


@query(f"with {_CHOICE_SQL}, r as (select coalesce(size, 0)::int as size from users u left join picks p on p.user_id = u.user_id) select size, count(*) as users, round(count(*) / (select count(*) from r)::double, 6) as share from r group by 1")
def choice_shares(spark, d):
    return rounded(pricing.choice_shares(tables.panel(spark, d), tables.MENU, tables.SIZES, tables.UNIT_COST), 6)


@query(f"with {PANEL_SQL}, price as (select item_id, median(v) as price from panel group by 1) select p.item_id, round(avg(1 / (1 + exp(-greatest(least((2 + 1.5 * v - price) / 3.0, 700), -700)))), 8) as rate from panel p join price using (item_id) group by 1")
def predicted_rates(spark, d):
    """Mean purchase chance of each event type at its median value as price, under a logit link."""
    panel = tables.panel(spark, d)
    prices = panel.groupBy("item_id").agg(F.median("v").alias("price"))
    return rounded(statistics.predicted_rates(panel.withColumnRenamed("v", "score"), prices, 2.0, 1.5, 3.0, "logit"))


@query(
    f"with {_PARAMETERS_SQL}, v as (select user_id, item_id, v as score from (select user_id, event_id as item_id, value as v from events where value is not null and user_id is not null)), "
    "par2 as (select min(score) as lo, quantile_cont(score, 0.05) as q05, quantile_cont(score, 0.25) as q25, quantile_cont(score, 0.5) as q50, quantile_cont(score, 0.75) as q75, quantile_cont(score, 0.95) as q95 from v), "
    "u as (select least(greatest((score - lo) / greatest(q95 - q05, 1e-6), 0), 1e6) as a, ln(1 + exp(least(greatest((score - q50) / greatest(q75 - q25, 1e-6), -40), 40))) as b, "
    "(rank() over (partition by user_id order by score) - 1 + 0.5::double * count(*) over (partition by user_id, score)) / count(*) over (partition by user_id) as c, "
    "least(greatest((score - avg(score) over (partition by user_id)) / greatest(stddev_pop(score) over (partition by user_id), 1e-6), 0), 100) as d from v cross join par2), "
    "l as (select 'global_shift' as scenario, a as x from u union all select 'softplus', b from u union all select 'midrank', c from u union all select 'zscore', d from u) "
    "select scenario, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as deviation, round(max(x), 6) as most, round(avg((x = 0)::int), 6) as share_zero from l group by 1"
)
def utility_diagnostics(spark, d):
    """Scenario diagnostics of event values as scores."""
    rows = tables.table(spark, d, "events").where("value is not null and user_id is not null")
    return rounded(orchestrate.freeze_utilities(rows.select("user_id", F.col("event_id").alias("item_id"), F.col("value").alias("score")))[1], 6)


@query(f"with {EDGES_SQL}, o as (select item_id, count(*) as owners from edges group by 1) select item_id, owners, p_retailprice as price from o join part on p_partkey = item_id where p_retailprice > 0 order by owners desc, item_id limit 8")
def top_priced_items(spark, d):
    """The eight priced items of most owners, ties to the smaller id."""
    owners = interactions.support(tables.edges(spark, d), "item_id", "owners")
    return owners.join(tables.items(spark, d).where("price > 0").select("item_id", "price"), "item_id").orderBy(F.desc("owners"), "item_id").limit(8)


@query(f"with {EDGES_SQL} select user_id, item_id, playtime_forever::float as value from edges")
def matrix_archive(spark, d):
    """Edges written as a matrix in compressed rows, in archives of whole rows, and read back."""
    from marquetry.sources import matrices

    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    digests = matrices.write_csr_parts(tables.edges(spark, d), path, "playtime_forever")
    return matrices.read_csr(spark, path, digests)


@query()
def menu_optimum(spark, d):
    """A size menu by differential evolution: prices and profit, at least that of the menu it starts from."""
    prices, profit = pricing.optimise_menu(tables.panel(spark, d), tables.SIZES, tables.UNIT_COST, start=tables.MENU)
    return spark.createDataFrame([(int(s), float(p), profit) for s, p in zip(tables.SIZES, prices, strict=True)], "size int, price double, profit double")


# ---- more of the evaluation


@query(f"with {_METRICS_SQL}, m as (select family, avg(ndcg_at_20) as a from metric_rows group by 1) select x.family, 1 as training_seed, round(x.a - y.a, 8) as difference from m x join m y on x.family = 'volume' and y.family = 'popularity'")
def seed_contrasts(spark, d):
    rows = saver(spark)(evaluate.both_families(evaluate.prepare(spark, d)))
    return rounded(orchestrate.seed_contrasts(rows.where("family = 'volume'").withColumn("training_seed", F.lit(1)), rows.where("family = 'popularity'")))


@query(
    f"with {_METRICS_SQL}, n as (select count(*) as n from warm_items), h as (select user_id, count(*) as hidden from hidden group by 1), "
    "c as (select m.*, n - coalesce(hidden, 0) as candidates from metric_rows m cross join n left join h on h.user_id = m.user_id) "
    "select family, user_id, (strictly_above + tied_block_size <= 10)::int as hit_at_10, (strictly_above + tied_block_size <= 20)::int as hit_at_20, "
    "round(case when candidates > 1 then (candidates - strictly_above - tied_block_size + (tied_block_size - 1) / 2.0::double) / (candidates - 1) end, 8) as auc from c"
)
def plain_rank_metrics(spark, d):
    """Hits and areas under the curve of every evaluable user's target."""
    ready = evaluate.prepare(spark, d)
    out = ranking.plain_metrics(evaluate.both_families(ready), candidate_counts(spark, d))
    return out.select("family", "user_id", "hit_at_10", "hit_at_20", F.round("auc", 8).alias("auc"))


_KIND_SQL = (
    f"{NESTED_SQL}, sup as (select item_id, count(*) as s from nested where role = 'training' group by 1), cold as (select item_id from sup where s between 10 and 24), "
    "kinds as (select p_type, count(*) as n from nested join part on p_partkey = item_id where role = 'training' and item_id not in (select item_id from cold) group by 1), "
    "cs as (select c.item_id, coalesce(n, 0)::double as score from cold c join part on p_partkey = c.item_id left join kinds k on k.p_type = part.p_type), "
    "own as (select n.user_id, n.item_id, score from nested n join cs on cs.item_id = n.item_id where role = 'training')"
)


@query(
    f"with {_KIND_SQL}, lv as (select score, count(*) as n from cs group by 1), "
    "w as (select o.user_id, o.item_id, o.score, coalesce(sum(l.n) filter (l.score > o.score), 0) as above, sum(l.n) filter (l.score = o.score) as tied from own o cross join lv l group by 1, 2, 3), "
    "x as (select a.user_id, a.item_id, count(*) filter (b.score > a.score) as above, count(*) filter (b.score = a.score) as tied from own a join own b on a.user_id = b.user_id and a.item_id <> b.item_id group by 1, 2) "
    "select w.user_id, w.item_id as target_item_id, (w.above - coalesce(x.above, 0))::bigint as strictly_above, (w.tied - coalesce(x.tied, 0))::bigint as tied_block_size from w left join x on x.user_id = w.user_id and x.item_id = w.item_id"
)
def pseudo_cold_targets(spark, d):
    """Every training edge of items with 10 to 24 of them, ranked among these by what the other items of their kind sell."""
    ready = evaluate.prepare(spark, d)
    cold = interactions.support(ready.trained, "item_id", "s").where("s between 10 and 24").select("item_id")
    kinds = tables.items(spark, d).select("item_id", "p_type")
    sold = ready.trained.join(cold, "item_id", "left_anti").join(kinds, "item_id").groupBy("p_type").agg(F.count("*").cast("double").alias("n"))
    scores = cold.join(kinds, "item_id").join(sold, "p_type", "left").select("item_id", F.coalesce("n", F.lit(0.0)).alias("score"))
    return orchestrate.pseudo_cold(ready, cold, scores).select("user_id", "target_item_id", "strictly_above", "tied_block_size")


_HIDDEN_COLD_SQL = (
    f"{_COHORT_SQL}, whole as (select user_id, item_id from nested where role in ('training', 'validation', 'test')), "
    "kept as (select distinct user_id from whole where item_id not in (select item_id from cohort)), "
    "owned as (select w.user_id, w.item_id, c.design_training_support as score from whole w join cohort c on c.item_id = w.item_id), "
    "cold_targets as (select o.* from owned o join kept k on k.user_id = o.user_id)"
)


@query(
    f"with {_HIDDEN_COLD_SQL}, level as (select design_training_support as score, count(*) as n from cohort group by 1), "
    "w as (select t.user_id, t.item_id, coalesce(sum(l.n) filter (l.score > t.score), 0) as above, sum(l.n) filter (l.score = t.score) as tied from cold_targets t cross join level l group by 1, 2), "
    "x as (select a.user_id, a.item_id, count(*) filter (b.score > a.score) as above, count(*) filter (b.score = a.score) as tied from cold_targets a join owned b on a.user_id = b.user_id and a.item_id <> b.item_id group by 1, 2) "
    "select w.user_id, w.item_id as target_item_id, (w.above - coalesce(x.above, 0))::bigint as strictly_above, (w.tied - coalesce(x.tied, 0))::bigint as tied_block_size from w left join x on x.user_id = w.user_id and x.item_id = w.item_id"
)
def hidden_cold_targets(spark, d):
    """Every edge, held-out ones included, of the cold cohort of users that own something else, ranked among it by popularity."""
    ready, cold = evaluate.prepare(spark, d), pseudo_cold_items(spark, d)
    _, targets, owned = orchestrate.hide_cold(ready, cold, saver(spark))
    return orchestrate.cold_popularity(ready, cold, targets, owned).select("user_id", "target_item_id", "strictly_above", "tied_block_size")


@query()
def content_only_cold_rank(spark, d):
    """Leaderboard rows of the cold cohort: popularity, and labels alone after a pairwise refit with 64 factors that never saw it."""
    ready, cold = evaluate.prepare(spark, d), saver(spark)(pseudo_cold_items(spark, d))
    labels = features.label_features(tables.items(spark, d))
    config = {"factors": 64, "ridge": 1e-4, "rate": 0.1, "epochs": 12}
    rows = orchestrate.pseudo_cold_refit(ready, cold, labels, config, [104_729], saver(spark))
    return evaluation.leaderboard(rows, "family", "training_seed").withColumnRenamed("users", "target_edges")


@query()
def contested_edge_split(spark, d):
    """The capacity-aware holdout where items are scarce: event types as items, each with room for a few users. Tested against the scan."""
    kinds = tables.table(spark, d, "events").select("event_type").distinct()
    numbers = splits.numbered(kinds, "event_type", "item_id")
    owned = tables.table(spark, d, "events").where("user_id is not null").join(F.broadcast(numbers), "event_type").select("user_id", "item_id").distinct()  # one row per event type
    supports = owned.groupBy("item_id").agg(F.count("*").alias("n"))
    least = supports.agg(F.min("n")).first()[0] or 0
    return splits.nested_split(owned, before=1, after=max(0, least - 40), required=3, save=saver(spark))


# ---- models


def _weighted(ready: evaluate.Prepared) -> DataFrame:
    return ready.trained.select("user_id", "item_id", scalars.observed_confidence(F.col("playtime_forever"), 20.0, 0.0, 1.0).alias("confidence"))


def _ranked(ready: evaluate.Prepared, users: DataFrame, items: DataFrame, family: str) -> DataFrame:
    """A leaderboard row of factors on the test targets."""
    counts = ranking.factor_tie_counts(users.withColumnRenamed("id", "user_id"), items, ready.targets, ready.hidden, k=0)
    return evaluation.leaderboard(ranking.tie_metrics(counts.drop("shown")).withColumn("family", F.lit(family)), "family")


@query()
def als_fit_rank(spark, d):
    """Implicit ALS on the training edges with 64 factors and 12 iterations, ranked on the test targets: a leaderboard row."""
    ready = evaluate.prepare(spark, d)
    users, items = models.fit_als(_weighted(ready), factors=64, ridge=0.05, iterations=12, save=saver(spark))
    return _ranked(ready, users, items.withColumnRenamed("id", "item_id"), "als")


def _shown_by_als(spark, d) -> tuple[evaluate.Prepared, DataFrame]:
    """What the evaluated users are shown in their first 20 places by the factors of `als_fit_rank`."""
    ready = evaluate.prepare(spark, d)
    users, items = models.fit_als(_weighted(ready), factors=64, ridge=0.05, iterations=12, save=saver(spark))
    asked = users.withColumnRenamed("id", "user_id").join(ready.targets.select("user_id"), "user_id", "left_semi")
    return ready, exposure.factor_exposure(asked, items.withColumnRenamed("id", "item_id"), ready.hidden, 20)


@query()
def als_coverage(spark, d):
    """Expected share of the warm catalogue that implicit ALS shows in first 20 places."""
    ready, shown = _shown_by_als(spark, d)
    return exposure.exposure_coverage(shown, ready.warm.count())


@query()
def als_concentration(spark, d):
    """Share of what implicit ALS shows in first 20 places that falls on the one percent of items most owned."""
    ready, shown = _shown_by_als(spark, d)
    return exposure.exposure_concentration(shown, interactions.top_share(evaluate.item_scores(ready, "popularity"), "score"))


_VECTORS_SQL = (
    "v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
    "scored as (select a.vec_id as user_id, b.vec_id as item_id, list_inner_product(a.v, b.v) as score from v a join v b on a.vec_id <> b.vec_id), "
    "placed as (select *, rank() over (partition by user_id order by score desc) as rk, count(*) over (partition by user_id, score) as c, count(*) over (partition by user_id) as n from scored), "
    "shown as (select user_id, item_id, least(1.0::double, (least(20, n) - (rk - 1)) / c::double) as inclusion from placed where rk <= 20)"
)


def _vectors(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, items and exclusions: every vector in whole steps of 1/256 (sums are exact) meets every other one."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = tables.table(spark, d, "embeddings").where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select("vec_id", F.transform(wide, lambda x: F.floor(x * 256).cast("float")).alias("vec"))
    return rows.withColumnRenamed("vec_id", "user_id"), rows.withColumnRenamed("vec_id", "item_id"), rows.select(F.col("vec_id").alias("user_id"), F.col("vec_id").alias("item_id"))


@query(
    f"with {_VECTORS_SQL} select user_id, max(n) as candidate_count, least(max(n), 20) as selected_count, arg_max(score, rk) as threshold, max(rk) - 1 as strictly_above, arg_max(c, rk) as tied_block_size, "
    "(least(max(n), 20) - (max(rk) - 1)) / arg_max(c, rk)::double as inclusion from placed where rk <= 20 group by user_id"
)
def factor_boundaries(spark, d):
    """Where the first 20 places of each vector end among the inner products with all others."""
    return exposure.top_k_boundaries(*_vectors(spark, d), 20)


@query(f"with {_VECTORS_SQL}, e as (select item_id, 1 - product(1 - inclusion) as shown from shown group by 1) select round(sum(shown), 6) as expected_items, round(sum(shown) / (select count(*) from v), 6) as coverage from e")
def factor_coverage(spark, d):
    """Expected share of vectors that stand in the first 20 places of some other one."""
    users, items, own = _vectors(spark, d)
    return rounded(exposure.exposure_coverage(exposure.factor_exposure(users, items, own, 20), items.count()), 6)


@query(
    f"with {_VECTORS_SQL}, longest as (select vec_id from v qualify row_number() over (order by list_inner_product(v, v) desc, vec_id) <= (select (count(*) + 99) // 100 from v)) "
    "select round(coalesce(sum(inclusion) filter (item_id in (select vec_id from longest)), 0) / sum(inclusion), 6) as concentration from shown"
)
def factor_concentration(spark, d):
    """Share of first 20 places that falls on the one percent of longest vectors."""
    users, items, own = _vectors(spark, d)
    longest = interactions.top_share(items.select("item_id", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("score")), "score")
    return rounded(exposure.exposure_concentration(exposure.factor_exposure(users, items, own, 20), longest), 6)


@query()
def als_fold_in(spark, d):
    """Assessment users folded in against frozen item factors: norms per user."""
    ready = evaluate.prepare(spark, d)
    _, items = models.fit_als(_weighted(ready), factors=32, ridge=0.05, iterations=12, save=saver(spark))
    new = tables.outer(spark, d).where("split = 'assessment'").select("user_id")
    fresh = tables.edges(spark, d).join(new, "user_id", "left_semi").select("user_id", "item_id", F.lit(21.0).alias("confidence"))
    return models.fold_in_als(fresh, items, save=saver(spark)).select(F.col("id").alias("user_id"), F.sqrt(scalars.dot(F.col("vec"), F.col("vec"))).alias("norm"))


@query()
def bpr_fit_rank(spark, d):
    """Pairwise ranking with 64 factors and 12 epochs, ranked on the test targets: a leaderboard row."""
    ready = evaluate.prepare(spark, d)
    return _ranked(ready, *models.fit_bpr(ready.trained, save=saver(spark)), "bpr")


@query()
def bpr_genre_fit_rank(spark, d):
    """The same with the labels of items as features."""
    ready = evaluate.prepare(spark, d)
    labels = features.label_features(tables.items(spark, d))
    return _ranked(ready, *models.fit_bpr(ready.trained, labels, save=saver(spark)), "bpr_genre")


@query()
def bpr_fold_in(spark, d):
    """Assessment users folded in against frozen pairwise item factors: norms per user."""
    ready = evaluate.prepare(spark, d)
    _, items = models.fit_bpr(ready.trained, factors=32, save=saver(spark))
    new = tables.outer(spark, d).where("split = 'assessment'").select("user_id")
    folded = models.fold_in_bpr_users(tables.edges(spark, d).join(new, "user_id", "left_semi"), items)
    return folded.select(F.col("id").alias("user_id"), F.sqrt(scalars.dot(F.col("vec"), F.col("vec"))).alias("norm"))


@query()
def bootstrap_interval(spark, d):
    """Paired interval of NDCG@20 of volume against popularity over evaluable users."""
    return _one(spark, **evaluation.bootstrap_users(paired_metric_diff(spark, d)))


@query()
def poisson_bootstrap(spark, d):
    """The distributed bootstrap: 200 replicate means without collecting users."""
    return evaluation.poisson_bootstrap(paired_metric_diff(spark, d))


@query()
def svd_values(spark, d):
    """Leading singular values of the training matrix."""
    values, _, _ = models.truncated_svd(_weighted(evaluate.prepare(spark, d)), 4, rounds=12, save=saver(spark))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "position int, value double")


@query()
def nmf_losses(spark, d):
    """The squared error of eight non-negative factors of the training matrix after each of ten rounds."""
    losses: list[float] = []
    models.fit_nmf_edges(_weighted(evaluate.prepare(spark, d)), 8, rounds=10, save=saver(spark), losses=losses)
    return spark.createDataFrame(list(enumerate(losses, 1)), "round int, loss double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
