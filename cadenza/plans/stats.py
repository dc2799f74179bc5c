"""Queries over rank statistics, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import evaluate, stats


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def avg_tie_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_ranks(events(spark, sf_dir), ["event_type"], "k", "rank_k").select("event_id", "event_type", "rank_k")


def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlate(events(spark, sf_dir), ["event_type"], "value", "k").select("event_type", "n", F.round("r", 6).alias("r"))


def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(events(spark, sf_dir), ["event_type"], "value", "k").select("event_type", "n", F.round("rho", 6).alias("rho"))


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of Spearman's rho over 2,000 resamples of the users."""
    return stats.cluster_bootstrap(events(spark, sf_dir), "value", "k", "user_id", evaluate.REPLICATES).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


EV = "ev as (select event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k')::double as k from events)"


def ranked(source: str, by: str, extra: str = "") -> str:
    rank = lambda c: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0::double"
    return f"select *{extra}, ({rank('x')})::double as rx, ({rank('y')})::double as ry from {source}"


def corr_sql(source: str, by: str, x: str, y: str, out: str, count: str = ", count(*) as n") -> str:
    return f"""select {by}{count}, round(case when count(*) < 2 or sqrt(sum(dx * dx) * sum(dy * dy)) < 1e-15 then 0.0::double
  else sum(dx * dy) / sqrt(sum(dx * dx) * sum(dy * dy)) end, 6) as {out}
from (select {by}, {x} - avg({x}) over (partition by {by}) as dx, {y} - avg({y}) over (partition by {by}) as dy from {source}) group by {by}"""


QUERIES = {f.__name__: f for f in (avg_tie_ranks, pearson_by_group, spearman_by_group, cluster_bootstrap_ci)}
ORACLE = {
    "avg_tie_ranks": f"with {EV} select event_id, event_type, (rank() over (partition by event_type order by k) + (count(*) over (partition by event_type, k) - 1) / 2.0::double)::double as rank_k from ev",
    "pearson_by_group": f"with {EV} {corr_sql('ev', 'event_type', 'value', 'k', 'r')}",
    "spearman_by_group": f"with {EV}, xy as (select event_type, value as x, k as y from ev), rk as ({ranked('xy', 'event_type')}) {corr_sql('rk', 'event_type', 'rx', 'ry', 'rho')}",
    "cluster_bootstrap_ci": f"""with {EV}, c as (select user_id, row_number() over (order by user_id) - 1 as g, count(*) over () as total from (select distinct user_id from ev)),
d as (select b, ('0x' || substr(md5('42:' || b || ':' || g), 1, 8))::bigint % total as g from c, range({evaluate.REPLICATES}) t(b)),
xy as (select d.b, ev.value as x, ev.k as y from d join c on d.g = c.g join ev on ev.user_id = c.user_id),
rk as ({ranked('xy', 'b')}), r as ({corr_sql('rk', 'b', 'rx', 'ry', 'rho', '').replace(', 6) as', ', 15) as')}),
s as (select list_sort(list(rho)) as l, count(*) - 1 as n from r)
select round(l[round(0.025 * n)::int + 1], 6) as lo, round(l[round(0.975 * n)::int + 1], 6) as hi from s""",
}
