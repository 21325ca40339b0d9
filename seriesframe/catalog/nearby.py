"""Joins on the nearest time and within a tolerance."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import E_SERIES, r, registry, rounded
from seriesframe.operators import nearest
from seriesframe.plans.sheets import series_events, table

QUERIES, SQL, register = registry()


def _kinds(spark, folder):
    e = series_events(spark, folder).withColumn("bay", F.col("user_id") % 7)
    buys = e.where("series = 'purchase'").select("bay", "ts", "event_id", "value")
    views = e.where("series = 'view'").select("bay", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return buys, views


@register(
    "join_nearest",
    f"""with {E_SERIES}, b as (select user_id % 7 as bay, ts, event_id, value from e where series = 'purchase'),
    v as (select user_id % 7 as bay, ts, event_id as view_id, value as view_value from e where series = 'view'
      qualify row_number() over (partition by user_id % 7, ts order by event_id) = 1),
    lo as (select b.*, v.ts as ts0, v.view_id as id0, v.view_value as v0 from b asof left join v on b.bay = v.bay and b.ts >= v.ts),
    hi as (select b.event_id, v.ts as ts1, v.view_id as id1, v.view_value as v1 from b asof left join v on b.bay = v.bay and b.ts < v.ts),
    d as (select *, epoch_us(ts) - epoch_us(ts0) as d0, epoch_us(ts1) - epoch_us(ts) as d1 from lo join hi using (event_id)),
    k as (select *, d1 is null or d0 <= d1 as early, least(d0, d1) as off from d)
    select bay, ts, event_id, {r('value')} as value, case when off <= 3600000000 then case when early then ts0 else ts1 end end as ts_matched,
      {r('case when off <= 3600000000 then off / 1000000.0e0 end')} as distance,
      case when off <= 3600000000 then case when early then id0 else id1 end end as view_id,
      case when off <= 3600000000 then {r('case when early then v0 else v1 end')} end as view_value from k""",
)
def join_nearest(spark, folder):
    buys, views = _kinds(spark, folder)
    out = nearest.join_nearest(buys, views, "ts", ["bay"], tolerance=3600, order=["view_id"])
    return rounded(out)


@register(
    "join_within",
    f"""select c_custkey, s_suppkey, c_nationkey, {r('c_acctbal', 2)} as c_acctbal, {r('s_acctbal', 2)} as s_acctbal, {r('c_acctbal - s_acctbal', 4)} as distance
    from customer join supplier on c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) <= 25.0""",
)
def join_within(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey"), "c_acctbal")
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    return rounded(nearest.join_within(c, s, ("c_acctbal", "s_acctbal"), 25.0, ["c_nationkey"]), 4, c_acctbal=2, s_acctbal=2)
