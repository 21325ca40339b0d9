"""Grouped summaries, data checks and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import EV_BASE, SPEC, grid_sql, r, registry, rounded
from seriesframe.functions import semantics as sem, times
from seriesframe.operators import relate, summarise as op
from seriesframe.operators.grid import densify
from seriesframe.operators.median import grouped_median
from seriesframe.plans.sheets import IDS, event_base, series_events, specimen_sheet, table
from seriesframe.sources.files import settle

QUERIES, SQL, register = registry()


@register(
    "fanout_safe_sum",
    f"""select cast(o_orderdate as date) as date, {r('sum(o_totalprice)', 2)} as total from (
      select distinct o_orderdate, o_orderkey, o_totalprice from orders left join lineitem on o_orderkey = l_orderkey)
    group by 1""",
)
def fanout_safe_sum(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    fanned = relate.join_fan_out(o, lines, ["o_orderkey"], null_safe=True)
    return rounded(op.event_sum(fanned, "o_orderkey", "o_totalprice", ["date"], "total"), 2)


@register(
    "group_stats",
    f"""select o_orderstatus as gear, o_orderpriority as bay, count(*) as n, count(distinct o_custkey) as n_cust,
    {r('sum(o_totalprice)', 2)} as total, {r('avg(o_totalprice)', 4)} as mean, {r('stddev_samp(o_totalprice)', 4)} as sd,
    min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1, 2""",
)
def group_stats(spark, folder):
    o = table(spark, folder, "orders").withColumnsRenamed({"o_orderstatus": "gear", "o_orderpriority": "bay"})
    x = "o_totalprice"
    out = op.summarise(
        o, ["gear", "bay"], n=F.count(F.lit(1)), n_cust=sem.n_distinct("o_custkey"), total=F.sum(x),
        mean=F.avg(x), sd=F.stddev_samp(x), low=F.min(x), high=F.max(x),
    )
    return rounded(out, 4, total=2)


@register(
    "length_table",
    f"""with {EV_BASE}, {SPEC} select gear, depth_ft, l_linestatus as status,
      count(distinct (event, l_partkey, l_linenumber)) as total, {r('avg(length)', 4)} as mean, {r('stddev_samp(length)', 4)} as sd,
      min(length) as low, max(length) as high from sp join ev_base using (event) group by 1, 2, 3""",
)
def length_table(spark, folder):
    sheet = event_base(spark, folder).select("event", "gear", "depth_ft")
    # The null-safe key is not the plain column, so the grouping below shuffles anew and a hot event
    # may be split in the join.
    fish = relate.join_keep_left(specimen_sheet(spark, folder), sheet, ["event"], "inner", null_safe=True)
    out = op.summarise(
        fish.withColumnRenamed("l_linestatus", "status"), ["gear", "depth_ft", "status"],
        total=sem.n_distinct("event", *IDS), mean=F.avg("length"), sd=F.stddev_samp("length"),
        low=F.min("length"), high=F.max("length"),
    )
    return rounded(out, 4)


@register(
    "length_by_category",
    f"""select l_partkey as category, count(*) as n, {r('avg(l_quantity)', 4)} as mean, {r('stddev_samp(l_quantity)', 4)} as sd
    from lineitem group by 1 having count(*) > 20""",
)
def length_by_category(spark, folder):
    fish = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "category")
    out = op.summarise(
        fish, ["category"], n=F.count(F.lit(1)), mean=F.avg("l_quantity"), sd=F.stddev_samp("l_quantity")
    )
    # Categories with too few specimens are no basis for a comparison of lengths.
    return rounded(out.where("n > 20"), 4)


@register(
    "na_strict_agg",
    f"""with {grid_sql()} select series, cast(t as date) as date,
      case when count(*) = count(value) then {r('avg(value)')} end as strict_mean, {r('avg(value)')} as mean,
      case when count(*) = count(value) then {r('sum(value)', 4)} end as strict_sum,
      count(distinct n) + max(case when n is null then 1 else 0 end) as n_kinds
    from g group by 1, 2""",
)
def na_strict_agg(spark, folder):
    e = series_events(spark, folder)
    g = densify(e, "ts", 600, ["series"], [F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")], reuse=False)
    out = g.groupBy("series", F.to_date("t").alias("date")).agg(
        sem.aggregate(F.avg, "value", na_rm=False).alias("strict_mean"),
        sem.aggregate(F.avg, "value").alias("mean"),
        sem.aggregate(F.sum, "value", na_rm=False).alias("strict_sum"),
        sem.n_distinct("n", count_null=True).alias("n_kinds"),
    )
    return rounded(out, strict_sum=4)


@register(
    "regroup_two_level",
    f"""with {EV_BASE}, {SPEC}, a as (
      select category, date, event, sum(length) as total, avg(velocity) as v
      from sp join ev_base using (event) group by 1, 2, 3)
    select category, date, {r('sum(total)', 2)} as total, {r('avg(total)', 7)} as mean_total, {r('avg(v)', 8)} as mean_v,
      count(*) as n_events from a group by 1, 2""",
)
def regroup_two_level(spark, folder):
    days = event_base(spark, folder).select("event", "date")
    per_event = specimen_sheet(spark, folder).groupBy("category", "event").agg(
        F.sum("length").alias("total"), F.avg("velocity").alias("v")
    )
    out = relate.join_keep_left(per_event, days, ["event"], "inner").groupBy("category", "date").agg(
        F.sum("total").alias("total"),
        F.avg("total").alias("mean_total"),
        F.avg("v").alias("mean_v"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return rounded(out, 7, total=2, mean_v=8)


@register(
    "env_daily_summary",
    f"""select cast(o_orderdate as date) as date, {r('avg(c_acctbal)', 7)} as mean_temp,
    {r('avg(c_nationkey * 2.54e0)', 7)} as clarity_cm, {r('sum(o_totalprice)', 2)} as total, count(*) as n
    from orders left join customer on o_custkey = c_custkey group by 1""",
)
def env_daily_summary(spark, folder):
    c = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    env = relate.join_keep_left(table(spark, folder, "orders"), c, ["o_custkey"])
    out = env.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.avg("c_acctbal").alias("mean_temp"),
        (F.avg(F.col("c_nationkey") * 2.54)).alias("clarity_cm"),
        F.sum("o_totalprice").alias("total"),
        F.count(F.lit(1)).alias("n"),
    )
    return rounded(out, 7, total=2)


_HALF_HOUR = "strftime(make_timestamp(cast(floor((epoch_us(ts) + 900000000) / 1800000000.0) as bigint) * 1800000000), '%H:%M:%S')"


@register(
    "timeslot_stats",
    f"""select series, slot, {r('med')} as med, {r('mean')} as mean, {r('sd')} as sd, {r('mean - sd')} as low,
      {r('mean + sd')} as high, n from (
      select event_type as series, {_HALF_HOUR} as slot, median(value) as med, avg(value) as mean,
        stddev_samp(value) as sd, count(*) as n from events group by 1, 2)""",
)
def timeslot_stats(spark, folder):
    e = series_events(spark, folder).withColumn("slot", times.clock_text(times.round_to("ts", 1800)))
    keys = ["series", "slot"]
    stats = e.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n")
    )
    out = relate.join_keep_left(stats, grouped_median(e, keys, "value", "med"), keys, null_safe=True)
    return rounded(out.withColumns({"low": F.col("mean") - F.col("sd"), "high": F.col("mean") + F.col("sd")}))


@register(
    "histogram_by_slot",
    f"""select hour(ts)::int as hour, event_type as series, case when value < 0 then 0 when value >= 500 then 26
      else cast(floor(value / 20) as bigint) + 1 end as bin, count(*) as n from events group by 1, 2, 3""",
)
def histogram_by_slot(spark, folder):
    e = series_events(spark, folder).withColumn("hour", F.hour("ts"))
    return op.slot_histogram(e, ["hour", "series"], "value", 0, 500, 25)


@register(
    "duplicate_keys",
    """select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1""",
)
def duplicate_keys(spark, folder):
    return op.repeated(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "duplicate_flags",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      row_number() over (partition by k, l_suppkey order by l_partkey nulls first, l_orderkey, l_linenumber) > 1 as dup_later,
      count(*) over (partition by k, l_suppkey) > 1 as dup_any
    from (select *, nullif(l_orderkey % 1000, 7) as k from (
      select * replace (nullif(l_partkey, 3) as l_partkey) from lineitem union all select * from lineitem where l_linenumber = 1))""",
)
def duplicate_flags(spark, folder):
    # Some rows twice, some without a key or an order value, as field sheets have them.
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    holes = rows.withColumn("l_partkey", F.nullif("l_partkey", F.lit(3)))
    both = holes.unionByName(rows.where("l_linenumber = 1")).withColumn("k", F.nullif(F.col("l_orderkey") % 1000, F.lit(7)))
    return op.duplicate_flags(both, ["k", "l_suppkey"], ["l_partkey", "l_orderkey", "l_linenumber"]).drop("k")


@register(
    "distinct_values",
    "select distinct l_returnflag as category, l_linestatus as status, cast(l_shipdate as date) as date from lineitem",
)
def distinct_values(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("date")
    ).distinct()


@register(
    "first_last_seen",
    """select l_suppkey, cast(min(l_shipdate) as date) as first_date, cast(max(l_shipdate) as date) as last_date
    from lineitem group by 1""",
)
def first_last_seen(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.to_date(F.min("l_shipdate")).alias("first_date"), F.to_date(F.max("l_shipdate")).alias("last_date")
    )


@register(
    "dedupe_keep_best",
    """select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (select *, row_number() over (
      partition by l_orderkey order by l_extendedprice desc nulls last, l_linenumber nulls last, l_partkey nulls last) as rn
      from lineitem) where rn = 1""",
)
def dedupe_keep_best(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return op.keep_best(rows, ["l_orderkey"], [("l_extendedprice", True), ("l_linenumber", False), ("l_partkey", False)])


@register(
    "group_argmax_ties",
    """select user_id, date, n from (select *, rank() over (partition by user_id order by n desc) as rk from (
      select user_id, cast(ts as date) as date, count(*) as n from events group by 1, 2)) where rk = 1""",
)
def group_argmax_ties(spark, folder):
    daily = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return op.argmax_rows(daily, ["user_id"], "n")


@register(
    "having_topk",
    f"""with revenue as (select p_brand, l_returnflag, l_quantity, l_extendedprice * (1 - l_discount) as x
      from lineitem join part on l_partkey = p_partkey),
    top as (select p_brand, sum(x) as total from revenue group by 1 having sum(x) > 19 order by total desc, p_brand limit 5)
    select p_brand, l_returnflag as category, count(*) as n, {r('sum(l_quantity)', 2)} as qty
    from revenue where p_brand in (select p_brand from top) group by 1, 2""",
)
def having_topk(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_returnflag", "category")
    rev = relate.join_keep_left(lines, part, ["l_partkey"], "inner")
    # Lines are joined and summed once; brands are ranked from the sums.
    sums = rev.groupBy("p_brand", "category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"),
    )
    sums = settle(sums, "sums")
    # The list of winners has k rows, so it is broadcast.
    top = F.broadcast(op.top_categories(sums, "p_brand", "x", 5, above=19).select("p_brand"))
    return rounded(relate.join_keep_left(sums, top, ["p_brand"], "left_semi").drop("x"), 2)


@register(
    "ordered_category",
    f"""select bay, case bay when '3-MEDIUM' then 1 when '1-URGENT' then 2 when '5-LOW' then 3 else 4 end as position,
      cast(rank() over (order by m) as int) as by_mean, {r('m', 4)} as mean from (
      select o_orderpriority as bay, avg(o_totalprice) as m from orders group by 1)""",
)
def ordered_category(spark, folder):
    means = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("bay")).agg(F.avg("o_totalprice").alias("mean"))
    # Several branches read the means, which need not add up to the same last digit twice.
    ranked = op.rank_rows(settle(means, "means"), "mean", "by_mean").withColumn("by_mean", F.col("by_mean").cast("int"))
    out = op.category_order(ranked, ["3-MEDIUM", "1-URGENT", "5-LOW"], "bay")
    return rounded(out.select("bay", "position", "by_mean", "mean"), 4)
