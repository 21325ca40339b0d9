"""Joins, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import E_SERIES, grid_sql, r, registry, rounded
from seriesframe.functions.times import add_seconds, slot_start, trunc_to
from seriesframe.operators import clean, relate, reshape
from seriesframe.operators.grid import densify, densify_filled, grid_spine
from seriesframe.operators.intervals import resolve_overlaps as repair
from seriesframe.operators.models import model_terms as fold_terms
from seriesframe.operators.running import zero_fill
from seriesframe.plans.sheets import series_events, table
from seriesframe.sources.files import settle
from seriesframe.sources.spines import day_spine, one_value

QUERIES, SQL, register = registry()
# The series of the test tables, for the SQL alone: it cannot take column names from the data.
SERIES = ["click", "error", "purchase", "signup", "view"]


@register(
    "star_join_keep_left",
    """select o_orderkey, o_custkey, c_mktsegment, n_name, l_partkey, l_linenumber, l_quantity
    from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
    left join lineitem on o_orderkey = l_orderkey""",
)
def star_join_keep_left(spark, folder):
    customer = table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "o_custkey", "c_nationkey": "nation"})
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "nation")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    env = relate.join_keep_left(relate.join_keep_left(table(spark, folder, "orders"), customer, ["o_custkey"]), nation, ["nation"])
    events = env.select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")
    return relate.join_fan_out(events, lines.select("o_orderkey", "l_partkey", "l_linenumber", "l_quantity"), ["o_orderkey"])


@register(
    "left_join_multi",
    f"""select a.l_orderkey as event, a.l_returnflag as category, n, {r('qty', 2)} as qty, mean_tax
    from (select l_orderkey, l_returnflag, count(*) as n, sum(l_quantity) as qty from lineitem group by 1, 2) a
    left join (select l_orderkey, l_returnflag, {r('avg(l_tax)')} as mean_tax from lineitem
      where l_linestatus = 'F' group by 1, 2) b
    on a.l_orderkey = b.l_orderkey and a.l_returnflag = b.l_returnflag""",
)
def left_join_multi(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnsRenamed({"l_orderkey": "event", "l_returnflag": "category"})
    keys = ["event", "category"]
    a = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    b = lines.where(F.col("l_linestatus") == "F").groupBy(*keys).agg(F.avg("l_tax").alias("mean_tax"))
    return rounded(relate.join_keep_left(a, b, keys), qty=2)


@register(
    "full_outer_join",
    f"""with {E_SERIES}, h as (select nullif(series, 'error') as series, date_trunc('hour', ts) as hour, user_id, value from e),
    a as (select series, hour, count(*) as n_a, sum(value) as v from h where user_id < 60 group by 1, 2),
    b as (select series, hour, count(*) as n_b, sum(value) as w from h where user_id >= 60 group by 1, 2)
    select coalesce(a.series, b.series) as series, coalesce(a.hour, b.hour) as hour, n_a, {r('v', 2)} as v, n_b,
      {r('w', 2)} as w
    from a full join b on a.series is not distinct from b.series and a.hour is not distinct from b.hour""",
)
def full_outer_join(spark, folder):
    e = series_events(spark, folder).select(
        F.nullif("series", F.lit("error")).alias("series"),
        trunc_to("ts", 3600).alias("hour"),
        "user_id",
        "value",
    )
    keys = ["series", "hour"]
    a = e.where("user_id < 60").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"), F.sum("value").alias("v"))
    b = e.where("user_id >= 60").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"), F.sum("value").alias("w"))
    return rounded(relate.join_full(a, b, keys), 2)


@register(
    "inner_join_time_key",
    f"""select c.event_id, date_trunc('minute', c.ts) as slot, c.value, gauge
    from events c join (select date_trunc('minute', ts) as m, {r('avg(value)')} as gauge from events
      where event_type = 'view' group by 1) v on date_trunc('minute', c.ts) = m
    where c.event_type = 'click'""",
)
def inner_join_time_key(spark, folder):
    e = series_events(spark, folder)
    clicks = e.where("series = 'click'").select("event_id", "ts", "value")
    minute = trunc_to("ts", 60).alias("ts")
    gauge = e.where("series = 'view'").groupBy(minute).agg(F.avg("value").alias("gauge"))
    return rounded(relate.join_on_slot(clicks, gauge, "ts", "minute"))


@register(
    "stack_segments",
    """select event_id, event_type, ts, value from events where ts <= timestamp '2024-01-12 23:59:59'
    union select event_id, event_type, ts, value from events
      where ts between timestamp '2024-01-12 00:00:00' and timestamp '2024-01-20 23:59:59'
    union select event_id, event_type, ts, value from events where ts >= timestamp '2024-01-20 00:00:00'""",
)
def stack_segments(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    edges = [
        ("1970-01-01 00:00:00", "2024-01-12 23:59:59"),
        ("2024-01-12 00:00:00", "2024-01-20 23:59:59"),
        ("2024-01-20 00:00:00", "9999-12-31 00:00:00"),
    ]
    return relate.stack([clean.time_range(e, "ts", lo, hi) for lo, hi in edges])


@register(
    "model_terms",
    f"""select t.term,
      case t.term when '(intercept)' then {r('regr_intercept(l_extendedprice, l_quantity)')}
        when 'qty' then {r('regr_slope(l_extendedprice, l_quantity)')} end as est_qty,
      case t.term when '(intercept)' then {r('regr_intercept(l_extendedprice, l_discount)')}
        when 'disc' then {r('regr_slope(l_extendedprice, l_discount)')} end as est_disc,
      case t.term when '(intercept)' then {r('regr_intercept(l_extendedprice, ln(l_quantity))')}
        when 'ln_qty' then {r('regr_slope(l_extendedprice, ln(l_quantity))')} end as est_ln_qty
    from lineitem, (values ('(intercept)'), ('qty'), ('disc'), ('ln_qty')) t(term) group by t.term""",
)
def model_terms(spark, folder):
    xs = {"qty": F.col("l_quantity"), "disc": F.col("l_discount"), "ln_qty": F.log("l_quantity")}
    return fold_terms(table(spark, folder, "lineitem"), "l_extendedprice", xs, digits=6)


@register(
    "join_full_many",
    """select coalesce(a.k, b.k, c.k) as k, n_orders, n_lines, balance
    from (select o_custkey % 700 as k, count(*) as n_orders from orders group by 1) a
    full join (select l_suppkey * 9 as k, count(*) as n_lines from lineitem group by 1) b on a.k = b.k
    full join (select c_custkey as k, round(c_acctbal, 2) as balance from customer) c on coalesce(a.k, b.k) = c.k""",
)
def join_full_many(spark, folder):
    a = table(spark, folder, "orders").groupBy((F.col("o_custkey") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") * 9).alias("k")).agg(F.count(F.lit(1)).alias("n_lines"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("balance"))
    return relate.join_full_many([a, b, c], ["k"])


@register(
    "missing_ids_in_bounds",
    """select o_orderkey from (select unnest(generate_series(1, 120000)) as o_orderkey)
    where o_orderkey not in (select o_orderkey from orders where o_orderkey is not null)""",
)
def missing_ids_in_bounds(spark, folder):
    return relate.missing_ids(table(spark, folder, "orders"), "o_orderkey", (1, 120000))


@register(
    "grid_densify",
    f"""with {grid_sql(3600)} select series, t, coalesce(n, 0) as n, {r('value')} as value from g""",
)
def grid_densify(spark, folder):
    e = series_events(spark, folder)
    out = densify(e, "ts", 3600, ["series"], [F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")], {"n": 0}, reuse=False)
    return rounded(out.select("series", "t", "n", "value"))


@register(
    "zero_fill_daily",
    f"""select user_id, cast(day as date) as date, coalesce(n, 0) as n, {r('coalesce(total, 0)', 2)} as total
    from (select user_id, unnest(generate_series((select min(date_trunc('day', ts)) from events),
      (select max(ts) from events), interval 1 day)) as day from (select distinct user_id from events))
    left join (select user_id, date_trunc('day', ts) as day, count(*) as n, sum(value) as total from events group by 1, 2)
      using (user_id, day)""",
)
def zero_fill_daily(spark, folder):
    e = series_events(spark, folder).withColumn("date", F.to_date("ts"))
    daily = settle(e.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "daily")
    lo, hi = one_value(daily, F.min("date")), one_value(daily, F.max("date"))
    season = daily.select("user_id").distinct().select("user_id", lo.alias("lo"), hi.alias("hi"))
    return rounded(zero_fill(daily, "date", ["n", "total"], day_spine(season, "lo", "hi"), ["user_id"]), 2)


_WIDE = ", ".join(f"{r(f'avg(value) filter (where series = {chr(39)}{s}{chr(39)})')} as {s}" for s in SERIES)


@register("pivot_bays", f"with {E_SERIES} select date_trunc('hour', ts) as hour, {_WIDE} from e group by 1")
def pivot_bays(spark, folder):
    e = series_events(spark, folder).withColumn("hour", trunc_to("ts", 3600))
    return rounded(reshape.to_wide(e, ["hour"], "series", F.avg("value")))


@register(
    "unpivot_bays",
    f"""with {E_SERIES}, w as (select date_trunc('hour', ts) as hour, {_WIDE} from e group by 1)
    select hour, series, value from w, (values {", ".join(f"('{s}')" for s in SERIES)}) k(s),
    lateral (select s as series, case s {" ".join(f"when '{s}' then {s}" for s in SERIES)} end as value)""",
)
def unpivot_bays(spark, folder):
    return reshape.to_long(pivot_bays(spark, folder), ["hour"], "series", "value")


@register(
    "catch_table_long",
    f"""with {E_SERIES}, w as (select date_trunc('hour', ts) as hour, series, {r('avg(value)')} as cpue from e group by 1, 2),
    c as (select series, cast(ts as date) as date, max(value) as top, count(*) as n_day from e group by 1, 2)
    select w.hour, w.series, w.cpue, c.top, c.n_day from w join c on c.series = w.series and c.date = cast(w.hour as date)
    where w.cpue is not null""",
)
def catch_table_long(spark, folder):
    e = series_events(spark, folder)
    covariates = e.groupBy("series", F.to_date("ts").alias("date")).agg(
        F.max("value").alias("top"), F.count(F.lit(1)).alias("n_day")
    )
    long = reshape.to_long(pivot_bays(spark, folder), ["hour"], "series", "cpue")
    joined = relate.join_keep_left(long.withColumn("date", F.to_date("hour")), covariates, ["series", "date"])
    return clean.drop_incomplete(joined).select("hour", "series", "cpue", "top", "n_day")


@register(
    "pad_by_group",
    """with e as (select user_id, date_trunc('hour', ts) as t, event_id, value from events)
    select user_id, t, event_id, value from (
      select user_id, unnest(generate_series(min(t), max(t), interval 1 hour)) as t from e group by 1)
    left join e using (user_id, t)""",
)
def pad_by_group(spark, folder):
    e = series_events(spark, folder).select("user_id", "event_id", "value", "ts")
    return reshape.pad(e, "ts", 3600, ["user_id"]).select("user_id", "t", "event_id", "value")


@register(
    "locf_fill",
    """with e as (select user_id, date_trunc('hour', ts) as t, max(event_id) as last_event, max(event_type) as kind
      from events group by 1, 2),
    p as (select user_id, t, last_event, kind from (
      select user_id, unnest(generate_series(min(t), max(t), interval 1 hour)) as t from e group by 1)
      left join e using (user_id, t))
    select user_id, t, last_value(last_event ignore nulls) over w as last_event,
      last_value(kind ignore nulls) over w as kind
    from p window w as (partition by user_id order by t rows between unbounded preceding and current row)""",
)
def locf_fill(spark, folder):
    e = series_events(spark, folder)
    aggs = [F.max("event_id").alias("last_event"), F.max("series").alias("kind")]
    filled = densify_filled(e, "ts", 3600, ["user_id"], aggs, ["last_event", "kind"])
    return filled.select("user_id", "t", "last_event", "kind")


_MINUTE_WIDE = ", ".join(f"max(value) filter (where series = '{s}') as {s}" for s in SERIES)


@register(
    "minute_grid",
    f"""with {E_SERIES}, m as (
      select series, value, unnest(generate_series(date_trunc('minute', ts),
        ts + to_minutes(cast(user_id % 20 + 5 as bigint)), interval 1 minute)) as t from e),
    w as (select t, {_MINUTE_WIDE} from m group by 1)
    select s.t, {", ".join(SERIES)} from (
      select unnest(generate_series(min(t), max(t), interval 1 minute)) as t from m) s left join w using (t)""",
)
def minute_grid(spark, folder):
    e = series_events(spark, folder)
    spans = e.withColumn("stop", add_seconds("ts", (F.col("user_id") % 20 + 5) * 60))
    cells = reshape.interval_grid(spans, "ts", "stop", 60, ["series", "value"])
    # One value per series and minute, then the pivot; the season spine keeps empty minutes.
    slots = settle(cells.groupBy("series", "slot").agg(F.max("value").alias("value")), "minutes")
    wide = reshape.to_wide(slots, ["slot"], "series", F.max("value"))
    out = relate.join_keep_left(grid_spine(slots, []), wide, ["slot"])
    return out.select(slot_start("slot", 60).alias("t"), *[c for c in out.columns if c != "slot"])


@register(
    "resolve_overlaps",
    # Interval by interval: each looks at where the one before it has ended.
    """with recursive i as (select user_id, event_id, epoch_us(date_trunc('minute', ts)) as s,
      case when event_id % 5 = 0 then event_id % 3 * 500000 else cast(user_id % 20 + 5 as bigint) * 60000000 end as own,
      row_number() over (partition by user_id order by date_trunc('minute', ts), event_id) as k from events),
    walk as (
      select user_id, event_id, k, s as first, s + greatest(own, 2000000) as last, own, false as pushed from i where k = 1
      union all
      select i.user_id, i.event_id, i.k, greatest(i.s, w.last), greatest(i.s, w.last) + greatest(i.own, 2000000), i.own, i.s <= w.last
      from walk w join i on i.user_id = w.user_id and i.k = w.k + 1),
    n as (select w.*, coalesce(x.pushed, false) as pushes from walk w left join walk x on x.user_id = w.user_id and x.k = w.k + 1),
    b as (select *, first + case when pushed then 1000000 else 0 end as begin_at from n)
    select user_id, event_id, make_timestamp(begin_at) as start_adj,
      make_timestamp(case when pushes then last - 1000000 else greatest(begin_at, first + own) end) as end_adj from b""",
)
def resolve_overlaps(spark, folder):
    start = trunc_to("ts", 60).alias("start")
    e = series_events(spark, folder).select("user_id", "event_id", start)
    # Every fifth interval is empty or shorter than the gap.
    long, short = add_seconds("start", (F.col("user_id") % 20 + 5) * 60), add_seconds("start", F.col("event_id") % 3 * 0.5)
    spans = e.withColumn("stop", F.when(F.col("event_id") % 5 == 0, short).otherwise(long))
    return repair(spans, "start", "stop", ["user_id"], "event_id").select(
        "user_id", "event_id", "start_adj", "end_adj"
    )
