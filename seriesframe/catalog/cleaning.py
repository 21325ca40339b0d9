"""Sources, cleaning, scalar functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import DEFAULTS, EV_BASE, VOLUMES, r, registry, rounded
from seriesframe.functions import semantics as sem, text, times
from seriesframe.functions.lookups import SENTINELS
from seriesframe.operators import clean as op, relate
from seriesframe.plans.catch import with_volume
from seriesframe.plans.sheets import event_base, table
from seriesframe.session import new_stage_path
from seriesframe.sources import files, spines
from seriesframe.sources.spines import one_value

QUERIES, SQL, register = registry()


@register("scan_csv_typed", "select event_id, ts, user_id, event_type, value, props from events")
def scan_csv_typed(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    path = new_stage_path(spark, "events-csv")
    files.write_survey_csv(e, path)
    return files.read_survey_csv(spark, path, e.schema)


@register(
    "roundtrip_sink",
    f"""select l_returnflag as category, l_linestatus as status, count(*) as n,
    {r('sum(l_quantity)', 2)} as total from lineitem group by 1, 2""",
)
def roundtrip_sink(spark, folder):
    agg = table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("status")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    copy = files.tee(rounded(agg, 2), new_stage_path(spark, "totals-csv"))
    return files.stage(copy, new_stage_path(spark, "totals"))


@register(
    "spine_day",
    """select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as date
    from (select min(o_orderdate) as lo, max(o_orderdate) as hi from orders)""",
)
def spine_day(spark, folder):
    ends = table(spark, folder, "orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return spines.day_spine(ends, "lo", "hi")


@register(
    "spine_minute",
    """select unnest(generate_series(date_trunc('minute', lo), hi, interval 1 minute)) as t
    from (select min(ts) as lo, max(ts) as hi from events)""",
)
def spine_minute(spark, folder):
    ends = table(spark, folder, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return spines.time_spine(ends, "lo", "hi", 60)


@register(
    "gap_in_ids",
    """select id as l_orderkey from (
      select unnest(generate_series(min(l_orderkey), max(l_orderkey))) as id from lineitem)
    where id not in (select l_orderkey from lineitem)""",
)
def gap_in_ids(spark, folder):
    return relate.missing_ids(table(spark, folder, "lineitem"), "l_orderkey")


_NR_TEXT = "case when l_linenumber = 7 then 'NR' else cast(l_quantity as varchar) end"


def _raw_sheet(spark, folder):
    """Lineitem as a raw text sheet with sentinels, negative signs and text dates."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Order No"),
        F.col("l_linenumber").cast("string").alias("Line"),
        F.when(F.col("l_linenumber") == 7, "NR").otherwise(F.col("l_quantity").cast("string")).alias("Length"),
        F.when(F.col("l_linestatus") == "F", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("Dist"),
        F.col("l_returnflag").alias("Depth"),
        F.date_format("l_shipdate", "dd-MMM-yyyy").alias("Date"),
        F.col("l_tax").alias("scratch"),
    )


@register(
    "clean_table",
    f"""select l_orderkey as event, l_linenumber as line, try_cast(nullif({_NR_TEXT}, 'NR') as double) as length,
    l_extendedprice as dist, case l_returnflag when 'N' then '0' else l_returnflag end as depth,
    cast(l_shipdate as date) as date from lineitem""",
)
def clean_table(spark, folder):
    tidy = op.clean(
        _raw_sheet(spark, folder),
        renames={"Order No": "event", "Line": "line", "Length": "length", "Dist": "dist", "Depth": "depth", "Date": "date"},
        casts={"line": "int", "length": "double"},
        sentinels=["NR", "NA"],
        relabel={"depth": {"N": "0"}},
        absolute=["dist"],
        drop=["scratch"],
    )
    return tidy.withColumn("date", times.parse_date("date", "dd-MMM-yyyy")).select(
        "event", "line", "length", "dist", "depth", "date"
    )


@register(
    "build_keys",
    """select o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-R' || o_custkey || '-B' || o_orderpriority || '-' ||
      coalesce(nullif(o_orderstatus, 'P'), 'NA') as event_key,
    strftime(o_orderdate, '%Y%m%d') || '-R' || o_custkey as env_key from orders""",
)
def build_keys(spark, folder):
    day = text.compact_date("o_orderdate")
    run = F.concat(F.lit("R"), F.col("o_custkey").cast("string"))
    bay = F.concat(F.lit("B"), F.col("o_orderpriority"))
    status = sem.blank_to_null("o_orderstatus", ["P"])
    return table(spark, folder, "orders").select(
        "o_orderkey", text.make_key(day, run, bay, status).alias("event_key"), text.make_key(day, run).alias("env_key")
    )


@register("select_by_position", "select l_orderkey, l_suppkey, l_quantity from lineitem")
def select_by_position(spark, folder):
    return op.pick(op.pick(table(spark, folder, "lineitem"), [1, 3, 5, 7]), [-4])


@register(
    "parse_runtime",
    """select event_id, case when event_type = 'error' then null else
    cast(hour(ts) * 3600 + minute(ts) * 60 as bigint) end as run_s from events""",
)
def parse_runtime(spark, folder):
    clock = F.concat(F.hour("ts"), F.lit(":"), F.lpad(F.minute("ts").cast("string"), 2, "0"))
    written = F.when(F.col("event_type") == "error", "NR").otherwise(clock)
    return table(spark, folder, "events").select("event_id", times.runtime_seconds(written).alias("run_s"))


@register(
    "parse_hhmm",
    """select event_id, cast(hour(ts) * 100 + minute(ts) as bigint) as hhmm,
    date_trunc('minute', ts) as start_ts from events""",
)
def parse_hhmm(spark, folder):
    hhmm = (F.hour("ts") * 100 + F.minute("ts")).cast("long")
    e = table(spark, folder, "events").select("event_id", F.to_date("ts").alias("day"), hhmm.alias("hhmm"))
    return e.select("event_id", "hhmm", times.parse_hhmm("day", "hhmm").alias("start_ts"))


@register(
    "string_ops",
    r"""select p_partkey, nullif(regexp_extract(p_name, '^(.*) ([^ ]+)$', 1), '') as head,
    nullif(regexp_extract(p_name, '^(.*) ([^ ]+)$', 2), '') as tail,
    regexp_replace(p_type, '(.{2})', '\1:', 'g') as pairs, p_brand || '_' || p_size as united,
    replace(p_brand, '#', '') as plain, lpad(cast(p_size as varchar), 4, '0') as padded,
    substring(p_name, 1, 3) as start3, cast(length(p_name) as int) as name_len from part""",
)
def string_ops(spark, folder):
    p = table(spark, folder, "part")
    head, tail = text.separate("p_name", " (?=[^ ]+$)", ["head", "tail"])
    return p.select(
        "p_partkey",
        head,
        tail,
        F.regexp_replace("p_type", "(.{2})", "$1:").alias("pairs"),
        text.unite("p_brand", "p_size").alias("united"),
        F.regexp_replace("p_brand", "#", "").alias("plain"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.substring("p_name", 1, 3).alias("start3"),
        F.length("p_name").alias("name_len"),
    )


@register(
    "date_ops",
    f"""select event_id, cast(year(ts) as int) as yr, strftime(ts, '%m') as mo, cast(day(ts) as int) as dy,
    cast(floor((dayofyear(ts) - 1) / 7) + 1 as int) as wk,
    cast(strptime(strftime(ts, '%d-%b-%y'), '%d-%b-%y') as date) as parsed,
    make_timestamp(cast(floor((epoch_us(ts) + 900000000) / 1800000000.0) as bigint) * 1800000000) as half_hour,
    strftime(ts, '%H:%M:%S') as clock,
    {r("(epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 86400000000.0")} as julian from events""",
)
def date_ops(spark, folder):
    written = F.date_format("ts", "dd-MMM-yy")
    out = table(spark, folder, "events").select(
        "event_id",
        F.year("ts").alias("yr"),
        F.lpad(F.month("ts").cast("string"), 2, "0").alias("mo"),
        F.dayofmonth("ts").alias("dy"),
        times.week_of_year("ts").alias("wk"),
        times.parse_date(written, "dd-MMM-yy").alias("parsed"),
        times.round_to("ts", 1800).alias("half_hour"),
        times.clock_text("ts").alias("clock"),
        times.julian_days("ts", "2024-01-01").alias("julian"),
    )
    return rounded(out)


@register(
    "math_ops",
    f"""select l_orderkey, l_linenumber, l_partkey, {r('ln(l_extendedprice)')} as ln_price,
    {r('log10(l_quantity)')} as log_qty, {r('exp(-l_discount)')} as decay, {r('power(l_quantity, 2)', 2)} as squared,
    round_even(l_quantity / 2, 0) as half_even, abs(l_discount - l_tax) > 0.05 as far from lineitem""",
)
def math_ops(spark, folder):
    out = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.log("l_extendedprice").alias("ln_price"),
        F.log10("l_quantity").alias("log_qty"),
        F.exp(-F.col("l_discount")).alias("decay"),
        F.pow("l_quantity", F.lit(2)).alias("squared"),
        sem.round_even(F.col("l_quantity") / 2).alias("half_even"),
        (F.abs(F.col("l_discount") - F.col("l_tax")) > 0.05).alias("far"),
    )
    return rounded(out, squared=2)


@register(
    "null_replace",
    f"""select o_orderkey, coalesce(n, 0) as n_lines, {r('coalesce(mean_price, o_totalprice)', 5)} as price
    from orders left join (select l_orderkey, count(*) as n, avg(l_extendedprice) as mean_price
      from lineitem group by 1) on o_orderkey = l_orderkey""",
)
def null_replace(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean_price")
    )
    o = relate.join_keep_left(table(spark, folder, "orders"), lines, ["o_orderkey"])
    out = o.select(
        "o_orderkey", sem.fill_from("n", 0).alias("n_lines"), sem.fill_from("mean_price", F.col("o_totalprice")).alias("price")
    )
    return rounded(out, 5)


@register(
    "category_collapse",
    """select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'early'
      when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 'late' else o_orderpriority end as stage,
    count(*) as n from orders group by 1""",
)
def category_collapse(spark, folder):
    stage = sem.collapse("o_orderpriority", {"early": ["1-URGENT", "2-HIGH"], "late": ["4-NOT SPECIFIED", "5-LOW"]})
    return table(spark, folder, "orders").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "lookup_with_default",
    f"""with {EV_BASE}, vol(gear, run_s, v) as (values {VOLUMES})
    select event, gear, run_s, coalesce(v, {DEFAULTS}) as fished_vol
    from ev_base left join vol using (gear, run_s)""",
)
def lookup_with_default(spark, folder):
    return with_volume(event_base(spark, folder), "gear", "run_s").select("event", "gear", "run_s", "fished_vol")


_SENTINEL_TEXT = """case l_linenumber when 7 then 'NR' when 6 then '' when 5 then 'n/a'
  else cast(l_quantity as varchar) end"""


@register(
    "filter_sentinels",
    f"""select l_orderkey, l_linenumber, l_partkey, try_cast(txt as double) as length
    from (select *, {_SENTINEL_TEXT} as txt from lineitem)
    where txt not in ('NR', 'NA', 'n/a', '', 'Unconfirmed', '#DIV/0!', 'RNA')
      and try_cast(txt as double) > 10 and l_returnflag = 'R' and l_linestatus <> 'F'""",
)
def filter_sentinels(spark, folder):
    n, qty = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    written = F.when(n == 7, "NR").when(n == 6, "").when(n == 5, "n/a").otherwise(qty)
    rows = table(spark, folder, "lineitem").withColumn("txt", written)
    length = sem.lenient_cast("txt", "double")
    kept = rows.where(
        sem.reject("txt", SENTINELS) & (length > 10) & (F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F")
    )
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", length.alias("length"))


@register(
    "filter_membership",
    """select o_orderkey, o_custkey, o_orderpriority from orders
    where o_orderpriority in ('1-URGENT', '3-MEDIUM', '5-LOW')
      and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""",
)
def filter_membership(spark, folder):
    o = op.keep_members(table(spark, folder, "orders"), "o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"])
    wanted = table(spark, folder, "customer").where(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    return op.keep_members(o, "o_custkey", wanted).select("o_orderkey", "o_custkey", "o_orderpriority")


@register(
    "filter_time_range",
    """select event_id, ts, value from events
    where ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-20 18:00:00'""",
)
def filter_time_range(spark, folder):
    e = table(spark, folder, "events")
    return op.time_range(e, "ts", "2024-01-05 06:00:00", "2024-01-20 18:00:00").select("event_id", "ts", "value")


@register(
    "filter_time_range_open",
    """select event_id, ts, value from events
    where ts > (select min(ts) from events) and ts < (select max(ts) from events)""",
)
def filter_time_range_open(spark, folder):
    e = table(spark, folder, "events")
    ends = [one_value(e, f("ts")) for f in (F.min, F.max)]
    return op.time_range(e, "ts", *ends, closed=False).select("event_id", "ts", "value")


@register("filter_pattern", "select p_partkey, p_name from part where not regexp_matches(p_name, 'widget')")
def filter_pattern(spark, folder):
    return table(spark, folder, "part").where(~F.col("p_name").rlike("widget")).select("p_partkey", "p_name")


@register(
    "drop_incomplete",
    f"""select o_orderkey, o_totalprice, {r('avg(l_quantity)')} as mean_qty
    from orders join lineitem on o_orderkey = l_orderkey group by 1, 2""",
)
def drop_incomplete(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.avg("l_quantity").alias("mean_qty")
    )
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rounded(op.drop_incomplete(relate.join_keep_left(o, lines, ["o_orderkey"])))


@register(
    "calendar_subset",
    """select o_orderkey, cast(o_orderdate as date) as date from orders
    where cast(o_orderdate as date) between date '1995-04-03' and date '2001-06-14' and day(o_orderdate) % 2 = 1""",
)
def calendar_subset(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return op.calendar_subset(o, "date", "1995-04-03", "2001-06-14", list(range(1, 32, 2)))


@register(
    "apply_corrections",
    """select o_orderkey, coalesce(new_status, o_orderstatus) as o_orderstatus,
    coalesce(new_price, o_totalprice) as o_totalprice
    from orders left join (select l_orderkey as k, 'X' as new_status,
      case when max(l_quantity) = 50 then 1.0 end as new_price
      from lineitem group by 1 having count(*) > 6) on o_orderkey = k
    where o_orderkey in (select l_orderkey from lineitem)""",
)
def apply_corrections(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    fixes = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    fixes = fixes.where("n > 6").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("q") == 50, 1.0).alias("o_totalprice")
    )
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    empty = relate.not_in(o, lines, ["o_orderkey"])
    return op.apply_corrections(o, fixes, ["o_orderkey"], deletes=empty)
