"""Expansion, effort, abundance and sampling pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import DEFAULTS, DISCHARGE, E_SERIES, EV, EV_BASE, EXPANDED, SPEC, VOLUMES, r, registry, rounded
from seriesframe.catalog.windows import PEAKS_SQL
from seriesframe.functions.lookups import BAY_WIDTH, CURRENT_SCALE, GEAR_DEPTH, GEAR_RATIO, SURFACE_TO_DEPTH
from seriesframe.functions.semantics import collapse, safe_divide
from seriesframe.operators import relate
from seriesframe.operators.running import zero_fill
from seriesframe.plans import catch
from seriesframe.plans.sheets import IDS, category_sums, discharge, event_base, event_sheet, series_events, specimen_sheet
from seriesframe.plans.timing import compare_sites
from seriesframe.sources.files import settle
from seriesframe.sources.spines import day_spine, one_value

QUERIES, SQL, register = registry()


def _expand(spark, folder, sums=None):
    sums = category_sums(spark, folder) if sums is None else sums
    counts = sums.where(F.col("category").isNotNull()).select("event", "category", "n_cat")
    return catch.expand_counts(event_sheet(spark, folder, sums), counts, "event", "total", "released")


def expanded(spark, folder, sums=None):
    """Expanded counts per event and category with volume and CPUE."""
    ex = catch.with_volume(_expand(spark, folder, sums), "gear", "run_s")
    return ex.withColumn("cpue", safe_divide("n_exp", "fished_vol"))


def events_with_cpue(spark, folder, sums=None):
    """One row per event with volume and CPUE of its whole catch."""
    ev = catch.with_volume(event_sheet(spark, folder, sums), "gear", "run_s")
    return ev.withColumn("cpue", safe_divide("total", "fished_vol"))


_EVV = f"""{EV}, vol(gear, run_s, v) as (values {VOLUMES}),
evv as (select ev.*, coalesce(v, {DEFAULTS}) as fished_vol, total / coalesce(v, {DEFAULTS}) as cpue
  from ev left join vol using (gear, run_s))"""
_DEPTH = f"case gear when 'Vertical' then {GEAR_DEPTH['Vertical']}e0 else {GEAR_DEPTH['RST']}e0 end"
_CURRENT = f"case depth_ft when 6 then velocity * {CURRENT_SCALE[6]}e0 when 12 then velocity * {CURRENT_SCALE[12]}e0 else velocity end"


@register(
    "subsample_expansion_run",
    f"""with {EXPANDED} select event, category, total, released, n_cat, {r('propn_obs')} as propn_obs,
      {r('n_exp')} as n_exp from ex""",
)
def subsample_expansion_run(spark, folder):
    ex = _expand(spark, folder)
    return rounded(ex.select("event", "category", "total", "released", "n_cat", "propn_obs", "n_exp"))


def _season_sql(day: str) -> str:
    keys = f"{day}category"
    over = f"partition by {day.rstrip(', ')}" if day else ""
    return f"""with {EV_BASE}, {SPEC},
    pe as (select {keys}, event, count(distinct (l_partkey, l_linenumber)) as a from sp join ev_base using (event) group by all),
    pp as (select *, a / sum(a) over (partition by event) as propn from pe),
    ad as (select {keys}, sum(released * propn) as n_added from
      (select pp.*, released from pp join (select event, released from ev_base where released <> 0) using (event)) group by all),
    od as (select {keys}, cast(sum(a) as bigint) as n_old from pe group by all),
    j as (select od.*, n_added, coalesce(n_old + n_added, n_old) as n_new from od left join ad using ({keys}))
    select {keys}, n_old, {r('n_added')} as n_added, {r('n_new')} as n_new,
      {r(f'n_old / sum(n_old) over ({over})')} as old_share, {r(f'n_new / sum(n_new) over ({over})')} as new_share from j"""


@register("subsample_expansion_season", _season_sql(""))
def subsample_expansion_season(spark, folder):
    out = catch.expand_season(event_base(spark, folder), specimen_sheet(spark, folder), "event", "category", IDS, "released")
    return rounded(out.select("category", "n_old", "n_added", "n_new", "old_share", "new_share"))


@register("subsample_expansion_daily", _season_sql("date, "))
def subsample_expansion_daily(spark, folder):
    out = catch.expand_season(
        event_base(spark, folder), specimen_sheet(spark, folder), "event", "category", IDS, "released", by=["date"]
    )
    return rounded(out.select("date", "category", "n_old", "n_added", "n_new", "old_share", "new_share"))


@register(
    "effort_metrics",
    f"""with {EXPANDED} select event, category, fished_vol, {r('cpue', 8)} as cpue, {r('n_exp / nullif(velocity, 0)')} as per_velocity,
      {r('n_exp / nullif(velocity, 0) / run_s', 10)} as per_velocity_s from exv""",
)
def effort_metrics(spark, folder):
    out = catch.effort_metrics(expanded(spark, folder), "n_exp", "velocity", "run_s")
    out = out.select("event", "category", "fished_vol", "cpue", "per_velocity", "per_velocity_s")
    return rounded(out, 8, per_velocity=6, per_velocity_s=10)


@register(
    "catch_per_run",
    f"""with {EV}, {DISCHARGE}, dy as (select date, sum(total) as total, count(distinct event) as n_runs, sum(run_s) as run_s
      from ev group by 1)
    select date, cast(total as bigint) as total, n_runs, {r('total / n_runs * 10')} as per_ten_runs,
      {r('total / nullif(mean_discharge, 0) * 1000', 4)} as per_discharge,
      {r('total / nullif(mean_discharge, 0) / run_s * 1e7', 3)} as per_discharge_s
    from dy left join discharge using (date)""",
)
def catch_per_run(spark, folder):
    out = catch.catch_per_run(event_sheet(spark, folder), "date", "event", "total", "run_s", discharge(spark, folder))
    out = out.select("date", "total", "n_runs", "per_ten_runs", "per_discharge", "per_discharge_s")
    return rounded(out, per_discharge=4, per_discharge_s=3)


@register(
    "effort_summary",
    f"""with {_EVV} select depth_ft, {r('sum(fished_vol)', 3)} as sum_vol, {r('sum(run_s) / 3600.0')} as hours,
      count(distinct event) as n_events, cast(sum(total) as bigint) as total_catch,
      {r('sum(fished_vol) / count(distinct event)')} as vol_per_event
    from evv where gear = 'Vertical' group by 1""",
)
def effort_summary(spark, folder):
    ev = events_with_cpue(spark, folder).where("gear = 'Vertical'")
    return rounded(catch.effort_summary(ev, ["depth_ft"], "event", "run_s", "total"), sum_vol=3)


# Two labels form the target group, as the labels of one stock do.
_GROUP = {"target": ["A", "R"]}


@register(
    "abundance_m1",
    f"""with {EXPANDED}, {DISCHARGE},
    pe as (select date, event, sum(n_exp) as n, avg(cpue) as c from exv where gear = 'RST' and category in ('A', 'R') group by 1, 2),
    dy as (select date, sum(n) as n, avg(c) as c from pe group by 1),
    sp_days as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from ev)
    select date, {r('coalesce(n, 0)', 4)} as total_n_exp, {r('coalesce(c * mean_discharge * 86400, 0)', 3)} as daily_ia
    from sp_days left join (select dy.*, mean_discharge from dy left join discharge using (date)) using (date)""",
)
def abundance_m1(spark, folder):
    ex = expanded(spark, folder).withColumn("category", collapse("category", _GROUP))
    daily = catch.abundance_m1(
        ex.where("gear = 'RST' and category = 'target'"), discharge(spark, folder), "date", "event"
    ).select("date", "total_n_exp", "daily_ia")
    ends = event_base(spark, folder).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    out = zero_fill(daily, "date", ["total_n_exp", "daily_ia"], day_spine(ends, "lo", "hi"), [])
    return rounded(out, 3, total_n_exp=4)


@register(
    "abundance_m2",
    f"""with {EXPANDED}, pe as (select category, date, event, sum(n_exp) as n,
      avg(cpue * ({BAY_WIDTH!r}e0 * {GEAR_DEPTH['RST']}e0 * velocity * run_s)) as ia
      from exv where gear = 'RST' group by 1, 2, 3)
    select category, date, {r('sum(n)', 4)} as total_n_exp, {r('avg(ia)', 4)} as mean_ia from pe group by 1, 2""",
)
def abundance_m2(spark, folder):
    ex = expanded(spark, folder).where("gear = 'RST'")
    return rounded(catch.abundance_m2(ex, "date", "event", "velocity", "run_s", ["category"]), 4)


@register(
    "abundance_m2_curve",
    f"""with {EXPANDED}, pe as (select category, date, event,
      avg(cpue * ({BAY_WIDTH!r}e0 * {GEAR_DEPTH['RST']}e0 * velocity * run_s)) as ia
      from exv where gear = 'RST' group by 1, 2, 3),
    m as (select category, date, avg(ia) as ia from pe group by 1, 2),
    f as (select c.category, days.date, coalesce(ia, 0) as ia from (select distinct category from m) c
      cross join (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from m) days
      left join m on m.category is not distinct from c.category and m.date = days.date)
    select category, date, {r('ia', 4)} as mean_ia, {r('sum(ia) over (partition by category order by date)', 2)} as running,
      {r('sum(ia) over (partition by category order by date) / nullif(sum(ia) over (partition by category), 0)')} as cum_share from f""",
)
def abundance_m2_curve(spark, folder):
    ex = expanded(spark, folder).where("gear = 'RST'")
    daily = catch.abundance_m2(ex, "date", "event", "velocity", "run_s", ["category"])
    return rounded(catch.season_curve(daily, "date", "mean_ia", ["category"]), mean_ia=4, running=2)


@register(
    "abundance_depth_totals",
    f"""with {EXPANDED}, dd as (select depth_ft, sum(cpue * ({BAY_WIDTH!r}e0 * {_DEPTH} * velocity * run_s)) as x
      from exv where gear <> 'IPT' group by 1)
    select depth_ft, {r('x', 0)} as total, {r('x / sum(x) over ()')} as share from dd""",
)
def abundance_depth_totals(spark, folder):
    ex = expanded(spark, folder).where("gear <> 'IPT'")
    daily = catch.abundance_by_depth(ex, "date", "depth_ft", "velocity", "run_s", "gear")
    return rounded(catch.depth_totals(daily, "depth_ft", "ia_depth"), total=0)


@register(
    "depth_scaled_shares",
    f"""with {EXPANDED}, evv as (select ev.*, total / coalesce(v, {DEFAULTS}) as cpue from ev left join vol using (gear, run_s)),
    a as (select date, depth_ft, sum(cpue * ({BAY_WIDTH!r}e0 * {_DEPTH} * ({_CURRENT}) * run_s)) as m4
      from exv where gear <> 'IPT' group by 1, 2),
    b as (select date, depth_ft, sum(cpue * case when depth_ft <> 0 then {GEAR_RATIO}e0 else 1 end
      * ({BAY_WIDTH!r}e0 * {GEAR_DEPTH['RST']}e0 * ({_CURRENT}) * run_s)) as m5 from evv where gear <> 'IPT' group by 1, 2)
    select date, depth_ft, {r('m4', 4)} as m4_total, {r('m4 / nullif(sum(m4) over (partition by date), 0)')} as m4_share,
      {r('m5', 4)} as m5_total, {r('m5 / nullif(sum(m5) over (partition by date), 0)')} as m5_share
    from a join b using (date, depth_ft)""",
)
def depth_scaled_shares(spark, folder):
    unit = ["date", "depth_ft"]
    sums = category_sums(spark, folder)
    ex, ev = (f(spark, folder, sums).where("gear <> 'IPT'") for f in (expanded, events_with_cpue))
    m4 = catch.abundance_m4(ex, "date", "depth_ft", "velocity", "run_s", "gear", by=["depth_ft"])
    m5 = catch.abundance_m5(ev, "date", "depth_ft", "velocity", "run_s", by=["depth_ft"])
    both = relate.join_keep_left(m4, m5, unit, "inner")
    for m in ("m4", "m5"):
        both = catch.share_small(both, f"{m}_total", ["date"], f"{m}_share")
    return rounded(both, m4_total=4, m5_total=4)


@register(
    "abundance_by_depth",
    f"""with {EXPANDED}, dd as (select date, depth_ft, sum(cpue * ({BAY_WIDTH!r}e0 * {_DEPTH} * velocity * run_s)) as x
      from exv where gear <> 'IPT' group by 1, 2)
    select date, depth_ft, {r('x', 4)} as ia_depth, {r('x / nullif(sum(x) over (partition by date), 0)')} as share_of_day from dd""",
)
def abundance_by_depth(spark, folder):
    ex = expanded(spark, folder).where("gear <> 'IPT'")
    return rounded(catch.abundance_by_depth(ex, "date", "depth_ft", "velocity", "run_s", "gear"), ia_depth=4)


@register(
    "depth_scaled",
    f"""with {EXPANDED}, evv as (select ev.*, total / coalesce(v, {DEFAULTS}) as cpue from ev left join vol using (gear, run_s)),
    a as (select date, sum(cpue * ({BAY_WIDTH!r}e0 * {_DEPTH} * ({_CURRENT}) * run_s)) as m4 from exv where gear <> 'IPT' group by 1),
    b as (select date, sum(cpue * case when depth_ft <> 0 then {GEAR_RATIO}e0 else 1 end
      * ({BAY_WIDTH!r}e0 * {GEAR_DEPTH['RST']}e0 * ({_CURRENT}) * run_s)) as m5 from evv where gear <> 'IPT' group by 1)
    select date, {r('m4', 4)} as m4_total, {r('m5', 4)} as m5_total from a join b using (date)""",
)
def depth_scaled(spark, folder):
    sums = category_sums(spark, folder)
    ex, ev = (f(spark, folder, sums).where("gear <> 'IPT'") for f in (expanded, events_with_cpue))
    m4 = catch.abundance_m4(ex, "date", "depth_ft", "velocity", "run_s", "gear")
    m5 = catch.abundance_m5(ev, "date", "depth_ft", "velocity", "run_s")
    return rounded(relate.join_keep_left(m4, m5, ["date"], "inner"), 4)


@register(
    "surface_to_depth",
    f"""with {_EVV}, s as (select date, bay, sum(cpue) as x from evv where depth_ft = 0 group by 1, 2),
    b as (select distinct date, bay from evv where depth_ft <> 0),
    j as (select coalesce(s.date, b.date) as date, coalesce(s.bay, b.bay) as bay, coalesce(x, 0) as x
      from s full join b on s.date = b.date and s.bay = b.bay)
    select date, bay, {r('x', 8)} as surface, {r(f'x * {SURFACE_TO_DEPTH[6]}', 8)} as depth_6,
      {r(f'x * {SURFACE_TO_DEPTH[12]}', 8)} as depth_12 from j""",
)
def surface_to_depth(spark, folder):
    out = catch.surface_to_depth(events_with_cpue(spark, folder), ["date", "bay"], "depth_ft", "cpue")
    return rounded(out.select("date", "bay", "surface", "depth_6", "depth_12"), 8)


@register(
    "paired_ratio",
    f"""with u as (select l_orderkey, sum(l_quantity) filter (where l_linestatus = 'F') as a,
      sum(l_quantity) filter (where l_linestatus = 'O') as b from lineitem group by 1 having a > 0 and b > 0)
    select count(*) as n_pairs, {r('avg(a / b)')} as mean_ratio, {r('stddev_samp(a / b)')} as sd_ratio from u""",
)
def paired_ratio(spark, folder):
    sp = specimen_sheet(spark, folder)
    return rounded(catch.paired_ratio(sp, ["event"], "l_linestatus", "F", "O", "length"))


@register(
    "sampling_scheme_compare",
    f"""with {EXPANDED}, dc as (select date, category, sum(n_exp) as n from ex where category is not null group by 1, 2),
    st as (select min(date) as lo from dc),
    s as (select category, sum(n) as every, sum(case when (date - lo) % 2 = 0 then n else 0 end) as odd,
      sum(case when (date - lo) % 2 = 1 then n else 0 end) as alt from dc, st group by 1)
    select category, {r('every', 4)} as sum_every, {r('every / sum(every) over ()')} as share_every,
      {r('odd', 4)} as sum_odd, {r('odd / sum(odd) over ()')} as share_odd,
      {r('alt', 4)} as sum_alt, {r('alt / sum(alt) over ()')} as share_alt from s""",
)
def sampling_scheme_compare(spark, folder):
    ex = expanded(spark, folder).where(F.col("category").isNotNull())
    daily = settle(ex.groupBy("date", "category").agg(F.sum("n_exp").alias("n")), "daily")
    return rounded(catch.compare_schemes(daily, "date", "category", "n", _schemes(daily)), sum_every=4, sum_odd=4, sum_alt=4)


def _schemes(daily):
    """All days, every second day from the first one on, and the days between those."""
    start = one_value(daily, F.min("date"))
    return {"every": F.lit(True), "odd": catch.every_other_day("date", start), "alt": catch.every_other_day("date", start, 1)}


@register(
    "sampling_scheme_daily",
    f"""with {EXPANDED}, dc as (select date, category, sum(n_exp) as n from ex where category is not null group by 1, 2),
    sh as (select *, n / sum(n) over (partition by date) as share, (date - min(date) over ()) % 2 as turn from dc)
    select date, category, {r('share')} as share_every, case when turn = 0 then {r('share')} end as share_odd,
      case when turn = 1 then {r('share')} end as share_alt from sh""",
)
def sampling_scheme_daily(spark, folder):
    ex = expanded(spark, folder).where(F.col("category").isNotNull())
    daily = settle(ex.groupBy("date", "category").agg(F.sum("n_exp").alias("n")), "daily")
    return rounded(catch.scheme_daily_share(daily, "date", "category", "n", _schemes(daily)))


@register(
    "two_site_compare",
    f"""with {E_SERIES}, b as (select cast(ts as date) as date, series, value from e where series in ('purchase', 'view')),
    days as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from b),
    src as (select s.series as grp, days.date as t, coalesce(sum(value), 0) as x from days
      cross join (values ('purchase'), ('view')) s(series) left join b on b.date = days.date and b.series = s.series group by 1, 2),
    {PEAKS_SQL}, rk as (select *, row_number() over (partition by grp order by height desc, t) as rn from pk where prominence >= 0),
    cu as (select grp, src.t, x, sum(x) over (partition by grp order by t) as run,
      sum(x) over (partition by grp order by t) / sum(x) over (partition by grp) as cum from src),
    al as (select cu.*, case when rn <= 3 then cast(rn as int) end as peak from cu left join rk using (grp, t))
    select a.t as date, {r('a.x', 4)} as a_n, {r('a.run', 4)} as a_run, {r('a.cum')} as a_cum, a.peak as a_peak,
      {r('b.x', 4)} as b_n, {r('b.run', 4)} as b_run, {r('b.cum')} as b_cum, b.peak as b_peak
    from al a join al b using (t) where a.grp = 'purchase' and b.grp = 'view'""",
)
def two_site_compare(spark, folder):
    e = series_events(spark, folder).select(F.to_date("ts").alias("date"), "series", "value")
    out = compare_sites(e.where("series = 'purchase'"), e.where("series = 'view'"), "date", "value")
    return rounded(out, a_n=4, a_run=4, b_n=4, b_run=4)
