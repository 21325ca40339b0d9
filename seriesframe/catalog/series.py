"""Gaps, imputation, breaks and other series operators on gridded events."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import daily_sql, grid_sql, r, registry, rounded
from seriesframe.operators import breaks, gaps, impute, signal
from seriesframe.operators.grid import with_index
from seriesframe.operators.running import running_total
from seriesframe.sources.files import settle
from seriesframe.plans.sheets import DAY_SLOTS, HALF_HOUR_SLOTS, daily_series, grid_series, series_events

QUERIES, SQL, register = registry()
BY = ["series"]

_RUNS = """near as (select *, max(case when value is not null then slot end) over (partition by series order by slot) as p from g),
runs as (select series, p, min(slot) as gap_start, max(slot) as gap_end, count(*) as gap_size from near
  where value is null group by 1, 2)"""


@register(
    "na_gap_stats",
    f"""with {grid_sql()}, {_RUNS},
    tot as (select series, count(*) as n_slots, count(*) - count(value) as n_null from g group by 1),
    sz as (select series, gap_size, count(*) as k from runs group by 1, 2),
    com as (select series, gap_size as commonest_gap, row_number() over (partition by series order by k desc, gap_size) as rn from sz),
    agg as (select series, cast(sum(k) as bigint) as n_gaps, max(gap_size) as longest_gap from sz group by 1)
    select series, n_slots, n_null, coalesce(n_gaps, 0) as n_gaps, longest_gap, commonest_gap,
      {r('n_null / n_slots')} as null_share
    from tot left join agg using (series) left join (select * from com where rn = 1) using (series)""",
)
def na_gap_stats(spark, folder):
    out = gaps.gap_stats(grid_series(spark, folder), BY, "slot", "value")
    return rounded(out)


@register(
    "gap_size_histogram",
    f"""with {grid_sql()}, {_RUNS} select series, gap_size, count(*) as n_gaps, cast(sum(gap_size) as bigint) as n_nulls
    from runs group by 1, 2""",
)
def gap_size_histogram(spark, folder):
    return gaps.gap_sizes(gaps.gap_runs(grid_series(spark, folder), BY, "slot", "value"), BY)


@register(
    "na_distribution",
    f"""with {grid_sql()}, b as (select *, cast(ntile(20) over (partition by series order by slot) as int) as bin from g)
    select series, bin, count(*) as n_slots, count(*) - count(value) as n_null,
      {r('1 - count(value) / count(*)')} as null_share from b group by 1, 2""",
)
def na_distribution(spark, folder):
    return rounded(gaps.gap_bins(grid_series(spark, folder), BY, "slot", "value", 20))


@register(
    "impute_mean_median",
    f"""with {grid_sql()}, m as (select series, avg(value) as mu, median(value) as med from g group by 1)
    select series, t, {r('coalesce(value, mu)')} as by_mean, {r('coalesce(value, med)')} as by_median
    from g join m using (series)""",
)
def impute_mean_median(spark, folder):
    g = impute.impute_mean(grid_series(spark, folder), BY, "value", "by_mean")
    out = impute.impute_median(g, BY, "value", "by_median")
    return rounded(out.select("series", "t", "by_mean", "by_median"))


_LINEAR = """nb as (select *, last_value(case when {v} is not null then slot end ignore nulls) over b as ps,
    last_value({v} ignore nulls) over b as pv,
    first_value(case when {v} is not null then slot end ignore nulls) over f as ns, first_value({v} ignore nulls) over f as nv
  from {src} window b as (partition by series order by slot rows between unbounded preceding and current row),
    f as (partition by series order by slot rows between current row and unbounded following)),
li as (select *, coalesce({v}, pv + (nv - pv) * ((slot - ps) / nullif(ns - ps, 0)), pv, nv) as filled from nb)"""


@register(
    "impute_linear",
    f"with {grid_sql()}, {_LINEAR.format(v='value', src='g')} select series, t, value is null as was_null, {r('filled')} as filled from li",
)
def impute_linear(spark, folder):
    out = impute.impute_linear(grid_series(spark, folder), BY, "slot", "value")
    return rounded(out.select("series", "t", F.col("value").isNull().alias("was_null"), "filled"))


@register(
    "impute_seasonal",
    f"""with {grid_sql()}, lv as (select series, avg(value) as lvl from g group by 1),
    se as (select series, slot % 144 as pos, avg(value) as sm from g group by 1, 2),
    sx as (select g.*, coalesce(sm - lvl, 0) as season, value - coalesce(sm - lvl, 0) as rest
      from g join lv using (series) join se on se.series = g.series and se.pos = g.slot % 144),
    {_LINEAR.format(v='rest', src='sx')}
    select series, t, {r('coalesce(value, filled + season)', 8)} as filled from li""",
)
def impute_seasonal(spark, folder):
    out = impute.impute_seasonal(grid_series(spark, folder), BY, "slot", "value", DAY_SLOTS)
    return rounded(out.select("series", "t", "filled"), 8)


# Least costs for 0 to 5 breaks, place by place, with the same shortest segment and BIC.
# Series ending in _run are running sums of the daily means, which do shift their level.
_RUN = "dr as (select series, slot, t, sum(value) over (partition by series order by slot) as value from d)"
_BOTH = f"""{daily_sql()}, {_RUN}, bsrc as (select series, slot, t, value from d
  union all select series || '_run', slot, t, value from dr)"""
_ONLY_RUN = f"{daily_sql()}, {_RUN}, bsrc as (select * from dr)"
_MOST_BREAKS = 5
_COST = "p.s2 - a.s2 - (p.s1 - a.s1) * (p.s1 - a.s1) / (p.i - a.i)"
_LEVELS = ",\n".join(
    f"""l{m} as (select p.series, p.i, min(a.best + {_COST}) as best, arg_min(a.i, (a.best + {_COST}, a.i)) as origin
  from ps p join (select l.*, s1, s2 from l{m - 1} l join ps using (series, i)) a
    on a.series = p.series and a.i >= {m} * p.h and p.i - a.i >= p.h where p.i >= {m + 1} * p.h group by 1, 2)"""
    for m in range(1, _MOST_BREAKS + 1)
)
_FITS = " union all ".join(
    f"select series, {m} as m, n * ln(greatest(best, 2.2250738585072014e-308)) + ln(n) * {2 * (m + 1)} as bic, n "
    f"from l{m} join en using (series) where i = n" for m in range(_MOST_BREAKS + 1)
)
_BACK = ",\n".join(
    f"""c{m} as (select c.series, c.m, case when c.m >= {m} then l.origin else c.i end as i
  from c{m + 1} c left join l{m} l on l.series = c.series and l.i = c.i)""" for m in range(_MOST_BREAKS, 0, -1)
)
_ENDS = " union ".join(f"select series, i from c{m}" for m in range(1, _MOST_BREAKS + 2))
_BREAKS = f"""
pt as (select series, t, value, row_number() over (partition by series order by slot) as i,
  count(*) over (partition by series) as n,
  avg(value) over (partition by series) as mu from bsrc where value is not null),
ps as (select *, sum(value - mu) over w as s1, sum((value - mu) * (value - mu)) over w as s2,
  greatest(cast(floor(n * 0.15) as bigint), 2) as h from pt window w as (partition by series order by i)),
en as (select distinct series, n from ps),
l0 as (select series, i, s2 - s1 * s1 / i as best, 0 as origin from ps),
{_LEVELS},
c{_MOST_BREAKS + 1} as (select series, m, n as i from (
  select *, row_number() over (partition by series order by bic, m) as rn from ({_FITS})) where rn = 1),
{_BACK},
ends as (select distinct series, i from ({_ENDS})),
seg as (select p.series, p.t, p.value, 1 + (select count(*) from ends e where e.series = p.series and e.i < p.i) as segment from ps p),
segments as (select series, cast(segment as int) as segment, min(t) as from_t, max(t) as to_t, count(*) as n_points,
  avg(value) as mean from seg group by 1, 2)"""


def _running(spark, folder):
    return _run_of(daily_series(spark, folder))


def _run_of(daily):
    d = running_total(daily, "t", "value", BY, "run")
    return d.select("series", "t", F.col("run").alias("value"))


def _breaks(spark, folder):
    return settle(breaks.mean_breakpoints(_running(spark, folder), BY, "t", "value"), "segments")


@register(
    "mean_breakpoints",
    f"with {_BOTH}, {_BREAKS} select series, segment, from_t, to_t, n_points, {r('mean')} as mean from segments",
)
def mean_breakpoints(spark, folder):
    daily = daily_series(spark, folder)
    run = _run_of(daily).withColumn("series", F.concat("series", F.lit("_run")))
    both = daily.select("series", "t", "value").unionByName(run)
    return rounded(breaks.mean_breakpoints(both, BY, "t", "value"))


#: Normal tail in logarithms: steps of 1/1024 up to 16, the series of its end beyond.
_LOG_TAIL = """nd as (select i, exp(-(i / 1024.0e0) * (i / 1024.0e0) / 2) / sqrt(2 * pi()) as f from (select unnest(generate_series(0, 20480)) as i)),
    nt as materialized (select i, (sum(f) over (order by i desc rows unbounded preceding) - f / 2) / 1024 as p, f from nd)"""


def _log_tail(z: str, cell: str) -> str:
    return f"""(case when {z} > 16 then -{z} * {z} / 2 - ln({z} * sqrt(2 * pi())) + ln(1 - 1 / ({z} * {z}) + 3 / pow({z}, 4)) else
        ln({cell}.p - {cell}.f * ({z} - {cell}.i / 1024.0e0) + {cell}.f * {cell}.i / 1024.0e0 * ({z} - {cell}.i / 1024.0e0) * ({z} - {cell}.i / 1024.0e0) / 2) end)"""


_BELOW = f"""1 - (1 + exp(-x / (8 * q)) * root / sqrt(2 * pi()) + (2 * q + 1) / q / (1 + q) * exp(x * (1 + q) / 2 + {_log_tail('(root * (q + 0.5))', 'c1')})
      - ((2 * q + 1) * (2 * q + 1) / ((1 + q) * q) - 2 + x / (2 * q)) * exp({_log_tail('(root / 2)', 'c2')}))"""


@register(
    "break_intervals",
    f"""with recursive {_ONLY_RUN}, {_BREAKS}, {_LOG_TAIL},
    st as (select series, segment, count(*) as n, avg(value) as m, var_pop(value) as s from seg group by 1, 2),
    sx as (select *, sum(n) over (partition by series order by segment) as i, sum(n) over (partition by series) as n_all,
      lead(m) over (partition by series order by segment) - m as shift, lead(s) over (partition by series order by segment) as s2 from st),
    sy as (select *, greatest(s, greatest(s, s2) * 1e-9) as a, greatest(s2, greatest(s, s2) * 1e-9) as b from sx where shift is not null),
    hv as (
      select series, segment, side, q, 0.0e0 as lo, 200.0e0 * (1 + q) * (1 + q) as hi, 0 as k from (
        select series, segment, 0 as side, b / a as q from sy union all select series, segment, 1, a / b from sy) union all
      select series, segment, side, q, case when v > 0.025e0 then x else lo end, case when v > 0.025e0 then hi else x end, k + 1 from (
        select h.*, {_BELOW} as v from (select *, (lo + hi) / 2 as x, sqrt((lo + hi) / 2 / q) as root from hv where k < 60) h
          left join nt c1 on c1.i = cast(round(root * (q + 0.5) * 1024) as bigint) left join nt c2 on c2.i = cast(round(root / 2 * 1024) as bigint))),
    rc as (select series, segment, max(case when side = 0 then (lo + hi) / 2 end) as r0, max(case when side = 1 then (lo + hi) / 2 end) as r1
      from hv where k = 60 group by 1, 2),
    bd as (select sy.series, sy.segment, shift, i, greatest(i - ceil(r0 * a / (shift * shift)), 1) as l, least(i + ceil(r1 * b / (shift * shift)), n_all) as u
      from sy join rc using (series, segment))
    select bd.series, cast(segment as int) as segment, {r('shift', 5)} as shift, x.t as lower_t, y.t as place_t, z.t as upper_t, cast(l as bigint) as n_lower,
      cast(bd.i as bigint) as n_place, cast(u as bigint) as n_upper
    from bd join ps x on x.series = bd.series and x.i = l join ps y on y.series = bd.series and y.i = bd.i join ps z on z.series = bd.series and z.i = u""",
)
def break_intervals(spark, folder):
    run = settle(_running(spark, folder), "run")
    segments = settle(breaks.mean_breakpoints(run, BY, "t", "value"), "segments")
    return rounded(breaks.break_intervals(run, BY, "t", "value", segments), 5)


@register(
    "assign_segments",
    f"""with {_ONLY_RUN}, {_BREAKS} select e.series, cast(coalesce(s.segment, 1) as int) as segment, count(*) as n,
      {r('avg(e.value)')} as mean
    from e left join (select *, lead(from_t) over (partition by series order by segment) as until from segments) s
      on s.series = e.series and (e.ts >= s.from_t or s.segment = 1) and (s.until is null or e.ts < s.until)
    group by 1, 2""",
)
def assign_segments(spark, folder):
    e = series_events(spark, folder)
    placed = breaks.assign_segments(e, _breaks(spark, folder), BY, F.col("ts"))
    return rounded(placed.groupBy("series", "segment").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@register(
    "impute_timeslot_median",
    f"""with {_ONLY_RUN}, {_BREAKS}, {grid_sql().replace('e as (', 'e2 as (').replace('sl as', 'sl2 as').replace('from sl', 'from sl2').replace('join sl ', 'join sl2 ')},
    gs as (select g.series, g.slot, g.t, g.value, coalesce(s.segment, 1) as segment, g.slot % 144 // 3 as half_hour
      from g left join (select *, lead(from_t) over (partition by series order by segment) as until from segments) s
      on s.series = g.series and (g.t >= s.from_t or s.segment = 1) and (s.until is null or g.t < s.until)),
    md as (select series, segment, half_hour, median(value) as med from gs group by 1, 2, 3)
    select series, t, cast(segment as int) as segment, {r('coalesce(value, med)')} as filled
    from gs join md using (series, segment, half_hour)""",
)
def impute_timeslot_median(spark, folder):
    g = breaks.assign_segments(grid_series(spark, folder), _breaks(spark, folder), BY, F.col("t"))
    g = g.withColumn("half_hour", F.floor(F.col("slot") % DAY_SLOTS / HALF_HOUR_SLOTS))
    out = impute.impute_median(g, ["series", "segment", "half_hour"], "value")
    return rounded(out.select("series", "t", "segment", "filled"))


@register(
    "raw_vs_imputed",
    f"""with {grid_sql()}, {_LINEAR.format(v='value', src='g')},
    dy as (select series, cast(t as date) as date, avg(value) as raw_mean, avg(filled) as filled_mean from li group by 1, 2),
    lg as (select series, date, 'raw_mean' as kind, raw_mean as value from dy union all
      select series, date, 'filled_mean', filled_mean from dy)
    select series, date, kind, {r('value')} as value,
      {r('sum(value) over (partition by series, kind order by date)', 4)} as cum_value from lg""",
)
def raw_vs_imputed(spark, folder):
    filled = impute.impute_linear(grid_series(spark, folder), BY, "slot", "value")
    out = impute.compare_daily(filled, BY, F.to_date("t"), "value", "filled")
    return rounded(out, cum_value=4)


@register(
    "raw_vs_imputed_overall",
    f"""with {grid_sql()}, {_LINEAR.format(v='value', src='g')},
    dy as (select cast(t as date) as date, avg(value) as raw_mean, avg(filled) as filled_mean from li group by 1),
    lg as (select date, 'raw_mean' as kind, raw_mean as value from dy union all select date, 'filled_mean', filled_mean from dy)
    select date, kind, {r('value')} as value, {r('sum(value) over (partition by kind order by date)', 4)} as cum_value from lg""",
)
def raw_vs_imputed_overall(spark, folder):
    filled = impute.impute_linear(grid_series(spark, folder), BY, "slot", "value")
    out = impute.compare_daily(filled, [], F.to_date("t"), "value", "filled")
    return rounded(out, cum_value=4)


@register(
    "autocorrelation",
    f"""with {daily_sql()}, c as (select series, slot, value - avg(value) over (partition by series) as x from d),
    z as (select series, sum(x * x) as c0 from c group by 1)
    select a.series, cast(k as int) as lag, {r('sum(a.x * b.x) / max(c0)')} as acf
    from c a join (select unnest(generate_series(1, 10)) as k) on true
    join c b on b.series = a.series and b.slot = a.slot - k join z on z.series = a.series group by 1, 2""",
)
def autocorrelation(spark, folder):
    return rounded(signal.autocorrelation(daily_series(spark, folder), BY, "slot", "value", 10))


@register(
    "ar1_fit",
    f"""with {daily_sql()}, p as (select series, value as y, lag(value) over (partition by series order by slot) as x from d),
    f as (select series, regr_count(y, x) as n, regr_slope(y, x) as phi, regr_intercept(y, x) as c,
      regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x) as rss from p group by 1)
    select series, cast(n as bigint) as n_pairs, {r('phi')} as phi, {r('c / (1 - phi)')} as mean, {r('rss / n', 4)} as sigma2 from f""",
)
def ar1_fit(spark, folder):
    return rounded(signal.ar1_fit(daily_series(spark, folder), BY, "slot", "value"), sigma2=4)


@register(
    "trend_forecast",
    f"""with {daily_sql()}, x as (select series, value, row_number() over (partition by series order by slot) as i from d),
    f as (select series, regr_slope(value, i) as slope, regr_intercept(value, i) as a, max(i) as n from x group by 1)
    select series, n + h as idx, {r('slope')} as slope, {r('a')} as intercept, {r('a + slope * (n + h)')} as forecast
    from f, (select unnest(generate_series(1, 14)) as h)""",
)
def trend_forecast(spark, folder):
    d = with_index(daily_series(spark, folder), BY)
    return rounded(signal.trend_forecast(d, BY, "idx", "value", 14))


@register(
    "decompose_additive",
    f"""with {daily_sql()}, m as (select *, slot - min(slot) over (partition by series) as i,
      case when count(value) over w = 7 then sum(value) over w / 7 end as trend
      from d window w as (partition by series order by slot rows between 3 preceding and 3 following)),
    ef as (select series, i % 7 as pos, avg(value - trend) as eff from m group by 1, 2),
    se as (select series, pos, eff - avg(eff) over (partition by series) as seasonal from ef)
    select m.series, t, {r('trend')} as trend, {r('seasonal')} as seasonal, {r('value - trend - seasonal')} as remainder
    from m join se on se.series = m.series and se.pos = m.i % 7""",
)
def decompose_additive(spark, folder):
    out = signal.decompose_additive(daily_series(spark, folder), BY, "slot", "value", 7)
    return rounded(out.select("series", "t", "trend", "seasonal", "remainder"))
