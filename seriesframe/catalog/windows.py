"""Shares, cumulative curves, crossings and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import EV_BASE, SPEC, daily_sql, r, registry, rounded
from seriesframe.operators import relate, running, summarise
from seriesframe.plans.sheets import daily_series, event_base, specimen_sheet
from seriesframe.plans.timing import run_timing as timing
from seriesframe.sources.files import settle

QUERIES, SQL, register = registry()

_DAILY = f"""with {EV_BASE}, {SPEC},
d as (select date, category, sum(length) as n from sp join ev_base using (event) group by 1, 2)"""


def _catch_per_event(spark, folder):
    """Catch per event and category with its date. Specimens are summed up before the join, so an
    event with very many of them is a few rows by then."""
    days = event_base(spark, folder).select("event", "date")
    sums = specimen_sheet(spark, folder).groupBy("event", "category").agg(F.sum("length").alias("length"))
    return relate.join_keep_left(sums, days, ["event"], "inner")


def daily_catch(spark, folder):
    """Catch per day and category; the day comes from the event of each specimen."""
    return running.by_date(_catch_per_event(spark, folder), "date", "length", ["category"], "n")


@register(
    "share_of_group",
    f"""{_DAILY} select date, category, {r('n', 2)} as n, {r('n / sum(n) over (partition by date)')} as day_share,
      {r('n / sum(n) over ()', 10)} as season_share from d""",
)
def share_of_group(spark, folder):
    # Written once: the day's and the season's totals are read from it. A day has a handful of categories.
    d = settle(daily_catch(spark, folder), "daily")
    d = summarise.share_small(d, "n", ["date"], "day_share")
    out = summarise.share(d, "n", [], "season_share").select("date", "category", "n", "day_share", "season_share")
    return rounded(out, n=2, season_share=10)


@register(
    "cumulative_total",
    f"""{_DAILY}, t as (select date, sum(n) as n from d group by 1)
    select date, {r('n', 2)} as n, {r('sum(n) over (order by date)', 2)} as running from t""",
)
def cumulative_total(spark, folder):
    daily = running.by_date(daily_catch(spark, folder), "date", "n", [], "n")
    return rounded(running.running_total(daily, "date", "n", []), 2)


_CURVE = """c as (select *, sum(n) over (partition by category order by date) as running,
  sum(n) over (partition by category order by date) / sum(n) over (partition by category) as cum_share from d)"""


@register(
    "cumulative_share",
    f"""{_DAILY}, {_CURVE} select date, category, {r('n', 2)} as n, {r('running', 2)} as running,
      {r('cum_share')} as cum_share from c""",
)
def cumulative_share(spark, folder):
    curve = running.cumulative_share(daily_catch(spark, folder), "date", "n", ["category"])
    return rounded(curve.select("date", "category", "n", "running", "cum_share"), n=2, running=2)


_CROSS = f"""x as (select *, lag(cum_share) over w as y0, date_diff('day', date '1970-01-01', lag(date) over w) as d0,
    date_diff('day', date '1970-01-01', date) as d1 from c window w as (partition by category order by date)),
  h as (select category, date as cross_date,
    coalesce(d0 + (0.5 - y0) / (cum_share - y0) * (d1 - d0), d1) as cross_day,
    row_number() over (partition by category order by date) as rn
    from x where cum_share >= 0.5 and (y0 is null or y0 < 0.5))"""


@register(
    "crossing_date",
    f"{_DAILY}, {_CURVE}, {_CROSS} select category, cross_date, {r('cross_day', 4)} as cross_day from h where rn = 1",
)
def crossing_date(spark, folder):
    curve = running.cumulative_share(daily_catch(spark, folder), "date", "n", ["category"])
    return rounded(running.crossing(curve, "date", "cum_share", 0.5, ["category"]), 4)


@register(
    "run_timing",
    f"""{_DAILY}, {_CURVE}, {_CROSS},
    p as (select category, min(date) as peak_date, max(n) as peak_n from d
      where (category, n) in (select category, max(n) from d group by 1) group by 1)
    select e.category, first_date, last_date, {r('total', 2)} as total, peak_date, {r('peak_n', 2)} as peak_n,
      cross_date as half_date, {r('cross_day', 4)} as half_day
    from (select category, min(date) as first_date, max(date) as last_date, sum(n) as total from d where n > 0 group by 1) e
    left join p using (category) left join h on h.category = e.category and rn = 1""",
)
def run_timing(spark, folder):
    return rounded(timing(_catch_per_event(spark, folder), "date", "category", "length"), 2, half_day=4)


PEAKS_SQL = """
s as (select *, sign(x - lag(x) over w) as sg, lag(x) over w as px from src window w as (partition by grp order by t)),
k as (select *, case when sg is not distinct from lag(sg) over w then 0 else 1 end as nw from s
  window w as (partition by grp order by t)),
u as (select *, sum(nw) over (partition by grp order by t) as run from k),
st as (select grp, run, sg, arg_min(px, t) as x1, arg_max(x, t) as top, max(t) as t from u group by 1, 2, 3),
nx as (select *, lead(sg) over w as nsg, lead(top) over w as ntop from st window w as (partition by grp order by run)),
pk as (select grp, t, top as height, top - greatest(x1, ntop) as prominence from nx where sg = 1 and nsg = -1)"""


@register(
    "find_peaks",
    f"""with {daily_sql()}, src as (select series as grp, t, total as x from d), {PEAKS_SQL},
    rk as (select *, row_number() over (partition by grp order by height desc, t) as peak_rank from pk where prominence >= 4)
    select grp as series, t, {r('height', 4)} as height, {r('prominence', 4)} as prominence, cast(peak_rank as int) as peak_rank
    from rk where peak_rank <= 3""",
)
def find_peaks(spark, folder):
    return rounded(running.find_peaks(daily_series(spark, folder), "t", "total", ["series"], 3, 4.0), 4)
