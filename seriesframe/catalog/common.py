"""Rounding on both sides, and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seriesframe.functions.lookups import DEFAULT_VOLUME, FISHED_VOLUME


def nudge(digits: int) -> float:
    """Small shift before rounding: means of cent values are often exact halves, which noise in
    the last bit would otherwise send up in one engine and down in the other."""
    return 3.7 * 10.0 ** -(digits + 4)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns, so sums in another order give the same digits."""

    def one(c: str):
        n = special.get(c, digits)
        return F.round(F.col(c) + nudge(n), n).alias(c)

    return df.select(*[one(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; never yields a negative zero."""
    return f"(round(cast({expr} as double) + {nudge(digits)!r}, {digits}) + 0.0)"


def registry():
    """Two dictionaries and a decorator that files a query with its SQL."""
    queries, sql = {}, {}

    def register(name: str, statement: str | None = None):
        def keep(fn):
            queries[name] = fn
            if statement:
                sql[name] = statement
            return fn

        return keep

    return queries, sql, register


#: Volume of a run length without an entry, by gear.
DEFAULTS = "case gear " + " ".join(f"when '{g}' then {v!r}e0" for g, v in DEFAULT_VOLUME.items()) + " end"
VOLUMES = ", ".join(f"('{g}', {s}, {v!r}e0)" for g, runs in FISHED_VOLUME.items() for s, v in runs.items())

# Sheets as common table expressions, the counterparts of plans/sheets.py.
EV_BASE = """
ev_base as (
  select o_orderkey as event, cast(o_orderdate as date) as date, o_orderpriority as bay,
    case o_orderstatus when 'F' then 'RST' when 'O' then 'Vertical' else 'IPT' end as gear,
    o_orderkey % 4 as released, 600 + 60 * (o_orderkey % 13) as run_s, o_orderkey % 3 * 6 as depth_ft
  from orders)"""
SPEC = """
sp as (
  select l_orderkey as event, l_returnflag as category, l_partkey, l_linenumber, l_quantity as length,
    l_discount as velocity, l_linestatus from lineitem)"""
EV = f"""{EV_BASE}, {SPEC},
ev as (
  select b.*, coalesce(n, 0) + released as total, velocity
  from ev_base b left join (
    select event, count(*) as n, avg(velocity) as velocity from sp group by 1
  ) s using (event))"""
DISCHARGE = """
discharge as (
  select cast(o_orderdate as date) as date, avg(abs(c_acctbal)) as mean_discharge
  from orders left join customer on o_custkey = c_custkey group by 1)"""
EXPANDED = f"""{EV},
ncat as (
  select event, category, count(distinct (l_partkey, l_linenumber)) as n_cat from sp group by 1, 2),
ex as (
  select ev.*, category, n_cat, n_cat / nullif(total - released, 0) as propn_obs,
    coalesce(n_cat + released * (n_cat / nullif(total - released, 0)), total) as n_exp
  from ev left join ncat using (event)),
vol(gear, run_s, v) as (values {VOLUMES}),
exv as (
  select ex.*, coalesce(v, {DEFAULTS}) as fished_vol, n_exp / coalesce(v, {DEFAULTS}) as cpue
  from ex left join vol using (gear, run_s))"""
E_SERIES = "e as (select event_id, ts, user_id, event_type as series, value from events)"


def grid_sql(step_s: int = 600, name: str = "g") -> str:
    """Dense grid of series means: columns series, slot, value, t."""
    return f"""
{E_SERIES},
sl as (select series, cast(floor(epoch(ts) / {step_s}) as bigint) as slot, avg(value) as value, count(*) as n
  from e group by 1, 2),
{name} as (
  select series, slot, value, n, make_timestamp(slot * {step_s} * 1000000) as t
  from (select series, slot from (select distinct series from sl),
        (select unnest(generate_series((select min(slot) from sl), (select max(slot) from sl))) as slot))
  left join sl using (series, slot))"""


def daily_sql(name: str = "d") -> str:
    """Dense daily means and totals: columns series, slot, value, total, t."""
    return f"""
{E_SERIES},
sl as (select series, cast(floor(epoch(ts) / 86400) as bigint) as slot, avg(value) as value, sum(value) as total
  from e group by 1, 2),
{name} as (
  select series, slot, value, total, make_timestamp(slot * 86400 * 1000000) as t
  from (select series, slot from (select distinct series from sl),
        (select unnest(generate_series((select min(slot) from sl), (select max(slot) from sl))) as slot))
  left join sl using (series, slot))"""


def sweep_sql(source: str, out: str, pivots: list[int], keys: list[str]) -> str:
    """Gauss-Jordan exchange of the pivots, one table each; matrices (keys, i, j, v) without a pivot's row stay."""
    tables, before = [], source
    same = lambda other: " and ".join(f"{other}.{k} is not distinct from a.{k}" for k in keys)
    for k in pivots:
        tables.append(f"""{out}{k} as materialized (
      select {', '.join(f'a.{c}' for c in keys)}, a.i, a.j, case when p.v is null then a.v when a.i = {k} and a.j = {k} then 1 / p.v
        when a.i = {k} then a.v / p.v when a.j = {k} then -a.v / p.v else a.v - c.v * w.v / p.v end as v
      from {before} a left join {before} p on {same('p')} and p.i = {k} and p.j = {k}
        left join {before} c on {same('c')} and c.i = a.i and c.j = {k}
        left join {before} w on {same('w')} and w.i = {k} and w.j = a.j)""")
        before = f"{out}{k}"
    return ",\n    ".join([*tables, f"{out} as materialized (select * from {before})"])
