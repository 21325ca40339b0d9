"""Multiple imputation of several columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import grid_sql, r, registry, rounded
from seriesframe.catalog.models import _normal_sql
from seriesframe.operators import chained, impute
from seriesframe.operators.relate import attach
from seriesframe.plans.sheets import grid_series

QUERIES, SQL, register = registry()
#: Columns that are filled from each other, copies and turns.
_COLUMNS, _COPIES, _ROUNDS = ("click", "purchase"), 2, 2


def _wide(spark, folder):
    """Slots with the mean of two kinds of events side by side, in halves of the season."""
    g = grid_series(spark, folder)
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("value"))).alias(s)
    wide = g.groupBy("slot").agg(*[pick(s) for s in _COLUMNS])
    ends = wide.agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
    place = attach(wide, ends, []).withColumn("idx", (F.col("slot") - F.col("_lo")) / 1000)
    half = F.when(F.col("slot") * 2 < F.col("_lo") + F.col("_hi"), "first").otherwise("second")
    return place.select(half.alias("half"), "slot", "idx", *_COLUMNS)


_SETUP = f"""{grid_sql()},
    wi as (select slot, {', '.join(f"max(case when series = '{s}' then value end) as {s}" for s in _COLUMNS)} from g group by 1),
    pl as (select case when slot * 2 < min(slot) over () + max(slot) over () then 'first' else 'second' end as half, slot,
      (slot - min(slot) over ()) / 1000.0e0 as idx, {', '.join(_COLUMNS)} from wi),
    s0 as materialized (select pl.*, m, {', '.join(f'coalesce({c}, avg({c}) over (partition by half, m)) as now_{c}' for c in _COLUMNS)}
      from pl, (select unnest(generate_series(1, {_COPIES})) as m))"""


def _turn(k: int, turn: int, y: str, other: str) -> str:
    tag = f"'1/{turn}/{y}'"
    z = lambda what: _normal_sql("half", "m", tag, f"'{what}'")
    n = "(n - 3)"
    return f"""
    a{k} as (select half, m, count(*) as n, avg(now_{y}) as my, avg(now_{other}) as m1, avg(idx) as m2, var_pop(now_{other}) * count(*) as s11,
        var_pop(idx) * count(*) as s22, covar_pop(now_{other}, idx) * count(*) as s12, covar_pop(now_{other}, now_{y}) * count(*) as t1,
        covar_pop(idx, now_{y}) * count(*) as t2, var_pop(now_{y}) * count(*) as tt from s{k} where {y} is not null group by 1, 2),
    b{k} as (select *, s11 * s22 - s12 * s12 as det, (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) as b1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) as b2 from a{k}),
    c{k} as (select *, sqrt((tt - b1 * t1 - b2 * t2) / {n}) * sqrt({n} / greatest({n} * power(1 - 2.0e0 / (9 * {n}) + {z('v')} * sqrt(2.0e0 / (9 * {n})), 3), 1e-9)) as sd,
      sqrt(s22 / det) as l11, -s12 / det / sqrt(s22 / det) as l21, sqrt(s11 / det - s12 / det * s12 / det / (s22 / det)) as l22 from b{k}),
    d{k} as materialized (select half, m, sd, my + {z('c')} * sd / sqrt(n) as level, m1, m2, b1 + sd * l11 * {z('b0')} as p1,
      b2 + sd * (l21 * {z('b0')} + l22 * {z('b1')}) as p2 from c{k}),
    s{k + 1} as materialized (select s.* exclude (now_{y}), case when {y} is null then level + p1 * (now_{other} - m1) + p2 * (idx - m2)
      + sd * {_normal_sql('half', 'm', 'slot', tag)} else now_{y} end as now_{y} from s{k} s join d{k} using (half, m))"""


_TURNS = [(t, y, o) for t in range(_ROUNDS) for y, o in (_COLUMNS, _COLUMNS[::-1])]
_CHAIN = _SETUP + "," + ",".join(_turn(k, t, y, o) for k, (t, y, o) in enumerate(_TURNS)) + f", done as (select * from s{len(_TURNS)})"


def _completed(spark, folder):
    return chained.impute_chained(_wide(spark, folder), ["half"], list(_COLUMNS), ["idx"], "slot", _COPIES, _ROUNDS, "norm")


@register(
    "impute_chained",
    f"with {_CHAIN} select half, slot, cast(m as int) as m, {', '.join(f'{c} is null as {c}_null' for c in _COLUMNS)}, "
    f"{', '.join(f'{r(f'now_{c}', 5)} as {c}' for c in _COLUMNS)} from done",
)
def impute_chained(spark, folder):
    out = _completed(spark, folder)
    seen = _wide(spark, folder).select("slot", *[F.col(c).isNull().alias(f"{c}_null") for c in _COLUMNS])
    return rounded(attach(out, seen, ["slot"]).select("half", "slot", "m", *[f"{c}_null" for c in _COLUMNS], *_COLUMNS), 5)


@register(
    "pool_chained",
    f"""with {_CHAIN}, f as (select half, m, regr_slope(now_click, idx) as q, (regr_syy(now_click, idx) - regr_slope(now_click, idx)
        * regr_slope(now_click, idx) * regr_sxx(now_click, idx)) / (regr_count(now_click, idx) - 2) / regr_sxx(now_click, idx) as u from done group by 1, 2)
    select half, count(*) as m_copies, {r('avg(q)', 5)} as estimate, {r('avg(u)', 6)} as within_var, {r('var_samp(q)', 6)} as between_var,
      {r('avg(u) + (1 + 1 / count(*)) * var_samp(q)', 6)} as total_var from f group by 1""",
)
def pool_chained(spark, folder):
    return rounded(impute.pool_estimates(_completed(spark, folder), ["half"], "click", "idx"), 6, estimate=5)
