"""Statistics with their probabilities; the SQL integrates the densities instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import E_SERIES, daily_sql, grid_sql, r, registry, rounded
from seriesframe.operators import models as op, signal
from seriesframe.operators.grid import densify, with_index
from seriesframe.plans.sheets import daily_series, series_events, table

QUERIES, SQL, register = registry()
BY = ["series"]
_CELLS = 40_000


def _beta_sql(source: str, keys: list[str], a: str, b: str, x: str, name: str) -> str:
    """Incomplete beta function by the midpoint rule over the angle whose squared sine runs from 0 to x."""
    angle = f"(i - 0.5e0) * h"
    return f"""
    {name} as (select {', '.join(keys)}, sum(exp((2 * a - 1) * ln(sin({angle})) + (2 * b - 1) * ln(cos({angle})) + lgamma(a + b) - lgamma(a) - lgamma(b)
        + ln(2.0e0))) * max(h) as p
      from (select {', '.join(keys)}, {a} as a, {b} as b, asin(sqrt({x})) / {_CELLS} as h from {source}), (select unnest(generate_series(1, {_CELLS})) as i) group by {', '.join(keys)})"""


_GROUPS = """g as (select series, count(*) as n, avg(value) as m, var_pop(value) as v from e group by 1),
    t as (select sum(n) as tot, count(*) as k, sum(n * m) / sum(n) as mu, sum(n * v) / (sum(n) - count(*)) as ms from g)"""


@register(
    "anova_test",
    f"""with {E_SERIES}, {_GROUPS},
    s as (select 1 as one, sum(n * (m - mu) * (m - mu)) as ssb, sum(n * v) as ssw, max(k) - 1.0e0 as d1, max(tot) - max(k) * 1.0e0 as d2 from g, t),
    f as (select *, (ssb / d1) / (ssw / d2) as f from s), {_beta_sql('f', ['one'], 'd2 / 2', 'd1 / 2', 'd2 / (d2 + d1 * f)', 'pv')}
    select cast(d1 as bigint) as df_between, cast(d2 as bigint) as df_within, {r('ssb', 3)} as ss_between, {r('ssw', 3)} as ss_within,
      {r('f')} as f_value, {r('p', 5)} as p_value from f join pv using (one)""",
)
def anova_test(spark, folder):
    return rounded(op.anova_test(series_events(spark, folder), "value", "series"), ss_between=3, ss_within=3, p_value=5)


#: Normal distribution in steps of 1/2048, from which any place is two terms away.
_NORMAL = """nd as (select i, exp(-(i / 2048.0e0) * (i / 2048.0e0) / 2) / sqrt(2 * pi()) as f from (select unnest(generate_series(-36864, 20480)) as i)),
    nc as materialized (select i, f, (sum(f) over (order by i rows unbounded preceding) - f / 2) / 2048 as c from nd)"""


def _range_sql(points: str, name: str) -> str:
    """Tail of the studentised range for points (id, q, k, d) by sums over the spread s and the place z of the largest number."""
    return f"""{name}_n as (select id, q, k, d, z / 12.0e0 as z, s, w from (
        select id, q, k, d, exp(u) as s, exp(d / 2 * ln(d / 2) + ln(2.0e0) - lgamma(d / 2) + d * u - d * exp(2 * u) / 2) * h as w
        from (select *, 9 / sqrt(2 * d) / 100 * i as u, 9 / sqrt(2 * d) / 100 as h from {points}, (select unnest(generate_series(-100, 100)) as i))),
      (select unnest(generate_series(-96, 96)) as z)),
    {name}_c as (select a.*, nc.c + nc.f * (z - q * s - nc.i / 2048.0e0) as under from (
        select *, cast(round((z - q * s) * 2048) as bigint) as cell from {name}_n) a left join nc on nc.i = a.cell),
    {name} as (select id, 1 - sum(w * inner_p) as p from (
        select id, s, max(w) as w, sum(k * exp(-z * z / 2) / sqrt(2 * pi()) / 12 * pow(greatest(b.c - coalesce(under, 0), 0), k - 1)) as inner_p
        from {name}_c join nc b on b.i = cast(round(z * 2048) as bigint) group by 1, 2) group by 1)"""


@register(
    "tukey_test",
    f"""with {E_SERIES}, {_GROUPS}, {_NORMAL},
    pr as (select a.series as group_a, b.series as group_b, b.m - a.m as diff, sqrt(ms / 2 * (1 / a.n + 1 / b.n)) as se,
        row_number() over (order by a.series, b.series) as id, t.k * 1.0e0 as k, tot - t.k * 1.0e0 as d
      from g a join g b on a.series < b.series, t),
    pt as (select id, abs(diff) / se as q, k, d from pr),
    {_range_sql('pt', 'rp')},
    cq as (select id, 3.0e0 + id * 0.002e0 as q, (select max(k) from pr) as k, (select max(d) from pr) as d from (select unnest(generate_series(0, 900)) as id)),
    {_range_sql('cq', 'cp')},
    crit as (select max(q + 0.002e0 * (p - 0.05e0) / (p - after)) as q from (
      select q, p, lead(p) over (order by q) as after from cp join cq using (id)) where p > 0.05e0 and after <= 0.05e0)
    select group_a, group_b, {r('diff')} as diff, {r('diff - crit.q * se', 3)} as lower, {r('diff + crit.q * se', 3)} as upper, {r('p', 5)} as p_value
    from pr join rp using (id), crit""",
)
def tukey_test(spark, folder):
    return rounded(op.tukey_test(series_events(spark, folder), "value", "series"), lower=3, upper=3, p_value=5)


@register(
    "ols_test",
    f"""with l as (select l_returnflag as category, l_linestatus as status, l_discount as y, l_quantity as x from lineitem),
    f as (select category, status, row_number() over (order by category, status) as id, regr_count(y, x) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a,
        regr_sxx(y, x) as sxx, regr_avgx(y, x) as mx, regr_syy(y, x) - regr_slope(y, x) * regr_slope(y, x) * regr_sxx(y, x) as rss from l group by 1, 2),
    s as (select *, sqrt(rss / (n - 2) / sxx) as sb, sqrt(rss / (n - 2) * (1.0e0 / n + mx * mx / sxx)) as sa from f),
    {_beta_sql('s', ['id'], '(n - 2) / 2.0e0', '0.5e0', '(n - 2) / (n - 2 + b / sb * b / sb)', 'pb')},
    {_beta_sql('s', ['id'], '(n - 2) / 2.0e0', '0.5e0', '(n - 2) / (n - 2 + a / sa * a / sa)', 'pa')}
    select category, status, cast(n as bigint) as n, {r('b', 8)} as slope, {r('sb', 8)} as se_slope, {r('b / sb', 5)} as t_slope, {r('pb.p', 5)} as p_slope,
      {r('a', 7)} as intercept, {r('sa', 7)} as se_intercept, {r('a / sa', 4)} as t_intercept, {r('pa.p', 5)} as p_intercept
    from s join pb using (id) join pa using (id)""",
)
def ols_test(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("y"), F.col("l_quantity").alias("x")
    )
    out = op.ols_test(lines, ["category", "status"], "y", "x")
    return rounded(out, 5, slope=8, se_slope=8, intercept=7, se_intercept=7, t_intercept=4)


@register(
    "zero_inflation_test",
    f"""with {grid_sql(1800)}, c as (select series, coalesce(n, 0) as n from g),
    s as (select series, count(*) as n_rows, cast(sum(case when n = 0 then 1 else 0 end) as bigint) as n_zero, avg(n) as mean from c group by 1),
    x as (select *, power(n_zero - n_rows * exp(-mean), 2) / (n_rows * exp(-mean) * (1 - exp(-mean)) - n_rows * mean * exp(-mean) * exp(-mean)) as score from s),
    w as (select series, n_rows, n_zero, score, sqrt(score) as z from x),
    p as (select series, sum(exp(-u * u / 2) * h) * 2 / sqrt(2 * pi()) as p from (
      select series, z + (i - 0.5e0) * 12 / 20000 as u, 12.0e0 / 20000 as h from w, (select unnest(generate_series(1, 20000)) as i)) group by 1)
    select series, n_rows, n_zero, {r('score')} as score, {r('p')} as p_value from w join p using (series)""",
)
def zero_inflation_test(spark, folder):
    g = densify(series_events(spark, folder), "ts", 1800, BY, [F.count(F.lit(1)).alias("n")], {"n": 0}, reuse=False)
    return rounded(op.zero_test_p(g, BY, "n").select("series", "n_rows", "n_zero", "score", "p_value"))


def _t_sql(z: str, d: str) -> str:
    """t quantile from the normal one, four terms of the expansion in 1 / d."""
    terms = [f"({z} + ({z} * {z} * {z} + {z}) / (4 * {d})", f"(5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * {d} * {d})",
             f"(3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z}) / (384 * pow({d}, 3))",
             f"(79 * pow({z}, 9) + 776 * pow({z}, 7) + 1482 * pow({z}, 5) - 1920 * pow({z}, 3) - 945 * {z}) / (92160 * pow({d}, 4)))"]
    return " + ".join(terms)


# Normal quantiles of 0.9 and 0.975.
_Z = {"80": "1.2815515655446004e0", "95": "1.959963984540054e0"}


@register(
    "forecast_bounds",
    f"""with {daily_sql()}, x as (select series, value, row_number() over (partition by series order by slot) as i from d),
    f as (select series, regr_slope(value, i) as slope, regr_intercept(value, i) as a, max(i) as last, regr_count(value, i) as n, regr_avgx(value, i) as mx,
      regr_sxx(value, i) as sxx, regr_syy(value, i) - regr_slope(value, i) * regr_slope(value, i) * regr_sxx(value, i) as rss from x group by 1),
    s as (select *, last + h as idx, a + slope * (last + h) as forecast, sqrt(rss / (n - 2) * (1 + 1.0e0 / n + (last + h - mx) * (last + h - mx) / sxx)) as se
      from f, (select unnest(generate_series(1, 14)) as h))
    select series, idx, {r('slope')} as slope, {r('a')} as intercept, {r('forecast')} as forecast,
      {', '.join(f"{r(f'forecast - se * {_t_sql(z, '(n - 2.0e0)')}', 3)} as lower_{p}, {r(f'forecast + se * {_t_sql(z, '(n - 2.0e0)')}', 3)} as upper_{p}" for p, z in _Z.items())} from s""",
)
def forecast_bounds(spark, folder):
    d = with_index(daily_series(spark, folder), BY)
    out = signal.forecast_bounds(d, BY, "idx", "value", 14)
    return rounded(out, lower_80=3, upper_80=3, lower_95=3, upper_95=3)
