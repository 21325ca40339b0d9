"""Non-linear fits of how often values of each size occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import E_SERIES, r, registry, rounded, sweep_sql
from seriesframe.operators import nonlinear
from seriesframe.plans.sheets import series_events

QUERIES, SQL, register = registry()
BY = ["series"]
STEP, AT = 10, 8.0


def size_counts(spark, folder):
    """Number of events of each series in steps of their value."""
    place = (F.floor(F.col("value") / STEP) + 1).cast("double")
    return series_events(spark, folder).groupBy("series", place.alias("x")).agg(F.count(F.lit(1)).alias("y"))


_POINTS = f"""{E_SERIES}, pt as materialized (select series, cast(floor(value / {STEP}) + 1 as double) as x, cast(count(*) as double) as y from e group by 1, 2)"""


def _zoom(shape: str, line: bool, low: float, high: float, levels: int = 4, cells: int = 60) -> str:
    """Tables z0 .. z{levels}: the best place of the one parameter that is not linear, in ever finer steps."""
    out = f"z0 as (select distinct series, {(low + high) / 2!r}::double as c from pt)"
    width = (high - low) / 2
    for k in range(1, levels + 1):
        if line:
            rss = "regr_syy(y, e) - regr_slope(y, e) * regr_slope(y, e) * regr_sxx(y, e)"
        else:
            rss = "sum(y * y) - sum(y * e) * sum(y * e) / sum(e * e)"
        out += f""",
    z{k} as materialized (select series, arg_min(c, rss) as c from (
      select series, c, {rss} as rss from (select pt.series, c, y, {shape} as e from pt join (
        select series, c + {width / cells!r}::double * j as c from z{k - 1}, (select unnest(generate_series(-{cells}, {cells})) as j)) using (series)) group by 1, 2) group by 1)"""
        width = 2 * width / cells
    return out


def _newton(start: str, value: str, slopes: list[str], steps: int = 4) -> str:
    """Plain Gauss-Newton steps from close by, then the last sums: parameters q{steps}, sums s{steps} after the exchange."""
    size = len(slopes)
    out = f"q0 as ({start})"
    for k in range(steps + 1):
        out += f""",
    j{k} as (select series, x, unnest([0, {', '.join(map(str, range(1, size + 1)))}]) as i, unnest([y - ({value}), {', '.join(slopes)}]) as v
      from pt join q{k} using (series)),
    g{k} as (select a.series, a.i, b.i as j, sum(a.v * b.v) as v from j{k} a join j{k} b using (series, x) group by 1, 2, 3),
    {sweep_sql(f'g{k}', f's{k}_', list(range(1, size + 1)), ['series'])}"""
        if k < steps:
            moved = ", ".join(f"max(p{i}) + max(case when s.i = {i} and s.j = 0 then v end) as p{i}" for i in range(1, size + 1))
            out += f""",
    q{k + 1} as materialized (select series, {moved} from s{k}_ s join q{k} using (series) group by 1)"""
    return out


def _fit_sql(names: list[str], zoom: str, start: str, value: str, slopes: list[str], steps: int = 4) -> str:
    size = len(names)
    return f"""with {_POINTS}, {zoom},
    {_newton(start, value, slopes, steps)},
    nn as (select series, count(*) as n, var_pop(y) * count(*) as tss from pt group by 1),
    f as (select series, max(case when i = 0 and j = 0 then v end) as sse, {', '.join(f'max(case when i = {k} and j = {k} then v end) as i{k}' for k in range(1, size + 1))}
      from s{steps}_ group by 1)
    select series, {', '.join(f'{r(f"p{k}", 4)} as {c}' for k, c in enumerate(names, 1))},
      {', '.join(f'{r(f"sqrt(i{k} * sse / (n - {size}))", 4)} as se_{c}' for k, c in enumerate(names, 1))}, cast(n as bigint) as n, {r('sse', 3)} as sse,
      {r("(1 - sse / tss) / (1 - exp(-(ln(2 * pi() * tss / n) + 1)))")} as r2_max, true as converged
    from q{steps} join f using (series) join nn using (series)"""


def _fitted(spark, folder, curve):
    return rounded(nonlinear.fit_curve(size_counts(spark, folder), BY, "y", "x", curve).drop("steps"), 4, sse=3, r2_max=6)


@register(
    "fit_power",
    _fit_sql(
        ["a", "b"], _zoom("pow(x, c)", False, -6.0, 2.0),
        "select series, sum(y * pow(x, c)) / sum(pow(x, 2 * c)) as p1, max(c) as p2 from pt join z4 using (series) group by 1",
        "p1 * pow(x, p2)", ["pow(x, p2)", "p1 * pow(x, p2) * ln(x)"],
    ),
)
def fit_power(spark, folder):
    return _fitted(spark, folder, nonlinear.POWER)


_E = "exp(-exp(p3) * x)"


@register(
    "fit_asymptote",
    _fit_sql(
        ["asymptote", "origin", "log_rate"], _zoom("exp(-exp(c) * x)", True, -5.0, 2.0),
        """select series, regr_intercept(y, exp(-exp(c) * x)) as p1, regr_intercept(y, exp(-exp(c) * x)) + regr_slope(y, exp(-exp(c) * x)) as p2, max(c) as p3
      from pt join z4 using (series) group by 1""",
        f"p1 + (p2 - p1) * {_E}", [f"1 - {_E}", _E, f"(p1 - p2) * exp(p3) * x * {_E}"],
    ),
)
def fit_asymptote(spark, folder):
    return _fitted(spark, folder, nonlinear.ASYMPTOTE)


_L = f"exp(-p3 * (x - {AT!r}))"


@register(
    "fit_plateau",
    _fit_sql(
        ["a", "b", "c"], _zoom(f"exp(-c * (x - {AT!r}))", True, 0.001, 2.0),
        f"""select series, regr_intercept(y, exp(-c * (x - {AT!r}))) as p1, regr_slope(y, exp(-c * (x - {AT!r}))) as p2, max(c) as p3
      from pt join z4 using (series) group by 1""",
        f"p1 + p2 * {_L}", ["1.0e0", _L, f"-p2 * (x - {AT!r}) * {_L}"],
    ),
)
def fit_plateau(spark, folder):
    return _fitted(spark, folder, nonlinear.plateau(AT))
