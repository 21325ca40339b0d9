"""Decomposition, smoothing and order search of gridded series."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import grid_sql, r, registry, rounded, sweep_sql
from seriesframe.operators import arma, smooth, states
from seriesframe.operators.grid import densify
from seriesframe.operators.relate import attach
from seriesframe.plans.sheets import series_events

QUERIES, SQL, register = registry()
BY = ["series"]
HOUR, DAY = 3600, 24


def hourly_series(spark, folder):
    """Mean value per series and hour of the whole season."""
    return densify(series_events(spark, folder), "ts", HOUR, BY, [F.avg("value").alias("value")])


def _line_sql(name: str, source: str, reach: int, step: int = 1, places: str = "g") -> str:
    """Weighted local line of ``source`` (series, slot, v) at the slots of ``places``."""
    weight = f"pow(1 - pow(abs(j) / {reach + 1}.0e0, 3), 3)"
    return f"""
    {name} as (select series, slot, case when s0 * s2 - s1 * s1 > {smooth.FLAT!r} * s0 * s2 then (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1)
        else t0 / s0 end as v
      from (select a.series, a.slot, sum(w) as s0, sum(w * j) as s1, sum(w * j * j) as s2, sum(w * y.v) as t0, sum(w * j * y.v) as t1
        from (select series, slot, j, {weight} as w from {places}, (select unnest(generate_series({-reach}, {reach})) as j)) a
        join {source} y on y.series = a.series and y.slot = a.slot + j * {step} and y.v is not null group by 1, 2))"""


def _decompose_sql(period: int, season: int, low: int, trend: int, rounds: int) -> str:
    """Tables t (trend) and s (season) after all rounds, from the grid g."""
    weights = ", ".join(repr(float(w)) for w in smooth.low_pass(period))
    out = f"""ends as (select series, min(slot) as lo, max(slot) as hi from g group by 1),
    ext as (select series, unnest(generate_series(lo - {period}, hi + {period})) as slot from ends),
    wt as (select unnest([{weights}]) as w, unnest(generate_series({-period}, {period})) as j),
    t0 as (select series, slot, 0.0e0 as v from g)"""
    for k in range(rounds):
        out += f""",
    x{k} as (select series, slot, value - t{k}.v as v from g left join t{k} using (series, slot)),"""
        out += _line_sql(f"c{k}", f"x{k}", season, period, "ext")
        out += f""",
    l{k} as (select g.series, g.slot, sum(w * c.v) / sum(w) as v
      from g, wt, c{k} c where c.series = g.series and c.slot = g.slot + j group by 1, 2),"""
        out += _line_sql(f"m{k}", f"l{k}", low)
        out += f""",
    s{k} as (select g.series, g.slot, coalesce(c.v - m.v, 0) as v from g left join c{k} c using (series, slot) left join m{k} m using (series, slot)),
    d{k} as (select series, slot, value - s{k}.v as v from g join s{k} using (series, slot)),"""
        out += _line_sql(f"t{k + 1}", f"d{k}", trend)
    return out + f""",
    s as (select * from s{rounds - 1}),
    t as (select * from t{rounds})"""


_DAILY_CYCLE = {"period": DAY, "season": 5, "low": 12, "trend": 21, "rounds": 2}


@register(
    "decompose_local",
    f"""with {grid_sql(HOUR)}, {_decompose_sql(**_DAILY_CYCLE)}
    select g.series, g.t, {r('t.v')} as trend, {r('s.v')} as seasonal, {r('value - t.v - s.v')} as remainder
    from g left join t using (series, slot) left join s using (series, slot)""",
)
def decompose_local(spark, folder):
    out = smooth.decompose_local(hourly_series(spark, folder), BY, "slot", "value", DAY)
    return rounded(out.select("series", "t", "trend", "seasonal", "remainder"))


_REST = """rs as (select g.series, g.slot, g.t, g.value, s.v as season, value - s.v as rest from g join s using (series, slot)),
    nb as (select *, last_value(case when rest is not null then slot end ignore nulls) over b as ps, last_value(rest ignore nulls) over b as pv,
        first_value(case when rest is not null then slot end ignore nulls) over f as ns, first_value(rest ignore nulls) over f as nv
      from rs window b as (partition by series order by slot rows between unbounded preceding and current row),
        f as (partition by series order by slot rows between current row and unbounded following))"""


@register(
    "impute_local_season",
    f"""with {grid_sql(HOUR)}, {_decompose_sql(**_DAILY_CYCLE)}, {_REST}
    select series, t, value is null as was_null,
      {r('coalesce(value, coalesce(pv + (nv - pv) * ((slot - ps) / nullif(ns - ps, 0)), pv, nv) + season)')} as filled from nb""",
)
def impute_local_season(spark, folder):
    out = smooth.impute_local_season(hourly_series(spark, folder), BY, "slot", "value", DAY)
    return rounded(out.select("series", "t", F.col("value").isNull().alias("was_null"), "filled"))


def _aicc_sql(n: str, rss: str, k: str) -> str:
    return f"{n} * (ln(2 * pi()) + ln({rss} / {n}) + 1) + 2 * {k} + 2.0e0 * {k} * ({k} + 1) / ({n} - {k} - 1)"


_ARMA_P, _ARMA_D, _ARMA_Q, _ARMA_LONG = 3, 1, 2, 6
_ARMA_REACH = _ARMA_D + _ARMA_Q + _ARMA_LONG
_ARMA_LAGS = ", ".join(f"lag(value, {k}) over w as z{k}" for k in range(1, _ARMA_REACH + 1))
_ARMA_ALL = " and ".join(f"z{k} is not null" for k in range(_ARMA_REACH + 1))
_ARMA_U = " union all ".join(
    f"select series, slot, {d} as d, {j} as j, {f'z{j}' if d == 0 else f'z{j} - z{j + 1}'} as v from z"
    for d in (0, 1) for j in range(_ARMA_Q + _ARMA_LONG + 1)
)


@register(
    "arma_orders",
    f"""with {grid_sql(HOUR)}, za as (select series, slot, value as z0, {_ARMA_LAGS} from g window w as (partition by series order by slot)),
    z as (select * from za where {_ARMA_ALL}), nn as (select series, count(*) as n from z group by 1), u as ({_ARMA_U}),
    lg as (select a.series, a.d, a.j as i, b.j, covar_pop(a.v, b.v) * count(*) as v from u a join u b using (series, d, slot)
      where a.j <= {_ARMA_LONG} and b.j <= {_ARMA_LONG} group by 1, 2, 3, 4),
    {sweep_sql('lg', 'la', list(range(1, _ARMA_LONG + 1)), ['series', 'd'])},
    um as (select series, d, j, avg(v) as mu from u group by 1, 2, 3),
    lc as (select la.series, la.d, la.i as k, la.v as a from la where la.j = 0 and la.i > 0),
    l0 as (select series, d, (select mu from um where um.series = lc.series and um.d = lc.d and um.j = 0) - sum(a * mu) as c
      from lc join um using (series, d) where um.j = lc.k group by 1, 2),
    sh as (select u.series, u.d, u.slot, q.q, sum(lc.a * u.v) as fit from u join (select unnest(generate_series(1, {_ARMA_Q})) as q) q on true
      join lc on lc.series = u.series and lc.d = u.d and u.j = q.q + lc.k group by 1, 2, 3, 4),
    x as (select series, d, slot, j as i, v from u where j <= {_ARMA_P} union all
      select u.series, u.d, u.slot, {_ARMA_P} + q, u.v - c - fit from sh join u on u.series = sh.series and u.d = sh.d and u.slot = sh.slot
        and u.j = sh.q join l0 on l0.series = u.series and l0.d = u.d),
    xm as (select series, d, i, avg(v) as mu from x group by 1, 2, 3),
    xg as (select a.series, a.d, a.i, b.i as j, covar_pop(a.v, b.v) * count(*) as v from x a join x b using (series, d, slot) group by 1, 2, 3, 4),
    md as (select p, q from (select unnest(generate_series(0, {_ARMA_P})) as p), (select unnest(generate_series(0, {_ARMA_Q})) as q)),
    mg as (select xg.*, p, q from xg, md where (i <= p or i between {_ARMA_P + 1} and {_ARMA_P} + q)
      and (j <= p or j between {_ARMA_P + 1} and {_ARMA_P} + q)),
    {sweep_sql('mg', 'ms', list(range(1, _ARMA_P + _ARMA_Q + 1)), ['series', 'd', 'p', 'q'])},
    co as (select ms.series, ms.d, p, q, max(case when ms.i = 0 then ms.v end) as rss,
      max(case when ms.i = 0 then mu end) - coalesce(sum(case when ms.i > 0 then ms.v * mu end), 0) as intercept,
      {', '.join(f'max(case when ms.i = {k} then ms.v end) as ar{k}' for k in (1, 2, 3))},
      {', '.join(f'max(case when ms.i = {_ARMA_P + k} then ms.v end) as ma{k}' for k in (1, 2))}
      from ms join xm on xm.series = ms.series and xm.d = ms.d and xm.i = ms.i where ms.j = 0 group by 1, 2, 3, 4),
    sc as (select *, {_aicc_sql('n', 'rss', '(p + q + 2)')} as aicc from co join nn using (series))
    select series, cast(p as bigint) as p, cast(d as bigint) as d, cast(q as bigint) as q, cast(n as bigint) as n, {r('intercept', 5)} as intercept,
      {', '.join(f'{r(c, 5)} as {c}' for c in ('ar1', 'ar2', 'ar3', 'ma1', 'ma2'))}, {r('rss / n', 4)} as sigma2, {r('aicc', 4)} as aicc,
      cast(row_number() over (partition by series order by aicc, p, d, q) as int) as model_rank from sc""",
)
def arma_orders(spark, folder):
    out = arma.arma_orders(hourly_series(spark, folder), BY, "slot", "value", _ARMA_P, _ARMA_D, _ARMA_Q, _ARMA_LONG)
    ar = [F.get("ar", F.lit(k)).alias(f"ar{k + 1}") for k in range(_ARMA_P)]
    ma = [F.get("ma", F.lit(k)).alias(f"ma{k + 1}") for k in range(_ARMA_Q)]
    return rounded(out.select("series", "p", "d", "q", "n", "intercept", *ar, *ma, "sigma2", "aicc", "model_rank"), 5, sigma2=4, aicc=4)


_TERMS = {"idx": "(slot - lo) / 100.0e0", "wave": f"sin(slot % {DAY} * pi() / 12)", "swing": f"cos(slot % {DAY} * pi() / 12)"}
_TERMS["idx_wave"] = f"{_TERMS['idx']} * {_TERMS['wave']}"
_MODELS = {"null": [], "trend": ["idx"], "season": ["wave", "swing"], "both": ["idx", "wave", "swing"], "interaction": ["idx", "wave", "swing", "idx_wave"]}
_PLACES = ", ".join(f"('{m}', {k}, {1 + list(_TERMS).index(t)})" for m, ts in _MODELS.items() for k, t in enumerate(ts, 1))
_AR_STEPS = 6


def _ar_step(k: int) -> str:
    """Fit with the residuals' autocorrelation of the step before; step 0 has none."""
    return f"""tw{k} as materialized (select x.series, r.model, x.slot, x.i, x.now - r.rho * x.past as v from x join r{k} r using (series)
      join mt using (model) where mt.i = x.i),
    tg{k} as (select a.series, a.model, a.i, b.i as j, covar_pop(a.v, b.v) * count(*) as v
      from tw{k} a join tw{k} b using (series, model, slot) group by 1, 2, 3, 4),
    {sweep_sql(f'tg{k}', f'ts{k}_', list(range(1, len(_TERMS) + 1)), ['series', 'model'])},
    tr{k} as (select x.series, m.model, x.slot, sum(case when x.i = 0 then now else -m.v * now end) as e, sum(case when x.i = 0 then past else -m.v * past end) as b
      from x join ts{k}_ m on m.series = x.series and m.i = x.i and m.j = 0 group by 1, 2, 3),
    r{k + 1} as materialized (select series, model, regr_slope(e, b) as rho from tr{k} group by 1, 2)"""


def _ar_fit(k: int, errors: str, extra: int) -> str:
    """One row per series and model from the fit of step ``k``."""
    return f"""select m.series, m.model, '{errors}' as errors, max(rho) as rho, max(case when m.i = 0 then m.v end) as rss,
      count(*) - 1 + {extra} as k, (max(case when m.i = 0 then mu end) - coalesce(sum(case when m.i > 0 then m.v * mu end), 0)) / (1 - max(rho)) as intercept,
      {', '.join(f'max(case when mp.place = {p} then m.v end) as est_{p}' for p in range(1, 5))}
      from ts{k}_ m join (select series, model, i, avg(v) as mu from tw{k} group by 1, 2, 3) u using (series, model, i)
      join r{k} using (series, model) left join mp on mp.model = m.model and mp.i = m.i where m.j = 0 group by 1, 2, 3"""


@register(
    "model_compare_terms",
    f"""with {grid_sql(HOUR)}, b as (select *, min(slot) over (partition by series) as lo from g),
    v as (select series, slot, value as x0, {', '.join(f'{e} as x{k}' for k, e in enumerate(_TERMS.values(), 1))} from b),
    l as (select *, {', '.join(f'lag(x{k}) over w as p{k}' for k in range(len(_TERMS) + 1))} from v window w as (partition by series order by slot)),
    c as (select * from l where x0 is not null and p0 is not null),
    x as materialized ({' union all '.join(f'select series, slot, {k} as i, x{k} as now, p{k} as past from c' for k in range(len(_TERMS) + 1))}),
    mp(model, place, i) as (values {_PLACES}),
    mt as (select model, i from mp union all select unnest([{', '.join(f"'{m}'" for m in _MODELS)}]), 0),
    nn as (select series, count(*) as n from c group by 1),
    r0 as (select distinct series, model, 0.0e0 as rho from c, mt),
    {','.join(_ar_step(k) for k in range(_AR_STEPS))},
    fits as ({_ar_fit(0, 'iid', 2)} union all {_ar_fit(_AR_STEPS - 1, 'ar1', 3)}),
    sc as (select *, {_aicc_sql('n', 'rss', 'k')} as aicc from fits join nn using (series))
    select series, model, errors, cast(n as bigint) as n, cast(k as bigint) as n_par, {r("case when errors = 'ar1' then rho end")} as rho,
      {r('intercept', 5)} as intercept, {', '.join(f'{r(f"est_{p}", 5)} as est_{p}' for p in range(1, 5))}, {r('rss / n', 4)} as mean_rss, {r('aicc', 4)} as aicc,
      cast(row_number() over (partition by series order by aicc, model, errors) as int) as model_rank from sc""",
)
def model_compare_terms(spark, folder):
    g = hourly_series(spark, folder)
    lo = g.groupBy(*BY).agg(F.min("slot").alias("lo"))
    terms = {t: F.expr(e.replace("e0", "D")) for t, e in _TERMS.items()}
    out = arma.compare_models(attach(g, lo, BY), BY, "slot", "value", terms, _MODELS)
    estimates = [F.get("estimates", F.lit(k)).alias(f"est_{k + 1}") for k in range(4)]
    return rounded(out.select("*", *estimates).drop("estimates"), 5, rho=6, mean_rss=4, aicc=4)


#: Steps of level and slope as multiples of the noise.
_RATIOS = tuple((a, b) for a in (0.001, 0.01, 0.1) for b in (0.0, 1e-6, 1e-4))
_RATIO_ROWS = ", ".join(f"({k}, {a!r}::double, {b!r}::double)" for k, (a, b) in enumerate(_RATIOS))
_FILTER = f"""rt(ratio, q1, q2) as (values {_RATIO_ROWS}),
    st as (select series, min(slot) as lo, max(slot) as hi, avg(value) as mu, count(value) as n from g group by 1),
    f as (
      select series, ratio, q1, q2, lo - 1 as slot, mu as m1, 0e0 as m2, {states.DIFFUSE!r}::double as p11, 0e0 as p12, {states.DIFFUSE!r}::double as p22, 0e0 as logs, 0e0 as err
      from st, rt union all
      select series, ratio, q1, q2, slot, case when v is null then a1 else a1 + r11 / (r11 + 1) * (v - a1) end,
        case when v is null then a2 else a2 + r12 / (r11 + 1) * (v - a1) end,
        case when v is null then r11 else r11 - r11 * r11 / (r11 + 1) end, case when v is null then r12 else r12 - r11 * r12 / (r11 + 1) end,
        case when v is null then r22 else r22 - r12 * r12 / (r11 + 1) end,
        logs + case when v is null then 0 else ln(r11 + 1) end, err + case when v is null then 0 else (v - a1) * (v - a1) / (r11 + 1) end
      from (select f.series, ratio, q1, q2, f.slot + 1 as slot, g.value as v, m1 + m2 as a1, m2 as a2, p11 + 2 * p12 + p22 + q1 as r11,
        p12 + p22 as r12, p22 + q2 as r22, logs, err from f join g on g.series = f.series and g.slot = f.slot + 1)),
    bt as (select series, ratio, err / n as sigma2 from f join st using (series) where f.slot = st.hi
      qualify row_number() over (partition by series order by n * ln(err / n) + logs, ratio) = 1),
    k as (select f.*, p11 + 2 * p12 + p22 + q1 as r11, p12 + p22 as r12, p22 + q2 as r22 from f semi join bt using (series, ratio)),
    k2 as (select *, ((p11 + p12) * r22 - p12 * r12) / (r11 * r22 - r12 * r12) as e11, (p12 * r11 - (p11 + p12) * r12) / (r11 * r22 - r12 * r12) as e12,
      ((p12 + p22) * r22 - p22 * r12) / (r11 * r22 - r12 * r12) as e21, (p22 * r11 - (p12 + p22) * r12) / (r11 * r22 - r12 * r12) as e22 from k),
    b as (
      select k2.series, k2.slot, m1 as s1, m2 as s2, p11 as v11, p12 as v12, p22 as v22 from k2 join st on st.series = k2.series and slot = hi union all
      select k2.series, k2.slot, m1 + e11 * (s1 - m1 - m2) + e12 * (s2 - m2), m2 + e21 * (s1 - m1 - m2) + e22 * (s2 - m2),
        p11 + e11 * e11 * (v11 - r11) + 2 * e11 * e12 * (v12 - r12) + e12 * e12 * (v22 - r22),
        p12 + e11 * e21 * (v11 - r11) + (e11 * e22 + e12 * e21) * (v12 - r12) + e12 * e22 * (v22 - r22),
        p22 + e21 * e21 * (v11 - r11) + 2 * e21 * e22 * (v12 - r12) + e22 * e22 * (v22 - r22)
      from b join k2 on k2.series = b.series and k2.slot = b.slot - 1)"""


@register(
    "smooth_states",
    f"""with recursive {grid_sql(HOUR)}, {_FILTER}
    select g.series, g.t, {r('s1', 5)} as level, {r('s2', 5)} as slope, {r('v11 * sigma2', 4)} as level_var, ratio, {r('sigma2', 4)} as sigma2
    from g join b using (series, slot) join bt using (series)""",
)
def smooth_states(spark, folder):
    out = states.smooth_states(hourly_series(spark, folder), BY, "slot", "value", "trend", _RATIOS)
    out = out.withColumn("ratio", F.col("ratio").cast("int"))
    return rounded(out.select("series", "t", "level", "slope", "level_var", "ratio", "sigma2"), 5, level_var=4, sigma2=4)


@register(
    "impute_states",
    f"""with recursive {grid_sql(HOUR)}, {_FILTER}
    select g.series, g.t, value is null as was_null, {r('coalesce(value, s1)', 5)} as filled from g join b using (series, slot)""",
)
def impute_states(spark, folder):
    out = states.impute_states(hourly_series(spark, folder), BY, "slot", "value", "filled", "trend", ratios=_RATIOS)
    return rounded(out.select("series", "t", F.col("value").isNull().alias("was_null"), "filled"), 5)
