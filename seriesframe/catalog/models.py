"""Regressions, tests, generalised linear models and multiple imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesframe.catalog.common import E_SERIES, grid_sql, r, registry, rounded, sweep_sql
from seriesframe.functions.semantics import presence
from seriesframe.operators import impute, models as op
from seriesframe.operators.grid import densify
from seriesframe.operators.relate import attach, join_keep_left
from seriesframe.plans.sheets import grid_series, series_events, table

QUERIES, SQL, register = registry()
BY = ["series"]


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
    )


_L = """l as (select l_returnflag as category, l_linestatus as status, l_extendedprice as price, l_quantity as qty,
  l_discount as disc, l_tax as tax from lineitem)"""


@register(
    "ols_by_group",
    f"""with {_L} select category, status, cast(regr_count(price, qty) as bigint) as n, {r('regr_slope(price, qty)')} as slope,
      {r('regr_intercept(price, qty)')} as intercept, {r('regr_r2(price, qty)')} as r2 from l group by 1, 2""",
)
def ols_by_group(spark, folder):
    return rounded(op.ols(_lines(spark, folder), ["category", "status"], "price", "qty").drop("rss"))


@register(
    "ols_residuals",
    f"""with {_L}, f as (select category, regr_slope(price, qty) as b, regr_intercept(price, qty) as a from l group by 1)
    select category, qty, count(*) as n, {r('max(a + b * qty)', 4)} as fitted, {r('stddev_samp(price - (a + b * qty))', 4)} as resid_sd
    from l join f using (category) group by 1, 2""",
)
def ols_residuals(spark, folder):
    lines = _lines(spark, folder)
    out = op.residuals(lines, op.ols(lines, ["category"], "price", "qty"), ["category"], "price", "qty")
    return rounded(
        out.groupBy("category", "qty").agg(
            F.count(F.lit(1)).alias("n"), F.max("fitted").alias("fitted"), F.stddev_samp("resid").alias("resid_sd")
        ),
        4,
    )


_RSS = "regr_syy(price, {x}) - regr_slope(price, {x}) * regr_slope(price, {x}) * regr_sxx(price, {x})"
_AIC = "n * (ln(2 * pi()) + ln(rss / n) + 1)"


@register(
    "model_compare",
    f"""with {_L}, f as (
      select 'null' as model, 2 as k, cast(count(*) as double) as n, var_pop(price) * count(*) as rss from l
      union all select 'qty', 3, count(*), {_RSS.format(x='qty')} from l
      union all select 'disc', 3, count(*), {_RSS.format(x='disc')} from l
      union all select 'tax', 3, count(*), {_RSS.format(x='tax')} from l
      union all select 'ln_qty', 3, count(*), {_RSS.format(x='ln(qty)')} from l)
    select model, cast(n as bigint) as n, {r('rss / n', 2)} as mean_rss, {r(_AIC + ' + 2 * k', 3)} as aic,
      {r(_AIC + ' + 2 * k + 2.0 * k * (k + 1) / (n - k - 1)', 3)} as aicc,
      cast(rank() over (order by {_AIC} + 2 * k + 2.0 * k * (k + 1) / (n - k - 1)) as int) as model_rank from f""",
)
def model_compare(spark, folder):
    xs = {"qty": F.col("qty"), "disc": F.col("disc"), "tax": F.col("tax"), "ln_qty": F.log("qty")}
    out = op.rank_models(_lines(spark, folder), "price", xs)
    out = out.select("model", "n", (F.col("rss") / F.col("n")).alias("mean_rss"), "aic", "aicc", "model_rank")
    return rounded(out, 3, mean_rss=2)


@register(
    "loglinear_decay",
    f"""with {_L}, d as (select category, ln(price) as ly, qty as x, ln(qty) as lx from l where price > 0 and qty > 0)
    select category, {r('exp(regr_intercept(ly, x))', 4)} as exp_scale, {r('regr_slope(ly, x)')} as exp_rate,
      {r('regr_r2(ly, x)')} as exp_r2, {r('exp(regr_intercept(ly, lx))', 4)} as pow_scale,
      {r('regr_slope(ly, lx)')} as pow_rate, {r('regr_r2(ly, lx)')} as pow_r2 from d group by 1""",
)
def loglinear_decay(spark, folder):
    return rounded(op.decay_fits(_lines(spark, folder), ["category"], "price", "qty"), exp_scale=4, pow_scale=4)


@register(
    "decay_curve",
    f"""with {_L}, d as (select category, ln(price) as ly, qty as x, ln(qty) as lx from l where price > 0 and qty > 0),
    f as (select category, exp(regr_intercept(ly, x)) as ea, regr_slope(ly, x) as eb, exp(regr_intercept(ly, lx)) as pa,
      regr_slope(ly, lx) as pb from d group by 1)
    select category, 1.0e0 + i * 0.5e0 as x, {r('ea * exp(eb * (1 + i * 0.5e0))', 3)} as exp_fit,
      {r('pa * power(1 + i * 0.5e0, pb)', 3)} as pow_fit from f, (select unnest(generate_series(0, 98)) as i)""",
)
def decay_curve(spark, folder):
    fits = op.decay_fits(_lines(spark, folder), ["category"], "price", "qty")
    return rounded(op.decay_curves(fits, ["category"], 1, 50, 0.5), 3)


@register(
    "anova_oneway",
    f"""with {E_SERIES}, g as (select series, count(*) as n, avg(value) as m, var_pop(value) as v from e group by 1),
    t as (select sum(n) as tot, count(*) as k, sum(n * m) / sum(n) as mu from g),
    s as (select sum(n * (m - mu) * (m - mu)) as ssb, sum(n * v) as ssw, max(k) as k, max(tot) as tot from g, t)
    select cast(k - 1 as bigint) as df_between, cast(tot - k as bigint) as df_within, {r('ssb', 3)} as ss_between,
      {r('ssw', 3)} as ss_within, {r('(ssb / (k - 1)) / (ssw / (tot - k))')} as f_value from s""",
)
def anova_oneway(spark, folder):
    return rounded(op.anova(series_events(spark, folder), "value", "series"), ss_between=3, ss_within=3)


@register(
    "pairwise_means",
    f"""with {E_SERIES}, g as (select series, count(*) as n, avg(value) as m, var_pop(value) as v from e group by 1),
    t as (select sum(n * v) / (sum(n) - count(*)) as ms from g)
    select a.series as group_a, b.series as group_b, {r('b.m - a.m')} as diff,
      {r('sqrt(ms / 2 * (1 / a.n + 1 / b.n))')} as std_error,
      {r('abs(b.m - a.m) / sqrt(ms / 2 * (1 / a.n + 1 / b.n))')} as q_value
    from g a join g b on a.series < b.series, t""",
)
def pairwise_means(spark, folder):
    return rounded(op.pairwise_means(series_events(spark, folder), "value", "series"))


_MEASURES = ["price", "qty", "disc", "tax"]
_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]]


@register(
    "correlation_matrix",
    f"with {_L} "
    + " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, {r(f'corr({a}, {b})')} as corr from l" for a, b in _PAIRS),
)
def correlation_matrix(spark, folder):
    return rounded(op.correlations(_lines(spark, folder), _MEASURES))


@register(
    "zero_inflation",
    f"""with {grid_sql(1800)}, c as (select series, coalesce(n, 0) as n from g),
    s as (select series, count(*) as n_rows, sum(case when n = 0 then 1 else 0 end) as n_zero,
      sum(case when n > 0 then 1 else 0 end) as n_positive, avg(n) as mean, avg(n) filter (where n > 0) as mp from c group by 1)
    select series, n_rows, cast(n_zero as bigint) as n_zero, cast(n_positive as bigint) as n_positive, {r('mean')} as mean,
      {r('mp')} as mean_positive,
      {r('power(n_zero - n_rows * exp(-mean), 2) / (n_rows * exp(-mean) * (1 - exp(-mean)) - n_rows * mean * exp(-mean) * exp(-mean))')} as score
    from s""",
)
def zero_inflation(spark, folder):
    g = densify(series_events(spark, folder), "ts", 1800, BY, [F.count(F.lit(1)).alias("n")], {"n": 0}, reuse=False)
    return rounded(op.zero_test(g, BY, "n"))


@register(
    "glm_gamma",
    f"""with {E_SERIES}, g as (select series, avg(value + 1) as m from e group by 1)
    select '(intercept)' as term, {r('1 / m')} as estimate from g where series = 'click'
    union all select 'series=' || series, {r("1 / m - 1 / (select m from g where series = 'click')")} from g where series <> 'click'""",
)
def glm_gamma(spark, folder):
    e = series_events(spark, folder).select("series", (F.col("value") + 1).alias("y"))
    fit = op.glm(e, "y", [], BY, "gamma", "inverse")
    return rounded(op.glm_coefficients(fit, [], BY, spark))


@register(
    "glm_binomial",
    f"""with c as (select o_orderpriority as bay, case when n > 0 then 1.0 else 0.0 end as y from orders left join (
      select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on o_orderkey = l_orderkey),
    l as (select bay, ln(avg(y) / (1 - avg(y))) as lo from c group by 1)
    select '(intercept)' as term, {r('lo', 4)} as estimate from l where bay = '1-URGENT'
    union all select 'bay=' || bay, {r("lo - (select lo from l where bay = '1-URGENT')", 4)} from l where bay <> '1-URGENT'""",
)
def glm_binomial(spark, folder):
    caught = table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("bay"))
    rows = join_keep_left(o, caught, ["o_orderkey"]).select("bay", presence(F.coalesce("n", F.lit(0))).alias("caught"))
    fit = op.glm(rows, "caught", [], ["bay"], "binomial", "logit")
    return rounded(op.glm_coefficients(fit, [], ["bay"], spark), 4)


#: Reweighted least squares, step by step; terms 1 to 9 are the constant, the price, four bays and three quarters.
_LOGIT_BAYS = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_LOGIT_STEPS = 7


def _logit_step(k: int) -> str:
    eta = "0.0e0" if k == 0 else "sum(b * v)"
    start = f"""e{k} as (select x.id, max(y) as y, {'(max(y) + 0.5e0) / 2' if k == 0 else f'1 / (1 + exp(-({eta})))'} as mu
      from x {'' if k == 0 else f'join b{k} using (i)'} group by 1)"""
    return f"""{start},
    w{k} as materialized (select id, mu * (1 - mu) as w, ln(mu / (1 - mu)) + (y - mu) / (mu * (1 - mu)) as z from e{k}),
    d{k} as (select id, 0 as i, z as v, w from w{k} union all select id, i, v, w from x join w{k} using (id)),
    g{k} as (select 1 as one, a.i, b.i as j, sum(a.w * a.v * b.v) as v from d{k} a join d{k} b using (id) group by 2, 3),
    {sweep_sql(f'g{k}', f's{k}_', list(range(1, 10)), ['one'])},
    b{k + 1} as materialized (select i, v as b from s{k}_ where j = 0 and i > 0)"""


@register(
    "glm_binomial_terms",
    f"""with c as (select o_orderkey as id, o_totalprice / 100000.0e0 as price, o_orderpriority as bay, quarter(o_orderdate) as q,
      case when n > 0 then 1.0e0 else 0.0e0 end as y from orders left join (
      select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on o_orderkey = l_orderkey),
    x as materialized (select id, y, unnest([1, 2, {', '.join(map(str, range(3, 10)))}]) as i, unnest([1.0e0, price,
      {', '.join(f"case when bay = '{b}' then 1.0e0 else 0.0e0 end" for b in _LOGIT_BAYS)},
      {', '.join(f"case when q = {q} then 1.0e0 else 0.0e0 end" for q in (2, 3, 4))}]) as v from c),
    {','.join(_logit_step(k) for k in range(_LOGIT_STEPS))},
    t(i, term) as (values (1, '(intercept)'), (2, 'price'), {', '.join(f"({k}, 'bay={b}')" for k, b in enumerate(_LOGIT_BAYS, 3))},
      {', '.join(f"({k}, 'quarter={q}')" for k, q in enumerate((2, 3, 4), 7))})
    select term, {r('b', 4)} as estimate from b{_LOGIT_STEPS} join t using (i)""",
)
def glm_binomial_terms(spark, folder):
    caught = table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("bay"), (F.col("o_totalprice") / 100000).alias("price"),
        F.quarter("o_orderdate").cast("string").alias("quarter"),
    )
    rows = join_keep_left(o, caught, ["o_orderkey"]).withColumn("caught", presence(F.coalesce("n", F.lit(0))))
    fit = op.glm(rows, "caught", ["price"], ["bay", "quarter"], "binomial", "logit")
    return rounded(op.glm_coefficients(fit, ["price"], ["bay", "quarter"], spark), 4)


_HOURS = "(slot % 144) / 6.0"


@register(
    "glm_gaussian_impute",
    f"""with {grid_sql()}, x as (select *, {_HOURS} as hr from g),
    m as (select series, avg(hr) as mx, avg(value) as my from x where value is not null group by 1),
    b as (select sum((hr - mx) * (value - my)) / sum((hr - mx) * (hr - mx)) as b from x join m using (series) where value is not null)
    select series, t, {r('coalesce(value, my + b * (hr - mx))', 4)} as filled from x join m using (series), b""",
)
def glm_gaussian_impute(spark, folder):
    g = grid_series(spark, folder).withColumn("hr", F.col("slot") % 144 / 6.0)
    fit = op.glm(g.where(F.col("value").isNotNull()), "value", ["hr"], BY, "gaussian", "identity")
    return rounded(op.glm_fill(g, fit, "value", ["hr"], BY).select("series", "t", "filled"), 4)


_FIT = """fit as (select series, regr_slope(value, slot) as b, regr_intercept(value, slot) as a,
  sqrt(greatest(regr_syy(value, slot) - regr_slope(value, slot) * regr_slope(value, slot) * regr_sxx(value, slot), 0)
    / (regr_count(value, slot) - 2)) as s from gx group by 1)"""
_GX = "gx as (select series, t, value, slot - min(slot) over () as slot from g)"


def _indexed(spark, folder):
    """Grid with slot numbers from the season start, so regressions keep their digits."""
    g = grid_series(spark, folder)
    lo = g.agg(F.min("slot").alias("_lo"))
    return attach(g, lo, []).select("series", "t", "value", (F.col("slot") - F.col("_lo")).alias("slot"))


@register(
    "impute_regression",
    f"""with {grid_sql()}, {_GX}, {_FIT} select series, t, {r('coalesce(value, a + b * slot)')} as filled
    from gx join fit using (series)""",
)
def impute_regression(spark, folder):
    out = impute.impute_regression(_indexed(spark, folder), BY, "value", "slot")
    return rounded(out.select("series", "t", "filled"))


def _uniform_sql(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"((cast(('0x' || substr(md5({text}), 1, 8)) as ubigint) + 0.5) / 4294967296.0)"


_NOISE = (
    f"sqrt(-2 * ln({_uniform_sql('series', 'slot', 'm', chr(39) + '1' + chr(39), chr(39) + 'r' + chr(39))})) * "
    f"cos(2 * pi() * {_uniform_sql('series', 'slot', 'm', chr(39) + '1' + chr(39), chr(39) + 'a' + chr(39))})"
)


@register(
    "impute_norm_noise",
    f"""with {grid_sql()}, {_GX}, {_FIT}, mm as (select unnest(generate_series(1, 5)) as m)
    select series, t, cast(m as int) as m, {r(f'coalesce(value, a + b * slot + s * {_NOISE})')} as filled
    from gx join fit using (series), mm""",
)
def impute_norm_noise(spark, folder):
    out = impute.impute_norm(_indexed(spark, folder), BY, "value", "slot", "slot")
    return rounded(out.select("series", "t", "m", "filled"))


def _normal_sql(*parts: str) -> str:
    r, a = (_uniform_sql(*parts, f"'{x}'") for x in "ra")
    return f"(sqrt(-2 * ln({r})) * cos(2 * pi() * {a}))"


@register(
    "impute_norm_drawn",
    f"""with {grid_sql()}, {_GX}, {_FIT}, mm as (select unnest(generate_series(1, 5)) as m),
    mo as (select series, count(*) as n, avg(slot) as mx, avg(value) as my, regr_sxx(value, slot) as sxx from gx
      where value is not null group by 1),
    dr as (select *, s * sqrt((n - 2) / greatest((n - 2) * power(1 - 2.0e0 / (9 * (n - 2))
      + {_normal_sql('series', 'm', "'1'", "'v'")} * sqrt(2.0e0 / (9 * (n - 2))), 3), 1e-9)) as sd
      from fit join mo using (series), mm),
    pa as (select *, b + {_normal_sql('series', 'm', "'1'", "'b'")} * sd / sqrt(sxx) as slope,
      my + {_normal_sql('series', 'm', "'1'", "'c'")} * sd / sqrt(n) as level from dr)
    select series, t, cast(m as int) as m,
      {r(f"coalesce(value, level + slope * (slot - mx) + sd * {_normal_sql('series', 'slot', 'm', chr(39) + '1' + chr(39))})", 5)} as filled
    from gx join pa using (series)""",
)
def impute_norm_drawn(spark, folder):
    out = impute.impute_norm_drawn(_indexed(spark, folder), BY, "value", "slot", "slot")
    return rounded(out.select("series", "t", "m", "filled"), 5)


_PMM = f"""{_GX}, {_FIT}, pr as (select gx.*, a + b * slot as pred from gx join fit using (series)),
rk as (select *, sum(case when value is not null then 1 else 0 end) over (partition by series order by pred, slot) as rnk from pr),
dn as (select series, rnk, pred as dp, value as dy from rk where value is not null),
cd as (select q.series, q.slot, d.rnk, dy, row_number() over (partition by q.series, q.slot order by round(abs(dp - q.pred), 9), d.rnk) as o,
  from rk q join dn d on d.series = q.series and d.rnk > q.rnk - 5 and d.rnk <= q.rnk + 5 where q.value is null),
sz as (select series, slot, least(count(*), 5) as c from cd group by 1, 2),
mm as (select unnest(generate_series(1, 5)) as m),
ch as (select series, slot, m, 1 + floor({_uniform_sql('series', 'slot', 'm', chr(39) + '1' + chr(39))} * c) as o from sz, mm),
done as (select gx.series, gx.t, gx.slot, mm.m, coalesce(value, dy) as filled from gx cross join mm
  left join ch on ch.series = gx.series and ch.slot = gx.slot and ch.m = mm.m and gx.value is null
  left join cd on cd.series = ch.series and cd.slot = ch.slot and cd.o = ch.o)"""


@register(
    "impute_pmm",
    f"with {grid_sql()}, {_PMM} select series, t, cast(m as int) as m, {r('filled')} as filled from done",
)
def impute_pmm(spark, folder):
    out = impute.impute_pmm(_indexed(spark, folder), BY, "value", "slot", "slot")
    return rounded(out.select("series", "t", "m", "filled"))


@register(
    "pool_estimates",
    f"""with {grid_sql()}, {_PMM}, f as (select series, m, regr_slope(filled, slot) as q,
      (regr_syy(filled, slot) - regr_slope(filled, slot) * regr_slope(filled, slot) * regr_sxx(filled, slot))
        / (regr_count(filled, slot) - 2) / regr_sxx(filled, slot) as u from done group by 1, 2)
    select series, count(*) as m_copies, {r('avg(q)', 8)} as estimate, {r('avg(u)', 12)} as within_var,
      {r('var_samp(q)', 12)} as between_var, {r('avg(u) + (1 + 1 / count(*)) * var_samp(q)', 12)} as total_var
    from f group by 1""",
)
def pool_estimates(spark, folder):
    done = impute.impute_pmm(_indexed(spark, folder), BY, "value", "slot", "slot")
    return rounded(impute.pool_estimates(done, BY, "filled", "slot"), 12, estimate=8)
