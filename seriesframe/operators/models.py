"""Regressions and tests whose sums come from one grouped aggregate each."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import StringIndexer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from seriesframe.functions.tails import chi_square_tail, f_tail, studentised_range_point, studentised_range_tail, t_tails
from seriesframe.operators.relate import attach
from seriesframe.operators.summarise import rank_rows
from seriesframe.sources.files import settle


#: Groups of a factor in a block of pairs.
LEVELS = 256


def _aic(n: Column, rss: Column, k: int) -> Column:
    """Gaussian AIC with ``k`` estimated parameters, the variance among them."""
    return n * (math.log(2 * math.pi) + F.log(rss / n) + 1) + 2 * k


def _aicc(n: Column, rss: Column, k: int) -> Column:
    return _aic(n, rss, k) + F.lit(2.0 * k * (k + 1)) / (n - k - 1)


def ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Line of ``y`` on ``x`` per group; with a factor in ``by`` the full interaction fit."""
    slope = F.regr_slope(y, x)
    rss = F.regr_syy(y, x) - slope * slope * F.regr_sxx(y, x)
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        slope.alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        rss.alias("rss"),
    )


def residuals(df: DataFrame, fits: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Fitted value and residual of every row."""
    out = attach(df, fits.select(*by, "slope", "intercept"), by)
    out = out.withColumn("fitted", F.col("intercept") + F.col("slope") * F.col(x))
    return out.withColumn("resid", F.col(y) - F.col("fitted")).drop("slope", "intercept")


def rank_models(df: DataFrame, y: str, xs: dict[str, Column]) -> DataFrame:
    """AIC and AICc of the mean-only model and one line per predictor, best first.

    All fits read one pass: rows with any missing value are left out, so the models see the same
    data. Rank 1 has the smallest AICc.
    """
    data = df.select(F.col(y).alias("_y"), *[c.alias(name) for name, c in xs.items()]).dropna()
    aggs = [F.count("_y").cast("double").alias("n"), (F.var_pop("_y") * F.count("_y")).alias("null_rss")]
    for name in xs:
        b = F.regr_slope("_y", name)
        aggs.append((F.regr_syy("_y", name) - b * b * F.regr_sxx("_y", name)).alias(f"{name}_rss"))
    names = ["null", *xs]
    sums = data.agg(*aggs)
    long = sums.unpivot(["n"], [f"{m}_rss" for m in names], "model", "rss").withColumn(
        "model", F.regexp_replace("model", "_rss$", "")
    )
    k = F.when(F.col("model") == "null", 2).otherwise(3)
    n, rss = F.col("n"), F.col("rss")
    aic = F.when(k == 2, _aic(n, rss, 2)).otherwise(_aic(n, rss, 3))
    aicc = F.when(k == 2, _aicc(n, rss, 2)).otherwise(_aicc(n, rss, 3))
    scored = long.select("model", n.cast("long").alias("n"), "rss", aic.alias("aic"), aicc.alias("aicc"))
    # One row per model: the comparison list is as long as the call names predictors.
    better = scored.select(F.col("aicc").alias("_other"))
    order = F.sort_array(F.collect_list("_other"))
    ranks = better.agg(order.alias("_all"))
    return attach(scored, ranks, []).withColumn("model_rank", F.array_position("_all", F.col("aicc")).cast("int")).drop("_all")


def model_terms(df: DataFrame, y: str, xs: dict[str, Column], digits: int = 8) -> DataFrame:
    """Coefficients side by side: one row per term, one column per model, absent terms null."""
    data = df.select(F.col(y).alias("_y"), *[c.alias(name) for name, c in xs.items()])
    fits = [
        F.struct(F.lit(term).alias("term"), F.lit(name).alias("model"), F.round(estimate, digits).alias("est"))
        for name in xs
        for term, estimate in (("(intercept)", F.regr_intercept("_y", name)), (name, F.regr_slope("_y", name)))
    ]
    # One pass fits every model; the one row of estimates unfolds to (term, model, estimate).
    long = data.agg(F.array(*fits).alias("_fits")).select(F.inline("_fits"))
    return long.groupBy("term").agg(
        *[F.max(F.when(F.col("model") == name, F.col("est"))).alias(f"est_{name}") for name in xs]
    )


def anova(df: DataFrame, y: str, g: str) -> DataFrame:
    """One-way table: sums of squares between and within groups, and F."""
    groups = df.where(F.col(y).isNotNull() & F.col(g).isNotNull()).groupBy(g).agg(
        F.count(y).cast("double").alias("_n"), F.avg(y).alias("_m"), F.var_pop(y).alias("_v")
    )
    # One row per level of the factor from here on.
    grand = groups.agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_grand"))
    off = F.col("_m") - F.col("_grand")
    sums = attach(groups, grand, []).agg(
        F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum("_n").alias("_total"),
        F.sum(F.col("_n") * off * off).alias("ss_between"),
        F.sum(F.col("_n") * F.col("_v")).alias("ss_within"),
    )
    out = sums.withColumns({"df_between": F.col("_k") - 1, "df_within": F.col("_total") - F.col("_k")})
    ratio = (F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within"))
    return out.select(
        F.col("df_between").cast("long").alias("df_between"),
        F.col("df_within").cast("long").alias("df_within"),
        "ss_between",
        "ss_within",
        ratio.alias("f_value"),
    )


def pairwise_means(df: DataFrame, y: str, g: str) -> DataFrame:
    """Differences of group means with standard error and studentised range statistic.

    Pairs are formed between groups of the factor (the result is the list of pairs), never
    between rows: the rows are summed up first. Groups are numbered in their order and cut into blocks of ``LEVELS``; a pair of
    blocks is one key of an equality join, so no task holds all groups.
    """
    groups = df.where(F.col(y).isNotNull() & F.col(g).isNotNull()).groupBy(g).agg(
        F.count(y).cast("double").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")
    )
    groups = settle(groups, "groups")
    pooled = groups.agg(
        (F.sum(F.col("n") * F.col("v")) / (F.sum("n") - F.count(F.lit(1)))).alias("_ms"), F.count(F.lit(1)).alias("_k")
    )
    numbered = attach(rank_rows(groups.drop("v"), g, "_place"), pooled, [])
    block, last = F.floor(F.col("_place") / LEVELS), F.floor(F.col("_k") / LEVELS)
    one = numbered.select(F.col(g).alias("group_a"), "n", "m", "_ms", "_place", block.alias("_a"), F.explode(F.sequence(block, last)).alias("_b"))
    other = numbered.select(
        F.col(g).alias("group_b"), F.col("n").alias("_n2"), F.col("m").alias("_m2"), F.col("_place").alias("_place2"), block.alias("_b"),
        F.explode(F.sequence(F.lit(0).cast("long"), block)).alias("_a"),
    )
    pairs = one.join(other, ["_a", "_b"]).where("_place < _place2")
    se = F.sqrt(F.col("_ms") / 2 * (1 / F.col("n") + 1 / F.col("_n2")))
    diff = F.col("_m2") - F.col("m")
    # Groups without any spread have a standard error of 0 and no statistic.
    return pairs.select("group_a", "group_b", diff.alias("diff"), se.alias("std_error"), F.try_divide(F.abs(diff), se).alias("q_value"))


def anova_test(df: DataFrame, y: str, g: str) -> DataFrame:
    """The one-way table with the probability of a larger F value if all groups had one mean."""
    return anova(df, y, g).withColumn("p_value", f_tail(F.col("f_value"), F.col("df_between"), F.col("df_within")))


def tukey_test(df: DataFrame, y: str, g: str, level: float = 0.95) -> DataFrame:
    """Differences of all pairs of group means with joint bounds and adjusted probabilities (Tukey and Kramer).

    ``lower`` and ``upper`` hold all true differences at once with probability ``level``; ``p_value`` is the chance of so large a
    studentised range among all groups. One distribution for all pairs, from the number of groups and the
    degrees of freedom within them.
    """
    groups = df.where(F.col(y).isNotNull() & F.col(g).isNotNull()).groupBy(g).agg(F.count(y).alias("_n"))
    sizes = groups.agg(F.count(F.lit(1)).cast("double").alias("_k"), F.sum("_n").cast("double").alias("_total"))
    pairs = attach(pairwise_means(df, y, g), sizes, [])
    k, within = F.col("_k"), F.col("_total") - F.col("_k")
    reach = studentised_range_point(1 - level)(k, within) * F.col("std_error")
    out = pairs.withColumns({"_reach": reach, "p_value": studentised_range_tail(F.col("q_value"), k, within)})
    return out.select(
        "group_a", "group_b", "diff", (F.col("diff") - F.col("_reach")).alias("lower"), (F.col("diff") + F.col("_reach")).alias("upper"), "p_value"
    )


def ols_test(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Line per group with standard errors, t values and the probabilities of values farther from 0."""
    n, sxx = F.regr_count(y, x).cast("double"), F.regr_sxx(y, x)
    slope = F.regr_slope(y, x)
    rss = F.greatest(F.regr_syy(y, x) - slope * slope * sxx, F.lit(0.0))
    fits = df.groupBy(*by).agg(
        n.alias("_n"), slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), rss.alias("_rss"), sxx.alias("_sxx"), F.regr_avgx(y, x).alias("_mx")
    )
    variance = F.when(F.col("_n") > 2, F.col("_rss") / (F.col("_n") - 2))
    fits = fits.withColumns(
        {
            "se_slope": F.sqrt(F.try_divide(variance, F.col("_sxx"))),
            "se_intercept": F.sqrt(variance * (1 / F.col("_n") + F.try_divide(F.col("_mx") * F.col("_mx"), F.col("_sxx")))),
        }
    )
    for c in ("slope", "intercept"):
        fits = fits.withColumn(f"t_{c}", F.try_divide(F.col(c), F.col(f"se_{c}")))
        fits = fits.withColumn(f"p_{c}", F.when(F.col("_n") > 2, t_tails(F.col(f"t_{c}"), F.col("_n") - 2)))
    names = [f"{a}{c}" for c in ("slope", "intercept") for a in ("", "se_", "t_", "p_")]
    return fits.select(*by, F.col("_n").cast("long").alias("n"), *names)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of each pair of columns over the rows where both are present."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    sums = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = sums.unpivot([], [f"{a}|{b}" for a, b in pairs], "_pair", "corr")
    parts = F.split("_pair", "[|]")
    return long.select(parts[0].alias("col_a"), parts[1].alias("col_b"), "corr")


def zero_test(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Score statistic for more zeros than a Poisson count has, with the two-part split sizes."""
    sums = df.where(F.col(n).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col(n) == 0).cast("long")).alias("n_zero"),
        F.sum((F.col(n) > 0).cast("long")).alias("n_positive"),
        F.avg(n).alias("mean"),
        F.avg(F.when(F.col(n) > 0, F.col(n))).alias("mean_positive"),
    )
    p0 = F.exp(-F.col("mean"))
    rows = F.col("n_rows")
    spread = rows * p0 * (1 - p0) - rows * F.col("mean") * p0 * p0
    return sums.withColumn("score", F.try_divide(F.pow(F.col("n_zero") - rows * p0, F.lit(2)), spread))


def zero_test_p(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """``zero_test`` with the probability of a larger score if counts were Poisson."""
    return zero_test(df, by, n).withColumn("p_value", chi_square_tail(F.col("score"), 1))


def decay_fits(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Exponential (ln y on x) and power (ln y on ln x) decay by log-linear regression."""
    data = df.where((F.col(y) > 0) & (F.col(x) > 0)).select(
        *by, F.log(y).alias("_ly"), F.col(x).cast("double").alias("_x"), F.log(x).alias("_lx")
    )
    return data.groupBy(*by).agg(
        F.exp(F.regr_intercept("_ly", "_x")).alias("exp_scale"),
        F.regr_slope("_ly", "_x").alias("exp_rate"),
        F.regr_r2("_ly", "_x").alias("exp_r2"),
        F.exp(F.regr_intercept("_ly", "_lx")).alias("pow_scale"),
        F.regr_slope("_ly", "_lx").alias("pow_rate"),
        F.regr_r2("_ly", "_lx").alias("pow_r2"),
    )


def decay_curves(fits: DataFrame, by: list[str], lo: float, hi: float, step: float) -> DataFrame:
    """Fitted exponential and power curves over an even grid of x values."""
    points = F.explode(F.sequence(F.lit(0), F.lit(int(round((hi - lo) / step))))).alias("_i")
    grid = fits.select("*", points).withColumn("x", F.lit(float(lo)) + F.col("_i") * F.lit(float(step)))
    return grid.select(
        *by,
        "x",
        (F.col("exp_scale") * F.exp(F.col("exp_rate") * F.col("x"))).alias("exp_fit"),
        (F.col("pow_scale") * F.pow("x", "pow_rate")).alias("pow_fit"),
    )


def _design(numeric: list[str], factors: list[str]) -> list:
    stages, inputs = [], list(numeric)
    for f in factors:
        # Descending order puts the first name last, where the encoder drops it.
        stages.append(StringIndexer(inputCol=f, outputCol=f"_i_{f}", stringOrderType="alphabetDesc"))
        stages.append(OneHotEncoder(inputCol=f"_i_{f}", outputCol=f"_o_{f}"))
        inputs.append(f"_o_{f}")
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="_features")]


def glm(
    df: DataFrame,
    y: str,
    numeric: list[str],
    factors: list[str],
    family: str,
    link: str,
    tol: float = 1e-8,
    max_iter: int = 50,
) -> PipelineModel:
    """Generalised linear model over rows without missing values.

    The first level of each factor (in name order) is the reference, as contrasts usually
    are. The last stage of the result holds ``intercept`` and ``coefficients``.
    """
    data = df.dropna(subset=[y, *numeric, *factors])
    design = Pipeline(stages=_design(numeric, factors)).fit(data)
    # Every iteration passes over these rows again.
    rows = design.transform(data).select(F.col(y).cast("double").alias(y), "_features").persist()
    try:
        if (family, link) == ("gamma", "inverse"):
            last = _gamma_inverse(rows, y, tol, max_iter)
        else:
            last = GeneralizedLinearRegression(
                labelCol=y, featuresCol="_features", family=family, link=link, tol=tol, maxIter=max_iter
            ).fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel(stages=[*design.stages, last])


class InverseLine(Transformer):
    """Adds ``_eta``, the linear predictor, which is 1 / mean."""

    def __init__(self, intercept: float, coefficients: list[float]):
        super().__init__()
        self.intercept, self.coefficients = intercept, coefficients

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = F.zip_with(vector_to_array("_features"), F.array(*map(F.lit, self.coefficients)), lambda a, b: a * b)
        return dataset.withColumn("_eta", F.aggregate(parts, F.lit(self.intercept), lambda s, v: s + v))


def _weighted_sums(rows: DataFrame, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, int, float, int]:
    """X'WX, X'Wz, deviance, rows outside of the positive range, sum of y and rows at these coefficients, in one pass.

    Each task adds up its own rows; what is added up across tasks, and brought to the driver, has the size of the model squared.
    Without coefficients the mean of each row is its response.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy()
            x = np.column_stack([np.ones(len(y)), np.asarray(batch.column(0).flatten()).reshape(len(y), -1)])
            eta = 1 / np.where(y > 0, y, np.nan) if beta is None else x @ beta
            bad = ~(eta > 0)
            mu = 1 / np.where(bad, 1.0, eta)
            w = np.where(bad, 0.0, mu * mu)
            z = np.where(bad, 0.0, eta - (y - mu) / (mu * mu))
            deviance = 2 * np.where(bad, 0.0, (y - mu) / mu - np.log(y / mu)).sum()
            now = np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ (w * z), [deviance, bad.sum(), y.sum(), len(y)]])
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "v"])

    found = rows.mapInArrow(work, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    sums = np.array([r.v for r in sorted(found, key=lambda r: r.place)])
    size = (math.isqrt(4 * (len(sums) - 4) + 1) - 1) // 2
    return sums[: size * size].reshape(size, size), sums[size * size : -4], float(sums[-4]), int(sums[-3]), float(sums[-2]), int(sums[-1])


def _gamma_inverse(rows: DataFrame, y: str, tol: float, max_iter: int) -> InverseLine:
    """Gamma regression with inverse link by reweighted least squares, one pass over the rows a step.

    The built-in fit starts from an unweighted line through 1/y, which small responses pull so
    far up that later steps leave the positive range. Starting from mean = response with
    weights mean^2 avoids that. A step that leaves the positive range or raises the deviance is halved towards the
    last good one, at first the common mean, until it does neither.
    """
    data = rows.select(vector_to_array("_features").alias("x"), F.col(y).alias("y"))
    cross, right, _, bad, total, n = _weighted_sums(data, None)
    if bad:
        raise ValueError(f"{bad} responses of a gamma model are not positive")
    beta = np.linalg.lstsq(cross, right, rcond=None)[0]
    good, least = np.concatenate([[n / total], np.zeros(len(beta) - 1)]), math.inf
    for _ in range(max_iter):
        cross, right, deviance, bad, _, _ = _weighted_sums(data, beta)
        if bad or not deviance <= least + 1e-12 * abs(least):
            if np.abs(beta - good).max() <= tol * np.abs(good).max():
                break
            beta = (beta + good) / 2
            continue
        good, least = beta, deviance
        beta = np.linalg.lstsq(cross, right, rcond=None)[0]
        if np.abs(beta - good).max() <= tol * np.abs(beta).max():
            good = beta
            break
    return InverseLine(float(good[0]), [float(c) for c in good[1:]])


def glm_coefficients(model, numeric: list[str], factors: list[str], spark) -> DataFrame:
    """Term and estimate of a fitted model; as many rows as the model has terms."""
    terms = list(numeric)
    indexers = [s for s in model.stages if hasattr(s, "labels")]
    for f, indexer in zip(factors, indexers):
        terms += [f"{f}={label}" for label in indexer.labels[:-1]]
    fit = model.stages[-1]
    rows = [("(intercept)", float(fit.intercept))]
    rows += [(t, float(c)) for t, c in zip(terms, fit.coefficients)]
    return spark.createDataFrame(rows, "term string, estimate double")


def glm_fill(df: DataFrame, model, y: str, numeric: list[str], factors: list[str], name: str = "filled") -> DataFrame:
    """Missing responses become the model's prediction.

    Rows with a missing predictor, or a factor level the fit never saw, keep their response
    as it is.
    """
    known = F.lit(True)
    for c in numeric:
        known = known & F.col(c).isNotNull()
    indexers = [s for s in model.stages if hasattr(s, "labels")]
    for f, indexer in zip(factors, indexers):
        known = known & F.col(f).isNotNull() & F.col(f).isin(list(indexer.labels))
    fitted = model.transform(df.where(known))
    mean = 1 / F.col("_eta") if "_eta" in fitted.columns else F.col("prediction")
    filled = fitted.select(*df.columns, F.coalesce(F.col(y), mean).alias(name))
    return filled.unionByName(df.where(~known).withColumn(name, F.col(y).cast("double")))
