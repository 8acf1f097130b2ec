"""Inference as aggregations: what reaches the driver are matrices as wide as the model, never rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlens.functions.distributions import f_sf, normal_quantile, normal_sf, t_sf
from boardlens.operators.frames import average_rank, ordered
from boardlens.session import cut


def pearson(x: str, y: str) -> Column:
    """Correlation in an aggregation, over rows that have both: NaN where one of them doesn't vary, as for one row, null without rows. F.corr divides by zero there, an error in ANSI mode.

    That they vary is told by their extremes: a variance put together from parts may miss zero by rounding.
    """
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b)) | (scale == 0)
    return F.when(flat, F.lit(float("nan"))).otherwise(F.covar_pop(x, y) / scale)


def correlations(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, pearson, spearman) over rows that have both, NaN where one doesn't vary; ranks of ties are their mean."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*by, x, y, average_rank(by, x).alias("__rx"), average_rank(by, y).alias("__ry"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson(x, y).alias("pearson"), pearson("__rx", "__ry").alias("spearman"))


def cross_correlation(df: DataFrame, x: str, y: str, order: str, by: Sequence[str] = (), lags: int = 5) -> DataFrame:
    """(by, lag, r): corr(x at t, y at t + lag), lag from -lags to lags, all in one aggregation; NaN where one doesn't vary, null without pairs."""
    w = ordered(by, order)
    led = df.select(*by, x, *[(F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(w).alias(f"__y{k + lags}") for k in range(-lags, lags + 1)])
    one = led.groupBy(*by).agg(*[pearson(x, f"__y{k}").alias(f"r{k}") for k in range(2 * lags + 1)])
    pairs = ", ".join(f"{k - lags}, r{k}" for k in range(2 * lags + 1))
    return one.selectExpr(*by, f"stack({2 * lags + 1}, {pairs}) as (lag, r)")


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    ssr: float

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    @property
    def t(self) -> np.ndarray:
        return self.beta / self.se

    @property
    def p(self) -> np.ndarray:
        return np.array([2 * normal_sf(abs(t)) for t in self.t])

    def contrast(self, c: dict[str, float]) -> tuple[float, float]:
        v = np.array([c.get(n, 0.0) for n in self.names])
        return float(v @ self.beta), float(np.sqrt(v @ self.cov @ v))


def _products(cols: Sequence[str]) -> list[Column]:
    return [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]


def _matrix(row: Sequence[float], k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = [x or 0.0 for x in row]
    return m + np.triu(m, 1).T


def _complete(df: DataFrame, y: str, xs: Sequence[str], const: bool, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    d = df.dropna(subset=[y, *xs]).select(*[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(xs)], F.col(y).cast("double").alias("__y"), *[F.col(c) for c in keep])
    names = [f"__x{i}" for i in range(len(xs))]
    return (d.withColumn("__x_1", F.lit(1.0)), ["__x_1", *names]) if const else (d, names)


def _solve(d: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int, float]:
    cols = [*names, "__y"]
    row = d.agg(F.count("*"), *_products(cols)).first()
    g = _matrix(row[1:], len(cols))
    bread = np.linalg.pinv(g[:-1, :-1])
    beta = bread @ g[:-1, -1]
    return beta, bread, row[0], float(g[-1, -1] - beta @ g[:-1, -1])


def ols(df: DataFrame, y: str, xs: Sequence[str], const: bool = True) -> Fit:
    d, names = _complete(df, y, xs, const, [])
    beta, bread, n, ssr = _solve(d, names)
    return Fit([*["const"] * const, *xs], beta, bread * ssr / max(n - len(names), 1), n, ssr)


def _scores(d: DataFrame, names: list[str], beta: np.ndarray, keep: Sequence[str]) -> DataFrame:
    e = F.col("__y")
    for n, b in zip(names, beta, strict=True):
        e = e - F.lit(float(b)) * F.col(n)
    return d.withColumn("__e", e).select(*keep, *[(F.col(n) * F.col("__e")).alias(f"__s{i}") for i, n in enumerate(names)])


#: Rows of a series, which one window holds; a longer one isn't one of trading days.
LONGEST_SERIES = 1_000_000


def one_series(df: DataFrame) -> int:
    """df's number of rows; an error beyond LONGEST_SERIES."""
    n = df.limit(LONGEST_SERIES + 1).count()
    if n > LONGEST_SERIES:
        raise ValueError(f"more than {LONGEST_SERIES} rows are no series")
    return n


def ols_hac(df: DataFrame, y: str, xs: Sequence[str], order: str, lags: int = 5, const: bool = True) -> Fit:
    """OLS with Newey-West errors: Bartlett weights, no small-sample factor. df is one series, ordered by order; one beyond LONGEST_SERIES is refused."""
    one_series(df)
    d, names = _complete(df, y, xs, const, [order])
    beta, bread, n, ssr = _solve(d, names)
    s = _scores(d, names, beta, [order])
    k = len(names)
    w = Window.orderBy(order)
    lagged = s.select("*", *[F.lag(f"__s{i}", m).over(w).alias(f"__s{i}_{m}") for m in range(1, lags + 1) for i in range(k)])
    pairs = [F.sum(F.col(f"__s{i}") * F.col(f"__s{j}" + (f"_{m}" if m else ""))) for m in range(lags + 1) for i in range(k) for j in range(k)]
    g = np.array([x or 0.0 for x in lagged.agg(*pairs).first()]).reshape(lags + 1, k, k)
    meat = g[0] + sum((1 - m / (lags + 1)) * (g[m] + g[m].T) for m in range(1, lags + 1))
    return Fit([*["const"] * const, *xs], beta, bread @ meat @ bread, n, ssr)


def ols_clustered(df: DataFrame, y: str, xs: Sequence[str], clusters: Sequence[str], const: bool = True) -> Fit:
    """OLS with errors clustered one or two ways (V1 + V2 - V12), each with G/(G-1) * (n-1)/(n-k). Sums per cluster combine before they shuffle."""
    d, names = _complete(df, y, xs, const, clusters)
    beta, bread, n, ssr = _solve(d, names)
    s = _scores(d, names, beta, clusters)
    k = len(names)
    ways = [(list(clusters[:1]), 1)] if len(clusters) == 1 else [([clusters[0]], 1), ([clusters[1]], 1), (list(clusters), -1)]
    cov = np.zeros((k, k))
    for by, sign in ways:
        per = s.groupBy(*by).agg(*[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(k)])
        row = per.agg(F.count("*"), *_products([f"__s{i}" for i in range(k)])).first()
        g = row[0]
        cov += sign * (g / max(g - 1, 1)) * ((n - 1) / max(n - k, 1)) * bread @ _matrix(row[1:], k) @ bread
    return Fit([*["const"] * const, *xs], beta, cov, n, ssr)


def demean(df: DataFrame, cols: Sequence[str], effects: Sequence[str], tol: float = 1e-10, most: int = 10_000) -> DataFrame:
    """df, complete in cols, with cols less their group means, for all effects at once, by alternating projections until no mean is beyond tol; an error where `most` rounds don't get there."""
    d = cut(df.dropna(subset=list(cols)))
    for _ in range(most):
        largest = 0.0
        for fe in effects:
            means = d.groupBy(fe).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
            d = cut(d.join(means, fe).select(*[(F.col(c) - F.col(f"__m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns], *[F.abs(f"__m_{c}").alias(f"__a_{c}") for c in cols]))
            largest = max(largest, *[x or 0.0 for x in d.agg(*[F.max(f"__a_{c}") for c in cols]).first()])
            d = d.select(*df.columns)
        if largest < tol or len(effects) == 1:
            return d
    raise ArithmeticError(f"means of {largest} are left after {most} rounds")


def fe_ols(df: DataFrame, y: str, xs: Sequence[str], effects: Sequence[str], clusters: Sequence[str]) -> Fit:
    """Within-OLS without constant on demeaned data, clustered errors."""
    d = df.dropna(subset=[y, *xs]).select(*dict.fromkeys([y, *xs, *effects, *clusters]))
    return ols_clustered(demean(d, [y, *xs], effects), y, xs, clusters, const=False)


def granger(df: DataFrame, x: str, y: str, order: str, lags: int = 5) -> list[tuple[int, float, float]]:
    """(lag, F, p): whether x's past helps y's own past to tell y. df is one series, as in ols_hac."""
    one_series(df)
    w = Window.orderBy(order)
    out = []
    for m in range(1, lags + 1):
        d = df.dropna(subset=[x, y]).select(y, *[F.lag(c, k).over(w).alias(f"{p}{k}") for p, c in (("y_", y), ("x_", x)) for k in range(1, m + 1)]).dropna()
        own, both = [f"y_{k}" for k in range(1, m + 1)], [f"{p}{k}" for p in ("y_", "x_") for k in range(1, m + 1)]
        r, u = ols(d, y, own), ols(d, y, both)
        free = u.n - len(both) - 1
        f = ((r.ssr - u.ssr) / m) / (u.ssr / free)
        out.append((m, float(f), f_sf(float(f), m, free)))
    return out


def hac_mean(df: DataFrame, x: str, order: str, by: Sequence[str] = (), lags: int = 5) -> DataFrame:
    """(by, n, mean, se, t) of a series' mean with Newey-West errors."""
    d = df.filter(F.col(x).isNotNull())
    centred = d.join(d.groupBy(*by).agg(F.avg(x).alias("__m")), list(by)) if by else d.withColumn("__m", F.lit(d.agg(F.avg(x)).first()[0]).cast("double"))
    w = ordered(by, order)
    u = centred.select(*by, "__m", (F.col(x) - F.col("__m")).alias("__u"), order)
    u = u.select(*by, "__m", "__u", *[F.lag("__u", k).over(w).alias(f"__u{k}") for k in range(1, lags + 1)])
    s = F.sum(F.col("__u") * F.col("__u"))
    for k in range(1, lags + 1):
        s = s + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("__u") * F.col(f"__u{k}")), F.lit(0.0))
    g = u.groupBy(*by).agg(F.count("*").alias("n"), F.max("__m").alias("mean"), (F.sqrt(F.greatest(s, F.lit(0.0))) / F.count("*")).alias("se"))
    return g.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def spread_test(df: DataFrame, value: str, flag: str, clusters: Sequence[str], winsor: float | None = None) -> tuple[float, float, int]:
    """(difference of means flag - not flag, t, n), clustered; value cut at its winsor and 1 - winsor quantiles if given."""
    d = df.filter(F.col(value).isNotNull() & F.col(flag).isNotNull())
    if winsor:
        lo, hi = d.agg(F.percentile(value, F.lit(winsor)), F.percentile(value, F.lit(1 - winsor))).first()
        d = d.withColumn(value, F.greatest(F.least(F.col(value), F.lit(hi)), F.lit(lo)))
    fit = ols_clustered(d.withColumn("__flag", F.col(flag).cast("double")), value, ["__flag"], clusters)
    return float(fit.beta[1]), float(fit.t[1]), fit.n


def clark_west(y: Column, small: Column, large: Column) -> Column:
    """The loss difference of a model and one that nests it, adjusted for the larger one's noise."""
    return F.pow(y - small, 2) - (F.pow(y - large, 2) - F.pow(small - large, 2))


def holm(df: DataFrame, p: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """df with holm: whether the hypothesis is rejected, step down from the least p."""
    w = Window.partitionBy(*by).orderBy(F.col(p), *[c for c in df.columns if c not in by and c != p])
    k, m = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    ok = df.withColumn("__ok", F.col(p) <= F.lit(alpha) / (m - k + 1))
    return ok.withColumn("holm", F.min("__ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__ok")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """df with p_bh, the least false discovery rate at which the hypothesis is rejected."""
    down = Window.partitionBy(*by).orderBy(F.col(p).desc(), *[F.col(c).desc() for c in df.columns if c not in by and c != p])
    m = F.count("*").over(Window.partitionBy(*by))
    rank = m - F.row_number().over(down) + 1
    x = df.withColumn("__x", F.col(p) * m / rank)
    return x.withColumn("p_bh", F.least(F.min("__x").over(down.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__x")


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, kappa) of two label columns; null if chance alone agrees on all."""
    own, by = by, by or ["__all"]
    d = df.withColumn("__all", F.lit(1)).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = d.groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    total = cells.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum(F.when(F.col("__a") == F.col("__b"), F.col("__n")).otherwise(0)).alias("__same"))
    pa = cells.groupBy(*by, F.col("__a").alias("__l")).agg(F.sum("__n").alias("__na"))
    pb = cells.groupBy(*by, F.col("__b").alias("__l")).agg(F.sum("__n").alias("__nb"))
    chance = pa.join(pb, [*by, "__l"]).groupBy(*by).agg(F.sum(F.col("__na") * F.col("__nb")).alias("__c"))
    j = total.join(chance, list(by), "left")
    po, pe = F.col("__same") / F.col("n"), F.coalesce("__c", F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select(*own, "n", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, auc, brier, accuracy) of 0/1 labels and probabilities; auc is null with one class only."""
    d = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("__r", average_rank(by, score))
    n1, n0 = F.sum(F.col(label).cast("double")), F.sum(1 - F.col(label).cast("double"))
    a = (F.sum(F.when(F.col(label) == 1, F.col("__r"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))
    brier = F.avg(F.pow(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0)) - F.col(label), 2))
    hit = F.avg(((F.col(score) > 0.5).cast("int") == F.col(label)).cast("double"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), a.alias("auc"), brier.alias("brier"), hit.alias("accuracy"))


def regression_metrics(df: DataFrame, y: str, pred: str, bench: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mse, r2, r2_zero, ic, sign_acc, positive, sd) of predictions, against bench and against zero."""
    d = df.dropna(subset=[y, pred, bench])
    e, b, z = F.sum(F.pow(F.col(y) - F.col(pred), 2)), F.sum(F.pow(F.col(y) - F.col(bench), 2)), F.sum(F.pow(F.col(y), 2))
    moved = F.col(y) != 0
    return d.groupBy(*by).agg(F.count("*").alias("n"), (e / F.count("*")).alias("mse"), (1 - e / b).alias("r2"), (1 - e / z).alias("r2_zero"), F.corr(y, pred).alias("ic"), F.avg(F.when(moved, (F.signum(y) == F.signum(pred)).cast("double"))).alias("sign_acc"), F.avg((F.col(pred) > 0).cast("double")).alias("positive"), F.stddev_samp(pred).alias("sd"))


def welch(df: DataFrame, value: str, flag: str) -> tuple[float, float]:
    """(t, p that flag's mean isn't less) of two groups with their own variances."""
    rows = {r[flag]: r for r in df.dropna(subset=[value, flag]).groupBy(flag).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n")).collect()}  # two rows
    a, b = rows[True], rows[False]
    va, vb = a.v / a.n, b.v / b.n
    t = (a.m - b.m) / (va + vb) ** 0.5
    free = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    return t, 1 - t_sf(t, free)


def expected_power(t: float, n: int, n_new: int, alpha: float = 0.05) -> float:
    """Power of a one-sided test on n_new rows of an effect whose t on n rows was t."""
    return normal_sf(normal_quantile(1 - alpha) - t * (n_new / n) ** 0.5)


def one_sided(t: float) -> float:
    """p of a mean above 0."""
    return normal_sf(t)


def detectable(se: float, alpha: float = 0.05, power: float = 0.8) -> float:
    """The effect that a one-sided test finds with that power, given its standard error."""
    return se * (normal_quantile(1 - alpha) + normal_quantile(power))


def side_difference(df: DataFrame, value: str, side: str, order: str, lags: int = 5, least: int = 10) -> tuple[float, float, int] | None:
    """(difference of the means of value on rows with side 1 and -1, t with Newey-West errors, n); null with fewer than least rows on either side."""
    d = df.filter((F.col(side) != 0) & F.col(value).isNotNull()).withColumn("__long", (F.col(side) > 0).cast("double"))
    n = d.agg(F.count_if(F.col("__long") == 1).alias("a"), F.count_if(F.col("__long") == 0).alias("b")).first()
    if min(n.a, n.b) < least:
        return None
    fit = ols_hac(d, value, ["__long"], order, lags)
    return float(fit.beta[1]), float(fit.t[1]), fit.n


def extreme_spread(df: DataFrame, fwd: str, low: str, high: str, controls: Sequence[str], order: str, lags: int) -> dict[str, float]:
    """How much more fwd comes to after low days than after high ones: n, raw_diff (of the means) and diff with t and p, beside controls, Newey-West errors. df is one series."""
    d = df.dropna(subset=[fwd, low, high, *controls]).withColumns({"__low": F.col(low).cast("double"), "__high": F.col(high).cast("double")})
    fit = ols_hac(d, fwd, ["__low", "__high", *controls], order, lags)
    diff, se = fit.contrast({"__low": 1.0, "__high": -1.0})
    raw = d.agg((F.avg(F.when(F.col("__low") == 1, F.col(fwd))) - F.avg(F.when(F.col("__high") == 1, F.col(fwd)))).alias("d")).first().d
    return {"n": fit.n, "raw_diff": raw, "diff": diff, "t": diff / se, "p": 2 * normal_sf(abs(diff / se))}
