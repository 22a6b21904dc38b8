"""Fitted models, one group of rows a task: volatility, tails, matrices, cross-sections.

Spark deals the rows out by entity, date or book; numpy fits what a group holds. A group is one
series, one day's cross-section or one book's panel, and never the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import risk

#: Start of the volatility fit (share of the variance, shock, memory), least non-stationarity.
GARCH_START, MAX_PERSISTENCE = (0.05, 0.08, 0.90), 0.9999


def simplex_minimum(f, start, steps: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """Nelder-Mead descent with the usual coefficients."""
    n = len(start)
    points = [np.asarray(start, dtype=float)] + [np.asarray(start, dtype=float) + (0.05 * abs(start[i]) + 0.01) * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        along = lambda t: (p := middle + t * (points[-1] - middle), f(p))
        best = along(-1.0)
        if best[1] < values[0]:
            best = min(best, along(-2.0), key=lambda x: x[1])
        elif best[1] >= values[-2]:
            inner = along(-0.5 if best[1] < values[-1] else 0.5)
            best = inner if inner[1] < min(best[1], values[-1]) else None
        if best is None:
            points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
            values = [values[0]] + [f(p) for p in points[1:]]
        else:
            points[-1], values[-1] = best
    return points[int(np.argmin(values))]


def variance_path(r: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    """Conditional variances, the first one that of the sample."""
    out, v = [], float(np.var(r))
    for x in r.tolist():
        out.append(v)
        v = omega + alpha * x * x + beta * v
    return np.array([*out, v])


def garch_parameters(r: np.ndarray) -> tuple[float, float, float]:
    v0 = float(np.var(r))

    def cost(x):
        omega, alpha, beta = np.exp(np.clip(x, -50, 5))
        if alpha + beta >= MAX_PERSISTENCE:
            return 1e10
        v = variance_path(r, omega, alpha, beta)[:-1]
        return 0.5 * float(np.sum(np.log(v) + r * r / v))

    a, b, c = GARCH_START
    return tuple(np.exp(simplex_minimum(cost, np.log([a * v0, b, c]), 400)).tolist())


def garch(returns: DataFrame) -> DataFrame:
    """Per entity: omega, alpha, beta, persistence and the volatility of the next day. Fewer than 30
    returns, or returns that never move, give nulls."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("date")["r"].dropna().to_numpy()
        if len(r) < 30 or np.var(r) == 0:
            return pd.DataFrame({"entity": [g["entity"].iloc[0]], "omega": [None], "alpha": [None], "beta": [None], "persistence": [None], "next_vol": [None]})
        r = r - r.mean()
        o, a, b = garch_parameters(r)
        return pd.DataFrame({"entity": [g["entity"].iloc[0]], "omega": [o], "alpha": [a], "beta": [b], "persistence": [a + b], "next_vol": [math.sqrt(variance_path(r, o, a, b)[-1])]})

    return returns.select("entity", "date", "r").groupBy("entity").applyInPandas(fit, "entity string, omega double, alpha double, beta double, persistence double, next_vol double")


def var_filtered_historical(returns: DataFrame, confidence: float = 0.99, horizon: int = 1, n_sims: int = 20_000, seed: int = 7) -> DataFrame:
    """Per entity: value at risk and the mean beyond it of simulated paths whose shocks are drawn from the
    standardised residuals and whose variance moves with them."""

    def simulate(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("date")["r"].dropna().to_numpy()
        name = g["entity"].iloc[0]
        if len(r) < 30 or np.var(r) == 0:
            return pd.DataFrame({"entity": [name], "var": [None], "es": [None]})
        mean = r.mean()
        o, a, b = garch_parameters(r - mean)
        v = variance_path(r - mean, o, a, b)
        z = (r - mean) / np.sqrt(v[:-1])
        rng, now, total = np.random.default_rng(seed), np.full(n_sims, v[-1]), np.zeros(n_sims)
        for _ in range(horizon):
            shock = rng.choice(z, n_sims) * np.sqrt(now)
            total += mean + shock
            now = o + a * shock * shock + b * now
        q = np.quantile(total, 1 - confidence)
        return pd.DataFrame({"entity": [name], "var": [-q], "es": [-total[total <= q].mean()]})

    return returns.select("entity", "date", "r").groupBy("entity").applyInPandas(simulate, "entity string, var double, es double")


def gpd_parameters(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of a generalised Pareto tail by maximum likelihood."""

    def cost(x):
        xi, beta = x[0], math.exp(min(50.0, max(-50.0, x[1])))
        if abs(xi) < 1e-8:
            return len(excess) * math.log(beta) + float(excess.sum()) / beta
        inside = 1 + xi * excess / beta
        return 1e10 if (inside <= 0).any() else len(excess) * math.log(beta) + (1 + 1 / xi) * float(np.log(inside).sum())

    xi, scale = simplex_minimum(cost, [0.1, math.log(excess.mean())])
    return float(xi), math.exp(scale)


def var_extreme(returns: DataFrame, confidence: float = 0.99, threshold: float = 0.95) -> DataFrame:
    """Per entity: value at risk and the mean beyond it from the losses above a quantile; nulls under 20
    such losses. The mean is infinite for a shape of 1 or more."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        loss = -g["r"].dropna().to_numpy()
        row = {"entity": g["entity"].iloc[0], "shape": None, "scale": None, "var": None, "es": None, "n_tail": 0}
        if len(loss):
            u = np.quantile(loss, threshold)
            excess = loss[loss > u] - u
            row["n_tail"] = len(excess)
            if len(excess) >= 20:
                xi, beta = gpd_parameters(excess)
                rate = len(loss) / len(excess) * (1 - confidence)
                var = u - beta * math.log(rate) if abs(xi) < 1e-8 else u + beta / xi * (rate**-xi - 1)
                row |= {"shape": xi, "scale": beta, "var": float(var), "es": float((var + beta - xi * u) / (1 - xi)) if xi < 1 else math.inf}
        return pd.DataFrame([row])

    return returns.select("entity", "r").groupBy("entity").applyInPandas(fit, "entity string, shape double, scale double, var double, es double, n_tail int")


#: Names of the estimators, in their order.
ENSEMBLE = ("historical", "parametric_normal", "parametric_cf", "filtered_historical", "evt_pot")


def var_ensemble(returns: DataFrame, confidence: float = 0.99, horizon: int = 1) -> DataFrame:
    """(entity, method, var, es, n_obs, error, spread_ratio): every estimator for every entity. One that can't
    answer has an error and nulls; the ratio is that of the largest to the smallest positive answer."""
    good = risk.clean(returns, 1)
    n = good.groupBy("entity").agg(F.count("*").alias("n_obs"))
    enough, root = risk.clean(returns), horizon**0.5
    runs = {
        "historical": risk.var_historical(enough, confidence, horizon),
        "parametric_normal": risk.var_parametric(enough, confidence, horizon, expand=False),
        "parametric_cf": risk.var_parametric(enough, confidence, horizon),
        "filtered_historical": var_filtered_historical(enough, confidence, horizon),
        "evt_pot": var_extreme(enough, confidence).withColumns({"var": F.col("var") * root, "es": F.col("es") * root}),
    }
    rows = None
    for method in ENSEMBLE:
        r = runs[method].select("entity", F.lit(method).alias("method"), "var", "es")
        rows = r if rows is None else rows.unionByName(r)
    grid = n.select("entity", "n_obs", F.explode(F.array(*[F.lit(m) for m in ENSEMBLE])).alias("method"))
    few = F.when(F.col("n_obs") < 30, F.format_string("need >= 30 observations for VaR, got %d", "n_obs"))
    error = F.coalesce(few, F.when(F.col("var").isNull(), "too few losses beyond the threshold, or returns that never move"), F.lit(""))
    every = W.partitionBy("entity")
    lo, hi = F.min("var").over(every), F.max("var").over(every)
    return grid.join(rows, ["entity", "method"], "left").select("entity", "method", "var", "es", "n_obs", error.alias("error"), F.when((F.count("var").over(every) > 1) & (lo > 0), hi / lo).alias("spread_ratio"))


def estimate(returns: DataFrame, method: str = "shrunk_ewma") -> DataFrame:
    """A covariance by its name: (i, j, cov, ...). Without a column ``book`` the fitted ones take all entities
    as one book, whose panel one task holds."""
    known = {
        "sample": risk.sample_cov, "ewma": risk.ewma_cov, "shrunk_ewma": lambda r: risk.shrunk_cov(risk.ewma_cov(r)),
        "ledoit_wolf": lambda r: shrinkage_cov(r if "book" in r.columns else r.withColumn("book", F.lit("all")), "ledoit_wolf"),
        "oas": lambda r: shrinkage_cov(r if "book" in r.columns else r.withColumn("book", F.lit("all")), "oas"),
    }
    if method not in known:
        raise ValueError(f"unknown method {method!r}; choose from {sorted(known)}")
    return known[method](returns)


def _shrunk(x: np.ndarray, method: str) -> tuple[np.ndarray, float]:
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = float(np.trace(s)) / p
    if method == "ledoit_wolf":
        squares = float(((x**2).T @ (x**2)).sum()) / n
        cross = float((s**2).sum())
        far = (cross - 2 * mu * float(np.trace(s)) + p * mu * mu) / p
        near = min((squares - cross) / (p * n), far)
        d = near / far if far > 0 else 0.0
    elif method == "oas":
        alpha, den = float((s**2).mean()), 0.0
        den = (n + 1) * (alpha - mu * mu / p)
        d = 1.0 if den == 0 else min((alpha + mu * mu) / den, 1.0)
    else:
        raise ValueError(f"unknown method {method!r}: ledoit_wolf or oas")
    return (1 - d) * s + d * mu * np.eye(p), d


def nearest_psd(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """The symmetric matrix with its eigenvalues raised to ``floor``."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors @ np.diag(np.maximum(values, floor)) @ vectors.T


def shrinkage_cov(returns: DataFrame, method: str = "ledoit_wolf", book: str = "book") -> DataFrame:
    """(book, i, j, cov, shrinkage, condition, n_filled) per book of (book, entity, date, r): covariance
    shrunk to a scaled identity. Missing returns count as 0 and their number is reported."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="date", columns="entity", values="r", aggfunc="last").dropna(axis=1, how="all")
        filled = int(wide.isna().sum().sum())
        m, d = _shrunk(wide.fillna(0.0).to_numpy(), method)
        m = nearest_psd(m)
        values = np.linalg.eigvalsh(m)
        names = wide.columns.to_numpy()
        k = len(names)
        return pd.DataFrame({"book": g[book].iloc[0], "i": np.repeat(names, k), "j": np.tile(names, k), "cov": m.ravel(), "shrinkage": d, "condition": float(values[-1] / values[0]), "n_filled": filled})

    return returns.select(book, "entity", "date", "r").groupBy(book).applyInPandas(fit, "book string, i string, j string, cov double, shrinkage double, condition double, n_filled int")


def exposures(frame: DataFrame, scores: dict[str, list[Column]]) -> DataFrame:
    """``market`` = 1 and, for each factor, the mean of its scored characteristics, without those that are null."""
    out = frame.withColumn("market", F.lit(1.0))
    for name, columns in scores.items():
        known = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
        out = out.withColumn(name, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(known, F.lit(0)))
    return out


def cross_sectional_regression(panel: DataFrame, factors: list[str], cap: str = "cap") -> DataFrame:
    """(date, factor, premium, r2, n) per date of (date, entity, r, cap, factors): weighted least squares by
    the root of the size, with one pass that takes weight from residuals beyond two deviations. A date
    needs five rows more than factors."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=["r", *factors])
        if len(g) < len(factors) + 5:
            return g[["date"]].iloc[:0].assign(factor="", premium=0.0, r2=0.0, n=0)
        x, y = g[factors].to_numpy(dtype=float), g["r"].to_numpy(dtype=float)
        w = np.sqrt(np.maximum(g[cap].fillna(0).to_numpy(dtype=float), 0)) if cap in g else np.ones(len(g))
        w = w / w.mean() if w.sum() > 0 else np.ones(len(g))

        def solved(w):
            root = np.sqrt(w)
            return np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]

        e = y - x @ solved(w)
        scale = 1.4826 * np.median(np.abs(e - np.median(e)))
        b = solved(w * np.minimum(1.0, 2 * scale / np.maximum(np.abs(e), 1e-12))) if scale > 0 else solved(w)
        e = y - x @ b
        spread = float(((y - y.mean()) ** 2).sum())
        return pd.DataFrame({"date": g["date"].iloc[0], "factor": factors, "premium": b, "r2": 1 - float((e**2).sum()) / spread if spread > 0 else np.nan, "n": len(g)})

    columns = ["date", "entity", "r", *factors] + ([cap] if cap in panel.columns else [])
    return panel.select(*columns).groupBy("date").applyInPandas(fit, "date date, factor string, premium double, r2 double, n int")


def factor_summary(premia: DataFrame, days: int = 252) -> DataFrame:
    """Per factor: annual mean and volatility, their ratio, t, and its two-sided p-value."""
    from ..functions.stats import t_two_sided

    s = premia.groupBy("factor").agg(F.avg("premium").alias("m"), F.stddev_samp("premium").alias("sd"), F.count("premium").alias("n"))
    s = s.withColumn("t", F.col("m") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt("n"))
    return s.select("factor", (F.col("m") * days).alias("mean"), (F.col("sd") * days**0.5).alias("vol"), (F.col("m") / F.nullif("sd", F.lit(0.0)) * days**0.5).alias("sharpe"), "t", t_two_sided(F.col("t"), (F.col("n") - 1).cast("double")).alias("p"), "n")


def specific_risk(panel: DataFrame, premia: DataFrame, factors: list[str], floor: float = 0.005) -> DataFrame:
    """Per entity: deviation of what the factors leave of its returns; the median of all where unknown."""
    wide = premia.groupBy("date").pivot("factor", factors).agg(F.first("premium"))
    wide = wide.select("date", *[F.col(f"`{f}`").alias(f"_p_{f}") for f in factors])
    left = panel.join(wide, "date").withColumn("e", F.col("r") - sum((F.col(f) * F.col(f"_p_{f}") for f in factors), F.lit(0.0)))
    s = left.groupBy("entity").agg(F.stddev_samp("e").alias("sd"))
    return s.join(F.broadcast(s.agg(F.median("sd").alias("m")))).select("entity", F.greatest(F.coalesce("sd", "m"), F.lit(floor)).alias("specific"))
