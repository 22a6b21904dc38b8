"""Factor risk: exposures from characteristics, fitted premia, their covariance, and a book's risk split by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import models, risk

#: Factors and the characteristics they are the mean score of; a minus turns the sign.
FACTORS = {
    "size": ("-log_market_cap",), "value": ("book_to_price", "earnings_yield"), "momentum": ("return_12m_1m",), "quality": ("roe", "-debt_to_equity"),
    "low_vol": ("-realised_vol_60d",), "liquidity": ("turnover_ratio",), "growth": ("sales_growth_3y",), "governance": ("-promoter_pledge_pct",),
}
WINSOR, FACTOR_LAMBDA = 3.0, 0.97


def scores(frame: DataFrame, by: list[str], columns: list[str], winsor: float = WINSOR) -> DataFrame:
    """``risk.zscore`` of several columns at once: three aggregations, however many columns; nulls score 0."""
    mid = frame.join(frame.groupBy(*by).agg(*[F.median(c).alias(f"_m_{c}") for c in columns]), by)
    x = mid.join(mid.groupBy(*by).agg(*[(1.4826 * F.median(F.abs(F.col(c) - F.col(f"_m_{c}")))).alias(f"_d_{c}") for c in columns]), by)

    def clipped(c: str) -> Column:
        m, d = F.col(f"_m_{c}"), winsor * F.col(f"_d_{c}")
        return F.when(F.col(c).isNull(), None).when(d > 0, F.least(F.greatest(F.col(c), m - d), m + d)).otherwise(F.col(c))

    x = x.withColumns({f"_x_{c}": clipped(c) for c in columns})
    s = x.groupBy(*by).agg(*[f(f"_x_{c}").alias(f"_{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    x = x.join(s, by)

    def z(c: str) -> Column:
        sd = F.col(f"_sd_{c}")
        score = F.least(F.greatest((F.col(f"_x_{c}") - F.col(f"_mean_{c}")) / sd, F.lit(-winsor)), F.lit(winsor))
        return F.coalesce(F.when((sd > 0) & F.col(f"_x_{c}").isNotNull(), score), F.lit(0.0))  # greatest skips nulls

    return x.select(*frame.columns, *[z(c).alias(f"z_{c}") for c in columns])


def build_exposures(characteristics: DataFrame, by: list[str]) -> DataFrame:
    """``market`` = 1 and each factor whose characteristics are there, in full or in part, scored within ``by``
    (usually the date); a size is taken by its logarithm, a larger one counts less."""
    known = characteristics.columns
    if "market_cap" in known:
        characteristics = characteristics.withColumn("log_market_cap", F.when(F.col("market_cap").isNotNull(), F.log(F.greatest(F.col("market_cap").cast("double"), F.lit(1.0)))))
    used = {f: [c for c in parts if c.lstrip("-") in characteristics.columns] for f, parts in FACTORS.items()}
    names = [c.lstrip("-") for parts in used.values() for c in parts]
    scored = scores(characteristics, by, names) if names else characteristics
    signed = lambda c: -F.col(f"z_{c[1:]}") if c.startswith("-") else F.col(f"z_{c}")
    each = {f: sum((signed(c) for c in parts), F.lit(0.0)) / len(parts) for f, parts in used.items() if parts}
    return scored.select(*known, F.lit(1.0).alias("market"), *[c.alias(f) for f, c in each.items()])


def fit_summary(panel: DataFrame, premia: DataFrame) -> DataFrame:
    """One row: dates fitted, dates that had too few entities, mean share explained."""
    fitted = premia.groupBy("date").agg(F.first("r2").alias("r2"))
    return panel.select("date").distinct().join(fitted.withColumn("_fit", F.lit(1)), "date", "left").agg(F.count("_fit").alias("periods_estimated"), F.count_if(F.col("_fit").isNull()).alias("periods_skipped"), F.avg("r2").alias("mean_r_squared"))


def factor_cov(premia: DataFrame, lam: float = FACTOR_LAMBDA) -> DataFrame:
    """Exponentially weighted covariance of (date, factor, premium) as (i, j, cov, n_eff)."""
    return risk.ewma_cov(premia.select("date", F.col("factor").alias("entity"), F.col("premium").alias("r")), lam)


def risk_decomposition(weights: DataFrame, exposures: DataFrame, cov: DataFrame, specific: DataFrame, factors: list[str]) -> DataFrame:
    """A row a factor: the book's exposure and its share of the variance; beside it the book's volatility, a
    day's and a year's, from factors and from what they leave, and both shares.

    ``weights`` (entity, weight), ``exposures`` (entity, factors), ``cov`` (i, j, cov), ``specific`` (entity,
    specific); weights without exposures count 0, an unknown specific risk is the median of the known ones."""
    long = exposures.select("entity", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("x")) for f in factors])).alias("e"))
    held = exposures.select("entity").join(weights, "entity").select("entity", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    fx = long.select("entity", "e.factor", "e.x").join(held, "entity").groupBy("factor").agg(F.sum(F.col("weight") * F.col("x")).alias("exposure"))
    other = fx.select(F.col("factor").alias("j"), F.col("exposure").alias("xj"))
    own = fx.withColumnRenamed("factor", "i").join(cov.select("i", "j", "cov"), "i").join(other, "j").groupBy("i").agg((F.max("exposure") * F.sum(F.col("cov") * F.col("xj"))).alias("part"))
    middle = specific.agg(F.median("specific").alias("_mid"))
    rest = held.join(specific, "entity", "left").join(F.broadcast(middle)).agg(F.sum(F.col("weight") ** 2 * F.coalesce("specific", "_mid") ** 2).alias("sv"))
    total = own.agg(F.sum("part").alias("fv")).join(F.broadcast(rest)).select("fv", F.coalesce("sv", F.lit(0.0)).alias("sv"))
    all_, root = F.col("fv") + F.col("sv"), lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    share = lambda v: F.when(all_ > 0, v / all_)
    return fx.join(own.withColumnRenamed("i", "factor"), "factor").join(F.broadcast(total)).select(
        "factor", "exposure", share(F.col("part")).alias("contribution"), root(all_).alias("total_vol"), (root(all_) * risk.DAYS**0.5).alias("total_vol_ann"),
        root(F.col("fv")).alias("factor_vol"), root(F.col("sv")).alias("specific_vol"), share(F.col("fv")).alias("pct_factor"), share(F.col("sv")).alias("pct_specific"),
    )


def ranked_summary(premia: DataFrame) -> DataFrame:
    """``models.factor_summary``, the surest factors first."""
    return models.factor_summary(premia).orderBy(F.desc(F.abs("t")), "factor")
