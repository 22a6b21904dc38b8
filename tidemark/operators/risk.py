"""Market risk on long frames: (entity, date, price) and (entity, date, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.shared import cut
from ..functions.stats import chi2_sf1, chi2_sf2, norm_pdf, norm_ppf
from . import series

LAMBDA, DAYS = 0.94, 252


def _path(entity: str = "entity"):
    return W.partitionBy(entity).orderBy("date")


def simple_returns(prices: DataFrame) -> DataFrame:
    """Change from the last known price; gaps in the price are padded; first dates have none."""
    known = prices.withColumn("price", F.last("price", ignorenulls=True).over(_path().rowsBetween(W.unboundedPreceding, 0)))
    return known.select("entity", "date", (F.col("price") / F.lag("price").over(_path()) - 1).alias("r")).where("r is not null")


def log_returns(prices: DataFrame) -> DataFrame:
    return prices.select("entity", "date", F.log(F.col("price") / F.lag("price").over(_path())).alias("r")).where("r is not null")


def stale_runs(prices: DataFrame, max_run: int = 5) -> DataFrame:
    """Per entity: observations, days on which the price stood still, longest such run, suspect."""
    moved = F.coalesce((F.col("price") != F.lag("price").over(_path())).cast("int"), F.lit(1))
    rows = prices.withColumn("moved", moved).withColumn("island", F.sum("moved").over(_path()))
    runs = rows.groupBy("entity", "island").agg((F.count("*") - 1).alias("still"), F.count("*").alias("n"))
    return runs.groupBy("entity").agg(F.sum("n").alias("n_obs"), F.sum("still").alias("stale_days"), F.max("still").alias("max_run")).withColumn("suspect", F.col("max_run") > max_run)


def adjust_for_actions(prices: DataFrame, actions: DataFrame, rows_per_block: int = series.ROWS_PER_BLOCK) -> DataFrame:
    """Prices times the ratios of the later ex-dates of the entity (entity, ex_date, ratio).

    One running product, from the last date back, over prices and actions together: the work is that of both
    tables, however many actions a price has. Of several prices of a date the largest counts; null prices stay null."""
    p = prices.groupBy("entity", "date").agg(F.max("price").alias("price")).withColumns({"_rank": F.lit(1), "_ratio": F.lit(None).cast("double")})
    a = actions.select("entity", F.col("ex_date").cast(p.schema["date"].dataType).alias("date"), F.lit(None).cast(p.schema["price"].dataType).alias("price"), F.lit(0).alias("_rank"), F.col("ratio").cast("double").alias("_ratio")).where("date is not null and entity is not null")
    # Backwards, a date's prices come before its own actions, which don't touch them.
    after = series.scan(p.unionByName(a), ["entity"], ["date", "_rank"], {"factor": ("product", F.col("_ratio"))}, descending=True, rows_per_block=rows_per_block).where("_rank = 1")
    factor = F.when(F.col("date").isNotNull(), F.coalesce("factor", F.lit(1.0))).otherwise(1.0)
    return after.select("entity", "date", (F.col("price") * factor).alias("price"), factor.alias("factor"))


def clean(returns: DataFrame, least: int = 30) -> DataFrame:
    """Finite returns of the entities that have ``least`` of them."""
    finite = returns.where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf")))
    return finite.withColumn("_n", F.count("*").over(W.partitionBy("entity"))).where(F.col("_n") >= least).drop("_n")


def align_prices(prices: DataFrame, min_obs: int = 60, max_run: int = 5) -> DataFrame:
    """Per entity of a panel: observations, share of the panel's dates, days without a move, the longest run
    of them, whether that is suspect, and whether the entity has ``min_obs`` prices and so is kept.

    A day without a price ends a run. The dates are numbered in one task, a row a date."""
    known = prices.where("price is not null")
    days = prices.select("date").distinct().withColumn("_day", F.row_number().over(W.orderBy("date")))
    still = (F.col("price") == F.lag("price").over(_path())) & (F.col("_day") == F.lag("_day").over(_path()) + 1)
    rows = known.join(days, "date").withColumn("_still", F.coalesce(still, F.lit(False)))
    rows = rows.withColumn("_run", F.count_if(~F.col("_still")).over(_path()))
    runs = rows.groupBy("entity", "_run").agg(F.count("*").alias("_n"), F.count_if("_still").alias("_s"))
    out = runs.groupBy("entity").agg(F.sum("_n").alias("n_obs"), F.sum("_s").alias("stale_days"), F.max("_s").alias("max_stale_run"))
    return out.join(F.broadcast(days.agg(F.max("_day").alias("_all")))).select("entity", "n_obs", (F.col("n_obs") / F.col("_all")).alias("coverage"), "stale_days", "max_stale_run", (F.col("max_stale_run") > max_run).alias("suspect"), (F.col("n_obs") >= min_obs).alias("kept"))


def dense(returns: DataFrame) -> DataFrame:
    """A return for every entity on every date, 0 where there is none; entities without any are left out.

    As many rows as the full panel, which is what matrices of it read."""
    live = returns.where("r is not null").select("entity", "date", "r")
    panel = live.select("entity").distinct().crossJoin(returns.select("date").distinct())
    return panel.join(live, ["entity", "date"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))


def _quantiles(returns: DataFrame, shares: list[float], counted: bool) -> DataFrame:
    """(entity, b): linear quantiles of each entity, by ``percentile``, which holds an entity's values, or counted."""
    if counted:
        return series.quantiles(returns, ["entity"], "r", shares).withColumnRenamed("quantiles", "b")
    return returns.groupBy("entity").agg(F.percentile("r", F.array(*[F.lit(q) for q in shares])).alias("b"))


def winsorize(returns: DataFrame, lo: float = 0.01, hi: float = 0.99, counted: bool = False) -> DataFrame:
    """Returns within two quantiles of their entity. ``counted`` is for entities whose values no task should hold.

    The returns are written once: sums made anew may differ in the last bit, and a quantile would then be no return."""
    returns = cut(returns.select("entity", "date", "r"))
    bounds = _quantiles(returns, [lo, hi], counted)
    return returns.join(bounds, "entity").select("entity", "date", F.when(F.col("r").isNotNull(), F.least(F.greatest("r", F.col("b")[0]), F.col("b")[1])).alias("r"))


def realised_vol(returns: DataFrame, window: int = 21) -> DataFrame:
    """Annualised rolling standard deviation, where the window is full."""
    frame = _path().rowsBetween(1 - window, 0)
    return returns.select("entity", "date", F.when(F.count("r").over(frame) == window, F.stddev_samp("r").over(frame) * DAYS**0.5).alias("vol"))


def drawdown(prices: DataFrame, rows_per_block: int | None = None) -> DataFrame:
    """Price below its maximum so far. With ``rows_per_block`` an entity is as many tasks as it has blocks."""
    if rows_per_block:
        high = series.scan(prices, ["entity"], ["date"], {"_high": ("max", F.col("price"))}, rows_per_block=rows_per_block)
        return high.select("entity", "date", (F.col("price") / F.col("_high") - 1).alias("drawdown"))
    return prices.select("entity", "date", (F.col("price") / F.max("price").over(_path().rowsBetween(W.unboundedPreceding, 0)) - 1).alias("drawdown"))


def amihud(returns: DataFrame, window: int = 60) -> DataFrame:
    """Rolling mean of |r| per unit of traded value, times a million, from max(5, window / 4) values on."""
    frame, x = _path().rowsBetween(1 - window, 0), F.abs("r") / F.nullif("volume", F.lit(0))
    return returns.withColumn("_x", x).select("entity", "date", F.when(F.count("_x").over(frame) >= max(5, window // 4), F.avg("_x").over(frame) * 1e6).alias("amihud"))


def circuit_limit_risk(returns: DataFrame, limit: float, lookback: int = 252) -> DataFrame:
    recent = returns.withColumn("_n", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date")))).where(F.col("_n") <= lookback)
    hit = F.abs("r") >= 0.99 * limit
    return recent.groupBy("entity").agg(F.count("r").alias("n_obs"), F.count_if(hit).alias("hits"), F.max(F.abs("r")).alias("max_move")).withColumn("pct", F.col("hits") / F.col("n_obs")).withColumn("flag", F.col("pct") > 0.01)


def var_historical(returns: DataFrame, confidence: float = 0.99, horizon: int = 1, counted: bool = False) -> DataFrame:
    """Per entity: value at risk by the linear quantile, the mean beyond it, tail size, worst. ``counted`` is for
    entities whose values no task should hold. The returns are written once, as for :func:`winsorize`."""
    returns = cut(returns.select("entity", "r"))
    at = _quantiles(returns, [round(1 - confidence, 12)], counted).select("entity", F.col("b")[0].alias("q"))
    root = horizon**0.5
    tail = F.when(F.col("r") <= F.col("q"), F.col("r"))
    return returns.join(at, "entity").groupBy("entity").agg(
        (-F.max("q") * root).alias("var"), (-F.avg(tail) * root).alias("es"), F.count(tail).alias("n_tail"), F.min("r").alias("worst"), F.count("r").alias("n_obs")
    )


def var_parametric(returns: DataFrame, confidence: float = 0.99, horizon: int = 1, expand: bool = True) -> DataFrame:
    """Gaussian or, with ``expand``, Cornish-Fisher value at risk per entity; the expansion is used where it is
    monotone."""
    z, root = norm_ppf(1 - confidence), horizon**0.5
    m = returns.groupBy("entity").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt"), F.count("r").alias("n_obs"))
    m = m.withColumn("z_cf", cornish_fisher(F.lit(z), F.col("skew"), F.col("kurt"))).withColumn("cf_valid", cornish_fisher_valid(F.col("skew"), F.col("kurt")))
    used = F.when(F.col("cf_valid") & F.lit(expand), F.col("z_cf")).otherwise(z)
    jb = F.col("n_obs") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return m.select(
        "entity", "mu", "sd", "skew", "kurt", "cf_valid", (-(F.col("mu") + used * F.col("sd")) * root).alias("var"),
        (-(F.col("mu") - F.col("sd") * norm_pdf(z) / (1 - confidence)) * F.abs(used) / abs(z) * root).alias("es"), F.exp(-jb / 2).alias("jarque_bera_p"),
    )


def cornish_fisher(z: Column, s: Column, k: Column) -> Column:
    return z + (z**2 - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s**2 / 36


def cornish_fisher_valid(skew: Column, kurt: Column, points: int = 200) -> Column:
    """Whether the expansion rises over z from -4 to -1, and the excess kurtosis is 7 at most."""
    at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: cornish_fisher(-4.0 + i * (3.0 / (points - 1)), skew, kurt))
    falls = F.exists(F.zip_with(F.slice(at, 1, points - 1), F.slice(at, 2, points - 1), lambda a, b: b - a), lambda d: d <= 0)
    return ~falls & (kurt <= 7)


def pairs(returns: DataFrame) -> DataFrame:
    """Returns of entities i and j on the same dates. The number of entities, not of rows, is squared."""
    a, b = returns.select("date", F.col("entity").alias("i"), F.col("r").alias("ri")), returns.select("date", F.col("entity").alias("j"), F.col("r").alias("rj"))
    return a.join(b, "date")


def sample_cov(returns: DataFrame) -> DataFrame:
    return pairs(returns).groupBy("i", "j").agg(F.covar_samp("ri", "rj").alias("cov"), F.count("*").alias("n_obs"))


def ewma_cov(returns: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """Exponentially weighted covariance, weights by the age of the date, centred on weighted means; with
    the effective number of observations."""
    dates = returns.select("date").distinct().withColumn("age", F.row_number().over(W.orderBy(F.desc("date"))) - 1)
    dates = dates.withColumn("w", (1 - lam) * F.pow(F.lit(lam), "age"))
    both = pairs(returns).join(dates.select("date", "w"), "date")
    s = both.groupBy("i", "j").agg(F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sw2"), *[F.sum(F.col("w") * x).alias(n) for n, x in (("mi", F.col("ri")), ("mj", F.col("rj")), ("mij", F.col("ri") * F.col("rj")))])
    return s.select("i", "j", (F.col("mij") / F.col("sw") - F.col("mi") * F.col("mj") / F.col("sw") ** 2).alias("cov"), (F.col("sw") ** 2 / F.col("sw2")).alias("n_eff"))


def shrunk_cov(cov: DataFrame) -> DataFrame:
    """Correlations shrunk to their mean, volatilities kept; the intensity is n / (n + effective observations)
    between .05 and .95, n being the number of entities."""
    v = cov.where("i = j").select(F.col("i").alias("e"), F.sqrt("cov").alias("vol"))
    c = cov.join(v.select(F.col("e").alias("i"), F.col("vol").alias("vi")), "i").join(v.select(F.col("e").alias("j"), F.col("vol").alias("vj")), "j").withColumn("corr", F.col("cov") / (F.col("vi") * F.col("vj")))
    mean = c.agg(F.avg(F.when(F.col("i") != F.col("j"), F.col("corr"))).alias("mean_corr"), F.countDistinct("i").alias("n"), F.max("n_eff").alias("eff"))
    c = c.join(F.broadcast(mean))  # one row
    d = F.least(F.greatest(F.col("n") / (F.col("n") + F.col("eff")), F.lit(0.05)), F.lit(0.95))
    shrunk = F.when(F.col("i") == F.col("j"), 1.0).otherwise(d * F.col("mean_corr") + (1 - d) * F.col("corr"))
    return c.select("i", "j", (shrunk * F.col("vi") * F.col("vj")).alias("cov"), d.alias("shrinkage"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Per entity: weight, marginal contribution, share of the portfolio's volatility (they add up to 1). Entities
    without a weight have 0."""
    w = lambda k: weights.select(F.col("entity").alias(k), F.col("weight").alias(f"w{k}"))
    none = F.lit(0.0)
    m = cov.join(w("i"), "i", "left").join(w("j"), "j", "left").groupBy("i").agg(F.coalesce(F.max("wi"), none).alias("weight"), F.sum(F.coalesce("wj", none) * F.col("cov")).alias("sw"))
    total = m.agg(F.sqrt(F.sum(F.col("weight") * F.col("sw"))).alias("vol"))
    return m.join(F.broadcast(total)).select(F.col("i").alias("entity"), "weight", (F.col("sw") / F.col("vol")).alias("marginal"), (F.col("weight") * F.col("sw") / F.col("vol") ** 2).alias("share"), "vol")


def zscore(frame: DataFrame, by: list[str], value: str, winsor: float = 3.0) -> DataFrame:
    """Cross-sectional score: clipped at the median by median absolute deviations, standardised, clipped."""
    mid = frame.join(frame.groupBy(*by).agg(F.median(value).alias("_m")), by)
    mad = mid.groupBy(*by).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_d"))
    x = mid.join(mad, by).withColumn("_x", F.when((F.col("_d") > 0) & F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_m") - winsor * F.col("_d")), F.col("_m") + winsor * F.col("_d"))).otherwise(F.col(value)))
    s = x.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.stddev_samp("_x").alias("_sd"))
    z = F.when((F.col("_sd") > 0) & F.col("_x").isNotNull(), F.least(F.greatest((F.col("_x") - F.col("_mean")) / F.col("_sd"), F.lit(-winsor)), F.lit(winsor))).otherwise(0.0)
    return x.join(s, by).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("_m", "_d", "_x", "_mean", "_sd")


def concentration(positions: DataFrame) -> DataFrame:
    """Herfindahl index, its inverse, shares of the largest 1, 5 and 10, positions."""
    total = positions.agg(F.sum(F.abs("value")).alias("total"))
    top = positions.select(F.abs("value").alias("v")).orderBy(F.desc("v")).limit(10).withColumn("n", F.row_number().over(W.orderBy(F.desc("v"))))
    tops = top.agg(*[F.sum(F.when(F.col("n") <= k, F.col("v"))).alias(f"top{k}") for k in (1, 5, 10)])
    sums = positions.agg(F.sum(F.pow("value", F.lit(2))).alias("ss"), F.count_if(F.abs("value") > 0).alias("n_positions"))
    row = sums.join(F.broadcast(total)).join(F.broadcast(tops))
    hhi = F.col("ss") / F.nullif(F.col("total") ** 2, F.lit(0.0))
    return row.select(hhi.alias("hhi"), (1 / hhi).alias("effective_n"), *[(F.col(f"top{k}") / F.nullif("total", F.lit(0.0))).alias(f"top{k}") for k in (1, 5, 10)], "n_positions")


def days_to_liquidate(positions: DataFrame, adv: DataFrame, participation: float = 0.20) -> DataFrame:
    """Days to sell each position at a share of the traded value; without any it is untradeable."""
    days = F.abs("value") / F.nullif(F.col("adv") * participation, F.lit(0.0))
    bucket = F.when(F.col("days").isNull(), "untradeable")
    for most in (1, 3, 10, 30):
        bucket = bucket.when(F.col("days") <= most, f"<={most}d")
    return positions.join(adv, "entity", "left").withColumn("days", days).withColumn("bucket", bucket.otherwise(">30d"))


def liquidity_adjusted_var(var: Column, days: Column, cost_bps: Column) -> Column:
    d = F.sqrt(F.greatest(days, F.lit(1.0)))
    return var * d + cost_bps / 1e4 * d


#: Fixed values of the scenarios: equity, further mid/small-cap shock, rates bp, credit bp, rupee, oil.
SCENARIOS = {
    "gfc_2008": (-0.55, -0.15, -150.0, 400.0, 0.22, -0.70),
    "taper_tantrum_2013": (-0.12, -0.10, 300.0, 150.0, 0.20, 0.05),
    "demonetisation_2016": (-0.08, -0.06, -50.0, 0.0, 0.03, 0.0),
    "ilfs_2018": (-0.14, -0.22, 50.0, 250.0, 0.08, 0.0),
    "covid_crash_2020": (-0.38, -0.10, -100.0, 300.0, 0.07, -0.65),
    "adani_2023": (-0.05, -0.08, 0.0, 80.0, 0.0, 0.0),
    "oil_shock_hypo": (-0.18, -0.07, 150.0, 120.0, 0.15, 0.90),
    "monsoon_failure_hypo": (-0.10, -0.08, 100.0, 0.0, 0.05, 0.0),
    "fpi_exodus_hypo": (-0.22, -0.12, 120.0, 150.0, 0.12, 0.0),
}
SCENARIO_COLUMNS = "scenario string, equity double, midcap double, rates_bp double, credit_bp double, fx double, oil double"


def scenarios(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SCENARIOS.items()], SCENARIO_COLUMNS)


def stress(book: DataFrame, given: DataFrame) -> DataFrame:
    """Profit and loss of each position in each scenario. Optional columns that the book lacks count as
    1 (beta) or 0 and are what ``unmodelled`` lists. Scenarios are a handful of rows."""
    col = lambda c, default=0.0: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in book.columns else F.lit(default)
    small = (F.col("cap_segment").isin("mid", "small") if "cap_segment" in book.columns else F.lit(False))
    dy = F.col("rates_bp") / 1e4
    parts = {
        "equity_pnl": F.col("value") * col("beta", 1.0) * (F.col("equity") + F.when(small, F.col("midcap")).otherwise(0.0)),
        "rates_pnl": F.col("value") * (-col("duration") * dy + 0.5 * col("convexity") * dy**2),
        "credit_pnl": -col("credit_spread_dv01") * F.col("credit_bp"),
        "fx_pnl": col("fx_exposure") * F.col("fx"),
        "oil_pnl": F.col("value") * col("oil_beta") * F.col("oil"),
    }
    out = book.join(F.broadcast(given)).withColumns(parts)
    return out.withColumn("total_pnl", sum((F.col(c) for c in parts), F.lit(0.0)))


def stress_totals(book: DataFrame, given: DataFrame) -> DataFrame:
    """Per scenario, worst first: profit and loss, its share of the book, the worst position."""
    return stress(book, given).groupBy("scenario").agg(F.sum("total_pnl").alias("pnl"), (F.sum("total_pnl") / F.sum("value")).alias("pnl_pct"), F.min_by("name", F.struct("total_pnl", "name")).alias("worst_position")).orderBy("pnl")


def unmodelled(book: DataFrame) -> list[str]:
    return [c for c in ("beta", "cap_segment", "duration", "convexity", "credit_spread_dv01", "fx_exposure", "oil_beta") if c not in book.columns]


def rolling_var_backtest(returns: DataFrame, window: int = 500, confidence: float = 0.99) -> DataFrame:
    """Historical value at risk of each date from the ``window`` returns before it, and whether it was exceeded."""
    frame = _path().rowsBetween(-window, -1)
    out = returns.select("entity", "date", "r", F.when(F.count("r").over(frame) == window, -F.percentile("r", 1 - confidence).over(frame)).alias("var"))
    return out.where("var is not null").withColumn("exceeded", F.col("r") < -F.col("var"))


def rolling_backtest(returns: DataFrame, estimator, window: int = 500, confidence: float = 0.99, step: int = 1, **arguments) -> DataFrame:
    """``coverage_tests`` of any estimator's forecasts, each from the ``window`` returns before its date, with ``failed``, the
    number of calls that gave none; see ``series.rolling``. An entity without a forecast has its failures only."""
    made = cut(series.rolling(returns, estimator, window, step, confidence=confidence, **arguments))  # read four times
    told = made.withColumnRenamed("estimate", "var").withColumn("exceeded", F.col("r") < -F.col("var"))
    tests = coverage_tests(told.where("var is not null"), 1 - confidence, series.ROWS_PER_BLOCK)
    return tests.join(told.groupBy("entity").agg(F.count_if(F.col("var").isNull()).alias("failed")).withColumnRenamed("entity", "_e"), F.col("entity").eqNullSafe(F.col("_e")), "right").select(F.col("_e").alias("entity"), *[c for c in tests.columns if c != "entity"], "failed")


def kupiec_lr(n: Column, x: Column, p: float) -> Column:
    h = x / n
    full = -2 * ((n - x) * F.log(F.lit(1 - p)) + x * F.log(F.lit(p)) - (n - x) * F.log(1 - h) - x * F.log(h))
    return F.when(x == 0, -2 * n * F.log(F.lit(1 - p))).when(x == n, -2 * n * F.log(F.lit(p))).otherwise(full)


def coverage_tests(exceptions: DataFrame, p: float = 0.01, rows_per_block: int | None = None) -> DataFrame:
    """Per entity: exceptions, transitions, the statistics and p-values of Kupiec, Christoffersen and both
    together, traffic light, verdict (fixed texts). With ``rows_per_block`` an entity is as many tasks as it has blocks."""
    rows = exceptions.withColumn("e", F.col("exceeded").cast("int"))
    if rows_per_block:
        rows = series.scan(rows.select("entity", "date", "e"), ["entity"], ["date"], {"before": ("last", F.col("e"))}, exclusive=True, rows_per_block=rows_per_block)
    else:
        rows = rows.withColumn("before", F.lag("e").over(_path()))
    n = {f"n{a}{b}": F.count_if((F.col("before") == a) & (F.col("e") == b)) for a in (0, 1) for b in (0, 1)}
    t = rows.groupBy("entity").agg(F.count("*").alias("n"), F.sum("e").alias("x"), *[c.alias(k) for k, c in n.items()])
    pi01, pi11 = F.col("n01") / (F.col("n00") + F.col("n01")), F.col("n11") / (F.col("n10") + F.col("n11"))
    pi = (F.col("n01") + F.col("n11")) / (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    null = (F.col("n00") + F.col("n10")) * F.log(1 - pi) + (F.col("n01") + F.col("n11")) * F.log(pi)
    alt = F.col("n00") * F.log(1 - pi01) + F.col("n01") * F.log(pi01) + F.col("n10") * F.log(1 - pi11) + F.col("n11") * F.log(pi11)
    usable = (F.col("n00") + F.col("n01") > 0) & (F.col("n10") + F.col("n11") > 0) & (F.col("n01") > 0) & (F.col("n11") > 0) & (F.col("n10") > 0)
    light = F.when(F.col("x") <= 4 * F.col("n") / 250, "green").when(F.col("x") <= 9 * F.col("n") / 250, "yellow").otherwise("red")
    kupiec = kupiec_lr(F.col("n"), F.col("x"), p)
    out = t.select("entity", "n", "x", *n, kupiec.alias("kupiec"), F.when(usable, -2 * (null - alt)).otherwise(0.0).alias("christoffersen"), light.alias("light"))
    zero = F.lit(0.0)
    out = out.withColumns({"kupiec_p": chi2_sf1(F.greatest("kupiec", zero)), "christoffersen_p": chi2_sf1(F.greatest("christoffersen", zero)), "conditional": F.col("kupiec") + F.col("christoffersen")})
    few = F.concat(F.lit("inconclusive - "), F.col("n").cast("string"), F.lit(f" observations is too few to test a {1 - p:.0%} VaR"))
    verdict = (
        F.when(F.col("n") < 100, few)
        .when((F.col("kupiec_p") < 0.05) & (F.col("x") / F.col("n") > p), "REJECTED - too many exceptions; the model understates risk")
        .when(F.col("kupiec_p") < 0.05, "rejected - too few exceptions; the model overstates risk and wastes capital")
        .when(F.col("christoffersen_p") < 0.05, "rejected on independence - exceptions cluster. The count is right but they arrive together, which is the dangerous failure")
        .otherwise("not rejected - consistent with the data")
    )
    return out.withColumns({"conditional_p": chi2_sf2(F.col("conditional")), "verdict": verdict})
