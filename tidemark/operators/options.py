"""Option chains: put-call ratio, implied distribution of the underlying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import expit, logit

#: Formats of expiries, tried in this order.
EXPIRY_FORMATS = ("d-MMM-yyyy", "d-M-yyyy", "yyyy-M-d")
RATE, BAND = 0.0525, (0.80, 1.20)


def put_call_ratio(chain: DataFrame, by: list[str]) -> DataFrame:
    calls, puts = (F.sum(F.when(F.col("side") == s, F.col("oi"))) for s in ("CE", "PE"))
    return chain.groupBy(*by).agg(F.when(calls > 0, puts / calls).alias("pcr"))


def price(bid, ask, last):
    """Middle of bid and ask where both are quoted, else the last trade."""
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(last)


def implied_cdf(calls: DataFrame, years: float | Column, rate: float = RATE, by: str = "expiry") -> DataFrame:
    """1 + e^(rT) dC/dK with the slope of unequal steps, one-sided at the ends, made monotone in [0, 1]."""
    years = F.lit(years) if isinstance(years, (int, float)) else years
    o = W.partitionBy(by).orderBy("strike")
    k, c = F.col("strike"), F.col("call")
    h1, h2 = k - F.lag(k).over(o), F.lead(k).over(o) - k
    d1, d2 = (c - F.lag(c).over(o)) / h1, (F.lead(c).over(o) - c) / h2
    slope = F.when(h1.isNull(), d2).when(h2.isNull(), d1).otherwise((d1 * h2 + d2 * h1) / (h1 + h2))
    raw = calls.withColumn("cdf", 1 + F.exp(rate * years) * slope)
    rising = F.max("cdf").over(o.rowsBetween(W.unboundedPreceding, 0))
    return raw.withColumn("cdf", F.least(F.greatest(rising, F.lit(0.0)), F.lit(1.0)))


def years_to(expiry: Column, today: Column) -> Column:
    """Years to the day that ``expiry`` names, half a day more, past days as today; null if no format fits."""
    text = F.array_join(F.transform(F.split(F.trim(expiry), "-"), F.initcap), "-")
    day = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in EXPIRY_FORMATS])
    return F.when(day.isNotNull(), (F.greatest(F.datediff(day, today), F.lit(0)) + 0.5) / 365)


def call_curve(chain: DataFrame, rate: float = RATE, min_oi: int = 1, band: tuple[float, float] = BAND, by: str = "expiry", order: str = "at") -> DataFrame:
    """(by, strike, call, spot, years) of a chain (by, at, strike, side, oi, bid, ask, ltp, spot, years).

    Only options out of the money count, puts as the calls that parity gives. Of several quotes of a strike
    the last by ``order`` stands. Calls never rise with the strike; those under their intrinsic value go.
    """
    near = chain.where(F.col("strike").between(band[0] * F.col("spot"), band[1] * F.col("spot")) & F.col("years").isNotNull())
    if min_oi:
        near = near.where(F.coalesce("oi", F.lit(0)) >= min_oi)
    quoted = near.withColumn("call", price(F.col("bid"), F.col("ask"), F.col("ltp"))).where(F.col("call") > 0)
    quoted = quoted.where((F.col("side") == "CE") == (F.col("strike") >= F.col("spot")))
    last = quoted.groupBy(by, "strike").agg(F.max_by(F.struct("call", "spot", "years", "side"), order).alias("q")).select(by, "strike", "q.*")
    floor = F.col("spot") - F.col("strike") * F.exp(-rate * F.col("years"))
    calls = last.withColumn("call", F.when(F.col("side") == "PE", F.col("call") + floor).otherwise(F.col("call"))).where("call > 0").drop("side")
    falling = F.min("call").over(W.partitionBy(by).orderBy("strike").rowsBetween(W.unboundedPreceding, 0))
    return calls.withColumn("call", falling).where(F.col("call") >= F.greatest(floor, F.lit(0.0)) - 1e-9)


def implied(chain: DataFrame, rate: float = RATE, by: str = "expiry", least: int = 8, **curve) -> DataFrame:
    """The distribution (by, strike, call, spot, years, cdf) of every expiry with ``least`` strikes or more."""
    calls = call_curve(chain, rate, by=by, **curve).withColumn("n", F.count("*").over(W.partitionBy(by)))
    return implied_cdf(calls.where(F.col("n") >= least).drop("n"), F.col("years"), rate, by)


def _at_quantile(q: float) -> Column:
    """Strike at which the distribution crosses ``q``, linear between strikes, clamped at the ends."""
    under, over = F.col("cdf") <= q, F.col("cdf") > q
    k, c = F.col("strike"), F.col("cdf")
    k0, k1 = F.max(F.when(under, k)), F.min(F.when(over, k))
    c0, c1 = F.max(F.when(under, c)), F.min_by(F.when(over, c), F.when(over, k))
    return F.when(k0.isNull(), F.min(k)).when(k1.isNull(), F.max(k)).otherwise(k0 + (k1 - k0) * (q - c0) / (c1 - c0))


def quantiles(cdf: DataFrame, by: str = "expiry", at: dict[str, float] | None = None) -> DataFrame:
    return cdf.groupBy(by).agg(*[_at_quantile(q).alias(name) for name, q in (at or {"q05": 0.05, "median": 0.5, "q95": 0.95}).items()])


def reliability(cdf: DataFrame, by: str = "expiry") -> DataFrame:
    """Per expiry: what the distribution covers, whether to trust it, and why not (fixed texts)."""
    step = F.col("cdf") - F.lag("cdf").over(W.partitionBy(by).orderBy("strike"))
    g = cdf.withColumn("step", step).groupBy(by).agg(
        F.count("*").alias("n_strikes"), F.min("cdf").alias("cdf_min"), F.max("cdf").alias("cdf_max"), F.coalesce(F.max("step"), F.lit(1.0)).alias("largest_step"),
        ((_at_quantile(0.95) - _at_quantile(0.05)) / F.max("spot")).alias("range_pct"), F.min("strike").alias("strike_min"), F.max("strike").alias("strike_max"),
    )
    tests = {
        "crosses_median": (F.col("cdf_min") <= 0.5) & (F.col("cdf_max") >= 0.5), "spans_tails": (F.col("cdf_min") < 0.15) & (F.col("cdf_max") > 0.85),
        "flat": F.col("cdf_max") - F.col("cdf_min") < 0.3, "step_degenerate": F.col("largest_step") > 0.5, "too_narrow": F.col("range_pct") < 0.003,
    }
    reasons = F.concat_ws(
        "; ", F.when(~F.col("crosses_median"), "CDF never crosses 0.5"), F.when(~F.col("spans_tails"), "CDF does not span both tails"), F.when(F.col("flat"), "degenerate/flat CDF"),
        F.when(F.col("step_degenerate"), F.format_string("step-function CDF (one strike carries %.0f%% of the mass) - quotes are likely constant or stale", F.col("largest_step") * 100)),
        F.when(F.col("too_narrow"), "implied range is implausibly narrow"), F.when(F.col("n_strikes") < 12, F.format_string("only %d strikes", "n_strikes")),
    )
    return g.withColumns(tests).withColumn("reason", reasons).withColumn("reliable", F.col("reason") == "")


def prob_below(cdf: DataFrame, level: float | Column, by: str = "expiry") -> DataFrame:
    """Per expiry the chances to end below and above a level, by linear interpolation clamped at the ends,
    and to touch it before. ``level`` may be an expression that is one value an expiry; with a column
    ``spot``, a level at or over it is touched from below."""
    level = F.lit(float(level)) if isinstance(level, (int, float)) else level
    rows = cdf.withColumn("_x", level)
    k, c, lo, hi = F.col("strike"), F.col("cdf"), F.col("strike") <= F.col("_x"), F.col("strike") >= F.col("_x")
    k0, k1 = F.max(F.when(lo, k)), F.min(F.when(hi, k))
    c0, c1 = F.max_by(F.when(lo, c), F.when(lo, k)), F.min_by(F.when(hi, c), F.when(hi, k))
    p = F.when(k0.isNull(), c1).when(k1.isNull() | (k0 == k1), c0).otherwise(c0 + (c1 - c0) * (F.max("_x") - k0) / (k1 - k0))
    upward = F.max((F.col("_x") >= F.col("spot"))) if "spot" in cdf.columns else F.lit(False)
    b = rows.groupBy(by).agg(p.alias("p_below"), upward.alias("_up"))
    touch = F.when(F.col("_up"), 1 - F.col("p_below")).otherwise(F.col("p_below"))
    return b.select(by, "p_below", (1 - F.col("p_below")).alias("p_above"), F.least(2 * touch, F.lit(1.0)).alias("p_touch"))


def real_world(p: Column, premium: float = 0.25) -> Column:
    """A risk-neutral chance of a fall, less the premium in log-odds that such options carry."""
    return expit(logit(p) - premium)


def at_the_money(chain: DataFrame, n: int = 6, by: str = "expiry") -> DataFrame:
    """Per expiry the mean volatility of the ``n`` live quotes nearest to the spot, the lower strike first."""
    near = F.row_number().over(W.partitionBy(by).orderBy(F.abs(F.col("strike") - F.col("spot")), "strike", "side"))
    return chain.where("iv > 0").withColumn("_n", near).where(F.col("_n") <= n).groupBy(by).agg(F.avg("iv").alias("atm_iv"), F.count("*").alias("n_quotes"))
