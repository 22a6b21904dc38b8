"""Queries on long series and wide books: scans by blocks, any estimator, counted quantiles, blocked covariances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import gram, pit, portfolio, risk
from . import more  # noqa: F401  its SQL is used
from .registry import BASE, SQL, prices, query, returns, rounded, table

#: Rows of a block: small against a brand's history, so that every brand has several.
BLOCK = 400

BASE["rate"] = "rate AS (SELECT substr(o_orderpriority, 1, 1) AS currency, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS rate FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)"
BASE["var"] = "var AS (SELECT entity, date, r, var, CASE WHEN r < -var THEN 1 ELSE 0 END AS e FROM (SELECT entity, date, r, -quantile_cont(r, 0.01) OVER w AS var, count(r) OVER w AS n FROM rt WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) WHERE n = 250)"
BASE["panel"] = """b AS (SELECT substr(entity, 1, 7) AS book, entity, date, r FROM rt), size AS (SELECT book, count(DISTINCT date) AS n, count(DISTINCT entity) AS p, count(*) AS there FROM b GROUP BY 1),
    x AS (SELECT *, r - avg(r) OVER (PARTITION BY book, entity) AS c FROM (SELECT e.book, e.entity, d.date, coalesce(b.r, 0) AS r FROM (SELECT DISTINCT book, entity FROM b) e JOIN (SELECT DISTINCT book, date FROM b) d ON d.book = e.book LEFT JOIN b ON b.book = e.book AND b.entity = e.entity AND b.date = d.date)),
    s AS (SELECT i.book, i.entity AS i, j.entity AS j, sum(i.c * j.c) / max(n) AS s FROM x i JOIN x j ON i.book = j.book AND i.date = j.date JOIN size ON size.book = i.book GROUP BY 1, 2, 3),
    tot AS (SELECT size.*, tr, tr / p AS mu, cr, sq / n AS sq FROM size JOIN (SELECT book, sum(s) FILTER (i = j) AS tr, sum(s * s) AS cr FROM s GROUP BY 1) t ON t.book = size.book JOIN (SELECT book, sum(z * z) AS sq FROM (SELECT book, date, sum(c * c) AS z FROM x GROUP BY 1, 2) GROUP BY 1) q ON q.book = size.book)"""


@query("w11_drawdown_blocks", SQL["w11_drawdown"])
def w11_drawdown_blocks(spark, sf):
    return rounded(risk.drawdown(prices(spark, sf), BLOCK), 8)


@query("a56_replay_blocks", SQL["a56_replay"])
def a56_replay_blocks(spark, sf):
    w = table(spark, sf, "part").select(F.col("p_brand").alias("entity")).distinct().select(F.substring("entity", 1, 7).alias("book"), "entity", F.lit(0.01).alias("weight"))
    return rounded(portfolio.replay(returns(spark, sf), w, rows_per_block=BLOCK))


@query("j1_by_currency", "SELECT entity, px.date, round(price, 6) AS price, px.currency, round(f.rate, 6) AS rate, round(price * f.rate, 4) AS converted FROM (SELECT *, substr(entity, 8, 1) AS currency FROM px) px ASOF LEFT JOIN rate f ON px.currency = f.currency AND px.date >= f.date", "px rate")
def j1_by_currency(spark, sf):
    """Prices at the last known rate of their currency; five currencies hold all rows."""
    fx = table(spark, sf, "orders").where("o_orderkey % 3 = 0").groupBy(F.substring("o_orderpriority", 1, 1).alias("currency"), F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("rate"))
    priced = prices(spark, sf).select("entity", "date", "price", F.substring("entity", 8, 1).alias("currency"))
    out = pit.asof_join(priced, fx, "date", ["currency"], "rate", BLOCK)
    return out.select("entity", "date", F.round("price", 6).alias("price"), "currency", F.round("rate", 6).alias("rate"), F.round(F.col("price") * F.col("rate"), 4).alias("converted"))


@query("a5_var_counted", SQL["a5_var_historical"])
def a5_var_counted(spark, sf):
    return rounded(risk.var_historical(returns(spark, sf), counted=True))


@query("w8_winsorize_counted", SQL["w8_winsorize"])
def w8_winsorize_counted(spark, sf):
    return rounded(risk.winsorize(returns(spark, sf), counted=True), 8)


def quantile(values: pd.Series, confidence: float) -> float:
    """An estimator as a user writes one."""
    return -values.quantile(1 - confidence)


@query("w16_any_estimator", "SELECT entity, date, round(var, 6) AS var, e = 1 AS exceeded FROM var", "px rt var")
def w16_any_estimator(spark, sf):
    from ..operators.series import rolling

    made = rolling(returns(spark, sf), quantile, 250, confidence=0.99)
    return made.where("estimate is not null").select("entity", "date", F.round("estimate", 6).alias("var"), (F.col("r") < -F.col("estimate")).alias("exceeded"))


@query("w16_stepped", "SELECT entity, date, round(-(m - 2.0 * s), 6) AS var, round(-(m - 2.0 * s), 6) IS NULL AS failed FROM (SELECT entity, date, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s, row_number() OVER (PARTITION BY entity ORDER BY date) - 1 AS k FROM rt WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE k >= 60 AND (k - 60) % 5 = 0", "px rt")
def w16_stepped(spark, sf):
    """Another estimator, every fifth date."""
    from ..operators.series import rolling

    made = rolling(returns(spark, sf), lambda v, confidence: -(v.mean() - 2.0 * v.std()), 60, 5, confidence=0.99)
    return made.select("entity", "date", F.round("estimate", 6).alias("var"), F.col("estimate").isNull().alias("failed"))


def _tail1(x: str) -> str:
    """Upper tail of chi-squared with one degree of freedom, 1 - erf(sqrt(x / 2)), by Simpson's rule over 2,000 steps."""
    z = f"least(sqrt(greatest({x}, 0) / 2), 6.5)"
    return f"1 - 2 / sqrt(pi()) * {z} / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(({z} * k / 2000) ** 2))))"


_LR = """CASE WHEN x = 0 THEN -2 * n * ln(0.99) WHEN x = n THEN -2 * n * ln(0.01) ELSE -2 * ((n - x) * ln(0.99) + x * ln(0.01) - (n - x) * ln(1 - x / n) - x * ln(x / n)) END"""
_IND = """CASE WHEN n01 + n11 = 0 OR n00 + n01 = 0 OR n10 + n11 = 0 OR n01 = 0 OR n11 = 0 OR n10 = 0 THEN 0 ELSE
    -2 * ((n00 + n10) * ln(1 - (n01 + n11) / (n00 + n01 + n10 + n11)) + (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11))
    - n00 * ln(1 - n01 / (n00 + n01)) - n01 * ln(n01 / (n00 + n01)) - n10 * ln(1 - n11 / (n10 + n11)) - n11 * ln(n11 / (n10 + n11))) END"""


@query("a44_backtest", f"""SELECT entity, n, x, n00, n01, n10, n11, round(kp, 6) AS kupiec, round(ch, 6) AS christoffersen, light, round(kupiec_p, 6) AS kupiec_p, round(christoffersen_p, 6) AS christoffersen_p, round(kp + ch, 6) AS conditional, round(exp(-(kp + ch) / 2), 6) AS conditional_p,
    CASE WHEN n < 100 THEN 'inconclusive - ' || n || ' observations is too few to test a 99% VaR' WHEN kupiec_p < 0.05 AND x / n > 0.01 THEN 'REJECTED - too many exceptions; the model understates risk'
    WHEN kupiec_p < 0.05 THEN 'rejected - too few exceptions; the model overstates risk and wastes capital'
    WHEN christoffersen_p < 0.05 THEN 'rejected on independence - exceptions cluster. The count is right but they arrive together, which is the dangerous failure' ELSE 'not rejected - consistent with the data' END AS verdict, 0 AS failed
    FROM (SELECT *, {_tail1('kp')} AS kupiec_p, {_tail1('ch')} AS christoffersen_p FROM (SELECT *, {_LR} AS kp, {_IND} AS ch, CASE WHEN x <= 4 * n / 250 THEN 'green' WHEN x <= 9 * n / 250 THEN 'yellow' ELSE 'red' END AS light FROM
    (SELECT entity, count(*) AS n, CAST(sum(e) AS BIGINT) AS x, count(*) FILTER (b = 0 AND e = 0) AS n00, count(*) FILTER (b = 0 AND e = 1) AS n01, count(*) FILTER (b = 1 AND e = 0) AS n10, count(*) FILTER (b = 1 AND e = 1) AS n11
     FROM (SELECT *, lag(e) OVER (PARTITION BY entity ORDER BY date) AS b FROM var) GROUP BY 1)))""", "px rt var")
def a44_backtest(spark, sf):
    """The whole test of a rolling estimator: both statistics, both together, their p-values, light and verdict."""
    return rounded(risk.rolling_backtest(returns(spark, sf), quantile, 250))


@query("a10_cov_blocks", SQL["a10_sample_cov"])
def a10_cov_blocks(spark, sf):
    return rounded(gram.sample_cov(returns(spark, sf), entities=8, dates=500), 8)


@query("a11_ewma_blocks", SQL["a11_ewma_cov"])
def a11_ewma_blocks(spark, sf):
    return gram.ewma_cov(returns(spark, sf), entities=8, dates=500).select("i", "j", F.round("cov", 8).alias("cov"), F.round("n_eff", 4).alias("n_eff"))


def _shrunk(d: str) -> str:
    return f"SELECT s.book, i, j, round((1 - d) * s + CASE WHEN i = j THEN d * mu ELSE 0 END, 6) AS cov, round(d, 6) AS shrinkage, n * p - there AS n_filled FROM s JOIN (SELECT *, {d} AS d FROM tot) t ON t.book = s.book"


_FAR = "((cr - 2 * mu * tr + p * mu * mu) / p)"


@query("a12_ledoit_wolf_blocks", _shrunk(f"CASE WHEN {_FAR} > 0 THEN least((sq - cr) / (p * n), {_FAR}) / {_FAR} ELSE 0 END"), "px rt panel")
def a12_ledoit_wolf_blocks(spark, sf):
    return rounded(gram.shrinkage_cov(returns(spark, sf).withColumn("book", F.substring("entity", 1, 7)), entities=2, dates=900))


@query("a13_oas_blocks", _shrunk("CASE WHEN cr / p ** 2 = mu * mu / p THEN 1 ELSE least((cr / p ** 2 + mu * mu) / ((n + 1) * (cr / p ** 2 - mu * mu / p)), 1) END"), "px rt panel")
def a13_oas_blocks(spark, sf):
    return rounded(gram.shrinkage_cov(returns(spark, sf).withColumn("book", F.substring("entity", 1, 7)), "oas", entities=2, dates=900))
