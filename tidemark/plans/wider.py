"""Queries over the driver's tables: option chains, price panels, factors, track records, prose. They join the registry's."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import factors, forecasts as fc, models, options as op, pit, portfolio, prose, questions as qs, risk, text
from ..sources import feeds
from .registry import BASE, forecasts, observations, prices, query, returns, rounded, table

TODAY, SPOT = dt.date(2024, 7, 1), 100.0
EXPIRIES = ("25-Jul-2024", "29-08-2024", "2024-09-26", "31-OCT-2024", "some day")

# Orders as quotes: five expiries, strikes from 75 to 125, calls and puts of a logistic distribution of the spot.
_MID = "0.0625 * {k} * ln(1 + exp((100.0 - strike) / (0.0625 * {k})))"
BASE["chain"] = f"""chain AS (SELECT *, CASE WHEN stamp % 4 = 0 THEN 0.0 ELSE mid * 0.999 END AS bid, mid * 1.001 AS ask, mid * (1 + stamp % 5 / 1000.0) AS ltp, 10.0 + stamp % 7 AS iv, stamp % 6 AS oi, 100.0 AS spot FROM
    (SELECT *, {_MID.format(k='(40 + 8 * e)')} + CASE side WHEN 'CE' THEN 0.0 ELSE strike - 100.0 END AS mid FROM
    (SELECT o_orderkey AS stamp, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS e, CAST(75 + o_orderkey * 7 % 51 AS DOUBLE) AS strike FROM orders), (VALUES ('CE'), ('PE')) s(side))
    JOIN (VALUES (1, '25-Jul-2024', 24.5 / 365), (2, '29-08-2024', 59.5 / 365), (3, '2024-09-26', 87.5 / 365), (4, '31-OCT-2024', 122.5 / 365), (5, 'some day', NULL)) x(e2, expiry, years) ON e = e2)"""
BASE["curve"] = """curve AS (SELECT expiry, strike, call, years FROM (SELECT expiry, strike, years, min(c) OVER (PARTITION BY expiry ORDER BY strike) AS call FROM
    (SELECT expiry, strike, years, CASE side WHEN 'PE' THEN p + 100 - strike * exp(-0.0525 * years) ELSE p END AS c FROM
    (SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE ltp END AS p FROM chain WHERE strike BETWEEN 80 AND 120 AND oi >= 1 AND years IS NOT NULL)
    WHERE p > 0 AND (side = 'CE') = (strike >= 100) QUALIFY row_number() OVER (PARTITION BY expiry, strike ORDER BY stamp DESC) = 1) WHERE c > 0) WHERE call >= greatest(100 - strike * exp(-0.0525 * years), 0) - 1e-9)"""
BASE["cdf"] = """slopes AS (SELECT *, strike - lag(strike) OVER o AS h1, lead(strike) OVER o - strike AS h2, (call - lag(call) OVER o) / (strike - lag(strike) OVER o) AS d1, (lead(call) OVER o - call) / (lead(strike) OVER o - strike) AS d2,
    count(*) OVER (PARTITION BY expiry) AS n FROM curve WINDOW o AS (PARTITION BY expiry ORDER BY strike)),
    cdf AS (SELECT expiry, strike, years, least(greatest(max(1 + exp(0.0525 * years) * CASE WHEN h1 IS NULL THEN d2 WHEN h2 IS NULL THEN d1 ELSE (d1 * h2 + d2 * h1) / (h1 + h2) END) OVER (PARTITION BY expiry ORDER BY strike), 0), 1) AS cdf FROM slopes WHERE n >= 8)"""
BASE["load"] = "load AS (SELECT p_brand AS entity, avg(p_size) / 10 - 2.5 AS size FROM part GROUP BY 1)"
BASE["pr"] = "pr AS (SELECT date, 'market' AS factor, avg(r) AS premium FROM rt JOIN load USING (entity) GROUP BY 1 UNION ALL SELECT date, 'size', avg(r * size) FROM rt JOIN load USING (entity) GROUP BY 1)"
BASE["cv"] = "cv AS (SELECT a.factor AS i, b.factor AS j, covar_samp(a.premium, b.premium) AS cov FROM pr a JOIN pr b USING (date) GROUP BY 1, 2)"
BASE["fx"] = "fx AS (SELECT 'market' AS factor, sum(0.04) AS x FROM load UNION ALL SELECT 'size', sum(0.04 * size) FROM load)"
BASE["tr"] = "tr AS (SELECT *, CASE WHEN question % 7 = 0 THEN 1 ELSE 0 END AS k, (p - y) ** 2 AS brier, -(y * ln(p) + (1 - y) * ln(1 - p)) AS ls FROM fcs)"
BASE["snap"] = "snap AS (SELECT * FROM obs WHERE available_at <= TIMESTAMP '1998-06-30 23:59:59' AND event_date >= DATE '1998-06-30' - INTERVAL 1200 DAY QUALIFY row_number() OVER (PARTITION BY series_id, entity, event_date ORDER BY revision DESC, available_at DESC) = 1)"


def chain(spark, sf):
    e = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("at"), e.alias("e"), (75.0 + F.col("o_orderkey") * 7 % 51).alias("strike"), F.explode(F.array(F.lit("CE"), F.lit("PE"))).alias("side"))
    width = 0.0625 * (40 + 8 * F.col("e"))
    mid = width * F.log(1 + F.exp((100.0 - F.col("strike")) / width)) + F.when(F.col("side") == "CE", 0.0).otherwise(F.col("strike") - 100.0)
    rows = rows.withColumn("mid", mid).withColumns({"expiry": F.get(F.array(*[F.lit(x) for x in EXPIRIES]), F.col("e") - 1), "spot": F.lit(SPOT), "iv": 10.0 + F.col("at") % 7, "oi": F.col("at") % 6})
    rows = rows.withColumns({"bid": F.when(F.col("at") % 4 == 0, 0.0).otherwise(F.col("mid") * 0.999), "ask": F.col("mid") * 1.001, "ltp": F.col("mid") * (1 + F.col("at") % 5 / 1000.0)})
    return rows.withColumn("years", op.years_to(F.col("expiry"), F.lit(TODAY))).drop("e", "mid")


@query("f20_years_to", "SELECT expiry, count(*) AS n, round(max(years), 9) AS years FROM chain GROUP BY 1", "chain")
def f20_years_to(spark, sf):
    return chain(spark, sf).groupBy("expiry").agg(F.count("*").alias("n"), F.round(F.max("years"), 9).alias("years"))


@query("w18_call_curve", "SELECT expiry, strike, round(call, 6) AS call FROM curve", "chain curve")
def w18_call_curve(spark, sf):
    return rounded(op.call_curve(chain(spark, sf)).select("expiry", "strike", "call"))


@query("w19_implied", "SELECT expiry, strike, round(cdf, 6) AS cdf FROM cdf", "chain curve cdf")
def w19_implied(spark, sf):
    return rounded(op.implied(chain(spark, sf)).select("expiry", "strike", "cdf"))


@query("w19_reliability", """
    SELECT expiry, n_strikes, round(lo, 6) AS cdf_min, round(hi, 6) AS cdf_max, round(step, 6) AS largest_step, lo <= 0.5 AND hi >= 0.5 AS crosses_median, lo < 0.15 AND hi > 0.85 AS spans_tails, hi - lo < 0.3 AS flat, step > 0.5 AS step_degenerate,
    lo <= 0.5 AND hi >= 0.5 AND lo < 0.15 AND hi > 0.85 AND hi - lo >= 0.3 AND step <= 0.5 AND n_strikes >= 12 AS reliable FROM
    (SELECT expiry, count(*) AS n_strikes, min(cdf) AS lo, max(cdf) AS hi, max(s) AS step FROM (SELECT *, cdf - lag(cdf) OVER (PARTITION BY expiry ORDER BY strike) AS s FROM cdf) GROUP BY 1)""", "chain curve cdf")
def w19_reliability(spark, sf):
    return rounded(op.reliability(op.implied(chain(spark, sf))).select("expiry", "n_strikes", "cdf_min", "cdf_max", "largest_step", "crosses_median", "spans_tails", "flat", "step_degenerate", "reliable"))


def _quantile(q: float) -> str:
    return f"CASE WHEN max(strike) FILTER (WHERE cdf <= {q}) IS NULL THEN min(strike) WHEN min(strike) FILTER (WHERE cdf > {q}) IS NULL THEN max(strike) ELSE max(strike) FILTER (WHERE cdf <= {q}) + (min(strike) FILTER (WHERE cdf > {q}) - max(strike) FILTER (WHERE cdf <= {q})) * ({q} - max(cdf) FILTER (WHERE cdf <= {q})) / (min(cdf) FILTER (WHERE cdf > {q}) - max(cdf) FILTER (WHERE cdf <= {q})) END"


@query("w20_quantiles", f"SELECT expiry, round({_quantile(0.05)}, 5) AS q05, round({_quantile(0.5)}, 5) AS median, round({_quantile(0.95)}, 5) AS q95 FROM cdf GROUP BY 1", "chain curve cdf")
def w20_quantiles(spark, sf):
    return rounded(op.quantiles(op.implied(chain(spark, sf))), 5)


@query("w20_probabilities", """
    SELECT expiry, round(p, 6) AS p_below, round(1 - p, 6) AS p_above, round(least(2 * p, 1), 6) AS p_touch, round(1 / (1 + exp(-(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) - 0.25))), 6) AS p_real FROM
    (SELECT expiry, CASE WHEN k0 IS NULL THEN c1 WHEN k1 IS NULL OR k0 = k1 THEN c0 ELSE c0 + (c1 - c0) * (95.5 - k0) / (k1 - k0) END AS p FROM (SELECT expiry, max(strike) FILTER (WHERE strike <= 95.5) AS k0, min(strike) FILTER (WHERE strike >= 95.5) AS k1,
    arg_max(cdf, strike) FILTER (WHERE strike <= 95.5) AS c0, arg_min(cdf, strike) FILTER (WHERE strike >= 95.5) AS c1 FROM cdf GROUP BY 1))""", "chain curve cdf")
def w20_probabilities(spark, sf):
    return rounded(op.prob_below(op.implied(chain(spark, sf)), F.col("spot") * 0.955).withColumn("p_real", op.real_world(F.col("p_below"))))


@query("t7_atm_strikes", "SELECT expiry, round(avg(iv), 6) AS atm_iv, count(*) AS n_quotes FROM (SELECT expiry, iv, row_number() OVER (PARTITION BY expiry ORDER BY abs(strike - 100), strike, side) AS n FROM (SELECT expiry, strike, side, avg(iv) AS iv FROM chain WHERE iv > 12 GROUP BY 1, 2, 3)) WHERE n <= 6 GROUP BY 1", "chain")
def t7_atm_strikes(spark, sf):
    live = chain(spark, sf).where("iv > 12").groupBy("expiry", "strike", "side", "spot").agg(F.avg("iv").alias("iv"))
    return rounded(op.at_the_money(live))


@query("a6_expected_shortfall", "SELECT entity, round(-avg(r), 6) AS es FROM rt JOIN (SELECT entity AS e, quantile_cont(r, 0.025) AS q FROM rt GROUP BY 1) ON entity = e WHERE r <= q GROUP BY 1", "px rt")
def a6_expected_shortfall(spark, sf):
    return rounded(risk.var_historical(risk.clean(returns(spark, sf)), 0.975).select("entity", "es"))


@query("fp4_clean", "SELECT entity, count(*) AS n, round(sum(r), 6) AS total FROM (SELECT entity, CASE WHEN day(date) = 1 THEN NULL WHEN day(date) = 2 THEN 'NaN'::DOUBLE WHEN day(date) = 3 THEN 'Infinity'::DOUBLE ELSE r END AS r FROM rt) WHERE r IS NOT NULL AND isfinite(r) GROUP BY 1 HAVING count(*) >= 30", "px rt")
def fp4_clean(spark, sf):
    d = F.dayofmonth("date")
    spoilt = F.when(d == 1, None).when(d == 2, float("nan")).when(d == 3, float("inf")).otherwise(F.col("r"))
    return rounded(risk.clean(returns(spark, sf).withColumn("r", spoilt)).groupBy("entity").agg(F.count("*").alias("n"), F.sum("r").alias("total")))


@query("fp6_align_prices", """
    SELECT entity, CAST(sum(n) AS BIGINT) AS n_obs, round(sum(n) / (SELECT count(DISTINCT date) FROM px), 6) AS coverage, CAST(sum(s) AS BIGINT) AS stale_days, max(s) AS max_stale_run, max(s) > 5 AS suspect, sum(n) >= 60 AS kept FROM
    (SELECT entity, run, count(*) AS n, count(*) FILTER (WHERE still) AS s FROM (SELECT *, count(*) FILTER (WHERE NOT still) OVER (PARTITION BY entity ORDER BY date) AS run FROM
    (SELECT entity, date, coalesce(p = lag(p) OVER w AND d = lag(d) OVER w + 1, false) AS still FROM (SELECT entity, date, floor(price / 400) AS p, dense_rank() OVER (ORDER BY date) AS d FROM px) WINDOW w AS (PARTITION BY entity ORDER BY date))) GROUP BY 1, 2) GROUP BY 1""", "px")
def fp6_align_prices(spark, sf):
    return rounded(risk.align_prices(prices(spark, sf).withColumn("price", F.floor(F.col("price") / 400))))


@query("a9_var_ensemble")
def a9_var_ensemble(spark, sf):
    return rounded(models.var_ensemble(returns(spark, sf)), 4)


@query("a16_estimate", "SELECT a.entity AS i, b.entity AS j, round(covar_samp(a.r, b.r), 6) AS cov, count(*) AS n_obs FROM rt a JOIN rt b USING (date) GROUP BY 1, 2", "px rt")
def a16_estimate(spark, sf):
    return rounded(models.estimate(returns(spark, sf), "sample"))


def _sql_score(c: str) -> str:
    return f"coalesce(CASE WHEN stddev_samp(x_{c}) OVER g > 0 AND x_{c} IS NOT NULL THEN least(greatest((x_{c} - avg(x_{c}) OVER g) / stddev_samp(x_{c}) OVER g, -3), 3) END, 0)"


_CHARACTERISTICS = ("cap", "bp", "roe", "debt")


@query("a20_exposures", f"""
    SELECT p_partkey, 1.0::DOUBLE AS market, round(-{_sql_score('cap')}, 6) AS size, round({_sql_score('bp')}, 6) AS value, round(({_sql_score('roe')} - {_sql_score('debt')}) / 2, 6) AS quality FROM
    (SELECT p_partkey, family, {', '.join(f'CASE WHEN {c} IS NULL THEN NULL WHEN d_{c} > 0 THEN least(greatest({c}, m_{c} - 3 * d_{c}), m_{c} + 3 * d_{c}) ELSE {c} END AS x_{c}' for c in _CHARACTERISTICS)} FROM
    (SELECT *, {', '.join(f'1.4826 * median(abs({c} - m_{c})) OVER (PARTITION BY family) AS d_{c}' for c in _CHARACTERISTICS)} FROM
    (SELECT *, {', '.join(f'median({c}) OVER (PARTITION BY family) AS m_{c}' for c in _CHARACTERISTICS)} FROM
    (SELECT p_partkey, substr(p_brand, 1, 7) AS family, ln(greatest(CAST(p_retailprice AS DOUBLE), 1)) AS cap, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey % 13 AS DOUBLE) END AS bp, CAST(p_size AS DOUBLE) AS roe, CASE WHEN p_partkey % 50 = 0 THEN 1e6::DOUBLE ELSE CAST(p_partkey % 7 AS DOUBLE) END AS debt FROM part)))) WINDOW g AS (PARTITION BY family)""")
def a20_exposures(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select(
        "p_partkey", F.substring("p_brand", 1, 7).alias("family"), F.col("p_retailprice").cast("double").alias("market_cap"), F.when(k % 9 != 0, (k % 13).cast("double")).alias("book_to_price"),
        F.col("p_size").cast("double").alias("roe"), F.when(k % 50 == 0, 1e6).otherwise((k % 7).cast("double")).alias("debt_to_equity"),
    )
    return rounded(factors.build_exposures(c, ["family"]).select("p_partkey", "market", "size", "value", "quality"))


def _premia(spark, sf):
    """Two made factors a date, market and size: mean return, and mean of returns times the entity's size."""
    x = _loadings(spark, sf)
    r = returns(spark, sf).join(x, "entity")
    return r.groupBy("date").agg(F.avg("r").alias("market"), F.avg(F.col("r") * F.col("size")).alias("size")).unpivot("date", ["market", "size"], "factor", "premium")


def _loadings(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("entity")).agg((F.avg("p_size") / 10 - 2.5).alias("size")).withColumn("market", F.lit(1.0))


@query("a23_factor_cov", """
    SELECT i, j, round(sum(w * a * b) / sum(w) - sum(w * a) * sum(w * b) / sum(w) ** 2, 6) AS cov, round(sum(w) ** 2 / sum(w ** 2), 4) AS n_eff FROM (SELECT x.factor AS i, y.factor AS j, x.premium AS a, y.premium AS b, 0.03 * pow(0.97, age) AS w FROM pr x JOIN pr y USING (date)
    JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM pr)) USING (date)) GROUP BY 1, 2""", "px rt load pr")
def a23_factor_cov(spark, sf):
    c = factors.factor_cov(_premia(spark, sf))
    return c.select("i", "j", F.round("cov", 6).alias("cov"), F.round("n_eff", 4).alias("n_eff"))


@query("a24_risk_decomposition", """
    SELECT factor, round(exposure, 6) AS exposure, round(part / (fv + sv), 6) AS contribution, round(sqrt(fv + sv), 6) AS total_vol, round(sqrt(fv + sv) * sqrt(252), 5) AS total_vol_ann, round(sqrt(fv), 6) AS factor_vol, round(sqrt(sv), 6) AS specific_vol, round(fv / (fv + sv), 6) AS pct_factor, round(sv / (fv + sv), 6) AS pct_specific FROM
    (SELECT f.factor, f.x AS exposure, f.x * sum(c.cov * g.x) AS part, sum(f.x * sum(c.cov * g.x)) OVER () AS fv FROM fx f JOIN cv c ON c.i = f.factor JOIN fx g ON g.factor = c.j GROUP BY 1, 2),
    (SELECT sum((0.04 * s) ** 2) AS sv FROM (SELECT entity, greatest(stddev_samp(r), 0.005) AS s FROM rt GROUP BY 1))""", "px rt load pr cv fx")
def a24_risk_decomposition(spark, sf):
    x, premia = _loadings(spark, sf), _premia(spark, sf)
    cov = risk.sample_cov(premia.select("date", F.col("factor").alias("entity"), F.col("premium").alias("r")))
    own = returns(spark, sf).groupBy("entity").agg(F.greatest(F.stddev_samp("r"), F.lit(0.005)).alias("specific"))
    return factors.risk_decomposition(x.select("entity", F.lit(0.04).alias("weight")), x, cov, own, ["market", "size"]).select("factor", *[F.round(c, 5 if c == "total_vol_ann" else 6).alias(c) for c in ("exposure", "contribution", "total_vol", "total_vol_ann", "factor_vol", "specific_vol", "pct_factor", "pct_specific")])


@query("a22_fit_summary")
def a22_fit_summary(spark, sf):
    panel = returns(spark, sf).join(_loadings(spark, sf), "entity")
    return rounded(factors.fit_summary(panel, models.cross_sectional_regression(panel, ["market", "size"])), 5)


@query("a40_pooled_error", "SELECT question, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 'Infinity'::DOUBLE ELSE stddev_samp(ln(p / (1 - p))) / sqrt(count(*)) END, 6) AS se FROM fcs GROUP BY 1", "fcs")
def a40_pooled_error(spark, sf):
    return rounded(fc.pooled_standard_error(forecasts(spark, sf)))


@query("a37_dispersion", """
    SELECT question, count(DISTINCT member) AS n_members, round(CASE WHEN count(DISTINCT member) > 1 THEN sum(0.5 * (q - m) * log2(q / m)) / count(DISTINCT member) ELSE 0 END, 6) AS dispersion FROM
    (SELECT question, member, q, avg(q) OVER (PARTITION BY question, outcome) AS m FROM (SELECT question, member, 'yes' AS outcome, p AS q FROM fcs UNION ALL SELECT question, member, 'no', 1 - p FROM fcs)) GROUP BY 1""", "fcs")
def a37_dispersion(spark, sf):
    f = forecasts(spark, sf)
    both = F.array(F.struct(F.lit("yes").alias("outcome"), F.col("p").alias("p")), F.struct(F.lit("no").alias("outcome"), (1 - F.col("p")).alias("p")))
    return rounded(fc.dispersion_categorical(f.select("question", "member", F.explode(both).alias("x")).select("question", "member", "x.*")))


@query("a30_track_record", """
    SELECT s.member, n, round(mean_brier, 6) AS mean_brier, round(mean_log_score, 6) AS mean_log_score, round(ece, 6) AS ece, round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(1 - mean_brier / (base * (1 - base)), 5) AS skill, round(ml - ln(base / (1 - base)), 6) AS bias_logit FROM
    (SELECT member, count(*) AS n, sum(w * brier) / sum(w) AS mean_brier, sum(w * ls) / sum(w) AS mean_log_score FROM (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY member ORDER BY k DESC, question DESC) - 1) / 20.0) AS w FROM tr) GROUP BY 1) s
    JOIN (SELECT member, avg(y) AS base, avg(ln(p / (1 - p))) AS ml FROM tr WHERE k = 0 GROUP BY 1) b ON b.member = s.member
    JOIN (SELECT member, sum(abs(sp - sy)) / sum(c) AS ece FROM (SELECT member, greatest(ceil(p * 10), 1) AS bin, sum(p) AS sp, sum(y) AS sy, count(*) AS c FROM tr WHERE k = 0 GROUP BY 1, 2) GROUP BY 1) e ON e.member = s.member
    JOIN (SELECT member, sum(c * (fy - mp) ** 2) / sum(c) AS reliability, sum(c * (fy - base) ** 2) / sum(c) AS resolution FROM (SELECT t.member, bb.base, avg(p) AS mp, avg(y) AS fy, count(*) AS c FROM tr t JOIN (SELECT member, avg(y) AS base FROM tr WHERE k = 0 GROUP BY 1) bb ON bb.member = t.member WHERE k = 0
    GROUP BY 1, 2, len(list_filter([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9], lambda x: x::DOUBLE <= p))) GROUP BY 1) m ON m.member = s.member""", "fcs tr")
def a30_track_record(spark, sf):
    f = forecasts(spark, sf).select(F.col("question").alias("position"), "member", "y", "p", F.when(F.col("question") % 7 == 0, "categorical").otherwise("binary").alias("kind"))
    t = fc.track_record(fc.scored(f).withColumn("crps", F.lit(None).cast("double")), 20.0)
    return t.select("member", "n", *[F.round(c, 5 if c == "skill" else 6).alias(c) for c in ("mean_brier", "mean_log_score", "ece", "reliability", "resolution", "skill", "bias_logit")])


_SPEECH = "'I have ' || c_custkey * 100 || CASE c_custkey % 3 WHEN 0 THEN ' lakh' WHEN 1 THEN ' rupees' ELSE 'k' END || ' for ' || c_custkey % 60 || CASE c_custkey % 2 WHEN 0 THEN ' years in ' ELSE ' months in ' END || CASE c_mktsegment WHEN 'BUILDING' THEN 'gold' WHEN 'MACHINERY' THEN 'a bond fund' WHEN 'FURNITURE' THEN 'something' ELSE 'an FD' END || CASE c_custkey % 5 WHEN 0 THEN ' as a monthly SIP' ELSE '' END"


@query("f14_projection", rf"""
    SELECT c_custkey, amount, round(years, 6) AS years, asset, mode FROM (SELECT c_custkey, list_extract(list_filter(list_transform(range(1, len(raws) + 1), lambda i: CASE WHEN raws[i] = raw AND units[i] = '' THEN NULL ELSE TRY_CAST(replace(raws[i], ',', '') AS DOUBLE) * CASE units[i] WHEN 'lakh' THEN 1e5 WHEN 'k' THEN 1e3 ELSE 1 END END), lambda v: v >= 500), 1) AS amount,
    CASE WHEN y > 0 AND y <= 50 THEN y END AS years, CASE WHEN contains(low, 'gold') THEN 'gold' WHEN contains(low, 'fd') THEN 'fixed_deposit' WHEN contains(low, 'bond fund') THEN 'debt_fund' ELSE 'indian_equity' END AS asset, CASE WHEN contains(low, 'sip') THEN 'sip' ELSE 'lumpsum' END AS mode FROM
    (SELECT *, TRY_CAST(raw AS DOUBLE) / CASE WHEN contains(low, 'months') THEN 12 ELSE 1 END AS y FROM (SELECT c_custkey, low, regexp_extract_all(low, '([\d,]+(?:\.\d+)?)\s*(lakh|k)?', 1) AS raws, regexp_extract_all(low, '([\d,]+(?:\.\d+)?)\s*(lakh|k)?', 2) AS units, regexp_extract(low, '([\d.]+)\s*(year|month)', 1) AS raw FROM (SELECT c_custkey, lower({_SPEECH}) AS low FROM customer))))
    WHERE amount IS NOT NULL AND years IS NOT NULL""")
def f14_projection(spark, sf):
    said = table(spark, sf, "customer").select("c_custkey", prose.projection_of(F.expr(_SPEECH)).alias("p")).where("p is not null")
    return rounded(said.select("c_custkey", "p.amount", "p.years", "p.asset", "p.mode"))


@query("f16_asset_class")
def f16_asset_class(spark, sf):
    text = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 2 == 0, "gold shares and a share"))
    return table(spark, sf, "documents").select("doc_id", prose.asset_class(text).alias("asset_class"))


@query("fp10_relevant", "SELECT source, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(t, 'sample data|test data|dummy|demo ') AND regexp_matches(t, '" + "|".join(prose.RELEVANCE_TERMS) + "')) AS relevant FROM (SELECT source, lower(coalesce(lang, '') || ' ' || coalesce(text, '')) AS t FROM documents) GROUP BY 1")
def fp10_relevant(spark, sf):
    d = table(spark, sf, "documents").select("source", prose.relevant(F.col("lang"), F.col("text")).alias("r"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if("r").alias("relevant"))


@query("f7_adjusted_relevance", "SELECT doc_id, round((CASE WHEN doc_id % 3 = 0 THEN greatest(b, 0.32) ELSE b END) * (1 + 0.35 * (CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END - 0.6)), 6) AS relevance FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars % 100 / 100.0 ELSE 0.7 * (doc_id % 10 / 10.0) + 0.3 * (n_chars % 100 / 100.0) END AS b FROM documents)")
def f7_adjusted_relevance(spark, sf):
    k = F.col("doc_id")
    tier = F.when(k % 3 == 0, "primary").when(k % 3 == 1, "press").otherwise("aggregate")
    return rounded(table(spark, sf, "documents").select("doc_id", text.adjusted_relevance(F.col("n_chars") % 100 / 100.0, F.when(k % 4 != 0, k % 10 / 10.0), tier).alias("relevance")))


@query("f17_extract_json", "SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN CAST(doc_id AS DOUBLE) END AS p FROM documents")
def f17_extract_json(spark, sf):
    k = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"p": '), k, F.lit("}"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit('Sure:\n```json\n{"p": '), k, F.lit(", \"ok\": True,}\n```"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit('I say {"why": "a } b", "p": '), k, F.lit(', "x": NaN} so.')))
    reply = reply.when(F.col("doc_id") % 5 == 3, F.concat(F.lit('{"p": '), k, F.lit(', "in": {"a": [1, 2, ], }} {'))).otherwise("no { object")
    return table(spark, sf, "documents").select("doc_id", F.get_json_object(prose.extract_json(reply), "$.p").cast("double").alias("p"))


@query("f18_coerce", "SELECT c_custkey, round(least(greatest(CASE WHEN v > 1 THEN v / 100 ELSE v END, 0), 1), 6) AS probability, 0.5::DOUBLE AS confidence FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 100 AS v FROM customer)")
def f18_coerce(spark, sf):
    none = F.lit(None).cast("map<string,double>")
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 100).alias("probability"), none.alias("distribution"), none.alias("quantile_values"), F.lit(None).cast("double").alias("confidence"))
    return rounded(fc.coerce(rows).select("c_custkey", "probability", "confidence"))


@query("w22_realised_vol", """
    SELECT series_id, n_obs, round(CASE WHEN n_obs >= 20 AND n_r >= 15 AND sd > 0 THEN sd * sqrt(252) END, 6) AS vol FROM (SELECT series_id, count(r) AS n_r, stddev_samp(r) AS sd FROM (SELECT series_id, ln(value / lag(value) OVER (PARTITION BY series_id ORDER BY event_date)) AS r FROM
    (SELECT series_id, event_date, value FROM snap QUALIFY row_number() OVER (PARTITION BY series_id, event_date ORDER BY available_at DESC, revision DESC, entity DESC) = 1)) GROUP BY 1) JOIN (SELECT series_id, count(*) AS n_obs FROM snap GROUP BY 1) USING (series_id)""", "obs snap")
def w22_realised_vol(spark, sf):
    return rounded(qs.realised_vol(observations(spark, sf), dt.date(1998, 6, 30), 1200))


@query("w25_evidence", """
    SELECT series_id, round(max(value) FILTER (WHERE n = 1), 4) AS value, max(event_date) FILTER (WHERE n = 1) AS event_date, CASE WHEN max(lag) FILTER (WHERE n = 1) > 3 THEN 'publication lag ' || max(lag) FILTER (WHERE n = 1) || 'd' ELSE '' END AS note, coalesce(string_agg(printf('%s %.2f', CAST(event_date AS VARCHAR), value), ', ' ORDER BY n DESC) FILTER (WHERE n > 1), '') AS history FROM
    (SELECT *, date_diff('day', event_date, CAST(available_at AS DATE)) AS lag, row_number() OVER (PARTITION BY series_id ORDER BY event_date DESC, available_at DESC, entity DESC) AS n FROM snap) WHERE n <= 6 GROUP BY 1""", "obs snap")
def w25_evidence(spark, sf):
    e = qs.evidence(observations(spark, sf), dt.date(1998, 6, 30), 1200)
    said = F.array_join(F.transform("history", lambda h: F.format_string("%s %.2f", h["event_date"].cast("string"), h["value"])), ", ")
    return e.select("series_id", F.round("value", 4).alias("value"), "event_date", "note", said.alias("history"))


@query("f30_generate")
def f30_generate(spark, sf):
    """Three brands stand in for tracked series, by their last prices and their own volatility."""
    named = F.when(F.col("entity") == "Brand#11", "NIFTY50_CLOSE").when(F.col("entity") == "Brand#12", "USDINR").when(F.col("entity") == "Brand#13", "INDIA_VIX")
    latest = prices(spark, sf).withColumn("series_id", named).where("series_id is not null").groupBy("series_id").agg(F.max_by("price", "date").alias("value"))
    vols = returns(spark, sf).withColumn("series_id", named).where("series_id is not null").groupBy("series_id").agg((F.stddev_samp("r") / 10).alias("vol"))
    return rounded(qs.generate(latest, vols, TODAY))


@query("f4_fingerprint", r"""SELECT source, packet, substr(sha256('[' || string_agg('["E' || n || '", "' || lang || '", "' || n_chars || '", "2024-01-0' || n || '"]', ', ' ORDER BY n) || ']'), 1, 16) AS print FROM
    (SELECT source, lang, n_chars, (k - 1) // 9 AS packet, (k - 1) % 9 + 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang IS NOT NULL)) GROUP BY 1, 2""")
def f4_fingerprint(spark, sf):
    """Packets of nine documents of a source each; all documents are in one."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    d = table(spark, sf, "documents").where("lang is not null").withColumn("k", k).withColumns({"packet": F.floor(F.col("k") / 9), "n": F.col("k") % 9 + 1})
    item = F.struct("n", F.concat(F.lit("E"), F.col("n").cast("string")).alias("id"), F.col("lang").alias("label"), F.col("n_chars").cast("string").alias("value"), F.concat(F.lit("2024-01-0"), F.col("n").cast("string")).alias("event_date"))
    return d.groupBy("source", "packet").agg(F.array_sort(F.collect_list(item)).alias("items")).select("source", "packet", qs.fingerprint(F.col("items")).alias("print"))


@query("a54_summarise", "SELECT count(*) AS candidates, count(p) AS tested, count(*) - count(p) AS untestable, count(*) FILTER (WHERE p < 0.05) AS naive_significant, round(CAST(count(p) * 0.05 AS DOUBLE), 1) AS expected_by_chance, count(*) FILTER (WHERE p < 0.01) AS survive_fdr FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 97 / 97.0 END AS p FROM customer)")
def a54_summarise(spark, sf):
    k = F.col("c_custkey")
    return qs.summarise(table(spark, sf, "customer").select(F.when(k % 4 != 0, k % 97 / 97.0).alias("p")).withColumn("survives", F.col("p") < 0.01))


@query("a49_panels", "SELECT question, count(*) AS n, round(min(p), 9) AS least, max(y) AS y FROM fcs GROUP BY 1 HAVING count(*) >= 2", "fcs")
def a49_panels(spark, sf):
    p = qs.panels(forecasts(spark, sf))
    return rounded(p.select("question", F.size("probabilities").cast("long").alias("n"), F.array_min("probabilities").alias("least"), "y"), 9)


@query("t5_categories", "SELECT p_type AS category, count(*) AS schemes FROM part WHERE contains(lower(p_type), 'eel') OR contains(lower(p_type), 'a') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def t5_categories(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_type").alias("category"))
    return feeds.categories(part.where("contains(lower(category), 'eel') or contains(lower(category), 'a')"))


@query("sc10_data_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS index, round(CAST(o_totalprice AS DOUBLE), 2) AS last FROM orders")
def sc10_data_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.to_json(F.struct(F.array(F.struct(F.col("o_orderkey").cast("string").alias("index"), F.col("o_totalprice").cast("double").alias("last"))).alias("data"))).alias("value"))
    return rounded(feeds.data_rows(o, "index string, last double"), 2)


@query("sc11_expiries", "SELECT strftime(last_day(CAST(o_orderdate AS DATE)), '%d-%b-%Y') AS expiry, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def sc11_expiries(spark, sf):
    month = F.date_format(F.last_day(F.col("o_orderdate").cast("date")), "dd-MMM-yyyy")
    docs = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.to_json(F.struct(F.collect_set(month).alias("expiryDates"))).alias("value"))
    return feeds.option_expiries(docs).groupBy("expiry").agg(F.count("*").alias("n"))


@query("sc14_commodity", "SELECT date, round(avg(r), 6) AS value, 'USD/oz' AS unit FROM rt GROUP BY 1", "px rt")
def sc14_commodity(spark, sf):
    day = returns(spark, sf).groupBy("date").agg(F.avg("r").alias("usd"))
    metals = day.withColumn("feed", F.lit("gold_pm")).unionByName(day.withColumn("feed", F.lit("silver")))
    return rounded(feeds.commodity("gold", metals, day.select(F.lit("DCOILWTICO").alias("series_id"), "date", F.col("usd").alias("value"))))


@query("sc23_longest_table", "SELECT n_nationkey, 3 AS n_rows, 'USD|' || n_nationkey || ';EUR|' || n_regionkey || ';a b|' AS cells FROM nation")
def sc23_longest_table(spark, sf):
    page = F.concat(F.lit("<p><TABLE class='x'><tr><td>short</td></tr></table> <table>\n<tr><th>USD</th><td> "), F.col("n_nationkey").cast("string"), F.lit("</td></tr><tr><td><b>EUR</b></td><td>"), F.col("n_regionkey").cast("string"), F.lit("</td></tr><tr><td>a<br>b</td><td></td></tr></table>"))
    t = feeds.longest_table(table(spark, sf, "nation").select("n_nationkey", page.alias("html")), "n_nationkey")
    return t.select("n_nationkey", "n_rows", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))
