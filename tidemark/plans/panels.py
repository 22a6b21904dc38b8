"""Queries on verdicts, experiments, standings, speech and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import arm
from ..operators import ledger, learning as ln, projections as pj, text as tx, verdicts as vd
from ..sources import feeds
from .registry import BASE, forecasts, prices, query, rounded, table

BASE["ok"] = "ok AS (SELECT * FROM fcs WHERE NOT (question % 5 = 0 AND member < 'd'))"
BASE["w"] = "w AS (SELECT *, CASE member WHEN 'click' THEN 2.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM ok)"


@query("a38_verdicts", """
    WITH bin AS (SELECT question, 1 / (1 + exp(-(1 + 0.8 * least(sd / 0.25, 1) * ag) * l)) AS probability, sd FROM
        (SELECT question, sum(w * ln(p / (1 - p))) / sum(w) AS l, coalesce(stddev_samp(p), 0) AS sd, abs(2 * avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) - 1) AS ag FROM w WHERE question % 3 = 0 GROUP BY 1)),
    far AS (SELECT w.question, count(*) FILTER (abs(p - probability) >= 0.15) AS n_dissent, arg_max(member, (abs(p - probability), member)) AS strongest FROM w JOIN bin ON bin.question = w.question GROUP BY 1),
    sh AS (SELECT question, member, w, o, greatest(CASE o WHEN 'up' THEN p WHEN 'down' THEN (1 - p) * 0.75 ELSE 0 END, 1e-6) AS s FROM w, (VALUES ('up'), ('flat'), ('down')) x(o) WHERE question % 3 = 1),
    nm AS (SELECT *, s / sum(s) OVER (PARTITION BY question, member) AS u FROM sh),
    cat AS (SELECT question, o, exp(l) / sum(exp(l)) OVER (PARTITION BY question) AS p FROM (SELECT question, o, sum(w * ln(u)) / sum(w) AS l FROM nm GROUP BY 1, 2)),
    div AS (SELECT question, CASE WHEN count(*) > 1 THEN avg(d) ELSE 0 END AS disp FROM (SELECT question, member, sum(0.5 * (u - m) * log2(u / m)) AS d FROM (SELECT *, avg(u) OVER (PARTITION BY question, o) AS m FROM nm) GROUP BY 1, 2) GROUP BY 1),
    lev AS (SELECT question, q, sum(w * v) / sum(w) AS v, coalesce(stddev_samp(v), 0) AS sp FROM (SELECT question, q, w, p * (CASE q WHEN 0.05 THEN 10 WHEN 0.5 THEN 20 ELSE 15 END) AS v FROM w, (VALUES (0.05), (0.5), (0.95)) x(q) WHERE question % 3 = 2) GROUP BY 1, 2),
    num AS (SELECT question, max(v) FILTER (q > 0.9) AS v, max(sp) FILTER (q = 0.5) AS disp FROM (SELECT question, q, sp, max(v) OVER (PARTITION BY question ORDER BY q) AS v FROM lev) GROUP BY 1),
    asked AS (SELECT DISTINCT question FROM fcs), seen AS (SELECT question, count(*) AS n, count(*) FILTER (member > 'p') AS un FROM w GROUP BY 1)
    SELECT asked.question, CASE asked.question % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'categorical' ELSE 'numeric' END AS kind, coalesce(n, 0) AS n_members, coalesce(un, 0) AS uncited,
           round(CASE WHEN n IS NULL AND asked.question % 3 = 0 THEN 0.5 ELSE probability END, 9) AS probability, round(coalesce(sd, div.disp, num.disp, 0), 9) AS dispersion, coalesce(n_dissent, 0) AS n_dissent, strongest,
           round(cat.p, 9) AS up, round(num.v, 9) AS high, CASE WHEN n IS NULL THEN 'no parseable forecasts; verdict is the uninformative prior' END AS note
    FROM asked LEFT JOIN seen ON seen.question = asked.question LEFT JOIN bin ON bin.question = asked.question LEFT JOIN far ON far.question = asked.question LEFT JOIN cat ON cat.question = asked.question AND o = 'up'
         LEFT JOIN div ON div.question = asked.question LEFT JOIN num ON num.question = asked.question""", "fcs ok w")
def a38_verdicts(spark, sf):
    f = forecasts(spark, sf).withColumn("parse_ok", ~((F.col("question") % 5 == 0) & (F.col("member") < "d")))
    p, k = F.col("p"), F.col("question") % 3
    told = f.select(
        "question", "member", "parse_ok", F.when(k == 0, p).alias("probability"), F.when(k == 1, F.create_map(F.lit("up"), p, F.lit("down"), (1 - p) * 0.75)).alias("distribution"),
        F.when(k == 2, F.create_map(F.lit("0.05"), p * 10, F.lit("0.5"), p * 20, F.lit("0.95"), p * 15)).alias("quantile_values"), F.when(F.col("member") <= "p", F.array(F.lit("E01"))).alias("citations"),
    )
    kind = F.when(F.col("question") % 3 == 0, "binary").when(F.col("question") % 3 == 1, "categorical").otherwise("numeric")
    asked = f.select("question").distinct().select("question", kind.alias("kind"), F.array(F.lit("up"), F.lit("flat"), F.lit("down")).alias("outcomes"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)).alias("quantiles"))
    weights = spark.createDataFrame([("click", 2.0), ("view", -1.0)], "member string, weight double")
    v = vd.verdicts(asked, told, weights)
    return rounded(v.select("question", "kind", "n_members", "uncited", "probability", "dispersion", "n_dissent", "strongest", F.try_element_at("distribution", F.lit("up")).alias("up"), F.try_element_at("quantile_values", F.lit("0.95")).alias("high"), "note"), 9)


_ARMS = {"rounds": ["0", "1"], "method": ["0", "1", "2", "3", "4", "5", "6"]}


@query("a47_compare_arms", f"""
    WITH b AS (SELECT question, avg((p - y) ** 2) AS brier FROM fcs GROUP BY 1),
    r AS (SELECT setting, CAST(CAST(CAST('0x' || substr(sha256(setting || ':' || question), 1, 8) AS BIGINT) % k AS INTEGER) AS VARCHAR) AS arm, brier FROM b, (VALUES ('rounds', 2), ('method', 7)) s(setting, k)),
    g AS (SELECT setting, CAST(unnest(range(k)) AS VARCHAR) AS arm FROM (VALUES ('rounds', 2), ('method', 7)) s(setting, k)),
    e AS (SELECT g.setting, g.arm, count(brier) AS n, avg(brier) AS mean, var_samp(brier) AS var FROM g LEFT JOIN r ON r.setting = g.setting AND r.arm = g.arm GROUP BY 1, 2),
    best AS (SELECT setting, arg_min(arm, (mean, arm)) AS winner FROM e WHERE n >= 30 GROUP BY 1 HAVING count(*) > 1),
    two AS (SELECT best.setting, winner, avg(brier) FILTER (r.arm = winner) AS m1, var_samp(brier) FILTER (r.arm = winner) / count(*) FILTER (r.arm = winner) AS a, count(*) FILTER (r.arm = winner) AS n1,
        avg(brier) FILTER (r.arm <> winner) AS m2, var_samp(brier) FILTER (r.arm <> winner) / count(*) FILTER (r.arm <> winner) AS c, count(*) FILTER (r.arm <> winner) AS n2
        FROM best JOIN r ON r.setting = best.setting JOIN e ON e.setting = r.setting AND e.arm = r.arm AND e.n >= 30 GROUP BY 1, 2),
    t AS (SELECT setting, winner, (m1 - m2) / sqrt(a + c) AS t, (a + c) ** 2 / (a ** 2 / (n1 - 1) + c ** 2 / (n2 - 1)) AS df FROM two),
    p AS (SELECT *, 1 - 2 * abs(t) / 6000 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * (1 + (t * k / 2000) ** 2 / df) ** (-(df + 1) / 2))) AS p FROM t)
    SELECT e.setting, e.arm, n, round(mean, 6) AS mean, round(sqrt(var / n), 6) AS se, winner, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p,
           CASE WHEN winner IS NULL THEN 'not enough evidence' WHEN p < 0.05 THEN 'winner scored better' ELSE 'no significant difference' END AS decision FROM e LEFT JOIN p ON p.setting = e.setting""", "fcs")
def a47_compare_arms(spark, sf):
    f = forecasts(spark, sf)
    scores = f.groupBy("question").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    asked = f.select("question").distinct()
    told = [asked.select("question", F.lit(s).alias("setting"), arm(F.col("question"), s, len(names)).cast("string").alias("arm")) for s, names in _ARMS.items()]
    out = vd.compare_arms(scores, told[0].unionByName(told[1]), _ARMS)
    return rounded(out.withColumn("df", F.round("df", 4)))


@query("a46_scoreboard", f"""
    WITH m AS (SELECT member, count(*) AS n_resolved, avg((p - y) ** 2) AS b, avg(y) AS base_rate FROM fcs GROUP BY 1),
    ec AS (SELECT member, sum(n * abs(g)) / sum(n) AS ece FROM (SELECT member, count(*) AS n, avg(y) - avg(p) AS g FROM fcs GROUP BY member, greatest(ceil(p * 10), 1)) GROUP BY 1),
    rs AS (SELECT member, sum(n * (fy - base_rate) ** 2) / sum(n) AS resolution FROM (SELECT member, count(*) AS n, avg(y) AS fy FROM fcs GROUP BY member, len(list_filter([i / 10.0 FOR i IN range(1, 10)], lambda e: e <= p))) JOIN m USING (member) GROUP BY 1)
    SELECT m.member, n_resolved, round(b, 7) AS brier, round(base_rate, 7) AS base_rate, round(base_rate * (1 - base_rate), 7) AS base_rate_brier, round(1 - b / (base_rate * (1 - base_rate)), 6) AS skill, round(ece, 7) AS ece, round(resolution, 8) AS resolution,
           reference, reference_brier, round(b - reference_brier, 7) AS difference, n_resolved >= 100 AS carries,
           CASE WHEN n_resolved < 30 THEN 'too few' WHEN 1 - b / (base_rate * (1 - base_rate)) < 0 THEN 'worse than the base rate' WHEN 1 - b / (base_rate * (1 - base_rate)) < 0.05 THEN 'no better than the base rate' ELSE 'better than the base rate' END AS verdict
    FROM m JOIN ec USING (member) JOIN rs USING (member), (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in vd.REFERENCES.items())}) r(reference, reference_brier)""", "fcs")
def a46_scoreboard(spark, sf):
    return rounded(vd.scoreboard(forecasts(spark, sf).withColumn("kind", F.lit("binary")).withColumn("position", F.col("question"))), 8)


_SAID = """'I have ' || CASE c_custkey % 4 WHEN 0 THEN c_custkey || ' lakh in HDFC Bank' WHEN 1 THEN 'Rs ' || c_custkey * 1000 || ' of gold' WHEN 2 THEN c_custkey || 'L into a nifty index fund' ELSE '5 in cash' END || ', ' || c_custkey % 9 || '.5 crores worth of the ' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' and 2 thousand rupees in liquid fund.' ELSE '' END"""


@query("f13_holdings", """
    SELECT c_custkey, unnest(h).name AS name, unnest(h).v::DOUBLE AS value, unnest(h).b AS bucket, unnest(h).g AS guessed FROM (SELECT c_custkey, list_filter([
        CASE c_custkey % 4 WHEN 0 THEN {name: 'Hdfc Bank', v: c_custkey * 1e5, b: 'large_cap', g: false} WHEN 1 THEN {name: 'Gold', v: c_custkey * 1e3, b: 'gold', g: false} WHEN 2 THEN {name: 'To A Nifty Index Fund', v: c_custkey * 1e5, b: 'index_fund', g: false} ELSE {name: 'Cash', v: 5, b: 'cash', g: false} END,
        {name: upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), v: (c_custkey % 9 + 0.5) * 1e7, b: 'large_cap', g: c_mktsegment <> 'none'},
        CASE WHEN c_custkey % 2 = 0 THEN {name: 'Liquid Fund', v: 2000, b: 'debt', g: false} END], lambda x: x IS NOT NULL AND x.v >= 100) AS h FROM customer)""")
def f13_holdings(spark, sf):
    said = table(spark, sf, "customer").select("c_custkey", F.expr(_SAID).alias("text"))
    return tx.parse_holdings(said)


_ASKED = """CASE c_custkey % 8 WHEN 0 THEN 'I want ' || c_custkey || ' lakh in 15 years' WHEN 1 THEN 'My portfolio: ' || c_custkey || ' lakh in gold and 2k in cash' WHEN 2 THEN 'Which fund has the best NAV?' WHEN 3 THEN '50,000 in a fixed deposit for 10 years'
    WHEN 4 THEN 'What is the drawdown of ' || lower(c_mktsegment) || '?' WHEN 5 THEN 'Will the nifty fall below 22,900 in 30 months?' WHEN 6 THEN 'The repo rate today' ELSE 'I have no idea about ' || lower(c_mktsegment) END"""


@query("f15_question_kind", "SELECT CASE c_custkey % 8 WHEN 0 THEN CASE WHEN c_custkey >= 1 THEN 'goal' ELSE 'council' END WHEN 1 THEN 'portfolio' WHEN 2 THEN 'fund' WHEN 3 THEN 'projection' WHEN 4 THEN 'risk' WHEN 5 THEN 'council' WHEN 6 THEN 'data' ELSE 'council' END AS kind, count(*) AS n FROM customer GROUP BY 1")
def f15_question_kind(spark, sf):
    return table(spark, sf, "customer").groupBy(tx.question_kind(F.expr(_ASKED)).alias("kind")).agg(F.count("*").alias("n"))


@query("f11_fund_pick", """
    WITH f AS (SELECT p_name AS name, p_brand AS amc, CASE WHEN p_size % 2 = 0 THEN 'Direct Plan' ELSE 'Regular' END AS plan, CASE WHEN p_size % 3 = 0 THEN 'Growth' ELSE 'IDCW' END AS option, p_type AS category, p_partkey FROM part),
    best AS (SELECT name, amc, plan, option, category, CAST(CASE WHEN starts_with(lower(name), 'gear') THEN 3 WHEN contains(lower(name), 'gear') THEN 1 ELSE 0 END + CASE WHEN starts_with(lower(name), 'brand') THEN 3 WHEN contains(lower(name), 'brand') THEN 1 ELSE 0 END
        + CASE WHEN contains(lower(plan), 'direct') THEN 2 ELSE 0 END + CASE WHEN contains(lower(option), 'growth') THEN 1 ELSE 0 END AS INTEGER) AS score FROM f
        WHERE (contains(lower(name), 'gear') OR contains(lower(amc), 'gear')) AND (contains(lower(name), 'brand') OR contains(lower(amc), 'brand')) ORDER BY score DESC, name, amc, plan, option, category LIMIT 8)
    SELECT *, (SELECT count(*) FROM f WHERE category = (SELECT category FROM best ORDER BY score DESC, name, amc, plan, option, category LIMIT 1)) AS peers FROM best""")
def f11_fund_pick(spark, sf):
    p = table(spark, sf, "part")
    funds = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("amc"), F.when(F.col("p_size") % 2 == 0, "Direct Plan").otherwise("Regular").alias("plan"), F.when(F.col("p_size") % 3 == 0, "Growth").otherwise("IDCW").alias("option"), F.col("p_type").alias("category"))
    return tx.fund_search(funds, "Brand gear mutual fund")


#: Simulations and months; the operator's own default is 20,000 simulations.
SIMS, MONTHS = 200, 60
_MIX = "(sim::BIGINT * 73856093 + ({step})::BIGINT * 19349663 + {seed}) % 2147483647"
for _ in range(3):
    _MIX = f"xor({_MIX}, ({_MIX}) >> 15) * 48271 % 2147483647"
BASE["hist"] = "hist AS (SELECT entity AS asset, month, least(greatest(r / 20, -0.2), 0.2) AS r FROM (SELECT entity, month, price / lag(price) OVER (PARTITION BY entity ORDER BY month) - 1 AS r FROM (SELECT entity, CAST(last_day(date) AS DATE) AS month, arg_max(price, date) AS price FROM px GROUP BY 1, 2)) WHERE r IS NOT NULL)"
BASE["paths"] = f"""nums AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY month) - 1 AS i FROM hist), long AS (SELECT asset, count(*) AS n, CASE WHEN count(*) >= 24 THEN 12 ELSE greatest(1, count(*) // 4) END AS size FROM hist GROUP BY 1 HAVING count(*) >= 60),
    paths AS (SELECT d.asset, sim, d.month, nums.r FROM (SELECT *, {_MIX.format(step='month // size', seed=12345 * 83492791 % 2147483647)} % (n - size + 1) + month % size AS at FROM long, range({SIMS}) s(sim), range({MONTHS}) m(month)) d JOIN nums ON nums.asset = d.asset AND nums.i = d.at)"""
BASE["ends"] = """ends AS (SELECT asset, sim, count(*) AS n, arg_max(level, month) AS lump, arg_max(level, month) * sum(1 / level) AS monthly, min(fall) AS fall FROM
    (SELECT *, level / max(level) OVER (PARTITION BY asset, sim ORDER BY month) - 1 AS fall FROM (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY asset, sim ORDER BY month)) AS level FROM paths)) GROUP BY 1, 2)"""


def history(spark, sf):
    """Monthly returns of every brand, as those of an asset."""
    m = ln.month_end(prices(spark, sf)).where("r is not null")
    return m.select(F.col("entity").alias("asset"), "month", F.least(F.greatest(F.col("r") / 20, F.lit(-0.2)), F.lit(0.2)).alias("r"))


#: Brands that are taxed as others are.
_TAXED = {"Brand#11": pj.TAXES["indian_equity"], "Brand#12": pj.TAXES["gold"], "Brand#13": pj.TAXES["debt_fund"]}


@query("m4_compare_history", f"""
    WITH t AS (SELECT *, 1e5 * lump AS nominal, CASE asset WHEN 'Brand#11' THEN 0.125 * greatest(greatest(1e5 * lump - 1e5, 0) - 125000, 0) WHEN 'Brand#12' THEN 0.125 * greatest(1e5 * lump - 1e5, 0) WHEN 'Brand#13' THEN 0.3 * greatest(1e5 * lump - 1e5, 0) ELSE 0 END AS tax FROM ends)
    SELECT a.asset, n_sims, round(p5, 3) AS nominal_p5, round(p50, 3) AS nominal_p50, round(p95, 3) AS nominal_p95, round(p50 / 1.055 ** 5, 3) AS real_p50, round(tx, 3) AS after_tax_p75, round(tx / 1.055 ** 5, 3) AS net_real_p75, round(loss, 6) AS p_loss, round(below, 6) AS p_below_prices, round(dep, 6) AS p_below_deposit,
           round((p50 / 1e5) ** 0.2 - 1, 6) AS median_growth, round(mf, 6) AS median_fall, round(df, 6) AS deep_fall, CASE WHEN p50 IS NULL THEN coalesce(h.n, 0) || ' months of history, need 60' END AS error
    FROM (SELECT DISTINCT p_brand AS asset FROM part) a LEFT JOIN (SELECT asset, count(*) AS n FROM hist GROUP BY 1) h ON h.asset = a.asset LEFT JOIN
    (SELECT asset, count(*) AS n_sims, quantile_cont(nominal, 0.05) AS p5, quantile_cont(nominal, 0.5) AS p50, quantile_cont(nominal, 0.95) AS p95, quantile_cont(nominal - tax, 0.75) AS tx, avg((nominal < 1e5)::INT) AS loss, avg((nominal / 1.055 ** 5 < 1e5)::INT) AS below, avg((nominal < 1e5 * 1.068 ** 5)::INT) AS dep, median(fall) AS mf, quantile_cont(fall, 0.05) AS df FROM t GROUP BY 1) r ON r.asset = a.asset""", "px hist paths ends")
def m4_compare_history(spark, sf):
    assets = table(spark, sf, "part").select(F.col("p_brand").alias("asset"))
    out = pj.compare(history(spark, sf), assets, 1e5, MONTHS, SIMS, taxes=_TAXED)
    money = ["nominal_p5", "nominal_p50", "nominal_p95", "real_p50", "after_tax_p75", "net_real_p75"]
    return out.select("asset", "n_sims", *[F.round(c, 3).alias(c) for c in money], *[F.round(c, 6).alias(c) for c in ("p_loss", "p_below_prices", "p_below_deposit", "median_growth", "median_fall", "deep_fall")], "error")


@query("m2_project", """
    SELECT asset, round(quantile_cont(1e5 * lump, 0.05), 3) AS p5, round(quantile_cont(1e5 * lump, 0.25), 3) AS p25, round(median(1e5 * lump), 3) AS p50, round(quantile_cont(1e5 * lump, 0.75), 3) AS p75, round(quantile_cont(1e5 * lump, 0.95), 3) AS p95, round(avg((1e5 * lump < 1e5)::INT), 6) AS p_loss FROM ends GROUP BY 1""", "px hist paths ends")
def m2_project(spark, sf):
    h = history(spark, sf)
    enough = h.join(h.groupBy("asset").count().where("count >= 60"), "asset", "left_semi")
    out = pj.project(pj.history_paths(enough, SIMS, MONTHS), 1e5)
    return out.select("asset", *[F.round(f"nominal_p{p}", 3).alias(f"p{p}") for p in (5, 25, 50, 75, 95)], F.round("p_loss", 6).alias("p_loss"))


@query("m2_project_monthly", """
    SELECT asset, count(*) AS n_sims, 60000::DOUBLE AS paid, round(quantile_cont(1e3 * monthly, 0.1), 3) AS nominal_p10, round(median(1e3 * monthly), 3) AS nominal_p50, round(quantile_cont(1e3 * monthly, 0.9), 3) AS nominal_p90, round(avg((1e3 * monthly < 6e4)::INT), 6) AS p_loss,
           round(avg((1e3 * monthly < 1e3 * list_sum(list_transform(range(1, 61), lambda k: 1.068 ** (k / 12))))::INT), 6) AS p_below_deposit FROM ends GROUP BY 1""", "px hist paths ends")
def m2_project_monthly(spark, sf):
    h = history(spark, sf)
    enough = h.join(h.groupBy("asset").count().where("count >= 60"), "asset", "left_semi")
    out = pj.project(pj.history_paths(enough, SIMS, MONTHS), 1e3, "monthly")
    return out.select("asset", "n_sims", "paid", *[F.round(f"nominal_p{p}", 3).alias(f"nominal_p{p}") for p in (10, 50, 90)], F.round("p_loss", 6).alias("p_loss"), F.round("p_below_deposit", 6).alias("p_below_deposit"))


@query("m3_goal_history", """
    SELECT e.asset, round(max(m), 4) AS monthly_50, round(max(m8), 4) AS monthly_80, round(max(l), 3) AS lump_50, round(avg((m * monthly >= 1e6)::INT), 1) AS p_reach, round(max(m) * 60, 3) AS contributed, round(1e6 / 1.055 ** 5, 4) AS target_today
    FROM ends e JOIN (SELECT asset, 1e6 / median(monthly) AS m, 1e6 / quantile_cont(monthly, 0.2) AS m8, 1e6 / median(lump) AS l FROM ends GROUP BY 1) n ON n.asset = e.asset GROUP BY 1""", "px hist paths ends")
def m3_goal_history(spark, sf):
    h = history(spark, sf)
    enough = h.join(h.groupBy("asset").count().where("count >= 60"), "asset", "left_semi")
    out = pj.plan_goal(pj.history_paths(enough, SIMS, MONTHS), 1e6)
    return out.select("asset", *[F.round(c, 4).alias(c) for c in ("monthly_50", "monthly_80")], F.round("lump_50", 3).alias("lump_50"), F.round("p_reach", 1).alias("p_reach"), F.round("contributed", 3).alias("contributed"), F.round("target_today", 4).alias("target_today"))


_STAMPS = {0: ("EEE, d MMM yyyy HH:mm:ss '+0530'", "INTERVAL 330 MINUTE"), 1: ("EEE, d MMM yyyy HH:mm:ss", "INTERVAL 330 MINUTE"), 2: ("d MMM, yyyy '+0530'", "INTERVAL 330 MINUTE"), 3: ("d MMM, yyyy", "INTERVAL 330 MINUTE"), 4: ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "INTERVAL 120 MINUTE"), 5: ("yyyy-MM-dd'T'HH:mm:ss'Z'", "INTERVAL 0 MINUTE"), 6: ("'on' yyyy", None)}


@query("f8_every_format", f"SELECT o_orderkey, CASE o_orderkey % 7 {' '.join(f'WHEN {k} THEN CAST(o_orderdate AS TIMESTAMP) - {zone}' for k, (_, zone) in _STAMPS.items() if zone)} END AS published FROM orders")
def f8_every_format(spark, sf):
    written = F.lit(None)
    for k, (pattern, _) in _STAMPS.items():
        written = F.when(F.col("o_orderkey") % 7 == k, F.date_format("o_orderdate", pattern)).otherwise(written)
    return table(spark, sf, "orders").select("o_orderkey", feeds.parsed_time(written).cast("timestamp_ntz").alias("published"))


BASE["src"] = """src AS (SELECT s_suppkey AS position, s_name AS source, CASE s_suppkey % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'fragile' WHEN 2 THEN 'blocked' ELSE 'planned' END AS status, 'd' || s_nationkey % 5 AS domain, CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-07-01' END AS last_verified, s_suppkey % 6 = 0 AS needs_key,
    ['S' || s_nationkey, 'T' || s_suppkey % 10] AS series, CASE WHEN s_suppkey % 4 < 2 THEN ['equity', 'bond'] ELSE ['fx'] END AS asset_classes FROM supplier)"""


def catalogue(spark, sf):
    """Suppliers as sources of series."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    pick = lambda *names: F.get(F.array(*[F.lit(x) for x in names]), (k % 4).cast("int"))
    return table(spark, sf, "supplier").select(
        k.alias("position"), F.col("s_name").alias("source"), pick("working", "fragile", "blocked", "planned").alias("status"), F.concat(F.lit("d"), (n % 5).cast("string")).alias("domain"), F.when(k % 3 == 0, F.lit("2024-07-01").cast("date")).alias("last_verified"),
        (k % 6 == 0).alias("needs_key"), F.array(F.concat(F.lit("S"), n.cast("string")), F.concat(F.lit("T"), (k % 10).cast("string"))).alias("series"), F.when(k % 4 < 2, F.array(F.lit("equity"), F.lit("bond"))).otherwise(F.array(F.lit("fx"))).alias("asset_classes"),
    )


@query("a50_catalogue_summary", "SELECT domain, count(*) AS sources, count(*) FILTER (status = 'working') AS working, count(*) FILTER (status = 'fragile') AS fragile, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'planned') AS planned, count(last_verified) AS verified, count(DISTINCT domain) AS domains, count(*) FILTER (needs_key) AS need_key, (SELECT count(DISTINCT x) FROM (SELECT unnest(series) AS x, domain AS d FROM src) WHERE d = src.domain) AS series FROM src GROUP BY 1", "src")
def a50_catalogue_summary(spark, sf):
    return ledger.catalogue_summary(catalogue(spark, sf), ["domain"])


@query("a50_asset_classes", "SELECT a AS asset_class, count(*) AS n_sources, count(*) FILTER (status = 'working') AS n_working, bool_or(status IN ('working', 'fragile')) AS can_answer FROM (SELECT *, unnest(asset_classes) AS a FROM src) GROUP BY 1", "src")
def a50_asset_classes(spark, sf):
    return ledger.catalogue_coverage(catalogue(spark, sf))


@query("sc32_first_sources", "SELECT x AS series, arg_min(source, (position, pos)) AS source FROM (SELECT position, source, unnest(series) AS x, unnest([0, 1]) AS pos FROM src WHERE status = 'working' AND list_contains(asset_classes, 'bond')) GROUP BY 1", "src")
def sc32_first_sources(spark, sf):
    return ledger.catalogue_series(ledger.catalogue_where(catalogue(spark, sf), status="working", asset_class="bond"))


@query("w23_trailing_growth", "SELECT entity, n AS n_months, round(CASE WHEN n > 60 THEN (l / f) ** 0.2 - 1 ELSE 0.055 END, 6) AS growth FROM (SELECT entity, count(*) AS n, max(price) FILTER (k = 1) AS l, max(price) FILTER (k = 60) AS f FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS k FROM (SELECT entity, CAST(last_day(date) AS DATE) AS month, arg_max(price, date) AS price FROM px GROUP BY 1, 2)) GROUP BY 1)", "px")
def w23_trailing_growth(spark, sf):
    return rounded(ln.trailing_growth(prices(spark, sf), 5))


@query("a45_market_duel", """
    SELECT round(base_rate, 9) AS base_rate, n, round(fb, 9) AS forecast_brier, round(mb, 9) AS market_brier, round(bb, 9) AS base_rate_brier, round(fl, 9) AS forecast_log, round(ml, 9) AS market_log, round(mf, 9) AS mean_forecast, round(mm, 9) AS mean_market, round(gap, 9) AS mean_gap,
           round(1 - fb / mb, 8) AS skill_market, round(1 - fb / bb, 8) AS skill_base_rate,
           CASE WHEN n < 20 THEN 'inconclusive' WHEN 1 - fb / mb > 0.05 THEN 'ahead of the market' WHEN 1 - fb / mb < -0.05 THEN 'behind the market' ELSE 'indistinguishable from the market' END AS verdict FROM
    (SELECT avg(y) AS base_rate, count(*) AS n, avg((p - y) ** 2) AS fb, avg((m - y) ** 2) AS mb, avg(y) * (1 - avg(y)) AS bb, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS fl, avg(-(y * ln(m) + (1 - y) * ln(1 - m))) AS ml, avg(p) AS mf, avg(m) AS mm, avg(p - m) AS gap
     FROM (SELECT question, p, y FROM fcs WHERE member = 'click') a JOIN (SELECT question, p AS m FROM fcs WHERE member = 'view') b USING (question))""", "fcs")
def a45_market_duel(spark, sf):
    f = forecasts(spark, sf)
    market = f.where("member = 'view'").select("question", F.col("p").alias("m"))
    out = rounded(ledger.market_duel(f.where("member = 'click'").join(market, "question")), 9)
    return out.withColumns({c: F.round(c, 8) for c in ("skill_market", "skill_base_rate")})


@query("ll1_any_resolver", "SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice > 100000 END AS outcome, CASE WHEN o_orderkey % 11 = 0 THEN 'not resolvable yet' WHEN o_orderkey % 13 = 0 THEN 'LookupError: no source' END AS note FROM orders")
def ll1_any_resolver(spark, sf):
    def resolver(question):
        if question["question_id"] % 11 == 0:
            return None
        if question["question_id"] % 13 == 0:
            raise LookupError("no source")
        return question["level"] > 100000

    return ledger.resolved_by(table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_totalprice").alias("level")), resolver)


#: States of items as deposits: their taxes and discounts are rates and volatilities.
_UNIT = "(({}) + 0.5::DOUBLE) / 2147483647"
BASE["paths_fixed"] = f"""rates AS (SELECT l_returnflag || l_linestatus AS asset, 0.04::DOUBLE + avg(l_tax) AS rate, 0.01::DOUBLE + avg(l_discount) / 5 AS vol FROM lineitem GROUP BY 1),
    paths AS (SELECT asset, sim, month, (1 + rate) ** (1::DOUBLE / 12) - 1 + vol / sqrt(12) * sqrt(-2 * ln({_UNIT.format(_MIX.format(step='month', seed=12345 * 83492791 % 2147483647))})) * cos(2 * pi() * {_UNIT.format(_MIX.format(step='month', seed=12346 * 83492791 % 2147483647))}) AS r FROM rates, range({SIMS}) s(sim), range({MONTHS}) m(month))"""


def fixed(spark, sf):
    """Paths of deposits whose rates and volatilities come from the table."""
    rates = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("asset")).agg((0.04 + F.avg("l_tax")).alias("rate"), (0.01 + F.avg("l_discount") / 5).alias("vol"))
    return pj.fixed_paths(rates, SIMS, MONTHS)


@query("m5_project_fixed", """
    SELECT asset, count(*) AS n_sims, round(quantile_cont(1e5 * lump, 0.05), 3) AS nominal_p5, round(median(1e5 * lump), 3) AS nominal_p50, round(quantile_cont(1e5 * lump, 0.95), 3) AS nominal_p95, round(avg((1e5 * lump / 1.055 ** 5 < 1e5)::INT), 6) AS p_below_prices, round(median(fall), 6) AS median_fall FROM ends GROUP BY 1""", "paths_fixed ends")
def m5_project_fixed(spark, sf):
    out = pj.project(fixed(spark, sf), 1e5)
    return out.select("asset", "n_sims", *[F.round(f"nominal_p{p}", 3).alias(f"nominal_p{p}") for p in (5, 50, 95)], *[F.round(c, 6).alias(c) for c in ("p_below_prices", "median_fall")])


@query("m3_plan_goal", "SELECT asset, round(1e6 / median(monthly), 4) AS monthly_50, round(1e6 / quantile_cont(monthly, 0.2), 4) AS monthly_80, round(1e6 / median(lump), 3) AS lump_50, round(1e6 / 1.055 ** 5, 4) AS target_today FROM ends GROUP BY 1", "paths_fixed ends")
def m3_plan_goal(spark, sf):
    out = pj.plan_goal(fixed(spark, sf), 1e6)
    return out.select("asset", *[F.round(c, 4).alias(c) for c in ("monthly_50", "monthly_80")], F.round("lump_50", 3).alias("lump_50"), F.round("target_today", 4).alias("target_today"))


@query("m4_compare_assets", """
    SELECT asset, round(median(1e3 * monthly), 3) AS nominal_p50, round(quantile_cont(1e3 * monthly, 0.05), 3) AS nominal_p5, round(avg((1e3 * monthly < 6e4)::INT), 6) AS p_loss, round((median(1e3 * monthly) / 6e4) ** 0.2 - 1, 6) AS median_growth FROM ends GROUP BY 1""", "paths_fixed ends")
def m4_compare_assets(spark, sf):
    out = pj.project(fixed(spark, sf), 1e3, "monthly")
    return out.select("asset", F.round("nominal_p50", 3).alias("nominal_p50"), F.round("nominal_p5", 3).alias("nominal_p5"), F.round("p_loss", 6).alias("p_loss"), F.round("median_growth", 6).alias("median_growth"))
