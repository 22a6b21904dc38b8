"""Further queries over the driver's tables: models, ledgers, portfolios, feeds. They join those of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, models, portfolio, risk
from ..sources import feeds
from .registry import forecasts, prices, query, returns, rounded, table

@query("m6_garch")
def m6_garch(spark, sf):
    return rounded(models.garch(returns(spark, sf)), 4)


@query("m7_filtered_historical")
def m7_filtered_historical(spark, sf):
    return rounded(models.var_filtered_historical(returns(spark, sf)), 4)


@query("m8_extreme_value")
def m8_extreme_value(spark, sf):
    return rounded(models.var_extreme(returns(spark, sf)), 4)


@query("a12_ledoit_wolf")
def a12_ledoit_wolf(spark, sf):
    return rounded(models.shrinkage_cov(returns(spark, sf).withColumn("book", F.substring("entity", 1, 7))))


@query("a13_oas")
def a13_oas(spark, sf):
    return rounded(models.shrinkage_cov(returns(spark, sf).withColumn("book", F.substring("entity", 1, 7)), "oas"))


@query("a21_cross_section")
def a21_cross_section(spark, sf):
    kinds = table(spark, sf, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.avg("p_size").alias("size"), F.sum("p_retailprice").alias("cap"))
    scored = risk.zscore(kinds.withColumn("all", F.lit(1)), ["all"], "size").select("entity", "cap", F.col("z").alias("size_score"))
    panel = returns(spark, sf).join(F.broadcast(scored), "entity").withColumn("market", F.lit(1.0))
    return rounded(models.factor_summary(models.cross_sectional_regression(panel, ["market", "size_score"])), 5)


@query("a56_replay", "SELECT book, round(exp(sum(ln(1 + r))) - 1, 6) AS total_return, round(min(r), 6) AS worst_day, round(max(r), 6) AS best_day, round(stddev_samp(r) * sqrt(252), 6) AS vol, count(*) FILTER (WHERE abs(r) > 0.02) AS days_over_2pct, round(min(fall), 6) AS max_drawdown FROM (SELECT *, exp(lv) / max(exp(lv)) OVER (PARTITION BY book ORDER BY date) - 1 AS fall FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY book ORDER BY date) AS lv FROM (SELECT substr(entity, 1, 7) AS book, date, sum(0.01 * r) AS r FROM rt GROUP BY 1, 2))) GROUP BY 1", "px rt")
def a56_replay(spark, sf):
    r = returns(spark, sf)
    w = table(spark, sf, "part").select(F.col("p_brand").alias("entity")).distinct().select(F.substring("entity", 1, 7).alias("book"), "entity", F.lit(0.01).alias("weight"))
    return rounded(portfolio.replay(r, w))


@query("a45_against_market", "SELECT count(*) AS n, round(avg((p - y) ** 2), 7) AS forecast, round(avg((m - y) ** 2), 7) AS market, round(avg((b - y) ** 2), 7) AS climate, round(1 - avg((p - y) ** 2) / avg((m - y) ** 2), 6) AS skill_market, round(1 - avg((p - y) ** 2) / avg((b - y) ** 2), 6) AS skill_climate, CASE WHEN count(*) < 20 THEN 'too few' WHEN 1 - avg((p - y) ** 2) / avg((m - y) ** 2) > 0 THEN 'ahead of the market' ELSE 'behind the market' END AS verdict FROM (SELECT *, 0.5 AS m, (SELECT avg(y) FROM fcs) AS b FROM fcs)", "fcs")
def a45_against_market(spark, sf):
    s = ledger.against_market(forecasts(spark, sf).withColumn("m", F.lit(0.5)))
    return s.select("n", *[F.round(c, 7).alias(c) for c in ("forecast", "market", "climate")], *[F.round(c, 6).alias(c) for c in ("skill_market", "skill_climate")], "verdict")


@query("sk2_latest_wins", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def sk2_latest_wins(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ledger.latest_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("sk8_add_absent", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'rejected' ELSE 'proposed' END AS state FROM customer")
def sk8_add_absent(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return ledger.add_absent(c.where("key % 3 = 0").withColumn("state", F.lit("rejected")), c.withColumn("state", F.lit("proposed")), "key")


@query("a55_state_counts", "SELECT s.state, count(d.doc_id) AS n FROM (VALUES ('proposed'), ('verified'), ('validated'), ('promoted'), ('rejected')) s(state) LEFT JOIN (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'promoted' ELSE 'rejected' END AS state FROM documents) d ON d.state = s.state GROUP BY 1")
def a55_state_counts(spark, sf):
    k = F.col("doc_id") % 3
    return ledger.state_counts(table(spark, sf, "documents").select(F.when(k == 0, "proposed").when(k == 1, "promoted").otherwise("rejected").alias("state")))


@query("ll1_resolve_due", "SELECT f.question AS question_id, member, p, y, round((p - y) ** 2, 8) AS brier FROM (SELECT question, member, round(p, 6) AS p, y FROM fcs UNION ALL SELECT question, '__council__', round(avg(p), 6), max(y) FROM fcs GROUP BY 1) f WHERE f.question % 5 <> 0 AND f.question % 2 = 0", "fcs")
def ll1_resolve_due(spark, sf):
    f = forecasts(spark, sf)
    runs = f.groupBy(F.col("question").alias("question_id")).agg(F.round(F.avg("p"), 6).alias("probability"), F.collect_list(F.struct("member", F.round("p", 6).alias("probability"), F.lit(True).alias("parse_ok"))).alias("forecasts"))
    day = F.when(F.col("question_id") % 2 == 0, F.lit("2024-01-01")).otherwise(F.lit("2030-01-01")).cast("date")
    runs = runs.withColumns({"run_id": F.col("question_id"), "resolution_date": day})
    known = f.groupBy(F.col("question").alias("question_id")).agg((F.max("y") == 1).alias("outcome"))
    out = ledger.resolve_due(runs, known, runs.where("run_id % 5 = 0"), "2024-06-30")
    return out.select("question_id", "member", "p", "y", F.round("brier", 8).alias("brier"))


@query("ll3_validate", """
    WITH c AS (SELECT entity AS candidate, date, r AS x, avg(r) OVER (PARTITION BY date) AS y FROM rt), k AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY date) AS i, count(*) OVER (PARTITION BY candidate) AS n FROM c),
    p AS (SELECT *, CASE WHEN i <= floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN i > floor(n * CAST(0.6 AS DOUBLE)) + 3 THEN 'test' END AS part FROM k),
    g AS (SELECT candidate, part, rank() OVER (PARTITION BY candidate, part ORDER BY x) + (count(*) OVER (PARTITION BY candidate, part, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY candidate, part ORDER BY y) + (count(*) OVER (PARTITION BY candidate, part, y) - 1) / 2 AS ry FROM p WHERE part IS NOT NULL),
    s AS (SELECT candidate, max(rho) FILTER (part = 'train') AS rho_train, max(n) FILTER (part = 'train') AS n_train, max(rho) FILTER (part = 'test') AS rho_test, max(n) FILTER (part = 'test') AS n_test FROM (SELECT candidate, part, corr(rx, ry) AS rho, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT *, CAST(n_test - 2 AS DOUBLE) AS df, rho_test * sqrt((n_test - 2) / greatest(1 - rho_test ** 2, 1e-12)) AS t FROM s WHERE n_test >= 20 AND n_train + n_test >= 40),
    q AS (SELECT *, 1 - 2 * abs(t) / 6000 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * (1 + (t * k / 2000) ** 2 / df) ** (-(df + 1) / 2))) AS p FROM t),
    r AS (SELECT *, row_number() OVER (ORDER BY p, candidate) AS rank, count(*) OVER () AS m FROM q),
    a AS (SELECT *, least(min(p * m / rank) OVER (ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adjusted FROM r)
    SELECT candidate, round(rho_train, 6) AS rho_train, n_train, round(rho_test, 6) AS rho_test, n_test, round(p, 6) AS p, round(adjusted, 6) AS adjusted, adjusted <= 0.1 AND sign(rho_train) = sign(rho_test) AS survives, sign(rho_train) = sign(rho_test) AS sign_consistent FROM a""", "px rt")
def ll3_validate(spark, sf):
    r = returns(spark, sf)
    target = r.groupBy("date").agg(F.avg("r").alias("y"))
    out = rounded(ledger.validate(r.select(F.col("entity").alias("candidate"), "date", F.col("r").alias("x")).join(target, "date")))
    return out.drop("rank")


@query("f12_buckets", """
    SELECT n.name, n.bucket, n.guessed, count(c_custkey) AS holders FROM (VALUES ('Bharat Bond ETF', 'debt', false, 'BUILDING'), ('PPF', 'debt', false, 'AUTOMOBILE'), ('Silver', 'gold', false, 'MACHINERY'),
    ('Nifty 50 Index Fund', 'index_fund', false, 'FURNITURE'), ('HDFC Bank', 'large_cap', false, 'HOUSEHOLD'), ('Some Equity Fund', 'large_cap', true, 'BUILDING'), ('Parag Global Fund', 'international', false, 'MACHINERY'),
    ('Axis Midcap', 'mid_small_cap', false, 'FURNITURE'), ('savings', 'cash', false, 'BUILDING')) n(name, bucket, guessed, segment) LEFT JOIN customer ON c_mktsegment = segment GROUP BY 1, 2, 3""")
def f12_buckets(spark, sf):
    held = {"BUILDING": ["Bharat Bond ETF", "Some Equity Fund", "savings"], "AUTOMOBILE": ["PPF"], "MACHINERY": ["Silver", "Parag Global Fund"], "FURNITURE": ["Nifty 50 Index Fund", "Axis Midcap"], "HOUSEHOLD": ["HDFC Bank"]}
    names = spark.createDataFrame([(k, n) for k, names in held.items() for n in names], "segment string, name string")
    rows = names.join(table(spark, sf, "customer"), F.col("segment") == F.col("c_mktsegment"), "left").groupBy("name").agg(F.count("c_custkey").alias("holders"))
    return rows.select("name", portfolio.bucket_of(F.col("name")).alias("bucket"), portfolio.bucket_guessed(F.col("name")).alias("guessed"), "holders")


@query("a53_portfolio", "SELECT c_nationkey AS book, round(sum(abs(c_acctbal)), 4) AS total, round(sum(c_acctbal ** 2) / sum(abs(c_acctbal)) ** 2, 4) AS hhi, 0.16::DOUBLE AS vol, round(-1.65 * 0.16 * sum(abs(c_acctbal)), 4) AS bad_year, round(1.65 * 0.16 * sum(abs(c_acctbal)), 4) AS good_year FROM customer GROUP BY 1")
def a53_portfolio(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_mktsegment").alias("name"), F.abs("c_acctbal").alias("value"))
    return rounded(portfolio.analyse(c), 4)


@query("f26_fx_decomposition", "SELECT entity, round(l, 6) AS local, round(x, 6) AS fx, round((1 + l) * (1 + x) - 1, 6) AS total, round(l * x, 6) AS interaction FROM (SELECT entity, arg_max(price, date) / arg_min(price, date) - 1 AS l, arg_max(volume, date) / arg_min(volume, date) - 1 AS x FROM px GROUP BY 1)", "px")
def f26_fx_decomposition(spark, sf):
    return rounded(portfolio.fx_decomposition(prices(spark, sf).withColumnRenamed("volume", "rate")).drop("fx_share"))


@query("sc27_retrieve", "SELECT id, source, age_hours FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY age_hours, source, position) AS k FROM (SELECT doc_id AS position, doc_id // 2 AS id, source, CAST(doc_id * 37 % 400 AS DOUBLE) AS age_hours, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 50 AND age_hours <= 168) WHERE k = 1")
def sc27_retrieve(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), F.floor(F.col("doc_id") / 2).alias("id"), "source", (F.col("doc_id") * 37 % 400).cast("double").alias("age_hours"))
    return feeds.retrieve(d, 50, 168.0).drop("position")


@query("fp9_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), lower('part')) AND contains(lower(p_name || ' ' || p_type), '1')")
def fp9_search(spark, sf):
    return feeds.search(table(spark, sf, "part"), "part 1", "p_name", "p_type").select("p_partkey", "p_name")


@query("fp13_citations", """
    SELECT o_orderkey, array_to_string(list_sort(list_filter(list_distinct(c), lambda x: NOT list_contains(k, x))), ',') AS unknown, len(list_filter(list_distinct(c), lambda x: list_contains(k, x))) / len(list_distinct(k)) AS coverage FROM
    (SELECT o_orderkey, ['E0' || o_orderkey % 5, 'E0' || o_custkey % 7] AS c, ['E0' || o_custkey % 3, 'E03', 'E0' || o_orderkey % 4] AS k FROM orders)""")
def fp13_citations(spark, sf):
    name = lambda c, n: F.concat(F.lit("E0"), (F.col(c) % n).cast("string"))
    o = table(spark, sf, "orders").select("o_orderkey", F.array(name("o_orderkey", 5), name("o_custkey", 7)).alias("cited"), F.array(name("o_custkey", 3), F.lit("E03"), name("o_orderkey", 4)).alias("known"))
    return feeds.citations(o, "cited", "known").select("o_orderkey", F.array_join(F.array_sort("unknown"), ",").alias("unknown"), "coverage")


@query("fp11_noise", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '(?i)0{5}1') THEN 'ones' WHEN length(c_name) < 15 THEN 'short' END AS reason FROM customer")
def fp11_noise(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", feeds.noise(F.col("c_name"), {"ones": "(?i)0{5}1"}).alias("reason"))


@query("f8_parsed_time", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS published FROM orders")
def f8_parsed_time(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", feeds.parsed_time(text, "UTC").cast("timestamp_ntz").alias("published"))
