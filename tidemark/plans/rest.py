"""Queries of operators that others don't meet: labelled rates, panels of countries, matches, factor summaries, counted windows, charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors, models
from ..sources import feeds, parsers
from ..streaming import observations as st
from .registry import prices, query, returns, rounded, table
from .wider import _loadings, _premia


@query("sc22_current_rates", "SELECT s_suppkey AS page_id, series, CAST(value AS DOUBLE) / 100 AS value FROM (SELECT s_suppkey, 'REPO' AS series, s_suppkey * 7 % 900 AS value FROM supplier UNION ALL SELECT s_suppkey, 'BANK', s_nationkey * 31 % 900 FROM supplier WHERE s_suppkey % 3 > 0)")
def sc22_current_rates(spark, sf):
    """A page a supplier: a style sheet with a number, labels, a value one to three tokens on, a label that comes again, one without a value."""
    shown = lambda c: F.format_string("%d.%02d", F.floor(c / 100), c % 100)
    repo, bank = F.col("s_suppkey") * 7 % 900, F.col("s_nationkey") * 31 % 900
    html = F.concat(
        F.lit("<style>td { width: 9px }</style><table><tr><td>Policy Repo Rate</td><td>:</td><td> "), shown(repo), F.lit("% </td></tr>"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("<tr><td>BANK RATE</td><td>as of</td><td>today</td><td>"), shown(bank), F.lit("</td></tr>"))).otherwise("<tr><td>Bank Rate</td><td>n/a</td><td>-</td><td>-</td></tr>"),
        F.lit("<tr><td>x</td><td>y</td><td>z</td></tr><tr><td>policy repo rate</td><td>99.00</td></tr></table>"),
    )
    return feeds.labelled_rates(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")), {"policy repo rate": "REPO", "bank rate": "BANK"})


@query("j15_compare_countries", "SELECT date, max(v) FILTER (c = '1') AS a, max(v) FILTER (c = '3') AS b, max(v) FILTER (c = '5') AS c FROM (SELECT CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS date, substr(o_orderpriority, 1, 1) AS c, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) GROUP BY 1")
def j15_compare_countries(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("iso3"), F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(F.round(F.max("o_totalprice"), 2).alias("value"))
    out = feeds.compare_countries(o, ["1", "3", "5"])
    return out.select("date", F.col("1").alias("a"), F.col("3").alias("b"), F.col("5").alias("c"))


@query("fp15_matching_or_all", "SELECT 'some' AS asked, p_partkey FROM part WHERE contains(lower(p_name), 'gear') OR contains(lower(p_name), 'blue') UNION ALL SELECT 'none', p_partkey FROM part")
def fp15_matching_or_all(spark, sf):
    part = table(spark, sf, "part")
    some, none = (feeds.matching_or_all(part, F.col("p_name"), q).select(F.lit(k).alias("asked"), "p_partkey") for k, q in (("some", "is a BLUE gear up"), ("none", "zyzzyva of it")))
    return some.unionByName(none)


@query("t10_ranked_summary", """
    SELECT factor, round(m * 252, 6) AS mean, round(sd * sqrt(252), 6) AS vol, round(m / sd * sqrt(252), 6) AS sharpe, round(t, 6) AS t, n,
           round(1 - 2 * abs(t) / 6000 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * (1 + (t * k / 2000) ** 2 / (n - 1)) ** (-n / 2))), 6) AS p FROM
    (SELECT *, m / sd * sqrt(n) AS t FROM (SELECT factor, avg(premium) AS m, stddev_samp(premium) AS sd, count(*) AS n FROM pr GROUP BY 1))""", "px rt load pr")
def t10_ranked_summary(spark, sf):
    return rounded(factors.ranked_summary(_premia(spark, sf)))


@query("a23_specific_risk", """
    SELECT entity, round(greatest(coalesce(sd, median(sd) OVER ()), 0.005), 6) AS specific FROM (SELECT rt.entity, stddev_samp(r - m.premium - size * z.premium) AS sd FROM rt JOIN load ON load.entity = rt.entity
    JOIN (SELECT * FROM pr WHERE factor = 'market') m ON m.date = rt.date JOIN (SELECT * FROM pr WHERE factor = 'size') z ON z.date = rt.date GROUP BY 1)""", "px rt load pr")
def a23_specific_risk(spark, sf):
    panel = returns(spark, sf).join(_loadings(spark, sf), "entity")
    return rounded(models.specific_risk(panel, _premia(spark, sf), ["market", "size"]))


@query("s_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s_windowed_counts(spark, sf):
    """The stream's operator over the whole table at once."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return st.windowed_counts(e).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s4_busy_clients", """
    SELECT CAST(user_id AS VARCHAR) AS client, start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 30 MINUTE, CAST(ts AS TIMESTAMP)) - to_minutes(CAST(30 * unnest([0, 1]) AS BIGINT)) AS start FROM events) GROUP BY 1, 2 HAVING count(*) > 1""")
def s4_busy_clients(spark, sf):
    """Clients with more than one request in an hour that slides by half of one."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("client"))
    return st.sliding_counts(e, slide="30 minutes", limit=1).select("client", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("sc5_chart_json", "SELECT date, round(sum(price), 9) AS total, count(*) AS n FROM px GROUP BY 1", "px")
def sc5_chart_json(spark, sf):
    """A document a brand with parallel arrays; midnight in Kolkata is the day's own."""
    p = prices(spark, sf).withColumn("t", F.unix_timestamp(F.col("date").cast("timestamp")) + 3600)
    rows = p.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("t", "price"))).alias("x"))
    docs = rows.select(F.to_json(F.struct(F.col("x.t").alias("timestamp"), F.col("x.price").alias("close"))).alias("value"))
    return parsers.chart_json(docs).groupBy("date").agg(F.round(F.sum("close"), 9).alias("total"), F.count("*").alias("n"))
