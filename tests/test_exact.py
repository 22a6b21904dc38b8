"""Stand-ins of the queries whose sums must not depend on the order of rows."""

import random

import duckdb
from pyspark.sql import functions as F

from tidemark.plans import registry


def test_sums_of_amounts_are_exact(spark, tmp_path):
    """Amounts that add up to a whole number in whatever order: volumes, means and ranks are those of the exact sums."""
    amounts = [round(random.Random(i).uniform(900, 99_000), 2) for i in range(200)]
    rows = []
    for brand in range(40):
        random.Random(brand).shuffle(amounts)
        rest = round(-sum(int(round(a * 100)) for a in amounts) % 100 / 100, 2)
        rows += [(f"Brand#{brand}", a) for a in [*amounts, rest]]
    whole = (sum(int(round(a * 100)) for a in amounts) + 99) // 100
    part = spark.createDataFrame([(i, f"Brand#{i}") for i in range(40)], "p_partkey long, p_brand string")
    line = spark.createDataFrame([(int(b[6:]), a, 1.0) for b, a in rows], "l_partkey long, l_extendedprice double, l_quantity double").withColumn("l_shipdate", F.lit("2024-01-02").cast("timestamp"))
    events = line.select(F.col("l_partkey").alias("user_id"), F.lit("view").alias("event_type"), F.col("l_extendedprice").alias("value"))
    for name, frame in (("part", part), ("lineitem", line), ("events", events)):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.prices(spark, str(tmp_path)).collect()
    assert len(got) == 40 and {r.volume for r in got} == {float(whole)} and {r.price for r in got} == {whole / 201}
    ranked = registry.QUERIES["w21_benjamini_hochberg"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.candidate for r in ranked] == list(range(40))


def test_means_on_a_bin_edge_stay_in_their_bin(spark, tmp_path):
    """Values in any order whose mean is 50 exactly: p is a tenth, which closes the first bin."""
    gaps = [round(random.Random(i).uniform(0.01, 49.99), 2) for i in range(60)]
    values, rows = [round(50 + s * g, 2) for g in gaps for s in (1, -1)], []
    for user in range(60):
        random.Random(user).shuffle(values)
        rows += [(user, "view", v) for v in values]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r.bin, r.n) for r in registry.QUERIES["a27_calibration"](spark, str(tmp_path)).collect()] == [(1, 60)]


def test_means_on_a_rounding_edge_are_rounded_as_in_sql(spark, tmp_path):
    """Means of 80 amounts, a quarter of which lie between two numbers of six digits: p is that of the SQL to the last digit."""
    rng = random.Random(12)
    rows = [(user, round(rng.uniform(0, 500), 2)) for user in range(60) for _ in range(80)]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT candidate, p, rank, survives FROM ({registry.SQL['w21_benjamini_hochberg']}) ORDER BY rank").fetchall()
    got = registry.QUERIES["w21_benjamini_hochberg"](spark, str(tmp_path)).orderBy("rank").select("candidate", "p", "rank", "survives").collect()
    assert [tuple(r) for r in got] == want
