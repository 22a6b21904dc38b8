"""Long series against plain windows, loops and percentiles."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from tidemark.operators import series


def ticks(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        e = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(rng.expovariate(1) ** 4 * 1000), microseconds=i)  # bursts
        rows.append((e, at, None if rng.random() < 0.1 else rng.uniform(-1, 1), i))
    return spark.createDataFrame(rows, "entity string, at timestamp_ntz, x double, row int")


@pytest.mark.parametrize("descending,exclusive", [(False, False), (True, False), (False, True)])
def test_scan_is_a_window(spark, descending, exclusive):
    data = ticks(spark)
    made = {"hi": ("max", F.col("x")), "lo": ("min", F.col("x")), "n": ("sum", F.lit(1).cast("long")), "known": ("last", F.col("x")), "growth": ("product", 1 + F.col("x") / 1000)}
    got = series.scan(data, ["entity"], ["at", "row"], made, descending=descending, exclusive=exclusive, rows_per_block=50)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("at", "row")]
    w = W.partitionBy("entity").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    want = data.select("*", F.max("x").over(w).alias("hi"), F.min("x").over(w).alias("lo"), F.sum(F.lit(1).cast("long")).over(w).alias("n"), F.last("x", ignorenulls=True).over(w).alias("known"), F.product(1 + F.col("x") / 1000).over(w).alias("growth"))
    a, b = ({r.row: r for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        assert [a[k][c] for c in ("entity", "hi", "lo", "n", "known")] == [b[k][c] for c in ("entity", "hi", "lo", "n", "known")]
        assert (a[k].growth is None) == (b[k].growth is None) and (a[k].growth is None or math.isclose(a[k].growth, b[k].growth, rel_tol=1e-12))


def test_blocks_are_bounded_for_bursts_too(spark):
    data = ticks(spark)
    block = series.time_block(data, ["entity"], "at", 50)
    sizes = [r["count"] for r in data.groupBy("entity", block.alias("k")).count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 3000
    same = data.withColumn("at", F.lit(dt.datetime(2024, 1, 1)))
    assert same.select(series.time_block(same, ["entity"], "at", 50).alias("k")).distinct().count() == 1  # one instant


def test_scan_of_none_clashes_and_unknown(spark):
    none = spark.createDataFrame([], "entity string, at date, x double")
    assert series.scan(none, ["entity"], ["at"], {"hi": ("max", F.col("x"))}).count() == 0
    odd = spark.createDataFrame([("a", 1, 2.0, 9), ("a", None, 1.0, 9), ("a", 2, 3.0, 9)], "_b0 string, _o0 int, _row double, hi int")
    got = series.scan(odd, ["_b0"], ["_o0"], {"hi": ("max", F.col("_row"))})
    assert sorted(tuple(r) for r in got.select("_row", "hi").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]
    with pytest.raises(ValueError):
        series.scan(odd, ["_b0"], ["_o0"], {"hi": ("median", F.col("_row"))})


def test_rolling_estimates_are_a_loop_with_any_estimator(spark):
    rng = random.Random(2)
    rows = [("long", dt.date(2000, 1, 1) + dt.timedelta(days=i), rng.gauss(0, 1)) for i in range(700)] + [("short", dt.date(2000, 1, 1), 0.5)] * 3 + [("b", dt.date(2001, 1, 1) + dt.timedelta(days=2 * i), None if i == 40 else rng.gauss(0, 2)) for i in range(90)]

    class Result:
        def __init__(self, var):
            self.var = var

    def estimator(values: pd.Series, confidence):
        if values.iloc[-1] > 2:
            raise ArithmeticError("too wild")
        if values.iloc[-1] < -2:
            return float("nan")
        return Result(-values.quantile(1 - confidence) + len(values) / 1e6 + values.index[0].toordinal() / 1e9)

    data = spark.createDataFrame(rows, "entity string, date date, r double").repartition(5)
    for window, step, size in ((60, 1, 64), (60, 7, 16), (30, 3, None)):  # windows longer than a group too
        got = {(r.entity, r.date): (r.estimate, r.error) for r in series.rolling(data, estimator, window, step, rows_per_task=size, confidence=0.9).collect()}
        want = {}
        for e in ("long", "short", "b"):
            known = [(d, r) for x, d, r in sorted((x for x in rows if x[0] == e), key=lambda x: x[1]) if r is not None]
            for i in range(window, len(known), step):
                past = pd.Series([r for _, r in known[i - window : i]], index=[d for d, _ in known[i - window : i]])
                try:
                    v = estimator(past, confidence=0.9)
                    want[e, known[i][0]] = (v.var, None) if isinstance(v, Result) else (None, "no finite number")
                except ArithmeticError as failed:
                    want[e, known[i][0]] = (None, f"ArithmeticError: {failed}")
        assert got == want and any(e for _, e in want.values())
    assert series.rolling(data.limit(0), estimator, 5, confidence=0.9).count() == 0


def test_rolling_splits_a_long_entity(spark):
    data = spark.range(20000).select(F.lit("one").alias("entity"), F.col("id").alias("date"), F.sin("id").alias("r"))
    block = F.floor(F.col("date") / 500)
    placed = series.numbered(data.withColumnRenamed("r", "x"), ["entity"], ["date"], block=block)
    assert placed.where("position <> date").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = series.rolling(data, lambda v: float(v.sum()), 100, block=block, rows_per_task=500).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in got) == 19900 and len(got) == 4 and max(r["count"] for r in got) < 10000


def test_quantiles_are_percentile_bit_for_bit(spark):
    rng = random.Random(3)
    shares = [0.0, 1 - 0.99, 0.05, 0.5, 0.975, 1.0]
    rows = [("wide", rng.gauss(0, 1) * 10 ** rng.randint(-30, 30)) for _ in range(4000)] + [("ties", float(rng.choice([1, 1, 1, 2]))) for _ in range(3000)] + [("two", float(i % 2)) for i in range(2000)]
    rows += [("same", 7.5)] * 2500 + [("one", 3.25)] + [("none", None)] * 5 + [(None, float(i) ** 3) for i in range(2100)] + [("nan", float("nan")), ("nan", 1.0)]
    data = spark.createDataFrame(rows, "g string, x double").repartition(6)
    want = {r.g: list(r.q) for r in data.where("not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*[F.lit(q) for q in shares])).alias("q")).collect() if r.q}
    assert {r.g: list(r.quantiles) for r in series.quantiles(data, ["g"], "x", shares, few=40).collect()} == want
    assert {r.g: list(r.quantiles) for r in series.quantiles(data, ["g"], "x", shares).collect()} == want
    (all_of,) = series.quantiles(data.where("g in ('wide', 'same')"), [], "x", [0.25], few=16).collect()
    assert all_of.quantiles == [data.where("g in ('wide', 'same')").agg(F.percentile("x", 0.25)).first()[0]]
    assert series.quantiles(data.limit(0), ["g"], "x", [0.5]).count() == 0
