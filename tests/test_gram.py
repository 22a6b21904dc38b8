"""Blocked covariances against joins and dense matrices."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram, models, risk


def panel(spark, n=30, days=80, seed=1):
    rng = random.Random(seed)
    rows = [(f"e{i}", dt.date(2020, 1, 1) + dt.timedelta(days=d), rng.gauss(0.001, 0.02 + i / 1000)) for i in range(n) for d in range(days) if rng.random() < 0.8]
    rows += [("lone", dt.date(2030, 1, 1), 0.5), ("e0", dt.date(2030, 1, 2), None), ("never", dt.date(2020, 1, 1), None)]
    return spark.createDataFrame(rows, "entity string, date date, r double").repartition(5)


def matrix(df):
    return {(r.i, r.j): tuple(r)[2:] for r in df.collect()}


@pytest.mark.parametrize("entities,dates", [(256, 256), (4, 7)])
def test_blocks_give_the_joins_covariances(spark, entities, dates):
    data = panel(spark)
    for ours, theirs in ((gram.sample_cov(data, entities=entities, dates=dates), risk.sample_cov(data.where("r is not null"))), (gram.ewma_cov(data.where("r is not null"), entities=entities, dates=dates), risk.ewma_cov(data.where("r is not null")))):
        a, b = matrix(ours), matrix(theirs.where("cov is not null or n_obs = 1") if "n_obs" in theirs.columns else theirs)
        assert a.keys() == b.keys()
        for k in a:
            assert (a[k][0] is None) == (b[k][0] is None) and (a[k][0] is None or abs(a[k][0] - b[k][0]) < 1e-12) and abs(a[k][1] - b[k][1]) < 1e-9


@pytest.mark.parametrize("method", ["ledoit_wolf", "oas"])
def test_shrinkage_by_moments(spark, method):
    data = panel(spark).withColumn("book", F.when(F.col("entity").isin("e1", "e2", "e3"), "small").when(F.col("entity") != "lone", "large"))
    ours = {(r.book, r.i, r.j): r for r in gram.shrinkage_cov(data, method, entities=5, dates=30).collect()}
    dense = {(r.book, r.i, r.j): r for r in models.shrinkage_cov(data.where("book is not null"), method).collect()}
    assert {k for k in ours if k[0]} == dense.keys() and (None, "lone", "lone") in ours
    for k, r in dense.items():
        assert abs(r["cov"] - ours[k]["cov"]) < 1e-9 and abs(r.shrinkage - ours[k].shrinkage) < 1e-9 and ours[k].n_filled == r.n_filled
    with pytest.raises(ValueError):
        gram.shrinkage_cov(data, "other")


def test_groups_weights_repeats_and_none(spark):
    rows = [("x", None, 1, 2.0, 1.0), ("x", "a", 1, 3.0, 1.0), ("x", "a", 1, 1.0, 1.0), ("x", "a", 2, 5.0, 0.5), ("x", None, 2, 4.0, 0.5), (None, "a", 1, 7.0, 2.0)]
    data = spark.createDataFrame(rows, "g string, entity string, day int, r double, w double").withColumn("date", F.timestamp_seconds("day")).drop("day")
    got = {(r.g, r.i, r.j): r for r in gram.moments(data, ["g"], F.col("w")).collect()}
    r = got["x", "a", None]
    assert (r.n, r.sw, r.sw2, r.si, r.sj, r.sij) == (2, 1.5, 1.25, 5.5, 4.0, 16.0)
    assert got["x", None, "a"].si == 4.0 and got[None, "a", "a"].sij == 98.0 and len(got) == 5
    assert gram.moments(data.limit(0)).count() == 0


def test_hot_entities_fare_as_others(spark):
    data = panel(spark).where("r is not null")
    a, b = ({r.entity: r for r in risk.var_historical(data, 0.95, counted=c).collect()} for c in (False, True))
    assert {k: (r["var"], r.n_tail, r.worst, r.n_obs) for k, r in a.items()} == {k: (r["var"], r.n_tail, r.worst, r.n_obs) for k, r in b.items()}
    assert all(abs(a[k].es - b[k].es) < 1e-12 for k in a)
    a, b = (sorted(risk.winsorize(data, 0.1, 0.9, counted=c).collect()) for c in (False, True))
    assert a == b
    prices = data.select("entity", "date", (1 + F.col("r")).alias("price"))
    a, b = (sorted(risk.drawdown(prices, n).collect()) for n in (None, 9))
    assert a == b


def test_actions_without_a_range_join(spark):
    rng = random.Random(4)
    prices = [(e, dt.date(2020, 1, 1) + dt.timedelta(days=d), float(d + 1)) for e in "ab" for d in range(60)] + [("c", None, 5.0), (None, dt.date(2020, 1, 1), 6.0), ("a", dt.date(2020, 1, 1), 0.5), ("a", dt.date(2021, 1, 1), None)]
    actions = [(e, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(-5, 70)), rng.choice([0.5, 0.25, 2.0, None])) for e in "ab" for _ in range(12)] + [("a", None, 0.1), (None, dt.date(2020, 5, 1), 0.1), ("z", dt.date(2020, 5, 1), 0.1)]
    got = risk.adjust_for_actions(spark.createDataFrame(prices, "entity string, date date, price double"), spark.createDataFrame(actions, "entity string, ex_date date, ratio double"), rows_per_block=7)
    want = {}
    for e, d in {(e, d) for e, d, _ in prices}:
        price = max((p for a, b, p in prices if (a, b) == (e, d) and p is not None), default=None)
        factor = float(np.prod([r for a, x, r in actions if e is not None and a == e and d and x and d < x and r is not None]))
        want[e, d] = (None if price is None else price * factor, factor)
    assert {(r.entity, r.date): (r.price, r.factor) for r in got.collect()} == want


def test_quantiles_of_rows_that_are_made_anew(spark):
    """Sums differ in the last bit from one evaluation to the next; a quantile that is a return stays one of the tail."""
    import random

    noise = F.udf(lambda x: x * (1 + random.randrange(-4, 5) * 2.0**-52), "double").asNondeterministic()
    base = spark.range(40 * 101).select((F.col("id") % 40).alias("entity"), F.floor(F.col("id") / 40).alias("date"))
    r = base.withColumn("r", noise((F.col("date") - 50) / 1000.0 + 1e-5))
    got = risk.var_historical(r, counted=True).collect()
    assert [(x.n_tail, x.n_obs) for x in got] == [(2, 101)] * 40
    low = risk.winsorize(r, 0.01, 0.99, counted=True).groupBy("entity").agg(F.min("r").alias("least"), F.max("r").alias("most"), F.count("r").alias("n")).collect()
    assert all(abs(x.least + 0.04899) < 1e-12 and abs(x.most - 0.04901) < 1e-12 and x.n == 101 for x in low) and len(low) == 40
